"""Language identification by language-bitmask n-gram filters.

One table of bit slices holds a Bloom filter for each language: slot s has a mask with the bit of every
language whose filter has bit s. The conjunction of an n-gram's slots is the set of all languages that contain
it. A text's n-grams are looked up at once; per-language popcounts of the masks, corrected for each filter's rate of
false positives, decide.

A language contains the n-grams that are common in a sample of its texts: at least ``FIT_COUNT`` times, and at least
``FIT_SHARE`` as frequent as in the language where they are most frequent. The sample is drawn by a hash of doc_id, about
``FIT_DOCS`` texts of each language; counting, filtering and setting bits are distributed, and only slots, of which there are
``SLOTS`` at most, come to the driver.

Edge cases: a null text or one without letters is ``und`` with score 0; so is every text if nothing can be learned; ties go to the
first language by name; a null doc_id hashes like the empty text; repeated rows stay; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import slices
from .common import require, table, written

FIT_DOCS = 3000
FIT_COUNT = 4
FIT_SHARE = 0.1
SLOTS = 1 << 22
SIZES = (3, 4, 5)
HASHES = 2
UND = "und"


@cache
def letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def normal(text: str) -> np.ndarray:
    """Code points of the lower-case text; each run of others than letters is one space, also at both ends."""
    codes = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), dtype="<u4")
    is_letter = letters()[codes]
    keep = is_letter.copy()
    keep[0] = True
    keep[1:] |= is_letter[:-1]
    return np.where(is_letter, codes, 32)[keep]


def grams(text: str) -> np.ndarray:
    """A 64-bit hash of every n-gram of each size that isn't made of spaces."""
    codes = normal(text).astype(np.uint64)
    if len(codes) <= 1:
        return np.zeros(0, dtype=np.uint64)
    out = []
    for n in SIZES:
        count = len(codes) - n + 1
        if count > 0:
            h = np.full(count, n, dtype=np.uint64)
            for i in range(n):
                h = (h ^ codes[i : i + count]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            out.append(h)
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def slots(h: np.ndarray, i: int) -> np.ndarray:
    """The i-th slot of each n-gram."""
    return (h >> np.uint64(22 * i)) & np.uint64(SLOTS - 1)


@dataclass
class Filters:
    """Masks by word of 64 languages and slot; the share of each language's set bits gives its false positives."""

    names: list[str]
    masks: list[np.ndarray]

    def __post_init__(self) -> None:
        fill = np.array([np.count_nonzero(self.masks[i // 64] >> self.masks[0].dtype.type(i % 64) & self.masks[0].dtype.type(1)) / SLOTS for i in range(len(self.names))])
        self.false = fill**HASHES

    def counts(self, h: np.ndarray) -> np.ndarray:
        """Corrected counts of the n-grams that each language contains."""
        out = np.zeros(len(self.names))
        at = [slots(h, i).astype(np.int64) for i in range(HASHES)]
        for w, masks in enumerate(self.masks):
            found = masks[at[0]]
            for x in at[1:]:
                found = found & masks[x]
            for i in range(64 * w, min(64 * w + 64, len(self.names))):
                out[i] = np.count_nonzero(found & masks.dtype.type(1 << i % 64))
        return np.maximum(0.0, (out - len(h) * self.false) / (1 - self.false + 1e-12))

    def predict(self, text: str | None) -> tuple[str, float]:
        h = grams(text or "")
        if not len(h) or not self.names:
            return UND, 0.0
        found = self.counts(h)
        best = int(np.argmax(found))
        total = found.sum()
        # Nothing found in any language: the first one by name, with no confidence.
        return self.names[best], float(found[best] / total) if total > 0 else 0.0


def remainder(key: Column, by: int) -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit(""))), F.lit(by))


def fit(rows: DataFrame, docs_per_language: int = FIT_DOCS) -> Filters:
    """Filters from ``rows(doc_id, text, lang)``, all of which may be learned from."""
    require(rows, "doc_id", "text", "lang")
    labelled = rows.filter("lang is not null and text is not null").select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    sizes = labelled.groupBy("lang").count().collect()
    names = sorted(r["lang"] for r in sizes)
    if not names:
        return Filters([], [np.zeros(SLOTS, dtype=np.uint8)])
    share = {r["lang"]: min(1.0, docs_per_language / r["count"]) for r in sizes}
    most = F.create_map(*[F.lit(x) for k, v in share.items() for x in (k, v)])
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    sample = labelled.filter(draw < most[F.col("lang")]).select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "text"):
            langs = part.column("lang").to_pylist()
            for lang in sorted(set(langs)):
                h, n = np.unique(np.concatenate([grams(t) for t, k in zip(texts, langs, strict=True) if k == lang]), return_counts=True)
                if len(h):
                    yield pa.RecordBatch.from_arrays([pa.array([names.index(lang)] * len(h), pa.int32()), pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["i", "h", "n"])

    counted = sample.mapInArrow(count, "i int, h long, n long").groupBy("h", "i").agg(F.sum("n").alias("n")).filter(F.col("n") >= FIT_COUNT)
    counted = written(counted, "grams")
    totals = {r["i"]: r["n"] for r in counted.groupBy("i").agg(F.sum("n").alias("n")).collect()}
    if not totals:
        return Filters([], [np.zeros(SLOTS, dtype=np.uint8)])
    rate = F.col("n") / F.create_map(*[F.lit(x) for k, v in totals.items() for x in (k, float(v))])[F.col("i")]
    rated = counted.withColumn("rate", rate)
    top = rated.groupBy("h").agg(F.max("rate").alias("top"))
    held = rated.join(top, "h").filter(F.col("rate") >= FIT_SHARE * F.col("top"))
    at = F.explode(F.array(*[F.shiftrightunsigned("h", 22 * i).bitwiseAND(F.lit(SLOTS - 1)) for i in range(HASHES)])).alias("slot")
    bits = held.select(at, (F.col("i") / 64).cast("int").alias("word"), F.expr("shiftleft(1L, i % 64)").alias("bit"))
    set_bits = bits.groupBy("word", "slot").agg(F.bit_or("bit").alias("mask")).toArrow()
    width = np.uint8 if len(names) <= 8 else np.uint64
    masks = [np.zeros(SLOTS, dtype=width) for _ in range(-(-len(names) // 64))]
    word, slot, mask = (set_bits.column(c).to_numpy() for c in ("word", "slot", "mask"))
    for w, m in enumerate(masks):
        m[slot[word == w]] = mask[word == w].view(np.uint64).astype(width)
    return Filters(names, masks)


def predict(docs: DataFrame, filters: Filters) -> DataFrame:
    """(doc_id, lang_pred, score) of every whole text."""
    require(docs, "doc_id", "text")
    names, masks = filters.names, filters.masks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Filters(names, masks)
        for part, texts in slices(batches, "text"):
            found = [model.predict(t) for t in texts]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def op10_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text of ``documents``, learned from rows whose id's crc32 mod 4 isn't 2."""
    docs = table(spark, sf_dir, "documents")
    held_out = remainder(F.col("doc_id"), 4) == 2
    filters = fit(docs.filter(~held_out).select("doc_id", "text", "lang"))
    return predict(docs, filters).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
