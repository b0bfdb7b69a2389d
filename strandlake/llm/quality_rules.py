"""Quality rules: word and line counts, and how a public tokenizer takes a text.

Fertility is measured on whole texts with a SentencePiece vocabulary: characters of words per token, the share of
tokens that fall back to bytes, and the entropy of the tokens. What is usual differs by language and length, so
rejection bands belong to a class: the language if it is given, else the script of most letters, and the power of two
below the number of tokens. A band reaches ``WIDTH`` robust deviations (from quartiles over all rows of the class, each side for itself)
from the median. Where fewer than ``LEAST`` rows are of a size, the bands of the whole class count; where a class has fewer, the base
rules alone do.

Edge cases: null texts have no words and fail the base rules, as do empty ones; null languages fall back to the script; null or
repeated ids keep their rows; an empty table gives an empty result; other columns are kept by ``judged`` and ignored by the query.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import slices
from .common import require, table, vocabulary, written

LEAST_WORDS = 50
WIDTH = 7.0
LEAST = 100
#: Least deviations, so that a class of like texts has no needle-thin band.
FLOOR = {"chars_per_token": 0.03, "byte_share": 0.004, "entropy": 0.06}
SYMBOLS = "#*$%&|<>"

MEASURES = {
    "n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long",
    "n_tokens": "long", "chars_per_token": "double", "byte_share": "double", "entropy": "double", "script": "string",
}


def repeated_words(words: list) -> int:
    """Words that are in some 3-word window found twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    often = Counter(windows)
    count, free = 0, 0
    for i, w in enumerate(windows):
        if often[w] > 1:
            count += i + 3 - max(i, free)
            free = i + 3
    return count


def repeated_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.encode().split()]
    return len(lines) - len(set(lines))


@cache
def script_of(letter: str) -> str:
    return unicodedata.name(letter, "OTHER").split(" ")[0].split("-")[0]


def script(text: str) -> str:
    """The script of most letters, by the first word of their Unicode names; ties go to the first by name."""
    counts: Counter = Counter()
    for c, n in Counter(text).items():
        if c.isalpha():
            counts[script_of(c)] += n
    return min(counts, key=lambda s: (-counts[s], s), default="NONE")


@cache
def tokenizer(path: str):
    import sentencepiece

    found = sentencepiece.SentencePieceProcessor(model_file=path)
    bytes_at = np.array([found.is_byte(i) for i in range(found.get_piece_size())])
    return found, bytes_at


def measure(texts: list[str], path: str) -> dict[str, list]:
    found, bytes_at = tokenizer(path)
    out: dict[str, list] = {k: [] for k in MEASURES}
    for text in texts:
        words = text.encode("utf-8").split()
        ids = np.array(found.encode(text), dtype=np.int64)
        chars = len(b"".join(words).decode("utf-8"))
        _, counts = np.unique(ids, return_counts=True)
        p = counts / max(1, len(ids))
        row = (
            len(words), chars, sum(map(text.count, SYMBOLS)), repeated_lines(text), repeated_words(words),
            len(ids), chars / max(1, len(ids)), float(bytes_at[ids].mean()) if len(ids) else 0.0, float(-(p * np.log2(p)).sum()) + 0.0, script(text),
        )
        for k, v in zip(MEASURES, row, strict=True):
            out[k].append(v)
    return out


def measured(docs: DataFrame, path: str, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` in a struct ``row``, and the measures of every whole text."""
    require(docs, "text", *keep)
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    source = docs.select(F.struct(*keep).alias("row"), F.col("text").alias("__text"), lang.alias("lang"))
    kind = source.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "__text"):
            found = measure(texts, path)
            columns = [part.column("row"), part.column("lang"), *(pa.array(found[k], {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}[t]) for k, t in MEASURES.items())]
            yield pa.RecordBatch.from_arrays(columns, ["row", "lang", *MEASURES])

    return source.mapInArrow(run, f"row {kind}, lang string, {', '.join(f'{k} {t}' for k, t in MEASURES.items())}")


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def bands(found: DataFrame, *keys: str) -> DataFrame:
    """Bounds of each class, from all its rows."""
    quartiles = [F.percentile_approx(k, [0.25, 0.5, 0.75], 2000).alias(k) for k in FLOOR]
    sums = found.groupBy(*keys).agg(F.count("*").alias("n"), *quartiles).filter(F.col("n") >= LEAST)
    sides = []
    for k, floor in FLOOR.items():
        low, mid, high = (F.col(k)[i] for i in range(3))
        sides += [(mid - WIDTH * F.greatest((mid - low) / 0.6745, F.lit(floor))).alias(f"{k}_low"), (mid + WIDTH * F.greatest((high - mid) / 0.6745, F.lit(floor))).alias(f"{k}_high")]
    return sums.select(*keys, *sides)


def verdicts(found: DataFrame) -> DataFrame:
    """``found``, a written table of measures, with ``base_failed`` and ``kept``."""
    found = found.withColumn("class", F.coalesce("lang", F.concat(F.lit("script "), "script"))).withColumn("size", F.floor(F.log2(F.greatest("n_tokens", F.lit(1)))).cast("int"))
    judged = found.withColumn("base_failed", base_failed())
    usual = found.filter(F.col("n_words") >= LEAST_WORDS)
    for keys in (["class", "size"], ["class"]):
        bounds = written(bands(usual, *keys), "bands")
        bounds = bounds.select(*keys, *[F.col(c).alias(f"{c}_{len(keys)}") for c in bounds.columns if c not in keys])
        # Languages are few, but that is checked before they are broadcast.
        judged = judged.join(F.broadcast(bounds) if bounds.count() <= 10_000 else bounds, keys, "left")
    out = F.lit(False)
    for k, sides in (("chars_per_token", ("low", "high")), ("byte_share", ("high",)), ("entropy", ("low",))):
        for side in sides:
            bound = F.coalesce(f"{k}_{side}_2", f"{k}_{side}_1")
            out = out | F.coalesce(F.col(k) < bound if side == "low" else F.col(k) > bound, F.lit(False))
    return judged.withColumn("kept", ~F.col("base_failed") & ~out)


def accepted(docs: DataFrame, path: str) -> DataFrame:
    """The rows of ``docs`` that the rules keep, unchanged."""
    # Texts are written beside their measures once, so that the verdict needs no shuffle of texts.
    found = written(measured(docs, path, docs.columns), "measured")
    return verdicts(found).filter("kept").select("row.*")


def op9_quality_rules(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Every whole text of ``documents``, judged."""
    found = written(measured(table(spark, sf_dir, "documents"), path or vocabulary("piece_bpe_32k.model"), ["doc_id"]), "measured")
    return verdicts(found).select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_tokens", "chars_per_token", "byte_share", "entropy"
    )
