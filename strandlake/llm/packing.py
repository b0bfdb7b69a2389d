"""Packing documents into windows by Karmarkar-Karp multiway differencing.

A document's ids fill as many whole windows as they can; what remains, less than a window, is one
piece. Remaining pieces are dealt at random into batches of about ``BATCH``. A batch starts with as many
windows as its tokens need at least. Every piece is a partial partition with one window in use; the two
partial partitions with the largest imbalance are merged, the fullest window of one with the emptiest of the
other, until one is left. If a window then holds more than its capacity, the window count rises by one and
the batch is packed anew. A document's cuts depend on its own ids only, so texts are tokenised once
and neither texts nor ids are moved.

Ids are those of the tokenizers library. Texts of common characters are normalised and split here, and
only words that a worker hasn't met go to the library; any other text goes to it whole.

Edge cases: null and empty texts have the end id only; a null or repeated doc_id is packed like any other row;
an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe import CACHE_BYTES, NEAR_DIGITS, slices
from .common import require, table, vocabulary, written

CAPACITY = 4096
BATCH = 1024
END = 2
#: New words that are encoded as one text, and words that a worker keeps.
JOINED = 64
CACHE_WORDS = 1_000_000

# The splitting pattern of the vocabulary file for lower-case texts of the characters below.
LOW_LETTERS = "a-zªµºß-öø-ʯ"
WORDS = re.compile(rf"'(?:[stmd]|re|ve|ll)|[{LOW_LETTERS}]+|[{NEAR_DIGITS}]|[^\s{LOW_LETTERS}{NEAR_DIGITS}]+")
#: Anything else, and what the library might take for an added token, takes the library's own path.
UNUSUAL = re.compile("[^\t\n\r -~¡-ʯ‐-‧]|<\\|")


class Words:
    """Ids of texts by a vocabulary file of the tokenizers library whose words are encoded one by one."""

    def __init__(self, path: str) -> None:
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.ends = np.zeros(self.library.get_vocab_size(), dtype=bool)
        for token, i in self.library.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.cache: dict[str, bytes] = {}

    def fresh(self, words: list[str]) -> list[bytes]:
        """Ids of each word. Many are encoded as one text, which is cut after the tokens that end a word, one to a word."""
        out = []
        for at in range(0, len(words), JOINED):
            some = words[at : at + JOINED]
            ids = np.array(self.library.encode(" ".join(some), add_special_tokens=False).ids, dtype="<u4")
            ends = (4 * np.nonzero(self.ends[ids])[0] + 4).tolist()
            if len(ends) == len(some):
                coded = ids.tobytes()
                out += [coded[a:b] for a, b in zip([0, *ends], ends, strict=False)]
            else:
                out += self.whole(some)
        return out

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.library.encode_batch(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        normal = unicodedata.normalize
        lower = [normal("NFC", t).lower() for t in texts]
        usual = [None if UNUSUAL.search(t) else WORDS.findall(t) for t in lower]
        known = self.cache
        new = list({w for ws in usual if ws for w in ws if w not in known})
        if len(known) + len(new) > CACHE_WORDS:
            known.clear()
            new = list({w for ws in usual if ws for w in ws})
        known.update(zip(new, self.fresh(new), strict=True))
        get = known.__getitem__
        rest = iter(self.whole([t for t, ws in zip(texts, usual, strict=True) if ws is None]))
        out = [next(rest) if ws is None else b"".join(map(get, ws)) for ws in usual]
        for w in new:
            if len(w) > CACHE_BYTES:
                del known[w]
        return out


@cache
def load(path: str) -> Words:
    return Words(path)


def differencing(sizes: list[int], count: int) -> list[list[int]]:
    """Karmarkar-Karp: deals positions of ``sizes`` to ``count`` windows of near-equal sums.

    A partial partition lists only windows in use, fullest first; the others are empty. Its imbalance is the
    difference between its fullest and its emptiest window.
    """
    heap = [(-s, i, [(s, [i])]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    turn = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        over = len(a) + len(b) - count
        if over > 0:
            # The fullest of a stand with b's emptiest: those beyond count - len(b) have a partner.
            kept, shared = a[: len(a) - over], a[len(a) - over :]
            alone, other = b[: len(b) - over], b[len(b) - over :]
            both = [(x[0] + y[0], x[1] + y[1]) for x, y in zip(shared, reversed(other), strict=True)]
            merged = kept + alone + both
        else:
            merged = a + b
        merged.sort(key=lambda w: -w[0])
        least = merged[-1][0] if len(merged) == count else 0
        heapq.heappush(heap, (least - merged[0][0], turn, merged))
        turn += 1
    windows = [w[1] for w in heap[0][2]] if heap else []
    return windows + [[] for _ in range(count - len(windows))]


def pack(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Windows of at most ``capacity``, as lists of positions of ``sizes``; no size is above the capacity."""
    count = -(-sum(sizes) // capacity)
    while count:
        windows = differencing(sizes, count)
        if all(sum(sizes[i] for i in w) <= capacity for w in windows):
            return [w for w in windows if w]
        count += 1
    return []


PIECES = "row long, doc_id {key}, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Each document's ids and the end id, cut at multiples of the capacity: one row per piece, ids by checksum."""
    require(docs, "doc_id", "text")
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, last = load(path), np.array([end], dtype="<u4").tobytes()
        for part, texts in slices(batches, "text"):
            at, start, length, crc, total = [], [], [], [], []
            for i, ids in enumerate(words.encode(texts)):
                ids += last
                for low in range(0, len(ids), 4 * capacity):
                    piece = ids[low : low + 4 * capacity]
                    at.append(i)
                    start.append(low // 4)
                    length.append(len(piece) // 4)
                    crc.append(zlib.crc32(piece))
                    total.append(len(ids) // 4)
            at = pa.array(at, pa.int64())
            columns = [part.column("row").take(at), part.column("doc_id").take(at), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return numbered.mapInArrow(run, PIECES.format(key=docs.schema["doc_id"].dataType.simpleString()))


def assign(cut: DataFrame, capacity: int = CAPACITY, batch: int = BATCH) -> DataFrame:
    """(row, sequence_id, offset) of every piece of the written table ``cut`` that is shorter than a window."""
    part = cut.filter(F.col("length") < capacity).select("row", "length")
    # Batches differ little in size, as rows are dealt by a hash; their number follows the input.
    batches = max(1, -(-part.count() // batch))
    dealt = part.withColumn("batch", F.pmod(F.xxhash64("row"), F.lit(batches)))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("row", ignore_index=True)
        sizes, numbers = rows["length"].tolist(), rows["row"].tolist()
        out = []
        for w, window in enumerate(pack(sizes, capacity)):
            offset = 0
            for i in sorted(window):
                out.append((numbers[i], (int(key[0]) << 20) + w, offset))
                offset += sizes[i]
        return pd.DataFrame(out, columns=["row", "sequence_id", "offset"])

    return dealt.groupBy("batch").applyInPandas(run, "row long, sequence_id long, offset long")


def windows(docs: DataFrame, path: str, capacity: int = CAPACITY, batch: int = BATCH) -> DataFrame:
    """Every piece of every document with its sequence and offset there; ids of sequences that one piece fills are negative."""
    cut = written(pieces(docs, path, capacity), "pieces")
    rest, whole = assign(cut, capacity, batch), cut.filter(F.col("length") >= capacity)
    named = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    packed = cut.filter(F.col("length") < capacity).join(rest, "row").select(*named)
    return packed.unionByName(whole.withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long")).select(*named))


def op6_packing(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """All of ``documents`` in sequences of at most 4,096 tokens."""
    return windows(table(spark, sf_dir, "documents"), path or vocabulary("word_bpe_49k.json"))
