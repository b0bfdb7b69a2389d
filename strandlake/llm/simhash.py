"""SimHash near-duplicates with anchor points of a covering code.

Fingerprints link at ``distance`` or fewer differing bits. They are cut into blocks; a block is a word of the space of a perfect
code, whose code words are the anchors, and every word is within the covering radius of one. Each fingerprint goes to every
anchor within radius plus threshold of each of its blocks. Of a pair that differs in no more bits of a block than the threshold,
the anchor next to the one is then within reach of the other, so the pair meets there. Two schemes are made of this:

* ``EXACT``: 64 bits in three blocks, the binary Golay code (23 bits, radius 3, 4,096 anchors; shorter blocks have zeros above),
  threshold 1. A pair that differs in 4 bits differs in one bit at most of some block, so every link is found.
* ``WIDE``: for a given similarity of shingle sets rather than a number of bits. 192 bits of the set (repeats of a shingle count
  once) in twelve blocks of 15, the Hamming code (15 bits, radius 1, 2,048 anchors), threshold 1. At Jaccard similarity 0.8 two
  fingerprints differ in 29 bits of 192 on average (36 for sets of four and five); pairs at 56 bits or fewer are candidates only, and
  an edge is one whose sets are compared and found at 0.8 or more.

Candidates are compared in two steps. At each anchor the edges of a spanning forest of the candidates come first; what these
connect needs no other comparison, so a large group of copies costs about as many as it has members. Only the anchors where a
forest edge fails are gone through again, and there only the tree with that edge, for all its candidates between groups that
are still apart.

Fingerprints are compared once for all documents that share them. At an anchor they are compared
by exclusive or and bit count, in tiles; out go only edges of a spanning forest, never all pairs. Sets whose sizes differ by more
than the similarity allows can't be similar, so an anchor's members stand by size and meet only those within that ratio. A very large
anchor is dealt out as pairs of parts of bounded size, so no task holds a whole one; a part is large, as every member is sent to as
many cells as its anchor has parts. Anchors are counted in a pass of their own, so that members are never written before they are dealt out.

Edge cases: null texts count as empty; documents without words have fingerprint zero and link like any
other; a null doc_id keeps its row, and its component is the least doc_id of the group that isn't null; repeated rows
stay; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import slices
from .common import reclaim, require, table, written
from .components import components

SEED = 42
#: Most fingerprints in one part of an anchor, on average; a cell holds two parts.
PART = 1 << 16
#: Rows and columns of the tiles in which a cell is compared.
TILE = (512, 8192)


@dataclass(frozen=True)
class Scheme:
    """``blocks``: (word, lowest bit, bits) of a fingerprint of ``words`` 64-bit words; ``generator`` makes a code of dimension ``k``.

    With a ``similarity``, ``distance`` gives candidates, and links are those of at least that Jaccard similarity.
    """

    words: int
    blocks: tuple[tuple[int, int, int], ...]
    generator: int
    k: int
    radius: int
    threshold: int
    distance: int
    similarity: Fraction | None = None


EXACT = Scheme(1, ((0, 0, 22), (0, 22, 21), (0, 43, 21)), 0b101011100011, 12, 3, 1, 4)
WIDE = Scheme(3, tuple((w, 16 * i, 15) for w in range(3) for i in range(4)), 0b10011, 11, 1, 1, 56, Fraction(4, 5))


def shingles(text: str, size: int) -> list[bytes]:
    words = text.encode().lower().split()  # bytes: only A-Z are lowered, only the six ASCII white spaces split
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False)))


def fingerprint(text: str, size: int = 4, words: int = 1) -> list[int]:
    """SimHash of the shingles of ``size`` words: a bit is 1 if it is in more than half of their XXH64 values; one seed to a word."""
    return majority(shingles(text, size), words)


def majority(parts: list[bytes], words: int) -> list[int]:
    if not parts:
        return [0] * words
    digest, out = xxhash.xxh64_intdigest, []
    for seed in range(SEED, SEED + words):
        hashes = np.array([digest(p, seed) for p in parts], dtype=">u8")
        ones = np.zeros(64, dtype=np.int64)
        for at in range(0, len(hashes), 4096):
            part = hashes[at : at + 4096]
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        out.append(int.from_bytes(np.packbits(2 * ones > len(parts)).tobytes(), "big"))
    return out


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, size: int = 4, key: str = "doc_id", words: int = 1) -> DataFrame:
    """(key, fp, words) of every text: the fingerprint's words in binary, and as a signed integer, or a hash of them if there are several."""
    require(docs, key, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "text"):
            found = [np.array(fingerprint(t, size, words), dtype="<u8") for t in texts]
            names = [signed(int(x[0]) if words == 1 else xxhash.xxh64_intdigest(x.tobytes())) for x in found]
            yield pa.RecordBatch.from_arrays([part.column(key), pa.array(names, pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())], [key, "fp", "words"])

    return docs.select(key, "text").mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, fp long, words binary")


def shingle_set(text: str, size: int) -> np.ndarray:
    """The sorted XXH64 values of the text's different shingles."""
    return np.array(sorted({xxhash.xxh64_intdigest(p, SEED) for p in shingles(text, size)}), dtype="<u8")


def set_name(hashes: np.ndarray) -> int:
    return signed(xxhash.xxh64_intdigest(hashes.tobytes()))


def set_fingerprints(docs: DataFrame, size: int, key: str, words: int) -> DataFrame:
    """(key, fp, words, n) of every text: ``fp`` names its set of shingles, ``words`` is the fingerprint of the set, ``n`` its size."""
    require(docs, key, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "text"):
            names, found, sizes = [], [], []
            for t in texts:
                parts = {xxhash.xxh64_intdigest(p, SEED): p for p in shingles(t, size)}
                names.append(set_name(np.array(sorted(parts), dtype="<u8")))
                found.append(np.array(majority(list(parts.values()), words), dtype="<u8").tobytes())
                sizes.append(len(parts))
            yield pa.RecordBatch.from_arrays([part.column(key), pa.array(names, pa.int64()), pa.array(found, pa.binary()), pa.array(sizes, pa.int64())], [key, "fp", "words", "n"])

    return docs.select(key, "text").mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, fp long, words binary, n long")


def shingle_sets(texts: DataFrame, size: int) -> DataFrame:
    """(fp, shingles) of ``texts(fp, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in slices(batches, "text"):
            sets = [shingle_set(t, size).view("<i8") for t in found]
            yield pa.RecordBatch.from_arrays([part.column("fp"), pa.array(sets, pa.list_(pa.int64()))], ["fp", "shingles"])

    return texts.select("fp", "text").mapInArrow(run, "fp long, shingles array<long>")


@cache
def anchors(generator: int = EXACT.generator, k: int = EXACT.k) -> np.ndarray:
    """The code words of a cyclic code: multiples of its generator polynomial, in all ways."""
    words = np.zeros(1 << k, dtype=np.uint32)
    for bit in range(k):
        words ^= np.where(np.arange(1 << k) >> bit & 1, np.uint32(generator << bit), np.uint32(0))
    return words


def replicas(fps: np.ndarray, scheme: Scheme) -> tuple[np.ndarray, np.ndarray]:
    """(row of ``fps``, anchor) of all anchors within reach of each block; ``fps`` has a row of words for each fingerprint."""
    rows, names = [], []
    code = anchors(scheme.generator, scheme.k)
    for i, (word, at, width) in enumerate(scheme.blocks):
        block = (fps[:, word] >> np.uint64(at) & np.uint64((1 << width) - 1)).astype(np.uint32)
        for low in range(0, len(block), 512):
            near = np.bitwise_count(block[low : low + 512, None] ^ code[None, :]) <= scheme.radius + scheme.threshold
            row, name = np.nonzero(near)
            rows.append(row + low)
            names.append(name.astype(np.int64) + i * len(code))
    return np.concatenate(rows), np.concatenate(names)


def differing(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Differing bits of each row of ``left`` and each of ``right``."""
    total = np.bitwise_count(left[:, 0, None] ^ right[None, :, 0])
    for w in range(1, left.shape[1]):
        total = total + np.bitwise_count(left[:, w, None] ^ right[None, :, w])
    return total


def matrix(column: pa.ChunkedArray | pa.Array, words: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u8").reshape(-1, words)


def tiles(left: np.ndarray, right: np.ndarray, distance: int, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (positions in left, in right) within the distance, tile by tile; equal arrays: each pair once.

    Row i of ``left`` is compared with rows ``low[i]`` to ``high[i]`` (exclusive) of ``right`` only; both bounds never fall.
    """
    rows, columns = TILE
    for top in range(0, len(left), rows):
        end = min(top + rows, len(left))
        for at in range(max(int(low[top]), top if left is right else 0), int(high[end - 1]), columns):
            stop = min(at + columns, int(high[end - 1]))
            a, b = np.nonzero(differing(left[top:end], right[at:stop]) <= distance)
            a, b = a + top, b + at
            keep = (low[a] <= b) & (b < high[a])
            if left is right:
                keep &= a < b
            yield a[keep], b[keep]


def reach(left: np.ndarray, right: np.ndarray, similarity: Fraction | None) -> tuple[np.ndarray, np.ndarray]:
    """Bounds in ``right``, sizes in order, of the sets that can be as similar as that to each in ``left``, sizes in order."""
    if similarity is None:
        return np.zeros(len(left), np.int64), np.full(len(left), len(right))
    least = -(-left * similarity.numerator // similarity.denominator)
    return np.searchsorted(right, least), np.searchsorted(right, left * similarity.denominator // similarity.numerator, "right")


def forest(left: np.ndarray, right: np.ndarray, distance: int, low: np.ndarray, high: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """Edges (positions in left, in right, a mark of their tree) of a spanning forest of all links between the two; equal arrays: within one."""
    shift = 0 if left is right else len(left)
    parent = list(range(len(left) if left is right else len(left) + len(right)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    us, vs = [], []
    known = np.arange(len(parent))
    for a, b in tiles(left, right, distance, low, high):
        # Most pairs of a large group are in one tree by an earlier tile already.
        new = known[a] != known[b + shift]
        before = len(us)
        for x, y in zip(a[new].tolist(), b[new].tolist(), strict=True):
            p, q = find(x), find(y + shift)
            if p != q:
                parent[max(p, q)] = min(p, q)
                us.append(x)
                vs.append(y)
        if len(us) > before and new.sum() > 4096:
            known = np.array([find(x) for x in range(len(parent))])
    return us, vs, [find(x) for x in us]


def candidates(left: np.ndarray, right: np.ndarray, distance: int, low: np.ndarray, high: np.ndarray, left_groups: np.ndarray, right_groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (positions in left, in right) within the distance whose groups differ; equal arrays: within one."""
    us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a, b in tiles(left, right, distance, low, high):
        keep = left_groups[a] != right_groups[b]
        us.append(a[keep])
        vs.append(b[keep])
    return np.concatenate(us), np.concatenate(vs)


def place(fps: DataFrame, scheme: Scheme) -> DataFrame:
    """(anchor, a, b, part, fp, words, n): the written table ``fps(fp, words, n)`` (distinct) at its anchors, each anchor as pairs (a, b) of its parts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(scheme.blocks) << scheme.k, dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                total += np.bincount(replicas(matrix(batch.column("words").slice(at, 2048), scheme.words), scheme)[1], minlength=len(total))
        some = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["anchor", "n"])

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                row, anchor = replicas(matrix(part.column("words"), scheme.words), scheme)
                row = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), *(part.column(c).take(row) for c in ("fp", "words", "n"))], ["anchor", "fp", "words", "n"])

    counts = fps.select("words").mapInArrow(count, "anchor long, n long")
    placed = fps.select("fp", "words", "n").mapInArrow(replicate, "anchor long, fp long, words binary, n long")
    # Anchors with more than PART members are dealt out as pairs of parts. There are as many anchors as blocks times code words:
    # 12,288 or 24,576, so their sizes may be broadcast.
    sizes = counts.groupBy("anchor").agg(F.sum("n").alias("members")).filter("members > 1").select("anchor", F.ceil(F.col("members") / PART).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    dealt = placed.join(F.broadcast(sizes), "anchor").withColumn("part", part)
    other = F.explode(F.expr("sequence(0, parts - 1)"))
    return dealt.withColumn("other", other).select("anchor", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"), "part", "fp", "words", "n")


CELL = ["anchor", "a", "b"]


def compared(dealt: DataFrame, scheme: Scheme, keys: list[str]) -> DataFrame:
    """(anchor, a, b, tree, u, v): of each cell of ``dealt`` the edges of a spanning forest of its candidates; with a column ``group``,
    all candidates between different groups."""
    everything = "group" in dealt.columns

    def compare(key: tuple, cell: pa.Table) -> pa.Table:
        # In order of size and fp, so that cells with the same members give the same pairs.
        cell = cell.sort_by([("n", "ascending"), ("fp", "ascending")])
        fp, n, part = (cell.column(c).to_numpy() for c in ("fp", "n", "part"))
        bits = matrix(cell.column("words"), scheme.words)
        groups = cell.column("group").to_numpy() if everything else fp
        if key[1].as_py() == key[2].as_py():
            left = right = np.arange(len(fp))
            x = y = bits
        else:
            left, right = np.nonzero(part == key[1].as_py())[0], np.nonzero(part != key[1].as_py())[0]
            x, y = bits[left], bits[right]
        bounds = reach(n[left], n[right], scheme.similarity)
        if everything:
            us, vs = candidates(x, y, scheme.distance, *bounds, groups[left], groups[right])
            trees = np.zeros(len(us), np.int64)
        else:
            us, vs, trees = forest(x, y, scheme.distance, *bounds)
        u, v = fp[left[us]], fp[right[vs]]
        named = [pa.array(np.full(len(u), k.as_py()), t) for k, t in zip(key, (pa.int64(), pa.int32(), pa.int32()), strict=False)]
        return pa.table([*named, pa.array(trees, pa.int64()), pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=[*CELL, "tree", "u", "v"])

    return dealt.groupBy(*keys).applyInArrow(compare, "anchor long, a int, b int, tree long, u long, v long")


def links(fps: DataFrame, scheme: Scheme = EXACT) -> DataFrame:
    """(u, v): fingerprints of the written table ``fps(fp, words, n)`` (distinct) that link, enough of them to connect what all links that are found connect."""
    return compared(place(fps, scheme), scheme, CELL).select("u", "v")


def alike(pairs: DataFrame, sets: DataFrame, similarity: Fraction) -> DataFrame:
    """The pairs (u, v) whose sets in ``sets(fp, shingles)`` have at least this Jaccard similarity."""
    one, two = (sets.select(F.col("fp").alias(c), F.col("shingles").alias(f"{c}s")) for c in "uv")
    shared = F.size(F.array_intersect("us", "vs"))
    sized = pairs.join(one, "u").join(two, "v").select("u", "v", shared.alias("both"), (F.size("us") + F.size("vs")).alias("all"))
    return sized.filter(F.col("both") * similarity.denominator >= (F.col("all") - F.col("both")) * similarity.numerator).select("u", "v")


def similar(classes: DataFrame, texts: Callable[[DataFrame], DataFrame], size: int, scheme: Scheme) -> DataFrame:
    """(u, v): classes of ``classes(fp, words)`` whose sets are similar, enough of them to connect what all such candidates connect.

    ``texts`` gives (fp, text) of the classes it is given by ``fp``.
    """
    pair = [F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")]
    first = written(compared(place(classes, scheme), scheme, CELL), "forest")
    reclaim(classes.sparkSession)
    # Whatever is a candidate at an anchor is in its forest, so no other sets are needed later.
    named = first.select(F.explode(F.array("u", "v")).alias("fp")).distinct()
    sets = written(shingle_sets(texts(named), size), "sets")
    edges = written(alike(first.select(*pair).distinct(), sets, scheme.similarity), "edges")
    groups = written(components(edges).select(F.col("node").alias("fp"), F.col("component").alias("group")), "groups")
    # An edge that failed is between two groups. All candidates of a cell are within trees, so only a tree with such an edge has others that can join groups.
    ends = [groups.select(F.col("fp").alias(c), F.col("group").alias(f"{c}g")) for c in "uv"]
    marked = first.join(ends[0], "u", "left").join(ends[1], "v", "left").withColumn("apart", F.coalesce("ug", "u") != F.coalesce("vg", "v"))
    tree = [*CELL, "tree"]
    trees = marked.groupBy(*tree).agg(F.max("apart").alias("apart"), F.collect_set(F.struct(F.col("u").alias("fp"), F.col("a").alias("part"))).alias("us"), F.collect_set(F.struct(F.col("v").alias("fp"), F.col("b").alias("part"))).alias("vs"))
    # A tree of two has no other candidates than its edge.
    members = F.array_union("us", "vs")
    again = written(trees.filter("apart").select(*tree, members.alias("members")).filter("size(members) > 2").select(*tree, F.explode("members").alias("m")).select(*tree, "m.*"), "again")
    again = again.join(classes.select("fp", "words", "n"), "fp").join(groups, "fp", "left").withColumn("group", F.coalesce("group", "fp"))
    rest = compared(again, scheme, tree).select(*pair).distinct()
    # Forest edges that failed are not compared again.
    rest = written(rest.join(first.select(*pair).distinct(), ["u", "v"], "left_anti"), "rest")
    return edges.unionByName(alike(rest, sets, scheme.similarity))


def grouped(prints: DataFrame, scheme: Scheme = EXACT, linked: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(fp, component) of each fingerprint in the written table ``prints(fp, words)``, with ``n`` if the scheme has a similarity; component is the group's least fp.

    ``linked`` gives the links of the distinct fingerprints; without it, those within the scheme's distance are.
    """
    size = F.first("n") if scheme.similarity else F.lit(0).cast("long")
    classes = written(prints.groupBy("fp", "words").agg(size.alias("n")), "classes")
    found = components(written(linked(classes) if linked else links(classes, scheme), "links"))
    return classes.select("fp").join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))


def near_duplicates(docs: DataFrame, size: int = 4, scheme: Scheme = EXACT) -> DataFrame:
    """(doc_id, fp, component_id) of every document; component_id is the least doc_id of its group."""
    prints = written(fingerprints(docs, size, words=scheme.words), "fingerprints")
    named = prints.groupBy("fp").agg(F.min("doc_id").alias("least")).join(grouped(prints, scheme), "fp")
    named = written(named, "named")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return prints.select("doc_id", "fp").join(named.join(least, "component").select("fp", "component_id"), "fp")


def dedupe(docs: DataFrame, size: int = 5, scheme: Scheme = WIDE) -> DataFrame:
    """``docs`` with one row of each group, that with the least doc_id (null only where all are); columns stay.

    Rows are known by a hash of id and text, so of repeated rows one stays. If the scheme has a similarity, equal sets of shingles
    are one class, and classes are linked by the exact similarity of their sets.
    """
    require(docs, "doc_id", "text")
    row = F.xxhash64("doc_id", "text")
    named = docs.select(F.struct("doc_id", row.alias("at")).alias("row"), "text")
    made = set_fingerprints if scheme.similarity else fingerprints
    prints = written(made(named, size, "row", scheme.words).select("row.*", "fp", "words", *(["n"] if scheme.similarity else [])), "fingerprints")

    def texts(fps: DataFrame) -> DataFrame:
        one = prints.join(fps, "fp", "left_semi").groupBy("fp").agg(F.min("at").alias("at"))
        return docs.select(row.alias("at"), "text").join(one.hint("shuffle_hash"), "at").dropDuplicates(["at"]).select("fp", "text")

    linked = (lambda classes: similar(classes, texts, size, scheme)) if scheme.similarity else None
    # Nulls order first in a struct, so whether there is an id comes before the id.
    best = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "at"))
    groups = prints.groupBy("fp").agg(best.alias("best")).join(grouped(prints, scheme, linked), "fp")
    kept = groups.groupBy("component").agg(F.min("best").alias("best")).select(F.col("best.at").alias("__at"))
    chosen = docs.withColumn("__at", row).join(kept.hint("shuffle_hash"), "__at", "left_semi")
    return chosen.dropDuplicates(["__at"]).select(*docs.columns)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``: 4-word shingles, links at 4 or fewer differing bits."""
    found = near_duplicates(table(spark, sf_dir, "documents"), 4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
