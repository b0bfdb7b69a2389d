"""Near-duplicate vectors by randomised-rotation binary codes with correction factors.

After Gao and Long, "RaBitQ" (2024): a unit vector o is rotated at random, and its code is the signs of the
result. With f, the inner product of o and its code's unit vector, the inner product of o and q is estimated without
bias as <code, q'> / f, where q' is q rotated and rounded at random to 4 bits, so that <code, q'> is a handful of ands and
bit counts. The error is below EPS * sqrt((1 - f^2) / f^2 / (d - 1)) but for a tail; only pairs whose upper bound reaches the
threshold are computed again, exactly and in double precision.

1. Code, correction factor f, rounded query and the runs of bits that name buckets are computed once for each vector and stored.
2. Pairs are candidates if they agree in a run of code bits of one of several rotations. The run's length grows with the logarithm
   of the number of vectors, and the number of rotations follows from it, so that a pair right at the threshold is found
   with probability ``RECALL``; nearer pairs are all but sure. Equal vectors are compared once for all. To the buckets go codes, not
   vectors. A bucket is dealt out as pairs of parts of bounded size; what comes out is which vectors have a pair there that the
   bounds leave.
3. Only these come to the bucket once more, with their vectors, and their pairs are computed exactly. A pair counts in the first rotation
   where it meets. A task sends out sums of links for each vector and a spanning forest, never pairs.

Edge cases: a null vector, a zero one and one with null or non-finite components link with nothing; vectors of unlike length
don't link; a null vec_id keeps its row and is nobody's component_id; repeated rows count as vectors of their own; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import require, table, written
from .components import components

RECALL = 0.995
EPS = 3.5
PART = 1024
#: Vectors that a bucket holds on average, were they spread evenly.
BUCKET = 64
LEVELS = 4
#: Rows of buckets that a task gets on average.
ROWS = 32768


@cache
def rotation(seed: int, d: int) -> np.ndarray:
    """A random rotation (or reflection) of d dimensions."""
    q, r = np.linalg.qr(np.random.default_rng([seed, d]).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def plan(n: int, d: int, threshold: float) -> tuple[int, int]:
    """(bits of a run, number of rotations) for n vectors."""
    bits = min(d, 48, max(4, math.ceil(math.log2(max(2, n) / BUCKET))))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - RECALL) / math.log(1 - agree)))


def runs(unit: np.ndarray, bits: int, count: int) -> np.ndarray:
    """For each vector the first ``bits`` code bits of each of ``count`` rotations, as one number."""
    n, d = unit.shape
    out = np.empty((n, count), dtype=np.int64)
    powers = 1 << np.arange(bits, dtype=np.int64)
    for i in range(count):
        out[:, i] = ((unit @ rotation(i + 1, d)[:, :bits]) > 0) @ powers
    return out


def codes(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code bits, correction factor f) by rotation 0."""
    turned = unit @ rotation(0, unit.shape[1])
    return turned > 0, np.abs(turned).sum(axis=1) / math.sqrt(unit.shape[1])


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as 64-bit words."""
    n, d = bits.shape
    padded = np.zeros((n, -(-d // 64) * 64), dtype=np.uint8)
    padded[:, :d] = bits
    return np.packbits(padded, axis=1).view(np.uint64)


@dataclass
class Coded:
    """Stored rows: the code's words and f of a vector, and the same vector as a query: ``LEVELS`` planes of words, low and step."""

    code: np.ndarray
    f: np.ndarray
    planes: np.ndarray
    low: np.ndarray
    step: np.ndarray
    d: int

    def take(self, rows: np.ndarray) -> "Coded":
        return Coded(self.code[rows], self.f[rows], self.planes[rows], self.low[rows], self.step[rows], self.d)


def coded(unit: np.ndarray, seed: int = 0) -> Coded:
    d = unit.shape[1]
    bits, f = codes(unit)
    turned = unit @ rotation(0, d)
    low, high = turned.min(axis=1, keepdims=True), turned.max(axis=1, keepdims=True)
    step = np.maximum(high - low, 1e-12) / (2**LEVELS - 1)
    # Rounded up or down at random by its fraction, which keeps the estimate unbiased.
    level = np.floor((turned - low) / step + np.random.default_rng(seed).random(turned.shape)).clip(0, 2**LEVELS - 1).astype(np.uint8)
    return Coded(packed(bits), f, np.stack([packed(level >> bit & 1) for bit in range(LEVELS)], axis=1), low[:, 0], step[:, 0], d)


def estimates(right: Coded, left: Coded) -> np.ndarray:
    """Unbiased estimates of the inner products of each query of ``left`` (rows) with each coded vector of ``right`` (columns)."""
    d = right.d
    ones = np.bitwise_count(right.code).sum(axis=1, dtype=np.int64)
    total = np.zeros((len(left.f), len(right.f)), dtype=np.int64)
    sums = np.zeros(len(left.f), dtype=np.int64)
    for bit in range(LEVELS):
        plane = left.planes[:, bit]
        sums += np.bitwise_count(plane).sum(axis=1, dtype=np.int64) << bit
        for w in range(plane.shape[1]):
            total += np.bitwise_count(plane[:, w, None] & right.code[None, :, w]).astype(np.int64) << bit
    # Of sum (2 b - 1)(low + step * level), with b the code's bits.
    low, step = left.low[:, None], left.step[:, None]
    dot = 2 * (low * ones[None, :] + step * total) - (low * d + step * sums[:, None])
    return dot / math.sqrt(d) / right.f[None, :]


def possible(left: Coded, right: Coded, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of the pairs that the bounds don't rule out, in blocks."""
    slack = EPS * np.sqrt(np.maximum(0, 1 - right.f**2) / right.f**2 / max(1, right.d - 1))
    for at in range(0, len(left.f), 256):
        block = left.take(np.arange(at, min(at + 256, len(left.f))))
        a, b = np.nonzero(estimates(right, block) + slack[None, :] >= threshold)
        yield a + at, b


def unit_rows(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Lists of equal length as rows of length 1."""
    flat = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    x = np.asarray(flat.flatten(), dtype=np.float64).reshape(len(flat), -1)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


STORED = "class long, n long, f double, low double, step double, code binary, planes binary"
CELL = "turn int, run long, a int, b int"


def sides(group: pa.Table, key: tuple, d: int) -> tuple[Coded, np.ndarray, np.ndarray]:
    """The rows of a cell as stored codes, and the positions of those on its two sides (alike within one part)."""
    words = -(-d // 64)
    low, high, part = key[2].as_py(), key[3].as_py(), group.column("part").to_numpy()
    column = lambda c: group.column(c).to_numpy()
    whole = lambda c, *shape: np.frombuffer(b"".join(group.column(c).to_pylist()), dtype=np.uint64).reshape(len(part), *shape)
    rows = Coded(whole("code", words), column("f"), whole("planes", LEVELS, words), column("low"), column("step"), d)
    if low == high:
        return rows, np.arange(len(part)), np.arange(len(part))
    return rows, np.nonzero(part == low)[0], np.nonzero(part != low)[0]


def links(classes: DataFrame, d: int, threshold: float) -> DataFrame:
    """(u, v, n): from ``classes(class, vector, n)``, all usable and of length d, the rows of a forest that connects what links
    connect (n = 0), and rows with v null and the number of vectors that link with class u in one place."""
    spark = classes.sparkSession
    total = classes.count()
    bits, count = plan(total, d, threshold)
    # Codes are small for the work that they make, so the number of tasks follows the rows and not the bytes.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total * count / ROWS))

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                unit = unit_rows(part.column("vector"))
                # A seed of the vector's own, so that a task that runs again stores the same.
                rows = coded(unit, int(part.column("class")[0].as_py()) & (1 << 62) - 1)
                binary = lambda x: pa.array([r.tobytes() for r in x], pa.binary())
                found = [part.column("class"), part.column("n"), pa.array(rows.f), pa.array(rows.low), pa.array(rows.step), binary(rows.code), binary(rows.planes)]
                yield pa.RecordBatch.from_arrays([*found, pa.array(list(runs(unit, bits, count)), pa.list_(pa.int64()))], [*(x.split()[0] for x in STORED.split(", ")), "runs"])

    stored = written(classes.mapInArrow(store, f"{STORED}, runs array<long>"), "codes")
    placed = stored.select("class", F.posexplode("runs").alias("turn", "run"))
    sizes = placed.groupBy("turn", "run").agg(F.count("*").alias("size")).filter("size > 1")
    part = F.pmod(F.xxhash64("class"), F.col("parts")).cast("int")
    full = stored.select("*", F.posexplode("runs").alias("turn", "run")).drop("runs", "n")
    dealt = full.join(sizes, ["turn", "run"]).withColumn("parts", F.ceil(F.col("size") / PART).cast("int")).withColumn("part", part)
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, parts - 1)"))).withColumns({"a": F.least("part", "other"), "b": F.greatest("part", "other")}).drop("parts", "other", "size")
    cell = ["turn", "run", "a", "b"]

    def sift(key: tuple, group: pa.Table) -> pa.Table:
        rows, first, second = sides(group, key, d)
        left, right, met = rows.take(first), rows.take(second), np.zeros(len(rows.f), dtype=bool)
        for a, b in possible(left, right, threshold) if len(first) and len(second) else ():
            apart = first[a] != second[b]
            met[first[a[apart]]] = True
            met[second[b[apart]]] = True
        names = group.column("class").filter(pa.array(met))
        return pa.table([*(pa.array(np.full(len(names), k.as_py()), t) for k, t in zip(key, (pa.int32(), pa.int64(), pa.int32(), pa.int32()), strict=True)), names, group.column("part").filter(pa.array(met))], names=[*cell, "class", "part"])

    left = written(dealt.repartition(tasks, *cell).groupBy(*cell).applyInArrow(sift, f"{CELL}, class long, part int"), "left")
    again = left.join(stored.drop("runs"), "class").join(classes.select("class", "vector"), "class")

    def compare(key: tuple, group: pa.Table) -> pa.Table:
        turn = key[0].as_py()
        rows, first, second = sides(group, key, d)
        name, n = (group.column(c).to_numpy() for c in ("class", "n"))
        unit = unit_rows(group.column("vector"))
        out_u, out_v, out_n = [], [], []
        # Whoever met in an earlier rotation was counted there.
        run = runs(unit, bits, turn) if turn else np.empty((len(unit), 0))
        seen, parent = np.zeros(len(name), dtype=np.int64), list(range(len(name)))

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        pairs = [first[a] * len(name) + second[b] for a, b in possible(rows.take(first), rows.take(second), threshold)] if len(first) and len(second) else []
        if pairs:
            a, b = np.divmod(np.concatenate(pairs), len(name))
            # Within a part either of two may be the query, and the pair is one.
            a, b = np.divmod(np.unique((np.minimum(a, b) * len(name) + np.maximum(a, b))[a != b]), len(name))
            for at in range(0, len(a), 65536):
                x, y = a[at : at + 65536], b[at : at + 65536]
                keep = np.einsum("ij,ij->i", unit[x], unit[y]) >= threshold
                keep[keep] &= ~(run[x[keep]] == run[y[keep]]).any(axis=1)
                x, y = x[keep], y[keep]
                np.add.at(seen, x, n[y])
                np.add.at(seen, y, n[x])
                for i, j in zip(x.tolist(), y.tolist(), strict=True):
                    p, q = find(i), find(j)
                    if p != q:
                        parent[max(p, q)] = min(p, q)
                        out_u.append(name[i])
                        out_v.append(name[j])
                        out_n.append(0)
            for i in np.nonzero(seen)[0]:
                out_u.append(name[i])
                out_v.append(None)
                out_n.append(seen[i])
        return pa.table({"u": pa.array(out_u, pa.int64()), "v": pa.array(out_v, pa.int64()), "n": pa.array(out_n, pa.int64())})

    return written(again.repartition(tasks, *cell).groupBy(*cell).applyInArrow(compare, "u long, v long, n long"), "links")


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    require(vectors, key, column)
    vector = F.col("vector")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("vector")).withColumn("usable", usable)
    # Equal vectors are a class, named by a hash of all components.
    rows = written(rows.select("vec_id", F.when(F.col("usable"), F.xxhash64("vector", F.size("vector"))).alias("class"), F.when(F.col("usable"), vector).alias("vector")), "vectors")
    classes = rows.filter("class is not null").groupBy("class", "vector").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"))
    classes = written(classes.withColumn("d", F.size("vector")), "classes")
    found = None
    for (d,) in classes.select("d").distinct().collect():
        part = links(classes.filter(F.col("d") == d).select("class", "vector", "n"), d, threshold)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    sums = found.filter("v is null").groupBy(F.col("u").alias("class")).agg(F.sum("n").alias("more"))
    groups = components(found.filter("v is not null")).withColumnRenamed("node", "class")
    named = classes.select("class", "n", "least").join(sums, "class", "left").join(groups, "class", "left").withColumn("component", F.coalesce("component", "class"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(least, "component").select("class", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), "component_id")
    out = rows.select("vec_id", "class").join(named, "class", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op8_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of ``embeddings``, linked at cosine 0.9."""
    return near_duplicates(table(spark, sf_dir, "embeddings"), 0.9)
