"""Functions of DNA sequences: reverse complement, k-mers, tetramer distance.

k-mers are counted over a sequence followed by its reverse complement, without the last window of that text. Letters are taken
in four ways: A, C, G as such; B, D, E and F make a k-mer count as the first one; anything else is T. A k-mer above
the greatest one seen in its sequence is absent, others unseen have count 0. Empty sequences have no k-mers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INTRA = 0.036


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ATGC", "TACG"))


def normal_bases(seq: Column) -> Column:
    """Letters by the way they are taken; X where a k-mer counts as the first one."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(seq, "@", "A"), "[^ABCDEFG]", "T"), "[BDEF]", "X")


def both_strands(seq: Column) -> Column:
    return normal_bases(F.concat(seq, reverse_complement(seq)))


def kmer_counts(sequences: DataFrame, k: int = 4) -> DataFrame:
    """(header, counts): an array of counts by the k-mer's rank, as long as the greatest one seen.

    An Arrow kernel: a row per base would cost far more than the counting.
    """
    code = np.full(256, 4, dtype=np.int64)
    for i, letter in enumerate(b"ACGT"):
        code[letter] = i

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for seq in batch.column("s").to_pylist():
                digits = code[np.frombuffer((seq or "").encode(), dtype=np.uint8)]
                n = len(digits) - k - 1
                if n <= 0:
                    out.append([])
                    continue
                rank, odd = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool)
                for i in range(k):
                    part = digits[i : i + n]
                    rank = rank * 4 + part
                    odd |= part == 4
                rank[odd] = 0
                out.append(np.bincount(rank).tolist())
            yield pa.RecordBatch.from_arrays([batch.column("header"), pa.array(out, pa.list_(pa.int64()))], ["header", "counts"])

    return sequences.select("header", both_strands(F.col("seq")).alias("s")).mapInArrow(run, "header string, counts array<long>")


def kmer_text(rank: Column, k: int) -> Column:
    """The k-mer of a rank."""
    letters = [F.substring(F.lit("ACGT"), (F.shiftright(rank, 2 * (k - 1 - i)) % 4 + 1).cast("int"), F.lit(1)) for i in range(k)]
    return F.concat(*letters)


def kmer_rows(sequences: DataFrame, k: int = 4) -> DataFrame:
    """(header, kmer, n)."""
    return kmer_counts(sequences, k).select("header", F.posexplode("counts").alias("rank", "n")).select("header", kmer_text(F.col("rank"), k).alias("kmer"), "n")


def expected_tetramers(sequences: DataFrame) -> DataFrame:
    """(header, kmer, n, expected, z): by the maximal-order Markov model; z is null where the deviation isn't positive."""
    four, three, two = (kmer_rows(sequences, k) for k in (4, 3, 2))
    joined = (
        four.withColumns({"a": F.substring("kmer", 1, 3), "b": F.substring("kmer", 2, 3), "m": F.substring("kmer", 2, 2)})
        .join(three.select("header", F.col("kmer").alias("a"), F.col("n").alias("na")), ["header", "a"])
        .join(three.select("header", F.col("kmer").alias("b"), F.col("n").alias("nb")), ["header", "b"])
        .join(two.select("header", F.col("kmer").alias("m"), F.col("n").alias("nm")), ["header", "m"])
    )
    a, b, m = (F.col(x).cast("double") for x in ("na", "nb", "nm"))
    expected = F.when(m > 0, a * b / m)
    sd = F.sqrt(F.greatest(expected * (m - a) * (m - b) / (m * m), F.lit(0.0)))
    return joined.select("header", "kmer", "n", expected.alias("expected"), F.when(sd > 0, (F.col("n") - expected) / sd).alias("z"))


def tetramer_distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two count arrays over the k-mers that both have, each a share of its sum there.

    Counts that are all zero there have no shares, and count as zero. Without k-mers in either the distance is null.
    """
    n = F.least(F.size(a), F.size(b))
    x, y = F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)
    total = lambda v: F.aggregate(v, F.lit(0).cast("long"), lambda s, i: s + i).cast("double")
    sums = F.array(F.struct(x.alias("x"), y.alias("y"), total(x).alias("sx"), total(y).alias("sy")))
    share = lambda v, sum: F.coalesce(F.try_divide(v.cast("double"), sum), F.lit(0.0))
    square = lambda s: F.aggregate(F.zip_with(s["x"], s["y"], lambda i, j: F.pow(share(i, s["sx"]) - share(j, s["sy"]), F.lit(2.0))), F.lit(0.0), lambda t, v: t + v)
    return F.when(n > 0, F.sqrt(F.transform(sums, square)[0]))


def intra_pairs(pairs: DataFrame, sequences: DataFrame, limit: float = INTRA) -> DataFrame:
    """Pairs (qname, tname) with ``distance`` below ``limit``. Counts are made once per sequence, not per pair."""
    counts = kmer_counts(sequences, 4)
    joined = pairs.join(counts.select(F.col("header").alias("qname"), F.col("counts").alias("__q")), "qname").join(counts.select(F.col("header").alias("tname"), F.col("counts").alias("__t")), "tname")
    return joined.withColumn("distance", tetramer_distance(F.col("__q"), F.col("__t"))).filter(F.col("distance") < limit).select(*pairs.columns, "distance")
