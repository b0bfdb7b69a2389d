"""From coverage to an accept mask: scores, expected benefit of each bin and strand, and the threshold.

Bins are a long table (contig, bin, cov_sum). Moving sums are differences of one running sum per contig, so ten widths cost
one sort. A contig is one window partition: at 100 bases a bin the longest chromosome has a few million rows. The only
windows without partitions run over tables of bounded size: read lengths (a million at most) and binary exponents (about a thousand).
Empty inputs give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .links import NODE

# Fixed values of the model.
LIMIT_END = 50
MAX_LEN = 1_000_000
PIECES = 10
WEIGHTS = tuple(round(1 - 0.1 * i, 1) for i in range(PIECES))
ALPHA, RHO = 200, 300


def score_vector(spark: SparkSession, lowcov: float = 10, top: int = 100) -> DataFrame:
    """(x, score): the worth of more coverage at each coverage."""
    return spark.range(top + 1).select(F.col("id").alias("x"), score_of(F.col("id"), lowcov).alias("score"))


def score_of(coverage: Column, lowcov: float = 10) -> Column:
    return 1 / (F.exp(coverage - F.lit(float(lowcov))) + 1)


def chunk(coverage: DataFrame, size: int = NODE) -> DataFrame:
    """(contig, bin, cov_sum) from ``coverage(contig, cov)`` with an array of one value per base; the last bin may be short."""
    starts = F.when(F.size("cov") > 0, F.sequence(F.lit(0), F.size("cov") - 1, F.lit(size))).otherwise(F.array().cast("array<int>"))
    sums = F.transform(starts, lambda i: F.aggregate(F.slice("cov", i + 1, F.lit(size)), F.lit(0.0), lambda a, x: a + x))
    return coverage.select("contig", F.posexplode(sums).alias("bin", "cov_sum")).withColumn("bin", F.col("bin").cast("long"))


def scored(bins: DataFrame, lowcov: float = 10) -> DataFrame:
    return bins.withColumn("score", score_of(F.floor(F.col("cov_sum") / NODE), lowcov))


def with_ends(scores: DataFrame, caps: DataFrame | None = None, limit: int = LIMIT_END) -> DataFrame:
    """Thinly covered first and last bins become nodes of interest with score 1, unless the contig is capped there.

    ``caps(contig, cap_l, cap_r)``; contigs that aren't listed have no caps.
    """
    ends = scores.groupBy("contig").agg(F.max("bin").alias("last"))
    if caps is not None:
        ends = ends.join(caps, "contig", "left")
    cap = lambda c: F.coalesce(F.col(c), F.lit(False)) if caps is not None else F.lit(False)
    joined = scores.join(ends.select("contig", "last", cap("cap_l").alias("cap_l"), cap("cap_r").alias("cap_r")), "contig")
    thin = F.col("cov_sum") <= limit * NODE
    noi = thin & (((F.col("bin") == 0) & ~F.col("cap_l")) | ((F.col("bin") == F.col("last")) & ~F.col("cap_r")))
    return joined.withColumn("noi", noi).withColumn("score", F.when(noi, F.lit(1.0)).otherwise(F.col("score"))).drop("last", "cap_l", "cap_r")


def ends_of(scores: DataFrame) -> DataFrame:
    """(contig, e1, e2): whether the first and the last bin are of interest."""
    return scores.groupBy("contig").agg(F.min_by("noi", "bin").alias("e1"), F.max_by("noi", "bin").alias("e2"))


def padded(scores: DataFrame, ends: DataFrame, pad: int) -> DataFrame:
    """(contig, p, size, sx): ``pad`` cells on each side, 1 beyond an end of interest, else 0; the very last cell stays 0.

    p counts from 0 with the padding, ``size`` is the padded length.
    """
    n = scores.groupBy("contig").agg((F.max("bin") + 1).alias("n"))
    frame = n.join(ends, "contig").withColumn("size", F.col("n") + 2 * pad)
    left = frame.select("contig", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(pad - 1).cast("long"))).alias("p"), F.col("e1").cast("double").alias("sx"))
    right = frame.select("contig", "size", F.explode(F.sequence(F.col("n") + pad, F.col("size") - 1)).alias("p"), F.col("e2").cast("double").alias("sx"))
    right = right.withColumn("sx", F.when(F.col("p") == F.col("size") - 1, 0.0).otherwise(F.col("sx")))
    middle = scores.join(frame.select("contig", "size"), "contig").select("contig", "size", (F.col("bin") + pad).alias("p"), F.col("score").alias("sx"))
    return left.unionByName(middle).unionByName(right)


def benefits(scores: DataFrame, ends: DataFrame, widths: list[int], mu: int = 400) -> DataFrame:
    """(contig, bin, strand, benefit): expected new information of reads that begin there, less that of their anchor.

    The reverse strand's anchor sums are those of the reversed contig, taken in that order.
    """
    pad, m = widths[-1], mu // NODE
    w = W.partitionBy("contig").orderBy("p")
    sums = padded(scores, ends, pad).withColumn("s", F.sum("sx").over(w.rowsBetween(W.unboundedPreceding, 0)))
    s, p, size = F.col("s"), F.col("p"), F.col("size")
    total = F.last("s").over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    forward, reverse = F.lit(0.0), F.lit(0.0)
    for weight, width in zip(WEIGHTS, widths, strict=True):
        forward = forward + F.when(p <= size - width - 2, weight * (F.lead("s", width).over(w) - s)).otherwise(0.0)
        reverse = reverse + F.when((p >= width) & (p <= size - 2), weight * (s - F.lag("s", width, 0.0).over(w))).otherwise(0.0)
    anchor = s - F.lag("s", m, 0.0).over(w)
    # The anchor sum of the reversed contig at size - 1 - p, of the cells from p on.
    mirrored = F.coalesce(F.lead("s", m - 1).over(w), total) - F.lag("s", 1, 0.0).over(w)
    cells = sums.select("contig", "p", "size", forward.alias("f"), reverse.alias("r"), anchor.alias("a"), mirrored.alias("t"))
    inner = cells.filter((p >= pad) & (p <= size - pad - 1))
    turned = inner.select("contig", (size - 1 - p).alias("p"), F.col("t").alias("a1"))
    both = inner.join(turned, ["contig", "p"])
    sides = F.array(F.struct(F.lit(0).alias("strand"), F.greatest(F.col("f") - F.col("a"), F.lit(0.0)).alias("benefit")), F.struct(F.lit(1).alias("strand"), F.greatest(F.col("r") - F.col("a1"), F.lit(0.0)).alias("benefit")))
    return both.select("contig", (p - pad).alias("bin"), F.explode(sides).alias("x")).select("contig", "bin", "x.*")


def anchor_sum(scores: DataFrame, ends: DataFrame, widths: list[int], mu: int = 400) -> DataFrame:
    """(contig, smu_sum): all anchor sums of both strands, padding included.

    A cell counts in as many of the ``mu`` / 100 wide sums as reach it: fewer near the end on the forward strand, and near the start on the reverse one.
    """
    m = mu // NODE
    cells = padded(scores, ends, widths[-1])
    times = F.least(F.lit(m), F.col("size") - F.col("p")) + F.least(F.lit(m), F.col("p") + 1)
    return cells.groupBy("contig").agg(F.sum(F.col("sx") * times).alias("smu_sum"))


def exponent(x: Column) -> Column:
    """The e with 2^(e-1) <= x < 2^e. The logarithm is inexact, so its floor is set right by comparing powers."""
    low = F.floor(F.log2(x))
    low = F.when(x < F.pow(F.lit(2.0), low), low - 1).when(x >= F.pow(F.lit(2.0), low + 1), low + 1).otherwise(low)
    return low + 1


def benefit_bins(benefit: DataFrame) -> DataFrame:
    """(e, value, n): counts of the positive benefits by the size of their binary exponent, the greatest being 1."""
    positive = benefit.filter("benefit > 0").select("benefit")
    top = positive.agg(F.max("benefit")).first()[0]
    if top is None:
        return benefit.sparkSession.createDataFrame([], "e long, value double, n long")
    sums = positive.groupBy(F.abs(exponent(F.col("benefit") / F.lit(top))).alias("e")).agg(F.count("*").alias("n"))
    return sums.select("e", (F.pow(F.lit(2.0), -F.col("e")) * F.lit(top)).alias("value"), "n")


def threshold(bins: DataFrame, smu_sum: float, lam: float, mu: int = 400) -> DataFrame:
    """(threshold): the value of the bin after that with the highest ratio of gathered benefit to time, or of the last bin."""
    time_cost = (lam - mu - 300) // NODE
    at_once = ALPHA // NODE + RHO // NODE + mu // NODE
    order = W.orderBy("e")
    so_far = order.rowsBetween(W.unboundedPreceding, 0)
    peak = (F.sum(F.col("value") * F.col("n")).over(so_far) + smu_sum) / (F.sum(F.lit(float(time_cost)) * F.col("n")).over(so_far) + at_once)
    rated = bins.select("e", "value", peak.alias("peak"), F.lead("value").over(order).alias("next"))
    return rated.orderBy(F.desc("peak"), "e").limit(1).select(F.coalesce("next", "value").alias("threshold"))


def mask(benefit: DataFrame, least: float) -> DataFrame:
    """(contig, bin, strand, accept)."""
    return benefit.select("contig", "bin", "strand", (F.col("benefit") >= F.lit(least)).alias("accept"))


def strategy(bins: DataFrame, widths: list[int], lam: float, mu: int = 400, lowcov: float = 10, caps: DataFrame | None = None) -> DataFrame:
    """The mask of all contigs from their coverage; no contigs or no benefit: an empty mask or one that accepts nothing."""
    from ..plans.storage import materialize

    scores = materialize(with_ends(scored(bins, lowcov), caps), "scores")
    ends = ends_of(scores)
    found = materialize(benefits(scores, ends, widths, mu), "benefits")
    smu_sum = anchor_sum(scores, ends, widths, mu).agg(F.sum("smu_sum")).first()[0] or 0.0
    least = threshold(benefit_bins(found), smu_sum, lam, mu).first()
    return mask(found, least["threshold"] if least else float("inf"))


def length_histogram(lengths: DataFrame, state: DataFrame | None = None, mu: int = 400) -> DataFrame:
    """(length, n): lengths above twice ``mu``, a million and more as one below, added to what ``state`` has."""
    new = lengths.filter(F.col("length") > 2 * mu).select(F.least(F.col("length").cast("long"), F.lit(MAX_LEN - 1)).alias("length"), F.lit(1).cast("long").alias("n"))
    both = new if state is None else new.unionByName(state.select("length", "n"))
    return both.groupBy("length").agg(F.sum("n").alias("n"))


def mean_length(histogram: DataFrame) -> DataFrame:
    """(lam, longest)."""
    return histogram.agg((F.sum(F.col("length") * F.col("n")) / F.sum("n")).alias("lam"), F.max("length").alias("longest"))


def length_pieces(histogram: DataFrame, pieces: int = PIECES) -> DataFrame:
    """(piece, width): the lengths at which the share of reads still longer falls to 0.95, 0.85, ... 0.05."""
    total = F.sum("n").over(W.partitionBy())
    so_far = F.sum("n").over(W.orderBy("length").rowsBetween(W.unboundedPreceding, 0))  # a million rows at most
    shares = histogram.select("length", so_far.alias("c"), total.alias("total"))
    piece = F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))).alias("piece")
    return shares.select("length", "c", "total", piece).filter(2 * pieces * F.col("c") >= (2 * F.col("piece") + 1) * F.col("total")).groupBy("piece").agg(F.min("length").alias("width"))


def prior_lengths(spark: SparkSession, lam: float = 6000, sd: float = 4000, n: int = 46_000) -> DataFrame:
    """(length, share): a normal density, cut at 0 and n, that sums to 1."""
    density = spark.range(n).select(F.col("id").alias("length"), F.exp(-F.pow(F.col("id") - lam + 1, 2) / (2 * sd * sd)).alias("d"))
    total = density.agg(F.sum("d")).first()[0]
    return density.select("length", (F.col("d") / total).alias("share"))
