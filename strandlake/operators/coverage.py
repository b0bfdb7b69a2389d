"""Coverage of sequences by alignments: depth, repeats, trims, and coverage handed on along containments.

Depth is kept as segments (target, start, end, depth), not as a row per base. Empty inputs give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.storage import materialize
from . import links

CEILING = 100.0


def depth(intervals: DataFrame) -> DataFrame:
    """(target, start, end, depth): stretches of equal depth of each target with an interval, from 0 to its length.

    ``intervals(target, tlen, tstart, tend)``, ends exclusive.
    """
    events = intervals.select("target", F.explode(F.array(F.struct(F.col("tstart").alias("pos"), F.lit(1).alias("d")), F.struct(F.col("tend").alias("pos"), F.lit(-1).alias("d")))).alias("e")).select("target", "e.*")
    borders = intervals.groupBy("target").agg(F.max("tlen").alias("tlen")).select("target", F.explode(F.array(F.lit(0).cast("long"), "tlen")).alias("pos"), F.lit(0).alias("d"))
    # Events at one place are summed before the shuffle.
    steps = events.unionByName(borders).groupBy("target", "pos").agg(F.sum("d").alias("d"))
    w = W.partitionBy("target").orderBy("pos")
    runs = steps.select("target", F.col("pos").alias("start"), F.lead("pos").over(w).alias("end"), F.sum("d").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("depth"))
    return runs.filter("end is not null and end > start")


def depth_limit(segments: DataFrame, share: float = 0.999, least: float = 3.0) -> DataFrame:
    """(limit): the quantile of the depth over all positions, position 0 of each target counting as uncovered, and ``least`` at least."""
    split = F.when(F.col("start") == 0, F.array(F.struct(F.lit(0).cast("long").alias("depth"), F.lit(1).cast("long").alias("n")), F.struct("depth", (F.col("end") - 1).alias("n")))).otherwise(F.array(F.struct("depth", (F.col("end") - F.col("start")).alias("n"))))
    weights = segments.select(F.explode(split).alias("x")).select("x.*").filter("n > 0").groupBy("depth").agg(F.sum("n").alias("n"))
    return weights.agg(F.greatest(F.percentile("depth", share, F.col("n")), F.lit(least)).alias("limit"))


def islands(segments: DataFrame, at_least: float, longer_than: int = 100, equal: bool = False) -> DataFrame:
    """(target, start, end): longest runs of depth of ``at_least`` or more (or just that), if longer than that many bases."""
    hit = (F.col("depth") == at_least) if equal else (F.col("depth") >= at_least)
    w = W.partitionBy("target").orderBy("start")
    kept = segments.filter(hit).withColumn("fresh", (F.coalesce(F.lag("end").over(w), F.lit(-1)) != F.col("start")).cast("int"))
    runs = kept.withColumn("run", F.sum("fresh").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return runs.groupBy("target", "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).filter(F.col("end") - F.col("start") > longer_than).drop("run")


def chop(reads: DataFrame, window: int = 100) -> DataFrame:
    """(chunk_id, seq): windows of ``window`` bases side by side; the last may be shorter."""
    starts = F.when(F.length("seq") > 0, F.sequence(F.lit(0), F.length("seq") - 1, F.lit(window)))
    rows = reads.select("read_id", "seq", F.explode(starts).alias("start"))
    return rows.select(F.concat("read_id", F.lit("-"), F.lpad(F.col("start").cast("string"), 10, "0")).alias("chunk_id"), F.substring("seq", F.col("start") + 1, F.lit(window)).alias("seq"))


def repeat_sequences(sites: DataFrame, reads: DataFrame) -> DataFrame:
    """(header, read_id, start, end, seq) of repeat sites (target, start, end)."""
    joined = sites.withColumnRenamed("target", "read_id").join(reads, "read_id")
    return joined.select(F.concat("read_id", F.lit("-"), "start", F.lit(":"), "end").alias("header"), "read_id", "start", "end", F.substring("seq", F.col("start").cast("int") + 1, (F.col("end") - F.col("start")).cast("int")).alias("seq"))


def end_repeats(intervals: DataFrame, window: int = 500, most: int = 5) -> DataFrame:
    """(target): those with more than ``most`` repeat bases within the first ``window`` bases, or after them."""
    head = F.sum(F.least("tend", F.lit(window)) - F.least("tstart", F.lit(window)))
    tail = F.sum(F.greatest("tend", F.lit(window)) - F.greatest("tstart", F.lit(window)))
    return intervals.groupBy("target").agg(head.alias("head"), tail.alias("tail")).filter((F.col("head") > most) | (F.col("tail") > most)).select("target")


def without_end_repeats(reads: DataFrame, intervals: DataFrame, window: int = 500, most: int = 5) -> DataFrame:
    return reads.join(end_repeats(intervals, window, most).withColumnRenamed("target", "read_id"), "read_id", "left_anti")


def segments_of(cov: Column) -> Column:
    """An array of coverage as stretches (s, e, x) of equal values."""
    # Each array is used more than once by the next step, so it is bound to a lambda's variable and computed once.
    places = F.when(F.size(cov) > 0, F.sequence(F.lit(0), F.size(cov) - 1)).otherwise(F.array().cast("array<int>"))
    starts = F.filter(places, lambda i: (i == 0) | ~F.get(cov, i).eqNullSafe(F.get(cov, i - 1)))
    return F.transform(F.array(starts), lambda a: F.transform(a, lambda i, k: F.struct(i.alias("s"), F.coalesce(F.get(a, k + 1), F.size(cov)).alias("e"), F.get(cov, i).alias("x"))))[0]


def contribution(segments: Column, cstart: Column, cend: Column, length: Column, ostart: Column, oend: Column, rev: Column, share: Column) -> Column:
    """What a contained sequence of ``length`` bases hands on, as stretches (s, e, x) of the container: its span's coverage, cut or
    lengthened by its last value to the container's span, turned round if reverse, divided among its containers."""
    clen, olen = F.greatest(cend - cstart, F.lit(0)), F.greatest(oend - ostart, F.lit(0))
    inside = F.least(clen, length - cstart)
    fitted = F.when(inside <= 0, 0).when(clen > olen, F.least(inside, olen)).otherwise(inside + olen - clen)

    def placed(x: Column) -> Column:
        a = F.greatest(x["s"] - cstart, F.lit(0))
        # The last stretch goes on to the end of the container's span.
        b = F.when(x["e"] - cstart >= inside, fitted).otherwise(F.least(x["e"] - cstart, fitted))
        s, e = F.when(rev == 1, fitted - b).otherwise(a), F.when(rev == 1, fitted - a).otherwise(b)
        return F.struct((ostart + s).cast("long").alias("s"), (ostart + e).cast("long").alias("e"), (x["x"] / share).alias("x"))

    within = F.filter(segments, lambda x: (x["e"] > cstart) & (x["s"] - cstart < F.least(inside, fitted)))
    return F.filter(F.transform(within, placed), lambda x: x["e"] > x["s"])


def apply_level(sequences: DataFrame, level: DataFrame) -> DataFrame:
    """``sequences(header, cov, atoms)`` after the edges of one level, all of them from what was before it.

    ``level(source, target, cstart, cend, ostart, oend, rev)``. Coverage is summed as changes at the ends of stretches of equal
    values, not as a row per base, with partial sums, as very many reads may lie in one contig. Sums are rounded to nine decimals,
    which removes what adding and subtracting leaves, and clipped once, at the end.
    """
    shared = level.join(links.multiplicity(level), "source")
    needed = level.select(F.explode(F.array("source", "target")).alias("header")).distinct()
    held = materialize(sequences.join(needed, "header", "left_semi").select("header", F.size("cov").alias("length"), segments_of(F.col("cov")).alias("segments")), "segments")
    given = shared.join(held.withColumnRenamed("header", "source"), "source")
    part = contribution(F.col("segments"), F.col("cstart"), F.col("cend"), F.col("length"), F.col("ostart"), F.col("oend"), F.col("rev"), F.col("n").cast("double"))
    adds = given.select(F.col("target").alias("header"), F.inline(part)).withColumn("own", F.lit(0))
    touched = level.select(F.col("target").alias("header")).distinct()
    own = held.join(touched, "header", "left_semi").select("header", F.inline("segments")).withColumn("own", F.lit(1))
    both = own.unionByName(adds).select("header", F.explode(F.array(F.struct(F.col("s").cast("long").alias("pos"), F.col("x"), "own"), F.struct(F.col("e").cast("long").alias("pos"), (-F.col("x")).alias("x"), (-F.col("own")).alias("own")))).alias("d")).select("header", "d.*")
    steps = both.groupBy("header", "pos").agg(F.sum("x").alias("x"), F.sum("own").alias("own"))
    w = W.partitionBy("header").orderBy("pos")
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    runs = steps.select("header", F.col("pos").alias("s"), F.lead("pos").over(w).alias("e"), F.round(F.sum("x").over(upto), 9).alias("x"), F.sum("own").over(upto).alias("own"))
    # Only what lies on the container itself counts.
    runs = runs.filter("own > 0 and e is not null").select("header", F.struct("s", "e", F.least("x", F.lit(CEILING)).alias("x")).alias("r"))
    arrays = runs.groupBy("header").agg(F.flatten(F.transform(F.array_sort(F.collect_list("r")), lambda r: F.array_repeat(r["x"], (r["e"] - r["s"]).cast("int")))).alias("new_cov"))
    members = level.filter(~F.col("source").contains("*")).groupBy(F.col("target").alias("header")).agg(F.collect_set("source").alias("new_atoms"))
    none = F.array().cast("array<string>")
    out = sequences.join(arrays, "header", "left").join(members, "header", "left")
    return out.withColumns({"cov": F.coalesce("new_cov", "cov"), "atoms": F.array_sort(F.array_union(F.coalesce("atoms", none), F.coalesce("new_atoms", none)))}).drop("new_cov", "new_atoms")


def levels(edges: DataFrame, stop_on_equal: bool = True) -> list[DataFrame]:
    """Edges by level: first those whose source is in no other sequence, then those whose source was a target just before.

    Ends when none follow, or, as guard against cycles, after a level that is as wide as the one before it.
    """
    left = materialize(edges, "edges")
    now = left.join(left.select(F.col("target").alias("source")).distinct(), "source", "left_anti")
    out, width = [], None
    while True:
        now = materialize(now, "level")
        n = now.count()
        if not n:
            return out
        out.append(now)
        if stop_on_equal and n == width:
            return out
        width = n
        left = materialize(left.join(now.select("source", "target"), ["source", "target"], "left_anti"), "edges")
        now = left.join(now.select(F.col("target").alias("source")).distinct(), "source", "left_semi")


def propagate(sequences: DataFrame, edges: DataFrame, stop_on_equal: bool = True) -> DataFrame:
    """``sequences`` after all levels of ``edges``."""
    for level in levels(edges, stop_on_equal):
        sequences = materialize(apply_level(sequences, level), "sequences")
    return sequences


def trim(sequences: DataFrame, cuts: DataFrame) -> DataFrame:
    """Copies ``sid%`` of ``sequences(header, seq, cov)`` without the span of ``cuts(sid, trim_start, trim_stop)``; a null stop is the end."""
    joined = sequences.join(cuts.withColumnRenamed("sid", "header"), "header")
    start = F.col("trim_start").cast("int")
    stop = F.coalesce(F.col("trim_stop"), F.length("seq")).cast("int")
    return joined.select(
        F.concat("header", F.lit("%")).alias("header"),
        F.concat(F.substring("seq", F.lit(1), start), F.substring("seq", stop + 1, F.length("seq"))).alias("seq"),
        F.concat(F.slice("cov", F.lit(1), start), F.slice("cov", stop + 1, F.greatest(F.size("cov") - stop, F.lit(0)))).alias("cov"),
    )


def merge_layout(layout: DataFrame, sequences: DataFrame) -> DataFrame:
    """(unitig, cov): coverage of unitigs from ``layout(unitig, length, circ, idx, pos, rev, name, n)`` and ``sequences(header, cov)``.

    Each atom gives its first n values, turned round if reverse; the last one all of them, or what is left of a circular unitig.
    """
    joined = layout.join(sequences.select(F.col("header").alias("name"), "cov"), "name")
    turned = F.when(F.col("rev") == 1, F.reverse("cov")).otherwise(F.col("cov"))
    take = F.when(F.col("n") >= 0, F.col("n")).when(F.col("circ"), F.col("length") - F.col("pos")).otherwise(F.size("cov"))
    parts = joined.select("unitig", F.struct("idx", F.slice(turned, F.lit(1), F.greatest(take, F.lit(0)).cast("int")).alias("part")).alias("x"))
    return parts.groupBy("unitig").agg(F.flatten(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["part"])).alias("cov"))
