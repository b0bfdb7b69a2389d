"""Unitigs from overlap links: paths of reads that nothing branches off from.

A read has a left and a right end; a link joins two ends. Links that a path over a third read explains are removed (transitive
reduction, Myers 2005). Where two ends have only each other, their reads are neighbours in a unitig. Places in unitigs are found by
pointer doubling, in as many joins as the length's logarithm. All state is in DataFrames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.dna import reverse_complement
from ..plans.storage import discard, materialize

FUZZ = 1000


def opposite(end: str | Column) -> Column:
    return F.when((F.col(end) if isinstance(end, str) else end) == "L", "R").otherwise("L")


def end_links(links: DataFrame) -> DataFrame:
    """(a, a_end, b, b_end, hang, shift): both directions of each link. Going out of a by a_end into b by b_end, hang is what of b
    lies beyond a, and shift what of a lies before b.

    ``links(qname, qside, tname, tside, qlen, qstart, qend, tlen, tstart, tend)``.
    """

    def directed(a: str, b: str) -> DataFrame:
        col = lambda x, what: F.col(f"{x}{what}")
        hang = F.when(col(b, "side") == "L", col(b, "len") - col(b, "end")).otherwise(col(b, "start"))
        a_start = F.when(col(a, "side") == "R", col(a, "start")).otherwise(col(a, "len") - col(a, "end"))
        b_start = F.when(col(b, "side") == "L", col(b, "start")).otherwise(col(b, "len") - col(b, "end"))
        return links.select(col(a, "name").alias("a"), col(a, "side").alias("a_end"), col(b, "name").alias("b"), col(b, "side").alias("b_end"), hang.alias("hang"), (a_start - b_start).alias("shift"))

    return directed("q", "t").unionByName(directed("t", "q")).groupBy("a", "a_end", "b", "b_end").agg(F.min("hang").alias("hang"), F.min_by("shift", "hang").alias("shift"))


def reduced(ends: DataFrame, fuzz: int = FUZZ) -> DataFrame:
    """Ends' links without those that two others explain, in either direction."""
    first = ends.select("a", "a_end", F.col("b").alias("m"), F.col("b_end").alias("m_end"), F.col("hang").alias("h1"))
    second = ends.select(F.col("a").alias("m"), opposite("a_end").alias("m_end"), "b", "b_end", F.col("hang").alias("h2"))
    around = first.join(second, ["m", "m_end"]).filter("a <> b").groupBy("a", "a_end", "b", "b_end").agg(F.min(F.col("h1") + F.col("h2")).alias("way"))
    gone = ends.join(around, ["a", "a_end", "b", "b_end"]).filter(F.col("way") <= F.col("hang") + fuzz).select("a", "a_end", "b", "b_end")
    both = gone.unionByName(gone.select(F.col("b").alias("a"), F.col("b_end").alias("a_end"), F.col("a").alias("b"), F.col("a_end").alias("b_end"))).distinct()
    return ends.join(both, ["a", "a_end", "b", "b_end"], "left_anti")


def joints(ends: DataFrame) -> DataFrame:
    """Links between two ends that have no other link."""
    single = ends.groupBy("a", "a_end").agg(F.count("*").alias("n")).filter("n = 1").select("a", "a_end")
    out = ends.join(single, ["a", "a_end"], "left_semi")
    return out.join(single.select(F.col("a").alias("b"), F.col("a_end").alias("b_end")), ["b", "b_end"], "left_semi").filter("a <> b").select("a", "a_end", "b", "b_end", "shift")


def layout(links: DataFrame, lengths: DataFrame, fuzz: int = FUZZ) -> DataFrame:
    """(unitig, circ, idx, pos, rev, name, n): reads of each unitig in order; n bases of each count, of the last all (-1).

    ``lengths(header, length)``. A unitig has two reads at least; its name is that of the read it begins with.
    """
    joined = materialize(joints(reduced(materialize(end_links(links), "ends"), fuzz)), "joints")
    # A visit enters a read at one end and leaves by the other; steps go from visit to visit.
    reads = joined.select(F.col("a").alias("name")).distinct()
    visits = reads.select("name", F.explode(F.array(F.lit("L"), F.lit("R"))).alias("enter"))
    out = joined.select(F.col("a").alias("name"), opposite("a_end").alias("enter"), F.col("b").alias("to"), F.col("b_end").alias("to_enter"), "shift")
    steps = materialize(visits.join(out, ["name", "enter"], "left"), "steps")
    jump = steps.select("name", "enter", F.coalesce("to", "name").alias("far"), F.coalesce("to_enter", "enter").alias("far_enter"), F.when(F.col("to").isNull(), 0).otherwise(1).cast("long").alias("dist"), F.coalesce("to", "name").alias("low"))
    jump = jump.withColumn("low", F.least("low", "name"))
    stops = steps.filter("to is null").select(F.col("name").alias("far"), F.col("enter").alias("far_enter"), F.lit(True).alias("__stop"))
    total = reads.count()
    rounds = max(1, total.bit_length())
    jump = materialize(jump.withColumn("news", F.lit(True)), "jump")
    for _ in range(rounds):
        ahead = jump.select(F.col("name").alias("far"), F.col("enter").alias("far_enter"), F.col("far").alias("f2"), F.col("far_enter").alias("e2"), F.col("dist").alias("d2"), F.col("low").alias("l2"))
        ended = stops.select(F.col("far").alias("f2"), F.col("far_enter").alias("e2"), "__stop")
        moved = jump.join(ahead, ["far", "far_enter"]).join(ended, ["f2", "e2"], "left")
        # A path has visits at every distance from its end, so one arrives in each round until all have; where no least name
        # of a ring changes in a round, each is that of its whole ring.
        news = (F.col("d2") > 0) & F.col("__stop").isNotNull() | (F.col("l2") < F.col("low"))
        moved = moved.select("name", "enter", F.col("f2").alias("far"), F.col("e2").alias("far_enter"), (F.col("dist") + F.col("d2")).alias("dist"), F.least("low", "l2").alias("low"), news.alias("news"))
        jump, old = materialize(moved, "jump"), jump
        discard(old)
        if jump.filter("news").isEmpty():
            break
    placed = jump.drop("news").join(stops, ["far", "far_enter"], "left")
    # A path and its mirror image both appear; the one whose first read's name is less stays.
    lines = placed.filter("__stop").groupBy("far", "far_enter").agg(F.max_by(F.struct("name", "enter"), "dist").alias("first"), F.max("dist").alias("last"))
    lines = lines.filter(F.col("first.name") < F.col("far")).select("far", "far_enter", F.col("first.name").alias("unitig"), "last")
    straight = placed.filter("__stop").join(lines, ["far", "far_enter"]).select("unitig", F.lit(False).alias("circ"), (F.col("last") - F.col("dist")).alias("idx"), "name", "enter")
    rings = _rings(placed.filter("__stop is null").select("name", "enter", "low"), steps)
    ordered = straight.unionByName(rings)
    sized = ordered.join(steps.select("name", "enter", "shift"), ["name", "enter"]).join(lengths.select(F.col("header").alias("name"), "length"), "name", "left_semi")
    # A read gives what lies before the next one begins.
    given = F.greatest(F.col("shift"), F.lit(0))
    w = W.partitionBy("unitig").orderBy("idx")
    last = F.col("idx") == F.max("idx").over(W.partitionBy("unitig"))
    n = sized.withColumn("n", F.when(last, F.lit(-1).cast("long")).otherwise(given))
    pos = F.coalesce(F.sum(F.col("n")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return n.withColumn("pos", pos).select("unitig", "circ", "idx", "pos", (F.col("enter") == "R").cast("int").alias("rev"), "name", "n")


def _rings(visits: DataFrame, steps: DataFrame) -> DataFrame:
    """Circular paths, cut before their least read, entered at its left end."""
    if visits.isEmpty():
        return visits.select(F.col("low").alias("unitig"), F.lit(True).alias("circ"), F.lit(0).cast("long").alias("idx"), "name", "enter")
    ring = materialize(visits.join(steps.select("name", "enter", "to", "to_enter"), ["name", "enter"]), "ring")
    start = ring.filter("name = low and enter = 'L'").select(F.col("low"), "name", "enter")
    # Distance to the start, by doubling over the ring cut there.
    first = start.select(F.col("name").alias("to"), F.col("enter").alias("to_enter"), F.lit(True).alias("__cut"))
    cut = ring.join(first, ["to", "to_enter"], "left").select("name", "enter", "low", F.when(F.col("__cut"), None).otherwise(F.col("to")).alias("to"), F.when(F.col("__cut"), None).otherwise(F.col("to_enter")).alias("to_enter"))
    jump = cut.select("name", "enter", "low", F.coalesce("to", "name").alias("far"), F.coalesce("to_enter", "enter").alias("far_enter"), F.when(F.col("to").isNull(), 0).otherwise(1).cast("long").alias("dist"))
    ends = materialize(cut.filter("to is null").select(F.col("name").alias("far"), F.col("enter").alias("far_enter")), "ring_ends")
    for _ in range(max(1, ring.count().bit_length())):
        jump = materialize(jump, "ring_jump")
        ahead = jump.select(F.col("name").alias("far"), F.col("enter").alias("far_enter"), F.col("far").alias("f2"), F.col("far_enter").alias("e2"), F.col("dist").alias("d2"))
        jump = jump.join(ahead, ["far", "far_enter"]).select("name", "enter", "low", F.col("f2").alias("far"), F.col("e2").alias("far_enter"), (F.col("dist") + F.col("d2")).alias("dist"))
    reached = materialize(jump.join(ends, ["far", "far_enter"], "left_semi"), "ring_jump")
    size = reached.groupBy("low", "far", "far_enter").agg(F.max("dist").alias("last"))
    return reached.join(size, ["low", "far", "far_enter"]).select(F.col("low").alias("unitig"), F.lit(True).alias("circ"), (F.col("last") - F.col("dist")).alias("idx"), "name", "enter")


def assembled(placed: DataFrame, sequences: DataFrame) -> DataFrame:
    """(unitig, circ, seq, length) from a layout and ``sequences(header, seq)``."""
    joined = placed.join(sequences.select(F.col("header").alias("name"), "seq"), "name")
    turned = F.when(F.col("rev") == 1, reverse_complement(F.col("seq"))).otherwise(F.col("seq"))
    part = F.when(F.col("n") >= 0, F.substring(turned, F.lit(1), F.col("n").cast("int"))).otherwise(turned)
    parts = joined.select("unitig", "circ", F.struct("idx", part.alias("part")).alias("x"))
    whole = parts.groupBy("unitig", "circ").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["part"]), "").alias("seq"))
    return whole.withColumn("length", F.length("seq"))


def stable_id(names: Column) -> Column:
    """An id of 20 characters that depends on the members alone, so that a repeated run gives the same one."""
    return F.substring(F.sha2(F.array_join(F.array_sort(names), ","), 256), 1, 20)
