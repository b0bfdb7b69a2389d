"""Edges of the read graph: containments, overlap links, and what is removed from them.

A containment is (source, target): source is contained in target. Links are stored in both directions. Of several records for
an edge the one with the highest s1 stays, of equals the later line. Every top-1 is an aggregate with partial sums, so a pair
with very many records costs no more than its rows. Empty inputs give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import alignment as al

#: Bases to a bin.
NODE = 100
#: A pair with more records than this isn't searched for containments of several parts.
MOST_PARTS = 10


def latest_best(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """One row per key: that with the greatest ``order``; columns stay."""
    row = F.max_by(F.struct(*df.columns), F.struct(*order)).alias("__row")
    return df.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(row).select("__row.*")


def containments(classified: DataFrame) -> DataFrame:
    """Classes 2 and 3 as one row per (source, target)."""
    q_in = F.col("c") == 2
    edges = classified.filter(F.col("c").isin(2, 3)).withColumns({"source": F.when(q_in, F.col("qname")).otherwise(F.col("tname")), "target": F.when(q_in, F.col("tname")).otherwise(F.col("qname"))})
    return latest_best(edges, ["source", "target"], "s1", "line_no")


def with_acceptors(classified: DataFrame, closed: DataFrame) -> DataFrame:
    """Overlaps with a sequence of ``closed(header)``, which accepts no links, become containments; ``forced`` marks them."""
    names = closed.select("header").distinct()
    t_closed = names.select(F.col("header").alias("tname"), F.lit(True).alias("__t"))
    q_closed = names.select(F.col("header").alias("qname"), F.lit(True).alias("__q"))
    joined = classified.join(t_closed, "tname", "left").join(q_closed, "qname", "left")
    overlap = F.col("c").isin(4, 5)
    klass = F.when(overlap & F.col("__t").isNotNull(), 2).when(overlap & F.col("__q").isNotNull(), 3).otherwise(F.col("c"))
    return joined.withColumns({"forced": overlap & (F.col("__t").isNotNull() | F.col("__q").isNotNull()), "c": klass}).select(*classified.columns, "forced")


def links(classified: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Overlaps (classes 4 and 5) and the ``stored`` links, the best of each pair, in both directions (u, v)."""
    new = classified.filter(F.col("c").isin(4, 5))
    if stored is not None:
        # What is stored came before any line of this load.
        old = stored.filter("u < v").drop("u", "v").withColumn("line_no", F.lit(-1).cast("long"))
        new = new.unionByName(old, allowMissingColumns=True)
    best = latest_best(new.withColumn("pair", al.pair_key()), ["pair"], "s1", "line_no").drop("pair")
    both = F.explode(F.array(F.struct(F.col("qname").alias("u"), F.col("tname").alias("v")), F.struct(F.col("tname").alias("u"), F.col("qname").alias("v"))))
    return best.withColumn("__e", both).select("__e.*", *best.columns)


def last_overlaps(classified: DataFrame) -> DataFrame:
    """The last overlap of each (qname, tname)."""
    return latest_best(classified.filter(F.col("c").isin(4, 5)), ["qname", "tname"], "line_no")


def overlappers(linked: DataFrame) -> DataFrame:
    """(header) of all sequences with a link."""
    return linked.select(F.col("u").alias("header")).distinct()


def _covered(start: str, end: str, bins: Column) -> Column:
    """Bins below ``bins`` that a record covers."""
    low, high = F.floor(F.col(start) / NODE), F.least(F.floor(F.col(end) / NODE), bins)
    return F.when(high > low, F.sequence(low, high - 1)).otherwise(F.array().cast("array<bigint>"))


def multiline_containments(internal: DataFrame, contained: DataFrame) -> DataFrame:
    """Containments that several internal matches of a pair make up, one row per pair.

    ``internal`` are class 1 rows; pairs with a sequence of ``contained(header)`` are left out, and so are those with one record
    or with more than ``MOST_PARTS``, before anything is gathered. All records of a pair take the first one's naming.
    """
    gone = contained.select("header").distinct()
    rows = internal.join(gone.withColumnRenamed("header", "qname"), "qname", "left_anti").join(gone.withColumnRenamed("header", "tname"), "tname", "left_anti")
    rows = rows.withColumn("pair", al.pair_key())
    several = rows.groupBy("pair").agg(F.count("*").alias("parts"), F.min_by(F.struct("qname", "tname", "qlen", "tlen"), "line_no").alias("head")).filter(F.col("parts").between(2, MOST_PARTS))
    q_bins, t_bins = F.floor(F.col("head.qlen") / NODE), F.floor(F.col("head.tlen") / NODE)
    marked = rows.select("pair", "qstart", "qend", "tstart", "tend", "maplen", "line_no").join(several, "pair")
    marked = marked.withColumns({"q": _covered("qstart", "qend", q_bins), "t": _covered("tstart", "tend", t_bins)})
    longest = F.max_by(F.struct("qstart", "qend", "tstart", "tend"), F.struct("maplen", -F.col("line_no"))).alias("longest")
    sums = marked.groupBy("pair", "head").agg(F.array_distinct(F.flatten(F.collect_list("q"))).alias("q"), F.array_distinct(F.flatten(F.collect_list("t"))).alias("t"), longest)
    spans = sums.select(
        "pair", "head.*", "longest", F.size("q").alias("q_n"), F.size("t").alias("t_n"),
        F.array_min("q").alias("q_low"), F.array_max("q").alias("q_high"), F.array_min("t").alias("t_low"), F.array_max("t").alias("t_high"),
    )

    def fits(x: str) -> Column:
        bins = F.floor(F.col(f"{x}len") / NODE)
        return (F.col(f"{x}_n") > bins * 0.9) & (F.col(f"{x}_high") - F.col(f"{x}_low") > bins * 0.85)

    def edge(inner: str, outer: str) -> Column:
        wide = F.col(f"{outer}_high") - F.col(f"{outer}_low") > 2.2 * (F.col(f"{inner}_high") - F.col(f"{inner}_low"))
        low = F.when(wide, F.floor(F.col(f"longest.{outer}start") / NODE)).otherwise(F.col(f"{outer}_low"))
        high = F.when(wide, F.floor(F.col(f"longest.{outer}end") / NODE)).otherwise(F.col(f"{outer}_high"))
        return F.struct(
            F.col(f"{inner}name").alias("source"), F.col(f"{outer}name").alias("target"), F.col(f"{inner}len").alias("clen_total"), F.col(f"{outer}len").alias("olen_total"),
            (F.col(f"{inner}_low") * NODE).alias("cstart"), (F.col(f"{inner}_high") * NODE).alias("cend"), (low * NODE).alias("ostart"), (high * NODE).alias("oend"),
        )

    found = F.when(fits("q") & (F.col("t_n") > 0), edge("q", "t")).when(fits("t") & (F.col("q_n") > 0), edge("t", "q"))
    return spans.withColumn("e", found).filter("e is not null").select("e.*")


def source_union(*edges: DataFrame) -> DataFrame:
    """(source): all sources of several edge sets."""
    out = edges[0].select("source")
    for e in edges[1:]:
        out = out.unionByName(e.select("source"))
    return out.distinct()


def multiplicity(edges: DataFrame) -> DataFrame:
    """(source, n): edges of each source within a level."""
    return edges.groupBy("source").agg(F.count("*").alias("n"))


def without_sequences(linked: DataFrame, ids: DataFrame) -> DataFrame:
    """Links of which neither end is in ``ids(header)``."""
    gone = ids.select("header").distinct()
    return linked.join(gone.withColumnRenamed("header", "u"), "u", "left_anti").join(gone.withColumnRenamed("header", "v"), "v", "left_anti")


def trim_outcome(trimmed: DataFrame, overlaps: DataFrame) -> DataFrame:
    """(header) to remove after a trim: originals whose trimmed copy ``sid%`` overlaps now, and copies that don't.

    ``trimmed(sid)`` are the originals; ``overlaps(qname, tname)`` those of the load that followed.
    """
    seen = overlaps.select(F.col("qname").alias("header")).unionByName(overlaps.select(F.col("tname").alias("header"))).distinct()
    copies = trimmed.select("sid", F.concat("sid", F.lit("%")).alias("header")).distinct()
    good = copies.join(seen, "header", "left_semi").select(F.col("sid").alias("header"))
    return good.unionByName(copies.join(seen, "header", "left_anti").select("header"))
