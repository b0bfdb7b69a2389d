"""Expressions over one alignment record: filters, geometry, classes.

Columns: qname, qlen, qstart, qend, tname, tlen, tstart, tend, rev (0 or 1), s1, maplen. Classes: 1 internal, 2 query
contained, 3 target contained, 4 query-to-target overlap, 5 target-to-query overlap, 6 to be trimmed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col

# Fixed values of the classification.
OVERHANG_SHARE = 0.15
CONTAINED_SHARE = 0.90
LONG_SHARE, LONG_QUERY = 0.5, 20_000
NEAR_END, NEAR_SHARE = 1000, 0.15
TRIM_LEN, TRIM_MAP = 15_000, 5_000


def query_span() -> Column:
    return c("qend") - c("qstart")


def target_span() -> Column:
    return c("tend") - c("tstart")


def map_length() -> Column:
    return F.least(query_span(), target_span())


def passes(min_map_len: int = 2000, min_s1: int = 200, min_seq_len: int = 2500) -> Column:
    """Not aligned to itself, and long and good enough."""
    return (c("qname") != c("tname")) & (map_length() >= min_map_len) & (c("s1") >= min_s1) & (F.least("qlen", "tlen") >= min_seq_len)


def by_strand(forward: Column, reverse: Column) -> Column:
    return F.when(c("rev") == 0, forward).otherwise(reverse)


def overhang() -> Column:
    """Unaligned bases on the inner sides of both ends."""
    q_after, t_after = c("qlen") - c("qend"), c("tlen") - c("tend")
    return by_strand(F.least("qstart", "tstart") + F.least(q_after, t_after), F.least(c("qstart"), t_after) + F.least(c("tstart"), q_after))


def first_contained() -> Column:
    q_after, t_after = c("qlen") - c("qend"), c("tlen") - c("tend")
    return by_strand((c("qstart") <= c("tstart")) & (q_after < t_after), (c("qstart") <= t_after) & (q_after < c("tstart")))


def second_contained() -> Column:
    q_after, t_after = c("qlen") - c("qend"), c("tlen") - c("tend")
    return by_strand((c("qstart") >= c("tstart")) & (q_after > t_after), (c("qstart") >= t_after) & (q_after > c("tstart")))


def _sided(klass: int, q: str, t: str) -> Column:
    return F.struct(F.lit(klass).alias("c"), F.lit(q).alias("qside"), F.lit(t).alias("tside"))


def orientation() -> Column:
    """Struct (c, qside, tside) of an overlap at the ends."""
    q_after, t_after = c("qlen") - c("qend"), c("tlen") - c("tend")
    forward = F.when(c("qstart") > c("tstart"), _sided(4, "R", "L")).otherwise(_sided(5, "L", "R"))
    right = F.when(c("qstart") > t_after, _sided(4, "R", "R")).otherwise(_sided(5, "R", "R"))
    left = F.when(c("qlen") - c("qstart") > c("tend"), _sided(4, "L", "L")).otherwise(_sided(5, "L", "L"))
    return by_strand(forward, F.when(c("qstart") > q_after, right).otherwise(left))


def near_end(start: str, end: str, length: str, limit: float = NEAR_END) -> Column:
    """Whether an alignment comes near an end; a limit below 1 is a share of the length."""
    return F.least(c(start), c(length) - c(end)) < (c(length) * limit if limit < 1 else F.lit(limit))


def merged_names() -> Column:
    return c("qname").contains("*") & c("tname").contains("*")


def trimmable() -> Column:
    """Struct (ok, qprox): an internal match that trimming one end would turn into an overlap."""
    fits = (c("qlen") > TRIM_LEN) & (c("tlen") > TRIM_LEN) & (c("maplen") > TRIM_MAP) & merged_names()
    q_near, t_near = near_end("qstart", "qend", "qlen"), near_end("tstart", "tend", "tlen")
    ok = F.when(q_near, near_end("tstart", "tend", "tlen", NEAR_SHARE) & fits).when(t_near, near_end("qstart", "qend", "qlen", NEAR_SHARE) & fits).otherwise(False)
    return F.struct(ok.alias("ok"), q_near.alias("qprox"))


def with_class(paf: DataFrame) -> DataFrame:
    """Adds c, qside, tside, qprox; the first rule that holds decides."""
    q_share, t_share = query_span() / c("qlen"), target_span() / c("tlen")
    none = F.lit(None).cast("string")
    plain = lambda k: F.struct(F.lit(k).alias("c"), none.alias("qside"), none.alias("tside"))
    first = (
        F.when(overhang() > OVERHANG_SHARE * c("maplen"), plain(1)).when(first_contained(), plain(2)).when(second_contained(), plain(3))
        .when(q_share >= CONTAINED_SHARE, plain(2)).when(t_share >= CONTAINED_SHARE, plain(3)).otherwise(orientation())
    )
    # An internal match gets a second look; both shares ask for a long query.
    second = (
        F.when((q_share >= LONG_SHARE) & (c("qlen") > LONG_QUERY), plain(2)).when((t_share >= LONG_SHARE) & (c("qlen") > LONG_QUERY), plain(3))
        .when(trimmable()["ok"], plain(6)).otherwise(plain(1))
    )
    out = paf.withColumn("__k", first).withColumn("__k", F.when(c("__k.c") == 1, second).otherwise(c("__k")))
    return out.select(*paf.columns, "__k.*", trimmable()["qprox"].alias("qprox"))


def trim_coordinates() -> Column:
    """Struct (sid, trim_start, trim_stop, other, new_len) of what a class 6 record cuts off; sid '0' if the cut would shorten."""
    q = c("qprox")
    pick = lambda a, b: F.when(q, c(a)).otherwise(c(b))
    # Near the query's end, the target is trimmed, and the other way round.
    sid, start, end, length = pick("tname", "qname"), pick("tstart", "qstart"), pick("tend", "qend"), pick("tlen", "qlen")
    other, other_len = pick("qname", "tname"), pick("qlen", "tlen")
    head = start <= length - end
    trim_start, trim_stop = F.when(head, F.lit(0)).otherwise(end), F.when(head, start).otherwise(length)
    new_len = length - (trim_stop - trim_start) + other_len - c("block_len")
    return F.struct(
        F.when(new_len < length, F.lit("0")).otherwise(sid).alias("sid"), trim_start.cast("long").alias("trim_start"), trim_stop.cast("long").alias("trim_stop"), other.alias("other"), new_len.alias("new_len")
    )


def containment_coordinates() -> Column:
    """Struct of container and contained with spans and lengths, for classes 2 and 3."""

    def side(inner: str, outer: str) -> Column:
        named = {"contained": f"{inner}name", "cstart": f"{inner}start", "cend": f"{inner}end", "clen": f"{inner}len", "container": f"{outer}name", "ostart": f"{outer}start", "oend": f"{outer}end", "olen": f"{outer}len"}
        return F.struct(*[c(v).alias(k) for k, v in named.items()])

    return F.when(c("c") == 2, side("q", "t")).when(c("c") == 3, side("t", "q"))


def pair_key() -> Column:
    return F.concat_ws("-", F.least("qname", "tname"), F.greatest("qname", "tname"))
