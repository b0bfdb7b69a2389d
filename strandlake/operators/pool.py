"""The pool of sequences: intake, contigs, members, ageing.

``sequences(header, seq, cov, atoms, components, temperature, cap_l, cap_r, acceptor)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START_TEMPERATURE, REHEATED, REHEATED_CONTIG = 30, 60, 50


def intake(reads: DataFrame, min_len: int = 2500) -> DataFrame:
    """New sequences from ``reads(read_id, seq)`` longer than ``min_len``: coverage 1, their own only atom."""
    none = F.array().cast("array<string>")
    return reads.filter(F.length("seq") > min_len).select(
        F.col("read_id").alias("header"), "seq", F.array_repeat(F.lit(1.0), F.length("seq")).alias("cov"), F.array("read_id").alias("atoms"), none.alias("components"),
        F.lit(START_TEMPERATURE).alias("temperature"), F.lit(False).alias("cap_l"), F.lit(False).alias("cap_r"), F.lit(True).alias("acceptor"),
    )


def upsert(old: DataFrame, new: DataFrame, key: str = "header") -> DataFrame:
    """``old`` with rows of the same key replaced by those of ``new``."""
    return old.join(new.select(key).distinct(), key, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def contigs(sequences: DataFrame, min_len: int = 10_000) -> DataFrame:
    return sequences.filter(F.length("seq") > min_len)


def has_contig(sequences: DataFrame, min_len: int = 10_000) -> bool:
    return not contigs(sequences, min_len).isEmpty()


def total_bases(sequences: DataFrame) -> DataFrame:
    return sequences.agg(F.coalesce(F.sum(F.length("seq")), F.lit(0)).cast("long").alias("bases"))


def longest(sequences: DataFrame, n: int = 10) -> DataFrame:
    """(header, length) of the ``n`` longest, a report."""
    return sequences.select("header", F.length("seq").alias("length")).orderBy(F.desc("length"), "header").limit(n)


def members(groups: DataFrame, sequences: DataFrame) -> DataFrame:
    """(unitig, atoms, components): atoms of all its sequences; their components and the sequences themselves.

    ``groups(unitig, header)``. Members are made distinct before they are gathered.
    """
    joined = groups.join(sequences.select("header", "atoms", "components"), "header")
    atoms = joined.select("unitig", F.explode("atoms").alias("x")).distinct().groupBy("unitig").agg(F.array_sort(F.collect_list("x")).alias("atoms"))
    inside = joined.select("unitig", F.explode(F.array_union("components", F.array("header"))).alias("x")).distinct().groupBy("unitig").agg(F.array_sort(F.collect_list("x")).alias("components"))
    return atoms.join(inside, "unitig", "full")


def without(sequences: DataFrame, ids: DataFrame) -> DataFrame:
    """Sequences that aren't in ``ids(header)``."""
    return sequences.join(ids.select("header").distinct(), "header", "left_anti")


def reheat(sequences: DataFrame, ids: DataFrame, to: int = REHEATED) -> DataFrame:
    marked = sequences.join(ids.select("header").distinct().withColumn("__hot", F.lit(True)), "header", "left")
    return marked.withColumn("temperature", F.when(F.col("__hot"), F.lit(to)).otherwise(F.col("temperature"))).drop("__hot").select(*sequences.columns)


def cool(sequences: DataFrame, min_contig_len: int = 10_000) -> DataFrame:
    """Sequences shorter than a contig lose one degree; ``frozen`` marks those at zero or below."""
    short = F.length("seq") < min_contig_len
    cooled = sequences.withColumn("temperature", F.when(short, F.col("temperature") - 1).otherwise(F.col("temperature")))
    return cooled.withColumn("frozen", short & (F.col("temperature") <= 0))
