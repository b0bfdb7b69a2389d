"""Assembly graphs in GFA text: segments, and unitigs with their layout and caps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, kind, f): fields of each line in the file's order."""
    raw = spark.read.text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"), "value")
    return raw.select("file", "at", F.substring("value", 1, 1).alias("kind"), F.split("value", "\t").alias("f"))


def segments(spark: SparkSession, path: str) -> DataFrame:
    """(name, seq) of all S lines."""
    return lines(spark, path).filter("kind = 'S'").select(F.col("f")[1].alias("name"), F.col("f")[2].alias("seq"))


def unitigs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(unitigs, layout) of the unitig dialect: S lines with the A lines that follow, and an x line for each S line, in order.

    Unitigs: name, seq, length, circ, cap_l, cap_r. Layout: unitig, idx, pos, rev, name, n; n is the distance to
    the next read, -1 for the last. A file whose x lines don't match its S lines in number raises an error; so does a
    length that isn't the sequence's.
    """
    rows = lines(spark, path)
    order = W.partitionBy("file").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    numbered = rows.withColumns({"block": F.sum((F.col("kind") == "S").cast("int")).over(order), "cap": F.sum((F.col("kind") == "x").cast("int")).over(order)})
    s = numbered.filter("kind = 'S'").select("file", "block", F.col("f")[1].alias("name"), F.col("f")[2].alias("seq"), F.regexp_extract(F.array_join("f", "\t"), r"LN:i:(\d+)", 1).cast("long").alias("length"))
    # Where one of the two columns is missing, neither end is capped.
    both = F.get("f", F.lit(4)).isNotNull() & F.get("f", F.lit(5)).isNotNull()
    caps = numbered.filter("kind = 'x'").select("file", F.col("cap").alias("block"), *[F.coalesce(both & (F.get("f", F.lit(i)).try_cast("long") > 0), F.lit(False)).alias(c) for i, c in ((4, "cap_l"), (5, "cap_r"))])
    wrong = numbered.groupBy("file").agg((F.count_if(F.col("kind") == "S") != F.count_if(F.col("kind") == "x")).alias("bad")).filter("bad")
    if not wrong.isEmpty():
        raise ValueError("numbers of S and x lines differ")
    checked = F.when(F.col("length") == F.length("seq"), F.col("length")).otherwise(F.raise_error(F.concat(F.lit("length differs: "), "name")).cast("long"))
    heads = s.join(caps, ["file", "block"], "left").select("file", "block", "name", "seq", checked.alias("length"), F.col("name").endswith("c").alias("circ"), F.coalesce("cap_l", F.lit(False)).alias("cap_l"), F.coalesce("cap_r", F.lit(False)).alias("cap_r"))
    a = numbered.filter("kind = 'A'").select("file", "block", "at", F.col("f")[2].cast("long").alias("pos"), (F.col("f")[3] != "+").cast("int").alias("rev"), F.col("f")[4].alias("name"))
    w = W.partitionBy("file", "block").orderBy("at")
    layout = a.withColumns({"idx": F.row_number().over(w) - 1, "n": F.coalesce(F.lead("pos").over(w) - F.col("pos"), F.lit(-1))})
    named = layout.join(heads.select("file", "block", F.col("name").alias("unitig")), ["file", "block"]).select("unitig", "idx", "pos", "rev", "name", "n")
    return heads.drop("file", "block"), named


def unitig_lines(placed: DataFrame, assembled: DataFrame, lengths: DataFrame) -> DataFrame:
    """(unitig, k, idx, value): the same dialect from a layout and assembled unitigs, to be written in order."""
    name = F.concat(F.lit("utg"), "unitig", F.when(F.col("circ"), "c").otherwise("l"))
    s = assembled.select("unitig", F.lit(0).alias("k"), F.lit(0).cast("long").alias("idx"), F.concat_ws("\t", F.lit("S"), name, "seq", F.concat(F.lit("LN:i:"), F.col("length").cast("string"))).alias("value"))
    sized = placed.join(lengths.withColumnRenamed("header", "name"), "name")
    a = sized.select("unitig", F.lit(1).alias("k"), "idx", F.concat_ws("\t", F.lit("A"), name, F.col("pos").cast("string"), F.when(F.col("rev") == 0, "+").otherwise("-"), "name", F.lit("0"), F.col("length").cast("string")).alias("value"))
    x = assembled.select("unitig", F.lit(2).alias("k"), F.lit(0).cast("long").alias("idx"), F.concat_ws("\t", F.lit("x"), name, F.col("length").cast("string"), F.lit("0"), F.lit("0"), F.lit("0")).alias("value"))
    return s.unionByName(a).unionByName(x)
