"""Alignment records in PAF text: reading with tags, mapping mode, overlap mode, writing.

Fields that should be numbers and aren't become null, as does a row's geometry then; such rows fail every filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import alignment as al

# The columns of the format.
COLUMNS = ("qname", "qlen", "qstart", "qend", "strand", "tname", "tlen", "tstart", "tend", "num_matches", "block_len", "mapq")
TEXT = {"qname", "strand", "tname"}


def normal_name(name: Column) -> Column:
    """Names that read as numbers lose leading zeros and a plus sign."""
    digits = F.regexp_replace(name, "_", "")
    number = F.regexp_extract(digits, r"^\s*([+-]?)0*([0-9]+)\s*$", 2)
    sign = F.when(digits.rlike(r"^\s*-") & (number != "0"), F.lit("-")).otherwise(F.lit(""))
    return F.when(name.rlike(r"^\s*[+-]?[0-9]+(_[0-9]+)*\s*$"), F.concat(sign, number)).otherwise(name)


def parse(lines: DataFrame, tags: bool = True) -> DataFrame:
    """Records from ``lines(value)``; ``line_no`` is kept if it is there."""
    fields = F.split("value", "\t")
    columns = [normal_name(F.get(fields, F.lit(i))).alias(c) if c in ("qname", "tname") else F.get(fields, F.lit(i)).alias(c) if c in TEXT else F.get(fields, F.lit(i)).try_cast("long").alias(c) for i, c in enumerate(COLUMNS)]
    extra = [F.col("line_no")] if "line_no" in lines.columns else []
    out = lines.filter(F.size(fields) >= len(COLUMNS)).select(*columns, *extra, F.col("value").alias("line"), F.slice(fields, 13, 1000).alias("__tags"))
    out = out.withColumns({"rev": F.when(F.col("strand") == "+", 0).otherwise(1), "maplen": al.map_length()})
    if not tags:
        return out.drop("__tags")
    pairs = F.transform(F.filter("__tags", lambda t: F.size(F.split(t, ":")) == 3), lambda t: F.struct(F.split(t, ":")[0].alias("k"), F.split(t, ":")[2].alias("v")))
    # Of repeated tags the last one counts.
    value = lambda k: F.try_element_at(F.filter(F.col("__pairs"), lambda p: p["k"] == k), F.lit(-1))["v"]
    tagged = out.withColumn("__pairs", pairs)
    return tagged.withColumns(
        {"align_score": F.coalesce(value("AS").try_cast("long"), F.lit(0).cast("long")), "cigar": value("cg"), "s1": F.coalesce(value("s1").try_cast("long"), F.lit(0).cast("long")), "is_primary": F.when(value("tp") == "P", 1).otherwise(0)}
    ).drop("__tags", "__pairs")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records of the files of ``path``; line_no follows the file."""
    return parse(spark.read.text(path).withColumn("line_no", F.monotonically_increasing_id()))


def from_text(spark: SparkSession, text: str) -> DataFrame:
    rows = [(x, i) for i, x in enumerate(text.split("\n")) if x]
    return parse(spark.createDataFrame(rows, "value string, line_no long"))


def mappings(records: DataFrame, min_len: int = 1) -> DataFrame:
    """Mapping mode: primary records of at least ``min_len``."""
    return records.filter((F.col("block_len") >= min_len) & (F.col("is_primary") == 1))


def overlaps(records: DataFrame, min_map_len: int = 2000, min_s1: int = 200, min_seq_len: int = 2500) -> DataFrame:
    """Overlap mode: filtered and classified; class 1 rows are those to skip."""
    return al.with_class(records.filter(al.passes(min_map_len, min_s1, min_seq_len)))


def lines_of(records: DataFrame) -> DataFrame:
    """(value): the twelve columns and the tags tp and s1."""
    return records.select(F.concat_ws("\t", *[F.col(c).cast("string") if c != "num_matches" or c in records.columns else F.lit("0") for c in COLUMNS], F.concat(F.lit("tp:A:"), F.when(F.col("is_primary") == 1, "P").otherwise("S")), F.concat(F.lit("s1:i:"), F.col("s1").cast("string"))).alias("value"))


def write(lines: DataFrame, path: str) -> None:
    """Each distinct line once."""
    lines.select("value").distinct().write.mode("overwrite").text(path)
