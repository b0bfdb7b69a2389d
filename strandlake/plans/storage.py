"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, as in tests, a local folder is made and set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        found = f"file://{tempfile.mkdtemp(prefix='strandlake-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/strandlake/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts lineage and survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    drop_at_exit(df.sparkSession, path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(table: DataFrame) -> None:
    """Deletes a table that ``materialize`` made and that nothing reads any more, and lets the driver free the plans of finished steps."""
    spark = table.sparkSession
    if path := table.__dict__.pop("_written_to", None):
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop_at_exit(spark: SparkSession, path: str) -> None:
    """Has a folder deleted when the driver ends."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)


def number_rows(df: DataFrame, *order: str, name: str = "line_no") -> DataFrame:
    """Adds a 1-based number in the order of ``order``, which must identify rows, without a global window.

    Rows are sorted by ranges; within a range they are numbered by place, and ranges, few as they are, by a running sum.
    """
    # The number of a row in its range is in the low 33 bits of the id, that of the range above.
    ranged = materialize(df.orderBy(*order).withColumn("__id", F.monotonically_increasing_id()), "ranged")
    block, place = F.shiftright("__id", 33), F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = ranged.groupBy(block.alias("__block")).agg(F.count("*").alias("__n"))
    before = W.orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("__block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    # One row to a range, of which there are as many as shuffle partitions.
    numbered = ranged.withColumn("__block", block).join(F.broadcast(starts), "__block").withColumn(name, F.col("__before") + place + 1)
    return numbered.drop("__id", "__block", "__before")
