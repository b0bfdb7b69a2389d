"""Accept masks as versioned tables, and the NumPy container that sequencers' software reads."""

from __future__ import annotations

import io
import zipfile

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "contig string, bin long, strand int, accept boolean"


def write(mask: DataFrame, path: str, version: int) -> None:
    """A new version beside the old ones; readers see it whole or not at all, as Spark commits it."""
    mask.select("contig", "bin", "strand", "accept").write.mode("overwrite").parquet(f"{path}/version={version}")


def newest(spark: SparkSession, path: str) -> int | None:
    """The newest version that was committed."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    at = hadoop.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return None
    names = [s.getPath() for s in fs.listStatus(at)]
    found = [int(p.getName().split("=")[1]) for p in names if p.getName().startswith("version=") and fs.exists(hadoop.Path(p, "_SUCCESS"))]
    return max(found, default=None)


def load(spark: SparkSession, path: str) -> DataFrame:
    """The newest version; where there is none, an empty mask, by which everything is accepted."""
    version = newest(spark, path)
    if version is None:
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(f"{path}/version={version}")


class Masks:
    """The mask of a folder, read again only if a newer version is there."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.version, self.frame = spark, path, None, spark.createDataFrame([], SCHEMA)

    def current(self) -> DataFrame:
        version = newest(self.spark, self.path)
        if version is not None and (self.version is None or version > self.version):
            self.frame, self.version = load(self.spark, self.path), version
        return self.frame


def rows_of(mask: DataFrame) -> DataFrame:
    """(contig, bits): both strands' bits of each contig, bin by bin."""
    cells = mask.groupBy("contig", "bin").agg(F.max(F.when(F.col("strand") == 0, F.col("accept"))).alias("f"), F.max(F.when(F.col("strand") == 1, F.col("accept"))).alias("r"))
    return cells.groupBy("contig").agg(F.array_sort(F.collect_list(F.struct("bin", F.coalesce("f", F.lit(False)).alias("f"), F.coalesce("r", F.lit(False)).alias("r")))).alias("bits"))


def export_npz(mask: DataFrame, path: str) -> int:
    """One uncompressed container of a boolean array (bins, 2) per contig; contigs come to the driver one at a time."""
    count = 0
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as out:
        for row in rows_of(mask).toLocalIterator():
            data = io.BytesIO()
            np.save(data, np.array([(b["f"], b["r"]) for b in row["bits"]], dtype=bool))
            out.writestr(f"{row['contig']}.npy", data.getvalue())
            count += 1
    return count


def import_npz(spark: SparkSession, path: str) -> DataFrame:
    rows = []
    with np.load(path) as held:
        for contig in held.files:
            cells = held[contig]
            rows += [(contig, i, s, bool(cells[i, s])) for i in range(len(cells)) for s in range(2)]
    return spark.createDataFrame(rows, SCHEMA)


def unlike_names(mask: DataFrame, contigs: DataFrame) -> DataFrame:
    """(contig, side): names that only the mask or only the index knows."""
    a, b = mask.select("contig").distinct(), contigs.select(F.col("header").alias("contig")).distinct()
    return a.join(b, "contig", "left_anti").withColumn("side", F.lit("mask")).unionByName(b.join(a, "contig", "left_anti").withColumn("side", F.lit("index")))
