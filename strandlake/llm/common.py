"""What the corpus operators share: the shared folder, written intermediate tables, table access."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a data folder, read by Spark alone."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Only where the cluster names none (as in tests) a local folder is made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        found = f"file://{tempfile.mkdtemp(prefix='strandlake-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nobody else uses."""
    return f"{shared_dir(spark)}/strandlake/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table written to the shared folder and read again.

    This cuts lineage: a lost executor costs the running tasks only, and what depended
    on the order in which rows arrived stays as it was first computed.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    drop_at_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` made and that nothing reads any more, and the shuffle files of finished steps."""
    for df in tables:
        if path := df.__dict__.pop("_written_to", None):
            delete(df.sparkSession, path)
    if tables:
        reclaim(tables[0].sparkSession)


#: Lists that get the path of each folder made while they are here.
_RECORDS: list[list[str]] = []


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The paths of the folders that ``drop_at_exit`` is told of meanwhile."""
    paths: list[str] = []
    _RECORDS.append(paths)
    try:
        yield paths
    finally:
        _RECORDS[:] = [x for x in _RECORDS if x is not paths]


def drop_at_exit(spark: SparkSession, path: str) -> None:
    """Has a folder deleted when the driver ends."""
    for paths in _RECORDS:
        paths.append(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder through Spark's file system layer, whatever store it is in."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def vocabulary(name: str) -> str:
    """Default place of a public vocabulary file; operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def require(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns missing: {', '.join(missing)}")


os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


def reclaim(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files of finished steps, which it does when their plans are collected as garbage.

    Events that still wait for their listeners hold plans too, so these are handled first; else the files of the last step would
    stay until the next call, beside those of the next step.
    """
    gc.collect()
    context = spark.sparkContext
    with suppress(Py4JJavaError):  # not empty in time
        context._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    context._jvm.System.gc()
