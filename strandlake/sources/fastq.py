"""Reads from FASTQ and FASTA files, in batches and as a stream source.

Two ways in: ``strict`` takes files of four lines a record with Spark's own text reader, and ``register`` adds the data source
``reads`` for records of any number of lines. Both read gzip files. In either, of repeated names the last one of the last
file stays if asked for.
"""

from __future__ import annotations

import gzip
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.links import latest_best
from ..plans.storage import number_rows

#: Endings of read files.
ENDINGS = ("*.fq.gz", "*.fastq.gz", "*.fastq.gzip", "*.fq.gzip", "*.fastq", "*.fq")
GLOB = "{" + ",".join(ENDINGS) + "}"
SCHEMA = "file string, record long, description string, read_id string, seq string, quality string"


def records(lines: Iterator[str]) -> Iterator[tuple[str, str, str | None]]:
    """(description, sequence, quality) of FASTA and FASTQ records of any number of lines; a cut-off quality is None.

    An unfinished last line counts in full.
    """
    line = next(lines, None)
    while line is not None:
        if not line.startswith((">", "@")):
            line = next(lines, None)
            continue
        name, parts = line[1:], []
        line = next(lines, None)
        while line is not None and not line.startswith(("@", "+", ">")):
            parts.append(line)
            line = next(lines, None)
        seq = "".join(parts)
        if line is None or not line.startswith("+"):
            yield name, seq, None
            continue
        quality, size = [], 0
        line = next(lines, None)
        while line is not None and size < len(seq):
            quality.append(line)
            size += len(line)
            line = next(lines, None)
        yield name, seq, "".join(quality) if size >= len(seq) else None


class ReadFiles(DataSource):
    """Data source ``reads``: options ``paths``, comma-separated files. A file is one partition, as records don't align with blocks."""

    @classmethod
    def name(cls) -> str:
        return "reads"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ReadFilesReader(self.options)


class ReadFilesReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.paths = [p for p in options.get("paths", "").split(",") if p]

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition):
        import io

        import pyarrow.fs

        # Hadoop writes local paths as file:/..., which isn't taken elsewhere.
        uri = re.sub(r"^file:/(?!/)", "file:///", partition.value)
        fs, path = pyarrow.fs.FileSystem.from_uri(uri) if "://" in uri else (pyarrow.fs.LocalFileSystem(), uri)
        with fs.open_input_stream(path, compression=None) as raw:
            data = gzip.open(raw) if path.endswith((".gz", ".gzip")) else raw
            text = io.TextIOWrapper(data, encoding="utf-8", errors="replace", newline="")
            for i, (name, seq, quality) in enumerate(records(x.rstrip("\r\n") for x in text)):
                yield partition.value, i, name, name.split(" ")[0], seq, quality


def read_any(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Records of any layout."""
    spark.dataSource.register(ReadFiles)
    return spark.read.format("reads").option("paths", ",".join(paths)).load()


def strict(spark: SparkSession, path: str) -> DataFrame:
    """Records of four lines from files below ``path``: (file, record, description, read_id, seq, quality, source).

    Lines keep their place by the file's offset order, which Spark's text reader gives within a file read as one split.
    """
    # One split a file, so that the id's order is the file's.
    lines = spark.read.option("pathGlobFilter", GLOB).option("wholetext", False).text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("id"), "value")
    place = F.row_number().over(W.partitionBy("file").orderBy("id")) - 1
    rows = lines.withColumn("at", place).select("file", F.floor(F.col("at") / 4).alias("record"), (F.col("at") % 4).alias("k"), "value")
    part = lambda k: F.max(F.when(F.col("k") == k, F.col("value")))
    found = rows.groupBy("file", "record").agg(F.expr("substring(max(case when k = 0 then value end), 2)").alias("description"), part(1).alias("seq"), part(3).alias("quality"))
    words = F.split("description", " ")
    return found.select("file", "record", "description", words[0].alias("read_id"), "seq", "quality", F.element_at(words, -1).alias("source"))


def channel(description: str = "description"):
    return F.try_to_number(F.nullif(F.regexp_extract(description, r"\sch=([0-9]*)", 1), F.lit("")), F.lit("9999999999")).cast("int")


def on_channels(reads: DataFrame, channels: DataFrame | None) -> DataFrame:
    """Reads of ``channels(channel)`` only; without any channel given all stay, and reads that name none always go otherwise."""
    numbered = reads.withColumn("channel", channel())
    if channels is None or channels.isEmpty():
        return numbered
    return numbered.join(channels.select("channel").distinct(), "channel", "left_semi")


def last_of_each(reads: DataFrame) -> DataFrame:
    """One row per read_id: that of the last file, and there the last one."""
    return latest_best(reads, ["read_id"], "file", "record")


def batch_summary(reads: DataFrame) -> DataFrame:
    return reads.agg(F.count("*").alias("reads"), F.coalesce(F.sum(F.length("seq")), F.lit(0)).cast("long").alias("bases"))


def batches(reads: DataFrame, size: int, most: int | None = None, seed: int | None = None) -> DataFrame:
    """Adds batch_id: ``size`` reads each, in file order or shuffled by ``seed``; up to ``most`` batches after the first.

    The shuffle orders by a hash, so the same seed gives the same batches however the data are split.
    """
    if seed is not None:
        ordered = number_rows(reads.withColumn("__key", F.xxhash64(F.lit(seed), "file", "record")), "__key", "file", "record", name="__n").drop("__key")
    else:
        ordered = number_rows(reads, "file", "record", name="__n")
    out = ordered.withColumn("batch_id", F.floor((F.col("__n") - 1) / size)).drop("__n")
    return out if most is None else out.filter(F.col("batch_id") <= most)


def sample_with_replacement(reads: DataFrame, fraction: float, seed: int) -> DataFrame:
    return reads.sample(withReplacement=True, fraction=fraction, seed=seed)


def fasta_lines(sequences: DataFrame, key: str = "header") -> DataFrame:
    return sequences.select(F.concat(F.lit(">"), key, F.lit("\n"), "seq").alias("value"))


def write_fasta(sequences: DataFrame, path: str, key: str = "header") -> None:
    fasta_lines(sequences, key).write.mode("overwrite").text(path)


def write_contigs(contigs: DataFrame, path: str, batch: int) -> None:
    """The contigs for mapping, and every tenth batch a copy that stays."""
    write_fasta(contigs, path)
    if batch % 10 == 0:
        write_fasta(contigs, f"{path}_{batch}")


