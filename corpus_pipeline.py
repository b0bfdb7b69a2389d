"""The corpus pipeline: documents that the quality rules keep lose repeated lines, near-duplicates and secrets, and are packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result to the shared folder and reads it
as the next stage's documents. All stages but the last return the columns of ``documents``. A stage deletes the tables that the one
before it made on the way, unless its documents still read them, so the result of a stage has to be written before the next one begins
with other documents.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from strandlake.llm import line_dedup, packing, quality_rules, secret_scan, simhash
from strandlake.llm.common import delete, drop_at_exit, fresh_path, reclaim, recorded, table, vocabulary, written

#: Folders that stages made and that may still be there, by application.
_MADE: dict[str, list[str]] = {}


def clearing(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage, which first deletes what earlier stages made and ``docs`` doesn't read."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        app = spark.sparkContext.applicationId
        if old := _MADE.get(app):
            files = docs.inputFiles()
            used = [x for x in old if any(f"/{x.rsplit('/', 1)[-1]}/" in f for f in files)]
            for path in set(old) - set(used):
                delete(spark, path)
            _MADE[app] = used
        reclaim(spark)
        with recorded() as made:
            out = stage(spark, docs, sf_dir)
        _MADE[app] = _MADE.get(app, []) + made
        return out

    return run


@clearing
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.accepted(docs, vocabulary("piece_bpe_32k.model"))


@clearing
def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of like lines the first one stays; documents without a line left go."""
    return line_dedup.without_repeats(docs)


@clearing
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash.dedupe(docs)


@clearing
def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark."""
    ledger = fresh_path(spark, "ledger")
    kept = secret_scan.redact(docs, ledger)
    drop_at_exit(spark, ledger)
    return kept


@clearing
def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in windows of 4,096."""
    return packing.windows(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality rules", keep_quality),
    ("line dedup", drop_repeated_lines),
    ("simhash near-dedup", drop_near_duplicates),
    ("secret scans", redact_secrets),
    ("packing", pack_windows),
]

#: SQL can't express the tokenizers. The operators are tested against brute force one by one; the test of the whole reruns the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
