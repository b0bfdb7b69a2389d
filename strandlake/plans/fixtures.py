"""Sequencing inputs derived from the provided tables: reads, alignments, coverage bins, lengths and decisions.

Each fixture has one SQL text for DuckDB, and builds the same rows in Spark. ``{t}`` are tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import storage

_KEPT: dict[tuple[str, str, str], str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kept(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """A fixture that is built once in a session and read from the shared folder afterwards."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _KEPT:
        path = storage.fresh_path(spark, name)
        build().write.parquet(path)
        storage.drop_at_exit(spark, path)
        _KEPT[key] = path
    return spark.read.parquet(_KEPT[key])


ALPHABET, BASES = "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC"

READS_SQL = f"""select cast(doc_id as varchar) read_id, translate(lower(regexp_replace(text, '[^A-Za-z]', '', 'g')), '{ALPHABET}', '{BASES}') seq from documents"""

_PAF_BODY = """
k as (select cast(l_orderkey % 400 as bigint) qi, cast(l_partkey % 397 as bigint) ti, l_orderkey*31+l_linenumber*7 a, l_partkey*29+l_suppkey*11+l_linenumber b, l_returnflag, l_linestatus, l_linenumber, line_no from numbered),
n as (select *, 6000+(qi*7919)%30000 qlen, 6000+(ti*7919)%30000 tlen,
 concat('r',cast(qi as varchar(20)),case when qi%2=0 then '*' else '' end) qname, concat('r',cast(ti as varchar(20)),case when ti%2=0 then '*' else '' end) tname from k),
c as (select *, case when a%3=0 then a%60 else (a*37)%(qlen-3000) end qstart, case when b%3=0 then b%60 else (b*41)%(tlen-3000) end tstart from n),
d as (select *, case when a%5<2 then qlen-a%70 else qstart+1800+(a*53)%(qlen-qstart-1800) end qend, case when b%5<3 then tlen-b%70 else tstart+1800+(b*59)%(tlen-tstart-1800) end tend,
 case when l_returnflag='R' then 1 else 0 end rev, 150+a%900 s1 from c),
paf as (select qname, qlen, qstart, qend, case when rev = 1 then '-' else '+' end strand, tname, tlen, tstart, tend, rev, s1,
 least(qend-qstart, tend-tstart) maplen, greatest(qend-qstart, tend-tstart) block_len, cast(l_linenumber * 8 as bigint) mapq, case when l_linestatus = 'O' then 1 else 0 end is_primary, line_no from d)
"""

ORDER = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
#: Common table expressions that end with ``paf``; DuckDB numbers rows by a window.
PAF_SQL = f"numbered as (select *, row_number() over (order by {ORDER}) line_no from lineitem)," + _PAF_BODY


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(read_id, seq, length): letters of documents as bases."""
    return spark.sql(
        "select cast(doc_id as string) read_id, seq, length(seq) length from (select doc_id, translate(lower(regexp_replace(text, '[^A-Za-z]', '')), '"
        + ALPHABET + "', '" + BASES + "') seq from {documents})",
        documents=table(spark, sf_dir, "documents"),
    )


def paf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignments of all classes from ``lineitem``; ``line_no`` is their order in the file."""

    def build() -> DataFrame:
        numbered = storage.number_rows(table(spark, sf_dir, "lineitem"), *ORDER.split(", "))
        return spark.sql("with numbered as (select * from {numbered})," + _PAF_BODY + "select * from paf", numbered=numbered)

    return kept(spark, sf_dir, "paf", build)


BINS_SQL = f"bins as (select concat('c', cast(l_suppkey % 8 as varchar(20))) contig, row_number() over (partition by l_suppkey % 8 order by {ORDER}) - 1 bin, l_quantity * 37.0 cov_sum from lineitem)"


def bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(contig, bin, cov_sum)."""
    return spark.sql(
        "select concat('c', cast(l_suppkey % 8 as string)) contig, cast(row_number() over (partition by l_suppkey % 8 order by " + ORDER + ") - 1 as bigint) bin, l_quantity * 37.0D cov_sum from {lineitem}",
        lineitem=table(spark, sf_dir, "lineitem"),
    )


DECISIONS_SQL = "decisions as (select cast(event_id as varchar) read_id, concat('c', cast(user_id % 8 as varchar(20))) contig, cast(floor(value * 100) as bigint) r_pos, case when event_type in ('view', 'click') then 0 else 1 end strand, event_type <> 'error' mapped, ts from events)"


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(read_id, contig, r_pos, strand, mapped, ts)."""
    return spark.sql(
        "select cast(event_id as string) read_id, concat('c', cast(user_id % 8 as string)) contig, cast(floor(value * 100) as bigint) r_pos, case when event_type in ('view', 'click') then 0 else 1 end strand, event_type <> 'error' mapped, ts from {events}",
        events=table(spark, sf_dir, "events"),
    )
