"""Secret scans with an incremental blob ledger, in DataFrame operations only.

Every version of every path is addressed by the SHA-256 of its content. The ledger is a
pair of tables in one folder: ``scanned`` holds the (blob, rule, rule_version) triples that
have been looked at, ``findings`` their spans. A scan reads the text of one version of each
blob for which some rule version is new, appends to the ledger, and joins the findings
back to every path that holds the blob.

Shuffles carry addresses, not texts, except that the texts are dealt once by a hash of
their row, so copies of one blob never meet in a task. A scan that is repeated after a
failure appends the same findings again; readers drop repeats.

Edge cases: null content counts as empty; an empty table gives an empty result; a path that
occurs again with the same content keeps its rows; null paths are paths like any other; other
columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import drop_at_exit, fresh_path, require, table, written


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds leftmost non-overlapping matches; those whose ``group`` is shorter than ``least`` are dropped."""

    kind: str
    version: int
    pattern: str
    group: int
    least: int


# The patterns of the base rules.
RULES = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20),
    # A run of fewer than 24 digits is never a match, so it needn't be listed first.
    Rule("hex", 1, r"[0-9a-f]{24,}", 0, 24),
)

SCANNED = "blob string, kind string, version int"
FINDINGS = "blob string, kind string, version int, start int, `end` int"


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path) if _exists(spark, path) else spark.createDataFrame([], schema)


def _pieces(text: Column, rule: Rule) -> Column:
    """For each match: characters between it and the one before, its length, the length of the group that counts."""
    pattern = F.lit(rule.pattern)
    gaps = F.transform(F.split(text, rule.pattern, -1), F.length)
    long = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length)
    counted = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.length) if rule.group else long
    found = F.transform(
        F.arrays_zip(gaps.alias("gap"), long.alias("long"), counted.alias("counted")),
        lambda x: F.struct(F.lit(rule.kind).alias("kind"), F.lit(rule.version).alias("version"), x["gap"].alias("gap"), x["long"].alias("long"), x["counted"].alias("counted")),
    )
    none = F.array().cast("array<struct<kind:string,version:int,gap:int,long:int,counted:int>>")
    return F.when(text.rlike(rule.pattern), found).otherwise(none)


def find(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Spans in the texts of ``blobs(blob, todo, text)``; ``todo`` lists the kinds to look for.

    Offsets are in characters (code points), the end exclusive. A match's start is the running
    sum of what came before it in its blob, so a text with very many matches costs no more than their number.
    Rows that repeat a blob give equal pieces, which count once, or the sum would take each of them.
    """
    least = F.create_map(*[F.lit(x) for r in rules for x in (r.kind, r.least)])
    parts = F.flatten(F.array(*[F.when(F.array_contains("todo", r.kind), _pieces(F.col("text"), r)).otherwise(F.array().cast("array<struct<kind:string,version:int,gap:int,long:int,counted:int>>")) for r in rules]))
    rows = blobs.select("blob", F.posexplode(parts).alias("i", "m")).select("blob", "i", "m.*").distinct()
    run = W.partitionBy("blob", "kind").orderBy("i")
    ends = rows.filter(F.col("long").isNotNull()).withColumn("end", F.sum(F.col("gap") + F.col("long")).over(run).cast("int"))
    return ends.filter(F.col("counted") >= least[F.col("kind")]).select("blob", "kind", "version", (F.col("end") - F.col("long")).alias("start"), "end")


def scan(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Brings the ledger up to date with ``versions(path, content)`` and returns (path, blob) of each version.

    Only blobs that lack some rule version in the ledger are read, one version of each.
    """
    require(versions, "path", "content")
    spark = versions.sparkSession
    content = F.coalesce("content", F.lit(""))
    named = versions.select("path", F.xxhash64("path").alias("at"), F.sha2(content, 256).alias("blob"), content.alias("text"))
    address = written(named.select("path", "at", "blob"), "versions")
    rulings = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
    done = _read(spark, f"{ledger}/scanned", SCANNED)
    blobs = address.groupBy("blob").agg(F.min("at").alias("at"))
    unseen = blobs.select("blob", "at", F.explode(rulings).alias("r")).select("blob", "at", "r.*").join(done, ["blob", "kind", "version"], "left_anti")
    todo = written(unseen.groupBy("blob", "at").agg(F.collect_set("kind").alias("todo")), "unseen")
    texts = named.select("blob", "at", "text").join(todo.hint("shuffle_hash"), ["blob", "at"])
    find(texts, rules).write.mode("append").parquet(f"{ledger}/findings")
    kinds = F.create_map(*[F.lit(x) for r in rules for x in (r.kind, r.version)])
    marks = todo.select("blob", F.explode("todo").alias("kind")).withColumn("version", kinds[F.col("kind")])
    marks.write.mode("append").parquet(f"{ledger}/scanned")
    return address.select("path", "blob")


def findings(spark: SparkSession, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per blob with findings of these rule versions: ``spans``, an array of (start, rank, end) in order."""
    rank = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.kind, i)])
    version = F.create_map(*[F.lit(x) for r in rules for x in (r.kind, r.version)])
    rows = _read(spark, f"{ledger}/findings", FINDINGS).filter(F.col("version") == version[F.col("kind")])
    return rows.groupBy("blob").agg(F.array_sort(F.collect_set(F.struct("start", rank[F.col("kind")].alias("rank"), "end"))).alias("spans"))


def report(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(path, spans) of every version; spans is empty where nothing is found. Copies share their blob's findings."""
    paths = scan(versions, ledger, rules)
    found = findings(versions.sparkSession, ledger, rules)
    none = F.array().cast("array<struct<start:int,rank:int,end:int>>")
    return paths.join(found, "blob", "left").select("path", F.coalesce("spans", none).alias("spans"))


def redact(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, mark: str = "[REDACTED]") -> DataFrame:
    """``docs`` with every secret of ``text`` replaced by ``mark`` and ``n_chars`` set anew; rows and other columns stay.

    Overlapping spans are replaced as one. A null text stays null. The findings of a text are joined by its address. Columns whose
    names begin with two underscores are the operator's own and mustn't be in ``docs``.
    """
    require(docs, "text")
    spark = docs.sparkSession
    scan(docs.select(F.col("doc_id").alias("path"), F.col("text").alias("content")), ledger, rules)
    before = W.partitionBy("blob").orderBy("start", "end", "kind").rowsBetween(W.unboundedPreceding, -1)
    version = F.create_map(*[F.lit(x) for r in rules for x in (r.kind, r.version)])
    rows = _read(spark, f"{ledger}/findings", FINDINGS).filter(F.col("version") == version[F.col("kind")]).distinct()
    rows = rows.withColumn("from", F.coalesce(F.max("end").over(before), F.lit(0)))
    cuts = rows.groupBy(F.col("blob").alias("__blob")).agg(
        F.array_sort(F.collect_list(F.struct("from", "start", "end"))).alias("__cuts"), F.max("end").alias("__end")
    )
    joined = docs.withColumn("__blob", F.sha2(F.coalesce("text", F.lit("")), 256)).join(cuts, "__blob", "left").withColumn("__mark", F.lit(mark))
    cut = F.expr(
        f"concat(array_join(transform(__cuts, c -> if(c.start >= c.from, concat(substring(text, c.from + 1, c.start - c.from), __mark), '')), ''), substring(text, __end + 1))"
    )
    text = F.when(F.col("__cuts").isNull(), F.col("text")).otherwise(cut)
    out = joined.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text of ``documents``, one row per document, by way of a ledger that starts empty."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.col("text").alias("content"))
    kinds = F.array(*[F.lit(r.kind) for r in RULES])
    count = lambda i: F.size(F.filter("spans", lambda s: s["rank"] == i)).cast("long")
    spans = F.array_join(F.transform("spans", lambda s: F.concat(kinds[s["rank"]], F.lit(":"), s["start"], F.lit(":"), s["end"])), ",")
    ledger = fresh_path(spark, "ledger")
    found = report(docs, ledger)
    drop_at_exit(spark, ledger)
    return found.select(
        F.col("path").alias("doc_id"), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(spans, 256).alias("base_sha256"), spans.alias("spans")
    )


_SPANS = """
list_filter(list_transform(range(1, len(m) + 1), lambda i: struct_pack(
    "start" := list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0),
    "rank" := {rank}, kind := '{kind}', "long" := length(m[i]), counted := length(g[i]))), lambda s: s.counted >= {least})
"""


def oracle() -> str:
    parts = []
    for i, r in enumerate(RULES):
        pattern = r.pattern.replace("'", "''")
        spans = _SPANS.format(rank=i, kind=r.kind, least=r.least)
        parts.append(f"select doc_id, unnest({spans}) s from (select doc_id, regexp_extract_all(t, '{pattern}', 0) m, regexp_extract_all(t, '{pattern}', {r.group}) g, string_split_regex(t, '{pattern}') p from d)")
    return f"""
with d as (select doc_id, coalesce(text, '') t from documents),
f as ({' union all '.join(parts)}),
a as (select doc_id, count(*) filter (s.rank = 0) n_assign, count(*) filter (s.rank = 1) n_access, count(*) filter (s.rank = 2) n_hex,
  string_agg(s.kind || ':' || cast(s.start as bigint) || ':' || cast(s.start + s.long as bigint), ',' order by s.start, s.rank) spans from f group by doc_id)
select doc_id, coalesce(n_assign, 0) n_assign, coalesce(n_access, 0) n_access, coalesce(n_hex, 0) n_hex, sha256(coalesce(spans, '')) base_sha256, coalesce(spans, '') spans from d left join a using (doc_id)
"""
