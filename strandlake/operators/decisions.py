"""Accept or reject: best hits, mask lookups, and what is then done with a read.

Masks are long tables (contig, bin, strand, accept). Lookups are equi-joins on the bin of a position; Spark broadcasts the mask
if its measured size allows. Ties of best hits go to the later line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .links import NODE, latest_best

MU = 400


def truncate(reads: DataFrame, mu: int = MU) -> DataFrame:
    """Reads cut to their first ``mu`` bases."""
    return reads.withColumn("seq", F.substring("seq", 1, mu))


def best_hits(paf: DataFrame, min_len: int = 0) -> DataFrame:
    """One primary hit of at least ``min_len`` per query: highest (mapq, align_score), of equals the last line."""
    hits = paf.filter((F.col("is_primary") == 1) & (F.col("block_len") >= min_len))
    return latest_best(hits, ["qname"], "mapq", "align_score", "line_no")


def bin_of(position: Column) -> Column:
    return F.floor(position / NODE)


def simulated(hits: DataFrame, mask: DataFrame) -> DataFrame:
    """Adds ``accept`` to each read's best hit. The position is the start, of reverse hits the last base. Every contig and bin must be there:
    one that isn't raises an error rather than losing a read."""
    position = F.when(F.col("rev") == 0, F.col("tstart")).otherwise(F.col("tend") - 1)
    keyed = hits.withColumns({"contig": F.col("tname"), "bin": bin_of(position), "strand": F.col("rev")})
    found = keyed.join(mask.select("contig", "bin", "strand", "accept"), ["contig", "bin", "strand"], "left")
    return found.withColumn("accept", F.when(F.col("accept").isNull(), F.raise_error(F.concat(F.lit("no mask at "), "contig", F.lit(":"), "bin"))).otherwise(F.col("accept")))


def live_lookup(hits: DataFrame, mask: DataFrame) -> DataFrame:
    """Adds ``accept`` to each hit (contig, r_pos, strand); what the mask doesn't know is accepted."""
    keyed = hits.withColumn("bin", bin_of(F.col("r_pos")))
    return keyed.join(mask.select("contig", "bin", "strand", "accept"), ["contig", "bin", "strand"], "left").withColumn("accept", F.coalesce("accept", F.lit(True)))


def live_decisions(reads: DataFrame, hits: DataFrame, mask: DataFrame) -> DataFrame:
    """(read_id, decision) of every read: all its hits count, and one accepted is enough.

    ``reads(read_id, seq)``, ``hits(read_id, contig, r_pos, strand)``; no hit: no_map, or no_seq for an empty sequence.
    """
    sums = live_lookup(hits, mask).groupBy("read_id").agg(F.count("*").alias("n"), F.bool_or("accept").alias("on"))
    joined = reads.join(sums, "read_id", "left")
    kind = F.concat(F.when(F.col("n") == 1, F.lit("single_")).otherwise(F.lit("multi_")), F.when(F.col("on"), F.lit("on")).otherwise(F.lit("off")))
    unmapped = F.when(F.length("seq") > 0, F.lit("no_map")).otherwise(F.lit("no_seq"))
    return joined.select("read_id", F.when(F.col("n").isNull(), unmapped).otherwise(kind).alias("decision"))


def with_actions(decided: DataFrame, actions: dict[str, str]) -> DataFrame:
    """Adds the configured action of each decision; null where none is configured."""
    pairs = [F.lit(x) for kv in sorted(actions.items()) for x in kv]
    table = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return decided.withColumn("action", F.try_element_at(table, "decision"))


def apply_simulated(reads: DataFrame, decided: DataFrame, mu: int = MU) -> DataFrame:
    """Reads as sequenced: accepted and unmapped ones in full, rejected ones to ``mu`` bases; ``decision`` says which."""
    joined = reads.join(decided.select(F.col("qname").alias("read_id"), "accept"), "read_id", "left")
    decision = F.when(F.col("accept").isNull(), F.lit("unmapped")).when(F.col("accept"), F.lit("accept")).otherwise(F.lit("reject"))
    seq = F.when(decision == "reject", F.substring("seq", 1, mu)).otherwise(F.col("seq"))
    return joined.select("read_id", seq.alias("seq"), decision.alias("decision"))


def decision_counts(decided: DataFrame) -> DataFrame:
    return decided.groupBy("decision").agg(F.count("*").alias("n"))


def clocks(batches: DataFrame, bsize: int, mu: int = MU, alpha: int = 200, rho: int = 300) -> DataFrame:
    """(batch_id, control, treatment): simulated time after each batch, from ``batches(batch_id, length, decided_length)``.

    Acquisition counts the configured batch size; a decided read of exactly ``mu`` bases counts as rejected.
    """
    from pyspark.sql import Window as W

    sums = batches.groupBy("batch_id").agg(F.sum("length").alias("full"), F.sum("decided_length").alias("cut"), F.sum((F.col("decided_length") == mu).cast("long")).alias("rejected"))
    so_far = W.orderBy("batch_id").rowsBetween(W.unboundedPreceding, 0)  # one row per batch
    control, treatment = F.col("full") + bsize * alpha, F.col("cut") + bsize * alpha + rho * F.col("rejected")
    return sums.select("batch_id", F.sum(control).over(so_far).alias("control"), F.sum(treatment).over(so_far).alias("treatment"))
