"""Live runs as Structured Streaming: read files in, state tables on, masks out; and decisions on a stream of hits."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import decisions as de
from ..operators import pool as po
from ..plans import update as up
from ..sources import fastq, masks


def new_files(spark: SparkSession, folder: str, per_batch: int | None = None) -> DataFrame:
    """(path) of read files that come into ``folder``; the query's checkpoint remembers which were seen."""
    stream = spark.readStream.format("binaryFile").option("pathGlobFilter", fastq.GLOB)
    if per_batch:
        stream = stream.option("maxFilesPerTrigger", per_batch)
    # Contents aren't read here, only names.
    return stream.schema("path string, modificationTime timestamp, length long, content binary").load(folder).select("path")


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)




@dataclass
class Store:
    """The state of a run as one folder per batch; a batch that is repeated writes its folder again from the one before it."""

    spark: SparkSession
    path: str

    def save(self, state: up.State, batch: int, ready: bool) -> None:
        at = f"{self.path}/state/batch={batch}"
        for name in ("sequences", "links", "lengths"):
            getattr(state, name).write.mode("overwrite").parquet(f"{at}/{name}")
        self.spark.createDataFrame([(state.batch, ready)], "batch int, ready boolean").coalesce(1).write.mode("overwrite").parquet(f"{at}/done")

    def load(self, batch: int) -> tuple[up.State, bool]:
        """The state after ``batch``, and whether the run is past its warm-up."""
        at = f"{self.path}/state/batch={batch}"
        if not _exists(self.spark, f"{at}/done/_SUCCESS"):
            return up.empty(self.spark), False
        read = lambda name, schema: self.spark.read.schema(schema).parquet(f"{at}/{name}")
        done = self.spark.read.parquet(f"{at}/done").first()
        return up.State(read("sequences", up.SEQUENCES), read("links", up.LINKS), read("lengths", "length long, n long"), batch=done["batch"]), done["ready"]


def step(store: Store, reads: DataFrame, batch: int, settings: up.Settings, aligner: up.Aligner | None = None, warm_up_bases: int = 0) -> up.State:
    """One batch. During the warm-up reads are only gathered; when there are enough bases the first assembly is made, and
    the warm-up ends with the first contig."""
    state, ready = store.load(batch - 1)
    if not ready:
        gathered = po.upsert(state.sequences, po.intake(reads, settings.min_seq_len))
        if (po.total_bases(gathered).first()["bases"] or 0) < warm_up_bases:
            kept = up.replace(state, sequences=gathered)
            store.save(kept, batch, False)
            return kept
        before = state.sequences.select(F.col("header").alias("read_id"), "seq")
        state = up.State(store.spark.createDataFrame([], up.SEQUENCES), state.links, state.lengths, batch=state.batch)
        reads = before.unionByName(reads.select("read_id", "seq"))
    state = up.update(state, reads.select("read_id", "seq"), settings, aligner)
    ready = po.has_contig(state.sequences, settings.min_contig_len)
    if state.mask is not None:
        masks.write(state.mask, f"{store.path}/masks", batch)
    fastq.write_contigs(po.contigs(state.sequences, settings.min_contig_len), f"{store.path}/contigs", batch)
    store.save(state, batch, ready)
    return state


def run_live(spark: SparkSession, folder: str, work: str, settings: up.Settings | None = None, seconds: int | None = 60, channels: DataFrame | None = None, aligner: up.Aligner | None = None, warm_up_bases: int = 0) -> StreamingQuery:
    """Watches ``folder`` and updates the state in ``work`` every ``seconds``; None: takes what is there and ends."""
    settings, store = settings or up.Settings(), Store(spark, work)

    def each(files: DataFrame, batch: int) -> None:
        paths = sorted(r["path"] for r in files.collect())  # names of a batch's files
        if not paths:
            return
        reads = fastq.on_channels(fastq.last_of_each(fastq.read_any(spark, paths)), channels)
        step(store, reads, batch, settings, aligner, warm_up_bases)

    writer = new_files(spark, folder).writeStream.foreachBatch(each).option("checkpointLocation", f"{work}/checkpoint")
    return (writer.trigger(availableNow=True) if seconds is None else writer.trigger(processingTime=f"{seconds} seconds")).start()


def run_simulation(spark: SparkSession, reads: DataFrame, work: str, size: int, first: int, most: int, settings: up.Settings | None = None, aligner: up.Aligner | None = None, mapper: Callable | None = None, seed: int | None = None) -> tuple[up.State, DataFrame]:
    """Batches of ``reads(file, record, read_id, seq)``: the first ones whole, later ones as the mask decides. Returns the state and the clocks."""
    from ..operators import overlap as ov
    from ..plans.storage import materialize

    settings, store = settings or up.Settings(), Store(spark, work)
    numbered = materialize(fastq.batches(reads, size, most, seed), "batches")
    state = step(store, numbered.filter(F.col("batch_id") < first), 0, settings, aligner)
    cache = None
    for batch in range(first, most + 1):
        now = numbered.filter(F.col("batch_id") == batch).select("read_id", "seq")
        if now.isEmpty():
            break
        decided = now.withColumn("decision", F.lit("accept"))
        if state.mask is not None:
            contigs = po.contigs(state.sequences, settings.min_contig_len).select(F.col("header").alias("id"), "seq")
            short = de.truncate(now, settings.mu).select(F.col("read_id").alias("id"), "seq")
            hits = (mapper or ov.map_reads)(short, contigs).withColumn("line_no", F.monotonically_increasing_id())
            decided = de.apply_simulated(now, de.simulated(de.best_hits(hits), state.mask), settings.mu)
        decided = materialize(decided, "decided")
        lengths = now.select("read_id", F.length("seq").alias("length")).join(decided.select("read_id", F.length("seq").alias("decided_length")), "read_id").withColumn("batch_id", F.lit(batch))
        cache = lengths if cache is None else cache.unionByName(lengths)
        state = step(store, decided, batch - first + 1, settings, aligner)
    clocks = de.clocks(cache, size, settings.mu) if cache is not None else spark.createDataFrame([], "batch_id int, control long, treatment long")
    return state, clocks


def write_cache(decided: DataFrame, path: str, condition: str, dump: int) -> None:
    """Reads of a condition up to a dump; what was sequenced by then is all partitions up to it."""
    decided.withColumns({"condition": F.lit(condition), "dump": F.lit(dump)}).write.mode("append").partitionBy("condition", "dump").parquet(path)


def cumulative_dump(spark: SparkSession, path: str, condition: str, dump: int) -> DataFrame:
    return spark.read.parquet(path).filter((F.col("condition") == condition) & (F.col("dump") <= dump))


def decide_stream(hits: DataFrame, mask: masks.Masks, sink: str, actions: dict[str, str], checkpoint: str, once: bool = False) -> StreamingQuery:
    """Decides on a stream of reads with hits: (read_id, seq, contig, r_pos, strand), contig null for none.

    The mask of each micro-batch is the newest one by then.
    """

    def each(rows: DataFrame, batch: int) -> None:
        reads = rows.groupBy("read_id").agg(F.max("seq").alias("seq"))
        decided = de.live_decisions(reads, rows.filter("contig is not null").select("read_id", "contig", "r_pos", "strand"), mask.current())
        de.with_actions(decided, actions).withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{sink}/batch={batch}")

    writer = hits.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def by_condition(reads: DataFrame, conditions: DataFrame) -> DataFrame:
    """Adds the condition of each read's channel, by ``conditions(channel, condition)``; others are control."""
    return reads.join(conditions, "channel", "left").withColumn("condition", F.coalesce("condition", F.lit("control")))


