"""Whole batches, a live run over files, a simulation, decisions on a stream."""

import random

import pytest
from pyspark.sql import functions as F

from strandlake.operators import pool as po
from strandlake.plans import update as up
from strandlake.sources import fastq, masks
from strandlake.streaming import live


def simulated_reads(n, genome_len=30_000, seed=1):
    rng = random.Random(seed)
    genome = "".join(rng.choices("ACGT", k=genome_len))
    out = []
    for i in range(n):
        at = min(i * (genome_len - 8000) // max(1, n - 1), genome_len - 8000)
        seq = genome[at : at + 8000]
        out.append((f"r{i}", seq if i % 2 else seq[::-1].translate(str.maketrans("ACGT", "TGCA"))))
    return genome, out


SETTINGS = up.Settings(tetra=False)


def test_update_assembles_a_contig(spark):
    genome, reads = simulated_reads(6)
    state = up.update(up.empty(spark), spark.createDataFrame(reads, "read_id string, seq string"), SETTINGS)
    contigs = po.contigs(state.sequences).collect()
    assert len(contigs) == 1
    assert contigs[0].seq in (genome, genome[::-1].translate(str.maketrans("ACGT", "TGCA")))
    assert len(contigs[0].cov) == len(contigs[0].seq)
    assert sorted(contigs[0].atoms) == [f"r{i}" for i in range(6)]
    assert state.mask is not None and state.mask.count() == 2 * -(-len(contigs[0].seq) // 100)


def test_live_run_over_files(spark, tmp_path):
    _, reads = simulated_reads(6)
    folder = tmp_path / "in"
    folder.mkdir()
    for k in (0, 1):
        (folder / f"{k}.fastq").write_text("".join(f"@{n} ch={k + 1}\n{s}\n+\n{'I' * len(s)}\n" for n, s in reads[k::2]))
    work = f"file://{tmp_path}/work"
    query = live.run_live(spark, str(folder), work, SETTINGS, seconds=None)
    query.awaitTermination(180)
    assert query.exception() is None
    assert masks.newest(spark, f"{work}/masks") is not None
    _, ready = live.Store(spark, work).load(0)
    assert ready


def test_decisions_on_a_stream(spark, tmp_path):
    masks.write(spark.createDataFrame([("k", 0, 0, False)], masks.SCHEMA), f"{tmp_path}/masks", 1)
    rows = spark.createDataFrame([("a", "ACG", "k", 50, 0), ("b", "ACG", None, None, None)], "read_id string, seq string, contig string, r_pos long, strand int")
    rows.write.parquet(f"{tmp_path}/hits")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/hits")
    query = live.decide_stream(stream, masks.Masks(spark, f"{tmp_path}/masks"), f"{tmp_path}/out", {"single_off": "unblock"}, f"{tmp_path}/ck", once=True)
    query.awaitTermination(120)
    got = {r.read_id: (r.decision, r.action) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {"a": ("single_off", "unblock"), "b": ("no_map", None)}


@pytest.mark.parametrize("size,first,most", [(6, 1, 1)])
def test_simulation(spark, tmp_path, size, first, most):
    _, reads = simulated_reads(6)
    _, more = simulated_reads(3)
    rows = [("f", i, n, s) for i, (n, s) in enumerate(reads + [(f"x{n}", s) for n, s in more])]
    frame = spark.createDataFrame(rows, "file string, record long, read_id string, seq string")
    state, clocks = live.run_simulation(spark, frame, f"file://{tmp_path}/work", size, first, most, SETTINGS)
    assert po.contigs(state.sequences).count() >= 1
    assert clocks.first().control == 3 * 8000 + 6 * 200


def test_dumps(spark, tmp_path):
    df = spark.createDataFrame([("a", "A")], "read_id string, seq string")
    live.write_cache(df, f"{tmp_path}/d", "control", 0)
    live.write_cache(df, f"{tmp_path}/d", "control", 1)
    assert live.cumulative_dump(spark, f"{tmp_path}/d", "control", 0).count() == 1
    assert live.cumulative_dump(spark, f"{tmp_path}/d", "control", 1).count() == 2
    assert live.by_condition(spark.createDataFrame([(1,), (2,)], "channel int"), spark.createDataFrame([(1, "run")], "channel int, condition string")).filter(F.col("condition") == "run").count() == 1
    drawn = [r.id for r in fastq.sample_with_replacement(spark.range(1000), 0.5, 1).collect()]
    assert 400 < len(drawn) < 600 and len(set(drawn)) < len(drawn)
    assert sorted(drawn) == sorted(r.id for r in fastq.sample_with_replacement(spark.range(1000), 0.5, 1).collect())
