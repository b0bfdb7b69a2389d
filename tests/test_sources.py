"""Readers, writers and configuration."""

import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.plans import config
from strandlake.sources import fastq, gfa, masks, paf


def test_records_of_any_layout():
    lines = ["@a x", "AC", "GT", "+", "II", "II", ">b", "AAA", "@c", "AC", "+", "I"]
    assert list(fastq.records(iter(lines))) == [("a x", "ACGT", "IIII"), ("b", "AAA", None), ("c", "AC", None)]


def test_fastq_files(spark, tmp_path):
    (tmp_path / "a.fastq").write_text("@r1 ch=3 s1\nACGT\n+\nIIII\n@r2 ch=4 s2\nAC\n+\nII\n")
    with gzip.open(tmp_path / "b.fq.gz", "wt") as f:
        f.write("@r1 ch=3 s3\nGGGG\n+\nIIII\n")
    (tmp_path / "c.txt").write_text("@no\nA\n+\nI\n")
    got = fastq.strict(spark, str(tmp_path))
    assert sorted((r.read_id, r.seq, r.source) for r in got.collect()) == [("r1", "ACGT", "s1"), ("r1", "GGGG", "s3"), ("r2", "AC", "s2")]
    assert sorted((r.read_id, r.seq) for r in fastq.last_of_each(got).collect()) == [("r1", "GGGG"), ("r2", "AC")]
    again = fastq.read_any(spark, [str(tmp_path / "a.fastq"), str(tmp_path / "b.fq.gz")])
    assert again.count() == 3
    channels = spark.createDataFrame([(4,)], "channel int")
    assert [r.read_id for r in fastq.on_channels(got, channels).collect()] == ["r2"]
    assert fastq.on_channels(got, None).count() == 3
    assert fastq.batch_summary(got).first().bases == 10


def test_batches(spark):
    reads = spark.range(10).select(F.lit("f").alias("file"), F.col("id").alias("record"))
    got = {r.record: r.batch_id for r in fastq.batches(reads, 4).collect()}
    assert [got[i] for i in range(10)] == [0, 0, 0, 0, 1, 1, 1, 1, 2, 2]
    one, two = (sorted((r.record, r.batch_id) for r in fastq.batches(reads, 4, 1, seed=5).collect()) for _ in range(2))
    assert one == two and len(one) == 8


def test_fasta_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", "ACGT"), ("b", "GG")], "header string, seq string")
    fastq.write_contigs(df, str(tmp_path / "x"), 10)
    parts = sorted(str(p) for p in (tmp_path / "x_10").glob("part-*"))
    assert sorted((r.read_id, r.seq) for r in fastq.read_any(spark, parts).collect()) == [("a", "ACGT"), ("b", "GG")]


def test_paf(spark, tmp_path):
    text = "007\t9000\t0\t3000\t+\tb\t9000\t6000\t9000\t10\t3000\t60\ttp:A:P\ts1:i:300\tAS:i:7\tcg:Z:3M\nq\tx\t0\t3000\t-\tb\t9000\t6000\t9000\t10\t3000\t60\n"
    rows = paf.from_text(spark, text).orderBy("line_no").collect()
    assert (rows[0].qname, rows[0].rev, rows[0].s1, rows[0].align_score, rows[0].cigar, rows[0].is_primary) == ("7", 0, 300, 7, "3M", 1)
    assert (rows[1].qlen, rows[1].s1, rows[1].is_primary, rows[1].rev) == (None, 0, 0, 1)
    records = paf.from_text(spark, text)
    assert paf.mappings(records).count() == 1
    assert [r.c for r in paf.overlaps(records).collect()] == [5]
    paf.write(paf.lines_of(records).unionByName(paf.lines_of(records)), str(tmp_path / "p"))
    assert spark.read.text(str(tmp_path / "p")).count() == 2


def test_gfa(spark, tmp_path):
    (tmp_path / "u.gfa").write_text("S\tutg1l\tACGTA\tLN:i:5\nA\tutg1l\t0\t+\ta\t0\t3\nA\tutg1l\t2\t-\tb\t0\t3\nS\tutg2c\tGG\tLN:i:2\nA\tutg2c\t0\t+\tc\t0\t2\nL\tz\nx\tutg1l\t5\t1\t1\t0\nx\tutg2c\t2\t0\n")
    units, layout = gfa.unitigs(spark, str(tmp_path / "u.gfa"))
    assert sorted((r.name, r.length, r.circ, r.cap_l, r.cap_r) for r in units.collect()) == [("utg1l", 5, False, True, False), ("utg2c", 2, True, False, False)]
    assert sorted((r.unitig, r.idx, r.pos, r.rev, r.name, r.n) for r in layout.collect()) == [("utg1l", 0, 0, 0, "a", 2), ("utg1l", 1, 2, 1, "b", -1), ("utg2c", 0, 0, 0, "c", -1)]
    assert gfa.segments(spark, str(tmp_path / "u.gfa")).count() == 2
    (tmp_path / "bad.gfa").write_text("S\tutg1l\tACGTA\tLN:i:5\n")
    with pytest.raises(ValueError):
        gfa.unitigs(spark, str(tmp_path / "bad.gfa"))


def test_masks(spark, tmp_path):
    path = str(tmp_path / "masks")
    held = masks.Masks(spark, path)
    assert held.current().isEmpty()
    mask = spark.createDataFrame([("k", 0, 0, True), ("k", 0, 1, False), ("k", 1, 0, False), ("k", 1, 1, True)], masks.SCHEMA)
    masks.write(mask, path, 1)
    assert held.current().count() == 4
    masks.write(mask.filter("bin = 0"), path, 2)
    assert held.current().count() == 2
    assert masks.export_npz(mask, str(tmp_path / "m.npz")) == 1
    with np.load(tmp_path / "m.npz") as f:
        assert f["k"].tolist() == [[True, False], [False, True]]
    assert sorted(map(tuple, masks.import_npz(spark, str(tmp_path / "m.npz")).collect())) == sorted(map(tuple, mask.collect()))
    contigs = spark.createDataFrame([("z",)], "header string")
    assert sorted(map(tuple, masks.unlike_names(mask, contigs).collect())) == [("k", "mask"), ("z", "index")]


def test_config(tmp_path):
    (tmp_path / "live.toml").write_text('[live]\ndevice = "D"\ndata_wait = 30\n[optional]\nwait = 30\nbsize = 400\n')
    got = config.load(str(tmp_path / "live.toml"))
    assert (got.min_seq_len, got.data_wait, got.wait, got.live_run, got.sim_run) == (2500, 30, 30, True, False)
    assert got.bsize == 4000  # the later section wins
    assert config.load({"simulation": {"fq": "x"}}).sim_run
    with pytest.raises(ValueError):
        config.load({})
    regions = {"regions": [{"name": "run", "no_map": "stop_receiving", "single_on": "a"}, {"name": "control"}]}
    split = config.load({"live": {"device": "D", "prom": True}}, regions)
    assert split.split_flowcell and split.channels == 3000
    assert config.actions(split) == {"no_map": "stop_receiving", "single_on": "a"}
    with pytest.raises(ValueError):
        config.load({"live": {"device": "D"}, "general": {"name": "other"}}, regions)
    assert config.channels_of({"conditions": {"1": {"name": "run", "channels": [1, 2]}}}, "run") == {1, 2}


def test_command_line_settings(tmp_path):
    from strandlake.__main__ import settings_of

    (tmp_path / "sim.toml").write_text('[simulation]\nfq = "x.fq"\n[filters]\nmin_seq_len = 100\n[const]\nlowcov = 1\n')
    args = config.parser().parse_args(["--toml", str(tmp_path / "sim.toml")])
    got = settings_of(config.load(args.toml, args.decisions))
    assert (got.min_seq_len, got.lowcov, got.temperature) == (100, 1, 60)
