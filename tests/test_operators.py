"""Hand-computed cases of the operators."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.functions import alignment as al
from strandlake.functions import dna
from strandlake.operators import benefit as be
from strandlake.operators import coverage as co
from strandlake.operators import decisions as de
from strandlake.operators import links as li
from strandlake.operators import overlap as ov
from strandlake.operators import unitigs as un
from strandlake.plans import queries

PAF = "qname string, qlen long, qstart long, qend long, tname string, tlen long, tstart long, tend long, rev int, s1 long, maplen long, block_len long, line_no long"


def paf(spark, *rows):
    full = [(q, ql, qs, qe, t, tl, ts, te, rev, 500, min(qe - qs, te - ts), max(qe - qs, te - ts), i) for i, (q, ql, qs, qe, t, tl, ts, te, rev) in enumerate(rows)]
    return spark.createDataFrame(full, PAF)


def test_classes(spark):
    rows = [
        ("a", 5000, 0, 5000, "b", 9000, 2000, 7000, 0),  # in b
        ("a", 9000, 2000, 7000, "b", 5000, 0, 5000, 1),  # b in a
        ("a", 9000, 6000, 9000, "b", 9000, 0, 3000, 0),  # a's right end on b's left end
        ("a", 9000, 0, 3000, "b", 9000, 6000, 9000, 0),
        ("a", 9000, 3000, 6000, "b", 9000, 3000, 6000, 0),  # in the middle of both
        ("a", 9000, 6000, 9000, "b", 9000, 6000, 9000, 1),  # two right ends
        ("a*", 20000, 10500, 19500, "b*", 20000, 2500, 11500, 0),
    ]
    got = al.with_class(paf(spark, *rows)).orderBy("line_no").collect()
    assert [(r.c, r.qside, r.tside) for r in got] == [(2, None, None), (3, None, None), (4, "R", "L"), (5, "L", "R"), (1, None, None), (4, "R", "R"), (6, None, None)]


def test_filter_drops_rows_aligned_to_themselves(spark):
    rows = paf(spark, ("a", 9000, 0, 3000, "a", 9000, 0, 3000, 0), ("a", 9000, 0, 3000, "b", 9000, 0, 3000, 0), ("a", 9000, 0, 1999, "b", 9000, 0, 3000, 0))
    assert [r.line_no for r in rows.filter(al.passes()).collect()] == [1]


def test_ties_go_to_the_later_line(spark):
    rows = al.with_class(paf(spark, ("a", 5000, 0, 5000, "b", 9000, 2000, 7000, 0), ("a", 5000, 0, 5000, "b", 9000, 2100, 7100, 0)))
    assert [r.line_no for r in li.containments(rows).collect()] == [1]


def test_golden_strategy(spark):
    scores = spark.createDataFrame([("c", 0, 1.0), ("c", 1, 0.0), ("c", 2, 0.5)], "contig string, bin long, score double")
    ends = spark.createDataFrame([("c", True, False)], "contig string, e1 boolean, e2 boolean")
    widths = [2] * 10
    got = be.benefits(scores, ends, widths, mu=100)
    rows = {(r.strand, r.bin): r.benefit for r in got.collect()}
    assert [rows[0, i] for i in range(3)] == pytest.approx([1.75, 2.75, 0])
    assert [rows[1, i] for i in range(3)] == pytest.approx([10.5, 5.5, 1.75])
    assert be.anchor_sum(scores, ends, widths, mu=100).first().smu_sum == pytest.approx(7)
    bins = be.benefit_bins(got)
    assert [(r.e, r.n) for r in bins.orderBy("e").collect()] == [(0, 1), (1, 2), (2, 2)]
    least = be.threshold(bins, 7.0, 1000, mu=100).first().threshold
    assert least == pytest.approx(5.25)
    assert sorted((r.strand, r.bin) for r in be.mask(got, least).filter("accept").collect()) == [(1, 0), (1, 1)]


def test_exponents(spark):
    df = spark.createDataFrame([(1.0,), (0.5,), (0.3,), (0.25,)], "benefit double")
    got = [r.e for r in df.select(F.abs(be.exponent(F.col("benefit"))).alias("e")).collect()]
    assert got == [1, 0, 1, 1]
    powers = spark.createDataFrame([(k, 2.0**-k) for k in range(1000)], "k int, x double")
    assert powers.filter(be.exponent(F.col("x")) != 1 - F.col("k")).count() == 0


def test_no_benefit_gives_no_bins(spark):
    assert be.benefit_bins(spark.createDataFrame([(0.0,)], "benefit double")).count() == 0
    assert be.threshold(be.benefit_bins(spark.createDataFrame([], "benefit double")), 0.0, 6000).count() == 0


def sequences(spark, **cov):
    return spark.createDataFrame([(k, [float(x) for x in v], [k]) for k, v in cov.items()], "header string, cov array<double>, atoms array<string>")


EDGE = "source string, target string, cstart long, cend long, ostart long, oend long, rev int"


def test_increment(spark):
    seqs = sequences(spark, s=[1.0, 2, 3, 4, 5], t=[1.0] * 10, u=[1.0] * 10)
    edges = spark.createDataFrame([("s", "t", 1, 4, 2, 8, 1), ("s", "u", 0, 2, 0, 2, 0)], EDGE)
    got = {r.header: r for r in co.propagate(seqs, edges).collect()}
    assert got["t"].cov == [1, 1, 3, 3, 3, 3, 2.5, 2, 1, 1]
    assert got["u"].cov == [1.5, 2, 1, 1, 1, 1, 1, 1, 1, 1]
    assert got["t"].atoms == ["s", "t"]


def test_chain_stops_after_two_levels_of_one_width(spark):
    seqs = sequences(spark, a=[1.0] * 4, b=[1.0] * 4, c=[1.0] * 4, d=[1.0] * 4)
    edges = spark.createDataFrame([(x, y, 0, 4, 0, 4, 0) for x, y in ("ab", "bc", "cd")], EDGE)
    got = {r.header: r.cov[0] for r in co.propagate(seqs, edges).collect()}
    assert got == {"a": 1, "b": 2, "c": 3, "d": 1}
    got = {r.header: r.cov[0] for r in co.propagate(seqs, edges, stop_on_equal=False).collect()}
    assert got["d"] == 4


def test_cycles_do_nothing(spark):
    seqs = sequences(spark, a=[1.0], b=[1.0])
    edges = spark.createDataFrame([("a", "b", 0, 1, 0, 1, 0), ("b", "a", 0, 1, 0, 1, 0)], EDGE)
    assert {r.cov[0] for r in co.propagate(seqs, edges).collect()} == {1.0}


def test_coverage_against_brute_force(spark):
    """Spans that are empty, cut, lengthened, turned round or beyond either end, base by base."""
    rng = random.Random(3)
    cov = {f"s{i}": [float(rng.choice([1, 1, 1, 2, 99])) for _ in range(rng.randint(1, 60))] for i in range(30)}
    edges = []
    for i in range(15):
        for j in rng.sample(range(15, 30), rng.randint(1, 3)):
            a, b = f"s{i}", f"s{j}"
            cs, os_ = rng.randint(0, len(cov[a])), rng.randint(0, len(cov[b]))
            edges.append((a, b, cs, rng.randint(cs, len(cov[a]) + 3), os_, rng.randint(os_, len(cov[b]) + 5), rng.randint(0, 1)))
    shares = Counter(e[0] for e in edges)
    want = {k: list(v) for k, v in cov.items()}
    for a, b, cs, ce, os_, oe, rev in edges:
        span, olen = cov[a][cs:ce], oe - os_
        span = span[:olen] if ce - cs > olen else span + span[-1:] * (olen - ce + cs)
        for i, x in enumerate(span[::-1] if rev else span):
            if os_ + i < len(want[b]):
                want[b][os_ + i] += x / shares[a]
    pool = spark.createDataFrame([(k, v, [k]) for k, v in cov.items()], "header string, cov array<double>, atoms array<string>")
    got = {r.header: r.cov for r in co.apply_level(pool, spark.createDataFrame(edges, EDGE)).collect()}
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == pytest.approx([min(x, 100.0) for x in v])


def test_coverage_is_clipped(spark):
    got = co.propagate(sequences(spark, a=[80.0], b=[70.0]), spark.createDataFrame([("a", "b", 0, 1, 0, 1, 0)], EDGE))
    assert got.filter("header = 'b'").first().cov == [100.0]


def test_islands_are_longer_than_asked(spark):
    rows = [("t", 1000, 0, 100), ("t", 1000, 200, 301)]
    depth = co.depth(spark.createDataFrame(rows, "target string, tlen long, tstart long, tend long"))
    assert [(r.start, r.end) for r in co.islands(depth, 1).collect()] == [(200, 301)]
    assert co.depth_limit(depth).first().limit == 3.0


def test_merge_layout(spark):
    layout = spark.createDataFrame([("u", 7, False, 0, 0, 0, "a", 2), ("u", 7, False, 1, 2, 1, "b", -1)], "unitig string, length long, circ boolean, idx int, pos long, rev int, name string, n long")
    got = co.merge_layout(layout, sequences(spark, a=[1.0, 2, 3], b=[4.0, 5, 6, 7, 8])).first()
    assert got.cov == [1, 2, 8, 7, 6, 5, 4]


def test_trim(spark):
    seqs = spark.createDataFrame([("a", "ACGTACGT", [float(i) for i in range(8)])], "header string, seq string, cov array<double>")
    got = co.trim(seqs, spark.createDataFrame([("a", 5, None)], "sid string, trim_start long, trim_stop long")).first()
    assert (got.header, got.seq, got.cov) == ("a%", "ACGTA", [0, 1, 2, 3, 4])


def test_reverse_complement_and_kmers(spark):
    df = spark.createDataFrame([("a", "ATGCN")], "header string, seq string")
    assert df.select(dna.reverse_complement(F.col("seq")).alias("r")).first().r == "NGCAT"
    # ATGCNNGCAT with N as T, windows of two, the last two left out.
    got = {r.kmer: r.n for r in dna.kmer_rows(df, 2).collect() if r.n}
    assert got == {"AT": 1, "TG": 2, "GC": 2, "CT": 1, "TT": 1}


def test_tetramer_distance_without_shared_kmers(spark):
    """Counts that are zero wherever both have k-mers have no shares there; reads without k-mers have no distance."""
    counts = [(1, [3, 1], [0, 0, 5]), (2, [3, 1], [3, 1]), (3, [], [2]), (4, [], [])]
    got = dict(spark.createDataFrame(counts, "i int, a array<long>, b array<long>").select("i", dna.tetramer_distance(F.col("a"), F.col("b"))).collect())
    assert got == {1: pytest.approx((0.75**2 + 0.25**2) ** 0.5), 2: 0.0, 3: None, 4: None}
    reads = spark.createDataFrame([("a", "T" * 40), ("b", "A" * 9 + "C" * 9), ("c", ""), ("d", None)], "header string, seq string")
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "c")], "qname string, tname string")
    assert dna.intra_pairs(pairs, reads).collect() == []


def test_live_decision(spark):
    reads = spark.createDataFrame([("a", "ACG"), ("b", "ACG"), ("c", ""), ("d", "ACG"), ("e", "A")], "read_id string, seq string")
    hits = spark.createDataFrame([("a", "k", 150, 0), ("b", "k", 50, 0), ("d", "k", 150, 0), ("d", "k", 50, 0)], "read_id string, contig string, r_pos long, strand int")
    mask = spark.createDataFrame([("k", 0, 0, True), ("k", 1, 0, False)], "contig string, bin long, strand int, accept boolean")
    got = {r.read_id: r.decision for r in de.live_decisions(reads, hits, mask).collect()}
    assert got == {"a": "single_off", "b": "single_on", "c": "no_seq", "d": "multi_on", "e": "no_map"}


def test_simulated_lookup_needs_the_mask(spark):
    hits = spark.createDataFrame([("r", "x", 0, 10, 0)], "qname string, tname string, tstart long, tend long, rev int")
    with pytest.raises(Exception, match="no mask"):
        de.simulated(hits, spark.createDataFrame([], "contig string, bin long, strand int, accept boolean")).collect()


def random_genome(n, seed=3):
    import random

    return "".join(random.Random(seed).choices("ACGT", k=n))


def test_overlaps_of_simulated_reads(spark):
    genome = random_genome(20_000)
    other = genome[6000:14_000][::-1].translate(str.maketrans("ACGT", "TGCA"))
    reads = spark.createDataFrame([("a", genome[:10_000]), ("b", other), ("z", random_genome(5000, 9))], "id string, seq string")
    got = ov.all_against_all(reads).collect()
    assert [(r.qname, r.tname, r.rev) for r in got] == [("a", "b", 1)]
    assert abs(got[0].qstart - 6000) < 100 and abs(got[0].qend - 10_000) < 100 and abs(got[0].tstart - 4000) < 100


def test_overlaps_of_many_copies(spark):
    """A passage that more than 50 reads share, and no other, still gives each pair its overlap."""
    passage = random_genome(600)
    reads = [(f"r{i:02d}", random_genome(100, 100 + i) + passage) for i in range(60)]
    got = ov.all_against_all(spark.createDataFrame(reads, "id string, seq string")).select("qname", "tname").collect()
    assert len(got) == 60 * 59 // 2 == len(set(got))


def sides(*reads):
    """Queries and targets of ``reads`` as the kernel of overlaps takes them."""
    found = [ov.minimizers(x) for x in reads]
    rows = sorted((h, i, s, p) for i, f in enumerate(found) for h, p, s in zip(*(x.tolist() for x in f), strict=True))
    h, owner, strand, pos = (np.array(x) for x in zip(*rows, strict=True))
    return ov._Side([f"r{i}" for i in range(len(reads))], np.array([len(x) for x in reads]), h, owner, (pos << 1 | strand).astype(np.uint32))


def test_anchors_of_repeats_are_counted_by_runs(monkeypatch):
    """A repeat within reads gives the bands that anchors one by one give, from a small part of their number."""
    turn = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    unit, flank = random_genome(7, 5), random_genome(900, 6)
    side = sides(flank + unit * 700, turn(unit * 800) + flank, unit * 3 + flank[:400] + unit * 500)
    found = [ov.minimizers(x) for x in (flank + unit * 700, turn(unit * 800) + flank, unit * 3 + flank[:400] + unit * 500)]
    want, anchors = {}, 0
    for x in range(3):
        for y in range(x + 1, 3):
            (h, p, s), (g, r, u) = found[x], found[y]
            i, j = np.nonzero(h[:, None] == g[None, :])
            anchors += len(i)
            for a, b, rev in zip(p[i].tolist(), r[j].tolist(), (s[i] != u[j]).tolist(), strict=True):
                key = (x, y, int(rev), (a + b if rev else a - b) // ov.BAND)
                n, q0, q1, t0, t1 = want.get(key, (0, a, a, b, b))
                want[key] = (n + 1, min(q0, a), max(q1, a), min(t0, b), max(t1, b))
    spread, made = ov._spread, []

    def counted(counts):
        out = spread(counts)
        made.append(len(out[0]))
        return out

    monkeypatch.setattr(ov, "_spread", counted)
    key, *sums = ov._bands(side, side, np.arange(3), np.full(3, -1))
    pair = key >> 24
    names = zip((pair // 6).tolist(), (pair // 2 % 3).tolist(), (pair % 2).tolist(), ((key & (1 << 24) - 1) - (1 << 23)).tolist(), strict=True)
    assert dict(zip(names, zip(*(x.tolist() for x in sums), strict=True), strict=True)) == want
    assert sum(made) < anchors / 10


def test_overlaps_in_several_blocks(spark, monkeypatch):
    """Blocks of one part each, to which parts of earlier ids aren't sent, give the overlaps that one block gives."""
    genome = random_genome(30_000, 8)
    reads = spark.createDataFrame([(f"r{i:02d}", genome[i * 1000 : i * 1000 + 5000]) for i in range(25)], "id string, seq string")
    whole = sorted(ov.all_against_all(reads).collect())
    pairs = {(r.qname, r.tname) for r in whole}
    assert {(f"r{i:02d}", f"r{j:02d}") for i in range(25) for j in range(i + 1, min(i + 5, 25))} <= pairs and all(a < b for a, b in pairs)
    monkeypatch.setattr(ov, "BLOCK", 1)
    assert sorted(ov.all_against_all(reads).collect()) == whole


def test_reads_mapped_on_targets_that_are_written_only_for_several_blocks(spark, monkeypatch):
    """One block of queries meets the targets' sketch as it is made; several blocks give the same alignments."""
    made = []
    monkeypatch.setattr(ov, "written", lambda parts, f=ov.written: made.append(1) or f(parts))
    genome = random_genome(30_000, 8)
    contigs = spark.createDataFrame([(f"c{i}", genome[i * 5000 : i * 5000 + 5500]) for i in range(6)], "id string, seq string")
    reads = spark.createDataFrame([(f"r{i:02d}", genome[i * 1500 : i * 1500 + 400]) for i in range(20)], "id string, seq string").repartition(4)
    one = sorted(ov.map_reads(reads, contigs).collect())
    assert len(made) == 1 and {(f"r{i:02d}", f"c{i * 1500 // 5000}") for i in range(20) if i * 1500 % 5000 <= 4500} <= {(r.qname, r.tname) for r in one}
    monkeypatch.setattr(ov, "BLOCK", 1)
    assert sorted(ov.map_reads(reads, contigs).collect()) == one and len(made) == 3


def test_incremental_overlaps_are_those_of_all_without_the_pool_s_own(spark):
    genome = random_genome(30_000, 8)
    reads = spark.createDataFrame([(f"r{i:02d}", genome[i * 1000 : i * 1000 + 5000]) for i in range(25)], "id string, seq string").withColumn("new", F.xxhash64("id") % 3 == 0)
    new, pool = reads.filter("new").drop("new"), reads.filter("not new").drop("new")
    fresh = {r.id for r in new.collect()}
    both = {frozenset((r.qname, r.tname)) for r in ov.all_against_all(reads.drop("new")).collect()}
    got = [(r.qname, r.tname) for r in ov.incremental(new, pool).collect()]
    assert all(q in fresh for q, _ in got) and len({frozenset(x) for x in got}) == len(got)
    assert {frozenset(x) for x in got} == {x for x in both if x & fresh}


def test_only_what_meets_new_reads_is_written_of_the_pool_s_sketch(spark, monkeypatch):
    """Blocks of one part each, so the pool's sketch is written: without minimizers that no new read has, and with the alignments that the whole sketch gives."""
    genome, other, made = random_genome(30_000, 8), random_genome(200_000, 11), []
    rows = [(f"r{i:02d}", genome[i * 1000 : i * 1000 + 5000]) for i in range(25)] + [(f"x{i:02d}", other[i * 5000 : i * 5000 + 5000]) for i in range(40)]
    reads = spark.createDataFrame(rows, "id string, seq string").repartition(4)
    new, pool = reads.filter("id in ('r03', 'r11', 'r12')"), reads.filter("id not in ('r03', 'r11', 'r12')")
    monkeypatch.setattr(ov, "BLOCK", 1)
    fresh = ov.written(ov.sketch(ov._by_id(new)))
    whole = sorted(ov.alignments(fresh, fresh, within=True).unionByName(ov.alignments(fresh, ov.sketch(pool))).collect())
    kept = ov.written
    monkeypatch.setattr(ov, "written", lambda parts: made.append(kept(parts)) or made[-1])
    monkeypatch.setattr(ov, "discard", lambda table: None)
    assert sorted(ov.incremental(new, pool).collect()) == whole and len(whole) > 10
    met = np.unique(np.concatenate([np.frombuffer(x.h, dtype=np.int64) for x in made[0].collect()]))
    held = np.concatenate([np.frombuffer(x.h, dtype=np.int64) for x in made[1].collect()])
    all_ = sum(x.n for x in ov.sketch(pool).collect())
    assert len(made) == 2 and np.isin(held, met).mean() > 0.5 and 0 < len(held) < all_ / 3


def documents(spark, folder, texts):
    """A folder of tables whose only one is ``documents``, of texts by id that give these bases."""
    rows = [(i, x and x.translate(str.maketrans("ACGT", "abcd"))) for i, x in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_reads_of_any_length_have_overlaps(spark, tmp_path):
    """Reads of 300 and 700 bases, and one with few, are read; those that share a passage of 200 bases overlap."""
    passage = random_genome(200, 21)
    texts = {20: passage + random_genome(100, 22), 1: random_genome(500, 23) + passage, 2: random_genome(400, 24), 3: "ACGT", 4: None}
    at = documents(spark, tmp_path, texts)
    assert {r.id for r in queries._dna(spark, at).collect()} == {"20", "1", "2", "3", "4"}
    assert {(r.qname, r.tname) for r in queries.overlaps_incremental(spark, at).collect()} == {("20", "1")}


def test_links_of_the_kernel_are_its_alignments(monkeypatch):
    """With few counters and small slices too, for repeats near each other and far apart, turned reads, copies and pairs that meet by chance."""
    turn = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    unit, genome = random_genome(60, 31), random_genome(6000, 32)
    reads = [genome[i * 500 : i * 500 + 1500] for i in range(9)] + [turn(genome[2000:3500]), genome[:1500], random_genome(1500, 33)]
    reads += [unit[:7] * 300, unit[:7] * 200 + genome[:300], turn(unit[:7] * 90), unit[:30], random_genome(700, 34) + unit[:30], "ACGT" * 300]
    reads += ["".join(random_genome(k, 40 + i) + unit[:20] for i in range(6)) for k in (30, 600, 900)]
    reads += ["".join(random.Random(i).choices(("ACCTGATTACAGG", "TTGACCATAGAC", "GGATCCATTAGCA", "CATGCATTACGAA"), k=60)) for i in range(8)]
    side = sides(*reads)
    side = ov._Side([f"r{i:02d}" for i in range(len(reads))], side.lens, np.repeat(np.repeat(side.h, side.groups), side.size), np.repeat(side.owner, side.size), (side.pos << 1 | np.repeat(side.strand, side.size)).astype(np.uint32))
    found = ov._chained(side, side, 4, True)
    want = set(zip(found.column("qname").to_pylist(), found.column("tname").to_pylist(), strict=True))
    assert 60 < len(want) < len(reads) * (len(reads) - 1) // 2
    for counters, slice_ in ((22, 1 << 20), (3, 1 << 20), (22, 50)):
        monkeypatch.setattr(ov, "COUNTERS", counters)
        monkeypatch.setattr(ov, "SLICE", slice_)
        assert {(side.ids[x], side.ids[y]) for x, y in zip(*np.nonzero(ov._links(side, side, 4)), strict=True)} == want


def test_overlaps_of_all_are_counted_for_each_read(spark, tmp_path, monkeypatch):
    """One row for each read, with its class and the number of reads that all pairs' alignments give, in one block and in several."""
    genome = random_genome(12_000, 35)
    texts = {i: genome[i * 500 : i * 500 + 1500] for i in range(20)} | {30: genome[:1500], 31: genome[:1500], 32: "ACGT", 33: None, 34: random_genome(2000, 36)}
    at = documents(spark, tmp_path, texts)
    partners = {str(i): set() for i in texts}
    for r in ov.all_against_all(queries._dna(spark, at)).collect():
        partners[r.qname].add(r.tname)
        partners[r.tname].add(r.qname)
    want = sorted((i, {"30": "0", "31": "0"}.get(i, i), len(x)) for i, x in partners.items())
    assert sorted(map(tuple, queries.overlaps_all_against_all(spark, at).collect())) == want and sum(x[2] for x in want) > 60
    monkeypatch.setattr(ov, "LINKS_BLOCK", 1)
    assert sorted(map(tuple, queries.overlaps_all_against_all(spark, at).collect())) == want


def test_reads_are_mapped_whole(spark, tmp_path):
    """A passage after the first 400 bases, and a target of 300 bases, are found."""
    passage = random_genome(200, 21)
    at = documents(spark, tmp_path, {20: random_genome(3000, 25) + passage, 1: random_genome(100, 26) + passage, 2: random_genome(3000, 27)})
    found = queries.read_mapping(spark, at).filter("s1 > 50").collect()
    assert [(r.qname, r.tname, r.qstart > 2900, r.tstart > 50) for r in found] == [("20", "1", True, True)]


def test_unitig_of_three_reads(spark):
    genome = random_genome(20_000)
    turn = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    seqs = {"a": genome[:9000], "b": turn(genome[5000:14_000]), "c": genome[10_000:20_000]}
    frame = spark.createDataFrame(list(seqs.items()), "header string, seq string")
    found = ov.all_against_all(frame.withColumnRenamed("header", "id")).withColumn("line_no", F.monotonically_increasing_id())
    linked = li.links(al.with_class(found.filter(al.passes())))
    placed = un.layout(linked.filter("u < v"), frame.select("header", F.length("seq").cast("long").alias("length")))
    whole = un.assembled(placed, frame).collect()
    assert len(whole) == 1
    assert whole[0].seq in (genome, turn(genome))


def test_doubling_ends_with_the_longest_path(spark, monkeypatch):
    """Many paths of 1 to 9 joints and rings of 5 and 12 are placed whole; rounds go by the longest of them, not by the number of reads."""
    made = []
    monkeypatch.setattr(un, "materialize", lambda df, name, f=un.materialize: made.append(name) or f(df, name))
    rows, want = [], {}
    for p in range(60):
        size = p % 9 + 2
        want[f"p{p:02d}.00"] = [(False, i, f"p{p:02d}.{i:02d}") for i in range(size)]
        rows += [(f"p{p:02d}.{i:02d}", "R", f"p{p:02d}.{i + 1:02d}", "L") for i in range(size - 1)]
    for r, size in (("x", 5), ("y", 12)):
        want[f"{r}.00"] = [(True, i, f"{r}.{i:02d}") for i in range(size)]
        rows += [(f"{r}.{i:02d}", "R", f"{r}.{(i + 1) % size:02d}", "L") for i in range(size)]
    links = spark.createDataFrame([(*row, 5000, 3000, 5000, 5000, 0, 2000) for row in rows], "qname string, qside string, tname string, tside string, qlen long, qstart long, qend long, tlen long, tstart long, tend long")
    names = sorted({row[i] for row in rows for i in (0, 2)})
    got = {}
    for r in un.layout(links, spark.createDataFrame([(n, 5000) for n in names], "header string, length long")).orderBy("unitig", "idx").collect():
        got.setdefault(r.unitig, []).append((r.circ, r.idx, r.name))
    assert got == want
    assert made.count("jump") <= 6 < len(names).bit_length()
