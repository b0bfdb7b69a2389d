"""WARC archives and vectors against brute force, and the registered queries on the smallest data."""

import hashlib
import os
import time
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.llm import queries, vector_dedup, warc
from strandlake.llm.common import fresh_path

SF = "/root/testdata/sf0.001"


def test_warc_round_trip(spark):
    body = "x" * 150
    rows = [(5, "http://a b/\r\n", body), (3, None, body), (None, "u", body), (7, "u", ""), (8, "u", None), (9, "u", "é" * 60), (9, "u", "é" * 60), (10, "u", "short"), (11, "u", "short"), (12, "u", "y\r\n\r\nWARC/1.1\r\n" * 20), (3, "v", body), (None, "u", "n" * 200), (None, "u", "n" * 200), (13, "u", "long " * 400_000)]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, digest string")
    got = warc.round_trip(pages, fresh_path(spark, "warc")).collect()

    first = {}
    for i, _, html in rows:
        if i is not None and len((html or "").encode()) >= 100:
            first[html] = min(i, first.get(html, i))
    seen = set()

    def want(i, html):
        data, least = (html or "").encode(), first.get(html)
        # Of the rows with the smallest page_id one is the response.
        refers = None if least is None or (i == least and html not in seen) else least
        if i is not None and i == least:
            seen.add(html)
        return (i, len(data), hashlib.sha256(data).hexdigest(), "response" if refers is None else "revisit", refers)

    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == Counter(want(i, h) for i, _, h in rows)
    assert warc.round_trip(pages.limit(0), fresh_path(spark, "warc")).count() == 0


def test_salvage():
    blocks = [warc.record(i, "u", b"payload %d" % i * 30, hashlib.sha256(b"payload %d" % i * 30).hexdigest(), None) for i in range(6)]
    members = [warc.member(b) for b in blocks]
    ids = lambda data: [warc.page_of(x.headers["warc-record-id"]) if isinstance(x, warc.Record) else (x.offset, x.length) for x in warc.salvage(data)]
    whole = b"".join(members)
    assert ids(whole) == list(range(6))
    at = len(members[0]) + len(members[1])
    hurt = bytearray(whole)
    hurt[at + 60] ^= 0xFF
    assert ids(bytes(hurt)) == [0, 1, (at, len(members[2])), 3, 4, 5]
    assert ids(b"rubbish" + whole) == [(0, 7), 0, 1, 2, 3, 4, 5]
    assert ids(whole[:-3])[-1] == (len(whole) - len(members[5]), len(members[5]) - 3)
    plain = bytearray(b"".join(blocks))
    plain[len(blocks[0]) + len(blocks[1]) - 20] ^= 1
    assert ids(bytes(plain)) == [0, (len(blocks[0]), len(blocks[1])), 2, 3, 4, 5]
    assert ids(b"") == [] and ids(b"no archive") == [(0, 10)]


def test_salvage_inside_members_and_of_first_lines():
    one = lambda i, more=b"": warc.record(i, "u", b"payload %d" % i * 30 + more, hashlib.sha256(b"payload %d" % i * 30 + more).hexdigest(), None)
    ids = lambda data: [warc.page_of(x.headers["warc-record-id"]) if isinstance(x, warc.Record) else (x.offset, x.length) for x in warc.salvage(data)]
    blocks = [one(i) for i in range(5)]
    bad = bytearray(blocks[3])
    bad[-20] ^= 1
    assert ids(warc.member(b"".join([*blocks[:3], bytes(bad), blocks[4]])) + warc.member(one(9))) == [0, 1, 2, (0, len(blocks[3])), 4, 9]
    plain = [one(i, warc.member(b"other")) for i in range(5)]
    first = bytearray(b"".join(plain))
    first[0] ^= 1
    assert ids(bytes(first)) == [(0, len(plain[0])), 1, 2, 3, 4]
    assert ids(one(0) + warc.member(one(1)) + one(2)) == [0, 1, 2]
    assert ids(warc.member(b"no record") + warc.member(one(1)))[1] == 1
    # Fields that aren't numbers are no reason to fail.
    assert ids(one(0).replace(b"X-Payload-Length: 270", b"X-Payload-Length: many")) == [0]


def test_salvage_takes_time_in_proportion():
    def took(n):
        data = b"".join(warc.member(warc.record(i, "u", bytes(np.random.default_rng(i).integers(0, 256, 2000, dtype=np.uint8)), "", None)) for i in range(n))
        began = time.perf_counter()
        assert sum(1 for _ in warc.salvage(data)) == n
        return (time.perf_counter() - began) / n

    took(200)
    assert took(16_000) < 4 * min(took(1000), took(1000))


def test_salvage_from_files(spark, tmp_path):
    members = [warc.member(warc.record(i, "u", b"p" * 200, hashlib.sha256(b"p" * 200).hexdigest(), None)) for i in range(3)]
    (tmp_path / "a.warc.gz").write_bytes(members[0] + b"???" + members[1] + members[2][:40])
    rows = warc.read(spark, str(tmp_path), payloads=True).orderBy("offset").collect()
    assert [(r.record_type, r.gap_bytes) for r in rows] == [("response", None), ("quarantined", 3), ("response", None), ("quarantined", 40)]
    assert bytes(rows[0].payload) == b"p" * 200


def test_vectors_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "PART", 16)
    rng = np.random.default_rng(3)
    base = rng.standard_normal((150, 64))
    near = base[:40] + 0.2 * rng.standard_normal((40, 64))
    hot = base[0] + 0.05 * rng.standard_normal((60, 64))
    x = np.concatenate([base, near, hot, base[:5]]).astype(np.float32)
    rows = [(i, v.tolist(), 1, "c") for i, v in enumerate(x)]
    odd = [(900, None), (901, [0.0] * 64), (902, [float("nan")] * 64), (903, [None] * 64), (904, [float("inf")] * 64), (905, []), (None, x[3].tolist()), (906, [1.0, 2.0]), (907, [2.0, 4.0])]
    table = spark.createDataFrame(rows + [(i, v, 0, "c") for i, v in odd], "vec_id long, embedding array<float>, label int, class string")
    got = {r.vec_id: r for r in vector_dedup.near_duplicates(table).collect()}
    assert len(got) == len(rows) + len(odd)
    ids = [*range(len(x)), None]
    unit = np.concatenate([x, x[3:4]]).astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    link = unit @ unit.T >= 0.9
    np.fill_diagonal(link, False)
    group = list(range(len(unit)))
    for _ in range(6):
        for i, j in zip(*np.nonzero(link), strict=True):
            group[i] = group[j] = min(group[i], group[j])
    for i, name in enumerate(ids):
        if name is not None:
            assert got[name].n_links == link[i].sum(), name
            assert got[name].component_id == group[i]
            assert got[name].kept == (group[i] == name)
    for i in (900, 901, 902, 903, 904, 905):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert (got[906].n_links, got[907].component_id) == (1, 906)
    assert vector_dedup.near_duplicates(table.limit(0)).count() == 0


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(5)
    unit = rng.standard_normal((400, 64))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    rows = vector_dedup.coded(unit)
    f = rows.f
    error = vector_dedup.estimates(rows, rows.take(np.arange(200))) - unit[:200] @ unit.T
    off = ~np.eye(400, dtype=bool)[:200]
    assert abs(error[off].mean()) < 0.005
    slack = vector_dedup.EPS * np.sqrt((1 - f * f) / (f * f) / 63)
    assert (np.abs(error) > slack[None, :])[off].mean() < 0.002


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_registered_query(spark, name):
    df = queries.QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    assert rows
    if name in queries.ORACLES:
        con = duckdb.connect()
        for t in ("documents", "pages"):
            con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
        cursor = con.execute(queries.ORACLES[name])
        order = [[d[0] for d in cursor.description].index(c) for c in df.columns]
        assert sorted(rows, key=repr) == sorted((tuple(r[i] for i in order) for r in cursor.fetchall()), key=repr)


def test_pipeline(spark):
    import corpus_pipeline

    data = spark.read.parquet(f"{SF}/documents.parquet")
    kept = data
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SF)
        assert kept.columns == data.columns
        kept = spark.createDataFrame(kept.collect(), data.schema)
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in kept.select("doc_id").collect()}
    assert all(r.n_chars == len(r.text) for r in kept.select("text", "n_chars").collect())
    assert kept.filter(F.col("text").rlike(r"AKIA[A-Z0-9]{16}")).count() == 0


def test_stages_delete_what_the_one_before_left(spark, tmp_path):
    """The tables behind a written result go when the next stage begins; those that its documents still read stay."""
    import corpus_pipeline
    from strandlake.llm.common import fresh_path

    left = lambda: {p.rsplit("-", 1)[0].rsplit("/", 1)[-1] for p in corpus_pipeline._MADE[spark.sparkContext.applicationId] if os.path.exists(p.removeprefix("file://"))}
    data = spark.read.parquet(f"{SF}/documents.parquet")
    lazy = corpus_pipeline.keep_quality(spark, data, SF)
    path = fresh_path(spark, "kept")
    lazy.write.parquet(path)
    assert "measured" in left()
    corpus_pipeline.redact_secrets(spark, lazy, SF)
    assert "measured" in left()
    corpus_pipeline.redact_secrets(spark, spark.read.parquet(path), SF)
    assert "measured" not in left()
