import base64
import gzip
import hashlib
import io

import numpy as np
import pytest

from adit.llm import topk, warc
from adit.llm.store import new_path, written


@pytest.mark.parametrize(("kind", "k"), [("array<float>", 5), ("array<double>", 3)])
def test_top_k(spark, kind, k):
    r = np.random.default_rng(3)
    rows = [(i, [float(x) for x in r.normal(size=6)]) for i in range(400)] + [(i, [0.5] * 6) for i in range(400, 520)]
    rows += [(600, None), (601, []), (602, [1.0, None, 1, 1, 1, 1]), (603, [float("nan")] * 6), (604, [float("inf")] * 6), (650, [1.0, 2.0]), (651, [2.0, 2.0]), (None, [9.0] * 6), (7, [0.1] * 6), (50, [0.25] * 6)]
    frame = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "z") for i, v in rows], f"vec_id long, embedding {kind}, score string").repartition(5)
    vectors = topk.integer_vectors(frame)
    got = {(q, n): (i, s) for q, n, i, s in topk.top_k(vectors, vectors.where("id % 50 = 0"), k, groups=3).collect()}
    cast = np.float32 if kind == "array<float>" else np.float64
    fine = [(i, np.floor(256 * np.array(v, cast).astype(float)).astype(np.int64)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = {}
    for q in sorted({i for i, _ in fine if i % 50 == 0}):
        v = min((x for i, x in fine if i == q), key=lambda x: x.tolist())
        best = sorted(((int(x @ v), i) for i, x in fine if i != q and len(x) == len(v)), key=lambda p: (-p[0], p[1]))[:k]
        want |= {(q, n + 1): (i, s) for n, (s, i) in enumerate(best)}
    assert got == want


def plain_top(x, ids, asked, k):
    """(query id, rank, id, score) by whole numbers; ``asked``: rows of ``x``."""
    out = []
    for r in asked:
        score = x @ x[r]
        best = sorted((-int(score[j]), int(ids[j])) for j in np.flatnonzero(ids != ids[r]))[:k]
        out += [(int(ids[r]), n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def test_top_k_needs_no_broadcast(spark):
    """No table of queries or pairs goes through the driver or stands in one row, however many there are: several chunks, blocks and parts."""
    r = np.random.default_rng(7)
    x = r.normal(size=(10_000, 24))
    x[5000:5400] = x[:400]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    vectors = topk.integer_vectors(frame)
    spark.conf.set("spark.sql.maxBroadcastTableSize", "256k")
    try:
        got = topk.top_k(vectors, vectors.where("id % 2 = 0"), 5, groups=2)
        rows = sorted(map(tuple, got.collect()))
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
    assert len(rows) == 25_000
    whole, ids = np.floor(256 * x).astype(np.int64), np.arange(len(x))
    some = {q for q in range(0, 10_000, 250)} | {2, 5002, 9998}
    assert [q for q in rows if q[0] in some] == plain_top(whole, ids, sorted(some), 5)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    assert topk.packed(vectors, 2).selectExpr("max(length(vectors))").first()[0] <= 8 * topk.ROW


@pytest.mark.parametrize("kind", ["normal", "copies", "few values", "one dimension", "outliers", "middling", "opposite", "short"])
def test_search_chunk(kind):
    r = np.random.default_rng(9)
    n, dim, k = {"short": 3, "copies": 900}.get(kind, 700), 1 if kind == "one dimension" else 7, 5
    x = np.floor(r.normal(size=(n, dim)) * 60)
    if kind == "copies":
        x[r.integers(0, n, 600)] = x[0]
    elif kind == "few values":
        x = np.sign(x)
    elif kind == "outliers":
        x[r.integers(0, n, 9), r.integers(0, dim, 9)] = 1e6
    elif kind == "middling":  # sums beyond the whole numbers that floats or doubles hold
        x = np.floor(x * 2.0**21)
    elif kind == "opposite":
        x = -np.abs(x) * np.where(np.arange(n) % 2, 1, -1)[:, None]
    ids = r.permutation(n) // (2 if kind == "copies" else 1)  # copies: rows that share their ids, too
    best = topk.Best(n, k)
    for part in np.array_split(r.permutation(n), 3):
        topk.search_chunk(topk.chunk_of(ids[part], x[part], k), x, ids, best)
    whole = x.astype(np.int64)
    for row in range(n):
        score = whole @ whole[row]
        want = sorted((-int(score[j]), int(ids[j])) for j in np.flatnonzero(ids != ids[row]))[:k]
        held = best.held[row]
        assert list(zip((-best.score[row, held]).tolist(), best.ids[row, held].tolist())) == want


def test_top_k_empty(spark):
    vectors = topk.integer_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert topk.top_k(vectors, vectors, 5).count() == 0


@pytest.mark.parametrize("least", [0, 5])
def test_warc_round_trip(spark, least):
    pages = [(3, "http://a/\r\nx", "same"), (1, "http://b", "same"), (2, None, ""), (9, "u", None), (5, "u", "é" * 1_500_000), (6, "u", "other"), (7, "ü", "é" * 1_500_000), (None, "n", "same"), (4, "d", "\r\n\r\nWARC/1.1\r\n")]
    frame = spark.createDataFrame([(*p, 1, "x") for p in pages], "page_id long, url string, html string, payload int, digest string").repartition(3)
    files = written(warc.write_archives(warc.with_revisits(frame, least), new_path(spark, "warc"), max_bytes=2000))
    got = {r.page_id: r for r in warc.read_archives(files, keep_payload=True).collect()}
    assert len(got) == len(pages) and all(r.verified for r in got.values())
    first = {}
    for i, _, html in pages:
        if i is not None:
            first[html or ""] = min(first.get(html or "", i), i)
    for i, _, html in pages:
        body = (html or "").encode()
        again = i is not None and len(body) >= least and first[html or ""] != i
        assert got[i].payload_bytes == len(body)
        assert got[i].payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode()
        assert (got[i].record_type, got[i].refers_to) == (("revisit", first[html or ""]) if again else ("response", None))
        assert bytes(got[i].payload) == (b"" if again else body)


def test_warc_faults():
    one, two = warc.record(1, "u", b"abc", None), warc.record(2, None, b"xyz", 1)
    assert [h["warc-type"] for h, *_ in warc.records(io.BytesIO(one + two))] == ["response", "revisit"]
    bad = gzip.compress(gzip.decompress(one).replace(b"abc", b"abd"))
    assert [good for *_, good in warc.records(io.BytesIO(bad + two))] == [False, True]
    assert [(n, d) for _, n, d, *_ in warc.records(io.BytesIO(bad))] == [(3, warc._sha1(b"abd"))]
    with pytest.raises(ValueError, match="ends within"):
        list(warc.records(io.BytesIO(one + two[:-20])))


def test_warc_reads_only_files_that_counted(spark, tmp_path):
    """A second attempt and a damaged left-over change nothing; a damaged file that counts is an error."""
    frame = spark.createDataFrame([(k, "u", f"page {k % 5}") for k in range(40)], "page_id long, url string, html string")
    rows = warc.with_revisits(frame)
    path = f"file://{tmp_path}/w"
    files = written(warc.write_archives(rows, path, max_bytes=500))
    warc.write_archives(rows, path, max_bytes=500).count()
    (tmp_path / "w" / "part-00000-00000-x.warc.gz").write_bytes(b"junk")
    got = warc.read_archives(files).collect()
    assert sorted(r.page_id for r in got) == list(range(40)) and sum(r.record_type == "response" for r in got) == 5
    hurt = tmp_path / "w" / "hurt.warc.gz"
    hurt.write_bytes(gzip.compress(gzip.decompress(warc.record(1, "u", b"abc", None)).replace(b"abc", b"abd")))
    bad = spark.createDataFrame([(f"file://{hurt}",)], "path string")
    assert not warc.read_archives(bad, strict=False).first().verified
    with pytest.raises(Exception, match="don't hold"):
        warc.read_archives(bad).collect()


def test_warc_hot_payload(spark):
    n = 3000
    frame = spark.range(n).selectExpr("id as page_id", "'u' as url", "if(id % 3 = 0, 'same', concat('own ', id div 2)) as html")
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.read_archives(written(warc.write_archives(warc.with_revisits(frame), new_path(spark, "warc")))).collect()}
    first = {}
    for k in range(n):
        first.setdefault("same" if k % 3 == 0 else k // 2, k)
    want = {k: ("response", None) if (f := first["same" if k % 3 == 0 else k // 2]) == k else ("revisit", f) for k in range(n)}
    assert got == want


def test_warc_empty(spark):
    frame = spark.createDataFrame([], "page_id long, url string, html string")
    files = written(warc.write_archives(warc.with_revisits(frame), new_path(spark, "warc")))
    assert warc.read_archives(files).count() == 0
