import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from adit.llm import kernels, merkle, mixing, resample
from adit.llm.store import running

ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def grams(text):
    w = re.findall(ALNUM, low(text))
    return [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(w) - k + 1)], len(w)


# --- running sums -------------------------------------------------------------------------------------------


def test_running_numbers_and_sums_over_a_hot_group(spark):
    rows = [("a" if k % 3 else None if k % 2 else "b", k * 37 % 101, k, k % 7) for k in range(700)]
    df = spark.createDataFrame(rows, "g string, x long, place long, n long").repartition(5)
    got = {r.place: (r.i, r.total, r.x) for r in running(df, ["g"], ["x", "place"], "i", total="total").collect()}
    sums = {r.place: (r["sum"], r.whole) for r in running(df, ["g"], ["x", "place"], "sum", "n", "whole").collect()}
    for g in ("a", "b", None):
        group = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2]))
        total = 0
        for i, r in enumerate(group):
            assert got[r[2]] == (i, len(group), r[1]) and sums[r[2]] == (total, sum(x[3] for x in group))
            total += r[3]


# --- importance resampling ----------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aZ9é \n-ß漢_", max_size=60) | st.integers(55, 140).map(lambda n: "x" * n + " y " + "Q" * n), max_size=8))
def test_features_are_checksums_of_word_runs(texts):
    data, offs = kernels.text_buffers(pa.array(texts, pa.string()))
    bucket, first, n = resample.features(data, offs)
    for k, t in enumerate(texts):
        assert (sorted(bucket[first[k] : first[k + 1]]), n[k]) == (sorted(grams(t)[0]), grams(t)[1])


def test_checksums_of_any_length():
    raw = np.frombuffer(np.random.default_rng(1).bytes(5000), np.uint8)
    start = np.arange(0, 2000)
    end = start + np.arange(2000) % 300
    want = [zlib.crc32(bytes(b + 32 if 65 <= b <= 90 else b for b in raw[a:b].tolist())) for a, b in zip(start, end)]
    assert resample.checksums(raw, start, end).tolist() == want


def test_resampling_against_plain_python(spark, docs, empty):
    target = spark.createDataFrame([(1, "alpha beta gamma word"), (2, None), (3, "delta x1 42 " * 9)], "item_id long, text string")
    rows = resample.resample(docs, target, percent=30, min_words=3).collect()
    texts = [r.text for r in docs.collect()]
    s, t = np.zeros(10_000), np.zeros(10_000)
    for side, some in ((s, texts), (t, [r.text for r in target.collect()])):
        for x in some:
            np.add.at(side, grams(x)[0], 1)
    gain = np.floor(1000 * np.log((t + 1) * (s.sum() + 10_000) / ((s + 1) * (t.sum() + 10_000))))
    assert len(rows) == len(texts)
    able = []
    for r in rows:
        f, n = grams(r.text)
        h = int(sha(f"42:{'' if r.doc_id is None else r.doc_id}")[:8], 16)
        noise = math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        assert (r.n_words, r.n_features, r.weight, r.score) == (n, len(f), int(gain[f].sum()), int(gain[f].sum()) + noise)
        if n >= 3:
            able.append((-r.score, r.doc_id is None, r.doc_id, r["rank"]))
        else:
            assert r["rank"] is None
    able.sort(key=lambda x: (x[0], x[1], x[2] or 0, x[3] or 1 << 60))
    most = 30 * len(able) // 100
    assert [x[3] for x in able] == [*range(1, most + 1), *[None] * (len(able) - most)]
    assert {"__tk", "label", "lang"} <= set(rows[0].asDict())
    assert resample.resample(empty, target).count() == 0
    assert all(r["rank"] is None for r in resample.resample(docs, target.limit(0), percent=1, min_words=10_000_000).collect())


def test_draw_with_ties_and_clashing_columns(spark):
    rows = spark.createDataFrame([(k % 50, 20, 0, 9, 1, 2) for k in range(400)], "doc_id long, n_words long, weight long, Score long, RANK int, place long")
    out = resample.drawn(rows, percent=25).collect()
    ranks = sorted(r["rank"] for r in out if r["rank"])
    assert len(out) == 400 and ranks == list(range(1, 101))
    best = sorted(((-r.score, r.doc_id) for r in out))[:100]
    assert sorted((-r.score, r.doc_id) for r in out if r["rank"]) == best


# --- mixing -------------------------------------------------------------------------------------------------


def least_cost(capacity, members, quota, repeats):
    """(tokens, cost) by trying all small flows."""
    links = [(p, s) for p, m in enumerate(members) for s in m]
    best = (0, 0)
    for x in itertools.product(*[range(min(capacity[p] * repeats, quota[s]) + 1) for p, s in links]):
        used, into = [0] * len(capacity), [0] * len(quota)
        for (p, s), v in zip(links, x):
            used[p] += v
            into[s] += v
        if all(u <= c * repeats for u, c in zip(used, capacity)) and all(i <= q for i, q in zip(into, quota)):
            best = max(best, (sum(x), -sum(cost(u, c) for u, c in zip(used, capacity))))
    return best


def cost(used, capacity):
    return sum(2 * (k // capacity) + 1 for k in range(used))


@settings(max_examples=25, deadline=None)
@given(st.data())
def test_flow_is_largest_and_cheapest(data):
    n_s = data.draw(st.integers(1, 2))
    members = data.draw(st.lists(st.lists(st.integers(0, n_s - 1), min_size=1, max_size=2, unique=True), min_size=1, max_size=2))
    capacity = [data.draw(st.integers(1, 3)) for _ in members]
    quota = [data.draw(st.integers(0, 4)) for _ in range(n_s)]
    found = mixing.flow(capacity, members, quota, 2)
    used = [sum(x.values()) for x in found]
    into = [sum(x.get(s, 0) for x in found) for s in range(n_s)]
    assert all(set(x) <= set(m) for x, m in zip(found, members)) and all(i <= q for i, q in zip(into, quota))
    assert (sum(used), -sum(cost(u, c) for u, c in zip(used, capacity))) == least_cost(capacity, members, quota, 2)


def test_overlapping_sources_meet_their_quotas(spark):
    rows = [(k, " ".join(["w"] * (1 + k * 7 % 13)), ["a"] if k % 4 == 0 else ["b", "a"] if k % 4 == 1 else ["b"] if k % 4 == 2 else ["c", None]) for k in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source array<string>").repartition(3)
    weights = spark.createDataFrame([("a", 1.0), ("b", 5.0), ("c", 1.0), (None, 0.5)], "source string, weight double")
    out, sources = mixing.mix(docs, weights, share=1.2)
    out, sources = out.collect(), {r.source: r for r in sources.collect()}
    total = sum(len(r[1].split()) for r in rows)
    assert abs(sum(s.target for s in sources.values()) - 1.2 * total) < 1 and all(s.target <= 2 * s["size"] + 1e-9 for s in sources.values())
    assert all(0 <= r.copies <= 2 and r.taken == r.size * r.copies for r in out) and len(out) == 800
    # "b" wants more than its own documents give once; what both share goes to it before anything is taken twice
    by = lambda f: sum(r.taken for r in out if f(set(r.source)))
    assert abs(by(lambda s: s <= {"a", "b"}) - sources["a"].target - sources["b"].target) <= 15
    assert abs(by(lambda s: s <= {"c", None}) - sources["c"].target - sources[None].target) <= 15


def test_targets_share_what_is_above_the_bound(spark):
    sizes = {"a": 10, "b": 400, "c": 30, "d": 1000, None: 5, "e": 0}
    sources = mixing.cycled(spark.createDataFrame(list(sizes.items()), "source string, size long"), (3.0, 1.0, 2.0))
    budget = 1.5 * sum(sizes.values())
    got = {r.source: (r.weight, r.target) for r in mixing.quotas(sources, budget, 2).collect()}
    assert {k: v[0] for k, v in got.items()} == {"a": 3, "b": 1, "c": 2, "d": 3, "e": 1, None: 2}
    full = set()
    while True:
        rate = (budget - sum(2 * sizes[s] for s in full)) / sum(got[s][0] for s in sizes if s not in full)
        new = {s for s in sizes if got[s][0] * rate > 2 * sizes[s]}
        if new <= full:
            break
        full |= new
    assert got == {s: (got[s][0], pytest.approx(2 * sizes[s] if s in full else got[s][0] * rate)) for s in sizes}


def test_mixing_of_odd_documents(spark, docs, empty):
    out, sources = mixing.mix(docs.withColumn("size", docs.label), (3.0, 1.0, 2.0))
    out = out.collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted(r.size for r in out) == sorted(size(r.text) for r in docs.collect())
    assert all(r.taken in (0, r.size, 2 * r.size) for r in out)
    target = sources.first().target
    # one document is longer than all others together: no whole document is left that would still fit
    assert abs(target - 1.5 * sum(r.size for r in out)) < 1e-6 and 0 <= target - sum(r.taken for r in out) < min(r.size for r in out if r.size and r.copies == 1)
    again = mixing.mix(docs.repartition(7), (3.0, 1.0, 2.0))[0].collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.size, r.taken)
    assert sorted(map(key, again)) == sorted(map(key, out))
    assert mixing.mix(empty, (1.0,))[0].count() == 0


def test_one_large_group_of_copies(spark):
    docs = spark.createDataFrame([(k if k % 3 else 7, "one two three", "s") for k in range(6000)], "doc_id long, text string, source string").repartition(6)
    out, _ = mixing.mix(docs, (1.0,), share=1.25)
    assert sum(r.taken for r in out.collect()) == 1.25 * 18_000


# --- manifests ----------------------------------------------------------------------------------------------


def tree(hashes, fanout):
    """The last node, and for each leaf the (left, right) of its levels."""
    found, level, at = [[] for _ in hashes], list(hashes), list(range(len(hashes)))
    while len(level) > 1:
        runs = [level[k : k + fanout] for k in range(0, len(level), fanout)]
        for leaf, k in enumerate(at):
            run, j = runs[k // fanout], k % fanout
            found[leaf].append(("".join(run[:j]), "".join(run[j + 1 :])))
        level, at = [sha("".join(r)) for r in runs], [k // fanout for k in at]
    return level[0], found


@pytest.mark.parametrize("fanout", [2, 8])
def test_manifest_against_plain_python(spark, docs, empty, fanout):
    many = docs.union(docs.selectExpr("doc_id + 100", "text", "if(doc_id % 7 = 3, '', if(doc_id % 2 = 0, 'é', lang))", "source", "doc_id", *docs.columns[5:]))
    rows = many.collect()
    said = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaves = [(r.lang, r.doc_id, sha("".join(said(v) for v in (r.doc_id, r.source, r.lang, r.n_chars, r.text)))) for r in rows]
    groups = {}
    for lang, key, h in leaves:
        groups.setdefault(lang, []).append((key is not None, key or 0, h))
    order = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: (sorted(groups[g]), tree([h for *_, h in sorted(groups[g])], fanout)) for g in order}
    root, tops = tree([trees[g][1][0] for g in order], fanout)
    want = sorted((h, trees[g][1][0], root, tuple(path + tops[k])) for k, g in enumerate(order) for (*_, h), path in zip(trees[g][0], trees[g][1][1]))
    found = merkle.manifest(many, fanout)
    got = found.select("*", merkle.folded(found.leaf, found.path).alias("again"), merkle.proof(found.path).alias("proof")).collect()
    assert sorted((r.leaf, r.subroot, r.root, tuple((s.left, s.right) for s in r.path)) for r in got) == want
    assert all(r.again == root and r.proof == sha("".join(s.left + s.right for s in r.path)) for r in got)
    assert merkle.manifest(empty).count() == 0


def test_one_row_and_many_small_groups(spark):
    one = merkle.manifest(spark.createDataFrame([(1, "s", None, 3, "abc")], "doc_id long, source string, lang string, n_chars long, text string")).first()
    assert one.leaf == one.subroot == one.root == sha("1:11:s-1:33:abc") and one.path == []
    rows = spark.createDataFrame([(k, None, f"l{k % 90}", k, "t") for k in range(300)], "doc_id long, source string, lang string, n_chars long, text string")
    out = merkle.manifest(rows).collect()
    assert len({r.subroot for r in out}) == 90 and len({r.root for r in out}) == 1 and {len(r.path) for r in out} == {4}


def test_changed_texts_do_not_verify(spark):
    docs = spark.createDataFrame([(k, "s", "en", 1, "Abc é" if k % 2 else "abc é") for k in range(70)], "doc_id long, source string, lang string, n_chars long, text string")
    told = merkle.leaf([docs.doc_id, docs.source, docs.lang, docs.n_chars, merkle.ascii_lower(docs.text)])
    found = merkle.manifest(docs, keep={"told": told})
    out = found.select("doc_id", (merkle.folded(found.told, found.path) == found.root).alias("ok")).collect()
    assert all(r.ok == (r.doc_id % 2 == 0) for r in out)
