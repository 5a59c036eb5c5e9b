"""Bounds and exactness: labelled rows whatever their ids, components of any size, words of any length."""

import numpy as np

import public_tokenizers

from adit.llm import bpe, kernels, secrets, topk, toxicity


def test_toxic_sample_is_bounded_by_rows(spark, monkeypatch):
    docs = spark.createDataFrame([(k % 2, f"word{k} fine day") for k in range(6000)] + [(10 + k, "bad awful" if k % 2 else "nice good") for k in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "written", lambda df, name: seen.append((name, df.count())) or df.persist())
    toxicity.fit(docs, labels, most=20)
    assert 0 < dict(seen)["labelled"] <= 20


def best(q, q_id, x, ids, k):
    pairs = [(max(min(sum(int(a) * int(b) for a, b in zip(v, q)), (1 << 63) - 1), -(1 << 63)), i) for v, i in zip(x, ids) if i != q_id]
    return sorted(pairs, key=lambda p: (-p[0], p[1]))[:k]


def test_large_components_are_exact(spark):
    r = np.random.default_rng(4)
    for size in (2**22, 2**26, 2**30, 2**40, 2**62, 2.0**200):
        x = np.floor(r.normal(size=(150, 6)) * size)
        x[:, 3:] = -x[:, :3] + r.integers(-3, 4, (150, 3)) if size < 2**40 else -x[:, :3]  # they cancel
        x[40:80] = x[:40]
        rows = [(i, (v / 256).tolist()) for i, v in enumerate(x)] + [(200 + i, [float(i)] * 6) for i in range(5)]
        vectors = topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(2))
        got = topk.top_k(vectors, vectors.where("id % 50 = 0"), 5, groups=2).collect()
        whole = [[int(np.floor(c * 256)) if abs(c) < 2**40 else int(c * 256) for c in v] for _, v in rows]
        want = [(q, n + 1, i, s) for q in (0, 50, 100, 200) for n, (s, i) in enumerate(best(dict(zip([i for i, _ in rows], whole))[q], q, whole, [i for i, _ in rows], 5))]
        assert sorted((g.query_id, g["rank"], g.vec_id, g.score) for g in got) == want


def test_a_few_large_vectors_leave_the_others_exact(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(300, 4))
    x[7], x[100] = [1e18, 1, 1, 1], [1.0, -1e30, 0, 0]
    vectors = topk.integer_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"))
    got = topk.top_k(vectors, vectors.where("id % 50 = 0"), 5).collect()
    whole = [[int(np.floor(c * 256)) for c in v] for v in x]
    want = [(q, n + 1, i, s) for q in range(0, 300, 50) for n, (s, i) in enumerate(best(whole[q], q, whole, range(300), 5))]
    assert sorted((g.query_id, g["rank"], g.vec_id, g.score) for g in got) == want


def test_long_words_cover(spark):
    words = ["internationalization", "international", "nation", "secret", "ete"]
    dictionary = spark.createDataFrame([(w,) for w in words], "piece string")
    found = ["9Internationalizationx", "xnationalsecretx1", "zzzzzzzz1", "abc", "secretsecret"]
    got = {r.candidate: r.covered for r in secrets._covered(spark.createDataFrame([(c,) for c in found * 2], "candidate string"), dictionary).collect()}
    want = {}
    for c in found:
        on = {i + j for w in words if len(w) >= 4 for i in range(len(c)) if c.lower().startswith(w, i) for j in range(len(w))}
        if on:
            want[c] = len(on) / len(c)
    assert got == want


def test_workers_give_the_tokenizer_back():
    """What one stage has cached must not lie beside the memory of the next stage in a worker that lives on."""
    tok = bpe.tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    list(kernels.released(iter, "bpe")([1]))
    assert bpe.tokenizer(public_tokenizers.path("word_bpe_49k.json")) is tok
    assert list(kernels.released(iter)([1, 2])) == [1, 2]
    assert bpe.tokenizer.cache_info().currsize == 0
