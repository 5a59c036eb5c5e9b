"""Operators on texts against plain Python, on rows with every awkward case."""

import collections
import hashlib
import random
import re

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from adit.llm import bpe, decontaminate, line_dedup, near_dedup

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows_of(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize(("most", "least"), [(2, 1), (10, 1), (3, 6)])
def test_line_dedup(docs, most, least):
    texts = [r.text for r in docs.collect()]
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOW)
    lines = [(t or "").split("\n") for t in texts]
    seen = collections.Counter(k for ls in lines for k in {key(x) for x in ls} if len(k) >= least)
    want = collections.Counter()
    for r, ls in zip(docs.collect(), lines):
        kept = [x for x in ls if len(key(x)) < least or seen[key(x)] < most]
        want[(r.doc_id, len(ls), len(ls) - len(kept), "\n".join(kept))] += 1
    out = line_dedup.dedup_lines(docs, most, least)
    assert out.columns == [c for c in docs.columns if c != "n_lines"] + ["n_lines", "n_dropped"]
    assert collections.Counter(rows_of(out.select("doc_id", "n_lines", "n_dropped", "text"))) == want


def shingle_sets(texts, width):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        out.append({tuple(w[i : i + width]) for i in range(max(len(w) - width + 1, min(len(w), 1)))})
    return out


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(docs, width):
    rows = docs.collect()
    sets = shingle_sets([r.text for r in rows], width)
    comp = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                old, new = comp[i], comp[j]
                comp = [new if c == old else c for c in comp]
    low = {}
    for c, r in zip(comp, rows):
        if r.doc_id is not None:
            low[c] = min(low.get(c, r.doc_id), r.doc_id)
    want = collections.Counter((r.doc_id, len(s), low.get(c, r.doc_id), r.doc_id is None or r.doc_id == low[c]) for r, s, c in zip(rows, sets, comp))
    got = near_dedup.near_duplicates(docs, width).select("doc_id", "n_shingles", "component_id", "kept")
    assert collections.Counter(rows_of(got)) == want


def test_near_duplicates_in_one_large_group(spark):
    """Chains and near misses in a crowd that shares most of its words: no link may be lost."""
    import random

    r = random.Random(1)
    base = [f"w{k}" for k in range(60)]
    texts = []
    for k in range(250):
        w = list(base)
        for _ in range(r.randrange(14)):
            w[r.randrange(60)] = f"v{r.randrange(3000)}"
        texts.append(" ".join(w))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets, comp = shingle_sets(texts, 2), list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if comp[i] != comp[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                old, new = max(comp[i], comp[j]), min(comp[i], comp[j])
                comp = [new if c == old else c for c in comp]
    got = dict(rows_of(near_dedup.near_duplicates(frame, 2).select("doc_id", "component_id")))
    assert got == dict(enumerate(comp))
    assert len(set(comp)) > 5


def test_sketches_merge_and_estimate():
    import numpy as np

    from adit.llm import kernels

    h = kernels.mix(np.arange(1, 3001, dtype=np.uint64))
    a, b = h[:2000], h[400:2400]
    ra, rb, both = (near_dedup.registers(x, np.array([0, len(x)])) for x in (a, b, np.unique(np.concatenate([a, b]))))
    assert (near_dedup.merged(ra, rb) == both).all()
    est = near_dedup.similarity(ra, rb, np.array([2000.0]), np.array([2000.0]))[0]
    assert abs(est - 1600 / 2400) < 0.2


def brute_contamination(texts, items, width):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    windows = {tuple(w[i : i + width]): 0 for _, t in items for w in [cut(t)] for i in range(max(len(w) - width + 1, min(len(w), 1)))}
    owner = collections.defaultdict(set)
    for name, t in items:
        w = cut(t)
        for i in range(max(len(w) - width + 1, min(len(w), 1))):
            owner[tuple(w[i : i + width])].add(name)
    out = []
    for t in texts:
        w, hit, got = cut(t), set(), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                if (x := tuple(w[i : i + size])) in owner:
                    hit |= set(range(i, i + size))
                    got |= owner[x]
        out.append((len(w), len(hit), tuple(sorted(x for x in got if x is not None)) + (None,) * (None in got)))
    return out


@pytest.mark.parametrize(("width", "block"), [(10, 200_000), (3, 200_000), (3, 5)])
def test_contamination(spark, docs, width, block):
    rows = docs.collect()
    items = [(1, rows[7].text), (2, "shared LINE own, 3"), (2, "word"), (3, None), (4, "..."), (10, "alpha Beta"), (5, "nowhere to be found"), (6, " ".join((rows[6].text or "a").split()[5:30])), (None, "naïve word"), (None, "ONE line")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = collections.Counter(zip([r.doc_id for r in rows], *zip(*brute_contamination([r.text for r in rows], [(str(i) if i is not None else None, t) for i, t in items], width))))
    found = decontaminate.contamination(docs, bench, width, block=block)
    got = found.select("id", "n_words", decontaminate.n_hit(), F.array_sort("items"))
    assert collections.Counter((a, b, c, tuple(d)) for a, b, c, d in rows_of(got)) == want


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (2, "a b x c d"), (3, "a x y z b c d"), (4, "b c d. a")], "doc_id long, text string")
    bench = spark.createDataFrame([("q", "a b c d")], "item_id string, text string")
    ids = lambda slop: {r.id for r in decontaminate.contamination(docs, bench, slop=slop).where("size(items) > 0").collect()}
    assert ids(0) == {1}
    assert ids(1) == {1, 2}


def test_bpe_round_trip(docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    ref = Tokenizer.from_file(path)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    plain, digests = bpe.encode(docs, path), bpe.encode(docs, path, digests=True)
    assert plain.columns == [*docs.columns, "n_tokens", "token_ids", "decoded"]
    for r in plain.collect():
        e = ref.encode(r.text or "", add_special_tokens=False)
        assert r.token_ids == e.ids and r.n_tokens == len(e.ids)
        assert r.decoded == ref.decode(e.ids, skip_special_tokens=False) == bpe.tokenizer(path).decode(r.token_ids)
    want = collections.Counter((r.doc_id, r.n_tokens, sha(" ".join(map(str, r.token_ids))), sha(r.decoded)) for r in plain.collect())
    assert collections.Counter(rows_of(digests.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256"))) == want


def test_words_that_a_polynomial_would_confuse(spark):
    """A Thue-Morse word and its complement have equal sums of powers; they are two words."""
    a = "a"
    while len(a) < 1024:
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, f"x {a} y"), (2, f"x {b} y"), (3, f"x {a} z {b}")], "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs, 2).collect()}
    assert got == {1: (2, 1), 2: (2, 2), 3: (3, 3)}
    found = decontaminate.contamination(docs, spark.createDataFrame([(7, a)], "item_id long, text string"))
    assert {r.id for r in found.where("size(items) > 0").collect()} == {1, 3}


def test_long_words_and_texts(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    ref, r = Tokenizer.from_file(path), random.Random(4)
    long = "".join(r.choice("abcdefghijklmnop") for _ in range(30_000))
    texts = [long, " ".join(["short"] * 4000 + [long[:9000]]), (" ".join(long[k : k + 7] for k in range(0, 30_000, 7)) + "\n\té ") * 8, "x" * 200_000]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("N_Tokens", F.lit("own"))
    got = {x.doc_id: x for x in bpe.encode(frame, path).collect()}
    sums = {x.doc_id: x for x in bpe.encode(frame, path, digests=True).collect()}
    for k, t in enumerate(texts):
        ids = ref.encode(t, add_special_tokens=False).ids
        assert got[k].token_ids == ids and got[k].n_tokens == len(ids) and got[k].decoded == ref.decode(ids, skip_special_tokens=False)
        assert sums[k].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and sums[k].decoded_sha256 == hashlib.sha256(got[k].decoded.encode()).hexdigest()
    assert "".join(bpe.pieces(texts[2], 1000)) == texts[2] and len(list(bpe.pieces(texts[2], 1000))) > 100


def test_more_windows_than_a_block(spark):
    """Above the real bounds of a pass and of the vocabulary."""
    n = decontaminate.BLOCK + 5_000
    items = spark.range(n).selectExpr("id as item_id", "concat('w', id) as text")
    docs = spark.createDataFrame([(1, "w3 and w204999 w3"), (2, "none"), (3, None)], "doc_id long, text string")
    got = {r.id: (sorted(r["items"]), r.n_words) for r in decontaminate.contamination(docs, items).collect()}
    assert got == {1: (["204999", "3"], 4), 2: ([], 1), 3: ([], 0)}


def test_bpe_odd_text():
    from hypothesis import given, settings
    from hypothesis import strategies as st
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    ref, own = Tokenizer.from_file(path), bpe.tokenizer(path)
    signs = st.sampled_from(list("aAbsSß'’éÉΣσİıſK12½٣ \t\n\x1c\x85 　,.!<|>-_日本한🎉́‍"))

    @settings(max_examples=300, deadline=None)
    @given(st.lists(signs, max_size=40).map("".join))
    def same(text):
        e = ref.encode(text, add_special_tokens=False)
        assert own.encode([text])[0] == (len(e.ids), " ".join(map(str, e.ids)), ref.decode(e.ids, skip_special_tokens=False))

    same()


def test_empty_tables(spark, empty):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert line_dedup.dedup_lines(empty).count() == 0
    assert near_dedup.near_duplicates(empty).count() == 0
    assert decontaminate.contamination(empty, bench).count() == 0
    assert bpe.encode(empty, public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_no_benchmark(spark, docs):
    bench = spark.createDataFrame([], "item_id long, text string")
    found = decontaminate.contamination(docs, bench)
    assert found.count() == docs.count() and found.where("size(items) > 0").count() == 0
