"""The pipeline against plain Python, stage by stage, on the stage's own input."""

import collections
import re

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_text_operators import LOW, brute_contamination

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, docs.toPandas()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        got = out.toPandas()
        if name != "bpe":
            assert out.columns == columns
        if name == "toxicity":
            assert set(got.doc_id) <= set(kept.doc_id) and len(got) > 0.8 * len(kept)
        elif name == "line_dedup":
            key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOW)
            seen = collections.Counter(k for t in kept.text for k in {key(x) for x in t.split("\n")} if k)
            want = {i: "\n".join(x for x in t.split("\n") if seen[key(x)] < 10 or not key(x)) for i, t in zip(kept.doc_id, kept.text)}
            assert dict(zip(got.doc_id, got.text)) == want
            assert (got.n_chars == got.text.str.len()).all()
        elif name == "near_dedup":
            sets = {}
            for i, t in sorted(zip(kept.doc_id, kept.text)):
                w = re.findall(r"[^\x20\x09-\x0D]+", t.translate(LOW))
                sets[i] = {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, min(len(w), 1)))}
            comp = {i: i for i in sets}
            for i in sets:
                for j in sets:
                    if j < i and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                        old, new = max(comp[i], comp[j]), min(comp[i], comp[j])
                        comp = {k: new if c == old else c for k, c in comp.items()}
            assert sorted(got.doc_id) == sorted(set(comp.values()))
        elif name == "decontamination":
            bench = spark.read.parquet(f"{SF}/benchmark.parquet").toPandas()
            hits = brute_contamination(kept.text, list(zip(bench.item_id.astype(str), bench.text)), 10)
            assert sorted(got.doc_id) == sorted(i for i, h in zip(kept.doc_id, hits) if not h[1])
        else:
            from tokenizers import Tokenizer

            ref = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
            text = dict(zip(kept.doc_id, kept.text))
            assert all(list(r.token_ids) == ref.encode(text[r.doc_id], add_special_tokens=False).ids for r in got.itertuples())
        docs, kept = out.persist(), got
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, SF).select("doc_id").collect()) == sorted(kept.doc_id)


def test_awkward_rows(spark, docs):
    """Nulls, repeated rows, long texts and clashing columns pass all stages; one of each group of copies stays."""
    at = docs.withColumn("Text_Digest", F.lit(1)).withColumn("kept_id", F.lit(2))
    for clash in ("Toxicity", "N_Dropped", "N_Tokens", "C1", "Tk", "Maybe", "Hot_Salt", "KF_Bits"):
        at = at.drop(clash).withColumn(clash, F.lit("own"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, SF)
        assert name == "bpe" or out.columns == at.columns
        assert out.where("Toxicity = 'own' and Hot_Salt = 'own' and Maybe = 'own' and N_Dropped = 'own'").count() == out.count() > 0
        at = out.persist()
    ids = [r.doc_id for r in at.select("doc_id").collect() if r.doc_id is not None]
    assert len(ids) == len(set(ids))
