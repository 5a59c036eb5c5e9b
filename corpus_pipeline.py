"""From raw documents to token ids: five stages, each over all that the stage before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``documents``. Decisions are joined back by the digest
of a text (and the id, where of equal texts only one stays), so that null or
repeated ids do no harm, and only rows that a decision may concern are shuffled.
Extra columns pass through under any name; the last stage replaces those named as its results.

Defined cases: empty texts, and those without words, are copies of nothing and all stay; of a group of near copies the
row with the smallest id stays (null ids last, then the smallest digest), of its repeated rows the one
whose columns hash lowest; an empty table passes all stages.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adit.llm import bpe, decontaminate, line_dedup, near_dedup, sampling, toxicity
from adit.llm.store import KeyFilter, split_join, unused, written

#: A stage that is fitted or compared with another table reads it from sf_dir.
TOXIC_AT = 0.7
MIN_LINE_DOCS = 10
SHINGLE, PERCENT = 5, 80
WINDOW = 10


def _digest(text: str = "text"):
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))


def _numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The documents with columns c0, c1, ..., which no operator's results clash with, and the new name of each (in lower case)."""
    return docs.toDF(*[f"c{k}" for k in range(len(docs.columns))]), {c.lower(): f"c{k}" for k, c in enumerate(docs.columns)}


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity of TOXIC_AT or more go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~sampling.held_out("doc_id", 3, 1))
    model = toxicity.fit(docs.select("doc_id", "text"), labels)
    rows, name = _numbered(docs)
    return toxicity.score(rows, model, name["text"]).where(F.col("toxicity") < TOXIC_AT).select(*rows.columns).toDF(*docs.columns)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of MIN_LINE_DOCS documents or more go; n_chars is that of the new text."""
    rows, name = _numbered(docs)
    kept = line_dedup.dedup_lines(rows, MIN_LINE_DOCS, text_col=name["text"])
    return kept.withColumn(name["n_chars"], F.char_length(name["text"]).cast("long")).select(*rows.columns).toDF(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays, once."""
    rows, name = _numbered(docs)
    key = lambda c: F.when(F.col(c).isNull(), "").otherwise(F.concat(F.lit("="), F.col(c).cast("string")))  # noqa: E731  of an id
    found = near_dedup.near_duplicates(docs.select("doc_id", "text"), SHINGLE, PERCENT).where("root is not null")
    found = written(found.select("tk", key("doc_id").alias("key"), F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), "tk").alias("place"), "root"), "found")
    best = found.groupBy("root").agg(F.min("place").alias("best"))
    gone = split_join(found, best, ["root"]).where("place <> best").select("tk", "key", F.lit(True).alias("gone")).distinct()
    twice = found.groupBy("tk", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("tk", "key", F.lit(False).alias("gone"))
    # what happens to rows of a text and id: they go, or one of them stays; all others stay as they are
    acts = written(gone.unionByName(twice).groupBy("tk", "key").agg(F.bool_or("gone").alias("gone")), "acts")

    named = rows.withColumn("tk", _digest(name["text"])).withColumn("key", key(name["doc_id"]))
    named = KeyFilter(acts, "tk", "key").marked(named, "maybe", F.col("tk"), F.col("key"))
    some = split_join(named.where("maybe"), acts, ["tk", "key"], found.select("tk", "key"), "left")
    out = named.where("not maybe").select(*rows.columns).unionByName(some.where("gone is null").select(*rows.columns))
    if not acts.where("not gone").isEmpty():
        # of rows that repeat in id and text one stays, chosen before texts move
        row = F.struct(*rows.columns)
        single = some.where("not gone").groupBy("tk", "key").agg(F.min_by(row, F.xxhash64(F.to_json(row))).alias("row"))
        out = out.unionByName(single.select("row.*"))
    return out.toDF(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold WINDOW consecutive words of a benchmark item (all, if it has fewer) go."""
    found = written(decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), WINDOW).select("tk", "items"), "hits")
    tk, maybe = unused(docs, "text_digest"), unused(docs, "maybe")
    bad = written(found.where(F.size("items") > 0).select(F.col("tk").alias(tk)).distinct(), "contaminated")
    named = KeyFilter(bad, tk).marked(docs.withColumn(tk, _digest()), maybe, F.col(tk))
    some = split_join(named.where(maybe), bad, [tk], found.select(F.col("tk").alias(tk)), "left_anti")
    return named.where(f"not {maybe}").unionByName(some).select(*[f"`{c}`" for c in docs.columns])


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, without its text."""
    encoded = bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"))
    return encoded.drop("text", "decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_common_lines),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("bpe", to_tokens),
]

#: The toxicity model is fitted, which SQL can't express; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the last stage returns; each stage's output is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
