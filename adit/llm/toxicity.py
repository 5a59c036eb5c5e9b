r"""Toxicity by maximum-scoring segments.

Features of a token are the word and its beginnings of ``PREFIXES`` bytes (where
it is longer), so that forms of a word that the sample lacks are known by what
they start with; a token's weight is that of its most specific feature that
stands out.

Fit: one labelled document in ``aside``, by a hash of its id, is set aside for the
calibration. Counts of toxic and other documents with a feature among the rest give it a
log-odds with an informative Dirichlet prior (``prior`` times the
pooled counts) and its z-score. Those that stand out keep their
log-odds as weight, every other token has weight 0, and a constant ``drift`` is
subtracted per token, so that scores of ordinary text go down.

Score: a linear-time scan (Ruzzo and Tompa) finds all maximal-scoring segments.
As all tokens without weight cost the same, the scan visits weighted tokens
only and takes the gaps from their positions. The chance that ordinary text of n tokens holds a
segment of score S is 1 - exp(-K n exp(-lambda S)) (Karlin and Altschul); lambda
solves sum p exp(lambda s) = 1 over the ordinary token scores, K is its
maximum-likelihood value on ordinary documents set aside. The most surprising segment and
the sum over segments that are significant alone, in such units, are calibrated
by logistic regression on the documents set aside.

Tokens are runs of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` after lower-casing A-Z.
The fit sees at most ``most`` labelled documents, chosen by a hash of the id;
scoring covers whole texts of all documents, with the input's own columns kept, but for those
named as a result in any case, which are replaced.

Defined cases: a null or empty text has no segment and the score of one; labels that
are null, or repeat with different values for an id, count as null and as the largest; repeated
rows are scored as often as they come, but of all rows of one id only the text of the smallest digest is learned from; of segments with equal scores each is one of its own; without
any labelled row of both classes, so in an empty table, every score is 0; without both classes among the
documents set aside all labelled ones calibrate; the time grows with a text in proportion.
"""

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adit.llm import kernels
from adit.llm.sampling import sample
from adit.llm.store import written


#: Bytes of the beginnings of words that count as features.
PREFIXES = (6, 7, 8, 9)


@dataclass
class Model:
    """Token hashes (sorted) with weights, and the calibration."""

    tokens: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    drift: float = 0.1
    rate: float = 1.0  # lambda
    size: float = 1.0  # K
    intercept: float = -40.0
    slopes: tuple = (0.0, 0.0)
    worst: float = 1e-3  # chance in ordinary text below which a segment is significant


def segments(at: np.ndarray, weight: np.ndarray, drift: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, last, score) of weighted tokens at increasing positions.

    Every token costs ``drift``, those without weight, which lie between the
    given ones, too. One pass: each candidate keeps a link to the nearest one
    before it whose sum up to its start is smaller, so that a look back skips what an
    earlier one has passed, and each candidate is merged at most once.
    """
    first, last, left, right, link = [], [], [], [], []  # places, sums before and up to the end, and the link of each candidate
    total, before = 0.0, -1
    for p, w in zip(at.tolist(), weight.tolist()):
        total -= drift * (p - before - 1)
        start, total, before = total, total + w - drift, p
        if total <= start:
            continue
        a = p
        k = len(left) - 1
        while True:
            while k >= 0 and left[k] >= start:
                k = link[k]
            if k < 0 or right[k] >= total:
                break
            a, start = first[k], left[k]
            before_k = link[k]
            del first[k:], last[k:], left[k:], right[k:], link[k:]
            k = before_k
        first.append(a), last.append(p), left.append(start), right.append(total), link.append(k)
    return [(a, b, r - s) for a, b, s, r in zip(first, last, left, right)]


def _weighted(data: np.ndarray, h: np.ndarray, start: np.ndarray, end: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Places and weights of the tokens that have one."""
    if not len(model.tokens):
        return np.zeros(0, np.int64), np.zeros(0)
    w = np.zeros(len(h))
    for some, f in (*kernels.prefixes(data, start, end, PREFIXES), (np.arange(len(h)), h)):  # the more specific ones overwrite
        f = f.view(np.int64)
        k = np.searchsorted(model.tokens, f)
        k[k == len(model.tokens)] = 0
        hit = np.flatnonzero(model.tokens[k] == f)
        w[some[hit]] = model.weights[k[hit]]
    at = np.flatnonzero(w)
    return at, w[at]


def surprise(score: np.ndarray, n: np.ndarray, model: Model) -> np.ndarray:
    """-ln of the chance that ordinary text of n tokens holds a segment of this score."""
    e = model.size * n * np.exp(-model.rate * score)
    return -np.log(np.maximum(-np.expm1(-e), 1e-300))


def scan(text: pa.Array, model: Model):
    """For each text: tokens, features (surprise of the best segment, sum over the significant ones) and its significant segments."""
    data, offs = kernels.text_buffers(text)
    for i, j in kernels.groups(offs):
        h, start, end, first = kernels.words(data, offs[i : j + 1], "alnum")
        at, w = _weighted(data, h, start, end, model)
        cut = np.searchsorted(at, first)
        features, spans = np.zeros((j - i, 2)), [[] for _ in range(j - i)]
        for d in np.flatnonzero(np.diff(cut)):
            a, b, n = cut[d], cut[d + 1], first[d + 1] - first[d]
            if w[a:b].max() <= 0:
                continue
            segs = segments(at[a:b] - first[d], w[a:b], model.drift)
            if not segs:
                continue
            s = surprise(np.array([x[2] for x in segs]), n, model)
            over = s > -np.log(model.worst)
            features[d] = s.max(), s[over].sum()
            spans[d] = [(int(segs[k][0]), int(segs[k][1]) + 1, float(s[k])) for k in np.flatnonzero(over)]
        yield i, j, np.diff(first), features, spans


def probability(features: np.ndarray, model: Model) -> np.ndarray:
    z = model.intercept + np.log1p(features) @ np.array(model.slopes)
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Intercept and slopes by Newton steps, with a slight ridge."""
    x = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -40, 40)))
        g = x.T @ (y - p) - 1e-3 * b
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(b)), g)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return b


def token_counts(texts: DataFrame) -> DataFrame:
    """(token, toxic, other): documents with each feature by label, in the rows (label, text)."""

    def count(batches):
        for batch in batches:
            label = batch.column("label").to_numpy(zero_copy_only=False).astype(bool)
            data, offs = kernels.text_buffers(batch.column("text"))
            for i, j in kernels.groups(offs):
                h, start, end, first = kernels.words(data, offs[i : j + 1], "alnum")
                doc = np.repeat(np.arange(i, j), np.diff(first))
                parts = [(h, doc), *((f, doc[some]) for some, f in kernels.prefixes(data, start, end, PREFIXES))]
                feature, home = np.concatenate([f for f, _ in parts]).view(np.int64), np.concatenate([d for _, d in parts])
                order = np.lexsort((feature, home))
                feature, home = feature[order], home[order]
                once = np.ones(len(feature), bool)  # a document counts once for a feature
                once[1:] = (feature[1:] != feature[:-1]) | (home[1:] != home[:-1])
                token, inverse = np.unique(feature[once], return_inverse=True)
                toxic = np.bincount(inverse, label[home[once]], len(token)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(toxic), pa.array(np.bincount(inverse, minlength=len(token)) - toxic)], ["token", "toxic", "other"])

    return texts.mapInArrow(kernels.released(count), "token long, toxic long, other long").groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def fit(docs: DataFrame, labels: DataFrame, most: int = 20_000, prior: float = 0.1, min_z: float = 3.2, min_odds: float = 1.0, min_count: int = 5, aside: int = 4, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learn from the labelled documents; ``labels`` holds the rows that may be seen."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("int").alias("label"))
    known = sample(known, "__id", most)  # a row of 12 bytes each: at most ``most`` rows are broadcast
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).join(F.broadcast(known), "__id")
    # one text an id, so that ``most`` bounds rows as well; chosen before texts move
    texts = texts.groupBy("__id", "label").agg(F.min_by("text", F.md5(F.coalesce("text", F.lit("")))).alias("text"))
    texts = written(texts.select("label", "text", (F.pmod(F.xxhash64(F.lit(7), "__id"), F.lit(aside)) == 0).alias("aside")), "labelled")
    counts = written(token_counts(texts.where("not aside").select("label", "text")), "counts")
    held = texts.where("aside").select("label", "text")
    if held.agg(F.count_distinct("label")).first()[0] < 2:
        held = texts.select("label", "text")
    total = counts.agg(F.sum("toxic").alias("t"), F.sum("other").alias("o")).first()
    model = Model()
    if not total.t or not total.o:
        return model
    a = (F.col("toxic") + F.col("other")) * prior
    yt, yo = F.col("toxic") + a, F.col("other") + a
    nt, no = total.t + prior * (total.t + total.o), total.o + prior * (total.t + total.o)
    odds = F.log(yt / (nt - yt)) - F.log(yo / (no - yo))
    scored = counts.where(F.col("toxic") + F.col("other") >= min_count).withColumn("w", odds).withColumn("z", F.col("w") / F.sqrt(1 / yt + 1 / yo))
    kept = scored.where((F.abs("z") >= min_z) & (F.abs("w") >= min_odds)).select("token", "w", "other").toPandas().sort_values("token")
    model.tokens, model.weights = kept["token"].to_numpy(np.int64), kept["w"].to_numpy(float)
    # ordinary text: chances of the token scores, and lambda as the root of their moment
    p = np.append(kept["other"].to_numpy(float), max(total.o - kept["other"].sum(), 1)) / total.o
    s = np.append(model.weights, 0.0) - model.drift
    up = s > 0
    if not up.any():
        return Model()
    p = np.where(up & (p <= 0), 0.5 / total.o, p)
    low, high = 1e-6, 60.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if (p * np.exp(np.minimum(mid * s, 600))).sum() < 1 else (low, mid)
    model.rate = low

    def features(batches, model=model, raw=False):
        for batch in batches:
            for i, j, n, f, _ in scan(batch.column("text"), model):
                yield pa.RecordBatch.from_arrays([batch.column("label").slice(i, j - i), pa.array(n), pa.array(f[:, 0]), pa.array(f[:, 1])], ["label", "n", "f0", "f1"])

    # K = documents / sum n exp(-lambda S) over ordinary documents; with K = 1 the surprise gives n exp(-lambda S) back
    seen = held.mapInArrow(kernels.released(features), "label int, n long, f0 double, f1 double").toPandas()
    plain = seen[(seen["label"] == 0) & (seen["n"] > 0)]
    e = np.where(plain["f0"] > 0, -np.log1p(-np.minimum(np.exp(-plain["f0"]), 1 - 1e-15)), plain["n"])
    model.size = float(len(plain) / max(e.sum(), 1e-9))
    seen = held.mapInArrow(kernels.released(lambda batches, m=model: features(batches, m)), "label int, n long, f0 double, f1 double").toPandas()
    b = _logistic(np.log1p(seen[["f0", "f1"]].to_numpy()), seen["label"].to_numpy(float))
    model.intercept, model.slopes = float(b[0]), (float(b[1]), float(b[2]))
    return model


_SPAN = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("stop", T.LongType()), T.StructField("surprise", T.DoubleType())]))


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The documents with ``toxicity`` (0 to 1) and ``toxic_segments`` (ranges of tokens, with their surprise)."""
    model = docs.sparkSession.sparkContext.broadcast(model)
    new = {"toxicity": T.DoubleType(), "toxic_segments": _SPAN}
    schema = T.StructType([f for f in docs.schema.fields if f.name in kernels.others(docs.columns, new)] + [T.StructField(k, v) for k, v in new.items()])
    span = pa.list_(pa.struct([("first", pa.int64()), ("stop", pa.int64()), ("surprise", pa.float64())]))

    def run(batches):
        m = model.value
        for batch in batches:
            for i, j, _, f, spans in scan(batch.column(text_col), m):
                made = [[{"first": a, "stop": b, "surprise": s} for a, b, s in x] for x in spans]
                yield kernels.append(batch.slice(i, j - i), {"toxicity": pa.array(probability(f, m)), "toxic_segments": pa.array(made, span)})

    return docs.mapInArrow(kernels.released(run), schema)
