"""Language ID by sparse multinomial logistic regression.

Features are hashed character n-grams (1 to 3 lower-cased letters and word
borders), weighted (1 + ln count) * idf and scaled to unit length. Document
frequencies are counted over all documents that may be learned from. The weights are learned by
follow-the-regularised-leader with elastic-net penalties (most stay exactly 0)
from at most ``most`` of them, chosen by a hash of the id, and a temperature fitted on a
part of these that is set aside scales the scores to probabilities.

Counts are kept as (text, slot, count) of the slots that occur, so that memory
follows the bytes of a group of texts, however short they are.

Defined cases: a null text, or one without a letter, is ``und`` with score 0;
without any labelled document, so for an empty table, all are ``und``; null labels and null ids are not learned
from; of equal scores the first language in order wins; repeated rows are predicted each, and learned from as long as
``most`` rows, in order of the hash of the id, the id, the language and the text's digest, are not exceeded;
texts of any length are read whole; input columns named as a result, in any case, are replaced, all others are kept.
"""

from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adit.llm import kernels
from adit.llm.sampling import sample

SLOTS = 1 << 14
ORDERS = 3


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point its lower-case letter, or 0 if it is none."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if (ch := chr(c)).isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def counts(column: pa.Array):
    """(first row, last row, row, slot, count, letters) for groups of texts.

    row (from 0 in the group), slot and count: the n-grams that occur, in order of
    row and slot; letters: how many each text has.
    """
    data, offs = kernels.text_buffers(column)
    letters = _letters()
    for i, j in kernels.groups(offs, 1 << 18):
        raw = data[offs[i] : offs[j]]
        starts = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[offs[i : j + 1] - offs[i]]
        low = letters[np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)]
        seen = np.add.reduceat(np.append(low != 0, False), starts[:-1], dtype=np.int64) * (np.diff(starts) > 0) if j > i else np.zeros(0, np.int64)
        # every text with a word border before and after it; no n-gram may cross from one into the next
        size = np.diff(starts) + 2
        ends = np.cumsum(size)
        c = np.zeros(int(ends[-1]), np.uint64)
        doc = np.repeat(np.arange(j - i), size)
        c[np.arange(len(low)) + 2 * np.repeat(np.arange(j - i), size - 2) + 1] = low
        left = np.repeat(ends, size) - np.arange(len(c))  # signs from here to the text's end
        keep = seen[doc] > 0
        run, codes = np.zeros(len(c), np.uint64), []
        for n in range(ORDERS):
            run = run[: len(c) - n] * np.uint64(0x100000001B3) + c[n:] + np.uint64(n + 1)
            ok = np.flatnonzero((left[: len(run)] > n) & keep[: len(run)])
            slot = ((run[ok] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(50)).astype(np.int64)
            codes.append(doc[ok] * SLOTS + slot)
        yield i, j, *_tallied(np.concatenate(codes), j - i), seen


def _tallied(codes: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, slot, count) of codes row * SLOTS + slot: tables of some rows where these are dense, else sorted."""
    if len(codes) * 16 < rows * SLOTS:
        cell, n = np.unique(codes, return_counts=True)
        return cell // SLOTS, cell % SLOTS, n
    parts, codes = [], codes[np.argsort(codes // (SLOTS * 64), kind="stable")] if rows > 64 else codes
    cuts = np.searchsorted(codes // (SLOTS * 64), np.arange(0, -(-rows // 64) + 1))
    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
        table = np.bincount(codes[a:b] - k * SLOTS * 64)
        cell = np.flatnonzero(table)
        parts.append((cell + k * SLOTS * 64, table[cell]))
    cell, n = (np.concatenate(x) for x in zip(*parts))
    return cell // SLOTS, cell % SLOTS, n


def weighted(row: np.ndarray, slot: np.ndarray, n: np.ndarray, idf: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, first): the weights of the occurring n-grams, of unit length a row, and where each row begins."""
    first = np.searchsorted(row, np.arange(rows + 1))
    x = (1 + np.log(n)).astype(np.float32) * idf[slot]
    size = np.sqrt(kernels.row_sums(x * x, first))
    return x / np.maximum(size, 1e-12)[row], first


@dataclass
class Model:
    langs: list = field(default_factory=list)
    idf: np.ndarray = field(default_factory=lambda: np.ones(SLOTS, np.float32))
    weights: np.ndarray = field(default_factory=lambda: np.zeros((SLOTS, 0), np.float32))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0))
    temperature: float = 1.0


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def ftrl(rows: list, y: np.ndarray, n_classes: int, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02):
    """Weights (SLOTS, classes) and biases, learned one row (slots, values) at a time."""
    z, n = np.zeros((SLOTS + 1, n_classes)), np.zeros((SLOTS + 1, n_classes))
    penalty = np.full((SLOTS + 1, 1), l1)
    penalty[-1] = 0  # the bias

    def solve(zi, ni, pi):
        return np.where(np.abs(zi) <= pi, 0.0, -(zi - np.sign(zi) * pi) / ((beta + np.sqrt(ni)) / alpha + l2))

    for _ in range(epochs):
        for (slots, values), label in zip(rows, y):
            slots, values = np.append(slots, SLOTS), np.append(values, 1.0)[:, None]
            zi, ni = z[slots], n[slots]
            w = solve(zi, ni, penalty[slots])
            p = _softmax((w * values).sum(0))
            p[label] -= 1
            g = values * p
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
            z[slots], n[slots] = zi + g - sigma * w, ni + g * g
    w = solve(z, n, penalty)
    return w[:SLOTS].astype(np.float32), w[SLOTS]


def document_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, int]:
    """Documents with each slot, and documents: the tasks send one table each, which are summed by slot."""

    def count(batches):
        total, n = np.zeros(SLOTS, np.int64), 0
        for batch in batches:
            for i, j, _, slot, _, _ in counts(batch.column("text")):
                total += np.bincount(slot, minlength=SLOTS)
                n += j - i
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(SLOTS + 1, dtype=np.int32)), pa.array(np.append(total, n))], ["slot", "n"])

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(SLOTS + 1, np.int64)
    out[rows["slot"]] = rows["n"]
    return out[:SLOTS], int(out[SLOTS])


def fit(docs: DataFrame, most: int = 2_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from ``docs``, all of which may be seen; those without a language only count for nothing."""
    docs = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull())
    df, n = document_frequencies(docs, text_col)
    if not n:
        return Model()
    model = Model(idf=np.log((1 + n) / (1 + df)).astype(np.float32) + 1)
    ids = sample(docs.select(F.col(id_col).alias("__id")), "__id", most).distinct()  # ids of at most ``most`` rows

    def to_rows(batches):
        for batch in batches:
            for i, j, row, slot, n, _ in counts(batch.column("text")):
                x, first = weighted(row, slot, n, model.idf, j - i)
                offs = pa.array(first.astype(np.int32))
                lists = [pa.ListArray.from_arrays(offs, pa.array(v)) for v in (slot.astype(np.int32), x)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in ("id", "lang", "tk")), *lists], ["id", "lang", "tk", "slots", "values"])

    texts = docs.select(F.col(id_col).alias("__id"), F.col(lang_col).cast("string").alias("lang"), F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("tk"), F.col(text_col).alias("text")).join(F.broadcast(ids), "__id")
    kind = docs.schema[id_col].dataType.simpleString()
    got = texts.select(F.col("__id").alias("id"), "lang", "tk", "text").mapInArrow(to_rows, f"id {kind}, lang string, tk string, slots array<int>, values array<float>")
    got = got.orderBy(F.xxhash64("id"), "id", "lang", "tk").limit(most).toPandas().sort_values(["id", "lang", "tk"])  # ids may repeat
    model.langs = sorted(got["lang"].unique())
    y = got["lang"].map({k: i for i, k in enumerate(model.langs)}).to_numpy()
    rows = [(np.asarray(s, np.int64), np.asarray(v, np.float64)) for s, v in zip(got["slots"], got["values"])]
    aside = np.arange(len(rows)) % 5 == 4
    w, b = ftrl([r for r, a in zip(rows, aside) if not a], y[~aside], len(model.langs))
    z = np.array([(w[s] * v[:, None]).sum(0) + b for (s, v), a in zip(rows, aside) if a])
    if len(z):
        grid = np.exp(np.linspace(np.log(0.05), np.log(5), 120))
        loss = [-np.log(np.maximum(_softmax(z / t)[np.arange(len(z)), y[aside]], 1e-12)).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
    model.weights, model.bias = w, b
    return model


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The documents with lang_pred and lang_score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    new = {"lang_pred": T.StringType(), "lang_score": T.DoubleType()}
    schema = T.StructType([f for f in docs.schema.fields if f.name in kernels.others(docs.columns, new)] + [T.StructField(k, v) for k, v in new.items()])

    def run(batches):
        m = sent.value
        for batch in batches:
            for i, j, row, slot, n, letters in counts(batch.column(text_col)):
                known = (letters > 0) & (len(m.langs) > 0)
                p = np.zeros((j - i, 1))
                if m.langs:
                    x, first = weighted(row, slot, n, m.idf, j - i)
                    # few languages: a sum of products for each, without a table of rows x slots
                    z = np.column_stack([kernels.row_sums(x * w[slot], first) for w in m.weights.T])
                    p = _softmax((z + m.bias) / m.temperature)
                best = p.argmax(1)
                yield kernels.append(batch.slice(i, j - i), {
                    "lang_pred": pa.array([m.langs[b] if k else "und" for b, k in zip(best, known)], pa.string()),
                    "lang_score": pa.array(np.where(known, p.max(1), 0.0).astype(np.float64)),
                })

    return docs.mapInArrow(run, schema)
