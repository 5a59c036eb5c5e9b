"""Quality by a generalised additive model with pairwise interactions.

Each text gives ``FEATURES``, numbers about its signs, words and lines, in one
vectorised pass. The model is a sum of lookup tables over binned features and
over a few pairs of features, through a logistic link. Tables are learned by
cyclic gradient boosting: each cycle visits every feature, fits a tree of at most
four leaves on that feature alone to the current residuals, and adds a small
share of it to the table; the number of cycles is the best one on a part of the
sample that is set aside. Then the pairs whose four quadrants explain most of what is left are
boosted in the same way. A score is a sum of table entries.

The fit sees at most ``most`` labelled rows, chosen by a hash of the id, and only
their features; whole texts of all documents are scored.

Defined cases: a null or empty text has all features 0 and gets the score of
these; null labels are left out, of several labels of an id the largest counts; of several
rows with one id the one with the smallest features is learned from, and each is scored; with no
label (so for empty tables) or one class only, every score is the share of 1 (0.5 without any); texts of any
length are read whole; of equally good cuts the first is taken; input columns named as a result, in any case, are
replaced, all others but the text are kept.
"""

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adit.llm import kernels
from adit.llm.sampling import sample

FEATURES = (
    "words", "bytes", "word_length", "word_length_deviation", "distinct_words", "root_distinct", "same_as_before", "top_word",
    "upper", "digits", "stops", "commas", "pipes", "signs", "exclamations", "short_words", "long_words", "line_ends", "words_a_line", "non_ascii", "repeated_pairs", "sign_words",
)
_CLASS_NAMES = _LOWER, _UPPER, _DIGIT, _BLANK, _LINE, _STOP, _COMMA, _PIPE, _BANG, _HIGH, _SIGN = range(11)


def _classes() -> np.ndarray:
    c = np.full(256, _SIGN, np.uint8)
    c[ord("a") : ord("z") + 1], c[ord("A") : ord("Z") + 1], c[ord("0") : ord("9") + 1], c[128:] = _LOWER, _UPPER, _DIGIT, _HIGH
    c[[9, 11, 12, 13, 32]], c[10], c[[ord("."), ord("?")]], c[[ord(","), ord(";"), ord(":")]], c[ord("|")], c[ord("!")] = _BLANK, _LINE, _STOP, _COMMA, _PIPE, _BANG
    return c


_CLASS = _classes()


def text_features(column: pa.Array) -> np.ndarray:
    """FEATURES of each text, a row each."""
    data, offs = kernels.text_buffers(column)
    out = np.zeros((len(offs) - 1, len(FEATURES)), np.float32)
    for i, j in kernels.groups(offs):
        out[i:j] = _group_features(data, offs[i : j + 1])
    out[np.diff(offs) == 0] = 0
    return out


def _repeats(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each run of hashes how many differ, and how often the commonest occurs."""
    doc = np.repeat(np.arange(len(first) - 1, dtype=np.uint64), np.diff(first))
    key = np.sort(doc << np.uint64(50) | h >> np.uint64(14))  # a group has fewer than 2^14 texts
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    runs = np.diff(np.append(at, len(key)))
    return kernels.row_sums(new.astype(np.int64), first), kernels.row_sums(runs, np.searchsorted(at, first), np.maximum)


def _group_features(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    h, start, end, first = kernels.words(data, offs, "space")
    docs, size, n = len(offs) - 1, np.diff(offs), np.diff(first)
    kinds = len(_CLASS_NAMES)
    code = np.repeat(np.arange(docs, dtype=np.int32) * kinds, size) + _CLASS[data[offs[0] : offs[-1]]]
    kind = np.bincount(code, minlength=docs * kinds).reshape(docs, kinds).T
    length = (end - start).astype(np.float64)
    of = lambda x: kernels.row_sums(x.astype(np.float64), first)
    m, letters, size1 = np.maximum(n, 1), np.maximum(kind[_LOWER] + kind[_UPPER] + kind[_HIGH], 1), np.maximum(size, 1)
    mean = of(length) / m
    again = np.zeros(len(h), bool)
    again[1:] = h[1:] == h[:-1]
    again[first[:-1][n > 0]] = False
    distinct, top = _repeats(h, first)
    pairs, pair_first = kernels.shingles(h, first, 2)
    pairs_distinct, _ = _repeats(pairs, pair_first)
    last_sign = _CLASS[data[end - 1]] == _SIGN if len(end) else np.zeros(0, bool)
    return np.column_stack([
        np.log1p(n), np.log1p(size), mean, np.sqrt(np.maximum(of(length**2) / m - mean**2, 0)), distinct / m, distinct / np.sqrt(m),
        of(again) / np.maximum(n - 1, 1), top / m,
        kind[_UPPER] / letters, kind[_DIGIT] / size1, kind[_STOP] / m, kind[_COMMA] / m, kind[_PIPE] / m, kind[_SIGN] / m, kind[_BANG] / m,
        of(length <= 3) / m, of(length >= 12) / m, kind[_LINE] / m, np.log1p(n / (kind[_LINE] + 1)), kind[_HIGH] / size1,
        1 - pairs_distinct / np.maximum(np.diff(pair_first), 1), of(last_sign) / m,
    ])


@dataclass
class Model:
    edges: list = field(default_factory=list)  # a feature's bin borders
    tables: list = field(default_factory=list)  # a feature's lookup table
    pairs: list = field(default_factory=list)  # (feature, feature, table)
    intercept: float = 0.0

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.edges)]).astype(np.int64) if self.edges else np.zeros((len(x), 0), np.int64)

    def margin(self, bins: np.ndarray) -> np.ndarray:
        z = np.full(len(bins), self.intercept)
        for k, table in enumerate(self.tables):
            z += table[bins[:, k]]
        for a, b, table in self.pairs:
            z += table[bins[:, a], bins[:, b]]
        return z

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(self.bins(x)), -40, 40)))


def _cut(g: np.ndarray, h: np.ndarray, least: float = 4.0) -> tuple[float, int]:
    """(gain, bins on the left) of the best cut of ordered bins with gradient and Hessian sums."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(gl):
        return 0.0, 0
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + 1) + gr**2 / (hr + 1) - g.sum() ** 2 / (h.sum() + 1)
    gain[(hl < least / 4) | (hr < least / 4)] = 0
    k = int(gain.argmax())
    return float(gain[k]), k + 1


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values of a tree of at most four leaves over ordered bins."""
    parts = [(0, len(g))]
    for _ in range(3):
        gain, at, k = max(((*_cut(g[a:b], h[a:b]), k) for k, (a, b) in enumerate(parts)), key=lambda x: x[0])
        if gain <= 1e-9:
            break
        a, b = parts[k]
        parts[k : k + 1] = [(a, a + at), (a + at, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """(gain, values) of a tree that cuts one feature and then each side on the other."""
    best = (0.0, np.zeros(g.shape))
    for flip in (False, True):
        gg, hh = (g.T, h.T) if flip else (g, h)
        gl, hl = np.cumsum(gg, 0), np.cumsum(hh, 0)
        for c in range(1, len(gg)):
            total, out = 0.0, np.zeros(gg.shape)
            for side, gs, hs in ((slice(0, c), gl[c - 1], hl[c - 1]), (slice(c, None), gl[-1] - gl[c - 1], hl[-1] - hl[c - 1])):
                gain, at = _cut(gs, hs)
                total += gs.sum() ** 2 / (hs.sum() + 1) + gain
                at = at if gain > 1e-9 else 0
                out[side, :at] = gs[:at].sum() / (hs[:at].sum() + 1)
                out[side, at:] = gs[at:].sum() / (hs[at:].sum() + 1)
            total -= g.sum() ** 2 / (h.sum() + 1)
            if total > best[0]:
                best = (total, out.T if flip else out)
    return best


def fit_tables(x: np.ndarray, y: np.ndarray, bins: int = 24, rate: float = 0.1, cycles: int = 200, n_pairs: int = 4, pair_cycles: int = 30) -> Model:
    """Learn the tables from features and 0/1 labels."""
    share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
    model = Model(intercept=float(np.log(share / (1 - share))))
    if len(np.unique(y)) < 2:
        return model
    model.edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(x.shape[1])]
    b = model.bins(x)
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    aside = np.arange(len(y)) % 6 == 0
    learn = ~aside

    def loss(z: np.ndarray) -> float:
        return float(np.mean(np.logaddexp(0, z[aside]) - y[aside] * z[aside]))

    def boost(steps: int, cycle) -> None:
        """Run cycles on the current margin and go back to the best one."""
        state = lambda: ([t.copy() for t in model.tables], [(p, q, t.copy()) for p, q, t in model.pairs])
        z = model.margin(b)
        best, kept, since = loss(z), state(), 0
        for _ in range(steps):
            cycle(z)
            since += 1
            if (now := loss(z)) < best - 1e-5:
                best, kept, since = now, state(), 0
            elif since >= 15:
                break
        model.tables, model.pairs = kept

    def residual(z: np.ndarray):
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        return np.where(learn, y - p, 0), np.where(learn, p * (1 - p), 0)

    def mains(z: np.ndarray) -> None:
        for k, table in enumerate(model.tables):
            g, h = residual(z)
            step = rate * _tree(np.bincount(b[:, k], g, len(table)), np.bincount(b[:, k], h, len(table)))
            table += step
            z += step[b[:, k]]

    boost(cycles, mains)

    def sums(p: int, q: int, g: np.ndarray, h: np.ndarray):
        rows, cols = len(model.tables[p]), len(model.tables[q])
        code = b[:, p] * cols + b[:, q]
        return np.bincount(code, g, rows * cols).reshape(rows, cols), np.bincount(code, h, rows * cols).reshape(rows, cols)

    def quadrants(g: np.ndarray, h: np.ndarray) -> float:
        """The largest gain over all pairs of one cut on each feature."""
        gc, hc = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
        parts = [(gc[:-1, :-1], hc[:-1, :-1])]
        parts.append((gc[:-1, -1:] - gc[:-1, :-1], hc[:-1, -1:] - hc[:-1, :-1]))
        parts.append((gc[-1:, :-1] - gc[:-1, :-1], hc[-1:, :-1] - hc[:-1, :-1]))
        parts.append((gc[-1, -1] - gc[:-1, -1:] - gc[-1:, :-1] + gc[:-1, :-1], hc[-1, -1] - hc[:-1, -1:] - hc[-1:, :-1] + hc[:-1, :-1]))
        total = sum(gs**2 / (hs + 1) for gs, hs in parts)
        return float(total.max()) if total.size else 0.0

    g, h = residual(model.margin(b))
    ranked = sorted(((quadrants(*sums(p, q, g, h)), p, q) for p in range(x.shape[1]) for q in range(p)), reverse=True)
    model.pairs = [(p, q, np.zeros((len(model.tables[p]), len(model.tables[q])))) for _, p, q in ranked[:n_pairs]]

    def interactions(z: np.ndarray) -> None:
        for p, q, table in model.pairs:
            _, step = _pair_tree(*sums(p, q, *residual(z)))
            table += rate * step
            z += rate * step[b[:, p], b[:, q]]

    boost(pair_cycles, interactions)
    return model


def features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents' columns without the text, and ``quality_features``."""
    keep = kernels.others(docs.columns, (text_col, "quality_features"))
    rest = [f for f in docs.schema.fields if f.name in keep]

    def run(batches):
        for batch in batches:
            x = text_features(batch.column(text_col))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in rest), flat], [*(f.name for f in rest), "quality_features"])

    return docs.mapInArrow(run, T.StructType([*rest, T.StructField("quality_features", T.ArrayType(T.FloatType()))]))


def fit(featured: DataFrame, labels: DataFrame, most: int = 20_000, id_col: str = "doc_id", label_col: str = "quality") -> Model:
    """Learn from the featured rows whose ids ``labels`` has; at most ``most`` rows, of features only, reach the driver."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    known = sample(known, "id", most)
    rows = featured.select(F.col(id_col).alias("id"), F.col("quality_features").alias("x")).join(F.broadcast(known), "id")
    rows = rows.groupBy("id", "label").agg(F.min("x").alias("x")).toPandas().sort_values("id")
    x = np.array(rows["x"].tolist(), np.float32).reshape(len(rows), len(FEATURES))
    return fit_tables(x, rows["label"].to_numpy(float))


def score(featured: DataFrame, model: Model) -> DataFrame:
    """The rows with ``quality_score`` for their features, which are dropped."""
    sent = featured.sparkSession.sparkContext.broadcast(model)
    keep = kernels.others(featured.columns, ("quality_features", "quality_score"))
    rest = [f for f in featured.schema.fields if f.name in keep]

    def run(batches):
        for batch in batches:
            x = np.asarray(batch.column("quality_features").flatten()).reshape(len(batch), len(FEATURES))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in rest), pa.array(sent.value.score(x))], [*(f.name for f in rest), "quality_score"])

    return featured.mapInArrow(run, T.StructType([*rest, T.StructField("quality_score", T.DoubleType())]))
