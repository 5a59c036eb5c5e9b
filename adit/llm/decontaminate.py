r"""Benchmark decontamination over a distributed positional inverted index.

Documents are tokenised once, in segments of a few megabytes of text. A segment
is one row of the index: for each term its positions (running over the
segment's words), and where each document begins. Only terms of the given
vocabulary are stored, as no other term can be asked for. A search reads
segments where they lie, without a shuffle: for each query window it starts
from the postings of its corpus-wide rarest term, shifts them by the term's
place in the window, and intersects with the lists of the next rarest terms.
``slop`` lets every further term lie so many words off its place (proximity);
0 asks for the exact phrase.

Query windows are sent to the tasks in blocks of at most ``BLOCK`` windows;
more blocks are more passes over the index, and their spans are then united per
document. Within a segment, windows are searched some at a time, so that no more than
``EXPAND`` postings are looked at together, unless one term alone has more there.

Words are runs of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` after lower-casing A-Z,
compared by 64-bit hashes.

Defined cases: a null or empty text has no words and no hits; an item without words
has no window; items with one id but several rows count as one item; rows with a null
id are one item without a name, a null among the items that match; of equally rare terms
the first in the window comes first; a window never crosses documents; document ids may
repeat or be null, as spans stay with the row, and repeated rows are a row each; very long texts are a
segment of their own; without documents there are no rows, without items no hits; extra columns are not read.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adit.llm import kernels
from adit.llm.store import split_join, written

BLOCK = 200_000
SEGMENT = 1 << 22
EXPAND = 1 << 21
_SPAN = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
_FOUND = [T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(_SPAN)), T.StructField("items", T.ArrayType(T.StringType()))]


def query_windows(items: DataFrame, width: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, terms array<long>): the windows of ``width`` words, or an item's whole text if it has fewer."""

    def cut(batches):
        for batch in batches:
            data, offs = kernels.text_buffers(batch.column("text"))
            h, _, _, first = kernels.words(data, offs, "alnum")
            h = h.view(np.int64)
            item, terms = [], []
            for d, name in enumerate(batch.column("item").to_pylist()):
                w = h[first[d] : first[d + 1]]
                for k in range(max(len(w) - width + 1, min(len(w), 1))):
                    item.append(name)
                    terms.append(w[k : k + width])
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.string()), pa.array(terms, pa.list_(pa.int64()))], ["item", "terms"])

    rows = items.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    return rows.mapInArrow(kernels.released(cut), "item string, terms array<long>").distinct()


def build_index(docs: DataFrame, vocabulary: np.ndarray | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The positional index, a row a segment.

    ids, tks (digests of the texts), begins (words before each document, and
    all at the end), and for the i-th of terms its count and, one after another,
    the positions. ``vocabulary``: sorted hashes of the terms to store; None
    stores all.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")))).alias("tk"), F.col(text_col).alias("text"))
    vocab = None if vocabulary is None else np.asarray(vocabulary, np.int64)

    def postings(batches):
        for batch in batches:
            data, offs = kernels.text_buffers(batch.column("text"))
            for i, j in kernels.groups(offs, SEGMENT):
                h, _, _, first = kernels.words(data, offs[i : j + 1], "alnum")
                h = h.view(np.int64)
                at = np.arange(len(h), dtype=np.int32)
                if vocab is not None:
                    place = np.searchsorted(vocab, h)
                    place[place == len(vocab)] = 0
                    known = vocab[place] == h if len(vocab) else np.zeros(len(h), bool)
                    h, at = h[known], at[known]
                order = np.argsort(h, kind="stable")
                terms, counts = np.unique(h[order], return_counts=True)
                cell = lambda x, t: pa.array([x.astype(t).tobytes()], pa.binary())
                part = batch.slice(i, j - i)
                one = lambda c: pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), part.column(c))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [one("id"), one("tk"), cell(first, np.int64), cell(terms, np.int64), cell(counts, np.int32), cell(at[order], np.int32)],
                    ["ids", "tks", "begins", "terms", "counts", "positions"],
                )

    return rows.mapInArrow(kernels.released(postings), f"ids array<{kind}>, tks array<binary>, begins binary, terms binary, counts binary, positions binary")


def document_frequencies(index: DataFrame) -> DataFrame:
    """(term, n): occurrences of each stored term in all documents."""

    def counts(batches):
        for batch in batches:
            for t, c in zip(batch.column("terms").to_pylist(), batch.column("counts").to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(t, np.int64)), pa.array(np.frombuffer(c, np.int32).astype(np.int64))], ["term", "n"])

    return index.select("terms", "counts").mapInArrow(kernels.released(counts), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


class _Plan:
    """A block of windows, their terms in order of rarity, ready to be looked up."""

    def __init__(self, items: list[str], windows: list[np.ndarray], rarity: dict[int, int], slop: int):
        self.names = [*sorted({i for i in items if i is not None}), None]
        place = {name: k for k, name in enumerate(self.names)}
        self.slop, self.item = slop, np.array([place[i] for i in items], np.int64)
        self.length = np.array([len(w) for w in windows], np.int64)
        most = int(self.length.max(initial=0))
        self.term, self.shift = np.zeros((len(windows), most), np.int64), np.zeros((len(windows), most), np.int64)
        for k, w in enumerate(windows):
            order = sorted(range(len(w)), key=lambda i: (rarity.get(int(w[i]), 0), i))
            self.term[k, : len(w)], self.shift[k, : len(w)] = np.asarray(w)[order], order

    def search(self, begins: np.ndarray, terms: np.ndarray, counts: np.ndarray, positions: np.ndarray):
        """(window, start) of the matches within one segment."""
        none = np.zeros(0, np.int64)
        if not len(terms) or not len(self.length):
            return none, none
        ends = np.cumsum(counts)
        starts = ends - counts
        code = (np.repeat(np.arange(len(terms), dtype=np.int64), counts) << 32) + positions  # the lists, as one sorted array
        place = np.searchsorted(terms, self.term)
        place[place == len(terms)] = 0
        held = (terms[place] == self.term) | (np.arange(self.term.shape[1])[None, :] >= self.length[:, None])
        some = np.flatnonzero(held.all(1))
        cut = np.cumsum(counts[place[some, 0]].astype(np.int64)) // EXPAND
        found = [self._matches(x, place, code, starts, begins, counts, positions) for x in np.split(some, np.flatnonzero(np.diff(cut)) + 1)]
        return tuple(np.concatenate(x) for x in zip(*found))

    def _matches(self, some: np.ndarray, place: np.ndarray, code: np.ndarray, starts: np.ndarray, begins: np.ndarray, counts: np.ndarray, positions: np.ndarray):
        """The matches of ``some`` windows, by intersection from the list of the rarest term on."""
        n = counts[place[some, 0]]
        window = np.repeat(some, n)
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        start = positions[np.repeat(starts[place[some, 0]], n) + inside].astype(np.int64) - self.shift[window, 0]
        doc = np.searchsorted(begins, start, "right") - 1
        ok = (start >= 0) & (start + self.length[window] <= begins[np.clip(doc + 1, 0, len(begins) - 1)])
        window, start = window[ok], start[ok]
        for k in range(1, self.term.shape[1]):
            more = k < self.length[window]
            at = (place[window, k].astype(np.int64) << 32) + start + self.shift[window, k]
            # off its place by slop at most, and within the document
            doc = np.searchsorted(begins, start, "right") - 1
            base = place[window, k].astype(np.int64) << 32
            low = np.searchsorted(code, np.maximum(at - self.slop, base + begins[doc]), "left")
            ok = ~more | (np.searchsorted(code, np.minimum(at + self.slop, base + begins[doc + 1] - 1), "right") > low)
            window, start = window[ok], start[ok]
            if not len(window):
                break
        return window, start


def _spans(begins: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The united ranges, cut at documents (no range crosses one)."""
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(stop[order])
    new = np.ones(len(start), bool)
    if len(start):
        doc = np.searchsorted(begins, start, "right")
        new[1:] = (start[1:] > reach[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    return start[first], reach[np.append(first[1:], len(start)) - 1] if len(start) else start


def matches(index: DataFrame, windows: DataFrame, slop: int = 0, block: int = BLOCK) -> DataFrame:
    """One row a document: id, tk, n_words, spans (ranges of words within matches, disjoint, in order) and items (ids that match)."""
    spark, id_type = index.sparkSession, index.schema["ids"].dataType.elementType
    spread = T.StructType([T.StructField("id", id_type), T.StructField("tk", T.BinaryType()), *_FOUND])
    asked = windows.select(F.explode("terms").alias("term")).distinct()
    total = windows.count()
    passes = max(1, -(-total // block))
    dealt = windows.withColumn("pass", F.pmod(F.xxhash64("item", "terms"), F.lit(passes)))
    rarity_of, parts = written(document_frequencies(index), "rarity"), []
    for k in range(passes):
        rows = dealt.where(F.col("pass") == k)  # of about ``block`` windows, so of bounded size
        held = rows.select(F.explode("terms").alias("term")).distinct() if passes > 1 else asked
        rarity = {r.term: r.n for r in rarity_of.join(held, "term").toLocalIterator()}
        got = rows.select("item", "terms").toPandas()
        plan = spark.sparkContext.broadcast(_Plan(got["item"].tolist(), got["terms"].tolist(), rarity, slop))

        def search(batches, plan=plan):
            p = plan.value
            for batch in batches:
                for r in range(len(batch)):
                    cell = lambda c, t: np.frombuffer(batch.column(c)[r].as_buffer(), t)  # noqa: B023, E731
                    begins = cell("begins", np.int64)
                    window, start = p.search(begins, cell("terms", np.int64), cell("counts", np.int32), cell("positions", np.int32))
                    n = len(begins) - 1
                    # documents that begin at one place: all but the last are empty
                    doc = np.searchsorted(begins, start, "right") - 1
                    a, b = _spans(begins, start, start + p.length[window])
                    home = np.searchsorted(begins, a, "right") - 1
                    span = pa.StructArray.from_arrays([pa.array(a - begins[home]), pa.array(b - begins[home])], ["a", "b"])
                    spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(home, np.arange(n + 1)).astype(np.int32)), span)
                    pairs = np.unique(np.stack([doc, p.item[window]]), axis=1) if len(doc) else np.zeros((2, 0), np.int64)
                    items = pa.ListArray.from_arrays(pa.array(np.searchsorted(pairs[0], np.arange(n + 1)).astype(np.int32)), pa.array([p.names[k] for k in pairs[1]], pa.string()))
                    ids, tks = batch.column("ids")[r].values, batch.column("tks")[r].values
                    yield pa.RecordBatch.from_arrays([ids, tks, pa.array(np.diff(begins)), spans, items], ["id", "tk", "n_words", "spans", "items"])

        part = index.mapInArrow(kernels.released(search), spread)
        parts.append(part.withColumn("pass", F.lit(k)))
    if passes == 1:
        return parts[0].drop("pass")
    return _united(parts)


def _united(parts: list[DataFrame]) -> DataFrame:
    """The passes' rows of each document as one; a text's digest names it, as equal texts have equal matches."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    hits = every.where(F.size("items") > 0).select("tk", "spans", "items").dropDuplicates(["tk", "spans", "items"])
    hits = hits.groupBy("tk").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("s"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("i"))
    # ranges in order of their starts: each either widens the last one or follows it
    start = F.struct(F.array().cast("array<struct<a:long,b:long>>").alias("done"), F.get("s", F.lit(0)).alias("last"))
    step = lambda acc, x: F.when(
        x["a"] <= acc["last"]["b"], F.struct(acc["done"].alias("done"), F.struct(acc["last"]["a"].alias("a"), F.greatest(acc["last"]["b"], x["b"]).alias("b")).alias("last"))
    ).otherwise(F.struct(F.concat(acc["done"], F.array(acc["last"])).alias("done"), x.alias("last")))
    merged = F.aggregate("s", start, step, lambda acc: F.concat(acc["done"], F.array(acc["last"])))
    hits = hits.select("tk", merged.alias("spans"), F.col("i").alias("items"))
    base = parts[0].drop("pass", "spans", "items")
    empty = lambda t: F.array().cast(t)
    return split_join(base, hits, ["tk"], how="left").select("id", "tk", "n_words", F.coalesce("spans", empty("array<struct<a:long,b:long>>")).alias("spans"), F.coalesce("items", empty("array<string>")).alias("items"))


def contamination(docs: DataFrame, items: DataFrame, width: int = 10, slop: int = 0, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", block: int = BLOCK) -> DataFrame:
    """Matches of the items' windows in the documents; see matches() for the columns.

    The vocabulary of the items is taken to the driver in order to leave other
    terms out of the index. If it has more than ``block`` terms, all terms are
    stored instead.
    """
    windows = written(query_windows(items, width, item_col, text_col), "windows")
    terms = windows.select(F.explode("terms").alias("t")).distinct().limit(block + 1).toPandas()["t"].to_numpy(np.int64)
    index = written(build_index(docs, np.sort(terms) if len(terms) <= block else None, id_col, text_col), "index")
    return matches(index, windows, slop, block)


def n_hit(spans: str = "spans"):
    """Words within the spans."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda acc, x: acc + x["b"] - x["a"])
