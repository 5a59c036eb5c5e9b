"""Exact top-k search by inner product over vector-approximation files.

Candidates are dealt to parts, and a part's task packs them into chunks. A chunk
holds its vectors' exact integer components and, as its approximation file, a
cell of one byte per component: which of ``CELLS`` ranges (by the chunk's own
quantiles) the component lies in. A search scans the cells for an upper bound of
each query's score with each vector, reads exact vectors whose bounds reach the
k-th best exact score so far, and sets that first by the vectors of the largest
bounds. Every row is indexed, and the result is exact.

A part has at most PART components, however many candidates there are, and is
held by its task; queries come behind the candidates in small rows and pass by in
blocks, so that no task holds all queries or all candidates, no row holds a pair
of both, and nothing is broadcast. Candidates move once, queries once to each part. Each
part sends on k rows a query.

Defined cases: vectors that are null, empty, or hold null or non-finite
components take no part, nor do rows with a null id; only vectors of a query's own length are its
candidates; rows with the query's id are never its candidates, other repeated
rows each are, with equal scores in any order; equal scores go by the smaller id; of several rows with one query id the smallest vector is the query.
Components of any size are exact: those too large for sums of 64 bits are multiplied as
whole numbers without bound, and a score beyond a long is given as the nearest long, ties by id; a component that is infinite after scaling takes no part. An
empty table gives no rows; columns other than the two that are named are not read.
"""

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adit.llm.kernels import released

CELLS = 256
#: Vectors of a chunk, queries of a block and of one step at most, and components of a chunk or block, unless it has 64 vectors or fewer.
CHUNK, BLOCK, TILE, WIDEST = 4096, 4096, 256, 1 << 21
#: Components of a row that is sent, and of a part; the parts that a small table is dealt to at most.
ROW, PART, PARTS = 2048, 1 << 24, 48
_LEAST = np.iinfo(np.int64).min


def _floor(c: Column) -> Column:
    """floor() of a double as a double; above 2^52 all are whole."""
    return F.when(F.abs(c) < float(1 << 52), F.floor(c).cast("double")).otherwise(c)


def _large(x: np.ndarray) -> np.ndarray:
    """Rows with components so large that an inner product of others might not fit 63 bits."""
    return np.abs(x.astype(np.float64)).max(1, initial=0) > 2.0**31 / np.sqrt(max(x.shape[1], 1))


def integer_vectors(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(id, v array<double>) with components floor(scale * x), without the rows that take no part; as doubles they are exact at every size."""
    scaled = lambda c: F.lit(float(scale)) * c.cast("double")
    fine = F.forall(vec_col, lambda c: F.coalesce(F.abs(scaled(c)) < float("inf"), F.lit(False)))  # no NaN is less
    some = rows.where(F.col(id_col).isNotNull() & (F.size(F.coalesce(vec_col, F.array().cast(rows.schema[vec_col].dataType))) > 0)).where(fine)
    return some.select(F.col(id_col).cast("long").alias("id"), F.transform(vec_col, lambda c: _floor(scaled(c))).alias("v"))


def packed(vectors: DataFrame, parts: int) -> DataFrame:
    """(part, dim, ids, vectors): rows of up to ROW components, in the narrowest numbers that hold them, dealt to ``parts`` in turn."""

    def pack(batches):
        turn = int(parts * (TaskContext.get().partitionId() * 0.6180339887498949 % 1))  # tasks of few rows begin at parts that lie apart
        for batch in batches:
            ids, lists = batch.column("id").to_numpy().astype(np.int64), batch.column("v")
            flat, offs = lists.flatten().to_numpy(), lists.offsets.to_numpy()
            offs = offs - offs[0]
            length = np.diff(offs)
            out: tuple[list, ...] = ([], [], [], [])
            for dim in np.unique(length):
                rows = np.flatnonzero(length == dim)
                x, names = flat[offs[rows][:, None] + np.arange(dim)[None, :]], ids[rows]
                most = np.abs(x).max(initial=0)
                x = x.astype(np.int16 if most < 2**15 else np.int32 if most < 2**31 else np.float64)
                size = max(ROW // int(dim), 1)
                for at in range(0, len(rows), size):
                    for column, value in zip(out, (turn, int(dim), names[at : at + size].tobytes(), x[at : at + size].tobytes())):
                        column.append(value)
                    turn = (turn + 1) % parts
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], ["part", "dim", "ids", "vectors"])

    return vectors.mapInArrow(pack, "part int, dim int, ids binary, vectors binary")


def _unpacked(ids: bytes, vectors: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    names = np.frombuffer(ids, np.int64)
    kind = {2: np.int16, 4: np.int32, 8: np.float64}[len(vectors) // (len(names) * dim)]
    return names, np.frombuffer(vectors, kind).reshape(-1, dim)


def _some(most: int, dim: int) -> int:
    return max(min(most, WIDEST // dim), 64)


def _first_copies(ids: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """Rows, of rows in order of ids, without copies that are among no query's k best.

    Of equal vectors with one id k are enough, and then the first 2 k of equal vectors: one query passes over k of them, those with its own id.
    """
    whole = np.ascontiguousarray(x).view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel()
    found, kind = np.unique(whole, return_inverse=True)
    if len(found) == len(x):
        return np.arange(len(x))
    rows = np.argsort(kind, kind="stable")
    for most, both in ((k, True), (2 * k, False)):
        c, n = kind[rows], ids[rows]
        new = np.ones(len(rows), bool)
        new[1:] = (c[1:] != c[:-1]) | (both & (n[1:] != n[:-1]))
        start = np.flatnonzero(new)
        rows = rows[np.arange(len(rows)) - start[np.cumsum(new) - 1] < most]
    return np.sort(rows)


class Chunk(NamedTuple):
    """Vectors of one length in order of ids; ``large`` ones have no approximation.

    A vector's score with q is at most q * m + |q| * reach, with m the middles of its cells and reach the length of the
    half cells' vector, widened by what sums of floats may lack.
    """

    ids: np.ndarray
    x: np.ndarray
    cells: np.ndarray  # by component and vector
    middle: np.ndarray  # by component and cell
    reach: np.ndarray
    large_ids: np.ndarray
    large: np.ndarray


def chunk_of(ids: np.ndarray, x: np.ndarray, k: int) -> Chunk:
    order = np.argsort(ids, kind="stable")
    order = order[_first_copies(ids[order], x[order], k)]
    ids, x = ids[order], x[order]
    big = _large(x)
    large_ids, large, ids, x = ids[big], x[big], ids[~big], x[~big]
    dim = x.shape[1]
    cells, middle, half = np.zeros((dim, len(x)), np.uint8), np.zeros((dim, CELLS), np.float32), np.zeros((dim, CELLS))
    for d in range(dim if len(x) else 0):
        v = x[:, d].astype(np.float64)
        s = np.sort(v)
        low = np.unique(s[np.arange(CELLS) * len(s) // CELLS])  # the range that a cell's components really have
        high = s[np.append(np.searchsorted(s, low[1:], "left"), len(s)) - 1]
        cells[d] = np.searchsorted(low, v, "right") - 1
        middle[d, : len(low)] = (low + high) / 2
        half[d, : len(low)] = np.maximum(high - middle[d, : len(low)], middle[d, : len(low)] - low)
    square = lambda table: np.sqrt(sum((np.float64(t) ** 2)[c] for t, c in zip(table, cells)))
    lack = (dim + 8) * 2.0**-22  # of floats of 24 bits, four times over
    reach = np.nextafter((square(half) * (1 + lack) + square(middle) * lack).astype(np.float32), np.float32(np.inf))
    return Chunk(ids, x, cells, middle, reach, large_ids, large)


class Best:
    """The k best of each query so far, the best first."""

    def __init__(self, n: int, k: int):
        self.score, self.ids, self.held = np.full((n, k), _LEAST), np.zeros((n, k), np.int64), np.zeros((n, k), bool)

    def add(self, rows: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        last = self.score[rows, -1]
        enter = ~self.held[rows, -1] | (score > last) | ((score == last) & (ids < self.ids[rows, -1]))
        if not enter.any():
            return
        k = self.score.shape[1]
        some, at = np.unique(rows[enter], return_inverse=True)
        r = np.concatenate([np.repeat(np.arange(len(some)), k), at])
        s, i = np.concatenate([self.score[some].ravel(), score[enter]]), np.concatenate([self.ids[some].ravel(), ids[enter]])
        h = np.concatenate([self.held[some].ravel(), np.ones(len(at), bool)])
        order = np.lexsort((i, ~s, ~h, r))  # ~s falls as s rises, and never overflows
        pick = order[np.searchsorted(r[order], np.arange(len(some)))[:, None] + np.arange(k)]
        self.score[some], self.ids[some], self.held[some] = s[pick], i[pick], h[pick]

    def add_all(self, row: int, ids: np.ndarray, score: np.ndarray) -> None:
        """Scores of one query with vectors in order of ids."""
        k = min(self.score.shape[1], len(ids))
        if k:
            kth = np.partition(score, len(ids) - k)[len(ids) - k]
            above = np.flatnonzero(score > kth)
            best = np.concatenate([above, np.flatnonzero(score == kth)[: k - len(above)]])
            self.add(np.full(k, row), ids[best], score[best])


def _below(score: np.ndarray) -> np.ndarray:
    """Floats under whole numbers."""
    return np.nextafter(score.astype(np.float32), np.float32(-np.inf))


def search_chunk(chunk: Chunk, q: np.ndarray, q_ids: np.ndarray, best: Best) -> None:
    """Put each query's best of a chunk into ``best``; queries are rows of doubles."""
    big = _large(q)
    if big.any() or len(chunk.large):  # pairs with a large vector, as whole numbers of any size
        whole = lambda v: np.array([int(c) for c in v.ravel()], object).reshape(v.shape)
        for x, ids, rows in ((chunk.large, chunk.large_ids, np.arange(len(q))), (chunk.x, chunk.ids, np.flatnonzero(big))):
            exact = whole(x) if len(rows) else x
            for i in rows:
                other = ids != q_ids[i]
                score = [min(max(int(v), -(1 << 63)), (1 << 63) - 1) for v in exact[other] @ whole(q[i])] if other.any() else []
                best.add_all(i, ids[other], np.array(score, np.int64))
    if not len(chunk.ids) or big.all():
        return
    n, dim = chunk.x.shape
    width = -(-n // 8) * 8
    m = np.zeros((dim + 1, width), np.float32)
    for c in range(dim):
        np.take(chunk.middle[c], chunk.cells[c], out=m[c, :n], mode="clip")
    m[dim, :n] = chunk.reach
    bounds, reached = np.empty(min(len(q), TILE) * width, np.float32), np.empty(min(len(q), TILE) * width, bool)
    doubles = np.abs(q[~big]).max(initial=0) * np.abs(chunk.x.astype(np.float64)).max(initial=0) * dim < 2.0**53
    plain = np.flatnonzero(~big)
    for at in range(0, len(plain), TILE):
        rows = plain[at : at + TILE]
        v, names = q[rows], q_ids[rows]
        asked = np.empty((len(rows), dim + 1), np.float32)
        asked[:, :dim], asked[:, dim] = v, np.nextafter(np.sqrt((v * v).sum(1) * (1 + 2.0**-20)).astype(np.float32), np.float32(np.inf))
        bound, hit = bounds[: len(rows) * width].reshape(-1, width), reached[: len(rows) * width].reshape(-1, width)
        np.matmul(asked, m, out=bound)
        first, last = np.searchsorted(chunk.ids, names, "left"), np.searchsorted(chunk.ids, names, "right")
        for r in np.flatnonzero(last > first):
            bound[r, first[r] : last[r]] = -np.inf
        exact = lambda i, j: np.einsum("ij,ij->i", v[i].astype(np.int64), chunk.x[j].astype(np.int64))  # noqa: B023, E731
        least = np.where(best.held[rows, -1], _below(best.score[rows, -1]), np.float32(-np.inf))
        new, k = np.flatnonzero(~best.held[rows, -1]), best.score.shape[1]
        if len(new) and n >= k:  # the largest bounds, one of each run of vectors, say which score k vectors have at least
            step = max(n // max(8 * k, 32), 1)
            runs = bound[new, : n // step * step].reshape(len(new), -1, step)
            at_most = runs.argmax(2) + np.arange(runs.shape[1]) * step
            seen = np.zeros(at_most.shape, np.int64)
            for j in range(at_most.shape[1]):
                seen[:, j] = np.where(bound[new, at_most[:, j]] > -np.inf, exact(new, at_most[:, j]), _LEAST)
            kth = np.partition(seen, seen.shape[1] - k, axis=1)[:, seen.shape[1] - k]
            least[new] = np.where(kth > _LEAST, _below(kth), np.float32(-np.inf))
        np.greater_equal(bound, least[:, None], out=hit)
        if np.count_nonzero(hit) > hit.size // 8:  # nearly all are read: scores by one product
            score = (v @ chunk.x.T.astype(np.float64)).astype(np.int64) if doubles else v.astype(np.int64) @ chunk.x.T.astype(np.int64)
            for r, i in enumerate(rows):
                other = slice(None) if first[r] == last[r] else chunk.ids != names[r]
                best.add_all(i, chunk.ids[other], score[r][other])
            continue
        words = np.flatnonzero(hit.reshape(-1).view(np.uint64))  # eight at a time
        w, b = np.nonzero(hit.reshape(-1, 8)[words])
        i, j = np.divmod(words[w] * 8 + b, width)
        real = j < n
        i, j = i[real], j[real]
        other = chunk.ids[j] != names[i]
        i, j = i[other], j[other]
        most = max(WIDEST // dim, 1)
        for p in range(0, len(i), most):
            best.add(rows[i[p : p + most]], chunk.ids[j[p : p + most]], exact(i[p : p + most], j[p : p + most]))


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 5, groups: int | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k largest inner products.

    Both inputs are (id, v), see integer_vectors(). ``groups``: parts into which
    candidates are dealt and to each of which every query is sent; by default
    as many as PART asks for, at least PARTS or the session's shuffle partitions, if fewer.
    """
    spark = candidates.sparkSession
    if not groups:
        components = candidates.agg(F.sum(F.size("v").cast("long"))).first()[0] or 0
        groups = max(-(-components // PART), min(int(spark.conf.get("spark.sql.shuffle.partitions")), PARTS), 1)
    asked = packed(queries.groupBy("id").agg(F.min("v").alias("v")), groups)
    asked = asked.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"), F.lit(True).alias("asks"), "dim", "ids", "vectors")
    rows = packed(candidates, groups).select("part", F.lit(False).alias("asks"), "dim", "ids", "vectors").unionByName(asked)
    # a row is small, as a batch of them is held whole; candidates come first
    rows = rows.repartitionById(groups, "part").sortWithinPartitions("asks", "dim")

    def search(batches):
        chunks: dict[int, list[Chunk]] = {}
        held: list[tuple[np.ndarray, np.ndarray]] = []
        of, n = (False, 0), 0

        def done():
            """What is held becomes a chunk, or is searched for."""
            (asks, dim), ids, x = of, np.concatenate([i for i, _ in held]), np.concatenate([x for _, x in held])
            if not asks:
                chunks.setdefault(dim, []).append(chunk_of(ids, x, k))
                return
            best, x = Best(len(ids), k), x.astype(np.float64)
            for chunk in chunks.get(dim, []):
                search_chunk(chunk, x, ids, best)
            r, c = np.nonzero(best.held)
            return pa.RecordBatch.from_arrays([pa.array(ids[r]), pa.array(best.ids[r, c]), pa.array(best.score[r, c])], ["query_id", "vec_id", "score"])

        for batch in batches:
            for asks, dim, ids, vectors in zip(*(batch.column(c) for c in ("asks", "dim", "ids", "vectors"))):
                asks, dim = asks.as_py(), dim.as_py()
                if held and ((asks, dim) != of or n >= _some(BLOCK if asks else CHUNK, dim)):
                    if found := done():
                        yield found
                    held, n = [], 0
                of = (asks, dim)
                held.append(_unpacked(ids.as_py(), vectors.as_py(), dim))
                n += len(held[-1][0])
        if held and (found := done()):
            yield found

    found = rows.mapInArrow(released(search), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
