"""Triangulated fill of grids: unknown cells by linear interpolation in the Delaunay triangulation of the known ones.

No triangulation is built. The triangle over a point is the facet of the lower hull
of the lifted points (i, j, i^2 + j^2) that lies over it, so each unknown cell walks to its own: from a
triangle around everything, the point farthest inside the circle takes the place of a corner until the
circle is empty. All is in whole numbers, so that points on one circle are seen as such; among them a
fixed function of the cell decides, which does not depend on the order of rows.

A known cell with eight known neighbours is a corner of no triangle but those of a unit square: only the rims of holes
take part. Cells are solved in blocks with a halo. A triangle counts if its circle lies within the block
and its halo, where no point is missing; other cells go to the next round, whose blocks and halos are twice
as wide, so the result is the same whatever the first width.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adit.operators.graph import kept
from adit.operators.grid import CELL, Grid, scaffold

#: Numbers that a step on queries and points holds at once.
CHUNK = 1 << 20


def order(i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Decides among points on one circle; a fixed function of the cell, without a pattern on the grid."""
    return (i * i * 7919 + i * j * 104729 + j * j * 15485863) % 1048573


def triangles(q: np.ndarray, p: np.ndarray, tie: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each query (whole numbers, two columns) the rows of p that are the corners of its Delaunay triangle, and their weights.

    Weights are NaN for queries outside the hull of p.
    """
    size = 4 * (int(max(np.abs(q).max(initial=0), np.abs(p).max(initial=0))) + 1)
    points = np.concatenate([p, [[-size, -size], [size, -size], [0, size]]]).astype(np.int64)
    n = len(p)
    corners, weights = np.empty((len(q), 3), np.int64), np.full((len(q), 3), np.nan)
    step = max(1, CHUNK // max(n, 1))
    for at in range(0, len(q), step):
        part = q[at : at + step].astype(np.int64)
        corners[at : at + step], weights[at : at + step] = _walked(part, points, np.concatenate([tie, [0, 0, 0]]).astype(np.int64), n)
    return corners, weights


def _plane(corner: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, ...]:
    """Coefficients, times twice the triangle's area, of the plane over the corners with the given heights."""
    (ax, ay), (bx, by), (cx, cy) = (corner[:, k].T for k in range(3))
    a, b, c = cost.T
    return a * (bx * cy - by * cx) + b * (cx * ay - cy * ax) + c * (ax * by - ay * bx), a * (by - cy) + b * (cy - ay) + c * (ay - by), a * (cx - bx) + b * (ax - cx) + c * (bx - ax)


def _walked(q: np.ndarray, points: np.ndarray, tie: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    tri, weights = np.tile(np.arange(n, n + 3), (len(q), 1)), np.full((len(q), 3), np.nan)
    left = np.arange(len(q))
    x, y = (points[None, :n, k] - q[:, None, k] for k in (0, 1))
    far = x * x + y * y
    while len(left):
        corner = points[tri[left]] - q[left][:, None, :]
        real = tri[left] < n
        area = (corner[:, 1, 0] - corner[:, 0, 0]) * (corner[:, 2, 1] - corner[:, 0, 1]) - (corner[:, 1, 1] - corner[:, 0, 1]) * (corner[:, 2, 0] - corner[:, 0, 0])
        over = lambda k: k[0][:, None] + k[1][:, None] * x[left] + k[2][:, None] * y[left]  # noqa: E731, B023
        best, move = np.zeros(len(left), np.int64), np.zeros(len(left), bool)
        if n:
            # first as little of the outer triangle as can be, then below the plane of the lifted corners, then the order among equals
            away = -over(_plane(corner, (~real).astype(np.int64)))
            below = area[:, None] * far[left] - over(_plane(corner, np.where(real, (corner**2).sum(2), 0)))
            least = area[:, None] * tie[None, :n] - over(_plane(corner, tie[tri[left]]))
            free = np.ones(away.shape, bool)
            for value in (away, below, least):
                value = np.where(free, value, np.int64(1) << 62)
                low = value.argmin(1)
                found = ~move & (value[np.arange(len(left)), low] < 0)
                best[found], move = low[found], move | found
                free &= value == 0
        # which corner leaves: the first that the way from the query, moved by an endless small step, reaches
        (ax, ay), (bx, by), (cx, cy) = (corner[:, k].T for k in range(3))
        here = np.stack([bx * cy - by * cx, cx * ay - cy * ax, ax * by - ay * bx], 1)
        slope = np.stack([by - cy, cy - ay, ay - by], 1), np.stack([cx - bx, ax - cx, bx - ax], 1)
        done = ~move
        inside = np.where(real, True, here == 0).all(1)
        rows = left[done & inside]
        weights[rows] = np.where(real, here / area[:, None], 0.0)[done & inside]
        if move.any():
            m = np.flatnonzero(move)
            dx, dy = x[left[m], best[m]], y[left[m], best[m]]
            there = here[m] + slope[0][m] * dx[:, None] + slope[1][m] * dy[:, None]
            with np.errstate(divide="ignore", invalid="ignore"):
                keys = [np.where(there > 0, v[m] / there, np.inf) for v in (here, *slope)]
            out = np.lexsort(keys[::-1], axis=1)[:, 0]
            tri[left[m], out] = best[m]
        left = left[move]
    return tri, weights


def reach(q: np.ndarray, corner: np.ndarray) -> tuple[np.ndarray, ...]:
    """Lowest and highest i and j of the circles through the corners (queries, 3, 2)."""
    a = corner[:, 0].astype(float)
    b, c = corner[:, 1] - a, corner[:, 2] - a
    d = 2 * (b[:, 0] * c[:, 1] - b[:, 1] * c[:, 0])
    bb, cc = (b**2).sum(1), (c**2).sum(1)
    u = np.stack([(c[:, 1] * bb - b[:, 1] * cc) / d, (b[:, 0] * cc - c[:, 0] * bb) / d], 1)
    r = np.sqrt((u**2).sum(1)) * (1 + 1e-9)
    return (a + u - r[:, None])[:, 0], (a + u + r[:, None])[:, 0], (a + u - r[:, None])[:, 1], (a + u + r[:, None])[:, 1]


def solved(q: np.ndarray, p: np.ndarray, r: np.ndarray, tie: np.ndarray, window: tuple[float, float, float, float] | None) -> np.ndarray:
    """Values at q, NaN where a circle leaves the window (lowest and highest i and j); without a window, the nearest point's where no triangle is."""
    out = np.full(len(q), np.nan)
    if not len(p):
        return out
    corners, weights = triangles(q, p, tie)
    by = np.argsort(corners, axis=1)  # sums in the points' order, whichever way the walk went
    corners, weights = np.take_along_axis(corners, by, 1), np.take_along_axis(weights, by, 1)
    ok = ~np.isnan(weights[:, 0])
    if window:
        real = ok & (corners < len(p)).all(1)
        rows = np.flatnonzero(real)
        low_i, high_i, low_j, high_j = reach(q[rows], p[corners[rows]])
        real[rows] = (low_i >= window[0]) & (high_i <= window[1]) & (low_j >= window[2]) & (high_j <= window[3])
        ok = real
    value = np.append(r, 0.0)[np.minimum(corners, len(p))]
    out[ok] = (np.where(weights > 0, value, 0.0) * np.nan_to_num(weights)).sum(1)[ok]
    if not window:
        for k in np.flatnonzero(~ok):
            far = ((p - q[k]) ** 2).sum(1)
            out[k] = r[np.lexsort((p[:, 1], p[:, 0], far))[0]]
    return out


def _block(w: int, n_s: int, n: int, whole: bool):
    """The function that solves a block's rows: unknown cells (r is null) of the block, known ones of the block and its halo of ``w`` cells."""
    least = lambda at, end: -np.inf if at <= end else at  # noqa: E731  beyond the domain and the three layouts of theta no point is missing

    def solve(key, rows):
        i, j, r = (rows.column(c).to_numpy() for c in ("i", "j", "r"))
        at, bi, bj = np.isnan(r), key[1].as_py() * w, key[2].as_py() * w
        q, p, value = np.stack([i[at], j[at]], 1), np.stack([i[~at], j[~at]], 1), r[~at]
        by = np.lexsort((p[:, 1], p[:, 0]))
        p, value = p[by], value[by]
        window = None if whole else (least(bi - w, 0), -least(1 - bi - 2 * w, 1 - n_s), least(bj - w, -n), -least(1 - bj - 2 * w, 1 - 2 * n))
        out = solved(q, p, value, order(p[:, 0], p[:, 1] % n), window)
        name = pa.array([key[0].as_py()] * len(q), rows.schema.field("cloud_id").type)
        return pa.table({"cloud_id": name, "i": q[:, 0], "j": q[:, 1], "r": pa.array(out, from_pandas=True)})

    return solve


def triangulated(cells: DataFrame, g: Grid, width: int = 32) -> DataFrame:
    """All cells, the unknown ones from the Delaunay triangulation of the known ones over (i, j), theta being laid out three times.

    Unknown cells outside the hull of the known ones, at the ends of the domain, have the nearest one's value. ``width``: of blocks and halos in the
    first round; the result does not depend on it. A cloud without any known cell stays unknown.
    """
    n, n_s = g.n_theta, g.n_slabs
    every = kept((scaffold(cells, g) if "dense" not in cells.columns else cells).select(*CELL, "r"))
    left = every.where("r is null").select(*CELL)
    around = F.array(*[F.struct((F.col("i") + a).alias("i"), F.pmod(F.col("j") + b, F.lit(n)).alias("j")) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b])
    near = left.select("cloud_id", F.explode(around).alias("c")).select("cloud_id", F.col("c.i").cast("long").alias("i"), F.col("c.j").cast("long").alias("j")).distinct()
    known = every.where("r is not null").select("cloud_id", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "r")
    ends = (F.col("i") == 0) | (F.col("i") == n_s - 1)
    rim = known.where(~ends).join(near, CELL, "left_semi").unionByName(known.where(ends))
    tiled = kept(rim.withColumn("j", F.explode(F.array(*[F.col("j") + k * n for k in (-1, 0, 1)]))))
    done, kind = None, f"cloud_id {cells.schema['cloud_id'].dataType.simpleString()}, i long, j long, r double"
    left = kept(left.select("cloud_id", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j")))
    while not left.isEmpty():
        w, whole = width, width >= max(n_s, 2 * n)
        block = lambda c, d=0, w=w: F.floor((F.col(c) + d) / w).cast("long")
        asked = left.select(*CELL, F.lit(None).cast("double").alias("r"), block("i").alias("bi"), block("j").alias("bj"))
        sent = tiled.withColumn("bi", F.explode(F.sequence(block("i", -w), block("i", w)))).withColumn("bj", F.explode(F.sequence(block("j", -w), block("j", w))))
        sent = sent.join(asked.select("cloud_id", "bi", "bj").distinct(), ["cloud_id", "bi", "bj"], "left_semi")

        found = kept(asked.unionByName(sent.select(*asked.columns)).groupBy("cloud_id", "bi", "bj").applyInArrow(_block(w, n_s, n, whole), kind))
        done = found.where("r is not null") if done is None else done.unionByName(found.where("r is not null"))
        left, width = found.where("r is null").drop("r"), width * 2
        if whole:
            break
    known = every.where("r is not null").select(*CELL, "r", F.lit(False).alias("interpolated"))
    if done is None:
        return known
    rest = left.select(*CELL, F.lit(None).cast("double").alias("r"))
    return known.unionByName(done.unionByName(rest).select(*[F.col(c).cast(known.schema[c].dataType).alias(c) for c in CELL], "r", F.lit(True).alias("interpolated")))
