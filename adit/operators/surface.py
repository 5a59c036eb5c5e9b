"""The half-level surface of occupied cells as a closed mesh: marching cubes with a derived table of cases.

A cube has eight cells as corners, of which some are occupied. On each of its faces the surface cuts off every run of
occupied corners, so of two occupied corners across a face each is cut off alone; as this depends on the face only, cubes
on both sides agree and the mesh closes. The cuts of a cube's faces chain to loops, and
loops are cut into triangles by diagonals that lie in no face, so that no edge has more than two triangles.

Corners of triangles lie halfway on the edges between cells. Their places in half cells are whole numbers, which weld the mesh:
a corner's id is its edge, whichever cube it comes from.
"""

from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adit.operators import volume

#: Bits of a coordinate, in half cells, in a corner's id.
BITS = 21


def _face_loops(pattern: int) -> list[list[tuple[int, int]]]:
    """The loops of cut edges of one case; an edge is its two corners in order."""
    step = {}
    for axis in range(3):
        u, v = (axis + 1) % 3, (axis + 2) % 3
        for side in (0, 1):
            around = [side << axis | a << u | b << v for a, b in ((0, 0), (1, 0), (1, 1), (0, 1))]
            around = around if side else around[::-1]  # counterclockwise as seen from outside
            inside = [pattern >> c & 1 for c in around]
            edge = lambda k: tuple(sorted((around[k % 4], around[(k + 1) % 4])))  # noqa: B023, E731
            for k in range(4):
                if inside[k] and not inside[k - 1]:  # a run begins
                    end = k
                    while inside[(end + 1) % 4]:
                        end += 1
                    step[axis, side, edge(k - 1)] = edge(end)
    loops, left = [], {start: end for (_, _, start), end in step.items()}
    while left:
        first, loop = next(iter(left)), []
        at = first
        while at in left:
            loop.append(at)
            at = left.pop(at)
        loops.append(loop)
    return loops


def _cuts(n: int, first: int = 0, last: int | None = None):
    """All ways to cut the polygon of corners first .. last into triangles."""
    last = n - 1 if last is None else last
    if last - first < 2:
        yield []
        return
    for mid in range(first + 1, last):
        for a in _cuts(n, first, mid):
            for b in _cuts(n, mid, last):
                yield [*a, (first, mid, last), *b]


def _in_a_face(e: tuple[int, int], f: tuple[int, int]) -> bool:
    corners = (*e, *f)
    return any(len({c >> axis & 1 for c in corners}) == 1 for axis in range(3))


@lru_cache(maxsize=1)
def triangle_table() -> list[list[tuple[tuple[int, int, int], ...]]]:
    """For each of the 256 cases its triangles: three corners in half cells from the cube's first cell, counterclockwise as seen from the free side."""
    place = lambda e: tuple((e[0] >> axis & 1) + (e[1] >> axis & 1) for axis in range(3))
    table = []
    for pattern in range(256):
        made = []
        for loop in _face_loops(pattern):
            n = len(loop)
            rim = lambda a, b: (b - a) % n in (1, n - 1)  # noqa: B023, E731
            flat = lambda cut: sum(not rim(a, b) and _in_a_face(loop[a], loop[b]) for t in cut for a, b in ((t[0], t[1]), (t[1], t[2]), (t[0], t[2])))  # noqa: B023, E731
            made += [tuple(place(loop[k]) for k in t) for t in min(_cuts(n), key=flat)]
        table.append(made)
    return table


def iso_surface(cells: DataFrame, h: float) -> DataFrame:
    """Triangles around the occupied cells (cloud_id, ix, iy, iz) of edge ``h``: (cloud_id, a, b, c) with places (ax .. cz), as volume.mesh() gives them.

    Cells count as points at their centres. A cube's case is the sum of its cells' bits; all else is a table of
    256 rows. Indices may go from -2^18 to 2^18.
    """
    touched = F.array(*[F.struct((F.col("ix") - (k & 1)).alias("x"), (F.col("iy") - (k >> 1 & 1)).alias("y"), (F.col("iz") - (k >> 2)).alias("z"), F.lit(1 << k).alias("bit")) for k in range(8)])
    cubes = cells.select("cloud_id", "ix", "iy", "iz").distinct().select("cloud_id", F.explode(touched).alias("c")).groupBy("cloud_id", "c.x", "c.y", "c.z").agg(F.sum("c.bit").cast("int").alias("pattern"))
    rows = [(k, [[c for corner in t for c in corner] for t in made]) for k, made in enumerate(triangle_table()) if made]
    table = cells.sparkSession.createDataFrame(rows, "pattern int, t array<array<int>>")
    each = cubes.join(F.broadcast(table), "pattern").select("cloud_id", "x", "y", "z", F.explode("t").alias("t"))
    at = {f"{p}{d}": 2 * F.col(d) + 1 + F.col("t")[3 * k + m] for k, p in enumerate("abc") for m, d in enumerate("xyz")}
    half = F.lit(1 << (BITS - 1))
    name = lambda p: F.shiftleft((at[f"{p}x"] + half).cast("long"), 2 * BITS) + F.shiftleft((at[f"{p}y"] + half).cast("long"), BITS) + at[f"{p}z"] + half
    return each.select("cloud_id", *[name(p).alias(p) for p in "abc"], *[(v * (h / 2)).alias(k) for k, v in at.items()])


def measured(meshed: DataFrame) -> DataFrame:
    """(cloud_id, volume, area, n_faces, n_edges, closed, oriented) of meshes; the volume is positive where triangles are seen counterclockwise from the free side."""
    u, v = ([F.col(p + d) - F.col("a" + d) for d in "xyz"] for p in "bc")
    cross = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    det = sum((F.col("a" + d) * c for d, c in zip("xyz", cross)), F.lit(0.0))
    sizes = meshed.groupBy("cloud_id").agg((F.sum(det) / 6).alias("volume"), (F.sum(F.sqrt(cross[0] ** 2 + cross[1] ** 2 + cross[2] ** 2)) / 2).alias("area"), F.count(F.lit(1)).alias("n_faces"))
    return sizes.join(volume.closed_check(meshed), "cloud_id")
