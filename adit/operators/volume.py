"""Volumes from filled grids: slab areas, integrals along s, meshes, hulls, voxels."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adit.operators import trajectory
from adit.operators.grid import Grid

#: Extremes that a hull is first thinned by
_DIRECTIONS = 24


def slab_areas(cells: DataFrame, g: Grid) -> DataFrame:
    """Polygon area of each slab from equally spaced radii; NULL if any is missing. With the share of filled cells."""
    ring = Window.partitionBy("cloud_id", "i").orderBy("j")
    first = F.first("r").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    nxt = F.coalesce(F.lead("r").over(ring), F.when(F.col("j") == g.n_theta - 1, first))
    area = 0.5 * math.sin(math.radians(g.dt)) * F.sum(F.col("r") * F.col("nxt"))
    whole = F.count("r") == g.n_theta
    slabs = cells.withColumn("nxt", nxt).groupBy("cloud_id", "i").agg(F.when(whole, area).alias("area"), F.when(whole, F.avg(F.col("interpolated").cast("double"))).otherwise(1.0).alias("frac_interp"))
    return slabs.withColumn("s", g.centre())


def trapezoid_volume(slabs: DataFrame, g: Grid) -> DataFrame:
    """Trapezoid integral over the slabs that have an area, with constant pieces to both ends of the domain."""
    by = Window.partitionBy("cloud_id").orderBy("s")
    v = slabs.where("area is not null").withColumn("s2", F.lead("s").over(by)).withColumn("a2", F.lead("area").over(by))
    core = F.coalesce(F.sum(0.5 * (F.col("area") + F.col("a2")) * (F.col("s2") - F.col("s"))), F.lit(0.0))
    head = F.min_by("area", "s") * F.greatest(F.lit(0.0), F.min("s") - g.s0)
    tail = F.max_by("area", "s") * F.greatest(F.lit(0.0), g.s1 - F.max("s"))
    out = v.groupBy("cloud_id").agg((core + head + tail).alias("volume"), F.count(F.lit(1)).alias("n_slabs"), F.avg("frac_interp").alias("frac_interp"))
    return out.withColumn("mean_area", F.col("volume") / (g.s1 - g.s0))


def simpson_volume(slabs: DataFrame, g: Grid) -> DataFrame:
    """Simpson's rule over evenly spaced slab areas, with Cartwright's end correction for an even number of samples, and the end pieces."""
    by = Window.partitionBy("cloud_id").orderBy("s")
    n = F.count(F.lit(1)).over(Window.partitionBy("cloud_id"))
    v = slabs.where("area is not null").withColumn("k", F.row_number().over(by) - 1).withColumn("n", n)
    m = F.when(F.col("n") % 2 == 1, F.col("n")).otherwise(F.col("n") - 1)  # samples that Simpson's rule itself covers
    inner = F.when(F.col("k") >= m, 0.0).when((F.col("k") == 0) | (F.col("k") == m - 1), 1.0).when(F.col("k") % 2 == 1, 4.0).otherwise(2.0) / 3.0
    back = F.col("n") - 1 - F.col("k")
    end = F.when(F.col("n") % 2 == 1, 0.0).when(back == 0, 5.0 / 12).when(back == 1, 8.0 / 12).when(back == 2, -1.0 / 12).otherwise(0.0)
    weight = F.when(F.col("n") == 1, 0.0).when(F.col("n") == 2, 0.5).otherwise(inner + end)
    head = F.min_by("area", "s") * F.greatest(F.lit(0.0), F.min("s") - g.s0)
    tail = F.max_by("area", "s") * F.greatest(F.lit(0.0), g.s1 - F.max("s"))
    return v.withColumn("w", weight).groupBy("cloud_id").agg((F.sum(F.col("w") * F.col("area")) * g.ds + head + tail).alias("volume"))


def cumulative_volume(slabs: DataFrame) -> DataFrame:
    """Running trapezoid integral along s, 0 at the first slab."""
    by = Window.partitionBy("cloud_id").orderBy("s")
    step = 0.5 * (F.col("area") + F.lag("area").over(by)) * (F.col("s") - F.lag("s").over(by))
    rows = slabs.where("area is not null").withColumn("step", F.coalesce(step, F.lit(0.0)))
    return rows.select("cloud_id", "i", "s", F.sum("step").over(by.rowsBetween(Window.unboundedPreceding, 0)).alias("volume"))


def rings(cells: DataFrame, g: Grid, to_ends: bool = True) -> DataFrame:
    """The slab rings that a mesh joins (cloud_id, k, rings, j, r, theta, s): those with all radii, numbered from 0.

    The first and last ring are repeated at both ends of the domain, unless
    ``to_ends`` is false: then the mesh spans ring centres only.
    """
    n = g.n_theta
    whole = F.count("r").over(Window.partitionBy("cloud_id", "i")) == n
    column = Window.partitionBy("cloud_id", "j").orderBy("s")
    rows = cells.select("cloud_id", "i", "j", "r").withColumn("whole", whole).where("whole").withColumn("s", g.centre())
    rows = rows.withColumn("first", F.row_number().over(column) == 1).withColumn("last", F.lead("s").over(column).isNull())
    places = F.array(F.col("s"))
    if to_ends:  # an end that a slab centre has reached already needs no ring
        none = F.array().cast("array<double>")
        head = F.when(F.col("first") & (F.col("s") > g.s0), F.array(F.lit(float(g.s0)))).otherwise(none)
        tail = F.when(F.col("last") & (F.col("s") < g.s1), F.array(F.lit(float(g.s1)))).otherwise(none)
        places = F.concat(head, places, tail)
    rows = rows.select("cloud_id", "j", "r", F.explode(places).alias("s"))
    rows = rows.select("cloud_id", (F.row_number().over(column) - 1).alias("k"), F.count(F.lit(1)).over(Window.partitionBy("cloud_id", "j")).alias("rings"), "j", "r", ((F.col("j") + 0.5) * g.dt - 180.0).alias("theta"), "s")
    return rows


def straight(rows: DataFrame) -> DataFrame:
    """(s, r, theta) about a straight axis along z, with x, y, z."""
    t = F.radians("theta")
    return rows.withColumn("x", F.col("r") * F.cos(t)).withColumn("y", F.col("r") * F.sin(t)).withColumn("z", F.col("s"))


def faces(placed: DataFrame, tips: DataFrame, g: Grid) -> DataFrame:
    """The triangles of a closed mesh (cloud_id, a, b, c) with their corners (ax .. cz), from rings() that have x, y, z.

    Two triangles a quad between neighbouring rings, across the theta seam, and a fan to a
    tip at each end. Corners are carried by windows over rings and columns, so
    that no face is joined with its vertices. ``tips``: (cloud_id, x0, y0, z0, x1, y1, z1), a row a cloud.
    """
    n = g.n_theta
    vertex = lambda k, j: F.struct((F.col(k) * n + F.col(j)).alias("v"), "x", "y", "z")
    ring, column = Window.partitionBy("cloud_id", "k").orderBy("j"), Window.partitionBy("cloud_id", "j").orderBy("k")
    rows = placed.withColumn("p", vertex("k", "j"))
    start = F.first("p").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.withColumn("q", F.coalesce(F.lead("p").over(ring), start)).withColumn("up", F.lead("p").over(column)).withColumn("upq", F.lead("q").over(column))
    rows = rows.join(F.broadcast(tips), "cloud_id")  # a row a cloud
    tip = lambda end: F.struct((F.col("rings") * n + end).cast("bigint").alias("v"), F.col(f"x{end}").alias("x"), F.col(f"y{end}").alias("y"), F.col(f"z{end}").alias("z"))
    face = lambda a, b, c: F.struct(a.alias("a"), b.alias("b"), c.alias("c"))
    p, q, up, upq = (F.col(c) for c in ("p", "q", "up", "upq"))
    none = F.array().cast("array<struct<a:struct<v:bigint,x:double,y:double,z:double>,b:struct<v:bigint,x:double,y:double,z:double>,c:struct<v:bigint,x:double,y:double,z:double>>>")
    made = F.concat(
        F.when(up.isNotNull(), F.array(face(p, q, upq), face(p, upq, up))).otherwise(none),
        F.when(F.col("k") == 0, F.array(face(tip(0), q, p))).otherwise(none), F.when(F.col("k") == F.col("rings") - 1, F.array(face(tip(1), p, q))).otherwise(none),
    )
    return rows.select("cloud_id", F.explode(made).alias("f")).select("cloud_id", *[F.col(f"f.{c}.v").alias(c) for c in "abc"], *[F.col(f"f.{c}.{d}").alias(c + d) for c in "abc" for d in "xyz"])


def placed_on(rows: DataFrame, frame: DataFrame | None) -> DataFrame:
    """(s, r, theta) with x, y, z: about a centreline, or about a straight axis along z without one."""
    return straight(rows) if frame is None else trajectory.from_cylindrical(rows, frame)


def mesh(cells: DataFrame, g: Grid, to_ends: bool = True, frame: DataFrame | None = None) -> DataFrame:
    """faces() of a grid about a centreline, or a straight axis; the tips lie on it at both ends of the rings."""
    rows = rings(cells, g, to_ends)
    ends = rows.groupBy("cloud_id").agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    tips = ends.select("cloud_id", F.posexplode(F.array("lo", "hi")).alias("end", "s")).withColumn("r", F.lit(0.0)).withColumn("theta", F.lit(0.0))
    at = lambda c, k: F.max(F.when(F.col("end") == k, F.col(c))).alias(f"{c}{k}")
    return faces(placed_on(rows, frame), placed_on(tips, frame).groupBy("cloud_id").agg(*[at(c, k) for k in (0, 1) for c in "xyz"]), g)


def profile_cloud(cells: DataFrame, g: Grid, frame: DataFrame | None = None) -> DataFrame:
    """(cloud_id, i, j, s, r, theta, x, y, z, interpolated): the known cells of a filled grid as points."""
    rows = cells.where("r is not null").select("cloud_id", "i", "j", g.centre().alias("s"), "r", ((F.col("j") + 0.5) * g.dt - 180.0).alias("theta"), "interpolated")
    return placed_on(rows, frame).select("cloud_id", "i", "j", "s", "r", "theta", "x", "y", "z", "interpolated")


def vertices(meshed: DataFrame) -> DataFrame:
    """(cloud_id, vid, x, y, z): the corners of the faces, once."""
    corner = lambda c: F.struct(F.col(c).alias("vid"), *[F.col(c + d).alias(d) for d in "xyz"])
    return meshed.select("cloud_id", F.explode(F.array(*map(corner, "abc"))).alias("v")).select("cloud_id", "v.*").groupBy("cloud_id", "vid").agg(*[F.first(d).alias(d) for d in "xyz"])


def closed_check(meshed: DataFrame) -> DataFrame:
    """Whether each undirected edge has two faces and each directed one a single face."""
    edges = meshed.select("cloud_id", F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("c").alias("v")), F.struct(F.col("c").alias("u"), F.col("a").alias("v")))).alias("e")).select("cloud_id", "e.*")
    each = edges.groupBy("cloud_id", F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("u") < F.col("v")).alias("up"))
    return each.groupBy("cloud_id").agg(F.count(F.lit(1)).alias("n_edges"), F.every(F.col("n") == 2).alias("closed"), F.every((F.col("n") == 2) & (F.col("up") == 1)).alias("oriented"))


def mesh_volume(meshed: DataFrame) -> DataFrame:
    """|sum of v0 . (v1 x v2)| / 6 over the faces."""
    c = {n: F.col(n) for n in ("ax", "ay", "az", "bx", "by", "bz", "cx", "cy", "cz")}
    det = c["ax"] * (c["by"] * c["cz"] - c["bz"] * c["cy"]) + c["ay"] * (c["bz"] * c["cx"] - c["bx"] * c["cz"]) + c["az"] * (c["bx"] * c["cy"] - c["by"] * c["cx"])
    return meshed.groupBy("cloud_id").agg((F.abs(F.sum(det)) / 6).alias("volume"), F.count(F.lit(1)).alias("n_faces"))


def hull_areas(points: DataFrame) -> DataFrame:
    """Convex-hull area of the points (cloud_id, i, x, y) of each slab; NULL for fewer than three or all in a line.

    Each slab's points are first thinned, in the tasks they lie in, to those outside the polygon of their
    extremes in ``_DIRECTIONS`` directions, in one vectorised step, and then to their hull; only hulls meet, so a
    slab of any size passes in pieces.
    """

    def corners(pts: np.ndarray) -> list[tuple[float, float]]:
        if len(pts) > 3 * _DIRECTIONS:
            turn = np.arange(_DIRECTIONS) * (2 * math.pi / _DIRECTIONS)
            rim = pts[np.unique((pts @ np.array([np.cos(turn), np.sin(turn)])).argmax(0))]
            mid = rim.mean(0)
            rim = rim[np.argsort(np.arctan2(*(rim - mid).T[::-1]))]
            edge = np.roll(rim, -1, 0) - rim
            inside = np.ones(len(pts), bool)
            for p, e in zip(rim, edge):  # strictly left of every edge
                inside &= e[0] * (pts[:, 1] - p[1]) - e[1] * (pts[:, 0] - p[0]) > 1e-12
            pts = pts[~inside]
        pts = sorted(set(map(tuple, pts.tolist())))
        if len(pts) < 3:
            return pts

        def chain(seq):
            out = []
            for p in seq:
                while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                    out.pop()
                out.append(p)
            return out[:-1]

        return chain(pts) + chain(reversed(pts))

    def thin(frames):
        for f in frames:
            made = []
            for (cloud, i), part in f.groupby(["cloud_id", "i"]):
                hull = corners(part[["x", "y"]].to_numpy())
                made.append(pd.DataFrame({"cloud_id": cloud, "i": i, "x": [p[0] for p in hull], "y": [p[1] for p in hull]}))
            if made:
                yield pd.concat(made)

    def area(f: pd.DataFrame) -> pd.DataFrame:
        hull = corners(f[["x", "y"]].to_numpy())
        twice = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(hull, hull[1:] + hull[:1]))
        return pd.DataFrame({"cloud_id": [f["cloud_id"].iloc[0]], "i": [f["i"].iloc[0]], "area": [abs(twice) / 2 if len(hull) > 2 else None]})

    return points.select("cloud_id", "i", "x", "y").mapInPandas(thin, "cloud_id string, i long, x double, y double").groupBy("cloud_id", "i").applyInPandas(area, "cloud_id string, i long, area double")


def voxels(points: DataFrame, h: float) -> DataFrame:
    """Distinct occupied cells (cloud_id, ix, iy, iz) of edge h."""
    return points.select("cloud_id", *[F.floor(F.col(c) / h).alias(f"i{c}") for c in "xyz"]).distinct()


def dilated(cells: DataFrame, steps: int = 1, clip: bool = False) -> DataFrame:
    """The cells and their six neighbours, ``steps`` times; with ``clip`` within the box of the given cells."""
    box = cells.groupBy("cloud_id").agg(*[f(f"i{c}").alias(f"{n}{c}") for c in "xyz" for n, f in (("lo", F.min), ("hi", F.max))]) if clip else None
    shifts = [(0, 0, 0), (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]
    for _ in range(steps):
        moved = F.explode(F.array(*[F.struct((F.col("ix") + a).alias("ix"), (F.col("iy") + b).alias("iy"), (F.col("iz") + c).alias("iz")) for a, b, c in shifts]))
        cells = cells.select("cloud_id", moved.alias("v")).select("cloud_id", "v.*").distinct()
    if clip:
        names = cells.columns
        inside = [F.col(f"i{c}").between(F.col(f"lo{c}"), F.col(f"hi{c}")) for c in "xyz"]
        cells = cells.join(F.broadcast(box), "cloud_id").where(inside[0] & inside[1] & inside[2]).select(*names)  # a row a cloud
    return cells


def voxel_downsample(points: DataFrame, h: float, values: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """Mean position (and other values) of the points in each cell of edge h."""
    cell = [F.floor(F.col(c) / h).alias(f"i{c}") for c in "xyz"]
    return points.select("cloud_id", *cell, *values).groupBy("cloud_id", "ix", "iy", "iz").agg(F.count(F.lit(1)).alias("n"), *[F.avg(v).alias(v) for v in values])


def cartesian(cloud: DataFrame) -> DataFrame:
    """(s, r, theta) about a straight axis to x, y, z."""
    t = F.radians("theta")
    return cloud.select("cloud_id", "pid", (F.col("r") * F.cos(t)).alias("x"), (F.col("r") * F.sin(t)).alias("y"), F.col("s").alias("z"))


def extrapolated_volume(per_size: DataFrame) -> DataFrame:
    """Voxel volumes at several edges h (cloud_id, h, volume), extended linearly to h = 0."""
    return per_size.groupBy("cloud_id").agg(F.regr_intercept("volume", "h").alias("volume"))


