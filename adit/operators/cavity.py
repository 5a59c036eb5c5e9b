"""Enclosed space of voxelised walls: free runs, cavities, iso-surface volumes."""

from itertools import permutations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adit.operators import surface, volume
from adit.operators.graph import components, kept


def free_runs(cells: DataFrame, pad: int = 1, planes: list[tuple[tuple[float, ...], tuple[float, ...]]] | None = None, h: float = 1.0) -> DataFrame:
    """Runs (cloud_id, ix, iy, lo, hi, outside) of free cells along z in the cells' box, widened by ``pad``.

    Only runs between walls are made, not the free cells, so the size follows
    the walls. A run that touches the box is marked. ``planes``: (point, normal) of end caps; cells of edge h whose
    centres lie behind one count as wall, by cutting the runs there.
    """
    box = cells.groupBy("cloud_id").agg(*[f(f"i{c}").alias(f"{n}{c}") for c in "xyz" for n, f in (("lo", F.min), ("hi", F.max))])
    box = box.select("cloud_id", *[(F.col(f"lo{c}") - pad).alias(f"lo{c}") for c in "xyz"], *[(F.col(f"hi{c}") + pad).alias(f"hi{c}") for c in "xyz"])
    columns = box.select("*", F.explode(F.sequence("lox", "hix")).alias("ix")).select("*", F.explode(F.sequence("loy", "hiy")).alias("iy"))
    ends = columns.select("*", F.explode(F.array(F.col("loz") - 1, F.col("hiz") + 1)).alias("iz"))
    walls = cells.join(box, "cloud_id").select(*ends.columns)
    by = Window.partitionBy("cloud_id", "ix", "iy").orderBy("iz")
    gaps = ends.unionByName(walls).withColumn("next", F.lead("iz").over(by)).where("next > iz + 1")
    rim = (F.col("ix") == F.col("lox")) | (F.col("ix") == F.col("hix")) | (F.col("iy") == F.col("loy")) | (F.col("iy") == F.col("hiy"))
    gaps = gaps.withColumn("lo", F.col("iz") + 1).withColumn("hi", F.col("next") - 1)
    for p, n in planes or []:
        # (centre - p) . n >= 0, with the centre's z as the only unknown of a run
        side = (F.col("ix") + 0.5) * (h * n[0]) + (F.col("iy") + 0.5) * (h * n[1]) - sum(a * b for a, b in zip(p, n))
        if abs(n[2]) < 1e-12:
            gaps = gaps.where(side >= 0)
        else:
            edge = -side / (h * n[2]) - 0.5
            gaps = gaps.withColumn("lo", F.greatest("lo", F.ceil(edge))) if n[2] > 0 else gaps.withColumn("hi", F.least("hi", F.floor(edge)))
    gaps = gaps.where("lo <= hi")
    return gaps.select("cloud_id", "ix", "iy", "lo", "hi", (rim | (F.col("lo") == F.col("loz")) | (F.col("hi") == F.col("hiz"))).alias("outside"))


def labelled(runs: DataFrame) -> DataFrame:
    """The runs with ``root``, which names the 6-connected space that they belong to."""
    runs = kept(runs.withColumn("v", F.struct("cloud_id", "ix", "iy", "lo")))
    near = runs.select("cloud_id", F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), F.col("v").alias("a"), F.explode(F.array(F.struct((F.col("ix") + 1).alias("ix"), F.col("iy").alias("iy")), F.struct(F.col("ix").alias("ix"), (F.col("iy") + 1).alias("iy")))).alias("n"))
    near = near.select("cloud_id", "n.ix", "n.iy", "lo2", "hi2", "a")
    edges = runs.join(near, ["cloud_id", "ix", "iy"]).where("lo <= hi2 and lo2 <= hi").select("a", F.col("v").alias("b"))
    return runs.join(components(runs.select("v"), edges), "v").drop("v")


def spaces(runs: DataFrame) -> DataFrame:
    """(cloud_id, root, n, outside): the spaces of labelled runs with their cells; those that reach the box are outside."""
    return runs.groupBy("cloud_id", "root").agg(F.sum(F.col("hi") - F.col("lo") + 1).alias("n"), F.bool_or("outside").alias("outside"))


def cavities(cells: DataFrame, pad: int = 1) -> DataFrame:
    """spaces() of the free cells between walls."""
    return spaces(labelled(free_runs(cells, pad)))


def largest_air(runs: DataFrame) -> DataFrame:
    """The cells (cloud_id, ix, iy, iz) of each cloud's largest enclosed space, from labelled runs."""
    best = spaces(runs).where("not outside").groupBy("cloud_id").agg(F.max_by("root", F.struct("n", "root")).alias("root"))
    return runs.join(best, ["cloud_id", "root"], "left_semi").select("cloud_id", "ix", "iy", F.explode(F.sequence("lo", "hi")).alias("iz"))


def box_cells(points: DataFrame, h: float, pad: int = 3) -> int:
    """Cells of the largest cloud's box, widened by ``pad`` cells."""
    span = points.groupBy("cloud_id").agg(*[(F.max(c) - F.min(c)).alias(c) for c in "xyz"])
    n = F.lit(1.0)
    for c in "xyz":
        n = n * (F.ceil(F.col(c) / h + 2 * pad) + 1)
    return int(span.agg(F.max(n)).first()[0] or 0)


def voxel_volumes(points: DataFrame, sizes: list[float], seal: int = 1, planes: list | None = None, budget: int = 200_000_000, floor_m3: float = 1.0, meshes: dict | None = None) -> DataFrame:
    """(cloud_id, h, seal, n_air, v_voxel, v_surface, area, n_faces, closed, leaked, skipped) of the largest enclosed space for each edge, from coarse to fine.

    Walls are thickened by ``seal`` cells before spaces are told apart and the space is widened by as many after. Volume, area and
    closedness are those of its iso-surface. A space below ``floor_m3`` says that the shell leaks, and has no volume.
    An edge whose box has more cells than ``budget`` is not measured; its rows say so in ``skipped``. ``meshes``: gets the triangles by edge, to be exported.
    """
    found, clouds = None, kept(points.select("cloud_id").distinct())
    for h in sorted(sizes, reverse=True):
        n = box_cells(points, h)
        rows = clouds.withColumn("h", F.lit(float(h))).withColumn("seal", F.lit(seal))
        if n > budget:
            empty = {"n_air": "bigint", "v_voxel": "double", "v_surface": "double", "area": "double", "n_faces": "bigint", "closed": "boolean", "leaked": "boolean"}
            rows = rows.select("*", *[F.lit(None).cast(t).alias(c) for c, t in empty.items()], F.lit(f"{n} cells; the budget is {budget}").alias("skipped"))
        else:
            walls = kept(volume.dilated(volume.voxels(points, h), seal))
            runs = kept(labelled(free_runs(walls, 1 + seal, planes, h)))
            inner = spaces(runs).groupBy("cloud_id").agg(F.coalesce(F.max(F.when(~F.col("outside"), F.col("n"))), F.lit(0)).alias("n_air"))
            air = kept(volume.dilated(largest_air(runs), seal))
            counts = air.groupBy("cloud_id").agg((F.count(F.lit(1)) * F.lit(h**3)).alias("v_voxel"))
            mesh = kept(surface.iso_surface(air, h))
            if meshes is not None:
                meshes[h] = mesh
            shape = surface.measured(mesh).select("cloud_id", F.col("volume").alias("v_surface"), "area", "n_faces", (F.col("closed") & F.col("oriented")).alias("closed"))
            rows = rows.join(inner, "cloud_id", "left").join(counts, "cloud_id", "left").join(shape, "cloud_id", "left")
            n_air, leaked = F.coalesce("n_air", F.lit(0)), F.coalesce("n_air", F.lit(0)) * F.lit(h**3) < floor_m3
            told = [F.when(~leaked, F.col(c)).alias(c) for c in ("v_voxel", "v_surface", "area", "n_faces", "closed")]
            rows = rows.select("cloud_id", "h", "seal", n_air.alias("n_air"), *told, leaked.alias("leaked"), F.lit(None).cast("string").alias("skipped"))
        found = rows if found is None else found.unionByName(rows)
    return kept(found)


def best_volume(volumes: DataFrame) -> DataFrame:
    """For each cloud the surface volume at the finest edge that does not leak, the voxel volume extended to h = 0 (of two edges or more) and whether any leaked."""
    fine = F.when(~F.col("leaked"), F.col("h"))  # null for an edge that was skipped
    line = F.when(F.count(fine) >= 2, F.regr_intercept(F.when(~F.col("leaked"), F.col("v_voxel")), fine))
    return volumes.groupBy("cloud_id").agg(F.min_by("v_surface", fine).alias("volume"), F.min(fine).alias("h"), line.alias("v_extrapolated"), F.bool_or("leaked").alias("leaked"))


def seal_table(points: DataFrame, sizes: list[float], seals: list[int], **settings) -> DataFrame:
    """voxel_volumes() for each number of sealing steps."""
    parts = [voxel_volumes(points, sizes, seal, **settings) for seal in seals]
    for p in parts[1:]:
        parts[0] = parts[0].unionByName(p)
    return parts[0]


def largest_cavity(cells: DataFrame, h: float, floor_m3: float = 0.0) -> DataFrame:
    """Cells and volume of each cloud's largest enclosed space; 0 and ``leaked`` where none reaches ``floor_m3``."""
    inner = cavities(cells).groupBy("cloud_id").agg(F.coalesce(F.max(F.when(~F.col("outside"), F.col("n"))), F.lit(0)).alias("n"))
    out = inner.withColumn("volume", F.col("n") * h**3)
    return out.withColumn("leaked", F.col("volume") <= floor_m3)


def pattern_volumes() -> list[tuple[int, float]]:
    """(pattern, inside share) for each of the 2^8 corner patterns of a unit cube.

    The cube is cut into the six tetrahedra of monotone corner paths; a plane at
    half height between in and out corners leaves 0, 1/8, 1/2, 7/8 or all of one.
    """
    share = (0.0, 1 / 8, 1 / 2, 7 / 8, 1.0)
    paths = []
    for order in permutations((1, 2, 4)):
        corner, path = 0, [0]
        for bit in order:
            corner |= bit
            path.append(corner)
        paths.append(path)
    return [(p, sum(share[sum(p >> c & 1 for c in path)] for path in paths) / 6) for p in range(256)]


def surface_volume(cells: DataFrame, h: float) -> DataFrame:
    """Volume within the half-level surface of occupied cells (cloud_id, ix, iy, iz), taken as corner values."""
    touched = F.array(*[F.struct((F.col("ix") - (k & 1)).alias("x"), (F.col("iy") - (k >> 1 & 1)).alias("y"), (F.col("iz") - (k >> 2)).alias("z"), F.lit(1 << k).alias("bit")) for k in range(8)])
    cubes = cells.distinct().select("cloud_id", F.explode(touched).alias("c")).groupBy("cloud_id", "c.x", "c.y", "c.z").agg(F.sum("c.bit").cast("int").alias("pattern"))
    table = cells.sparkSession.createDataFrame(pattern_volumes(), "pattern int, share double")  # 256 rows
    return cubes.groupBy("cloud_id", "pattern").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(table), "pattern").groupBy("cloud_id").agg((F.sum(F.col("n") * F.col("share")) * h**3).alias("volume"))


def solid(cells: DataFrame) -> DataFrame:
    """The cells of all enclosed free space (cloud_id, ix, iy, iz)."""
    runs = kept(labelled(free_runs(cells)))
    inner = spaces(runs).where("not outside").select("cloud_id", "root")
    return runs.join(inner, ["cloud_id", "root"], "left_semi").select("cloud_id", "ix", "iy", F.explode(F.sequence("lo", "hi")).alias("iz"))
