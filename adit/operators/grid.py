"""The r(s, theta) raster: binning, robust cell radii, coverage, gap filling.

A grid is sparse: a row a cell that has points, (cloud_id, i, j, r). Missing is
no row, or NULL once a scaffold is joined; there is no NaN.
"""

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adit.operators.graph import kept

CELL = ["cloud_id", "i", "j"]


@dataclass(frozen=True)
class Grid:
    """Slabs of ``ds`` over [s0, s1) and bins of ``dt`` degrees over [-180, 180), half-open."""

    s0: float = 0.0
    s1: float = 100.0
    ds: float = 1.0
    dt: float = 5.0

    @property
    def n_slabs(self) -> int:
        return max(0, math.ceil((self.s1 - self.s0 - self.ds / 2) / self.ds))

    @property
    def n_theta(self) -> int:
        return round(360 / self.dt)

    def centre(self, i: str = "i") -> Column:
        return F.lit(self.s0) + (F.col(i) + F.lit(0.5)) * F.lit(self.ds)


def binned(cloud: DataFrame, g: Grid) -> DataFrame:
    """Points with their cell (i, j); those outside are dropped. The filter on s reaches the scan."""
    end = g.s0 + g.n_slabs * g.ds
    inside = cloud.where((F.col("s") >= g.s0) & (F.col("s") < end) & (F.col("theta") >= -180.0) & (F.col("theta") < 180.0))
    i = F.floor((F.col("s") - g.s0) / g.ds)
    j = F.floor((F.col("theta") + 180.0) / g.dt)
    return inside.select("cloud_id", i.alias("i"), j.alias("j"), "r").where((F.col("i") < g.n_slabs) & (F.col("j") < g.n_theta))


def median_grid(points: DataFrame) -> DataFrame:
    """Median radius of each cell."""
    return points.groupBy(*CELL).agg(F.median("r").alias("r"), F.count(F.lit(1)).alias("n"))


#: Points of a cell whose median is found in one task.
FEW = 10_000


def _gaps(points: DataFrame, gap: float) -> DataFrame:
    """(cell, n, lo, hi, two): whether a cell's sorted radii have a gap above ``gap``, without sorting them.

    Two radii in a bucket of half a gap are no gap apart, so a gap lies between a bucket's largest and the next one's
    smallest. Points are counted by bucket on the map side; a cell has as many buckets as its radii span.
    """
    width = F.lit(gap / 2 if gap > 0 else 1.0)
    buckets = points.groupBy(*CELL, F.floor(F.col("r") / width).alias("b")).agg(F.min("r").alias("lo"), F.max("r").alias("hi"), F.count(F.lit(1)).alias("n"))
    some = buckets.groupBy(*CELL).agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.array_sort(F.collect_list(F.struct("b", "lo", "hi"))).alias("x"))
    two = F.exists(F.sequence(F.lit(1), F.size("x") - 1), lambda k: F.get("x", k)["lo"] - F.get("x", k - 1)["hi"] > gap)
    if gap <= 0:
        two = F.col("hi") - F.col("lo") > max(gap, 0.0)
    return some.select(*CELL, "n", "lo", "hi", F.coalesce((F.size("x") > 1) & two if gap > 0 else two, F.lit(False)).alias("two"))


def _hot_medians(points: DataFrame, hot: DataFrame, most: int) -> DataFrame:
    """(cell, mid) of cells (cell, n, lo, hi) of more than ``most`` points: both middle ranks are closed in on by counts of 1,024 parts of a range, until few points are left in it.

    ``hot`` has a stated number of rows and is broadcast; only counts are shuffled.
    """
    ranks = F.array(F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2))
    open_ = kept(hot.select(*CELL, F.posexplode(ranks).alias("which", "rank"), "lo", "hi", "n"))
    done = None
    while True:
        over = open_.where((F.col("n") > most) & (F.col("hi") > F.col("lo")))
        rest = open_.where(~((F.col("n") > most) & (F.col("hi") > F.col("lo"))))
        done = rest if done is None else done.unionByName(rest)
        if over.isEmpty():
            break
        near = points.join(F.broadcast(over), CELL).where((F.col("r") >= F.col("lo")) & (F.col("r") <= F.col("hi")))
        part = F.floor((F.col("r") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 1024).alias("part")
        counts = near.groupBy(*CELL, "which", "rank", part).agg(F.min("r").alias("a"), F.max("r").alias("b"), F.count(F.lit(1)).alias("m"))
        parts = counts.groupBy(*CELL, "which", "rank").agg(F.array_sort(F.collect_list(F.struct("part", "a", "b", "m"))).alias("x"))
        start = F.struct(F.col("rank").alias("rank"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"), F.lit(None).cast("long").alias("n"))

        def to(at, x):
            here = at["n"].isNull() & (at["rank"] < x["m"])
            passed = F.struct((at["rank"] - x["m"]).alias("rank"), at["lo"].alias("lo"), at["hi"].alias("hi"), at["n"].alias("n"))
            found = F.struct(at["rank"].alias("rank"), x["a"].alias("lo"), x["b"].alias("hi"), x["m"].alias("n"))
            return F.when(at["n"].isNotNull(), at).when(here, found).otherwise(passed)

        open_ = kept(parts.select(*CELL, "which", F.aggregate("x", start, to).alias("f")).select(*CELL, "which", "f.rank", "f.lo", "f.hi", "f.n"))
    done = kept(done)
    alike = done.where("hi = lo").select(*CELL, "which", F.col("lo").alias("v"))
    near = points.join(F.broadcast(done.where("hi > lo")), CELL).where((F.col("r") >= F.col("lo")) & (F.col("r") <= F.col("hi")))
    sorted_ = near.groupBy(*CELL, "which", "rank").agg(F.sort_array(F.collect_list("r")).alias("x"))
    values = sorted_.select(*CELL, "which", F.get("x", F.col("rank").cast("int")).alias("v")).unionByName(alike)
    return values.groupBy(*CELL).agg((F.sum("v") / 2).alias("mid"))


def bimodal_grid(points: DataFrame, gap: float = 0.30, few: int = FEW) -> DataFrame:
    """Cell radius: the largest where sorted radii have a gap above ``gap`` (the outer wall of two), else the median.

    No point is sorted. Medians of cells of up to ``few`` points are made in a task each; those of
    fuller ones, which are told apart from so many points on that at most 20,000 can exist, by counts.
    """
    cells = kept(_gaps(points, gap))
    largest, total = cells.agg(F.max("n"), F.sum("n")).first()
    out = cells.select(*CELL, "two", "hi", "n")
    least = max(few, (total or 0) // 20_000)
    if (largest or 0) <= least:
        mids = points.groupBy(*CELL).agg(F.median("r").alias("mid"))
    else:
        hot = kept(cells.where((F.col("n") > least) & ~F.col("two")).select(*CELL, "n", "lo", "hi"))
        full = cells.where(F.col("n") > least).select(*CELL)
        mids = points.join(F.broadcast(full), CELL, "left_anti").groupBy(*CELL).agg(F.median("r").alias("mid"))
        if not hot.isEmpty():
            mids = mids.unionByName(_hot_medians(points, hot, least))
    rows = out.join(mids, CELL, "left")
    return rows.select(*CELL, F.when(F.col("two"), F.col("hi")).otherwise(F.col("mid")).alias("r"), F.col("two").alias("bimodal"), "n")


def scaffold(grid: DataFrame, g: Grid) -> DataFrame:
    """All cells of every cloud in ``grid``, with r where there is one. The number of cells is fixed by the grid."""
    spark = grid.sparkSession
    cells = spark.range(g.n_slabs).withColumnRenamed("id", "i").crossJoin(spark.range(g.n_theta).withColumnRenamed("id", "j"))
    every = grid.select("cloud_id").distinct().crossJoin(cells)
    return every.join(grid.select(*CELL, "r"), CELL, "left")


def coverage_by_slab(grid: DataFrame, g: Grid) -> DataFrame:
    """Share of bins with points, for every slab."""
    return scaffold(grid, g).groupBy("cloud_id", "i").agg((F.count("r") / F.lit(float(g.n_theta))).alias("coverage"))


def coverage_total(grid: DataFrame, g: Grid) -> DataFrame:
    """Share of cells without points."""
    n = g.n_slabs * g.n_theta
    return grid.groupBy("cloud_id").agg(F.count(F.lit(1)).alias("n_cells"), (1.0 - F.count(F.lit(1)) / F.lit(float(n))).alias("frac_missing"))


def filled(df: DataFrame, keys: list[str], pos: str, value: str, period: int | None = None) -> Column:
    """Linear interpolation of NULLs along ``pos``; ends are held, or wrap with a ``period``. NULL where nothing is known."""
    by = Window.partitionBy(*keys).orderBy(pos)
    before, after = by.rowsBetween(Window.unboundedPreceding, 0), by.rowsBetween(0, Window.unboundedFollowing)
    whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(pos).cast("double").alias("p"), F.col(value).alias("v")))
    left, right = F.last(known, True).over(before), F.first(known, True).over(after)
    if period is None:
        a, b = F.coalesce(left, right), F.coalesce(right, left)
    else:
        end, start = F.last(known, True).over(whole), F.first(known, True).over(whole)
        a = F.coalesce(left, F.struct((end["p"] - period).alias("p"), end["v"].alias("v")))
        b = F.coalesce(right, F.struct((start["p"] + period).alias("p"), start["v"].alias("v")))
    line = a["v"] + (b["v"] - a["v"]) * (F.col(pos) - a["p"]) / (b["p"] - a["p"])
    return F.when(F.col(value).isNotNull(), F.col(value)).when(a["p"] == b["p"], a["v"]).otherwise(line)


def circular_filled(grid: DataFrame, g: Grid, min_coverage: float = 0.10) -> DataFrame:
    """All cells; slabs of enough coverage are filled around theta. Columns: cell, r, dense, interpolated."""
    cells = scaffold(grid, g)
    share = F.count("r").over(Window.partitionBy("cloud_id", "i")) / F.lit(float(g.n_theta))
    cells = cells.withColumn("dense", share >= min_coverage)
    new = F.when(F.col("dense"), filled(cells, ["cloud_id", "i"], "j", "r", g.n_theta)).otherwise(F.col("r"))
    return cells.select(*CELL, new.alias("r"), "dense", (F.col("dense") & F.col("r").isNull()).alias("interpolated"))


def along_filled(cells: DataFrame) -> DataFrame:
    """After circular_filled(): cells of sparse slabs are filled along s, where their column has two known ones."""
    known = F.count("r").over(Window.partitionBy("cloud_id", "j"))
    new = F.when(~F.col("dense") & (known >= 2), filled(cells, ["cloud_id", "j"], "i", "r")).otherwise(F.col("r"))
    return cells.select(*CELL, new.alias("r"), "dense", (F.col("interpolated") | (F.col("r").isNull() & new.isNotNull())).alias("interpolated"))


def filled_2d(cells: DataFrame, g: Grid) -> DataFrame:
    """All cells; the unknown ones from their neighbours in s and theta at once, so that wide holes get no ridges.

    Each unknown cell is the mean, by inverse distance in cells, of the nearest known cells before and after it
    along s and around theta (which wraps): exact for radii that are linear in both. Off the end of the domain
    one side along s is missing and the others decide. Cells whose row and column are both empty are then
    filled along s. Only cells are moved, of which a grid has a fixed number.
    """
    period = float(g.n_theta)

    def side(pos: str, keys: list[str], wrap: bool):
        by = Window.partitionBy(*keys).orderBy(pos)
        whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        known = F.when(F.col("r").isNotNull(), F.struct(F.col(pos).cast("double").alias("p"), F.col("r").alias("v")))
        left, right = F.last(known, True).over(by.rowsBetween(Window.unboundedPreceding, 0)), F.first(known, True).over(by.rowsBetween(0, Window.unboundedFollowing))
        if wrap:
            end, start = F.last(known, True).over(whole), F.first(known, True).over(whole)
            left = F.coalesce(left, F.struct((end["p"] - period).alias("p"), end["v"].alias("v")))
            right = F.coalesce(right, F.struct((start["p"] + period).alias("p"), start["v"].alias("v")))
        return left, right

    cells = scaffold(cells, g) if "dense" not in cells.columns else cells
    names = {"i": ["cloud_id", "j"], "j": ["cloud_id", "i"]}
    rows = cells.select(*CELL, "r")
    for pos, keys in names.items():
        a, b = side(pos, keys, pos == "j")
        rows = rows.withColumn(f"{pos}a", a).withColumn(f"{pos}b", b)
    total, weight = F.lit(0.0), F.lit(0.0)
    for pos in names:
        for k in "ab":
            near = F.col(f"{pos}{k}")
            w = F.when(near.isNotNull(), 1 / F.abs(near["p"] - F.col(pos)))
            total, weight = total + F.coalesce(w * near["v"], F.lit(0.0)), weight + F.coalesce(w, F.lit(0.0))
    new = F.coalesce("r", F.when(weight > 0, total / weight))
    rows = rows.select(*CELL, new.alias("r"), F.col("r").isNull().alias("interpolated"))
    last = F.coalesce("r", filled(rows, ["cloud_id", "j"], "i", "r"))
    return rows.select(*CELL, last.alias("r"), "interpolated")


def filled_grid(cloud: DataFrame, g: Grid, gap: float = 0.30, min_coverage: float = 0.10) -> DataFrame:
    """Points to a filled grid: the points are read and shuffled once, into a table of cells that all else works on."""
    return along_filled(circular_filled(kept(bimodal_grid(binned(cloud, g), gap)), g, min_coverage))
