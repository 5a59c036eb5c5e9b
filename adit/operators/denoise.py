"""Outlier removal and scan maps: distances to the nearest neighbours in a split of space by counts, and scans into one map."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adit.operators import kd, trajectory
from adit.operators.graph import kept

XYZ = ["x", "y", "z"]


#: Points that a split of space is found from, and the least of them that a leaf has.
SAMPLE, LEAST = 100_000, 16


def splits(points: DataFrame, leaf: int) -> dict:
    """A split of space for each cloud, into leaves of about ``leaf`` points, found from SAMPLE points at most of all clouds.

    Clouds that the sample lacks have one leaf. Leaves grow with very many points, as a split has at most SAMPLE / LEAST of them.
    """
    total = points.count()
    every = max(1, -(-2 * total // SAMPLE))
    some = points.where(F.pmod(F.xxhash64("pid", *XYZ), F.lit(every)) == 0).select("cloud_id", *XYZ).limit(SAMPLE).toPandas()
    return {c: kd.Split(p[XYZ].to_numpy(float), max(leaf // every, LEAST if every > 1 else leaf)) for c, p in some.groupby("cloud_id", dropna=False)}


def neighbour_distances(points: DataFrame, k: int, leaf: int = 4096) -> DataFrame:
    """(cloud_id, pid, d): the mean distance of each point to its k nearest others, exactly; ``pid`` names a point.

    Space is split by counts, so that dense and sparse places give tasks of like size, and comparisons of a point are bounded whatever
    the density. Points are first compared within their leaf. Only those whose ball, up to the k-th of these, reaches into other leaves
    ask there too, once. The split is found from a sample, but the result does not depend on it. Points without
    coordinates have d = 0.
    """
    spark, points = points.sparkSession, points.select("cloud_id", "pid", *[F.col(c).cast("double").alias(c) for c in XYZ])
    there = F.lit(True)
    for c in XYZ:
        there = there & F.col(c).isNotNull() & ~F.isnan(c)
    placed = points.where(there)
    split = spark.sparkContext.broadcast(splits(placed, leaf))
    kind = placed.schema["cloud_id"].dataType.simpleString()
    of = lambda cloud: split.value.get(cloud) or kd.Split(np.zeros((0, 3)), 1)
    place = lambda t: np.column_stack([t.column(c).to_numpy() for c in XYZ]).reshape(-1, 3)
    ids = lambda t: t.column("pid").to_numpy()

    def lists(x: np.ndarray, most: np.ndarray | None = None) -> pa.ListArray:
        there = np.isfinite(x) if most is None else np.isfinite(x) & (x <= most[:, None])
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(there.sum(1))), pa.int32()), pa.array(x[there]))

    def to_leaf(batches):
        for batch in batches:
            clouds, out = np.array(batch.column("cloud_id").to_pylist(), object), np.zeros(len(batch), np.int32)
            xyz = place(batch)
            for c in set(clouds):
                rows = np.flatnonzero(clouds == c)
                out[rows] = of(c).leaf(xyz[rows])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, "leaf"])

    def within(key, table):
        p, cloud, own = place(table), key[0].as_py(), key[1].as_py()
        near, _ = kd.nearest(p, ids(table), p, ids(table), k)
        rows, leaves = of(cloud).touched(p, near.max(1) if len(near) else np.zeros(0))
        order = np.argsort(rows, kind="stable")
        rows, leaves = rows[order], leaves[order]
        rows, leaves = rows[leaves != own], leaves[leaves != own]
        offs = np.searchsorted(rows, np.arange(len(p) + 1))
        asks = pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(leaves.astype(np.int32)))
        return pa.table({**{c: table.column(c) for c in ("cloud_id", "pid", *XYZ)}, "near": lists(near), "asks": asks})

    def across(asked, table):
        far = asked.column("far").to_numpy()
        near, _ = kd.nearest(place(asked), ids(asked), place(table), ids(table), k, bound=far)
        return pa.table({"cloud_id": asked.column("cloud_id"), "pid": asked.column("pid"), "near": lists(near, far)})

    columns = f"cloud_id {kind}, pid long, x double, y double, z double"
    home = kept(placed.mapInArrow(to_leaf, f"{columns}, leaf int"))
    first = kept(home.groupBy("cloud_id", "leaf").applyInArrow(within, f"{columns}, near array<double>, asks array<int>"))
    far = F.when(F.size("near") == k, F.array_max("near")).otherwise(F.lit(float("inf"))).alias("far")  # a ball that k points lie in already
    asks = first.where("size(asks) > 0").select("cloud_id", "pid", *XYZ, far, F.explode("asks").alias("leaf"))
    met = asks.groupBy("cloud_id", "leaf").cogroup(home.groupBy("cloud_id", "leaf")).applyInArrow(across, f"cloud_id {kind}, pid long, near array<double>")
    every = first.where("size(asks) > 0").select("cloud_id", "pid", "near").unionByName(met).groupBy("cloud_id", "pid").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))
    every = every.unionByName(first.where("size(asks) = 0").select("cloud_id", "pid", "near"))
    n = F.size("near")
    mean = F.when(n > 0, F.aggregate(F.array_sort("near"), F.lit(0.0), lambda a, x: a + x) / n).otherwise(0.0)
    return every.select("cloud_id", "pid", mean.alias("d")).unionByName(points.where(~there).select("cloud_id", "pid", F.lit(0.0).alias("d")))


def without_outliers(points: DataFrame, k: int = 20, ratio: float = 2.0, leaf: int = 4096) -> DataFrame:
    """Points whose mean neighbour distance is at most mean + ratio * deviation over the cloud; repeated points are points each."""
    named = kept(points.withColumn("nth", F.monotonically_increasing_id()))
    d = kept(neighbour_distances(named.select("cloud_id", F.col("nth").alias("pid"), *XYZ), k, leaf))  # for the limit, and to be held against it
    limit = d.groupBy("cloud_id").agg((F.avg("d") + ratio * F.stddev_samp("d")).alias("limit"))
    fine = d.join(F.broadcast(limit), "cloud_id").where("limit is null or d <= limit").select("cloud_id", F.col("pid").alias("nth"))  # a row a cloud
    return named.join(fine, ["cloud_id", "nth"], "left_semi").select(*points.columns)


def in_window(scans: DataFrame, traj_range: tuple[float, float], slack: float = 0.2) -> DataFrame:
    """Scans within the trajectory's times, or up to ``slack`` seconds off them."""
    return scans.where(F.col("t").between(traj_range[0] - slack, traj_range[1] + slack))


def frame_counts(scans: DataFrame, traj_range: tuple[float, float], slack: float = 0.2) -> DataFrame:
    """Scans read, with points, outside the trajectory's times, and stationary (``moving`` says not)."""
    inside = F.col("t").between(traj_range[0] - slack, traj_range[1] + slack)
    return scans.agg(F.count(F.lit(1)).alias("read"), F.count_if(F.col("n_points") > 0).alias("parsed"), F.count_if(~inside).alias("out_of_range"), F.count_if(inside & ~F.col("moving")).alias("stationary"), F.count_if(inside & F.col("moving")).alias("kept"))


def dense_map(points: DataFrame, traj: DataFrame, near: float, far: float, h: float, key: str = "run_id") -> DataFrame:
    """Raw points (key, t, x, y, z, and intensity or not) into one thinned map: range filter, pose at each point's time, a mean for each cell of edge h."""
    world = trajectory.deskewed(trajectory.in_range(points, near, far), traj, key)
    cell, values = [F.floor(F.col(c) / h).alias(f"i{c}") for c in "xyz"], [*XYZ, *[c for c in ("intensity",) if c in points.columns]]
    return world.select(key, *values, *cell).groupBy(key, "ix", "iy", "iz").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in values])
