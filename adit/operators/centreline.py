"""The centreline of a tunnel from one trajectory: a few hundred ordered points, fitted on the driver, used as a small table.

Every trajectory is thinned to even arclength steps by Spark before it comes
here, and ``most`` checks its length. What is not sequential (frames, curvature, residuals) is
columns of trajectory.py.
"""

import logging

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from adit.operators import trajectory
from adit.operators.spline import Spline, smoothing, smoothings

log = logging.getLogger(__name__)


def moving_frame(p: np.ndarray, t: np.ndarray, up: np.ndarray) -> np.ndarray:
    """Rotation-minimising reference vectors along a line, by double reflection, from ``up`` at its start, made square to the tangent at each step."""
    r = np.empty_like(p)
    r[0] = up - (up @ t[0]) * t[0]
    r[0] /= np.linalg.norm(r[0])
    for k in range(len(p) - 1):
        v = p[k + 1] - p[k]
        c = v @ v
        ref, tan = (r[k] - 2 / c * (v @ r[k]) * v, t[k] - 2 / c * (v @ t[k]) * v) if c > 0 else (r[k], t[k])
        w = t[k + 1] - tan
        c = w @ w
        turned = ref - 2 / c * (w @ ref) * w if c > 0 else ref
        turned = turned - (turned @ t[k + 1]) * t[k + 1]
        r[k + 1] = turned / np.linalg.norm(turned)
    return r


def fitted(points: np.ndarray, factor: float) -> Spline:
    """The smoothing spline whose squared residuals sum to factor * n."""
    return smoothing(points, max(factor, 0.0) * len(points))[0]


def fit(points: np.ndarray, factor: float = 0.05, ds: float = 0.10) -> list[tuple]:
    """Rows (k, s, p*, t*): places and unit tangents of the smoothed line at even arclengths."""
    line = fitted(points, factor)
    fine = np.linspace(0, 1, max(5 * len(points), 2000))
    arc = np.concatenate([[0.0], np.cumsum(np.linalg.norm(np.diff(line.at(fine), axis=0), axis=1))])
    even = np.linspace(0, arc[-1], max(int(arc[-1] // ds) + 1, 2))
    u = np.interp(even, arc, fine)
    at, slope = line.at(u), line.at(u, 1)
    t = slope / np.maximum(np.linalg.norm(slope, axis=1, keepdims=True), 1e-300)
    return [(k, float(even[k]), *map(float, (*at[k], *t[k]))) for k in range(len(even))]


_PLACES = ", ".join(f"{v}{c} double" for v in "pt" for c in "xyz")


def framed(spark: SparkSession, rows: list[tuple], gravity: bool = True) -> DataFrame:
    """The frame table (k, s, p*, t*, a*, b*) of fit()'s rows: up and side from gravity, or without twist from the start."""
    line = spark.createDataFrame(rows, f"k long, s double, {_PLACES}")
    if gravity:
        return trajectory.gravity_frame(line)
    x = np.array(rows)
    t = x[:, 5:8]
    a = moving_frame(x[:, 2:5], t, np.array([0.0, 0, 1]) if abs(t[0, 2]) < 0.9 else np.array([1.0, 0, 0]))
    up = spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(a)], "k long, ax double, ay double, az double")
    return trajectory.with_side(line.join(up, "k"))


def measured(frame: DataFrame, leg: DataFrame) -> dict[str, float]:
    """Length, RMS distance of the leg from the line, largest curvature and largest tilt of the tangent from level, in degrees."""
    near = trajectory.nearest(leg.select(*trajectory.XYZ), frame)
    line = frame.select(F.lit(0).alias("run_id"), "k", *[F.col("p" + c).alias(c) for c in trajectory.XYZ])
    ends = frame.agg(F.max("s").alias("length_m"), F.max(F.degrees(F.asin(F.least(F.abs("tz"), F.lit(1.0))))).alias("tilt_max_deg")).first()
    kappa = trajectory.curvature(line).agg(F.max("kappa")).first()[0]
    return {"length_m": ends.length_m, "fit_rms_m": near.agg(F.sqrt(F.avg(F.col("distance") ** 2))).first()[0], "kappa_max_1pm": kappa, "tilt_max_deg": ends.tilt_max_deg}


def thinned(traj: DataFrame, step: float = 0.5, most: int = 20_000) -> DataFrame:
    """The outbound leg of one run at even arclengths, with its number of points checked."""
    leg = trajectory.resampled(trajectory.without_repeats(trajectory.outbound_leg(traj)), step)
    n = leg.count()
    if not 4 <= n <= most:
        raise ValueError(f"{n} points after thinning; between 4 and {most} are needed")
    return leg


def centreline(spark: SparkSession, traj: DataFrame, step: float = 0.5, factor: float = 0.05, ds: float = 0.10, gravity: bool = True, most: int = 20_000, toward: tuple[float, float, float] | None = None) -> tuple[DataFrame, dict]:
    """The frame table of one run's outbound leg, for trajectory.cylindrical(), and what measured() says of it, with ``doubts``.

    ``toward``: a point that is to lie in the farther half; else the line is turned round.
    """
    leg = thinned(traj, step, most)
    points = leg.orderBy("k").select("x", "y", "z").toPandas().to_numpy()
    frame = framed(spark, fit(points, factor, ds), gravity)
    info = measured(frame, leg)
    if toward is not None:
        there = spark.createDataFrame([tuple(map(float, toward))], "x double, y double, z double")
        if trajectory.cylindrical(there, frame).first().s < info["length_m"] / 2:
            frame = trajectory.turned_round(frame)
    return frame, info | {"doubts": doubts(info)}


#: Above these a centreline is doubtful: curvature in 1/m, RMS distance of the leg in m, tilt of the tangent in degrees.
LIMITS = {"kappa_max_1pm": 0.50, "fit_rms_m": 0.30, "tilt_max_deg": 75.0}


def doubts(info: dict[str, float], limits: dict[str, float] = LIMITS) -> list[str]:
    """What of measured() is above its limit, as text; each is also a warning."""
    why = {"kappa_max_1pm": "the line has a kink, and (s, theta) near it mean little", "fit_rms_m": "the line does not follow the leg", "tilt_max_deg": "up is ill defined"}
    said = [f"{k} is {info[k]:.4g}, above {v:g}: {why[k]}" for k, v in limits.items() if (info.get(k) or 0) > v]
    for text in said:
        log.warning("centreline: %s", text)
    return said


#: Rows of runs, as they came and thinned, that a task fits at once, unless one run has more.
FITTED_ROWS = 100_000


def sweep(legs: DataFrame, factors: tuple[float, ...] = (0.01, 0.05, 0.2), steps: tuple[float, ...] = (0.25, 0.5, 1.0), key: str = "run_id", most: int = 20_000, together: int = FITTED_ROWS) -> DataFrame:
    """(key, factor, ds, n, knots, length_m, kappa_max_1pm, fit_rms_m): what smoothing does to the outbound leg of each run.

    ``legs``: (key, seq, x, y, z). A leg is thinned to every step by Spark; a run is fitted in one task, its number of points checked, and
    a task fits many runs at once, of about ``together`` rows. The RMS is that of the leg as it came. Runs of fewer than four points after thinning have no row.
    """
    raw = legs.select(key, F.lit(0.0).alias("ds"), F.col("seq").cast("long").alias("k"), *trajectory.XYZ)
    for step in steps:
        thin = trajectory.resampled(trajectory.without_repeats(legs, key=key), step, key)
        raw = raw.unionByName(thin.select(key, F.lit(float(step)).alias("ds"), F.col("k").cast("long").alias("k"), *trajectory.XYZ))
    limit = most * (len(steps) + 1)

    def fits(table: pa.Table) -> pa.RecordBatch:
        """The rows of whole runs, one run after another."""
        run, ds = _runs(table.column(key)), table.column("ds").to_numpy()
        xyz = np.column_stack([table.column(c).to_numpy().astype(float) for c in trajectory.XYZ])
        cuts = np.concatenate([[0], np.flatnonzero((run[1:] != run[:-1]) | (ds[1:] != ds[:-1])) + 1, [len(run)]])
        legs, asked = {}, []
        for a, b in zip(cuts[:-1], cuts[1:]):
            if ds[a] == 0:
                legs[run[a]] = xyz[a:b]
            elif b - a >= 4:
                asked += [(a, b, factor) for factor in factors]
        lines = smoothings([xyz[a:b] for a, b, _ in asked], [max(factor, 0.0) * (b - a) for a, b, factor in asked])
        made = [(factor, ds[a], b - a, *_told(line, legs[run[a]], b - a)) for (a, b, factor), (line, _) in zip(asked, lines)]
        columns = [pa.array(x, t) for x, t in zip(zip(*made) if made else [()] * 7, (pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()))]
        named = table.column(key).take(pa.array([a for a, _, _ in asked], pa.int64())).combine_chunks()
        return pa.RecordBatch.from_arrays([named, *columns], [key, "factor", "ds", "n", "knots", "length_m", "kappa_max_1pm", "fit_rms_m"])

    def all_fits(batches):
        waiting, n = [], 0
        for batch in batches:
            waiting.append(batch)
            n += len(batch)
            if n < together:
                continue
            table = pa.Table.from_batches(waiting)
            run = _runs(table.column(key))
            last = int(np.flatnonzero(np.append(True, run[1:] != run[:-1]))[-1])
            if n - last > limit:
                raise ValueError(f"{n - last} points of one run; {most} a step is the most")
            if last:
                yield checked(table.slice(0, last), run[:last])
            waiting, n = table.slice(last).to_batches(), n - last
        if n:
            table = pa.Table.from_batches(waiting)
            yield checked(table, _runs(table.column(key)))

    def checked(table: pa.Table, run: np.ndarray) -> pa.RecordBatch:
        longest = int(np.bincount(run).max())
        if longest > limit:
            raise ValueError(f"{longest} points of one run; {most} a step is the most")
        return fits(table)

    rows = raw.repartition(key).sortWithinPartitions(key, "ds", "k")
    return rows.mapInArrow(all_fits, f"{key} {legs.schema[key].dataType.simpleString()}, factor double, ds double, n long, knots long, length_m double, kappa_max_1pm double, fit_rms_m double")


def _runs(keys: pa.ChunkedArray) -> np.ndarray:
    """A number for each run; a null is a run like any other."""
    return keys.combine_chunks().dictionary_encode("encode").indices.to_numpy()


def _told(line: Spline, leg: np.ndarray, n: int) -> tuple:
    """Knots, length, largest curvature and RMS distance of the leg, at places five times as many as points."""
    u = np.linspace(0, 1, max(5 * n, 2000))
    at, middle, near = line.at(u), leg.mean(0), []
    x = np.ascontiguousarray((at - middle).T)
    half = 0.5 * (x**2).sum(0)
    for a in range(0, len(leg), 64):
        some = leg[a : a + 64]
        place = (half - (some - middle) @ x).argmin(1)  # of the least distance; the distance itself is then taken without cancellation
        near.append(((some - at[place]) ** 2).sum(1))
    return len(line.knots), np.linalg.norm(np.diff(at, axis=0), axis=1).sum(), line.curvature(u).max(), np.sqrt(np.concatenate(near).mean())


def curvature_peaks(kappas: DataFrame, key: str = "run_id", share: float = 0.9) -> DataFrame:
    """Local maxima of curvature (key, k, kappa) that reach the ``share`` percentile of their run.

    A flat top counts once, at its middle (the lower one of two); tops at either end of a run are none.
    """
    by = Window.partitionBy(key).orderBy("k")
    new = F.coalesce(F.col("kappa") != F.lag("kappa").over(by), F.lit(True)).cast("int")
    flat = kappas.withColumn("top", F.sum(new).over(by.rowsBetween(Window.unboundedPreceding, 0))).groupBy(key, "top").agg(F.min("k").alias("lo"), F.max("k").alias("hi"), F.first("kappa").alias("kappa"))
    order = Window.partitionBy(key).orderBy("top")
    peaks = flat.withColumn("before", F.lag("kappa").over(order)).withColumn("after", F.lead("kappa").over(order)).where("kappa > before and kappa > after")
    limit = kappas.groupBy(key).agg(F.percentile("kappa", F.lit(float(share))).alias("limit"))
    return peaks.join(limit, key).where("kappa >= limit").select(key, F.expr("(lo + hi) div 2").alias("k"), "kappa")
