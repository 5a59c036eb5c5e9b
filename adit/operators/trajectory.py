"""Trajectories: steps, arclength, resampling, interpolation, nearest samples, frames."""

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adit.operators import scan
from adit.operators.graph import kept

XYZ = ("x", "y", "z")


def _by(key: str, seq: str = "seq") -> Window:
    return Window.partitionBy(key).orderBy(seq)


def step(key: str = "run_id", seq: str = "seq") -> Column:
    """Distance to the pose before; NULL for the first."""
    return F.sqrt(sum(((F.col(c) - F.lag(c).over(_by(key, seq))) ** 2 for c in XYZ), F.lit(0.0)))


def path_length(traj: DataFrame, key: str = "run_id") -> DataFrame:
    return traj.withColumn("step", step(key)).groupBy(key).agg(F.coalesce(F.sum("step"), F.lit(0.0)).alias("length"), F.count(F.lit(1)).alias("n"))


def loop_closure(traj: DataFrame, key: str = "run_id") -> DataFrame:
    """|last - first|; NULL for fewer than two poses."""
    p = F.struct(*XYZ)
    ends = traj.groupBy(key).agg(F.min_by(p, "seq").alias("a"), F.max_by(p, "seq").alias("b"), F.count(F.lit(1)).alias("n"))
    d = F.sqrt(sum(((F.col(f"b.{c}") - F.col(f"a.{c}")) ** 2 for c in XYZ), F.lit(0.0)))
    return ends.select(key, F.when(F.col("n") >= 2, d).alias("error"))


def without_repeats(traj: DataFrame, least: float = 1e-6, key: str = "run_id") -> DataFrame:
    """Poses that lie more than ``least`` from the one before; the first stays."""
    return traj.withColumn("step", step(key)).where(F.col("step").isNull() | (F.col("step") > least)).drop("step")


def _measured(traj: DataFrame, key: str) -> DataFrame:
    """Poses dealt by ranges, with ``s``, the way to them, and ``total``, that of the run."""
    rows = scan.beside(scan.dealt(traj, key, "seq"), key, "seq", list(XYZ))
    d = F.sqrt(sum(((F.col(c) - F.col(f"before.{c}")) ** 2 for c in XYZ), F.lit(0.0)))
    return scan.accumulated(rows.select(*traj.columns, scan.PART, F.coalesce(d, F.lit(0.0)).alias("step")), key, "seq", "step", "s", "total")


def with_arclength(traj: DataFrame, key: str = "run_id") -> DataFrame:
    """The poses with ``s``, the way to them; in two levels, so that a run of any length is dealt over tasks."""
    return _measured(traj, key).select(*traj.columns, "s")


def resampled(traj: DataFrame, ds: float, key: str = "run_id") -> DataFrame:
    """The polyline at n = max(floor(L / ds) + 1, 4) evenly spaced arclengths; runs of no length are left out.

    Each interval of the polyline produces the samples in it, so that no join is needed; runs are dealt over tasks.
    """
    rows = kept(_measured(traj.select(key, "seq", *XYZ), key).where("total > 0"))
    rows = scan.beside(rows, key, "seq", [*XYZ, "s"]).withColumn("n", F.greatest(F.floor(F.col("total") / ds) + 1, F.lit(4)))
    rows = rows.select(key, "seq", *XYZ, "s", "total", "n", *[F.col(f"after.{c}").alias(c + "2") for c in (*XYZ, "s")]).where("s2 > s")
    gap = F.col("total") / (F.col("n") - 1)
    last = F.col("s2") >= F.col("total")
    k0, k1 = F.ceil(F.col("s") / gap), F.when(last, F.col("n") - 1).otherwise(F.ceil(F.col("s2") / gap) - 1)
    made = rows.withColumn("gap", gap).withColumn("k", F.explode(F.when(k0 <= k1, F.sequence(k0, k1)).otherwise(F.array().cast("array<bigint>"))))
    at = F.least(F.col("k") * F.col("gap"), F.col("total"))
    share = F.least((at - F.col("s")) / (F.col("s2") - F.col("s")), F.lit(1.0))
    return made.select(key, "k", at.alias("s"), *[(F.col(c) + (F.col(c + "2") - F.col(c)) * share).alias(c) for c in XYZ])


def moving(scans: DataFrame, speed: float, key: str = "run_id", t: str = "t") -> DataFrame:
    """Scans whose speed from the scan before reaches ``speed``; the first scan, and those at dt <= 1e-6, stay."""
    by = _by(key, t)
    dt = F.col(t) - F.lag(t).over(by)
    d = F.sqrt(sum(((F.col(c) - F.lag(c).over(by)) ** 2 for c in XYZ), F.lit(0.0)))
    rows = scans.withColumn("dt", dt).withColumn("d", d)
    return rows.where(F.col("dt").isNull() | (F.col("dt") <= 1e-6) | (F.col("d") / F.nullif("dt", F.lit(0.0)) >= speed)).drop("dt", "d")


def in_range(points: DataFrame, near: float, far: float) -> DataFrame:
    """Points with near < |p| < far; NULL and NaN coordinates go."""
    r2 = sum((F.col(c) ** 2 for c in XYZ), F.lit(0.0))
    return points.where((r2 > near**2) & (r2 < far**2) & ~F.isnan(r2))


def transformed(points: DataFrame, m: Sequence[Sequence[float]]) -> DataFrame:
    """Points under the rigid transform of a 4x4 matrix."""
    new = {c: sum((F.lit(float(m[k][n])) * F.col(d) for n, d in enumerate(XYZ)), F.lit(0.0)) + F.lit(float(m[k][3])) for k, c in enumerate(XYZ)}
    return points.select(*[new[c].alias(c) if c in new else F.col(c) for c in points.columns])


def rigid_faults(m: Sequence[Sequence[float]], tol: float = 1e-3) -> list[str]:
    """What keeps a 4x4 matrix from being a rigid transform: a warning each."""
    r = [list(map(float, row[:3])) for row in m[:3]]
    dot = [[sum(r[k][a] * r[k][b] for k in range(3)) for b in range(3)] for a in range(3)]
    off = max(abs(dot[a][b] - (a == b)) for a in range(3) for b in range(3))
    det = r[0][0] * (r[1][1] * r[2][2] - r[1][2] * r[2][1]) - r[0][1] * (r[1][0] * r[2][2] - r[1][2] * r[2][0]) + r[0][2] * (r[1][0] * r[2][1] - r[1][1] * r[2][0])
    return [f"axes are off by {off:.3g}"] * (off >= tol) + [f"determinant is {det:.6g}"] * (abs(det - 1) >= tol)


def interpolated(asked: DataFrame, traj: DataFrame, values: tuple[str, ...] = XYZ, key: str = "run_id", t: str = "t") -> DataFrame:
    """``values`` of the trajectory at the asked times, linear between poses, held at the ends.

    Both tables are laid on one time axis and dealt by ranges of it; the poses before and after are
    carried over within a range, and from range to range as a row each: no range join, and no task with all of a run.
    """
    pose = F.struct(F.col(t).alias("p"), *values)
    every = traj.select(key, t, pose.alias("pose"), F.lit(False).alias("ask")).unionByName(
        asked.select(key, t, F.lit(None).cast(traj.select(pose.alias("x")).schema["x"].dataType).alias("pose"), F.lit(True).alias("ask"))
    )
    rows = scan.carried(scan.dealt(every, key, t), key, t, "pose").where("ask")
    rows = rows.select(key, t, F.coalesce("before", "after").alias("a"), F.coalesce("after", "before").alias("b"))
    share = F.when(F.col("b.p") > F.col("a.p"), (F.col(t) - F.col("a.p")) / (F.col("b.p") - F.col("a.p"))).otherwise(0.0)
    return rows.select(key, t, *[(F.col(f"a.{c}") + (F.col(f"b.{c}") - F.col(f"a.{c}")) * share).alias(c) for c in values])


def nearest(points: DataFrame, samples: DataFrame, max_samples: int = 100_000, block: int = 32) -> DataFrame:
    """For each point the sample (k, px, py, pz) at the smallest distance, the lowest k among equals, and the distance.

    Samples of a centreline are few; their number is checked, and they are sent
    to every task, so that points are read once and never shuffled. Neighbouring samples lie close, so each ``block`` of them
    has a ball about it; a point is compared only with the blocks whose ball may be nearer
    than the farthest side of its nearest one. Points without coordinates have no sample.
    """
    few = samples.select("k", "px", "py", "pz").orderBy("k").limit(max_samples + 1).toPandas()
    if len(few) > max_samples:
        raise ValueError(f"more than {max_samples} samples; thin the centreline or raise max_samples")
    k, p = few["k"].to_numpy(np.int64), few[["px", "py", "pz"]].to_numpy(float)
    cuts = np.arange(0, len(p), block)
    centre = np.array([p[a : a + block].mean(0) for a in cuts]).reshape(-1, 3)
    ball = np.array([np.sqrt(((p[a : a + block] - c) ** 2).sum(1).max()) for a, c in zip(cuts, centre)]) * (1 + 1e-9) + 1e-9
    schema = T.StructType([*points.schema.fields, T.StructField("k", T.LongType()), T.StructField("distance", T.DoubleType())])

    def search(batches):
        for batch in batches:
            q = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in XYZ])
            best, at = np.full(len(q), np.inf), np.full(len(q), -1, np.int64)
            for lo in range(0, len(q) if len(p) else 0, 4096):
                part = q[lo : lo + 4096]
                away = np.sqrt(((part[:, None, :] - centre[None, :, :]) ** 2).sum(2))
                reach = (away + ball).min(1) * (1 + 1e-9)
                for b, a in enumerate(cuts):  # in order of k, so that an equal distance later changes nothing
                    rows = np.flatnonzero(away[:, b] - ball[b] <= reach)
                    if not len(rows):
                        continue
                    x = p[None, a : a + block]
                    d2 = (part[rows, None, 0] - x[..., 0]) ** 2 + (part[rows, None, 1] - x[..., 1]) ** 2 + (part[rows, None, 2] - x[..., 2]) ** 2
                    j = d2.argmin(1)
                    d = d2[np.arange(len(rows)), j]
                    new = d < best[lo + rows]
                    best[lo + rows[new]], at[lo + rows[new]] = d[new], k[a + j[new]]
            none = at < 0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, mask=none), pa.array(np.sqrt(best), mask=none)], [*batch.schema.names, "k", "distance"])

    return points.mapInArrow(search, schema)


def cylindrical(points: DataFrame, frame: DataFrame) -> DataFrame:
    """(s, r, theta) of points by their nearest sample of a frame (k, s, p*, t*, a*, b*: position, tangent, up, side).

    ``off``: how far along the tangent the point lies from its sample; ``dz``: how high above the line, square to it.
    """
    near = nearest(points, frame.select("k", "px", "py", "pz")).drop("distance")
    line = frame.select("k", F.col("s").alias("s0"), *[f"{v}{c}" for v in "ptab" for c in XYZ])
    rows = near.join(F.broadcast(line), "k")  # as few as nearest() has checked
    v = {c: F.col(c) - F.col(f"p{c}") for c in XYZ}
    dot = lambda u: sum((v[c] * F.col(f"{u}{c}") for c in XYZ), F.lit(0.0))
    along = dot("t")
    across = {c: v[c] - along * F.col(f"t{c}") for c in XYZ}
    r = F.sqrt(sum((across[c] ** 2 for c in XYZ), F.lit(0.0)))
    keep = [c for c in points.columns if c not in XYZ]
    return rows.select(*keep, (F.col("s0") + along).alias("s"), r.alias("r"), F.degrees(F.atan2(dot("b"), dot("a"))).alias("theta"), F.abs(along).alias("off"), across["z"].alias("dz"))


def from_cylindrical(points: DataFrame, frame: DataFrame) -> DataFrame:
    """x, y, z of (s, r, theta) on an evenly spaced frame, its vectors interpolated at s (ends held) and made unit again."""
    ends = frame.agg(F.min("s").alias("s_lo"), F.max("s").alias("s_hi"), F.count(F.lit(1)).alias("n"))
    rows = points.crossJoin(F.broadcast(ends))
    ds = (F.col("s_hi") - F.col("s_lo")) / (F.col("n") - 1)
    at = F.least(F.greatest((F.col("s") - F.col("s_lo")) / ds, F.lit(0.0)), F.col("n") - 1.0)
    lo = F.least(F.floor(at), F.col("n") - 2)
    rows = rows.withColumn("lo", lo).withColumn("share", at - lo)
    names = [f"{v}{c}" for v in "pab" for c in XYZ]
    rank = frame.select((F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("s")) - 1).cast("long").alias("lo"), *names)
    nxt = rank.select((F.col("lo") - 1).alias("lo"), *[F.col(c).alias(c + "2") for c in names])
    rows = rows.join(F.broadcast(rank.join(nxt, "lo")), "lo")
    mid = {c: F.col(c) + (F.col(c + "2") - F.col(c)) * F.col("share") for c in names}
    size = {v: F.sqrt(sum((mid[v + c] ** 2 for c in XYZ), F.lit(0.0))) for v in "ab"}
    cos, sin = F.cos(F.radians("theta")), F.sin(F.radians("theta"))
    out = [(mid["p" + c] + F.col("r") * (cos * mid["a" + c] / size["a"] + sin * mid["b" + c] / size["b"])).alias(c) for c in XYZ]
    return rows.select(*points.columns, *out)


def outbound_leg(traj: DataFrame, key: str = "run_id", least: int = 10) -> DataFrame:
    """Poses up to the one farthest from the start along the run's main axis (at least ``least`` + 1, as far as there are).

    The axis is the leading eigenvector of the 3x3 covariance, by power
    iterations on its six sums, so that no pose leaves its task's columns.
    """
    mean = Window.partitionBy(key)
    rows = traj.select("*", *[(F.col(c) - F.avg(c).over(mean)).alias(f"c{c}") for c in XYZ], F.count(F.lit(1)).over(mean).alias("n"))
    cov = {a + b: F.avg(F.col(f"c{a}") * F.col(f"c{b}")).over(mean) for a in XYZ for b in XYZ if a <= b}
    rows = rows.select("*", *[v.alias(k) for k, v in cov.items()])
    get = lambda a, b: F.col(min(a, b) + max(a, b))
    start = F.array(*[F.lit(v) for v in (0.5773, 0.5771, 0.5777)])

    def power(v, _):
        w = [sum((get(a, b) * v[n] for n, b in enumerate(XYZ)), F.lit(0.0)) for a in XYZ]
        size = F.sqrt(sum((u**2 for u in w), F.lit(0.0)))
        return F.array(*[F.when(size > 0, u / size).otherwise(v[n]) for n, u in enumerate(w)])

    axes = rows.groupBy(key).agg(*[F.first(k).alias(k) for k in cov]).withColumn("axis", F.aggregate(F.sequence(F.lit(1), F.lit(300)), start, power)).select(key, "axis")
    rows = rows.drop(*cov).join(axes, key)
    proj = sum((F.col(f"c{c}") * F.col("axis")[n] for n, c in enumerate(XYZ)), F.lit(0.0))
    rows = rows.withColumn("proj", proj)
    far = F.abs(F.col("proj") - F.first("proj").over(_by(key)))
    rows = rows.withColumn("far", far).withColumn("at", F.row_number().over(_by(key)) - 1)
    turn = F.max_by("at", F.struct("far", -F.col("at"))).over(mean)
    rows = rows.withColumn("turn", F.greatest(turn, F.least(F.col("n") - 1, F.lit(least))))
    return rows.where("at <= turn").select(*traj.columns)


def turned_round(frame: DataFrame) -> DataFrame:
    """A centreline in the other direction: s becomes L - s, tangent and side are negated, up is kept."""
    length = F.max("s").over(Window.partitionBy(F.lit(1)))
    new = {"s": length - F.col("s"), **{f"{v}{c}": -F.col(f"{v}{c}") for v in "tb" for c in XYZ}}
    return frame.select(*[new[c].alias(c) if c in new else F.col(c) for c in frame.columns])


def gravity_frame(line: DataFrame) -> DataFrame:
    """Up and side vectors (a*, b*) of samples with unit tangents t*: up is vertical less its part along the tangent."""
    up = {"x": -F.col("tz") * F.col("tx"), "y": -F.col("tz") * F.col("ty"), "z": 1 - F.col("tz") ** 2}
    size = F.sqrt(sum((up[c] ** 2 for c in XYZ), F.lit(0.0)))
    rows = line.select("*", *[(up[c] / size).alias(f"a{c}") for c in XYZ])
    return with_side(rows)


def with_side(line: DataFrame) -> DataFrame:
    """The samples with side vectors b* = t x a, of unit length."""
    t, a = (lambda c: F.col(f"t{c}")), (lambda c: F.col(f"a{c}"))
    side = {"x": t("y") * a("z") - t("z") * a("y"), "y": t("z") * a("x") - t("x") * a("z"), "z": t("x") * a("y") - t("y") * a("x")}
    size = F.sqrt(sum((v**2 for v in side.values()), F.lit(0.0)))
    return line.select("*", *[(side[c] / size).alias(f"b{c}") for c in XYZ])


def curvature(line: DataFrame, key: str = "run_id") -> DataFrame:
    """|d1 x d2| / max(|d1|^3, 1e-12) by central differences along evenly spaced samples; inner samples only."""
    by = _by(key, "k")
    d1 = {c: (F.lead(c).over(by) - F.lag(c).over(by)) / 2 for c in XYZ}
    d2 = {c: F.lead(c).over(by) - 2 * F.col(c) + F.lag(c).over(by) for c in XYZ}
    rows = line.select(key, "k", *[d1[c].alias(f"u{c}") for c in XYZ], *[d2[c].alias(f"w{c}") for c in XYZ]).where("ux is not null")
    cross = F.expr("sqrt(pow(uy*wz - uz*wy, 2) + pow(uz*wx - ux*wz, 2) + pow(ux*wy - uy*wx, 2))")
    return rows.select(key, "k", (cross / F.greatest(F.expr("pow(ux*ux + uy*uy + uz*uz, 1.5e0)"), F.lit(1e-12))).alias("kappa"))


def slerp(a: list[Column], b: list[Column], share: Column) -> list[Column]:
    """Spherical interpolation of unit quaternions on the shorter arc; near-equal ones are mixed linearly."""
    dot = sum((p * q for p, q in zip(a, b)), F.lit(0.0))
    sign = F.when(dot < 0, -1.0).otherwise(1.0)
    angle = F.acos(F.least(F.abs(dot), F.lit(1.0)))
    near = F.sin(angle) < 1e-9
    wa = F.when(near, 1 - share).otherwise(F.sin((1 - share) * angle) / F.sin(angle))
    wb = F.when(near, share).otherwise(F.sin(share * angle) / F.sin(angle)) * sign
    return [wa * p + wb * q for p, q in zip(a, b)]


def rotated(v: list[Column], q: list[Column]) -> list[Column]:
    """Vectors turned by unit quaternions (x, y, z, w)."""
    x, y, z, w = q
    t = [2 * (y * v[2] - z * v[1]), 2 * (z * v[0] - x * v[2]), 2 * (x * v[1] - y * v[0])]
    return [v[0] + w * t[0] + (y * t[2] - z * t[1]), v[1] + w * t[1] + (z * t[0] - x * t[2]), v[2] + w * t[2] + (x * t[1] - y * t[0])]


def deskewed(points: DataFrame, traj: DataFrame, key: str = "run_id", t: str = "t", bucket_s: float = 10.0) -> DataFrame:
    """Points (key, t, x, y, z in the sensor's frame) into the world at the pose of their own time; times outside the trajectory go.

    Points and pieces of the trajectory between two poses are laid on one time axis, in buckets of ``bucket_s``
    (a piece in each bucket that it reaches into), and the piece is carried to the points after its start by a window: one
    shuffle by run and bucket, no range join, and a run of any length in many tasks.
    """
    names = ("x", "y", "z", "qx", "qy", "qz", "qw")
    by = Window.partitionBy(key).orderBy(t)
    slot = lambda c: F.floor(F.col(c) / F.lit(bucket_s))
    pieces = traj.select(key, F.col(t).alias("t0"), F.lead(t).over(by).alias("t1"), *[F.col(c).alias(c + "0") for c in names], *[F.lead(c).over(by).alias(c + "1") for c in names]).where("t1 > t0")
    piece = F.struct("t0", "t1", *[c + n for c in names for n in "01"])
    pieces = pieces.select(key, piece.alias("piece"), F.col("t0"), F.explode(F.sequence(slot("t0"), slot("t1"))).alias("slot"))
    at = F.greatest(F.col("t0"), F.col("slot") * F.lit(bucket_s))
    none = F.lit(None).cast(pieces.schema["piece"].dataType)
    rest = [c for c in points.columns if c not in (key, t, *XYZ)]
    asked = points.where(F.col(t).isNotNull() & ~F.isnan(t)).select(key, slot(t).alias("slot"), F.col(t).cast("double").alias("at"), none.alias("piece"), *XYZ, *rest)
    every = pieces.select(key, "slot", at.alias("at"), "piece").unionByName(asked, allowMissingColumns=True)
    # pieces stand before points of their time; of those that begin together at a bucket's edge the later one counts
    order = Window.partitionBy(key, "slot").orderBy("at", F.coalesce("piece.t0", F.lit(float("inf"))))
    carried = F.last("piece", True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    both = every.withColumn("p", carried).where(F.col("piece").isNull() & (F.col("at") <= F.col("p.t1")))
    share = (F.col("at") - F.col("p.t0")) / (F.col("p.t1") - F.col("p.t0"))
    q = slerp([F.col(f"p.{c}0") for c in names[3:]], [F.col(f"p.{c}1") for c in names[3:]], share)
    world = rotated([F.col(c) for c in XYZ], q)
    return both.select(key, F.col("at").alias(t), *[(w + F.col(f"p.{c}0") + (F.col(f"p.{c}1") - F.col(f"p.{c}0")) * share).alias(c) for w, c in zip(world, XYZ)], *rest)
