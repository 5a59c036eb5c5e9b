"""What closes an open survey: the domain between two end planes, floor grids and caps over mouths."""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adit.operators import trajectory


def _projected(points: DataFrame, frame: DataFrame) -> list:
    return trajectory.cylindrical(points.select("idx", "x", "y", "z"), frame).select("idx", "s", "r").orderBy("idx").limit(1000).collect()


def domain(targets: DataFrame, caps: DataFrame | None, frame: DataFrame, mode: str = "auto", start: int = 0, end: int = 7, max_r: float = 5.0) -> tuple[tuple[float, float], dict]:
    """((s0, s1), info): where the end planes stand on a centreline, and why.

    target_planes: at two surveyed targets, comparable within one campaign; feature_planes: at two cap
    points, comparable between campaigns, each near the line; auto: at caps, if there are any. The
    targets' domain is told in any case. Targets and caps are (idx, x, y, z).
    """
    at = {r.idx: r.s for r in _projected(targets.where(F.col("idx").isin(start, end)), frame)}
    if set(at) != {start, end}:
        raise ValueError(f"targets {start} and {end} are to bound the domain; found {sorted(at)}")
    told = (min(at.values()), max(at.values()))
    if mode == "auto":
        mode = "feature_planes" if caps is not None else "target_planes"
    info = {"cap_mode": mode, "target_domain": told}
    if mode == "target_planes":
        return told, info
    if caps is None:
        raise ValueError("feature_planes needs two cap points, and there are none")
    ends = _projected(caps, frame)
    if len(ends) != 2:
        raise ValueError(f"{len(ends)} caps; a domain has two ends")
    if far := [r for r in ends if r.r > max_r]:
        raise ValueError("caps lie " + ", ".join(f"{r.r:.2f} m" for r in far) + f" off the centreline; {max_r} m are allowed")
    s = sorted(r.s for r in ends)
    return (s[0], s[1]), info | {"caps": [{"s_m": r.s, "r_offset_m": r.r} for r in ends], "shift_vs_targets_m": {"start": s[0] - told[0], "end": s[1] - told[1]}}


def above(points: DataFrame, floor: float, slack: float = 1e-6) -> DataFrame:
    """Points at the floor or higher."""
    return points.where(F.col("z") >= floor - slack)


def floor_grid(points: DataFrame, z: float, spacing: float) -> DataFrame:
    """(cloud_id, x, y, z): a level grid over each cloud's extent in x and y, from its lower edges on."""
    box = points.groupBy("cloud_id").agg(*[f(c).alias(f"{n}{c}") for c in "xy" for n, f in (("lo", F.min), ("hi", F.max))])
    n = lambda c: F.ceil((F.col(f"hi{c}") - F.col(f"lo{c}")) / F.lit(spacing)).cast("int")
    rows = box.withColumn("i", F.explode(F.sequence(F.lit(0), n("x")))).withColumn("j", F.explode(F.sequence(F.lit(0), n("y"))))
    return rows.select("cloud_id", (F.col("lox") + F.col("i") * spacing).alias("x"), (F.col("loy") + F.col("j") * spacing).alias("y"), F.lit(float(z)).alias("z"))


def _outline(q: np.ndarray) -> np.ndarray:
    """The convex hull of a few points of the plane, counter-clockwise."""
    pts = sorted(map(tuple, np.unique(q, axis=0).tolist()))

    def half(seq):
        out = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(pts) + half(reversed(pts)))


def mouth_cap(rim: DataFrame, spacing: float, most: int = 10_000) -> DataFrame:
    """(mouth, x, y, z): the plane through each mouth's rim points (mouth, x, y, z), tiled within their hull.

    A mouth's rim is a few picked points: its plane is fitted in one task a mouth.
    """
    import pandas as pd

    def tile(f: pd.DataFrame) -> pd.DataFrame:
        if len(f) > most:
            raise ValueError(f"{len(f)} rim points; up to {most} are picked")
        p = f[["x", "y", "z"]].to_numpy(float)
        c = p.mean(0)
        _, _, axes = np.linalg.svd(p - c, full_matrices=False)
        if len(p) < 3 or len(axes) < 2:
            return pd.DataFrame({"mouth": [], "x": [], "y": [], "z": []}).astype({"mouth": str, "x": float, "y": float, "z": float})
        q = (p - c) @ axes[:2].T
        hull = _outline(q)
        steps = [np.arange(lo, hi + spacing, spacing) for lo, hi in zip(q.min(0), q.max(0))]
        grid = np.stack(np.meshgrid(*steps), -1).reshape(-1, 2)
        edge = np.roll(hull, -1, 0) - hull
        inside = np.ones(len(grid), bool)
        for a, e in zip(hull, edge):
            inside &= e[0] * (grid[:, 1] - a[1]) - e[1] * (grid[:, 0] - a[0]) >= -1e-12
        made = c + grid[inside] @ axes[:2]
        return pd.DataFrame({"mouth": f["mouth"].iloc[0], "x": made[:, 0], "y": made[:, 1], "z": made[:, 2]})

    return rim.select("mouth", "x", "y", "z").groupBy("mouth").applyInPandas(tile, "mouth string, x double, y double, z double")
