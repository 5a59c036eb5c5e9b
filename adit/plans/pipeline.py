"""The measuring pipeline over clouds in (s, r, theta), and the statistics over its runs."""

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adit.operators import compare, stats, volume
from adit.operators.delaunay import triangulated
from adit.operators.graph import kept
from adit.operators.grid import Grid, along_filled, bimodal_grid, binned, circular_filled, coverage_total


@dataclass(frozen=True)
class Config:
    """Settings that define a measurement; runs are comparable only if all agree."""

    grid: Grid = Grid()
    gap: float = 0.30
    min_coverage: float = 0.10
    segment_m: float = 10.0
    golden_length_m: float = 25.0
    golden_coverage: float = 0.90
    max_median_r_m: float = 15.0

    def signature(self) -> str:
        """A name for cached results made under these settings."""
        import hashlib
        import json

        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()


def check_aligned(cloud: DataFrame, limit: float = 15.0, step: int = 1) -> None:
    """An error if a cloud's median radius says that it was not registered into the tunnel's frame."""
    bad = cloud.where(F.col("pid") % step == 0).groupBy("cloud_id").agg(F.median("r").alias("r")).where(F.col("r") > limit)
    if rows := bad.limit(10).collect():
        raise ValueError("not registered: " + ", ".join(f"{r.cloud_id} has median r = {r.r:.1f} m" for r in rows))


def check_caps(caps: DataFrame, max_r: float = 5.0) -> None:
    """Exactly two end caps, each near the centreline (columns s, r)."""
    n, r = caps.agg(F.count(F.lit(1)), F.max("r")).first()
    if n != 2 or r > max_r:
        raise ValueError(f"{n} caps, up to {r} m off the centreline; two within {max_r} m are needed")


def measure(cloud: DataFrame, cfg: Config = Config(), hull: bool = False, frame: DataFrame | None = None, mesh: bool = True) -> dict[str, DataFrame]:
    """All results of clouds (cloud_id, pid, s, r, theta), as DataFrames.

    ``frame``: the centreline that s follows; without one the axis is straight.

    The points are shuffled once, into a table of cell radii; everything else
    works on at most n_slabs x n_theta rows a cloud. The mesh is made of the grid filled in both directions at once.
    """
    check_aligned(cloud, cfg.max_median_r_m)
    g = cfg.grid
    raw = kept(bimodal_grid(binned(cloud, g), cfg.gap))
    cells = kept(along_filled(circular_filled(raw, g, cfg.min_coverage)))
    slabs = kept(volume.slab_areas(cells, g))
    profiles = volume.trapezoid_volume(slabs, g)
    volumes = profiles.select("cloud_id", F.lit("profiles").alias("method"), "volume")
    out = {}
    if mesh:
        out["mesh"] = kept(volume.mesh(triangulated(raw, g), g, frame=frame))
        out["mesh_closed"] = volume.closed_check(out["mesh"])
        volumes = volumes.unionByName(volume.mesh_volume(out["mesh"]).select("cloud_id", F.lit("surface_mesh").alias("method"), "volume"))
    volumes = volumes.unionByName(volume.simpson_volume(slabs, g).select("cloud_id", F.lit("profiles_simpson").alias("method"), "volume"))
    if hull:
        inside = cloud.where((F.col("s") >= g.s0) & (F.col("s") < g.s0 + g.n_slabs * g.ds))
        ring = volume.hull_areas(volume.cartesian(inside).withColumn("i", F.floor((F.col("z") - g.s0) / g.ds))).withColumn("s", g.centre()).withColumn("frac_interp", F.lit(0.0))
        volumes = volumes.unionByName(volume.trapezoid_volume(ring, g).select("cloud_id", F.lit("hull_bound").alias("method"), "volume"))
    return out | {
        "volumes": volumes, "profiles": profiles, "profile_cloud": volume.profile_cloud(cells, g, frame), "slabs": slabs, "cells": cells, "coverage": coverage_total(raw, g),
        "golden": compare.golden_segment(raw, g, cfg.golden_length_m, cfg.golden_coverage), "segments": compare.segment_volumes(volume.cumulative_volume(slabs), cfg.segment_m),
        "lateral": compare.delta_by_theta(raw, g), "lateral_summary": compare.delta_summary(raw, g), "bimodal": raw.groupBy("cloud_id", "i").agg(F.count_if("bimodal").alias("n_bimodal")).where("n_bimodal > 0"),
    }


def cross_check(volumes: DataFrame, a: str = "profiles", b: str = "surface_mesh", limit_pct: float = 2.0) -> DataFrame:
    """Clouds whose two methods disagree by more than ``limit_pct``."""
    side = lambda m: F.max(F.when(F.col("method") == m, F.col("volume")))
    both = volumes.groupBy("cloud_id").agg(side(a).alias("a"), side(b).alias("b"))
    return both.withColumn("pct", F.abs(F.col("b") - F.col("a")) / F.col("a") * 100).where(F.col("pct") > limit_pct)


def statistics(runs: DataFrame, use_all: bool = False, datasets: list[str] | None = None, must_match: list[str] | None = None, strict: bool = True) -> dict[str, DataFrame]:
    """Repeatability, outliers and bias over runs (dataset, rep, stamp, run_no, cloud_id, method, volume): the newest of each, or all.

    ``datasets``: those to look at; ``must_match``: columns of the runs that must agree within a dataset, or else it is an error (only told, if not ``strict``).
    """
    if datasets:
        runs = runs.where(F.col("dataset").isin(*datasets))
    chosen = runs if use_all else stats.newest(runs, ("dataset", "rep", "cloud_id", "method"))
    chosen = kept(chosen)
    problems = stats.comparability(chosen.withColumn("run_id", F.concat_ws("/", "rep", "stamp")), must_match) if must_match else None
    if problems is not None:
        stats.require_comparable(problems, strict)
    return ({"problems": problems} if problems is not None else {}) | {
        "describe": stats.describe(chosen, ["dataset", "cloud_id", "method"], "volume"), "grubbs": stats.grubbs(chosen, ["dataset", "cloud_id", "method"], "volume", "rep"),
        "bias": stats.bias(chosen, ["dataset", "method"]), "paired": stats.paired_bias(chosen, ["dataset", "rep", "method"], ["dataset", "method"]),
        "methods": stats.method_spread(chosen, ["dataset", "rep", "cloud_id"]),
    }
