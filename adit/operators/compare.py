"""Comparison of two clouds along the tunnel and around it."""

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adit.operators.graph import kept
from adit.operators.grid import Grid, coverage_by_slab, filled, scaffold


def delta_cells(grid: DataFrame, ref: str = "ref", other: str = "mobile") -> DataFrame:
    """Cells that both clouds observed, with the difference of their radii."""
    pair = grid.where(F.col("cloud_id").isin(ref, other)).groupBy("i", "j").agg(
        F.max(F.when(F.col("cloud_id") == ref, F.col("r"))).alias("r_ref"), F.max(F.when(F.col("cloud_id") == other, F.col("r"))).alias("r_oth")
    )
    return pair.where("r_ref is not null and r_oth is not null").withColumn("dr", F.col("r_oth") - F.col("r_ref"))


def delta_by_theta(grid: DataFrame, g: Grid, ref: str = "ref", other: str = "mobile") -> DataFrame:
    """For each bin: coverage of either cloud and of both, in percent of slabs, and the mean difference."""
    cells = scaffold(grid, g).groupBy("i", "j").agg(F.max(F.when(F.col("cloud_id") == ref, F.col("r"))).alias("a"), F.max(F.when(F.col("cloud_id") == other, F.col("r"))).alias("b"))
    share = lambda c: F.count(c) / F.lit(float(g.n_slabs)) * 100.0
    return cells.groupBy("j").agg(share("a").alias("cov_ref"), share("b").alias("cov_oth"), share(F.col("a") + F.col("b")).alias("both_pct"), F.avg(F.col("b") - F.col("a")).alias("dr"))


def delta_summary(grid: DataFrame, g: Grid, ref: str = "ref", other: str = "mobile") -> DataFrame:
    """Overlap, median difference, median absolute difference, and the bin where the other cloud covers least."""
    d = delta_cells(grid, ref, other).agg(
        (F.count("dr") / F.lit(float(g.n_slabs * g.n_theta))).alias("overlap"), F.median("dr").alias("median_dr"), F.median(F.abs("dr")).alias("median_abs_dr")
    )
    worst = delta_by_theta(grid, g, ref, other).agg(F.min_by("j", F.struct("cov_oth", "j")).alias("worst_j"), F.min("cov_oth").alias("worst_cov"))
    return d.crossJoin(worst)


def clean_areas(slabs: DataFrame) -> DataFrame:
    """Slab areas with missing ones interpolated along s, ends held."""
    return slabs.select("cloud_id", "i", "s", filled(slabs, ["cloud_id"], "s", "area").alias("area"))


def segment_volumes(cumulative: DataFrame, length: float = 10.0, ref: str = "ref", other: str = "mobile") -> DataFrame:
    """Volumes of segments of ``length`` from differences of the cumulative curves, interpolated at the edges.

    ``cumulative``: (cloud_id, s, volume) at the same s for both clouds. One row
    a segment: its edges, both volumes, their difference and its percentage.
    The curve is made once; each of its intervals produces the edges in it, so that edges need no join.
    """
    curve = kept(cumulative.select("cloud_id", "s", "volume"))
    lo, hi = curve.agg(F.min("s"), F.max("s")).first()
    if lo is None:
        lo = hi = 0.0
    n = math.ceil((hi - lo) / length)
    by = Window.partitionBy("cloud_id").orderBy("s")
    pieces = curve.select("cloud_id", "s", "volume", F.lead("s").over(by).alias("s2"), F.lead("volume").over(by).alias("v2"))
    place = lambda c: F.floor((F.col(c) - lo) / length).cast("int")  # noqa: E731  a step more on both sides, for rounding and for the last edge
    edges = F.transform(F.sequence(F.greatest(place("s") - 1, F.lit(0)), F.least(F.coalesce(place("s2"), place("s")) + 2, F.lit(n))), lambda k: F.struct(k.alias("k"), F.least(F.lit(lo) + k * length, F.lit(hi)).alias("edge")))
    at = pieces.select("cloud_id", "s", "volume", "s2", "v2", F.explode(edges).alias("e")).select("cloud_id", "s", "volume", "s2", "v2", "e.*")
    at = at.where((F.col("edge") >= F.col("s")) & F.coalesce(F.col("edge") < F.col("s2"), F.col("edge") == F.col("s")))
    value = F.col("volume") + F.coalesce((F.col("v2") - F.col("volume")) * (F.col("edge") - F.col("s")) / (F.col("s2") - F.col("s")), F.lit(0.0))
    order = Window.partitionBy("cloud_id").orderBy("k")
    seg = at.select("cloud_id", "k", "edge", value.alias("v"))
    seg = seg.select("cloud_id", "k", F.col("edge").alias("s_from"), F.lead("edge").over(order).alias("s_to"), (F.lead("v").over(order) - F.col("v")).alias("v")).where("s_to is not null")
    both = seg.groupBy("k", "s_from", "s_to").agg(F.max(F.when(F.col("cloud_id") == ref, F.col("v"))).alias("v_ref"), F.max(F.when(F.col("cloud_id") == other, F.col("v"))).alias("v_oth"))
    return both.withColumn("dv", F.col("v_oth") - F.col("v_ref")).withColumn("dv_pct", F.when(F.col("v_ref") != 0, F.col("dv") / F.col("v_ref") * 100.0))


def segment_summary(segments: DataFrame) -> DataFrame:
    """The segment with the largest difference, and the mean absolute difference."""
    return segments.agg(F.max_by("k", F.struct(F.abs("dv"), -F.col("k"))).alias("worst_k"), F.max(F.abs("dv")).alias("worst_abs_dv"), F.avg(F.abs("dv")).alias("mean_abs_dv"))


def masked_segments(slabs: DataFrame, length: float = 10.0) -> DataFrame:
    """Trapezoid within each segment alone: the interval across an edge is left out, as are segments of one slab."""
    seg = F.floor((F.col("s") - F.min("s").over(Window.partitionBy("cloud_id"))) / length)
    rows = slabs.where("area is not null").withColumn("seg", seg)
    by = Window.partitionBy("cloud_id", "seg").orderBy("s")
    rows = rows.withColumn("piece", 0.5 * (F.col("area") + F.lead("area").over(by)) * (F.lead("s").over(by) - F.col("s")))
    return rows.groupBy("cloud_id", "seg").agg(F.sum("piece").alias("volume"), F.count(F.lit(1)).alias("n")).where("n >= 2")


def good_runs(coverage: DataFrame, thresholds: list[float]) -> DataFrame:
    """For each threshold the runs of consecutive slabs whose smaller coverage of all clouds reaches it: (threshold, start, n)."""
    low = coverage.groupBy("i").agg(F.min("coverage").alias("coverage"))
    each = low.select("i", "coverage", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold")).where("coverage >= threshold")
    island = F.col("i") - F.row_number().over(Window.partitionBy("threshold").orderBy("i"))
    return each.withColumn("island", island).groupBy("threshold", "island").agg(F.min("i").alias("start"), F.count(F.lit(1)).alias("n")).drop("island")


def longest_run(coverage: DataFrame, thresholds: list[float]) -> DataFrame:
    """The longest run for each threshold, the first among equals; a threshold without any has n = 0."""
    best = good_runs(coverage, thresholds).groupBy("threshold").agg(F.max_by("start", F.struct("n", -F.col("start"))).alias("start"), F.max("n").alias("n"))
    every = coverage.sparkSession.createDataFrame([(float(t),) for t in thresholds], "threshold double")
    return every.join(best, "threshold", "left").select("threshold", F.coalesce("start", F.lit(0)).alias("start"), F.coalesce("n", F.lit(0)).alias("n"))


def golden_segment(grid: DataFrame, g: Grid, target: float = 25.0, min_coverage: float = 0.90) -> DataFrame:
    """(s_lo, s_hi) of the longest stretch that all clouds cover, of ``target`` at most; empty if no slab passes."""
    run = longest_run(coverage_by_slab(grid, g), [min_coverage])
    n = F.least(F.col("n"), F.ceil(F.lit(target) / g.ds))
    return run.select((F.lit(g.s0) + F.col("start") * g.ds).alias("s_lo"), (F.lit(g.s0) + (F.col("start") + n) * g.ds).alias("s_hi"))


def shifted_difference(a: DataFrame, b: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Two campaigns on s' = s - s_start: areas of ``a`` and of ``b`` interpolated at a's s', over the shorter length.

    ``keys``: columns that name a pair of campaigns, of which there may be many; each pair's slabs are laid on one axis and the
    areas of ``b`` before and after are carried over, without a join.
    """
    keys = keys or []
    pair = [*keys] if keys else [F.lit(1)]
    own = lambda df: df.where("area is not null").withColumn("p", F.col("s") - F.min("s").over(Window.partitionBy(*pair)))
    known = F.struct(F.col("p").alias("q"), "area")
    rows = own(a).select(*keys, "p", F.col("area").alias("area_a"), F.lit(None).cast("struct<q:double,area:double>").alias("b"))
    rows = rows.unionByName(own(b).select(*keys, "p", F.lit(None).cast("double").alias("area_a"), known.cast("struct<q:double,area:double>").alias("b")))
    by = Window.partitionBy(*pair).orderBy("p")
    before, after = F.last("b", True).over(by.rangeBetween(Window.unboundedPreceding, 0)), F.first("b", True).over(by.rangeBetween(0, Window.unboundedFollowing))
    rows = rows.select(*keys, "p", "area_a", before.alias("u"), after.alias("v")).where("area_a is not null and u is not null and v is not null")
    share = F.when(F.col("v.q") > F.col("u.q"), (F.col("v.area") - F.col("u.area")) * (F.col("p") - F.col("u.q")) / (F.col("v.q") - F.col("u.q"))).otherwise(0.0)
    value = F.col("u.area") + share
    return rows.select(*keys, "p", "area_a", value.alias("area_b"), (value - F.col("area_a")).alias("d_area"), F.row_number().over(by).alias("k"))


def change_split(tunnel_ref_a: float, tunnel_ref_b: float, total_a: float, total_b: float) -> dict[str, float]:
    """Change between campaigns, split into that of the reference scan (tunnel) and the rest (sensor)."""
    total, tunnel = total_b - total_a, tunnel_ref_b - tunnel_ref_a
    return {"total": total, "tunnel": tunnel, "sensor": total - tunnel, "tunnel_share_pct": tunnel / total * 100 if total else float("nan")}


def campaign_segments(shifted: DataFrame, length: float = 10.0, limit_pct: float = 5.0, keys: list[str] | None = None) -> DataFrame:
    """(k, v_a, v_b, dv, dv_pct, flagged) of two campaigns by segments of s', from shifted_difference(): trapezoids within a segment,
    which needs two slabs; flagged where they differ by more than ``limit_pct``."""
    keys = keys or []
    rows = shifted.withColumn("k", F.floor(F.col("p") / length))
    by = Window.partitionBy(*keys, "k").orderBy("p")
    piece = lambda c: 0.5 * (F.col(c) + F.lead(c).over(by)) * (F.lead("p").over(by) - F.col("p"))
    rows = rows.select(*keys, "k", piece("area_a").alias("a"), piece("area_b").alias("b"))
    seg = rows.groupBy(*keys, "k").agg(F.count(F.lit(1)).alias("n"), F.sum("a").alias("v_a"), F.sum("b").alias("v_b")).where("n >= 2")
    seg = seg.withColumn("dv", F.col("v_b") - F.col("v_a")).withColumn("dv_pct", F.when(F.col("v_a") > 0, F.col("dv") / F.col("v_a") * 100))
    return seg.select(*keys, "k", "v_a", "v_b", "dv", "dv_pct", F.coalesce(F.abs("dv_pct") > limit_pct, F.lit(False)).alias("flagged"))


def campaign_change(volumes: DataFrame, a: str, b: str, ref: str = "ref", other: str = "mobile") -> DataFrame:
    """For each method how the other cloud's volume changed from campaign a to b, and how much of it is the tunnel (the
    reference's change) and how much the sensor (that of their offset), with the sensor's share of both magnitudes.

    ``volumes``: (dataset, cloud_id, method, volume), a row each.
    """
    v = lambda d, c: F.max(F.when((F.col("dataset") == d) & (F.col("cloud_id") == c), F.col("volume")))
    rows = volumes.groupBy("method").agg(v(a, ref).alias("ra"), v(b, ref).alias("rb"), v(a, other).alias("oa"), v(b, other).alias("ob")).dropna()
    tunnel, total = F.col("rb") - F.col("ra"), F.col("ob") - F.col("oa")
    sensor = (F.col("ob") - F.col("rb")) - (F.col("oa") - F.col("ra"))
    return rows.select("method", total.alias("total"), tunnel.alias("tunnel"), sensor.alias("sensor"), (F.abs(sensor) / F.nullif(F.abs(tunnel) + F.abs(sensor), F.lit(0.0)) * 100).alias("sensor_share_pct"))


def band_mean(bins: DataFrame, theta_deg: str, value: str, lo: float, hi: float) -> DataFrame:
    """Mean of the bins whose middle lies within [lo, hi] degrees."""
    return bins.where(F.col(theta_deg).between(lo, hi)).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))


def harmonic_fit(bins: DataFrame, theta_deg: str, value: str, weight: str, keys: list[str] | None = None) -> DataFrame:
    """Weighted first-harmonic fit value = A cos + B sin + C, of all bins or of each of ``keys``: phase (degrees), amplitude, offset, R2; NULL below four bins.

    The normal equations are sums over the bins, solved by Cramer's rule.
    """
    rows = bins.where(F.col(value).isNotNull() & (F.col(weight) > 0))
    c, s, y = F.cos(F.radians(theta_deg)), F.sin(F.radians(theta_deg)), F.col(value)
    w = F.col(weight).cast("double")
    keys = keys or []
    m = rows.select(*keys, c.alias("c"), s.alias("s"), y.alias("y"), w.alias("w")).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"), *[F.sum(F.expr(f"w*{e}")).alias(k) for k, e in {"c": "c", "s": "s", "cc": "c*c", "cs": "c*s", "ss": "s*s", "y": "y", "cy": "c*y", "sy": "s*y", "yy": "y*y"}.items()]
    )
    m = m.select(*keys, "n", *[(F.col(k) / F.col("w")).alias(k) for k in ("c", "s", "cc", "cs", "ss", "y", "cy", "sy", "yy")])
    det = "(cc*(ss - s*s) - cs*(cs - s*c) + c*(cs*s - ss*c))"
    m = m.withColumn("a", F.expr(f"(cy*(ss - s*s) - cs*(sy - s*y) + c*(sy*s - ss*y)) / nullif({det}, 0)"))
    m = m.withColumn("b", F.expr(f"(cc*(sy - y*s) - cy*(cs - s*c) + c*(cs*y - sy*c)) / nullif({det}, 0)"))
    m = m.withColumn("o", F.expr("y - a*c - b*s"))
    ss_res = F.expr("yy - 2*(a*cy + b*sy + o*y) + a*a*cc + b*b*ss + o*o + 2*(a*b*cs + a*o*c + b*o*s)")
    out = m.withColumn("r2", 1 - ss_res / F.expr("nullif(yy - y*y, 0)"))
    ok = F.col("n") >= 4
    return out.select(*keys, F.when(ok, F.degrees(F.atan2("b", "a"))).alias("phase_deg"), F.when(ok, F.hypot("a", "b")).alias("amplitude"), F.when(ok, F.col("o")).alias("offset"), F.when(ok, F.col("r2")).alias("r2"))
