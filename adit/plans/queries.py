"""The survey queries: each takes (spark, sf_dir) and returns a DataFrame over whole tables."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from adit.operators import cavity, centreline, compare, denoise, stats, surface, sweep, targets, trajectory, volume
from adit.operators.graph import kept
from adit.operators.delaunay import triangulated
from adit.operators.grid import Grid, along_filled, bimodal_grid, binned, circular_filled, coverage_by_slab, coverage_total, filled_2d, filled_grid, median_grid
from adit.sources import phantom, readers
from adit.sources.views import view

QUERIES: dict = {}
G = Grid()
#: The coverages that windows are looked for at
THRESHOLDS = [0.98, 0.95, 0.92, 0.90, 0.85, 0.80, 0.75, 0.70, 0.65, 0.60, 0.50]
ROTATION = [[0.6, -0.8, 0.0, 1.0], [0.8, 0.6, 0.0, 2.0], [0.0, 0.0, 1.0, 3.0], [0.0, 0.0, 0.0, 1.0]]


def query(f):
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, nd: int = 6) -> DataFrame:
    return df.select(*[F.round(c, nd).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def cells(s: SparkSession, d: str, name: str = "cloud_gappy") -> DataFrame:
    return bimodal_grid(binned(view(s, d, name), G))


def areas(s: SparkSession, d: str) -> DataFrame:
    return volume.slab_areas(filled_grid(view(s, d, "cloud_gappy"), G), G)


@query
def volume_trapezoid(s, d):
    return rounded(volume.trapezoid_volume(areas(s, d), G))


@query
def volume_simpson(s, d):
    return rounded(volume.simpson_volume(areas(s, d), G))


@query
def grid_median(s, d):
    return rounded(median_grid(binned(view(s, d, "cloud"), G)), 8)


@query
def grid_bimodal(s, d):
    return rounded(cells(s, d, "cloud"), 8)


@query
def bimodal_slabs(s, d):
    slabs = cells(s, d, "cloud").groupBy("cloud_id", "i").agg(F.count_if("bimodal").alias("n_bimodal")).where("n_bimodal > 0")
    return slabs.withColumn("warned", F.col("n_bimodal") / F.lit(float(G.n_theta)) > 0.2)


@query
def coverage_slab(s, d):
    return rounded(coverage_by_slab(cells(s, d), G))


QUERIES["coverage_total"] = lambda s, d: rounded(coverage_total(cells(s, d), G))


@query
def coverage_theta(s, d):
    return rounded(compare.delta_by_theta(cells(s, d), G))


@query
def circular_fill(s, d):
    # midpoints of given radii often lie half a unit of the last digit up: scaled, as SQL rounds doubles, not by their decimal text
    return circular_filled(cells(s, d), G).withColumn("r", F.round(F.col("r") * 1e8) / 1e8)


@query
def along_s_fill(s, d):
    return rounded(along_filled(circular_filled(cells(s, d), G)), 10)


@query
def slab_area(s, d):
    return rounded(areas(s, d))


@query
def cumulative_volume(s, d):
    return rounded(volume.cumulative_volume(areas(s, d)))


@query
def segment_volume(s, d):
    return rounded(compare.segment_volumes(volume.cumulative_volume(areas(s, d)), 10.0))


@query
def segment_worst(s, d):
    return rounded(compare.segment_summary(compare.segment_volumes(volume.cumulative_volume(areas(s, d)), 10.0)))


@query
def segment_masked(s, d):
    return rounded(compare.masked_segments(areas(s, d), 10.0))


@query
def delta_r_cells(s, d):
    return rounded(compare.delta_cells(cells(s, d)), 8)


@query
def delta_r_summary(s, d):
    return rounded(compare.delta_summary(cells(s, d), G))


@query
def threshold_sweep(s, d):
    return compare.longest_run(coverage_by_slab(cells(s, d), G), THRESHOLDS)


@query
def golden_segment(s, d):
    return compare.golden_segment(cells(s, d), G)


def _theta(s, d):
    c = view(s, d, "cloud")
    j = F.floor((F.col("theta") + 180.0) / G.dt).alias("j")
    return c.groupBy("cloud_id", j).agg(F.avg(F.col("r") * F.cos(F.radians("theta"))).alias("dz"), F.avg("r").alias("r"), F.count(F.lit(1)).alias("n"))


@query
def theta_bins(s, d):
    return rounded(_theta(s, d))


@query
def harmonic_fit(s, d):
    bins = _theta(s, d).withColumn("angle", (F.col("j") + 0.5) * G.dt - 180.0)
    return rounded(compare.harmonic_fit(bins, "angle", "dz", "n", ["cloud_id"]))


@query
def band_percentiles(s, d):
    p = F.percentile("r", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    c = view(s, d, "cloud").groupBy("cloud_id", F.floor(F.col("s") / 10.0).alias("band")).agg(p.alias("p"), F.avg((F.col("r") < 1.6).cast("double")).alias("near"))
    return rounded(c.select("cloud_id", "band", F.col("p")[0].alias("p10"), F.col("p")[1].alias("p50"), F.col("p")[2].alias("p90"), "near"), 8)


@query
def radius_hist(s, d):
    return view(s, d, "cloud").groupBy("cloud_id", F.floor((F.col("r") - 1.5) / 0.0025).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query
def profile_cloud(s, d):
    return rounded(volume.profile_cloud(filled_grid(view(s, d, "cloud_gappy"), G), G).select("cloud_id", "i", "j", "x", "y", "z", "interpolated"))


@query
def alignment_guard(s, d):
    m = view(s, d, "cloud").groupBy("cloud_id").agg(F.median("r").alias("median_r"))
    return rounded(m.withColumn("aligned", F.col("median_r") <= 15))


@query
def wedge_filter(s, d):
    return view(s, d, "cloud").where(~F.col("theta").between(80.0, 130.0)).groupBy("cloud_id").agg(F.count(F.lit(1)).alias("n"))


@query
def mesh_volume(s, d):
    """Between the centres of the first and last ring; mesh_volume_to_ends has the whole domain."""
    return rounded(volume.mesh_volume(volume.mesh(filled_grid(view(s, d, "cloud_gappy"), G), G, to_ends=False)))


@query
def mesh_edges_closed(s, d):
    return volume.closed_check(volume.mesh(filled_grid(view(s, d, "cloud_gappy"), G), G, to_ends=False))


@query
def mesh_volume_to_ends(s, d):
    """Volume of the whole domain, of the grid filled in both directions at once, and whether its mesh is closed."""
    meshed = kept(volume.mesh(filled_2d(kept(cells(s, d)), G), G))
    return rounded(volume.mesh_volume(meshed).join(volume.closed_check(meshed), "cloud_id"))


@query
def fill_2d(s, d):
    return rounded(filled_2d(kept(cells(s, d)), G), 10)


@query
def smoothing_sweep(s, d):
    """Knots, length, largest curvature and residuals of every run's path under nine smoothings."""
    legs = view(s, d, "traj").select("run_id", "seq", "x", "y", "z")
    return rounded(centreline.sweep(legs, factors=(1.0, 10.0, 40.0), steps=(2.0, 5.0, 10.0)), 4)


@query
def triangulated_fill(s, d):
    """Rounded after a little shift, so that halves of a digit, which weights like 1/8 give, don't depend on the order of a sum."""
    return triangulated(kept(cells(s, d)), G).withColumn("r", F.round(F.col("r") + F.lit(3.3e-11), 9))


@query
def hull_area(s, d):
    points = volume.cartesian(view(s, d, "cloud")).withColumn("i", F.floor(F.col("z") / G.ds))
    return rounded(volume.hull_areas(points))


def _voxels(s, d, h=0.5):
    return volume.voxels(volume.cartesian(view(s, d, "cloud")), h)


@query
def voxel_count(s, d):
    return rounded(_voxels(s, d).groupBy("cloud_id").agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) * 0.125).alias("volume")))


@query
def voxel_extrapolated(s, d):
    sizes = [_voxels(s, d, h).groupBy("cloud_id").agg((F.count(F.lit(1)) * h * h * h).alias("volume")).withColumn("h", F.lit(h)) for h in (0.5, 0.75, 1.0)]
    return rounded(volume.extrapolated_volume(sizes[0].unionByName(sizes[1]).unionByName(sizes[2])))


@query
def voxel_downsample(s, d):
    return rounded(volume.voxel_downsample(volume.cartesian(view(s, d, "cloud")), 0.5))


@query
def dilate(s, d):
    return volume.dilated(_voxels(s, d))


@query
def dilate_clipped(s, d):
    return volume.dilated(_voxels(s, d), 2, clip=True)


@query
def strided_scans(s, d):
    """Every third scan of those within the trajectory's times, by their order."""
    t = view(s, d, "traj").withColumn("t", F.col("seq").cast("double"))
    return denoise.in_window(t, (2.0, 40.0)).where("seq % 3 = 0").groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("first"), F.max("t").alias("last"))


for _name, _f in {
    "loop_closure": trajectory.loop_closure, "path_length": trajectory.path_length,
    "cum_arclength": lambda t: trajectory.with_arclength(t).select("run_id", "seq", "s"), "step_dedup": lambda t: trajectory.without_repeats(t, 5.0),
    "resample_arclength": lambda t: trajectory.resampled(t, 5.0), "rigid_transform": lambda t: trajectory.transformed(t, ROTATION),
    "stationary_skip": lambda t: trajectory.moving(t.withColumn("t", F.col("seq").cast("double")), 5.0).groupBy("run_id").agg(F.count(F.lit(1)).alias("kept")),
    "range_filter": lambda t: trajectory.in_range(t, 3.0, 10.0).groupBy("run_id").agg(F.count(F.lit(1)).alias("n")),
    "interp_pose": lambda t: trajectory.interpolated(t.select("run_id", (F.col("seq") + 0.25).cast("double").alias("t")), t.withColumn("t", F.col("seq").cast("double"))),
}.items():
    QUERIES[_name] = lambda s, d, f=_f: rounded(f(view(s, d, "traj")))


@query
def nearest_sample(s, d):
    k = F.col("id").alias("k")
    line = s.range(51).select(k, (F.col("id") * 0.2).alias("px"), (F.col("id") * 0.1).alias("py"), (F.col("id") * 0.05).alias("pz"))
    return rounded(trajectory.nearest(view(s, d, "traj"), line).select("run_id", "seq", "k", "distance"))


@query
def cylindrical(s, d):
    """About a straight axis along x with z up, so that s is x."""
    at = lambda **v: [F.lit(float(v.get(c, 0))).alias(p + c) for p, v in [(v["p"], v)] for c in "xyz"]
    line = s.range(101).select(F.col("id").alias("k"), (F.col("id") * 0.1).alias("s"), (F.col("id") * 0.1).alias("px"), F.lit(0.0).alias("py"), F.lit(0.0).alias("pz"), *at(p="t", x=1), *at(p="a", z=1), *at(p="b", y=1))
    return rounded(trajectory.cylindrical(view(s, d, "traj"), line).select("run_id", "seq", "s", "r", "theta"))


@query
def outbound_leg(s, d):
    return rounded(trajectory.outbound_leg(view(s, d, "traj")))


@query
def penalised_rmse(s, d):
    return rounded(sweep.trial_metrics(view(s, d, "reps")).select("trial_id", "objective", "num_runs", "num_failures"))


@query
def success_stats(s, d):
    return rounded(sweep.trial_metrics(view(s, d, "reps")).select("trial_id", "mean_error", "std_error", "max_error", "min_error"), 10)


@query
def failure_breakdown(s, d):
    return sweep.failure_breakdown(view(s, d, "reps"))


@query
def leaderboard(s, d):
    return rounded(sweep.leaderboard(sweep.trial_metrics(view(s, d, "reps"))))


def _trials(s, d):
    state = F.when(F.col("o_orderstatus") == "F", "FAIL").otherwise("COMPLETE")
    return view(s, d, "orders").select(F.col("o_orderkey").alias("trial_id"), (F.col("o_totalprice") / 5000.0).alias("value"), state.alias("state"), F.col("o_orderpriority").alias("category"))


@query
def good_trials(s, d):
    return rounded(sweep.good_trials(_trials(s, d), 50.0).select("trial_id", "value"))


@query
def category_median(s, d):
    return rounded(sweep.category_medians(_trials(s, d).where("state = 'COMPLETE'"), "category"))


@query
def unknown_params(s, d):
    part = view(s, d, "part")
    return sweep.unknown_parameters(part.select(F.col("p_partkey").alias("trial_id"), F.col("p_brand").alias("name")), part.where("p_size <= 1").select(F.col("p_brand").alias("name")).distinct())


@query
def conditional_params(s, d):
    part = view(s, d, "part")
    kind = F.when(F.col("p_size") % 2 == 0, "A").otherwise("B")
    values = F.create_map(F.lit("type"), kind, F.lit("size"), F.col("p_size").cast("string"), F.lit("price"), F.col("p_partkey").cast("string"))
    space = s.createDataFrame([("type", None, None), ("size", "type", "A"), ("price", "type", "B")], "name string, parent string, parent_value string")
    return sweep.conditional(part.select(F.col("p_partkey").alias("trial_id"), F.explode(values).alias("name", "value")), space)


@query
def conditional_tree(s, d):
    """A parameter of a parameter of a parameter."""
    part = view(s, d, "part")
    kind, mode = F.when(F.col("p_size") % 2 == 0, "A").otherwise("B"), F.concat(F.lit("m"), (F.col("p_size") % 3).cast("string"))
    values = F.create_map(F.lit("type"), kind, F.lit("mode"), mode, F.lit("depth"), F.col("p_size").cast("string"), F.lit("price"), F.col("p_partkey").cast("string"))
    space = s.createDataFrame([("type", None, None), ("mode", "type", "A"), ("depth", "mode", "m1"), ("price", "depth", "10")], "name string, parent string, parent_value string")
    return sweep.conditional(part.select(F.col("p_partkey").alias("trial_id"), F.explode(values).alias("name", "value")), space)


def _newest(s, d):
    return stats.newest(view(s, d, "runs"), ("dataset", "rep", "cloud_id", "method"))


@query
def newest_runs(s, d):
    return rounded(stats.newest(view(s, d, "runs")).select("dataset", "rep", "cloud_id", "stamp", "run_no", "volume"))


@query
def comparability_guard(s, d):
    runs = view(s, d, "runs").withColumnRenamed("run_no", "run_id")
    return stats.comparability(runs, ["method", "cloud_id", "dataset"]).select("dataset", "key", "n_values")


@query
def repeatability(s, d):
    return rounded(stats.describe(_newest(s, d), ["dataset", "cloud_id", "method"], "volume"))


@query
def grubbs(s, d):
    return rounded(stats.grubbs(_newest(s, d), ["dataset", "cloud_id", "method"], "volume", "rep"))


@query
def bias(s, d):
    return rounded(stats.bias(_newest(s, d), ["dataset", "method"]))


@query
def paired_bias(s, d):
    return rounded(stats.paired_bias(_newest(s, d), ["dataset", "rep", "method"], ["dataset", "method"]))


@query
def method_spread(s, d):
    return rounded(stats.method_spread(_newest(s, d), ["dataset", "rep", "cloud_id"]))


@query
def aux_stability(s, d):
    rows = stats.long_form(view(s, d, "lineitem").select(F.col("l_returnflag").alias("dataset"), "l_discount", "l_tax", "l_quantity"), ["dataset"], ["l_discount", "l_tax", "l_quantity"])
    return rounded(stats.describe(rows, ["dataset", "metric"], "value").select("dataset", "metric", "n", "mean", "min", "max", "sd"))


@query
def has_reference(s, d):
    return view(s, d, "runs").groupBy("dataset", "rep").agg(F.bool_or(F.col("cloud_id") == "ref").alias("has_reference"))


@query
def run_index(s, d):
    wide = _newest(s, d).groupBy("dataset", "rep", "cloud_id").pivot("method", ["profiles", "surface_mesh", "hull_bound"]).agg(F.max("volume"))
    return wide.select("dataset", "rep", "cloud_id", *[F.when(F.col(m).isNull(), "").otherwise(F.format_string("%.5f", m)).alias(m) for m in ("profiles", "surface_mesh", "hull_bound")])


for _name, _f in {
    "pair_distances": targets.pair_distances, "scale_k": lambda t: targets.scale(targets.pair_distances(t)), "leave_one_out": targets.leave_one_out,
    "target_consistency": targets.consistency, "segment_lengths": targets.chainage,
}.items():
    QUERIES[_name] = lambda s, d, f=_f: rounded(f(view(s, d, "targets")))


@query
def uniform_scale_fit(s, d):
    out = targets.uniform_scale(view(s, d, "targets"))
    return out.select("net", F.round("k_fit", 6).alias("k_fit"), F.round("intercept_mm", 4).alias("intercept_mm"), F.round("k_end", 6).alias("k_end"), "verdict")


@query
def decomposition(s, d):
    mean = volume.trapezoid_volume(areas(s, d), G).select("cloud_id", "mean_area")
    return rounded(targets.decomposition(view(s, d, "targets"), mean))


@query
def phantom_volumes(s, d):
    """Volumes of a made cylinder of radius 2 and length 100, whole and with a wedge removed, against pi r^2 L."""
    parts = []
    for hole in (None, (80.0, 130.0)):
        raw = kept(bimodal_grid(binned(phantom.cylinder(s, hole=hole, n_z=1000), G)))
        filled = along_filled(circular_filled(raw, G))
        profiles = volume.trapezoid_volume(volume.slab_areas(filled, G), G).select(F.lit("profiles").alias("method"), "volume")
        meshed = volume.mesh_volume(volume.mesh(filled_2d(raw, G), G)).select(F.lit("surface_mesh").alias("method"), "volume")
        parts.append(profiles.unionByName(meshed).select(F.lit(hole is not None).alias("hole"), "method", "volume"))
    rows = parts[0].unionByName(parts[1])
    return rows.select("hole", "method", F.round("volume", 4).alias("volume"), F.round((F.col("volume") / phantom.true_volume() - 1) * 100, 6).alias("error_pct"))


@query
def largest_cavity(s, d):
    walls = volume.dilated(_voxels(s, d))
    return rounded(cavity.largest_cavity(walls, 0.5))


@query
def iso_surface(s, d):
    """Volume, area, faces and edges of the surface around each cloud's voxels."""
    return rounded(surface.measured(kept(surface.iso_surface(_voxels(s, d), 0.5))))


@query
def surface_volume(s, d):
    return rounded(cavity.surface_volume(_voxels(s, d), 0.5))


@query
def outlier_removal(s, d):
    """Points that the statistical filter keeps, counted by cloud."""
    points = volume.cartesian(view(s, d, "cloud"))
    return denoise.without_outliers(points, 8, 2.0).groupBy("cloud_id").agg(F.count(F.lit(1)).alias("n"))


def _poses(s, d):
    """Trajectories with unit quaternions that turn about z, a second apart."""
    half = F.radians((F.col("seq") * 7 % 360) / 2.0)
    return view(s, d, "traj").select("run_id", F.col("seq").cast("double").alias("t"), "x", "y", "z", F.lit(0.0).alias("qx"), F.lit(0.0).alias("qy"), F.sin(half).alias("qz"), F.cos(half).alias("qw"))


def _shots(s, d):
    """Points in the sensor's frame, a quarter second after each pose; the last one of a run lies outside."""
    return view(s, d, "traj").select("run_id", (F.col("seq") + 0.25).alias("t"), (F.col("y") / 2 + 0.5).alias("x"), (F.col("z") / 2).alias("y"), (F.col("x") / 2).alias("z"), (F.col("seq") % 10).cast("double").alias("intensity"))


@query
def deskew(s, d):
    return rounded(trajectory.deskewed(_shots(s, d), _poses(s, d)))


@query
def dense_map(s, d):
    return rounded(denoise.dense_map(_shots(s, d), _poses(s, d), 1.0, 6.0, 2.0))


def _axis(s, step=1.0, n=101):
    """A straight frame along x with z up."""
    at = lambda p, **v: [F.lit(float(v.get(c, 0))).alias(p + c) for c in "xyz"]
    return s.range(n).select(F.col("id").alias("k"), (F.col("id") * step).alias("s"), (F.col("id") * step).alias("px"), F.lit(0.0).alias("py"), F.lit(0.0).alias("pz"), *at("t", x=1), *at("a", z=1), *at("b", y=1))


@query
def from_cylindrical(s, d):
    points = view(s, d, "cloud").select("cloud_id", "s", "r", "theta")
    return rounded(trajectory.from_cylindrical(points, _axis(s)).groupBy("cloud_id").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.round(c, 6)).alias(c) for c in "xyz"]), 3)


@query
def reversed_axis(s, d):
    """Points about the axis turned round: s becomes 10 - s, and the side changes hands."""
    return rounded(trajectory.cylindrical(view(s, d, "traj"), trajectory.turned_round(_axis(s, 0.1))).select("run_id", "seq", "s", "r", "theta", "dz"))


@query
def gravity_frame(s, d):
    by = Window.partitionBy("run_id").orderBy("seq")
    step = view(s, d, "traj").select("run_id", "seq", *[(F.lead(c).over(by) - F.col(c)).alias(c) for c in "xyz"])
    size = F.sqrt(sum((F.col(c) ** 2 for c in "xyz"), F.lit(0.0)))
    lines = step.withColumn("size", size).where("size > 1e-6 and abs(z) < 0.999 * size").select("run_id", "seq", *[(F.col(c) / F.col("size")).alias("t" + c) for c in "xyz"])
    return rounded(trajectory.gravity_frame(lines).select("run_id", "seq", *[v + c for v in "ab" for c in "xyz"]))


def _kappa(s, d):
    return trajectory.curvature(trajectory.resampled(view(s, d, "traj"), 5.0))


@query
def curvature(s, d):
    return rounded(_kappa(s, d))


@query
def curvature_peaks(s, d):
    return rounded(centreline.curvature_peaks(_kappa(s, d).withColumn("kappa", F.round("kappa", 6))))


@query
def area_bridge(s, d):
    return rounded(compare.clean_areas(areas(s, d)))


def _shifted(s, d):
    a = kept(areas(s, d))
    side = lambda c: a.where((F.col("cloud_id") == c) & (F.col("s") >= (3.0 if c == "ref" else 1.25))).select("s", "area")
    return compare.shifted_difference(side("ref"), side("mobile"))


@query
def shifted_difference(s, d):
    return rounded(_shifted(s, d).select("p", "area_a", "area_b", "d_area"))


@query
def campaign_segments(s, d):
    return rounded(compare.campaign_segments(_shifted(s, d)))


@query
def campaign_change(s, d):
    mean = _newest(s, d).groupBy("dataset", "cloud_id", "method").agg(F.avg("volume").alias("volume"))
    return rounded(compare.campaign_change(mean, "ds0", "ds1"))


@query
def band_mean(s, d):
    bins = _theta(s, d).withColumn("angle", (F.col("j") + 0.5) * G.dt - 180.0)
    low, high = (compare.band_mean(bins, "angle", "dz", *b).withColumn("band", F.lit(n)) for b, n in (((-130.0, -110.0), "dip"), ((50.0, 70.0), "opposite")))
    return rounded(low.unionByName(high))


@query
def last_by_path(s, d):
    runs = view(s, d, "runs").withColumn("path", F.concat_ws("/", "dataset", "rep", F.date_format("stamp", "yyyyMMdd"), F.lpad(F.col("run_no").cast("string"), 9, "0"), "cloud_id", "method", F.format_string("%.5f", "volume")))
    return rounded(stats.last_by_path(runs, "path").select("dataset", "rep", "run_no", "cloud_id", "method", "volume"))


@query
def pooled_trials(s, d):
    return rounded(sweep.pooled(_trials(s, d)))


@query
def best_and_bounds(s, d):
    trials = _trials(s, d).where("state = 'COMPLETE'")
    o = view(s, d, "orders")
    params = o.select(F.col("o_orderkey").alias("trial_id"), F.explode(F.create_map(F.lit("cust"), F.col("o_custkey").cast("double"), F.lit("total"), F.col("o_totalprice"), F.lit("key"), F.col("o_orderkey") + 1.0)).alias("name", "value"))
    space = s.createDataFrame([("cust", 0.0, 150.0, "lin"), ("total", 1.0, 1e6, "log"), ("key", 0.0, 1e6, "lin")], "name string, lo double, hi double, scale string")
    return rounded(sweep.best_and_bounds(trials, params, space))


@query
def outcomes(s, d):
    o = view(s, d, "orders")
    code = F.when(F.col("o_custkey") % 11 == 0, 124).when(F.col("o_custkey") % 7 == 0, F.col("o_custkey") % 5).otherwise(0).cast("int")
    runs = o.select(code.alias("exit_code"), (F.col("o_custkey") % 13 != 0).alias("has_trajectory"), (F.col("o_totalprice") / 100).alias("path_length_m"))
    return sweep.classified(runs, 1500.0).groupBy("failure_reason", "failed").agg(F.count(F.lit(1)).alias("n"))


@query
def config_patches(s, d):
    """Values by file and path; the maps as sorted text."""
    p = view(s, d, "part")
    params = p.select(F.col("p_partkey").alias("trial_id"), F.explode(F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("brand"), F.col("p_brand"), F.lit("none"), F.lit("x"))).alias("name", "value"))
    mapping = s.createDataFrame([("size", "a.json", "m.size"), ("brand", "a.json", "m.brand")], "name string, file string, path string")
    text = F.concat_ws(";", F.transform(F.array_sort(F.map_entries("patch")), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return sweep.config_patches(params, mapping).select("trial_id", "file", text.alias("patch"))


@query
def frame_counts(s, d):
    t = view(s, d, "traj").withColumn("t", F.col("seq").cast("double"))
    flagged = t.select("run_id", "t", (F.col("seq") % 5).alias("n_points"), (F.col("seq") % 3 != 0).alias("moving"))
    return denoise.frame_counts(flagged, (2.0, 40.0))


@query
def point_times(s, d):
    """Which reading of a scan's raw times lies closest to its header."""
    e = view(s, d, "events")
    scale = F.when(F.col("user_id") % 4 == 0, F.lit(1.0)).when(F.col("user_id") % 4 == 1, F.lit(1e9)).when(F.col("user_id") % 4 == 2, F.lit(1e-3)).otherwise(F.lit(1e6))
    raw = F.when(F.col("user_id") % 4 < 2, (F.lit(1e5) + F.col("value") / 1000) * scale).otherwise(F.col("value") * scale)
    points = e.select(F.col("user_id").alias("scan_id"), F.lit(1e5).alias("header_t"), F.col("event_id").alias("pid"), raw.alias("t"))
    return rounded(readers.point_times(points).groupBy("scan_id").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("t_min"), F.max("t").alias("t_max")), 4)


@query
def cap_fingerprint(s, d):
    t = view(s, d, "targets").where("idx in (0, 7)").withColumn("run_id", F.concat_ws("/", "net", "cloud_id"))
    return stats.fingerprint(t)
