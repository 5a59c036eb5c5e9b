"""Survey operators on closed forms, ground truth and awkward rows."""

import json
import math
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from adit.functions.quantiles import chi2_quantile, quantile_row, t_quantile
from adit.operators import caps, cavity, centreline, compare, denoise, spline, stats, sweep, targets, trajectory, volume
from adit.operators.grid import Grid, bimodal_grid, binned, filled_2d, filled_grid
from adit.plans import pipeline, tunnel
from adit.sources import cache, datasets, phantom, readers, sinks


def test_phantom_volumes(spark):
    g, truth = Grid(0, 100, 0.5, 5.0), phantom.true_volume()
    for hole in (None, (80.0, 130.0)):
        cloud = phantom.cylinder(spark, hole=hole, n_z=1000)
        cells = filled_grid(cloud, g).persist()
        slabs = volume.slab_areas(cells, g)
        assert abs(volume.trapezoid_volume(slabs, g).first().volume / truth - 1) < 0.005
        assert abs(volume.simpson_volume(slabs, g).first().volume / truth - 1) < 0.005
        meshed = volume.mesh(filled_2d(bimodal_grid(binned(cloud, g)), g), g).persist()
        assert abs(volume.mesh_volume(meshed).first().volume / truth - 1) < 0.005
        check = volume.closed_check(meshed).first()
        assert check.closed and check.oriented


def test_mesh_reaches_both_ends(spark):
    g = Grid(1.0, 6.0, 1.0, 90.0)
    rows = [("a", i, j, None if (i, j) == (4, 2) or i == 0 else 2.0) for i in range(5) for j in range(4)]
    cells = spark.createDataFrame(rows, "cloud_id string, i long, j long, r double")
    meshed = volume.mesh(cells, g)
    assert volume.mesh_volume(meshed).first().volume == pytest.approx(8 * 5)
    corners = volume.vertices(meshed)
    assert corners.agg(F.min("z"), F.max("z")).first() == (1.0, 6.0) and corners.count() == 5 * 4 + 2
    check = volume.closed_check(meshed).first()
    assert check.closed and check.oriented
    assert volume.mesh_volume(volume.mesh(cells, g, to_ends=False)).first().volume == pytest.approx(8 * 2)


def test_fill_in_both_directions(spark):
    g = Grid(0.0, 12.0, 1.0, 30.0)
    hole = {(i, j) for i in range(4, 8) for j in (0, 1, 11)} | {(0, 5), (11, 6)}
    rows = [("a", i, j, 2.0 + 0.1 * i) for i in range(12) for j in range(12) if (i, j) not in hole]
    got = {(r.i, r.j): r for r in filled_2d(spark.createDataFrame(rows, "cloud_id string, i long, j long, r double"), g).collect()}
    assert len(got) == 144 and {k for k, r in got.items() if r.interpolated} == hole
    assert all(got[k].r == pytest.approx(2.0 + 0.1 * k[0]) for k in hole if 0 < k[0] < 11)
    assert got[(0, 5)].r == pytest.approx((2.0 + 2.0 + 2.1) / 3)
    lone = filled_2d(spark.createDataFrame([("a", 3, 4, 1.5)], "cloud_id string, i long, j long, r double"), g)
    assert lone.count() == 144 and lone.where("abs(r - 1.5) > 1e-12 or r is null").count() == 0


def test_voxel_cavity_leaks_only_with_a_hole(spark):
    def walls(hole):
        p = phantom.cylinder(spark, 2.0, 10.0, 360, 200, hole).select("cloud_id", "x", "y", "z")
        caps = spark.range(60).crossJoin(spark.range(60).withColumnRenamed("id", "k")).crossJoin(spark.createDataFrame([(0.0,), (10.0,)], "z double"))
        caps = caps.select(F.lit("phantom").alias("cloud_id"), (F.col("id") / 15.0 - 2).alias("x"), (F.col("k") / 15.0 - 2).alias("y"), "z").where("x*x + y*y <= 4.2")
        return volume.voxels(p.unionByName(caps), 0.25)

    full = walls(None)
    got = cavity.largest_cavity(full, 0.25).first()
    inner = math.pi * 1.75**2 * 9.5
    assert not got.leaked and 0.8 < got.volume / inner < 1.15
    assert cavity.largest_cavity(walls((80.0, 130.0)), 0.25).first().leaked
    inside = cavity.solid(full)
    assert inside.count() == got.n
    assert abs(cavity.surface_volume(inside, 0.25).first().volume / got.volume - 1) < 0.05


def test_pattern_volumes():
    table = dict(cavity.pattern_volumes())
    assert table[0] == 0 and table[255] == 1 and all(abs(table[p] + table[255 - p] - 1) < 1e-12 for p in table)


def test_ground_truth_axis(spark):
    frame, info = centreline.centreline(spark, phantom.out_and_back(spark), factor=0.05, ds=0.5)
    assert abs(info["length_m"] - 100) < 1.5 and info["fit_rms_m"] < 0.15 and info["tilt_max_deg"] > 85
    ends = frame.orderBy("k").toPandas()
    axis = ends[["px", "py", "pz"]].to_numpy()[[0, -1]]
    angle = math.degrees(math.acos(abs((axis[1] - axis[0])[2]) / np.linalg.norm(axis[1] - axis[0])))
    assert angle < 1


def test_smoothing_budget():
    r = np.random.default_rng(4)
    t = np.linspace(0, 40, 300)
    p = np.column_stack([t, np.sin(t / 3), 0 * t]) + r.normal(0, 0.05, (300, 3))
    for factor in (0.0075, 0.02):
        line, u = spline.smoothing(p, factor * 300)
        assert ((p - line.at(u)) ** 2).sum() == pytest.approx(factor * 300, rel=0.01)
        assert 3 < len(line.knots) < 60  # of 300 points
    for n in (1, 2, 3, 4):
        line, u = spline.smoothing(p[:n], 0.0)
        assert np.allclose(line.at(u)[[0, -1]], p[[0, n - 1]], atol=1e-6)
    same, u = spline.smoothing(p[:40], 0.0)
    assert np.allclose(same.at(u), p[:40], atol=1e-6)
    straight, u = spline.smoothing(p, 1e9)
    assert len(straight.knots) == 0
    bands = [np.full(50, 7.0), np.full(49, -2.0), np.full(48, 1.0)]
    full = sum(np.diag(b, k) + (np.diag(b, -k) if k else 0) for k, b in enumerate(bands))
    b = r.normal(size=(50, 2))
    assert np.allclose(full @ spline.banded(bands, b), b)


def test_spline_of_a_noisy_helix():
    r = np.random.default_rng(0)
    a = np.linspace(0, 6 * np.pi, 700)
    helix = np.column_stack([20 * np.cos(a), 20 * np.sin(a), 2 * a])
    noisy = helix + r.normal(size=helix.shape) * 0.05
    line, u = spline.smoothing(noisy, 0.98 * 3 * 0.05**2 * len(noisy))
    inner = np.linspace(0.05, 0.95, 400)
    assert np.median(line.curvature(inner)) == pytest.approx(20 / (20**2 + 2**2), rel=0.05) and len(line.knots) < 70
    h = 1e-5
    assert np.allclose((line.at(inner + h) - line.at(inner - h)) / (2 * h), line.at(inner, 1), atol=1e-3)
    assert np.allclose((line.at(inner + h, 1) - line.at(inner - h, 1)) / (2 * h), line.at(inner, 2), atol=1e-1)
    t = line.t
    first, value = spline.basis(t, inner)
    assert np.allclose(value.sum(1), 1) and (value >= -1e-12).all() and (t[first + 3] <= inner).all()


def test_doubtful_lines_warn(caplog):
    assert centreline.doubts({"kappa_max_1pm": 0.1, "fit_rms_m": 0.1, "tilt_max_deg": 5.0}) == []
    assert len(centreline.doubts({"kappa_max_1pm": 0.6, "fit_rms_m": 0.4, "tilt_max_deg": None})) == 2 and "kink" in caplog.text


def test_frames_are_orthonormal(spark):
    t = np.linspace(0, 3, 60)
    line = np.column_stack([10 * np.sin(t / 2), 10 * np.cos(t / 2), t])
    for gravity in (True, False):
        f = centreline.framed(spark, centreline.fit(line, 0.01, 0.2), gravity).orderBy("k").select(*[f"{v}{c}" for v in "tab" for c in "xyz"]).toPandas().to_numpy().reshape(-1, 3, 3)
        for u, v in ((0, 0), (1, 1), (2, 2), (0, 1), (0, 2), (1, 2)):
            assert np.allclose((f[:, u] * f[:, v]).sum(1), u == v, atol=1e-9)
    bend = [(run, k, float(20 * np.sin(v / 20)), float(20 * np.cos(v / 20)), 0.01 * (k % 2)) for run in ("a", "b") for k, v in enumerate(np.linspace(0, 30, 300))] + [("c", 0, 0.0, 0.0, 0.0)]
    swept = centreline.sweep(spark.createDataFrame(bend, "run_id string, seq long, x double, y double, z double")).collect()
    assert len(swept) == 18 and {r.run_id for r in swept} == {"a", "b"}
    assert all(abs(r.kappa_max_1pm - 0.05) < 0.02 and r.knots < r.n - 4 and r.fit_rms_m < 0.45 and r.length_m == pytest.approx(30, rel=0.02) for r in swept)


def test_smoothings_together(spark, monkeypatch):
    r = np.random.default_rng(7)
    legs = [np.column_stack([r.exponential(5, n), 10 * r.random(n), 5 * r.random(n)]) for n in r.integers(4, 90, 40)] + [np.zeros((6, 3)), np.ones((2, 3))]
    budgets = [float(f * len(p)) for f, p in zip(np.tile([1.0, 10.0, 40.0], 14), legs)]
    alone, calls, solve = [spline.smoothing(p, b) for p, b in zip(legs, budgets)], [], spline.banded_many
    monkeypatch.setattr(spline, "banded_many", lambda *x: calls.append(1) or solve(*x))
    for (a, u), (b, v) in zip(alone, spline.smoothings(legs, budgets)):
        assert np.array_equal(a.t, b.t) and np.allclose(a.at(u), b.at(v), atol=1e-6)
    assert len(calls) < 80  # of all problems together, however many there are
    rows = [(run, k, *map(float, p)) for run, leg in zip(["a", None, "c", "d"], legs) for k, p in enumerate(leg)]
    frame = spark.createDataFrame(rows, "run_id string, seq long, x double, y double, z double")
    told = lambda **how: sorted(map(str, centreline.sweep(frame, (1.0, 10.0), (2.0, 5.0), **how).collect()))
    assert told() == told(together=3) and len(told()) == 4 * 3  # a run without a name has no row
    with pytest.raises(Exception, match="points of one run"):
        told(most=5)


def test_curvature_peaks(spark):
    kappa = [0, 1, 0, 2, 2, 2, 1, 3, 3, 1, 5, 5]
    got = centreline.curvature_peaks(spark.createDataFrame([(1, k, float(v)) for k, v in enumerate(kappa)], "run_id int, k long, kappa double"), share=0.5)
    assert sorted((r.k, r.kappa) for r in got.collect()) == [(4, 2.0), (7, 3.0)]


def test_cylindrical_round_trip(spark):
    frame = centreline.framed(spark, centreline.fit(np.column_stack([np.linspace(0, 20, 41), np.zeros(41), np.zeros(41)]), 0, 0.5))
    points = spark.createDataFrame([(k, float(k), 1.0 + k / 10, -170.0 + 30 * k) for k in range(12)], "pid long, s double, r double, theta double")
    back = trajectory.cylindrical(trajectory.from_cylindrical(points, frame).select("pid", "x", "y", "z"), frame)
    for a, b in zip(points.orderBy("pid").collect(), back.orderBy("pid").collect()):
        assert np.allclose((a.s, a.r, a.theta), (b.s, b.r, b.theta), atol=1e-6)
    round_ = trajectory.turned_round(frame).orderBy(F.desc("k")).first()
    assert abs(round_.s) < 1e-9 and round_.tx == pytest.approx(-1)


def test_quantiles():
    assert t_quantile(0.975, 4) == pytest.approx(2.776445, abs=1e-5)
    assert chi2_quantile(0.975, 4) == pytest.approx(11.143287, abs=1e-5)
    assert chi2_quantile(0.025, 4) == pytest.approx(0.484419, abs=1e-5)
    assert quantile_row(5)[3] == pytest.approx(1.7150, abs=1e-3) and quantile_row(1) == (None,) * 4
    for n in (61, 1000, 999_999):  # against the expansions for many degrees of freedom
        z = 1.959963984540054
        hill = z + (z**3 + z) / (4 * n) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * n**2) + (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / (384 * n**3)
        assert t_quantile(0.975, n) == pytest.approx(hill, rel=1e-7)
    assert chi2_quantile(0.025, 1_000_000) == pytest.approx(chi2_quantile(0.025, 1_000_001) - 1, abs=2e-3)


def test_describe_and_grubbs(spark):
    rows = spark.createDataFrame([("a", f"rep{k}", v) for k, v in enumerate([1.0, 1.1, 0.9, 1.05, 9.0])] + [("b", "rep0", 2.0), ("c", "rep0", 3.0), ("c", "rep1", 3.0), ("c", "rep2", 3.0), ("d", "rep0", None)], "k string, rep string, v double")
    d = {r.k: r for r in stats.describe(rows, ["k"], "v").collect()}
    assert set(d) == {"a", "b", "c"} and d["b"].sd is None and d["b"].ci95_lo is None and d["a"].ci95_lo < d["a"].mean < d["a"].ci95_hi
    g = {r.k: r for r in stats.grubbs(rows, ["k"], "v", "rep").collect()}
    assert set(g) == {"a", "c"} and g["a"].flagged and g["a"].outlier == "rep4"
    assert g["c"].g == 0 and not g["c"].flagged and g["c"].outlier is None


def test_grubbs_of_large_groups(spark):
    groups = spark.createDataFrame([(61,), (1000,), (20_000,)], "k long")
    rows = groups.select("k", F.explode(F.sequence(F.lit(1), F.col("k"))).alias("rep")).withColumn("v", F.when(F.col("rep") == 7, 50.0).otherwise(F.col("rep") % 2))
    got = {r.k: r for r in stats.grubbs(rows, ["k"], "v", "rep").collect()}
    assert all(r.flagged and r.outlier == 7 for r in got.values())
    for n in (61, 1000):
        t = t_quantile(1 - 0.025 / n, n - 2)
        assert got[n].g_crit == pytest.approx((n - 1) / math.sqrt(n) * math.sqrt(t * t / (n - 2 + t * t)), abs=1e-6)
    assert not any(r.flagged for r in stats.grubbs(rows.where("rep <> 7"), ["k"], "v", "rep").collect())
    assert {r.k: r.g_crit for r in stats.describe(rows, ["k"], "v").collect()} == {k: r.g_crit for k, r in got.items()}


RUNS = "dataset string, rep string, stamp string, run_no int, cloud_id string, method string, volume double"


def test_newest_of_odd_runs(spark):
    rows = [("a", "1", "s1", 9, "ref", "m", 9.0), ("a", "1", "s2", 1, "ref", "m", 1.0), ("a", "1", "s2", 2, "ref", "m", 0.5), ("a", "1", "s2", 2, "ref", "m", 0.75), ("a", "1", "s2", 2, "ref", "m", None)]
    rows += [("b", "1", None, 9, "ref", "m", 9.0), ("b", "1", "", None, "ref", "m", 8.0), ("b", "1", "", -1, "ref", "m", -7.0), ("c", "1", "s", 1, "ref", "m", math.nan), ("c", "1", "s", 1, "ref", "m", math.inf)]
    rows += [(None, None, None, None, None, None, None), (None, None, None, None, None, None, 3.0), ("d", "1", "s", 1, "ref", "m", 2.0), ("d", "1", "s", 1, "ref", "m", 2.0), ("d", "1", "s", 1, "ref", None, 1.0)]
    runs = spark.createDataFrame(rows, RUNS)
    got = stats.newest(runs, ("dataset", "rep", "cloud_id", "method"))
    assert got.columns == runs.columns
    assert sorted(map(str, got.collect())) == sorted(str(runs.collect()[k]) for k in (3, 7, 8, 11, 12, 14))
    # without the method as a key it is that of the chosen run; a column of any type stays with its run
    noted = runs.where("dataset = 'd'").withColumn("notes", F.create_map(F.lit("volume"), "volume"))
    assert [(r.method, r.volume, r.notes) for r in stats.newest(noted).collect()] == [("m", 2.0, {"volume": 2.0})]
    assert stats.newest(runs.limit(0)).collect() == []


def test_newest_sorts_by_the_keys_only(spark):
    runs = spark.createDataFrame([("d", "1", "s", k, "ref", m, 1.0) for k in range(50) for m in ("a", "b")], RUNS)
    for keys in (("dataset", "rep", "cloud_id", "method"), ("dataset", "rep", "cloud_id")):
        got = stats.newest(runs, keys).select("dataset", "rep", "cloud_id", "stamp", "run_no", "volume")
        plan = got._jdf.queryExecution().sparkPlan().toString()
        assert "Window" not in plan and plan.count("partial_max(") == 1 and "max_by" not in plan
        assert {r.run_no for r in got.collect()} == {49}


def test_spread_of_odd_methods(spark):
    rows = [("d", "1", "ref", "profiles", 10.0), ("d", "1", "ref", "surface_mesh", 11.0), ("d", "1", "ref", "hull_bound", 90.0), ("d", "1", "ref", None, 70.0)]
    rows += [("d", "2", "ref", "profiles", 10.0), ("d", "2", "ref", "hull_bound", 9.0), ("d", "3", "ref", "profiles", 0.0), ("d", "3", "ref", "surface_mesh", 1.0)]
    rows += [("d", "4", "ref", "profiles", 10.0), ("d", "4", "ref", "surface_mesh", None), ("d", "5", "ref", None, 1.0), (None, None, None, "profiles", 4.0), (None, None, None, "surface_mesh", 5.0)]
    rows += [("d", "6", "ref", "profiles", 8.0), ("d", "6", "ref", "profiles", 5.0), ("d", "6", "ref", "surface_mesh", 10.0)]
    runs = spark.createDataFrame([(d, r, "s", 1, c, m, v) for d, r, c, m, v in rows], RUNS)
    got = {(r.dataset, r.rep, r.cloud_id): r.delta_pct for r in stats.method_spread(runs, ["dataset", "rep", "cloud_id"]).collect()}
    assert got == {("d", "1", "ref"): pytest.approx(10), (None, None, None): pytest.approx(25), ("d", "6", "ref"): pytest.approx(25)}


def test_spread_drops_other_methods_before_it_looks_for_the_newest(spark, tmp_path):
    rows = [("d", "1", s, 1, "ref", m, v) for s, m, v in (("s1", "profiles", 5.0), ("s2", "profiles", 10.0), ("s1", "surface_mesh", 11.0), ("s3", "hull_bound", 90.0))]
    spark.createDataFrame(rows, RUNS).write.parquet(str(tmp_path / "runs"))
    newest = stats.newest(spark.read.parquet(str(tmp_path / "runs")), ("dataset", "rep", "cloud_id", "method"))
    got = stats.method_spread(newest, ["dataset", "rep", "cloud_id"])
    assert [r.delta_pct for r in got.collect()] == [pytest.approx(10)]
    scan = next(x for x in got._jdf.queryExecution().sparkPlan().toString().splitlines() if "FileScan" in x)
    assert "In(method, [profiles,surface_mesh])" in scan


def test_penalised_objective(spark):
    reps = spark.createDataFrame([(1, 1, 0.5, False, "")] + [(1, k, None, True, "timeout" if k < 4 else "") for k in range(2, 6)] + [(2, k, 5.0, False, "") for k in range(5)], "trial_id long, rep int, error_m double, failed boolean, failure_reason string")
    m = {r.trial_id: r for r in sweep.trial_metrics(reps).collect()}
    assert m[1].objective == pytest.approx(math.sqrt((0.25 + 4e4) / 5)) and m[2].objective == pytest.approx(5)
    assert m[1].std_error == 0 and m[1].num_failures == 4
    assert sweep.failure_map(reps).first().failures == {"timeout": 2, "unknown": 2}


def test_sweep_rules(spark):
    assert sweep.flat({"a": {"b": 1, "_c": 2}, "_d": 3, "e.f": {"g": 4}}) == {"a.b": 1, "e.f": {"g": 4}}
    runs = spark.createDataFrame([(124, True, 1.0), (3, True, 1.0), (0, False, 1.0), (0, True, 5000.0), (0, True, 1.0)], "exit_code int, has_trajectory boolean, path_length_m double")
    assert [r.failure_reason for r in sweep.classified(runs).collect()] == ["timeout", "exit_3", "no_trajectory", "runaway", ""]
    space = spark.createDataFrame([("a", 0.0, 10.0, "lin"), ("b", 0.01, 1.0, "log")], "name string, lo double, hi double, scale string")
    trials = spark.createDataFrame([(1, 5.0), (2, 1.0), (3, None)], "trial_id long, value double")
    params = spark.createDataFrame([(2, "a", 9.5), (2, "b", 0.1), (1, "a", 1.0)], "trial_id long, name string, value double")
    assert {r.name: r.verdict for r in sweep.best_and_bounds(trials, params, space).collect()} == {"a": "near high", "b": "inside"}
    mapping = spark.createDataFrame([("a", "f.json", "x.a"), ("b", "f.json", "x.b")], "name string, file string, path string")
    assert sweep.config_patches(params.where("trial_id = 2"), mapping).first().patch == {"x.a": 9.5, "x.b": 0.1}


def test_exact_scale(spark):
    p = [(0, 0, 0), (1, 2, 3), (4, 0, 1), (2, 5, 2)]
    rows = [(n, "ref", i, *map(float, q)) for n in (1, 2) for i, q in enumerate(p)] + [(n, "mobile", i, *(1.01 * c for c in q)) for n in (1, 2) for i, q in enumerate(p)]
    t = spark.createDataFrame(rows, "net int, cloud_id string, idx int, x double, y double, z double")
    k = targets.scale(targets.pair_distances(t)).first()
    assert k.k == pytest.approx(1.01) and k.resid_rms < 1e-6
    assert k.len_oth == pytest.approx(1.01 * k.len_ref)
    moved = spark.createDataFrame([(n, c, i, x + (3.0 if (n, c, i) == (2, "mobile", 2) else 0), y, z) for n, c, i, x, y, z in rows], t.schema)
    assert [(r.net, r.idx) for r in targets.consistency(moved).where("flagged and net = 2").collect()] == [(2, 2)]
    targets.check_indices(t, 0, 3)
    with pytest.raises(ValueError, match="no target"):
        targets.check_indices(t, 0, 7)
    assert {r.verdict for r in targets.uniform_scale(t).collect()} == {"uniform"}


def test_harmonic_and_comparison(spark):
    bins = spark.range(72).select((F.col("id") * 5.0 - 177.5).alias("a"), F.lit(3.0).alias("n")).withColumn("v", 2 * F.cos(F.radians(F.col("a") - 30)) + 0.5)
    fit = compare.harmonic_fit(bins, "a", "v", "n").first()
    assert (fit.phase_deg, fit.amplitude, fit.offset, fit.r2) == pytest.approx((30, 2, 0.5, 1))
    assert compare.harmonic_fit(bins.limit(3), "a", "v", "n").first().phase_deg is None
    line = lambda k, n: spark.range(n).select((F.col("id") * 1.0 + k).alias("s"), (F.col("id") * 2.0).alias("area"))
    d = compare.shifted_difference(line(5.0, 6), line(2.3, 4)).collect()
    assert len(d) == 4 and all(abs(r.d_area) < 1e-9 for r in d)
    assert compare.change_split(10, 9, 20, 25) == {"total": 5, "tunnel": -1, "sensor": 6, "tunnel_share_pct": -20}


def test_empty_and_sparse_grids(spark):
    none = spark.createDataFrame([], "cloud_id string, pid long, s double, r double, theta double")
    g = Grid(0, 3, 1, 90)
    assert filled_grid(none, g).count() == 0
    one = spark.createDataFrame([("a", 1, 0.5, 2.0, -180.0), ("a", 2, 0.5, 9.0, 180.0), ("a", 3, 3.0, 9.0, 0.0), ("a", 4, 0.6, 3.0, -179.0)], none.schema)
    cells = {(r.i, r.j): r.r for r in filled_grid(one, g).collect()}
    assert cells[(0, 0)] == 3.0 and cells[(0, 2)] == 3.0 and cells[(1, 0)] is None
    assert bimodal_grid(binned(one, g)).first().bimodal
    assert volume.trapezoid_volume(volume.slab_areas(filled_grid(one, g), g), g).first().volume == pytest.approx(3 * 18)


def test_hull(spark):
    square = [("a", 0, float(x), float(y)) for x in range(4) for y in range(4)] + [("a", 1, 0.0, 0.0), ("a", 1, 1.0, 1.0), ("a", 1, 2.0, 2.0), ("a", 2, 1.0, 1.0)]
    got = {r.i: r.area for r in volume.hull_areas(spark.createDataFrame(square, "cloud_id string, i long, x double, y double").repartition(4)).collect()}
    assert got[0] == 9.0 and got[1] is None and got[2] is None


def test_neighbour_distances(spark):
    r = np.random.default_rng(0)
    p = np.vstack([r.random((80, 3)), [[9, 9, 9]]])
    frame = spark.createDataFrame([("a", k, *map(float, q)) for k, q in enumerate(p)], "cloud_id string, pid long, x double, y double, z double")
    d = np.sort(np.linalg.norm(p[:, None] - p[None], axis=2), axis=1)[:, 1:5].mean(1)
    got = {x.pid: x.d for x in denoise.neighbour_distances(frame, 4, 16).collect()}
    assert np.allclose([got[k] for k in range(81)], d)
    assert 80 not in {x.pid for x in denoise.without_outliers(frame, 4, 2.0).collect()}


def test_deskew(spark):
    h = math.sqrt(0.5)
    traj = spark.createDataFrame([("r", 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0), ("r", 2.0, 2.0, 0.0, 0.0, 0.0, 0.0, h, h)], "run_id string, t double, x double, y double, z double, qx double, qy double, qz double, qw double")
    points = spark.createDataFrame([("r", 1.0, 1.0, 0.0, 0.0), ("r", 2.0, 1.0, 0.0, 0.0), ("r", 3.0, 1.0, 0.0, 0.0)], "run_id string, t double, x double, y double, z double")
    got = [(r.x, r.y) for r in trajectory.deskewed(points, traj).orderBy("t").collect()]
    assert np.allclose(got, [(1 + h, h), (2, 1)])
    assert denoise.dense_map(points, traj, 0.5, 5.0, 10.0).count() == 1


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "t.txt").write_text("# t x y z\n1 0 0 0 0 0 0 1\n\n2 1 0 0 0 0 0 1\n3 1 1 0\n4 5\n")
    assert [(r.seq, r.x, r.qw) for r in readers.trajectory(spark, str(tmp_path / "t.txt")).orderBy("seq").collect()] == [(1, 0, 1), (2, 1, 1), (3, 1, None)]
    (tmp_path / "g.csv").write_text("id,x,y,z\nA,1,2,3\nB,4,5,6\n")
    assert [(r.idx, r.x, r.z) for r in readers.targets(spark, str(tmp_path / "g.csv"), "ref").orderBy("idx").collect()] == [(0, 1, 3), (1, 4, 6)]
    (tmp_path / "m.txt").write_text("1 0 0 1\n0 1 0 2\n0 0 1 3\n0 0 0 1\n")
    m = readers.registration(spark, str(tmp_path / "m.txt"))
    assert not trajectory.rigid_faults(m) and trajectory.rigid_faults([[2, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1]])
    (tmp_path / "c.ply").write_bytes(readers.ply_bytes(np.arange(30.0).reshape(10, 3), ["x", "y", "z"]))
    cloud = readers.ply(spark, str(tmp_path / "c.ply"), 3)
    assert cloud.count() == 10 and cloud.rdd.getNumPartitions() == 4 and cloud.agg(F.sum("z")).first()[0] == sum(range(2, 30, 3))
    (tmp_path / "a.ply").write_text("ply\nformat ascii 1.0\nelement vertex 2\nproperty float x\nproperty float y\nproperty float z\nend_header\n1 2 3\n4 5 6\n")
    assert readers.ply(spark, str(tmp_path / "a.ply")).agg(F.sum("y")).first()[0] == 7
    for n, v in (("one", 0.25), ("two", 0.08)):
        (tmp_path / n).mkdir()
        (tmp_path / n / "o.json").write_text('/*** doc ***/ {"m": {"v": %s, // note\n "u": "http://x", "w": 1e10}}' % v)
    a, b = readers.configs(spark, str(tmp_path / "one")), readers.configs(spark, str(tmp_path / "two"))
    assert {r.name for r in a.collect()} == {"m.v", "m.u", "m.w"}
    assert [(r.name, r.before, r.after) for r in readers.config_diff(a, b).collect()] == [("m.v", "0.25", "0.08")]
    assert json.loads(sinks.patched_config('{"a": 1 /* x */}', {"b.c": 2})) == {"a": 1, "b": {"c": 2}}
    run = tmp_path / "results" / "d1" / "rep01" / "20240101_000000Z"
    run.mkdir(parents=True)
    (run / "summary.json").write_text('{"results": {"ref": 1.5}}')
    (run.parent / "bad").mkdir()
    (run.parent / "bad" / "summary.json").write_text("{nonsense")
    got = readers.run_summaries(spark, str(tmp_path / "results"), "results map<string,double>").collect()
    assert [(r.dataset, r.rep, r.stamp) for r in got] == [("d1", "rep01", "20240101_000000Z")]
    listing = readers.files(spark, str(tmp_path), "*.txt")
    assert readers.first_of(listing, ["none.txt", "t.txt", "m.txt"]).first().path.endswith("/t.txt")
    sinks.run_folder(spark.range(2), str(tmp_path / "out"), "d", "r", "s")
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        sinks.run_folder(spark.range(2), str(tmp_path / "out"), "d", "r", "s")
    assert "| 1 |" in sinks.markdown(spark.createDataFrame([(1, None)], "a int, b double"), "T")


def test_scan_messages(spark):
    kind = np.dtype([("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("reflectivity", "<u1"), ("offset_time", "<u4")])
    data = np.array([(1, 2, 3, 9, 0), (4, 5, 6, 8, 100_000_000)], kind).tobytes()
    fields = [(n, kind.fields[n][1], {"<f4": 7, "|u1": 2, "<u4": 6}[kind[n].str]) for n in kind.names]
    frame = spark.createDataFrame([(1, 1000.0, kind.itemsize, fields, data), (2, 1.0, 4, [("q", 0, 7)], b"\0" * 4)], "scan_id long, header_t double, point_step int, fields array<struct<name string, offset int, datatype int>>, data binary")
    got = readers.point_times(readers.scan_points(frame)).orderBy("pid").collect()
    assert [(r.x, r.intensity) for r in got] == [(1, 9), (4, 8)]
    assert [r.t for r in got] == pytest.approx([1000.0, 1000.1])


def test_measure_and_statistics(spark, sf):
    from adit.sources.views import view

    out = pipeline.measure(view(spark, sf, "cloud"), hull=True)
    assert {r.method for r in out["volumes"].collect()} == {"profiles", "surface_mesh", "profiles_simpson", "hull_bound"}
    assert pipeline.cross_check(out["volumes"], limit_pct=5.0).count() == 0
    assert out["segments"].count() == 10 and pipeline.Config().signature() != pipeline.Config(gap=1.0).signature()
    assert pipeline.statistics(view(spark, sf, "runs"))["bias"].count() > 0
    with pytest.raises(ValueError, match="not registered"):
        pipeline.check_aligned(view(spark, sf, "cloud").withColumn("r", F.lit(40.0)))


def test_streams(spark, tmp_path):
    from adit.streaming import scans

    rows = [("a", float(k), 0.0 if k < 5 else float(k), 0.0, 0.0) for k in range(10)]
    frame = spark.createDataFrame(rows, "run_id string, t double, x double, y double, z double")
    frame.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    q = scans.moving(stream, 0.5).writeStream.format("memory").queryName("moved").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    want = trajectory.moving(frame, 0.5)
    assert sorted(r.t for r in spark.table("moved").collect()) == sorted(r.t for r in want.collect())


def test_voxel_driver(spark):
    p = phantom.cylinder(spark, 2.0, 10.0, 360, 400).select("cloud_id", "x", "y", "z")
    planes = [((0.0, 0.0, 1.0), (0.0, 0.0, 1.0)), ((0.0, 0.0, 9.0), (0.0, 0.0, -1.0))]
    got = {r.h: r for r in cavity.voxel_volumes(p, [0.25, 0.5, 0.01], 1, planes, budget=1_000_000).collect()}
    assert set(got) == {0.01, 0.25, 0.5} and not any(got[h].leaked or got[h].skipped or not got[h].closed for h in (0.25, 0.5))
    assert "budget is 1000000" in got[0.01].skipped and got[0.01].v_voxel is None
    truth = math.pi * 4 * 8
    assert abs(got[0.25].v_voxel / truth - 1) < 0.15 and abs(got[0.25].v_surface / got[0.25].v_voxel - 1) < 0.02
    best = cavity.best_volume(cavity.voxel_volumes(p, [0.25, 0.5, 0.01], 1, planes, budget=1_000_000)).first()
    assert best.h == 0.25 and abs(best.v_extrapolated / truth - 1) < 0.15
    table = cavity.seal_table(phantom.cylinder(spark, 2.0, 10.0, 360, 400, (80.0, 130.0)).select("cloud_id", "x", "y", "z"), [0.5], [0, 1], planes=planes)
    assert {(r.seal, r.leaked) for r in table.collect()} >= {(0, True)}
    assert cavity.best_volume(cavity.voxel_volumes(p, [0.01], budget=10)).first().volume is None


def test_caps_and_domain(spark):
    frame = centreline.framed(spark, centreline.fit(np.column_stack([np.linspace(0, 20, 41), np.zeros(41), np.zeros(41)]), 0, 0.5))
    t = spark.createDataFrame([(0, 1.0, 1.0, 0.0), (3, 9.0, 0.0, 0.0), (7, 18.0, 0.0, 1.0)], "idx int, x double, y double, z double")
    c = spark.createDataFrame([(0, 17.0, 2.0, 0.0), (1, 2.0, 0.0, 2.0)], t.schema)
    s, info = caps.domain(t, None, frame)
    assert s == pytest.approx((1, 18)) and info["cap_mode"] == "target_planes"
    s, info = caps.domain(t, c, frame)
    assert s == pytest.approx((2, 17)) and info["shift_vs_targets_m"]["end"] == pytest.approx(-1) and caps.domain(t, c, frame, "target_planes")[0] == pytest.approx((1, 18))
    with pytest.raises(ValueError, match="off the centreline"):
        caps.domain(t, c, frame, max_r=1.0)
    with pytest.raises(ValueError, match="two ends"):
        caps.domain(t, t, frame)
    with pytest.raises(ValueError, match="bound the domain"):
        caps.domain(t, c, frame, end=6)
    cloud = spark.createDataFrame([("a", 0.0, 0.0, 1.0), ("a", 1.0, 0.5, -1.0)], "cloud_id string, x double, y double, z double")
    assert caps.floor_grid(cloud, -2.0, 0.25).count() == 5 * 3 and caps.above(cloud, 1.0).count() == 1
    rim = spark.createDataFrame([("m", 1 + math.cos(a), 2 + math.sin(a) / math.sqrt(2), 3 + math.sin(a) / math.sqrt(2)) for a in np.arange(0, 6.28, 0.1)], "mouth string, x double, y double, z double")
    cap = caps.mouth_cap(rim, 0.05).toPandas()
    assert abs(len(cap) * 0.05**2 / math.pi - 1) < 0.05 and np.allclose(cap.y - 2, cap.z - 3)


def test_datasets_and_plans(spark, tmp_path):
    for p in ("a/rtc_clean_1cm.ply", "a/targets_leica.txt", "a/rep00/x.ply", "a/rep00/trajectory_transformed.txt", "a/rep00/transformation_matrix.txt", "a/rep01/x.ply", "a/rep01/y.ply", "a/rep01/trajectory.txt", "b/rep00/x.ply", "a/.hidden/z.ply"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x")
    files = datasets.placed(readers.files(spark, str(tmp_path)), str(tmp_path)).persist()
    assert [r.dataset for r in datasets.datasets(files).collect()] == ["a"]
    assert [tuple(r) for r in datasets.reps(files).collect()] == [("a", "rep00"), ("a", "rep01"), ("b", "rep00")]
    got = {(r.dataset, r.rep): r for r in datasets.runs(files).collect()}
    assert got["a", "rep00"].problem is None and got["a", "rep00"].trajectory.endswith("trajectory_transformed.txt")
    assert "2 PLY files: x.ply, y.ply" in got["a", "rep01"].problem and "no reference cloud" in got["b", "rep00"].problem
    told = datasets.provenance(datasets.runs(files), files)
    assert told.count() == 21 and told.where("bytes = 1").count() > 5
    none = spark.createDataFrame([], "dataset string, rep string, cloud_id string")
    plan = {(r.dataset, r.rep): r.clouds for r in datasets.planned(datasets.runs(files), none).collect()}
    assert plan == {("a", "rep00"): ["ref", "mobile"], ("a", "rep01"): ["mobile"], ("b", "rep00"): ["ref", "mobile"]}
    done = spark.createDataFrame([("a", "rep00", "ref")], none.schema)
    assert {r.rep: r.clouds for r in datasets.planned(datasets.runs(files), done).where("dataset = 'a'").collect()} == {"rep00": ["mobile"], "rep01": ["mobile"]}
    runs = spark.createDataFrame([("a", "p1", "feature_planes", ["ref"]), ("a", "p2", "target_planes", ["ref"]), ("a", "p0", "feature_planes", ["ref"]), ("b", "p9", "feature_planes", ["mobile"])], "dataset string, path string, cap_mode string, clouds array<string>")
    assert [(r.dataset, r.path) for r in datasets.feature_capped(runs).collect()] == [("a", "p1")]


def test_cache(spark, tmp_path):
    made = []
    make = lambda: made.append(1) or spark.range(3)
    for sign in ("one", "one", "two"):
        assert cache.kept_or_made(spark, str(tmp_path), "cells", sign, make).count() == 3
    assert len(made) == 2 and cache.load(spark, str(tmp_path), "cells", "one") is None and cache.load(spark, str(tmp_path), "none", "one") is None
    spark.range(2).write.parquet(str(tmp_path / "old"))
    assert cache.load(spark, str(tmp_path), "old", "one") is None


def test_curved_tunnel_from_files(spark, tmp_path):
    """A bend of radius 30 m and 40 m length, 2 m wide: both volumes within 1 % of pi r^2 L, from files to a summary."""
    n, radius, length = 400, 30.0, 40.0
    a, t = np.meshgrid(np.linspace(-0.05, (length + 1.5) / radius, 700), np.radians(np.arange(0.5, 360, 1.0)))
    out, up = radius + 2 * np.cos(t), 2 * np.sin(t)
    cloud = np.column_stack([(out * np.cos(a)).ravel(), (out * np.sin(a)).ravel(), up.ravel()])
    home = tmp_path / "data" / "d1"
    (home / "rep00").mkdir(parents=True)
    (home / "rep01").mkdir()
    (home / "rtc_clean_1cm.ply").write_bytes(readers.ply_bytes(cloud, ["x", "y", "z"]))
    (home / "rep00" / "m.ply").write_bytes(readers.ply_bytes(cloud, ["x", "y", "z"]))
    s = np.concatenate([np.linspace(-1, length + 1, n), np.linspace(length + 1, -1, n)]) / radius
    poses = "\n".join(f"{k} {radius * math.cos(v) - 5} {radius * math.sin(v)} 0 0 0 0 1" for k, v in enumerate(s))
    (home / "rep00" / "trajectory.txt").write_text("# t x y z qx qy qz qw\n" + poses)
    (home / "rep00" / "transformation_matrix.txt").write_text("1 0 0 5\n0 1 0 0\n0 0 1 0\n0 0 0 1\n")
    ends = [(k, radius * math.cos(v / radius), radius * math.sin(v / radius), 0.0) for k, v in enumerate(np.linspace(0, length, 8))]
    (home / "targets_leica.txt").write_text("\n".join(",".join(map(str, e)) for e in ends))
    files = datasets.placed(readers.files(spark, str(tmp_path / "data")), str(tmp_path / "data"))
    found = datasets.runs(files)
    run = tunnel.Run(measure=pipeline.Config(grid=Grid(ds=0.5, dt=5.0)), smoothing=1e-6, cache_root=str(tmp_path / "cache"))
    done = spark.createDataFrame([], "dataset string, rep string, cloud_id string")
    report = tunnel.all_runs(spark, found.unionByName(found.limit(1).select("dataset", F.lit("rep09").alias("rep"), *found.columns[2:-1], F.lit("no mobile cloud").alias("problem"))), datasets.planned(found, done, "both").unionByName(spark.createDataFrame([("d1", "rep09", ["ref"])], "dataset string, rep string, clouds array<string>")), str(tmp_path / "results"), "s1", run)
    got = {r.rep: r for r in report.collect()}
    assert got["rep09"].error == "no mobile cloud" and got["rep00"].error is None, got["rep00"].error
    told = json.loads((Path(got["rep00"].folder) / "summary.json").read_text())
    assert told["domain"]["L_m"] == pytest.approx(length, abs=0.05) and told["domain"]["cap_mode"] == "target_planes"
    for c in ("ref", "mobile"):
        v = told["results"][c]["volumes"]
        assert v["profiles"] == pytest.approx(math.pi * 4 * length, rel=0.01) and v["surface_mesh"] == pytest.approx(math.pi * 4 * length, rel=0.01) and v["hull_bound"] >= v["profiles"] * 0.99
    assert (tmp_path / "cache" / "d1" / "rep00").is_dir()

    # the runs are found again: as done, and by the statistics
    runs = tunnel.finished(spark, str(tmp_path / "results"))
    assert {(r.dataset, r.rep, r.stamp, r.run_no, r.cloud_id) for r in runs.collect()} == {("d1", "rep00", "s1", 1, "ref"), ("d1", "rep00", "s1", 1, "mobile")}
    plan = datasets.planned(found, runs)
    assert [r.clouds for r in plan.where("rep = 'rep00'").collect()] == [["mobile"]]
    # a wider cloud under the same name, settings and domain is measured anew
    wide, t2 = np.meshgrid(np.linspace(-0.05, (length + 1.5) / radius, 700), np.radians(np.arange(0.5, 360, 1.0)))
    out, up = radius + 2.5 * np.cos(t2), 2.5 * np.sin(t2)
    (home / "rep00" / "m.ply").write_bytes(readers.ply_bytes(np.column_stack([(out * np.cos(wide)).ravel(), (out * np.sin(wide)).ravel(), up.ravel()]), ["x", "y", "z"]))
    again = tunnel.all_runs(spark, found, datasets.planned(found, runs, "both"), str(tmp_path / "results"), "s2", run).where("rep = 'rep00'").first()
    assert again.error is None and not again.cancelled
    runs = tunnel.finished(spark, str(tmp_path / "results"))
    new = {r.cloud_id: r for r in runs.where("stamp = 's2' and method = 'profiles'").collect()}
    assert new["mobile"].volume == pytest.approx(math.pi * 2.5**2 * length, rel=0.01) and new["ref"].volume == pytest.approx(math.pi * 4 * length, rel=0.01) and new["ref"].run_no == 2
    told = pipeline.statistics(runs, must_match=["settings"])
    assert {r.cloud_id: r.n for r in told["describe"].where("method = 'profiles'").collect()} == {"ref": 1, "mobile": 1}


def test_a_run_that_hangs_is_cancelled_alone(spark, tmp_path):
    import time

    def measured(session, inputs, run, name):
        if name == "d/rep01":
            session.range(4).mapInArrow(lambda batches: (time.sleep(60) or b for b in batches), "id long").collect()
        if name == "d/rep02":
            raise OSError("no such cloud")
        session.range(1000).selectExpr("sum(id)").collect()
        volumes = session.createDataFrame([("ref", "profiles", 5.0)], "cloud_id string, method string, volume double")
        none = volumes.limit(0)
        return {"volumes": volumes, "coverage": none, "profiles": none, "domain": (0.0, 1.0), "domain_info": {}, "centreline": {}}

    names = ["ref_ply", "mobile_ply", "trajectory", "registration", "targets_ref", "targets_mobile", "caps", "problem"]
    reps = ["rep00", "rep01", "rep02", "rep03"]
    found = spark.createDataFrame([("d", r, *["x"] * 7, None) for r in reps], ", ".join(f"{c} string" for c in ["dataset", "rep", *names]))
    plan = spark.createDataFrame([("d", r, ["ref"]) for r in reps], "dataset string, rep string, clouds array<string>")
    began = time.monotonic()
    got = {r.rep: r for r in tunnel.all_runs(spark, found, plan, str(tmp_path), "s", at_once=2, limit_s=8.0, measured=measured).collect()}
    assert time.monotonic() - began < 50
    assert got["rep01"].cancelled and got["rep01"].error == "cancelled after 8.0 s" and got["rep01"].folder is None
    assert "no such cloud" in got["rep02"].error and not got["rep02"].cancelled
    assert [got[r].error for r in ("rep00", "rep03")] == [None, None]
    assert {(r.rep, r.volume) for r in tunnel.finished(spark, str(tmp_path)).collect()} == {("rep00", 5.0), ("rep03", 5.0)}


def test_exports_and_settings(spark, tmp_path):
    g = Grid(0.0, 3.0, 1.0, 90.0)
    cells = spark.createDataFrame([("a", i, j, 2.0) for i in range(3) for j in range(4)], "cloud_id string, i long, j long, r double")
    meshed = volume.mesh(cells, g)
    assert sinks.mesh_ply(meshed, str(tmp_path / "m.ply")) == (22, 40)
    assert readers.ply(spark, str(tmp_path / "m.ply")).agg(F.max("z")).first()[0] == 3
    frame = spark.range(25).selectExpr("cast(id as double) as x", "1.5D as y", "-2.0D as z", "cast(id as int) as ring").repartition(2)
    parts = sinks.ply_parts(frame, f"file://{tmp_path}/parts", ("x", "y", "z", "ring"), most=10).collect()
    assert sum(r.points for r in parts) == 25 and max(r.points for r in parts) <= 10
    assert sum(readers.ply(spark, r.path).agg(F.sum("x")).first()[0] for r in parts) == sum(range(25))
    xyz = {c: np.zeros(2, "f4") for c in "xyz"}
    assert b"property double w" in readers.ply_columns(xyz | {"w": np.zeros(2)}, ("made",))
    for bad in ({"x": xyz["x"]}, xyz | {"w": np.zeros(3)}, xyz | {"w": np.zeros(2, "i8")}):
        with pytest.raises(ValueError):
            readers.ply_columns(bad)
    sinks.mesh_tables(meshed, str(tmp_path / "mesh"))
    assert spark.read.parquet(str(tmp_path / "mesh" / "vertices")).count() == 22 and spark.read.parquet(str(tmp_path / "mesh" / "faces")).count() == 40
    points = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0)], "x double, y double, z double, intensity double")
    assert sinks.pcd(points, str(tmp_path / "m.pcd")) == 1 and (tmp_path / "m.pcd").read_bytes().endswith(np.array([1, 2, 3, 4], "<f4").tobytes())
    sinks.trial_summaries(spark.createDataFrame([(1, 0.5), (2, 0.7)], "trial_id int, objective double"), str(tmp_path / "trials"))
    assert {p.name for p in (tmp_path / "trials").iterdir() if p.is_dir()} == {"trial_id=1", "trial_id=2"}
    (tmp_path / "conf").mkdir()
    (tmp_path / "conf" / "o.json").write_text('{"m": {"v": 1 /* one */}}')
    (tmp_path / "conf" / "p.json").write_text('{"q": 2} // two')
    mapping = {"front.v": ("o.json", "m.v"), "lost": ("x.json", "y")}
    assert sinks.materialize_config(spark, str(tmp_path / "conf"), str(tmp_path / "new"), {"front": {"v": 9}, "_w": 1, "odd": 3}, mapping) == ["odd"]
    assert json.loads((tmp_path / "new" / "o.json").read_text()) == {"m": {"v": 9}} and "two" in (tmp_path / "new" / "p.json").read_text()
    with pytest.raises(KeyError):
        sinks.materialize_config(spark, str(tmp_path / "conf"), str(tmp_path / "new"), {"odd": 3}, mapping, strict=True)
    with pytest.raises(FileNotFoundError):
        sinks.materialize_config(spark, str(tmp_path / "conf"), str(tmp_path / "new"), {"lost": 3}, mapping)
    (tmp_path / "s.yaml").write_text("method: bayes\nparameters:\n  # one\n  a.b:\n    distribution: uniform  # even\n    min: 0.5\n    max: 2\n  kind:\n    values: [A, B]\n  n:\n    values:\n      - 1\n      - 2\nmetric: x\n")
    got = {r.name: r for r in readers.sweep_space(spark, str(tmp_path / "s.yaml")).collect()}
    assert (got["a.b"].dist, got["a.b"].lo, got["a.b"].hi) == ("uniform", 0.5, 2) and got["kind"]["values"] == ["A", "B"] and got["n"]["values"] == ["1", "2"]
    (tmp_path / "mouth1.txt").write_text("p1,x,1,2,3\np2,y,4,5,6\n")
    assert {(r.mouth, r.x, r.z) for r in readers.rims(spark, str(tmp_path / "mouth1.txt")).collect()} == {("mouth1", 1, 3), ("mouth1", 4, 6)}
    run = tunnel.Run.from_environment({"ADIT_SMOOTHING": "0.1", "ADIT_HULL": "no", "ADIT_CLOUDS": "ref", "HOME": "x"})
    assert (run.smoothing, run.hull, run.clouds) == (0.1, False, ("ref",))
    with pytest.raises(ValueError, match="speed"):
        tunnel.Run.from_environment({"ADIT_SPEED": "1"})


def test_nested_conditions(spark):
    from adit.operators import sweep

    space = [("kind", None, None), ("mode", "kind", "A"), ("depth", "mode", "m1"), ("free", None, None)]
    assert sweep.conditions(space)["depth"] == [("mode", "m1"), ("kind", "A")]
    for wrong in ([("a", "b", "1")], [("a", "b", "1"), ("b", "a", "1")]):
        with pytest.raises(ValueError):
            sweep.conditions(wrong)
    rows = [(1, "kind", "A"), (1, "mode", "m1"), (1, "depth", "3"), (2, "kind", "B"), (2, "mode", "m1"), (2, "depth", "4"), (3, "kind", "A"), (3, "mode", None), (3, "depth", "5"), (3, "free", "f")]
    got = sweep.conditional(spark.createDataFrame(rows, "trial_id int, name string, value string"), spark.createDataFrame(space, "name string, parent string, parent_value string"))
    told = {(r.trial_id, r.name): (r.active, r.value) for r in got.collect()}
    assert len(told) == 12 and told[1, "depth"] == (True, "3") and told[2, "mode"] == told[2, "depth"] == told[3, "depth"] == (False, None)
    assert told[3, "mode"] == (True, None) and told[3, "free"] == (True, "f") and told[1, "free"] == (True, None)
