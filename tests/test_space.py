"""Triangulated fills, iso-surfaces and partitions of space and time, against brute force."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from adit.operators import delaunay, denoise, grid, kd, scan, surface, trajectory, volume
from adit.operators.grid import Grid
from adit.sources import sinks


def empty_circle(q, p, tie):
    """Weights of the corners by looking at all triangles: the lowest over q of the lifted points, then of the order."""
    best = None
    for t in itertools.combinations(range(len(p)), 3):
        a, b, c = (p[k] - q for k in t)
        area = (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
        if area:
            w = [(u[0] * v[1] - u[1] * v[0]) / area for u, v in ((b, c), (c, a), (a, b))]
            if min(w) >= 0:
                key = (round(sum(x * (v**2).sum() for x, v in zip(w, (a, b, c))), 9), sum(x * tie[k] for x, k in zip(w, t)))
                found = (key, tuple((k, round(x, 9)) for k, x in zip(t, w) if x > 1e-12))
                best = min(best, found) if best else found
    return best and dict(best[1])


@pytest.mark.parametrize(("seed", "share"), [(0, 0.12), (1, 0.25), (2, 0.5)])
def test_triangles_have_empty_circles(seed, share):
    rng = np.random.default_rng(seed)
    cells = np.array([(i, j) for i in range(8) for j in range(8)])
    known = rng.random(64) < share
    p, q = cells[known], cells[~known]
    tie = delaunay.order(p[:, 0], p[:, 1])
    corners, weights = delaunay.triangles(q, p, tie)
    for k in range(0, len(q), 3):
        got = None if np.isnan(weights[k, 0]) else {int(c): round(float(w), 9) for c, w in zip(corners[k], weights[k]) if w > 1e-12}
        assert got == empty_circle(q[k], p, tie)


def test_triangles_of_few_points():
    q = np.array([[0, 0], [1, 1]])
    for p in ([], [[5, 5]], [[0, 1], [2, 1]], [[0, 2], [2, 0], [4, -2]]):
        p = np.array(p, np.int64).reshape(-1, 2)
        _, w = delaunay.triangles(q, p, np.zeros(len(p), np.int64))
        assert [bool(np.isnan(x[0])) for x in w] == [True, len(p) < 2]  # (1, 1) lies on the segments


def test_fill_does_not_depend_on_blocks(spark):
    rng = np.random.default_rng(3)
    g = Grid(s0=0.0, s1=40.5, ds=1.0, dt=15.0)
    n_s, n = g.n_slabs, g.n_theta
    known = rng.random((n_s, n)) < 0.5
    known[10:31, 4:19], known[:2], known[20, 20:] = False, False, False
    r = 2 + rng.random((n_s, n))
    rows = [("a", i, j, float(r[i, j])) for i in range(n_s) for j in range(n) if known[i, j]] + [("b", 3, 4, 1.5)]
    cells = spark.createDataFrame(rows, "cloud_id string, i long, j long, r double")
    found = [{(x.cloud_id, x.i, x.j): x for x in delaunay.triangulated(cells, g, w).collect()} for w in (4, 11, 1000)]
    assert found[0] == found[1] == found[2] and len(found[0]) == 2 * n_s * n
    assert all(x.r == 1.5 for k, x in found[0].items() if k[0] == "b")
    # all at once, over all known cells instead of rims
    p = np.array([(i, j + k * n) for i in range(n_s) for j in range(n) if known[i, j] for k in (-1, 0, 1)])
    q = np.argwhere(~known)
    want = delaunay.solved(q, p, np.array([r[i, j % n] for i, j in p]), delaunay.order(p[:, 0], p[:, 1] % n), None)
    got = np.array([found[0]["a", int(i), int(j)].r for i, j in q])
    assert np.allclose(got, want, atol=1e-12) and not np.isnan(got).any()
    assert all(found[0]["a", i, j].interpolated != known[i, j] for i in range(n_s) for j in range(n))
    # a plane around no seam: linear radii come back
    flat = spark.createDataFrame([("a", i, j, 1.0 + 0.1 * i) for i in range(n_s) for j in range(n) if known[i, j]], cells.schema)
    assert max(abs(x.r - 1.0 - 0.1 * x.i) for x in delaunay.triangulated(flat, g, 8).collect() if 2 <= x.i) < 1e-9


def test_fill_of_nothing(spark):
    g = Grid(s0=0.0, s1=6.0, ds=1.0, dt=60.0)
    full = spark.createDataFrame([("a", i, j, 1.0) for i in range(g.n_slabs) for j in range(g.n_theta)], "cloud_id string, i long, j long, r double")
    assert delaunay.triangulated(full, g).where("interpolated").count() == 0
    assert delaunay.triangulated(full.limit(0), g).count() == 0


def surface_of(field):
    """Triangles around the true cells, cube by cube, in half cells."""
    table, f, found = surface.triangle_table(), np.pad(field, 1), []
    for x, y, z in itertools.product(*(range(n - 1) for n in f.shape)):
        case = sum(int(f[x + (k & 1), y + (k >> 1 & 1), z + (k >> 2)]) << k for k in range(8))
        found += [[(2 * (x - 1) + a, 2 * (y - 1) + b, 2 * (z - 1) + c) for a, b, c in t] for t in table[case]]
    return np.array(found)


def test_every_case_closes():
    """Any field gives a closed, oriented mesh, and each edge has two triangles."""
    for seed in range(6):
        tri = surface_of(np.random.default_rng(seed).random((5, 5, 5)) < 0.2 + 0.1 * seed).tolist()
        ways = [(tuple(t[k]), tuple(t[(k + 1) % 3])) for t in tri for k in range(3)]
        assert len(set(ways)) == len(ways) and {(b, a) for a, b in ways} == set(ways)
    assert sorted(map(len, surface.triangle_table()))[-1] == 5 and not surface.triangle_table()[0] and not surface.triangle_table()[255]


def test_iso_surface_of_shapes(spark):
    grid = np.indices((16, 16, 16)) - 7.5
    ball = (grid**2).sum(0) < 36
    apart = np.zeros((3, 3, 1), bool)
    apart[0, 0] = apart[1, 1] = True  # across an edge: each is cut off alone
    rows = [("ball", *map(int, c)) for c in np.argwhere(ball)] + [("apart", *map(int, c)) for c in np.argwhere(apart)] + [("one", -3, 0, 7), ("one", -3, 0, 7)]
    meshed = surface.iso_surface(spark.createDataFrame(rows, "cloud_id string, ix long, iy long, iz long"), 0.5).persist()
    got = {r.cloud_id: r for r in surface.measured(meshed).collect()}
    assert all(r.closed and r.oriented for r in got.values())
    assert got["one"].volume == pytest.approx(0.125 / 6) and got["one"].n_faces == 8 and got["one"].area == pytest.approx(8 * np.sqrt(3) / 8 * 0.25)
    assert got["apart"].volume == pytest.approx(2 * 0.125 / 6) and got["apart"].n_faces == 16
    want = surface_of(ball).astype(float)
    assert got["ball"].n_faces == len(want) and got["ball"].volume == pytest.approx(np.linalg.det(want).sum() / 48 * 0.125)
    assert abs(got["ball"].volume / (4 / 3 * np.pi * 27) - 1) < 0.03 and got["ball"].n_edges * 2 == got["ball"].n_faces * 3
    v = volume.vertices(meshed.where("cloud_id = 'ball'"))
    assert v.count() - got["ball"].n_edges + got["ball"].n_faces == 2  # a sphere's Euler number: corners are welded


def test_iso_surface_as_ply(spark, tmp_path):
    meshed = surface.iso_surface(spark.createDataFrame([("a", x, y, 0) for x in range(3) for y in range(2)], "cloud_id string, ix long, iy long, iz long"), 1.0)
    n_v, n_f = sinks.mesh_ply(meshed, str(tmp_path / "m.ply"))
    r = surface.measured(meshed).first()
    assert (n_v, n_f) == (2 + r.n_edges - r.n_faces, r.n_faces)
    assert b"element face %d" % n_f in (tmp_path / "m.ply").read_bytes()[:400]


def test_one_long_run_is_dealt(spark):
    """Arclength, samples and poses of one run, against numpy; no task has an eighth of the rows."""
    rng = np.random.default_rng(8)
    n = 4000
    p = np.cumsum(rng.normal(size=(n, 3)), axis=0)
    p[100:140] = p[100]
    traj = spark.createDataFrame([("a", k, float(k) / 2, *map(float, v)) for k, v in enumerate(p)] + [("b", k, float(k), float(k), 0.0, 0.0) for k in range(3)] + [("c", 0, 0.0, 1.0, 1.0, 1.0)], "run_id string, seq long, t double, x double, y double, z double")
    names = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        sizes = [r.n for r in scan.dealt(traj, "run_id", "seq").groupBy(scan.PART).agg(F.count(F.lit(1)).alias("n")).collect()]
        assert max(sizes) < n / 8
        s = np.concatenate([[0], np.cumsum(np.linalg.norm(np.diff(p, axis=0), axis=1))])
        got = trajectory.with_arclength(traj).where("run_id = 'a'").orderBy("seq").toPandas()
        assert np.allclose(got["s"], s, atol=1e-8) and (np.diff(got["s"]) >= 0).all() and list(got.columns) == [*traj.columns, "s"]
        got = trajectory.resampled(traj, 2.5)
        assert {r.run_id for r in got.collect()} == {"a", "b"}
        a = got.where("run_id = 'a'").orderBy("k").toPandas()
        even = np.linspace(0, s[-1], int(s[-1] // 2.5) + 1)
        assert a["k"].tolist() == list(range(len(even))) and np.allclose(a["s"], even, atol=1e-7)
        assert np.allclose(a[["x", "y", "z"]], np.column_stack([np.interp(even, s, p[:, c]) for c in range(3)]), atol=1e-6)
        ask = np.concatenate([rng.uniform(-5, n / 2 + 5, 3000), [10.0, 10.0, n / 2 - 0.5]])
        asked = spark.createDataFrame([("a", float(v)) for v in ask] + [("c", 5.0), ("none", 1.0)], "run_id string, t double")
        got = trajectory.interpolated(asked, traj).orderBy("t").toPandas()
        here = got[got["run_id"] == "a"]
        assert len(here) == len(ask) and np.allclose(here[["x", "y", "z"]], np.column_stack([np.interp(np.sort(ask), np.arange(n) / 2, p[:, c]) for c in range(3)]), atol=1e-9)
        assert got[got["run_id"] == "c"][["x", "y", "z"]].to_numpy().tolist() == [[1, 1, 1]] and got[got["run_id"] == "none"]["x"].isna().all()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_cells_without_a_sort(spark):
    """Gaps and medians of cells with few points, and of one with a third of all, against numpy."""
    rng = np.random.default_rng(2)
    sets = {(0, 0): rng.normal(2, 0.05, 9000), (0, 1): [1.0], (0, 2): [1.0, 1.3], (0, 3): [1.0, 1.31], (0, 4): [2.0] * 7000, (0, 5): np.concatenate([rng.normal(2, 0.01, 6000), rng.normal(3, 0.01, 6000)]), (0, 6): [-0.4, -0.05, 0.3, 0.31], (0, 7): rng.integers(0, 3, 8001) * 0.25}
    rows = [("a", i, j, float(v)) for (i, j), r in sets.items() for v in r]
    points = spark.createDataFrame(rows, "cloud_id string, i long, j long, r double").repartition(7)
    for most in (1_000_000, 500):
        got = {(r.i, r.j): r for r in grid.bimodal_grid(points, 0.30, most).collect()}
        assert len(got) == len(sets)
        for cell, r in sets.items():
            r = np.sort(np.asarray(r, float))
            two = len(r) > 1 and bool((np.diff(r) > 0.30).any())
            assert (got[cell].n, got[cell].bimodal) == (len(r), two) and got[cell].r == pytest.approx(r[-1] if two else np.median(r), abs=1e-12), cell
    plan = grid.bimodal_grid(points)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_neighbours_in_clouds_of_any_density(spark):
    """Against all pairs: a dense ball in thin air, copies of a point, two clouds, points without coordinates; in many leaves."""
    rng = np.random.default_rng(6)
    dense, thin = rng.normal(0, 0.01, (1500, 3)), rng.uniform(-20, 20, (150, 3))
    clouds = {"a": np.concatenate([dense, thin, np.tile([[3.0, 3.0, 3.0]], (60, 1))]), "b": rng.normal(size=(40, 3)), "c": np.array([[0.0, 0, 0], [1, 0, 0]])}
    rows = [(c, k, *map(float, v)) for c, p in clouds.items() for k, v in enumerate(p)] + [("a", 9000, None, 1.0, 1.0), ("b", 9001, float("nan"), 1.0, 1.0)]
    points = spark.createDataFrame(rows, "cloud_id string, pid long, x double, y double, z double").repartition(4)
    got = {(r.cloud_id, r.pid): r.d for r in denoise.neighbour_distances(points, 5, leaf=64).collect()}
    assert len(got) == len(rows) and got["a", 9000] == got["b", 9001] == 0
    for c, p in clouds.items():
        d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(2))
        np.fill_diagonal(d, np.inf)
        d = np.sort(d, axis=1)[:, :5]
        want = [x[np.isfinite(x)].mean() for x in d]
        assert np.allclose([got[c, k] for k in range(len(p))], want, atol=1e-12)


def test_comparisons_are_bounded_whatever_the_density():
    rng = np.random.default_rng(7)
    p = np.concatenate([rng.uniform(0, 0.05, (20_000, 3)), rng.uniform(0, 1, (1600, 3)), np.zeros((5000, 3))])  # 1 : 10,000 and more
    near, made = kd.nearest(p, np.arange(len(p)), p, np.arange(len(p)), 8)
    assert made / len(p) < 12_000 and (near[-5000:] == 0).all()
    some = rng.choice(len(p), 50, replace=False)
    d = np.sqrt(((p[some][:, None] - p[None]) ** 2).sum(2))
    d[np.arange(50), some] = np.inf
    assert np.allclose(np.sort(near[some], axis=1), np.sort(d, axis=1)[:, :8])


def test_comparisons_are_few():
    rng = np.random.default_rng(8)
    for n in (4000, 16_000):
        p, q = rng.random((n, 3)), rng.random((300, 3)) * 1.2
        near, made = kd.nearest(p, np.arange(n), p, np.arange(n), 8)
        assert made / n < 200  # more than 700 before
        d = np.sort(np.sqrt(((q[:, None] - p[None]) ** 2).sum(2)), axis=1)[:, :8]
        far = d[:, 4]
        got, _ = kd.nearest(q, np.arange(300) + n, p, np.arange(n), 8)
        assert np.allclose(np.sort(got, axis=1), d)
        cut, less = kd.nearest(q, np.arange(300) + n, p, np.arange(n), 8, bound=far)
        assert np.allclose(np.sort(cut, axis=1)[:, :5], d[:, :5])


def test_a_split_covers_space():
    rng = np.random.default_rng(1)
    p = np.concatenate([rng.normal(size=(3000, 3)), np.ones((1000, 3))])
    s = kd.Split(p, 100)
    sizes = np.bincount(s.leaf(p), minlength=s.leaves)
    assert sizes.sum() == 4000 and np.sort(sizes)[-2] <= 100 and (sizes > 0).all()
    q, r = rng.normal(size=(200, 3)) * 3, rng.uniform(0, 1, 200)
    rows, leaves = s.touched(q, r)
    there = set(zip(rows.tolist(), leaves.tolist()))
    for k in range(200):  # every point in a ball lies in a leaf that the ball touches
        inside = np.linalg.norm(p - q[k], axis=1) <= r[k]
        assert {(k, int(v)) for v in s.leaf(p[inside])} <= there
