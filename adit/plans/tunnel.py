"""From files to volumes: one repetition of a survey in a curved tunnel, and many of them.

The mobile trajectory is registered into the reference frame and gives the
centreline; both clouds are laid about it; two planes bound the domain; volumes,
coverage and comparisons are those of pipeline.measure() in that frame.
"""

import time
import uuid
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from dataclasses import asdict, dataclass, field, replace

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from adit.operators import caps, cavity, centreline, targets, trajectory
from adit.operators.graph import kept
from adit.plans.pipeline import Config, measure
from adit.sources import cache, readers, sinks


@dataclass(frozen=True)
class Run:
    """Settings of a run: what to measure, where it ends, and what may be reused."""

    measure: Config = field(default_factory=Config)
    clouds: tuple[str, ...] = ("ref", "mobile")
    cap_mode: str = "auto"
    start_target: int = 0
    end_target: int = 7
    step_m: float = 0.5
    smoothing: float = 0.05
    line_ds_m: float = 0.10
    gravity: bool = True
    hull: bool = True
    mesh: bool = True
    voxel_sizes_m: tuple[float, ...] = ()
    seal: int = 1
    cache_root: str | None = None

    @classmethod
    def from_environment(cls, values: dict[str, str], prefix: str = "ADIT_") -> "Run":
        """Settings from text values such as those of the environment; names that are none are an error."""
        kinds = {"cap_mode": str, "start_target": int, "end_target": int, "step_m": float, "smoothing": float, "line_ds_m": float, "seal": int, "cache_root": str}
        told = {k.removeprefix(prefix).lower(): v for k, v in values.items() if k.startswith(prefix)}
        flags = {k: told.pop(k).lower() in ("1", "true", "yes") for k in ("gravity", "hull", "mesh") if k in told}
        clouds = {"clouds": tuple(told.pop("clouds").split(","))} if "clouds" in told else {}
        if wrong := sorted(set(told) - set(kinds)):
            raise ValueError(f"no settings: {', '.join(wrong)}")
        return cls(**{k: kinds[k](v) for k, v in told.items()}, **flags, **clouds)


def fingerprint(df: DataFrame) -> str:
    """A name for a table's rows, whatever their order: their number and two sums of their hashes."""
    h = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).cast("decimal(38,0)")
    return "-".join(map(str, df.agg(F.count(F.lit(1)), F.sum(h), F.sum(F.pmod(h * 31, F.lit(1_000_003)))).first()))


def made_of_files(spark: SparkSession, paths: list[str]) -> str:
    """A name for input files: path, bytes and time of change of each."""
    found = spark.read.format("binaryFile").load(sorted(set(paths))).select("path", "length", "modificationTime")
    return ";".join(f"{r.path}:{r.length}:{r.modificationTime.timestamp()}" for r in found.orderBy("path").collect())  # a run has seven


def tunnel(spark: SparkSession, clouds: DataFrame, traj: DataFrame, surveyed: DataFrame, end_caps: DataFrame | None = None, run: Run = Run(), name: str = "run", made_of: str | None = None) -> dict:
    """Everything measured of clouds (cloud_id, pid, x, y, z) in a tunnel along a trajectory, all in the reference frame.

    What is cached is found again under the settings and ``made_of``, a name for the inputs; without it that is made from their rows.

    ``surveyed``: targets (net, cloud_id, idx, x, y, z) with those of the reference that may bound the domain; ``end_caps``:
    two points (idx, x, y, z). The result holds DataFrames, and ``domain`` and ``centreline`` as plain values.
    """
    ref = surveyed.where("cloud_id = 'ref'")
    targets.check_indices(ref, run.start_target, run.end_target)
    far = ref.where(F.col("idx") == run.end_target).select("x", "y", "z").first()
    frame, line = centreline.centreline(spark, traj, run.step_m, run.smoothing, run.line_ds_m, run.gravity, toward=tuple(far))
    frame = kept(frame)
    (s0, s1), info = caps.domain(ref.select("idx", "x", "y", "z"), end_caps, frame, run.cap_mode, run.start_target, run.end_target)
    grid = replace(run.measure.grid, s0=s0, s1=s1)
    cfg = replace(run.measure, grid=grid)
    laid = lambda: trajectory.cylindrical(clouds.where(F.col("cloud_id").isin(*run.clouds)), frame)
    if run.cache_root:
        made_of = made_of or ";".join(fingerprint(t) for t in (clouds, traj, surveyed, end_caps) if t is not None)
        signature = f"{cfg.signature()}-{run.step_m}-{run.smoothing}-{run.line_ds_m}-{run.gravity}-{run.end_target}-{','.join(run.clouds)}-{made_of}"
        points = cache.kept_or_made(spark, run.cache_root, name, signature, laid)
    else:
        points = kept(laid())
    out = measure(points, cfg, run.hull, frame, run.mesh)
    if run.voxel_sizes_m:
        ends = frame.where((F.col("s") >= s0) & (F.col("s") <= s1)).agg(*[f(F.struct(*[v + c for v in "pt" for c in "xyz"]), "s").alias(n) for n, f in (("a", F.min_by), ("b", F.max_by))]).first()
        planes = [(tuple(ends.a)[:3], tuple(ends.a)[3:]), (tuple(ends.b)[:3], tuple(-v for v in tuple(ends.b)[3:]))]
        out["voxels"] = cavity.voxel_volumes(clouds.where(F.col("cloud_id").isin(*run.clouds)), list(run.voxel_sizes_m), run.seal, planes)
    if surveyed.where("cloud_id = 'mobile'").take(1):
        out["scale"], out["consistency"] = targets.scale(targets.pair_distances(surveyed)), targets.consistency(surveyed)
        out["decomposition"] = targets.decomposition(surveyed, out["profiles"].select("cloud_id", "mean_area"), run.start_target, run.end_target)
    return out | {"points": points, "frame": frame, "domain": (s0, s1), "domain_info": info, "centreline": line}


def of_files(spark: SparkSession, inputs: dict[str, str | None], run: Run = Run(), name: str = "run") -> dict:
    """tunnel() of one row of datasets.runs(): reads clouds, trajectory, matrix, targets and caps."""
    matrix = readers.registration(spark, inputs["registration"])
    traj = readers.registered_trajectory(spark, inputs["trajectory"], matrix)
    paths = {"ref": inputs["ref_ply"], "mobile": inputs["mobile_ply"]}
    clouds = [readers.ply(spark, paths[c]).withColumn("cloud_id", F.lit(c)) for c in run.clouds]
    for c in clouds[1:]:
        clouds[0] = clouds[0].unionByName(c)
    told = [readers.targets(spark, inputs[k], c) for k, c in (("targets_ref", "ref"), ("targets_mobile", "mobile")) if inputs.get(k)]
    for t in told[1:]:
        told[0] = told[0].unionByName(t)
    end_caps = readers.targets(spark, inputs["caps"], "caps").drop("cloud_id") if inputs.get("caps") else None
    used = [paths[c] for c in run.clouds] + [inputs[k] for k in ("trajectory", "registration", "targets_ref", "targets_mobile", "caps") if inputs.get(k)]
    return tunnel(spark, clouds[0], traj, told[0].withColumn("net", F.lit(0)), end_caps, run, name, made_of_files(spark, used) if run.cache_root else None)


def summary(out: dict, dataset: str, rep: str, run: Run, inputs: dict[str, str | None] | None = None) -> dict:
    """The plain values of a run, for summary.json: settings, domain, centreline, inputs, and the results of each cloud; no number that is not finite."""
    finite = lambda v: None if isinstance(v, float) and (v != v or v in (float("inf"), float("-inf"))) else v
    results: dict[str, dict] = {}
    for r in out["volumes"].collect():  # a row a cloud and method
        results.setdefault(r.cloud_id, {"volumes": {}})["volumes"][r.method] = finite(r.volume)
    for r in out["coverage"].collect():
        results.setdefault(r.cloud_id, {})["gap_frac_missing"] = finite(r.frac_missing)
    for r in out["profiles"].collect():
        results.setdefault(r.cloud_id, {}).update(mean_area_m2=finite(r.mean_area), frac_interp_mean=finite(r.frac_interp))
    s0, s1 = out["domain"]
    return {
        "schema": 2, "dataset": dataset, "rep": rep, "clouds": list(run.clouds), "inputs": inputs or {}, "config": asdict(run), "results": results,
        "domain": {"s_start_m": s0, "s_end_m": s1, "L_m": s1 - s0} | out["domain_info"], "centreline": {k: finite(v) for k, v in out["centreline"].items()},
    }


#: What run_summaries() reads of a run.
SUMMARY = "results map<string,struct<volumes:map<string,double>>>, config map<string,string>"


def finished(spark: SparkSession, results: str) -> DataFrame:
    """(dataset, rep, stamp, run_no, cloud_id, method, volume, settings) of all runs below ``results``, for pipeline.statistics() and, as ``done``, for datasets.planned().

    run_no counts a repetition's runs by stamp; settings is what was set, without clouds and cache.
    """
    found = readers.run_summaries(spark, results, SUMMARY)
    order = F.dense_rank().over(Window.partitionBy("dataset", "rep").orderBy("stamp"))
    told = F.to_json(F.map_filter("config", lambda k, _: ~k.isin("clouds", "cache_root")))
    rows = found.select("dataset", "rep", "stamp", order.alias("run_no"), told.alias("settings"), F.explode("results").alias("cloud_id", "result"))
    return rows.select("dataset", "rep", "stamp", "run_no", "cloud_id", F.explode("result.volumes").alias("method", "volume"), "settings")


def _one_run(spark: SparkSession, r, results: str, stamp: str, run: Run, measured) -> str:
    inputs, own = r.asDict(), replace(run, clouds=tuple(r.clouds))
    out = measured(spark, inputs, own, f"{r.dataset}/{r.rep}")
    folder = sinks.run_folder(out["volumes"], results, r.dataset, r.rep, stamp)
    told = {k: inputs[k] for k in ("ref_ply", "mobile_ply", "trajectory", "registration", "targets_ref", "targets_mobile", "caps")}
    sinks.run_record(spark, folder, summary(out, r.dataset, r.rep, own, told), [f"{r.dataset}/{r.rep}: {', '.join(own.clouds)}"])
    return folder


def all_runs(spark: SparkSession, found: DataFrame, plan: DataFrame, results: str, stamp: str, run: Run = Run(), at_once: int = 2, limit_s: float | None = None, measured=of_files) -> DataFrame:
    """Runs every planned repetition, ``at_once`` at a time, and writes a folder each; one that fails stops no other.

    Each run has a thread, a scheduler pool and a job tag of its own, so that under FAIR scheduling runs share the
    cluster, and one that takes over ``limit_s`` seconds has its jobs, and no others, cancelled until it ends. What a run does on the
    driver between jobs is not interrupted.
    ``found``: datasets.runs(); ``plan``: datasets.planned(); ``measured``: of_files() or another measurement of a run's inputs.
    Returns (dataset, rep, clouds, folder, error, seconds, cancelled), with error NULL where all went well.
    """
    sc, began, tagged = spark.sparkContext, {}, uuid.uuid4().hex

    def work(k: int, r):
        sc.setLocalProperty("spark.scheduler.pool", f"run-{k % at_once}")
        sc.addJobTag(f"{tagged}-{k}")
        began[k] = time.monotonic()
        try:
            return _one_run(spark, r, results, stamp, run, measured), None
        except Exception as e:  # noqa: BLE001
            return None, f"{type(e).__name__}: {str(e)[:500]}"
        finally:
            sc.clearJobTags()
            sc.setLocalProperty("spark.scheduler.pool", None)

    rows = found.join(plan, ["dataset", "rep"]).orderBy("dataset", "rep").collect()  # a row a repetition
    report, over, late = {}, {}, set()
    with ThreadPoolExecutor(at_once) as pool:
        going = {pool.submit(inheritable_thread_target(spark)(work), k, r): k for k, r in enumerate(rows) if r.problem is None}
        while going:
            done, _ = wait(going, 0.2, FIRST_COMPLETED)
            for f in done:
                k = going.pop(f)
                report[k], over[k] = f.result(), time.monotonic() - began[k]
            for k in going.values():
                if limit_s is not None and k in began and time.monotonic() - began[k] > limit_s:
                    late.add(k)
                    sc.cancelJobsWithTag(f"{tagged}-{k}")
    said = []
    for k, r in enumerate(rows):
        folder, error = report.get(k, (None, r.problem))
        cut = k in late and error is not None
        said.append((r.dataset, r.rep, list(r.clouds), folder, f"cancelled after {limit_s} s" if cut else error, over.get(k), cut))
    return spark.createDataFrame(said, "dataset string, rep string, clouds array<string>, folder string, error string, seconds double, cancelled boolean")
