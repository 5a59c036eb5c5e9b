"""Which files make a run: discovery of datasets and repetitions from a listing of files, and planning of runs.

A listing is readers.files(): (path, bytes, mtime), with paths that end in
<dataset>/<file> or <dataset>/<rep>/<file>. All rules are grouped SQL over it.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adit.sources.readers import SURVEY_FILES


def placed(listing: DataFrame, root: str) -> DataFrame:
    """(dataset, rep, name, path, bytes, mtime) of the files one or two folders below ``root``; rep is null in a dataset's own folder."""
    inner = F.regexp_extract("path", r"^(?:[a-z0-9+.-]+:/*)?/?(.*)$", 1)
    start = root.split(":", 1)[-1].strip("/") + "/"
    rows = listing.where(inner.startswith(start)).withColumn("part", F.split(F.substring(inner, F.lit(len(start) + 1), F.length(inner)), "/"))
    n = F.size("part")
    rows = rows.where(n.isin(2, 3) & ~F.exists("part", lambda x: x.startswith(".")))
    return rows.select(F.col("part")[0].alias("dataset"), F.when(n == 3, F.col("part")[1]).alias("rep"), F.element_at("part", -1).alias("name"), "path", "bytes", "mtime")


def datasets(files: DataFrame) -> DataFrame:
    """Names of the datasets that hold a reference cloud, in order."""
    return files.where(F.col("rep").isNull() & F.col("name").isin(*SURVEY_FILES["ref_ply"])).select("dataset").distinct().orderBy("dataset")


def reps(files: DataFrame) -> DataFrame:
    """(dataset, rep) of the repetitions, in order."""
    return files.where(F.col("rep").isNotNull()).select("dataset", "rep").distinct().orderBy("dataset", "rep")


def _first(names: tuple[str, ...], here: Column) -> Column:
    """The path of the first of ``names`` among a group's files."""
    rank = F.array_position(F.array(*map(F.lit, names)), F.col("name"))
    return F.min_by("path", F.when(here & (rank > 0), rank))


def runs(files: DataFrame) -> DataFrame:
    """The inputs of every repetition (dataset, rep, a path each) and ``problem``, NULL where all that is needed is there.

    The mobile cloud must be the one PLY of its folder: several are a problem, not a guess. Of
    trajectories and matrices the first name in order wins; targets of the mobile scan and caps may be missing.
    """
    in_rep, ply = F.col("rep").isNotNull(), F.col("name").endswith(".ply")
    own = files.where(in_rep).groupBy("dataset", "rep").agg(
        F.count_if(ply).alias("n_ply"), F.min(F.when(ply, F.col("path"))).alias("mobile_ply"), F.array_join(F.array_sort(F.collect_list(F.when(ply, F.col("name")))), ", ").alias("plys"),
        *[_first(SURVEY_FILES[k], in_rep).alias(k) for k in ("trajectory", "registration", "targets_mobile")],
    )
    shared = files.where(~in_rep).groupBy("dataset").agg(*[_first(SURVEY_FILES[k], ~in_rep).alias(k) for k in ("ref_ply", "targets_ref", "caps")])
    rows = own.join(shared, "dataset", "left")
    lacks = lambda c, what: F.when(F.col(c).isNull(), F.lit(f"no {what}"))
    many = F.when(F.col("n_ply") == 0, F.lit("no mobile cloud")).when(F.col("n_ply") > 1, F.concat(F.col("n_ply").cast("string"), F.lit(" PLY files: "), "plys"))
    said = F.concat_ws("; ", lacks("ref_ply", "reference cloud"), lacks("targets_ref", "reference targets"), many, lacks("trajectory", "trajectory"), lacks("registration", "registration matrix"))
    return rows.select("dataset", "rep", "ref_ply", "mobile_ply", "trajectory", "registration", "targets_ref", "targets_mobile", "caps", F.nullif(said, F.lit("")).alias("problem"))


def provenance(found: DataFrame, files: DataFrame) -> DataFrame:
    """(dataset, rep, input, path, bytes, mtime) of what each run reads; inputs that a run lacks have null paths."""
    inputs = ["ref_ply", "mobile_ply", "trajectory", "registration", "targets_ref", "targets_mobile", "caps"]
    rows = found.unpivot(["dataset", "rep"], inputs, "input", "path")
    return rows.join(files.select("path", "bytes", "mtime"), "path", "left").select("dataset", "rep", "input", "path", "bytes", "mtime")


def planned(found: DataFrame, done: DataFrame, mode: str = "auto", ref_rep: str | None = None) -> DataFrame:
    """(dataset, rep, clouds): which clouds to measure in which repetition.

    auto: the mobile cloud in each, and the reference once a dataset, in ``ref_rep`` or the first repetition, unless
    ``done`` (dataset, rep, cloud_id) has it; both or one cloud's name: that in each.
    """
    if mode != "auto":
        clouds = ["ref", "mobile"] if mode == "both" else [mode]
        return found.select("dataset", "rep", F.array(*map(F.lit, clouds)).alias("clouds"))
    has = done.where("cloud_id = 'ref'").select("dataset").distinct().withColumn("has_ref", F.lit(True))
    first = F.lit(ref_rep) if ref_rep else F.min("rep").over(Window.partitionBy("dataset"))
    rows = found.select("dataset", "rep", first.alias("ref_rep")).join(has, "dataset", "left")
    with_ref = F.col("has_ref").isNull() & (F.col("rep") == F.col("ref_rep"))
    return rows.select("dataset", "rep", F.when(with_ref, F.array(F.lit("ref"), F.lit("mobile"))).otherwise(F.array(F.lit("mobile"))).alias("clouds"))


def feature_capped(summaries: DataFrame) -> DataFrame:
    """For each dataset the last run by path that is capped at features and holds the reference cloud.

    ``summaries``: (dataset, path, cap_mode, clouds array<string>, ...).
    """
    fine = summaries.where((F.col("cap_mode") == "feature_planes") & F.array_contains("clouds", "ref"))
    rest = F.struct(*[c for c in summaries.columns if c != "dataset"])
    return fine.groupBy("dataset").agg(F.max_by(rest, "path").alias("run")).select("dataset", "run.*")
