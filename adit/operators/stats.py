"""Statistics over repeated runs: selection, guards, description, outliers, bias."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adit.functions.quantiles import with_quantiles


def newest(runs: DataFrame, keys: tuple[str, ...] = ("dataset", "rep", "cloud_id")) -> DataFrame:
    """The newest run of each key: by stamp, then run number, then volume.

    An aggregate and no window: a task sorts by the keys only, and hands on one row of each.
    """
    order = ["stamp", "run_no", "volume"]
    rest = [c for c in runs.columns if c not in keys and c not in order]
    found = [F.max(F.struct(*order)).alias("newest")] + ([F.max_by(F.struct(*rest), F.struct(*order)).alias("rest")] if rest else [])
    of = lambda c: c if c in keys else F.col("rest" if c in rest else "newest")[c].alias(c)
    return runs.groupBy(*keys).agg(*found).select(*map(of, runs.columns))


def last_by_path(runs: DataFrame, path: str, keys: tuple[str, ...] = ("dataset",)) -> DataFrame:
    """The run that sorts last by path, of each key."""
    whole = F.struct(*[c for c in runs.columns if c not in keys])
    return runs.groupBy(*keys).agg(F.max_by(whole, path).alias("run")).select(*keys, "run.*")


def comparability(settings: DataFrame, keys: list[str], run: str = "run_id", group: str = "dataset") -> DataFrame:
    """Problem rows (group, key, n_values, values): settings that are not the same in all runs of a group.

    One pass over the long form; NULL is a value of its own.
    """
    long = settings.select(group, run, F.explode(F.map_from_arrays(F.array(*map(F.lit, keys)), F.array(*[F.coalesce(F.to_json(F.struct(F.col(k).alias("v"))), F.lit("{}")) for k in keys]))).alias("key", "value"))
    found = long.groupBy(group, "key").agg(F.count_distinct("value").alias("n_values"), F.array_sort(F.collect_set("value")).alias("values"))
    return found.where("n_values > 1")


def fingerprint(caps: DataFrame, run: str = "run_id") -> DataFrame:
    """(run, caps): the cap points of each run as text, to a tenth of a millimetre, for comparability()."""
    point = F.concat_ws(" ", *[F.format_string("%.4f", c) for c in ("x", "y", "z")])
    return caps.groupBy(run).agg(F.concat_ws("; ", F.array_sort(F.collect_list(point))).alias("caps"))


def input_marks(provenance: DataFrame, inputs: tuple[str, ...] = ("ref_ply", "targets_ref"), run: str = "run_id") -> DataFrame:
    """(run, <input> ...): path and size of the inputs that all runs must share, for comparability(); from (run, input, path, bytes)."""
    mark = F.concat_ws(" ", "path", "bytes")
    return provenance.groupBy(run).agg(*[F.max(F.when(F.col("input") == i, mark)).alias(i) for i in inputs])


def require_comparable(problems: DataFrame, strict: bool) -> list[str]:
    """The problems as text; with ``strict`` an error if there is one. There are at most as many as settings."""
    said = [f"{r[0]}: {r.key} has {r.n_values} values" for r in problems.orderBy(*problems.columns[:2]).collect()]
    if said and strict:
        raise ValueError("runs are not comparable: " + "; ".join(said))
    return said


def describe(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, mean, range, spread, 95 % intervals of mean and deviation, and Grubbs' critical value, for each key.

    Intervals need two values, Grubbs' test three; the quantiles are exact for every n.
    """
    v = F.col(value)
    s = rows.where(v.isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"), F.stddev_samp(v).alias("sd"))
    s = with_quantiles(s)
    df, sem = F.col("n") - 1, F.col("sd") / F.sqrt("n")
    return s.select(
        *keys, "n", "mean", "min", "max", "sd", (F.col("sd") / F.nullif("mean", F.lit(0.0)) * 100).alias("cv_pct"), sem.alias("sem"),
        (F.col("mean") - F.col("t") * sem).alias("ci95_lo"), (F.col("mean") + F.col("t") * sem).alias("ci95_hi"), F.when(F.col("n") > 1, F.col("max") - F.col("min")).alias("range"),
        (F.col("sd") * F.sqrt(df / F.col("chi_lo"))).alias("sd_ci95_lo"), (F.col("sd") * F.sqrt(df / F.col("chi_hi"))).alias("sd_ci95_hi"), "g_crit",
    )


def grubbs(rows: DataFrame, keys: list[str], value: str, label: str) -> DataFrame:
    """Largest deviation in units of sd, its critical value, the label of the outlier (first among equals) and the flag.

    The mean of each key is joined back, so that a key of any size stays in several tasks.
    """
    v = rows.where(F.col(value).isNotNull())
    s = v.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.min(value).alias("lo"), F.max(value).alias("hi")).where("n >= 3")
    # the farthest values are the ends of the range: the smaller label of those at either end that is as far
    ends = v.groupBy(*keys).agg(F.min(F.struct(F.col(value), F.col(label).alias("label"))).alias("low"), F.min(F.struct((-F.col(value)).alias("v"), F.col(label).alias("label"))).alias("high"))
    s = with_quantiles(s).join(ends, keys)
    down, up = F.col("mean") - F.col("lo"), F.col("hi") - F.col("mean")
    outlier = F.when(down > up, F.col("low.label")).when(up > down, F.col("high.label")).otherwise(F.least("low.label", "high.label"))
    spread = F.col("sd") > 0
    g = F.when(spread, F.greatest(down, up) / F.col("sd")).otherwise(0.0)
    return s.select(*keys, "n", g.alias("g"), F.when(spread, F.col("g_crit")).alias("g_crit"), F.when(spread, outlier).alias("outlier"), F.coalesce(spread & (g > F.col("g_crit")), F.lit(False)).alias("flagged"))


def bias(runs: DataFrame, keys: list[str], ref: str = "ref", other: str = "mobile") -> DataFrame:
    """Mean and spread of the other cloud's volumes against the mean reference, for each key."""
    side = lambda c: F.when(F.col("cloud_id") == c, F.col("volume"))
    s = runs.groupBy(*keys).agg(F.avg(side(ref)).alias("reference"), F.count(side(ref)).alias("n_ref"), F.count(side(other)).alias("n"), F.avg(side(other)).alias("mean"), F.stddev_samp(side(other)).alias("sd_delta"))
    s = s.where("n_ref > 0 and n > 0").withColumn("mean_delta", F.col("mean") - F.col("reference"))
    return s.select(*keys, "reference", "n_ref", "n", "mean_delta", (F.col("mean_delta") / F.col("reference") * 100).alias("mean_delta_pct"), "sd_delta")


def pairs(runs: DataFrame, keys: list[str], ref: str = "ref", other: str = "mobile") -> DataFrame:
    """Keys that have both clouds, with the difference."""
    side = lambda c: F.max(F.when(F.col("cloud_id") == c, F.col("volume")))
    both = runs.groupBy(*keys).agg(side(ref).alias("v_ref"), side(other).alias("v_oth")).where("v_ref is not null and v_oth is not null")
    return both.withColumn("delta", F.col("v_oth") - F.col("v_ref")).withColumn("delta_pct", F.col("delta") / F.col("v_ref") * 100)


def paired_bias(runs: DataFrame, pair_keys: list[str], keys: list[str], ref: str = "ref", other: str = "mobile") -> DataFrame:
    """Statistics of the pairs of each key, where there are two or more."""
    return pairs(runs, pair_keys, ref, other).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("delta").alias("mean_delta"), F.avg("delta_pct").alias("mean_delta_pct"), F.stddev_samp("delta").alias("sd_delta")).where("n >= 2")


def method_spread(runs: DataFrame, keys: list[str], a: str = "profiles", b: str = "surface_mesh") -> DataFrame:
    """100 * (b - a) / a of two methods within each key."""
    side = lambda m: F.max(F.when(F.col("method") == m, F.col("volume")))
    both = runs.where(F.col("method").isin(a, b)).groupBy(*keys).agg(side(a).alias("va"), side(b).alias("vb")).where("va <> 0 and vb <> 0")
    return both.select(*keys, ((F.col("vb") - F.col("va")) / F.col("va") * 100).alias("delta_pct"))


def long_form(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """(keys, metric, value) of several numeric columns."""
    return df.unpivot(keys, metrics, "metric", "value")


def finite(x: Column) -> Column:
    """NULL for NaN and infinities."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)
