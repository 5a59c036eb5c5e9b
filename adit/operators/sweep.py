"""Parameter sweeps: scoring of trials, parameter checks, ranges, conditional parameters."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def trial_metrics(reps: DataFrame, penalty: float = 100.0) -> DataFrame:
    """Objective (RMSE with failed repetitions at the penalty) and statistics of the successes, for each trial."""
    e = F.when(F.col("failed"), F.lit(penalty)).otherwise(F.col("error_m"))
    good = F.when(~F.col("failed"), F.col("error_m"))
    return reps.groupBy("trial_id").agg(
        F.sqrt(F.sum(e * e) / F.count(F.lit(1))).alias("objective"), F.count(F.lit(1)).alias("num_runs"), F.count_if("failed").alias("num_failures"),
        F.avg(good).alias("mean_error"), F.stddev_pop(good).alias("std_error"), F.max(good).alias("max_error"), F.min(good).alias("min_error"),
    )


def failure_breakdown(reps: DataFrame) -> DataFrame:
    """(trial_id, reason, n) of failed repetitions; no reason is ``unknown``."""
    reason = F.coalesce(F.nullif("failure_reason", F.lit("")), F.lit("unknown"))
    return reps.where("failed").groupBy("trial_id", reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def failure_map(reps: DataFrame) -> DataFrame:
    """The breakdown as a map of each trial; it holds as many entries as there are reasons."""
    return failure_breakdown(reps).groupBy("trial_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("failures"))


def classified(runs: DataFrame, limit_m: float = 1000.0) -> DataFrame:
    """Outcome of each repetition from (exit_code, has_trajectory, error_m, path_length_m): failed and failure_reason.

    124 is a timeout; an error that is no number is no failure, as no comparison with the limit holds.
    """
    reason = F.when(F.col("exit_code") == 124, "timeout").when(F.col("exit_code") != 0, F.concat(F.lit("exit_"), F.col("exit_code").cast("string"))).when(~F.col("has_trajectory"), "no_trajectory").when(~F.isnan("path_length_m") & (F.col("path_length_m") > limit_m), "runaway").otherwise("")
    return runs.withColumn("failure_reason", reason).withColumn("failed", F.col("failure_reason") != "")


def good_trials(trials: DataFrame, limit: float = 99.0) -> DataFrame:
    """Complete trials below the limit."""
    return trials.where((F.col("state") == "COMPLETE") & (F.col("value") < limit))


def pooled(trials: DataFrame) -> DataFrame:
    """The complete trials that have a value, of all studies."""
    return trials.where((F.col("state") == "COMPLETE") & F.col("value").isNotNull())


def unknown_parameters(params: DataFrame, known: DataFrame) -> DataFrame:
    """Parameters without an entry in the map."""
    return params.join(known, "name", "left_anti")


def config_patches(params: DataFrame, mapping: DataFrame) -> DataFrame:
    """Values by file and JSON path, a map a file: each file is written once. ``mapping``: (name, file, path), a row a known parameter."""
    rows = params.join(mapping, "name")
    return rows.groupBy("trial_id", "file").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("path", "value")))).alias("patch"))


def best_and_bounds(trials: DataFrame, params: DataFrame, space: DataFrame, share: float = 0.15) -> DataFrame:
    """For each parameter of the best trial its place in the searched range (on a log scale where it was) and a verdict."""
    best = trials.where("value is not null").agg(F.min_by("trial_id", F.struct("value", "trial_id")).alias("trial_id"))
    rows = params.join(best, "trial_id").join(space, "name")
    x, lo, hi = (F.when(F.col("scale") == "log", F.log(c)).otherwise(F.col(c)) for c in ("value", "lo", "hi"))
    at = (x - lo) / F.nullif(hi - lo, F.lit(0.0))
    verdict = F.when(at <= share, "near low").when(at >= 1 - share, "near high").otherwise("inside")
    return rows.select("trial_id", "name", "value", at.alias("place"), verdict.alias("verdict"))


def category_medians(trials: DataFrame, category: str) -> DataFrame:
    """Median objective of each category."""
    return trials.where("value is not null").groupBy(category).agg(F.median("value").alias("median"), F.count(F.lit(1)).alias("n"))


def conditions(space: list[tuple[str, str | None, str | None]]) -> dict[str, list[tuple[str, str]]]:
    """For each parameter (name, parent, parent's value) what must hold for it to be active, up the tree of parents: (ancestor, value) each.

    A parent that is no parameter, or a parameter that is its own ancestor, is an error.
    """
    up, found = {name: (parent, value) for name, parent, value in space}, {}
    for name in up:
        chain, at = [], name
        while up[at][0] is not None:
            parent, value = up[at]
            if parent not in up:
                raise ValueError(f"{at}: no parameter {parent}")
            if len(chain) >= len(up):
                raise ValueError(f"{name} is its own ancestor")
            chain.append((parent, value))
            at = parent
        found[name] = chain
    return found


def conditional(params: DataFrame, space: DataFrame) -> DataFrame:
    """Long parameters (trial_id, name, value) of each trial with those that a branch leaves inactive as NULL.

    ``space``: (name, parent, parent_value), a row each of the few parameters of a sweep: a parameter is active if it has no
    parent, or its parent is active and has that value in the trial; so on any number of levels. A trial's parameters meet once, as a map.
    """
    tree = conditions([(r.name, r.parent, r.parent_value) for r in space.select("name", "parent", "parent_value").collect()])
    empty = F.array().cast("array<struct<parent:string,value:string>>")
    rule = lambda name, chain: F.struct(F.lit(name).alias("name"), (F.array(*[F.struct(F.lit(p).alias("parent"), F.lit(v).alias("value")) for p, v in chain]) if chain else empty).alias("all"))
    each = params.groupBy("trial_id", "name").agg(F.max("value").alias("value"))
    maps = each.groupBy("trial_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("m"))
    rows = maps.select("trial_id", "m", F.explode(F.array(*[rule(*x) for x in tree.items()])).alias("p"))
    active = F.forall("p.all", lambda c: F.coalesce(F.element_at("m", c["parent"]) == c["value"], F.lit(False)))
    return rows.select("trial_id", "p.name", active.alias("active"), F.when(active, F.element_at("m", F.col("p.name"))).alias("value"))


def flat(values: dict, prefix: str = "") -> dict:
    """Nested parameters under dotted names; keys that begin with _ are left out, a key with a dot is a name as it is."""
    out = {}
    for k, v in values.items():
        if k.startswith("_"):
            continue
        name = f"{prefix}.{k}" if prefix else k
        out |= flat(v, name) if isinstance(v, dict) and "." not in k else {name: v}
    return out


def leaderboard(metrics: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` trials of the lowest objective."""
    rank = F.row_number().over(Window.orderBy("objective", "trial_id"))
    return metrics.orderBy("objective", "trial_id").limit(n).select(rank.alias("rank"), "trial_id", "objective")
