"""Target networks: scale between clouds, consistency, chainage, decomposition of a volume ratio.

Tables hold many networks, told apart by ``net``; a network is a handful of
targets (idx, x, y, z) seen in two clouds. All work is grouped by network, so the
pairs of one stay few while networks grow with the table.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

XYZ = ("x", "y", "z")


def paired(targets: DataFrame, ref: str = "ref", other: str = "mobile") -> DataFrame:
    """(net, idx) with both clouds' coordinates (x, y, z and x2, y2, z2): one shuffle, no join."""
    side = lambda cloud, c: F.max(F.when(F.col("cloud_id") == cloud, F.col(c)))
    both = targets.groupBy("net", "idx").agg(*[side(ref, c).alias(c) for c in XYZ], *[side(other, c).alias(c + "2") for c in XYZ])
    return both.where("x is not null and x2 is not null")


def pair_distances(targets: DataFrame, ref: str = "ref", other: str = "mobile") -> DataFrame:
    """(net, i, j, d_ref, d_oth) of all pairs i < j of a network's targets.

    A network's targets meet as one array; its pairs are the feature, a few dozen.
    """
    t = paired(targets, ref, other)
    nets = t.groupBy("net").agg(F.array_sort(F.collect_list(F.struct("idx", *XYZ, *[c + "2" for c in XYZ]))).alias("t"))
    firsts = nets.select("net", "t", F.explode("t").alias("p"))
    rows = firsts.select("net", "p", F.explode(F.filter("t", lambda q: q["idx"] > F.col("p.idx"))).alias("q"))
    d = lambda k: F.sqrt(sum(((F.col(f"p.{c}{k}") - F.col(f"q.{c}{k}")) ** 2 for c in XYZ), F.lit(0.0)))
    return rows.select("net", F.col("p.idx").alias("i"), F.col("q.idx").alias("j"), d("").alias("d_ref"), d("2").alias("d_oth"))


def scale(pairs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Through-origin scale k of d_oth against d_ref, its standard error, the residual RMS and both mean lengths.

    Two passes within a key: the residuals are summed about the fitted line, as a difference of sums would cancel.
    """
    keys = keys or ["net"]
    s = pairs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), (F.sum(F.col("d_ref") * F.col("d_oth")) / F.sum(F.col("d_ref") ** 2)).alias("k"), F.sum(F.col("d_ref") ** 2).alias("aa"),
        F.avg("d_ref").alias("len_ref"), F.avg("d_oth").alias("len_oth"), F.collect_list(F.struct("d_ref", "d_oth")).alias("pairs"),
    )
    rss = F.aggregate("pairs", F.lit(0.0), lambda acc, p: acc + F.pow(p["d_oth"] - F.col("k") * p["d_ref"], F.lit(2.0)))
    s = s.withColumn("rss", rss)
    return s.select(*keys, "n", "k", F.sqrt(F.col("rss") / F.greatest(F.col("n") - 1, F.lit(1)) / F.col("aa")).alias("sigma_k"), F.sqrt(F.col("rss") / F.col("n")).alias("resid_rms"), "len_ref", "len_oth")


def leave_one_out(targets: DataFrame, ref: str = "ref", other: str = "mobile") -> DataFrame:
    """scale() without each target in turn, (net, dropped, ...)."""
    p = pair_distances(targets, ref, other)
    rows = p.groupBy("net").agg(F.collect_list(F.struct("i", "j", "d_ref", "d_oth")).alias("p"), F.array_distinct(F.flatten(F.collect_list(F.array("i", "j")))).alias("all"))
    rows = rows.select("net", "p", F.explode("all").alias("dropped"))
    rows = rows.select("net", "dropped", F.inline(F.filter("p", lambda q: (q["i"] != F.col("dropped")) & (q["j"] != F.col("dropped")))))
    return scale(rows, ["net", "dropped"])


def consistency(targets: DataFrame, ref: str = "ref", other: str = "mobile", factor: float = 2.0) -> DataFrame:
    """For each target how much better the fit is without it, the flag (more than ``factor`` times), and its mean pair
    residual against unflagged partners under their own scale.

    A network's pairs meet once, as one array; all fits are made of it.
    """
    nets = pair_distances(targets, ref, other).groupBy("net").agg(F.array_sort(F.collect_list(F.struct("i", "j", "d_ref", "d_oth"))).alias("p"))
    total = lambda q, f: F.aggregate(q, F.lit(0.0), lambda acc, x: acc + f(x))
    slope = lambda q: total(q, lambda x: x["d_ref"] * x["d_oth"]) / F.nullif(total(q, lambda x: x["d_ref"] * x["d_ref"]), F.lit(0.0))
    rms = lambda q, k: F.sqrt(total(q, lambda x: F.pow(x["d_oth"] - k * x["d_ref"], F.lit(2.0))) / F.size(q))
    nets = nets.withColumn("k", slope(F.col("p"))).withColumn("base", rms(F.col("p"), F.col("k")))
    every = F.array_sort(F.array_distinct(F.flatten(F.transform("p", lambda x: F.array(x["i"], x["j"])))))
    without = F.transform(every, lambda t: F.struct(t.alias("idx"), F.filter("p", lambda x: (x["i"] != t) & (x["j"] != t)).alias("q")))
    fits = F.transform(F.filter(without, lambda x: F.size(x["q"]) > 0), lambda x: F.struct(x["idx"].alias("idx"), x["q"].alias("q"), slope(x["q"]).alias("k")))
    nets = nets.withColumn("loo", F.transform(fits, lambda x: F.struct(x["idx"].alias("idx"), rms(x["q"], x["k"]).alias("rms"))))
    better = lambda x: F.when(x["rms"] > 0, F.col("base") / x["rms"]).when(F.col("base") > 0, float("inf")).otherwise(1.0)
    nets = nets.withColumn("loo", F.transform("loo", lambda x: F.struct(x["idx"].alias("idx"), x["rms"].alias("rms"), better(x).alias("improve"))))
    clean = F.filter("loo", lambda x: ~(x["improve"] > factor))
    clean = F.transform(F.when(F.size(clean) > 0, clean).otherwise(F.col("loo")), lambda x: x["idx"])  # with all flagged, all count as clean
    nets = nets.withColumn("clean", clean)
    inner = F.filter("p", lambda x: F.array_contains("clean", x["i"]) & F.array_contains("clean", x["j"]))
    nets = nets.withColumn("k", slope(inner)).select("net", "p", "k", "clean", F.explode("loo").alias("t"))
    own = F.filter("p", lambda x: ((x["i"] == F.col("t.idx")) & F.array_contains("clean", x["j"])) | ((x["j"] == F.col("t.idx")) & F.array_contains("clean", x["i"])))
    nets = nets.withColumn("own", own)
    resid = total(F.col("own"), lambda x: x["d_oth"] - F.col("k") * x["d_ref"]) / F.nullif(F.size("own"), F.lit(0))
    return nets.select("net", "t.idx", F.col("t.rms").alias("loo_rms"), "t.improve", (F.col("t.improve") > factor).alias("flagged"), F.coalesce(resid, F.lit(0.0)).alias("mean_resid"))


def chainage(targets: DataFrame) -> DataFrame:
    """Distance of each target from the first and from the one before, straight lines."""
    by = Window.partitionBy("net", "cloud_id").orderBy("idx")
    d = lambda f: F.sqrt(sum(((F.col(c) - f(c)) ** 2 for c in XYZ), F.lit(0.0)))
    return targets.select("net", "cloud_id", "idx", d(lambda c: F.first(c).over(by)).alias("from_first"), d(lambda c: F.lag(c).over(by)).alias("segment"))


def uniform_scale(targets: DataFrame, ref: str = "ref", other: str = "mobile", factor: float = 2.0) -> DataFrame:
    """Scale from a line through the chainage differences of unflagged targets, against the one from both ends, with a verdict."""
    side = lambda n: F.max(F.when(F.col("cloud_id") == n, F.col("from_first")))
    both = chainage(targets).groupBy("net", "idx").agg(side(ref).alias(ref), side(other).alias(other))
    flags = consistency(targets, ref, other, factor).select("net", "idx", "flagged")
    rows = both.join(flags, ["net", "idx"]).withColumn("d_mm", (F.col(other) - F.col(ref)) * 1000)
    use = F.when(~F.col("flagged"), F.col(ref))
    few = F.count(use) < 2
    y = F.when(~F.col("flagged"), F.col("d_mm"))
    fit = rows.groupBy("net").agg(
        F.when(few, F.regr_slope("d_mm", ref)).otherwise(F.regr_slope(y, use)).alias("slope"), F.when(few, F.regr_intercept("d_mm", ref)).otherwise(F.regr_intercept(y, use)).alias("intercept_mm"),
        (F.max_by(other, "idx") / F.max_by(ref, "idx")).alias("k_end"), (F.max_by("flagged", "idx") | F.min_by("flagged", "idx")).alias("end_flagged"),
    )
    fit = fit.withColumn("k_fit", 1 + F.col("slope") / 1000)
    agree = F.abs(F.col("k_fit") - F.col("k_end")) < 5e-4
    return fit.select("net", "k_fit", "intercept_mm", "k_end", F.when(agree, "uniform").when(F.col("end_flagged"), "end target flagged").otherwise("not uniform").alias("verdict"))


def check_indices(targets: DataFrame, *wanted: int) -> None:
    """An error if a network lacks one of the targets that are to bound the domain."""
    have = targets.groupBy("net").agg(F.collect_set("idx").alias("there"))
    lack = have.where(~F.forall(F.array(*[F.lit(int(k)) for k in wanted]), lambda k: F.array_contains("there", k))).limit(10).collect()
    if lack or not targets.take(1):
        raise ValueError("no target " + " or ".join(map(str, wanted)) + " in " + (", ".join(f"network {r.net}" for r in lack) or "an empty table"))


def decomposition(targets: DataFrame, areas: DataFrame, first: int = 0, last: int = 7, ref: str = "ref", other: str = "mobile") -> DataFrame:
    """V ratio = area ratio x length ratio of two clouds, for each network that has both ends; ``areas``: (cloud_id, mean_area)."""
    ends = targets.where(F.col("idx").isin(first, last)).groupBy("net", "cloud_id").agg(*[F.max(F.when(F.col("idx") == k, F.col(c))).alias(f"{c}{n}") for c in XYZ for n, k in enumerate((first, last))])
    length = F.sqrt(sum(((F.col(f"{c}1") - F.col(f"{c}0")) ** 2 for c in XYZ), F.lit(0.0)))
    side = lambda v, c: F.max(F.when(F.col("cloud_id") == c, F.col(v)))
    lengths = ends.select("net", "cloud_id", length.alias("length")).groupBy("net").agg((side("length", other) / side("length", ref)).alias("length_ratio")).where("length_ratio is not null")
    ratio = areas.agg((side("mean_area", other) / side("mean_area", ref)).alias("area_ratio"))
    far = lambda c: F.abs(F.col(c) - F.col(c + "2")) > 1e-8 + 1e-5 * F.abs(F.col(c + "2"))
    same = paired(targets, ref, other).groupBy("net").agg((~F.bool_or(far("x") | far("y") | far("z"))).alias("same_targets"))
    return lengths.crossJoin(F.broadcast(ratio)).withColumn("volume_ratio", F.col("length_ratio") * F.col("area_ratio")).join(same, "net")  # one row of ratios
