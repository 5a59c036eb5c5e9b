"""Synthetic ground truth: a cylinder cloud, an out-and-back trajectory, two targets."""

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def cylinder(spark: SparkSession, radius: float = 2.0, length: float = 100.0, n_theta: int = 360, n_z: int = 2500, hole: tuple[float, float] | None = None) -> DataFrame:
    """Points (cloud_id, pid, s, r, theta, x, y, z) on a cylinder about z; angles lie half a step off the degrees. ``hole``: theta range left out."""
    j, k = F.col("pid") % n_theta, F.floor(F.col("pid") / n_theta)
    theta = (j + 0.5) * (360.0 / n_theta) - 180.0
    rows = spark.range(n_theta * n_z).withColumnRenamed("id", "pid").select(F.lit("phantom").alias("cloud_id"), "pid", (k * (length / n_z)).alias("s"), F.lit(radius).alias("r"), theta.alias("theta"))
    rows = rows.where(~F.col("theta").between(*hole)) if hole else rows
    t = F.radians("theta")
    return rows.select("*", (F.col("r") * F.cos(t)).alias("x"), (F.col("r") * F.sin(t)).alias("y"), F.col("s").alias("z"))


def out_and_back(spark: SparkSession, length: float = 100.0, n: int = 200, sigma: float = 0.05, seed: int = 0) -> DataFrame:
    """(run_id, seq, x, y, z): along z and back with normal wander across it."""
    import numpy as np

    wander = np.random.default_rng(seed).normal(0, sigma, (n, 2))
    z = [length * (1 - abs(2 * k / (n - 1) - 1)) for k in range(n)]
    return spark.createDataFrame([("phantom", k + 1, float(wander[k, 0]), float(wander[k, 1]), z[k]) for k in range(n)], "run_id string, seq long, x double, y double, z double")


def end_targets(spark: SparkSession, length: float = 100.0) -> DataFrame:
    return spark.createDataFrame([("phantom", k, 0.0, 0.0, z) for k, z in enumerate((0.0, length))], "cloud_id string, idx int, x double, y double, z double")


def true_volume(radius: float = 2.0, length: float = 100.0) -> float:
    return math.pi * radius**2 * length
