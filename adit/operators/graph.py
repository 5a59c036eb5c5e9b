"""Checkpoints in the shared folder, and connected components of an undirected graph, by contraction."""

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def kept(df: DataFrame) -> DataFrame:
    """A checkpoint in the session's shared folder; a temporary one only where a local session has none."""
    sc = df.sparkSession.sparkContext
    if sc.getConf().get("spark.checkpoint.dir", None) is None and sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='adit-')}")
    return df.checkpoint()


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(v, root) of all vertices (v) under the edges (a, b).

    A round maps each vertex to the neighbour of the smallest hash, or itself,
    follows the map once more and contracts the edges, so that rounds grow with
    the logarithm of a component.
    """
    rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))
    labels = kept(vertices.select("v", F.col("v").alias("root")).distinct())
    edges = kept(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        near = kept(both.groupBy(F.col("a").alias("v")).agg(F.min(rank("b")).alias("m")).select("v", F.least(rank("v"), F.col("m"))["v"].alias("r")))
        to = kept(near.join(near.select(F.col("v").alias("r"), F.col("r").alias("r2")), "r").select("v", F.col("r2").alias("next")))
        labels = kept(labels.join(to.withColumnRenamed("v", "root"), "root", "left").select("v", F.coalesce("next", "root").alias("root")))
        ra, rb = to.select(F.col("v").alias("a"), F.col("next").alias("ra")), to.select(F.col("v").alias("b"), F.col("next").alias("rb"))
        edges = kept(edges.join(ra, "a").join(rb, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    return labels
