"""PLY as a data source: folders written by many tasks, read back, pruned by bounds, and jobs that fail."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from adit.sources import readers


@pytest.fixture
def cloud(spark):
    spark.dataSource.register(readers.PlySource)
    return spark.range(5000).selectExpr("cast(id as double) as x", "cast(id % 7 as float) as y", "-id / 2.0D as z", "id as ring", "cast(id % 3 as float) as intensity").repartitionByRange(4, "x")


def test_round_trip_in_parts(spark, cloud, tmp_path):
    path = f"file://{tmp_path}/out"
    cloud.select("ring", "x", "intensity", "y", "z").write.format("ply").option("rowsPerFile", 400).mode("append").save(path)
    files = sorted(p.name for p in (tmp_path / "out").iterdir())
    assert len(files) >= 12 and all(f.startswith("part-") and f.endswith(".ply") for f in files)
    back = spark.read.format("ply").load(path)
    assert back.count() == 5000 and back.select("pid").distinct().count() == 5000
    got = back.agg(F.sum("x"), F.sum("y"), F.sum("z")).first()
    want = cloud.agg(F.sum("x"), F.sum(F.col("y").cast("double")), F.sum("z")).first()
    assert np.allclose(list(got), list(want))
    raw = (tmp_path / "out" / files[0]).read_bytes()
    assert b"property int ring" in raw and b"property float intensity" in raw and len(readers.ply_bounds(raw)) == 6
    cloud.limit(10).write.format("ply").mode("append").save(path)
    assert spark.read.format("ply").load(path).count() == 5010
    cloud.limit(10).write.format("ply").mode("overwrite").save(path)
    assert spark.read.format("ply").load(path).count() == 10


def test_files_are_left_out_by_their_bounds(spark, cloud, tmp_path):
    path = f"file://{tmp_path}/out"
    cloud.write.format("ply").option("rowsPerFile", 500).mode("append").save(path)
    reader = readers._PrunedPlyReader(path, 1_000_000)
    every = len(reader.partitions())
    from pyspark.sql.datasource import GreaterThan, LessThanOrEqual

    told = [GreaterThan(("x",), 4200.0), LessThanOrEqual(("y",), 3.0)]
    assert list(reader.pushFilters(told)) == told
    assert 1 <= len(reader.partitions()) <= 4 < every
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        got = spark.read.format("ply").option("prune", "true").load(path).where("x > 4200 and y <= 3")
        assert got.count() == cloud.where("x > 4200 and y <= 3").count()
        assert got.rdd.getNumPartitions() <= 4
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_a_job_that_fails_leaves_nothing(spark, cloud, tmp_path):
    path = f"file://{tmp_path}/out"
    bad = cloud.withColumn("x", F.when(F.col("x") == 4999, F.raise_error(F.lit("no such place"))).otherwise(F.col("x")))
    with pytest.raises(Exception, match="no such place"):
        bad.write.format("ply").option("rowsPerFile", 100).mode("append").save(path)
    assert not list((tmp_path / "out").rglob("*")) if (tmp_path / "out").exists() else True
    cloud.limit(3).write.format("ply").mode("append").save(path)
    with pytest.raises(Exception, match="no such place"):
        bad.write.format("ply").mode("overwrite").save(path)
    assert spark.read.format("ply").load(path).count() == 3


def test_headers_of_any_length(spark, tmp_path):
    comments = tuple(f"line {k} {'x' * 90}" for k in range(1500))
    (tmp_path / "long.ply").write_bytes(readers.ply_bytes(np.arange(12.0).reshape(4, 3), ["x", "y", "z"], comments))
    assert readers.ply(spark, f"file://{tmp_path}/long.ply").agg(F.sum("x")).first()[0] == 18
    (tmp_path / "cut.ply").write_bytes(b"ply\nformat ascii 1.0\n")
    with pytest.raises(Exception, match="no end of the header"):
        readers.ply(spark, f"file://{tmp_path}/cut.ply").count()
