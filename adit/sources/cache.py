"""Tables kept by the settings that made them, so that nothing is read that other settings made."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save(df: DataFrame, root: str, name: str, signature: str) -> None:
    """Keep ``df`` as ``name`` under these settings; what other settings made is replaced as a whole."""
    df.withColumn("made_by", F.lit(signature)).write.mode("overwrite").parquet(f"{root.rstrip('/')}/{name}")


def load(spark: SparkSession, root: str, name: str, signature: str) -> DataFrame | None:
    """The table kept as ``name``, or None if there is none, it has no signature, or other settings made it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{name}")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    df = spark.read.parquet(path.toString())
    if "made_by" not in df.columns:
        return None
    row = df.select("made_by").limit(1).collect()
    return df.drop("made_by") if not row or row[0].made_by == signature else None


def kept_or_made(spark: SparkSession, root: str, name: str, signature: str, make) -> DataFrame:
    """What is kept, or else what ``make()`` gives, kept from now on."""
    found = load(spark, root, name, signature)
    if found is None:
        save(make(), root, name, signature)
        found = load(spark, root, name, signature)
    return found
