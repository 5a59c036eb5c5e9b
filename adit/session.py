"""Sessions for tests, benches and scripts, and shipping of the package to executors."""

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent


def local_session(cores: str = "8", **conf: str) -> SparkSession:
    """A session on this machine for tests and benches."""
    settings = {
        "spark.sql.shuffle.partitions": "8", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false",
        "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false",
    } | conf
    spark = SparkSession.builder.master(f"local[{cores}]").appName("adit").config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return ship(spark)


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the executors' Python, once a session, unless it is on their path."""
    sc = spark.sparkContext
    if getattr(sc, "_adit_shipped", False) or str(ROOT.parent) in os.environ.get("PYTHONPATH", "").split(":"):
        return spark
    path = Path(tempfile.mkdtemp(prefix="adit-")) / "adit.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(ROOT.rglob("*.py")):
            z.write(p, p.relative_to(ROOT.parent))
    sc.addPyFile(str(path))
    sc._adit_shipped = True
    return spark
