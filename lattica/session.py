"""Sessions, and shipping this package to executors that do not share the driver's folders."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Make the package importable in every Python worker of this session; once per context."""
    sc = spark.sparkContext
    if getattr(sc, "_lattica_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="lattica-ship-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    root = Path(__file__).resolve().parent
    where = Path(folder, "src", root.name)
    shutil.copytree(root, where, ignore=shutil.ignore_patterns("__pycache__"))
    sc.addPyFile(shutil.make_archive(f"{folder}/{root.name}", "zip", f"{folder}/src"))
    sc._lattica_shipped = True


def get_spark(app: str = "lattica", master: str = "local[8]", partitions: int = 8, **conf: str) -> SparkSession:
    """A session as the bench and the tools use it."""
    builder = SparkSession.builder.master(master).appName(app)
    defaults = {"spark.sql.shuffle.partitions": str(partitions), "spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"}
    for k, v in (defaults | conf).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
