"""Session defaults that results depend on."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors as an archive, once an application, where Python code runs in them."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        _shipped.add(context.applicationId)
        archive = Path(tempfile.mkdtemp(prefix="dotloom-")) / "dotloom-library.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for file in sorted(PACKAGE.rglob("*.py")):
                z.write(file, file.relative_to(PACKAGE.parent))
        context.addPyFile(str(archive))


def local_session(app: str = "dotloom", cpus: str | int = 8, shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and the bench.  A cluster brings its own session."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.files.maxPartitionBytes", "2m")  # as many splits as cores from small tables
        .config("spark.sql.files.openCostInBytes", "64k")
        .config("spark.driver.memory", os.environ.get("DOTLOOM_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    if spark.conf.get("spark.checkpoint.dir", None) is None and spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return spark
