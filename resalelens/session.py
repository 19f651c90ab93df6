"""Session with the settings the jobs are written for."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import SparkSession

PACKAGE = os.path.dirname(os.path.abspath(__file__))


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, wherever the job was started from."""
    folder = tempfile.mkdtemp(prefix="package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    name = os.path.basename(PACKAGE)
    archive = shutil.make_archive(os.path.join(folder, name), "zip", os.path.dirname(PACKAGE), name)
    spark.sparkContext.addPyFile(archive)


_shipped: set[str] = set()


def ensure_package(spark: SparkSession) -> None:
    """Ship the package, once per application, unless workers find it by their search path."""
    folder, app = os.path.dirname(PACKAGE), spark.sparkContext.applicationId
    known = [os.path.abspath(p) for p in [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()] if p]
    if app not in _shipped and folder not in known:
        ship_package(spark)
    _shipped.add(app)


def session(app: str = "resale-deals", **conf: str) -> SparkSession:
    """Adaptive execution does the run-time sizing: it merges small shuffle partitions,
    splits skewed ones and broadcasts a join side once its measured size is small.
    Arrow batches are bounded by bytes because captured pages differ in size."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))
    )
    for name, value in conf.items():
        builder = builder.config(name.replace("__", "."), value)
    spark = builder.getOrCreate()
    if spark.sparkContext.applicationId not in _shipped:
        ship_package(spark)
        _shipped.add(spark.sparkContext.applicationId)
    return spark
