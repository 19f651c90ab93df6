"""Small helpers for the operators: input tables, Arrow batch sizes, stored tables."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from resalelens.operators.storage import fresh_path

BATCH_ROWS = 1_000
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> None:
    """Bound Arrow batches by rows and bytes: texts differ a lot in length."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


_forget: dict[str, list[Callable[[], None]]] = {}
_at_work: list[str] = []


def keeps(operator: str, forget: Callable[[], None]) -> None:
    """Register how to drop what an operator keeps in a Python worker between batches."""
    _forget.setdefault(operator, []).append(forget)


def at_work(operator: str) -> None:
    """Drop what other operators keep in this worker: workers are used again for later
    stages, and would otherwise hold the memos of all operators that ever ran in them."""
    if _at_work and _at_work[-1] == operator:
        return
    for other, actions in _forget.items():
        if other != operator:
            for forget in actions:
                forget()
    _at_work[:] = [operator]
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


class Scratch:
    """Stored tables of one operator, each dropped once later ones no longer need it.

    Spark keeps the shuffle files of finished steps until the driver collects garbage;
    dropping a table asks for that, so a long run of steps needs the disk of a few."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[str, str] = {}

    def store(self, df: DataFrame, name: str) -> DataFrame:
        path = self.paths[name] = fresh_path(self.spark, name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        gc.collect()
        jvm.System.gc()
