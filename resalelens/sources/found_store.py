"""Found items, kept once per link, in buckets of the link's hash.

A writer (one run of a scan, or one batch of a stream) adds rows in folders of its own,
``bucket=<n>/writer=<id>``. It reads only the buckets that its links fall into, and of those
only the links; nothing that was written before is written again. A writer that is repeated
after a failure does not see its own rows and replaces them, so it gives the same table.

Small folders are merged by generation: once a bucket holds ``FAN_IN`` folders of one
generation they become one of the next, so a row is rewritten a logarithmic number of times
however many writers there are. A merged folder counts from the moment its line is in the
list of merges, and from that moment the folders it was made of do not; they are deleted
afterwards. A crash at any point leaves a table that reads the same.

One writer at a time adds to a store.
"""

from __future__ import annotations

import re
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from resalelens.operators.found import new_items
from resalelens.operators.first import first_per_key
from resalelens.operators.storage import written

BUCKETS = 64
FAN_IN = 16
_MERGES = "_merges"
_MERGE = "bucket INT, writer STRING, parts ARRAY<STRING>"


def bucket_of(url, buckets: int = BUCKETS):
    return F.pmod(F.xxhash64(url), F.lit(buckets)).cast("int")


def _merges(spark: SparkSession, path: str) -> list:
    """Merges so far, a line per merged folder."""
    try:
        return spark.read.schema(_MERGE).json(f"{path}/{_MERGES}/*").collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []


def _folders(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema("url STRING, bucket INT, writer STRING").parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def read(
    spark: SparkSession, path: str, schema: T.StructType | str, buckets: list[int] | None = None, but: str | None = None,
) -> DataFrame:
    """Items of a store; of some buckets, and of all writers but one, if asked for. Both
    are filters on folders."""
    columns = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if _folders(spark, path) is None:
        return spark.createDataFrame([], columns)
    full = T.StructType(columns.fields + T.StructType.fromDDL("bucket INT, writer STRING").fields)
    rows = spark.read.schema(full).parquet(path)
    merges = _merges(spark, path)
    replaced = [f"{m.bucket}/{w}" for m in merges for w in m.parts]
    place = F.concat_ws("/", "bucket", "writer")
    known = ~F.col("writer").startswith("g") | place.isin([f"{m.bucket}/{m.writer}" for m in merges])
    rows = rows.filter(known & ~place.isin(replaced))
    if buckets is not None:
        rows = rows.filter(F.col("bucket").isin(buckets))
    if but is not None:
        rows = rows.filter(F.col("writer") != but)
    return rows.select(*columns.names)


def add(batch: DataFrame, path: str, writer: str | None = None, order: str = "pos", columns: list[str] | None = None) -> None:
    """Add a batch's items with a link that is not there yet, the first of each link by
    ``order``; ``columns`` are kept, all by default."""
    spark = batch.sparkSession
    writer = f"w{writer or uuid.uuid4().hex}"
    columns = columns or batch.columns
    schema = batch.select(*columns).schema
    linked = batch.filter(F.coalesce(F.col("url"), F.lit("")) != "")
    firsts = written(first_per_key(linked, "url", [order]).withColumn("_bucket", bucket_of(F.col("url"))), "batch")
    touched = sorted(r[0] for r in firsts.select("_bucket").distinct().collect())   # BUCKETS at most
    known = read(spark, path, schema, touched, but=writer)
    fresh = new_items(firsts, known, order).select(*columns, F.col("_bucket").alias("bucket"), F.lit(writer).alias("writer"))
    (fresh.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("bucket", "writer").parquet(path))
    merge(spark, path, schema, touched)


def _generation(writer: str) -> int:
    found = re.match(r"g(\d+)-", writer)
    return int(found[1]) if found else 0


def merge(spark: SparkSession, path: str, schema: T.StructType, buckets: list[int]) -> None:
    """Merge the folders of each generation of which a bucket holds ``FAN_IN``."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    store = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    merges = _merges(spark, path)
    replaced = {(m.bucket, w) for m in merges for w in m.parts}
    listed = {(m.bucket, m.writer) for m in merges}
    for bucket in buckets:
        at = jvm.org.apache.hadoop.fs.Path(root, f"bucket={bucket}")
        if not store.exists(at):
            continue
        names = [s.getPath().getName() for s in store.listStatus(at) if s.isDirectory()]
        writers = [n.removeprefix("writer=") for n in names if n.startswith("writer=")]
        live = [w for w in writers if (bucket, w) not in replaced and (w[0] != "g" or (bucket, w) in listed)]
        for level in sorted({_generation(w) for w in live}):
            parts = [w for w in live if _generation(w) == level]
            if len(parts) < FAN_IN:
                continue
            name = f"g{level + 1}-{uuid.uuid4().hex}"
            rows = [spark.read.schema(schema).parquet(f"{path}/bucket={bucket}/writer={w}") for w in parts]
            whole = rows[0]
            for more in rows[1:]:
                whole = whole.unionByName(more)
            whole.coalesce(1).write.parquet(f"{path}/bucket={bucket}/writer={name}")
            line = spark.createDataFrame([(bucket, name, parts)], _MERGE)
            line.coalesce(1).write.json(f"{path}/{_MERGES}/{name}")
            for w in parts:
                store.delete(jvm.org.apache.hadoop.fs.Path(at, f"writer={w}"), True)
