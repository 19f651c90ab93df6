"""Process what was captured since the last run.

State between runs is the stream's checkpoint and the found-items store, both in a
shared folder. Every batch is a writer of the store, named by the run (the id that Spark
keeps in the checkpoint) and the batch. A batch that is repeated after a failure replaces
its own rows and sees those of all others; a run with a new checkpoint, whatever its batch
borders, sees all that earlier runs have found.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from resalelens.operators.storage import written
from resalelens.sources import found_store


def captures(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    """Stream of the captured tables in a folder."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def new_keys(stream: DataFrame, keys: list[str], ts: str, delay: str) -> DataFrame:
    """First row of each key within the watermark delay.

    Keys seen again later than that come through once more; the found-items table
    is the memory without an end.
    """
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    return timed.dropDuplicatesWithinWatermark(keys)


def read_batches(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Found items of all batches."""
    return found_store.read(spark, path, schema)


def keep_found(items: DataFrame, path: str, checkpoint: str, order: str = "pos") -> StreamingQuery:
    """Add each micro-batch's new items to the found-items store, once per link."""
    def upsert(batch: DataFrame, batch_id: int) -> None:
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        found_store.add(batch, path, f"{query}-{batch_id}", order)

    return (
        items.writeStream.foreachBatch(upsert)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def keep_records(records: DataFrame, path: str, checkpoint: str, rejects: str | None = None) -> StreamingQuery:
    """Accepted records of each micro-batch to the found-items store; the links of the
    others, with the reason, to a folder per batch of ``rejects``. The batch is stored
    once, so its pages are read once for both."""
    def upsert(batch: DataFrame, batch_id: int) -> None:
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        read = written(batch, "records")
        found_store.add(read.filter("error IS NULL"), path, f"{query}-{batch_id}", "page_id")
        if rejects:
            refused = read.filter("error IS NOT NULL").select("url", "site", "error")
            refused.write.mode("overwrite").parquet(f"{rejects}/batch={query}-{batch_id}")

    return (
        records.writeStream.foreachBatch(upsert)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def append_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream's rows to a Parquet table, exactly once."""
    return (
        stream.writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
