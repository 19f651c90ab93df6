"""Found-items table and result sinks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from resalelens.sources import found_store

ITEM_SCHEMA = (
    "title STRING, lot STRING, site STRING, url STRING, bid DOUBLE, market_value DOUBLE, "
    "profit DOUBLE, pickup STRING, ends DATE, photos ARRAY<STRING>"
)


def read_found(spark: SparkSession, path: str, schema: str = ITEM_SCHEMA, but: str | None = None) -> DataFrame:
    """Items found so far, of all runs but one if asked for; none if nothing was written yet."""
    return found_store.read(spark, path, schema, but=None if but is None else f"w{but}")


def append_found(batch: DataFrame, path: str, schema: str = ITEM_SCHEMA, order: str = "pos", run: str | None = None) -> None:
    """Add a batch's new items. A second call with the same batch adds nothing, and one of
    the same run replaces what the run has added."""
    names = T.StructType.fromDDL(schema).names
    lacking = [F.lit(None).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(schema).fields if f.name not in batch.columns]
    found_store.add(batch.select("*", *lacking), path, run, order, names)


def write_deals(deals: DataFrame, path: str) -> None:
    """Deals as JSON lines in the order of their numbers, if they have any; files sort by
    name in that order."""
    ordered = deals.orderBy("deal_number") if "deal_number" in deals.columns else deals
    ordered.write.mode("overwrite").json(path)


def items_lines(items: DataFrame) -> DataFrame:
    """One JSON object per item, absent fields included."""
    return items.select(F.to_json(F.struct(*items.columns), {"ignoreNullFields": "false"}).alias("json"))


def write_items(items: DataFrame, path: str) -> None:
    """Items as JSON lines from all tasks, any number of them; a file even without items."""
    items_lines(items).write.mode("overwrite").text(path)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The objects of a task as the lines of one document, written as they come."""
    lead = '{"items":['
    for batch in batches:
        lines = []
        for item in batch.column(0).to_pylist():
            if item is not None:
                lines.append(lead + item)
                lead = ","
        yield pa.record_batch([pa.array(lines, pa.string())], names=["value"])
    yield pa.record_batch([pa.array([("" if lead == "," else lead) + "]}"], pa.string())], names=["value"])


def write_items_document(items: DataFrame, path: str, parts: int = 1) -> None:
    """Items as one JSON object with ``items`` per part, also where there are none. A part
    is written by one task, item by item, so many items want several parts."""
    spark = items.sparkSession
    marker = spark.range(parts).select(F.lit(None).cast("string").alias("json"))
    dealt = items_lines(items).unionByName(marker).repartition(parts)
    dealt.mapInArrow(_documents, "value STRING").write.mode("overwrite").text(path)
