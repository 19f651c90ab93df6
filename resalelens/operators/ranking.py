"""Order of the deals and their numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from resalelens.operators.storage import written

_SHIFT = 33   # monotonically_increasing_id keeps the partition above this bit


def best_first() -> list[Column]:
    """Rounded ratio descending; equal ratios keep scan order."""
    return [F.col("profit_ratio").desc(), F.col("pos").asc()]


def ranked(deals: DataFrame) -> DataFrame:
    return deals.orderBy(*best_first())


def top_deals(deals: DataFrame, k: int = 1) -> DataFrame:
    return ranked(deals).limit(k)


def numbered(df: DataFrame, order: list[Column], name: str = "deal_number") -> DataFrame:
    """Number all rows 1, 2, 3, ... in the given order without a one-task window.

    Rows are range-partitioned and sorted, each takes its place within its
    partition, and partitions are shifted by the rows before them. The sorted rows
    are written once, so that places and counts come from the same partitioning.
    The table of counts has one row per partition.
    """
    placed = written(
        df.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("_place", F.monotonically_increasing_id()),
        "numbered",
    ).withColumn("_part", F.shiftright("_place", _SHIFT))
    within = F.col("_place").bitwiseAND(F.lit((1 << _SHIFT) - 1))
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0).cast("long")).alias("_offset"))
    return (
        placed.join(F.broadcast(offsets), "_part")
        .select((F.col("_offset") + within + 1).alias(name), *df.columns)
    )
