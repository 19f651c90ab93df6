"""Items found by earlier scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from resalelens.operators.first import first_per_key


def not_found(listings: DataFrame, found: DataFrame) -> DataFrame:
    """Listings whose link no earlier scan has kept."""
    return listings.join(found.select("url"), "url", "left_anti")


def new_items(batch: DataFrame, found: DataFrame, order: str = "pos") -> DataFrame:
    """Rows of a batch to add: with a link, first per link, not found before."""
    linked = batch.filter(F.coalesce(F.col("url"), F.lit("")) != "")
    return not_found(first_per_key(linked, "url", [order]), found)


def merged(found: DataFrame, batch: DataFrame, order: str = "pos") -> DataFrame:
    """Found items and the new ones; a found item is never replaced."""
    added = new_items(batch, found, order)
    return found.unionByName(added.select(*found.columns))


def merge_counts(found: DataFrame, batch: DataFrame, order: str = "pos") -> DataFrame:
    """How many items a batch adds and how many there are then, as one row."""
    old = found.select(F.lit(0).alias("_new"))
    new = new_items(batch, found, order).select(F.lit(1).alias("_new"))
    return old.unionByName(new).agg(
        F.coalesce(F.sum("_new"), F.lit(0)).cast("long").alias("added"),
        F.count(F.lit(1)).alias("total"),
    )
