"""Selection, daily cap and outcome of posting items."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from resalelens import settings as S
from resalelens.operators.first import first_rows


def selected(items: DataFrame, choice: str) -> DataFrame:
    """Items named by ``all``, ``none`` or a list of numbers such as ``1,3,5``."""
    choice = choice.strip().lower()
    if choice == "all":
        return items
    numbers = [] if choice in ("", "none") else [int(p) for p in choice.split(",") if p.strip()]
    return items.filter(F.col("n").isin(numbers)) if numbers else items.filter(F.lit(False))


def selected_by(items: DataFrame, selection: DataFrame) -> DataFrame:
    """Items whose number is in a selection table."""
    return items.join(selection.select("n"), "n", "left_semi")


def within_daily_cap(attempts: DataFrame, cap: int) -> DataFrame:
    """Attempts made before a day's cap of successes was reached.

    The last attempt of a day is its ``cap``-th success. That success is found from
    at most ``cap`` rows per day and task, so a busy day needs no running sum. A cap of
    nothing allows no attempt.
    """
    if cap < 1:
        return attempts.filter(F.lit(False))
    last = (
        first_rows(attempts.filter("ok").select("posted_on", "n"), ["posted_on"], ["n"], cap)
        .groupBy("posted_on")
        .agg(F.max("n").alias("_last"), F.count(F.lit(1)).alias("_hits"))
        .filter(F.col("_hits") == cap)
        .select("posted_on", "_last")
    )
    return (
        attempts.join(last, "posted_on", "left")
        .filter(F.col("_last").isNull() | (F.col("n") <= F.col("_last")))
        .drop("_last")
    )


def outcome_report(attempts: DataFrame) -> DataFrame:
    """Posted X of Y and failed Z, per day."""
    posted = F.count_if("ok")
    total = F.count(F.lit(1))
    return attempts.groupBy("posted_on").agg(
        posted.alias("posted"), total.alias("attempted"), (total - posted).alias("failed"),
    ).withColumn("summary", F.format_string(
        "Posted %d / %d items successfully. Failed: %d", "posted", "attempted", "failed"))


def failures(attempts: DataFrame) -> DataFrame:
    """Failed attempts with their reasons."""
    return attempts.filter(~F.col("ok")).select("posted_on", "n", "title", "reason")


def export_rows(items: DataFrame, city: str, max_title: int | None = None) -> DataFrame:
    """Rows for the posting form; titles are whole unless a limit is given."""
    return items.select(
        "n",
        (F.col("title") if max_title is None else F.substring("title", 1, max_title)).alias("title"),
        F.coalesce("list_price", "market_value").cast("long").cast("string").alias("price"),
        "category",
        F.coalesce(F.when(F.length("condition") > 0, F.col("condition")), F.lit(S.DEFAULT_CONDITION)).alias("condition"),
        "description",
        F.lit(city).alias("location"),
        "photos",
    )
