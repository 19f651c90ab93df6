"""Configured scan: search entries to kept items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from resalelens import settings as S
from resalelens.functions import dates, money, scoring
from resalelens.operators import comps, filters, found as found_ops, search
from resalelens.operators.first import capped, near_first
from resalelens.operators.storage import is_small, written

FEW_TITLES = 10_000   # up to here the sales of a title are cut to near its first before they are ranked


def closing_nearby(
    listings: DataFrame, centroids: DataFrame, as_of: Column, config: S.ScanConfig = S.ScanConfig(),
    hours: int = S.DEFAULT_HOURS, max_rows: int | None = None,
) -> DataFrame:
    """Listings near home that close soon, soonest first: the first page of a site's search.

    ``listings`` has ``close_ts, zip, pos``. The time filter reaches the scan.
    """
    soon = filters.closing_within(listings, as_of, hours)
    near = filters.within_radius(soon, centroids, config.your_zip, config.radius_miles)
    return near if max_rows is None else capped(near, max_rows, ["close_ts", "pos"])


def within_reach(
    listings: DataFrame, hours: int | None = None, centroids: DataFrame | None = None, home_zip: str | None = None,
    miles: float | None = None,
) -> DataFrame:
    """Listings of index pages that close within ``hours`` and lie within ``miles`` of home, as
    far as their cards tell: without a time or a known code they stay."""
    if hours is not None:
        left = dates.time_left_minutes(F.col("time_left"))
        listings = listings.filter(left.isNull() | (left <= hours * 60))
    if miles is not None:
        listings = filters.not_too_far(listings, centroids, home_zip, miles, filters.code_on_card(F.col("card_text")))
    return listings


def links_to_fetch(listings: DataFrame, searches: DataFrame, found: DataFrame, cap: int) -> DataFrame:
    """Links of all search entries, capped per entry, that no earlier scan has kept."""
    matches = search.first_matches(listings, searches, cap)
    return found_ops.not_found(search.union_of_searches(matches), found)


def worth_checking(
    records: DataFrame, as_of: Column, max_bid: float = 1500.0, hours: int = S.CLOSING_HOURS,
) -> DataFrame:
    """Accepted records with an affordable bid, a carriable kind and time to bid; adds ``ends``."""
    dated = records.withColumn("ends", dates.end_date(F.col("end_date")))
    kind = F.concat_ws(" ", "title", "description")
    return dated.filter(
        F.col("error").isNull()
        & filters.affordable(F.col("current_bid"), max_bid)
        & ~scoring.excluded_kind(kind)
        & filters.open_long_enough(F.col("ends"), as_of, hours)
    )


def kept_items(records: DataFrame, values: DataFrame, min_profit: float = S.MIN_PROFIT) -> DataFrame:
    """Items whose market value beats the bid by the wanted profit.

    ``values`` is the output of ``market_value``, keyed by title in ``item``.
    """
    worth = F.col("median_price")
    profit = worth - F.col("current_bid")
    return (
        records.join(values.select(F.col("item").alias("title"), "median_price"), "title")
        .filter((worth > 0) & filters.profitable(None, profit, None, min_profit))
        .select(
            "title", "lot", "site", "url",
            F.col("current_bid").alias("bid"),
            worth.alias("market_value"),
            money.cents(profit).alias("profit"),
            F.coalesce("location", F.lit("")).alias("pickup"),
            F.col("ends").cast("date").alias("ends"),
            F.coalesce("photos", F.array().cast("array<string>")).alias("photos"),
        )
    )


def scan(
    records: DataFrame, prices: DataFrame, as_of: Column,
    config: S.ScanConfig = S.ScanConfig(), centroids: DataFrame | None = None, hours: int = S.CLOSING_HOURS,
) -> DataFrame:
    """Records of fetched pages to kept items.

    ``prices`` has ``item, pos, price``: sold prices per title, in page order. With
    a table of centroids the radius of the config applies. The checked records are
    written once, so that pages are parsed once and prices are read for their titles
    only.
    """
    checked = worth_checking(records, as_of, config.max_bid, hours)
    if centroids is not None:
        checked = filters.not_too_far(checked, centroids, config.your_zip, config.radius_miles)
    checked = written(checked, "checked")
    titles = written(checked.select(F.col("title").alias("item")).distinct(), "titles")
    needed = prices.filter(F.col("price").isNotNull()).join(titles, "item", "left_semi")
    if is_small(titles, FEW_TITLES):
        needed = near_first(needed, "item", "pos", S.MARKET_SAMPLE)
    return kept_items(checked, comps.market_value(titles, needed), config.min_profit)


def items_out(items: DataFrame) -> DataFrame:
    """Items in the output contract, dates as ISO text."""
    return items.withColumn("ends", F.coalesce(F.date_format("ends", "yyyy-MM-dd"), F.lit("")))
