"""Index scan to ranked deals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from resalelens import settings as S
from resalelens.functions import money, scoring, text
from resalelens.operators import comps, filters, match, ranking
from resalelens.operators.storage import written
from resalelens.sources import cards
from resalelens.sources.records import detail_fields


def with_queries(listings: DataFrame) -> DataFrame:
    """Add the terms looked up in each source."""
    title = F.col("title")
    return listings.withColumn("query", text.search_query(title, S.PRIMARY_TERMS)).withColumn(
        "query2", text.search_query(title, S.SECONDARY_TERMS))


def stats_by_title(listings: DataFrame, sold: DataFrame) -> DataFrame:
    """Comp stats of every query, from the sold titles that hold all of its terms.

    ``listings`` has ``query, query2``; ``sold`` has ``title, source, price``. The
    stats are written, one row per query and source, since deals read them once per
    source.
    """
    wanted = (
        listings.select(F.explode(F.array("query", "query2")).alias("query")).distinct()
        .withColumn("terms", text.term_set(F.col("query")))
    )
    named = sold.select(text.term_set(F.col("title")).alias("terms"), "source", "price")
    prices = written(match.matched_prices(wanted, named), "matched-prices")
    return written(comps.comp_stats(prices), "stats")


def _optional(df: DataFrame, name: str, default: Column) -> Column:
    return F.col(name) if name in df.columns else default


def scored(listings: DataFrame, stats: DataFrame) -> DataFrame:
    """Every listing with comps, estimate, ratio and profit; nothing is dropped.

    ``listings`` has ``query`` and ``query2``; ``stats`` comes from ``comp_stats``.
    """
    described = listings.withColumn(
        "description", _optional(listings, "description", F.lit(None).cast("string")))
    df = comps.with_comps(described, stats)
    at_risk = scoring.condition_risk(F.col("card_text"), F.col("description"))
    return (
        df.withColumn("at_risk", at_risk)
        .withColumn("resale", scoring.resale_estimate(F.col("comps.median"), F.col("comps.avg"), F.col("at_risk")))
        .withColumn("ratio", scoring.profit_ratio(F.col("resale"), F.col("price")))
        .withColumn("profit", F.col("resale") - F.col("price"))
    )


def verdict(min_ratio: float = S.MIN_RATIO, min_profit: float = S.MIN_PROFIT) -> Column:
    """Why a scored listing was left out, or ``deal``. Thresholds test unrounded values."""
    good = filters.profitable(F.col("ratio"), F.col("profit"), min_ratio, min_profit)
    return (
        F.when(~F.coalesce(filters.has_price(F.col("price")), F.lit(False)), "no_price")
        .when(F.coalesce(F.col("comps.count"), F.lit(0)) == 0, "no_comps")
        .when(~good, "below_threshold")
        .otherwise("deal")
    )


def to_deal(df: DataFrame, listing_columns: list[str]) -> DataFrame:
    """Deal rows, rounded to cents. Rounding comes last."""
    c = F.col
    return df.select(
        *listing_columns,
        c("comps.avg").alias("comps_avg"),
        c("comps.median").alias("comps_median"),
        c("comps.low").alias("comps_low"),
        c("comps.high").alias("comps_high"),
        c("comps.count").alias("comps_count"),
        c("comps.query").alias("comps_query"),
        c("comps.source").alias("comps_source"),
        money.cents(c("resale")).alias("resale_estimate"),
        money.cents(c("ratio")).alias("profit_ratio"),
        money.cents(c("profit")).alias("est_profit"),
        scoring.confidence(c("comps.count")).alias("confidence"),
        scoring.risk_flags(c("at_risk")).alias("risk_flags"),
    )


VERDICTS = ("no_comps", "below_threshold", "deal")


class Funnel:
    """Counts of the steps of one search for deals, observed while its own passes run: no
    table is read for them. Complete once the deals are written."""

    def __init__(self):
        self._found, self._unique, self._judged = Observation(), Observation(), Observation()

    def found(self, scan: DataFrame) -> DataFrame:
        return scan.observe(self._found, F.count(F.lit(1)).alias("found"))

    def unique(self, listings: DataFrame) -> DataFrame:
        priced = F.coalesce(filters.has_price(F.col("price")), F.lit(False))
        return listings.observe(self._unique, F.count(F.lit(1)).alias("unique"), F.count_if(~priced).alias("no_price"))

    def judged(self, priced: DataFrame) -> DataFrame:
        return priced.observe(self._judged, *[F.count_if(F.col("_verdict") == v).alias(v) for v in VERDICTS])

    def rows(self, spark: SparkSession) -> DataFrame:
        """``reason, n``: found, unique, and each reason that occurs."""
        counts = self._found.get | self._unique.get | self._judged.get
        rows = [(k, n) for k, n in counts.items() if n or k in ("found", "unique")]
        return spark.createDataFrame(rows, "reason STRING, n LONG")


def find_deals(
    listings: DataFrame, stats: DataFrame,
    min_ratio: float = S.MIN_RATIO, min_profit: float = S.MIN_PROFIT, funnel: Funnel | None = None,
) -> DataFrame:
    """Listings worth buying, unordered. See ``ranking`` for their order and numbers."""
    priced = listings.filter(filters.has_price(F.col("price")))
    judged = scored(priced, stats).withColumn("_verdict", verdict(min_ratio, min_profit))
    kept = (judged if funnel is None else funnel.judged(judged)).filter(F.col("_verdict") == "deal")
    return to_deal(kept, [n for n in listings.columns if n not in ("query", "query2")])


def ranked_deals(listings: DataFrame, stats: DataFrame, funnel: Funnel | None = None, **thresholds: float) -> DataFrame:
    """Deals with their numbers, best first.

    Deals are written before they are numbered: range partitioning reads its input
    twice, and the joins behind the deals should run once.
    """
    found = written(find_deals(listings, stats, funnel=funnel, **thresholds), "deals")
    return ranking.numbered(found, ranking.best_first())


def deals_from_pages(
    index_pages: DataFrame, sold: DataFrame, detail_pages: DataFrame | None = None,
    max_rows: int | None = None, reach: Callable[[DataFrame], DataFrame] | None = None,
    funnel: Funnel | None = None, **thresholds: float,
) -> DataFrame:
    """Captured pages and sold titles to numbered deals. ``reach`` filters the listings
    before anything else, as a site's own search would.

    Index pages give the listings, detail pages better titles and descriptions, and
    the sold titles that hold a listing's terms its comps. Listings are written before
    and after their details, so that every page is parsed once, and detail pages only
    of listings with a price.
    """
    carded = cards.listings_of(cards.scan_cards(index_pages), max_lines=S.CARD_LINES)
    carded = carded if reach is None else reach(carded)
    found = cards.distinct_listings(carded if funnel is None else funnel.found(carded), max_rows)
    found = found if funnel is None else funnel.unique(found)
    listings = written(found.filter(filters.has_price(F.col("price"))), "listings")
    if detail_pages is not None:
        wanted = detail_pages.join(listings.select("url"), "url", "left_semi")
        listings = written(cards.with_details(listings, detail_fields(wanted)), "detailed")
    listings = with_queries(listings)
    return ranked_deals(listings, stats_by_title(listings, sold), funnel, **thresholds)


def funnel(
    found: DataFrame, unique: DataFrame, stats: DataFrame,
    min_ratio: float = S.MIN_RATIO, min_profit: float = S.MIN_PROFIT,
) -> DataFrame:
    """Listings per step: found, left after dedup, dropped by reason, deals.

    ``found`` is the scan, ``unique`` what dedup left of it, with queries.
    """
    total = found.agg(F.count(F.lit(1)).alias("n")).select(F.lit("found").alias("reason"), "n")
    reasons = scored(unique, stats).groupBy(verdict(min_ratio, min_profit).alias("reason")).agg(
        F.count(F.lit(1)).alias("n"))
    kept = unique.agg(F.count(F.lit(1)).alias("n")).select(F.lit("unique").alias("reason"), "n")
    return total.unionByName(kept).unionByName(reasons)
