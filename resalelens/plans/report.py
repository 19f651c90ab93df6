"""Text columns of the deal report, the summary table and the item blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from resalelens import settings as S
from resalelens.functions import money, scoring


def deal_report(deals: DataFrame) -> DataFrame:
    """One row of labels per numbered deal."""
    c = F.col
    flags = F.array_join("risk_flags", ", ")
    places = [c(n) for n in ("pickup_location", "location", "state") if n in deals.columns]
    place = F.coalesce(*places, F.lit(""))
    return deals.select(
        "deal_number",
        c("title"),
        c("url"),
        money.price_label(c("price_str"), c("price")).alias("current_price"),
        F.coalesce(c("time_left"), F.lit("")).alias("time_remaining"),
        F.coalesce(c("bids"), F.lit(0)).alias("bids"),
        place.alias("location"),
        F.coalesce(c("comps_query"), F.lit("")).alias("comps_query"),
        scoring.source_label(c("comps_source")).alias("comps_label"),
        money.whole_dollars(c("comps_avg")).alias("avg"),
        money.whole_dollars(c("comps_median")).alias("median"),
        F.concat(money.whole_dollars(c("comps_low")), F.lit(" – "), money.whole_dollars(c("comps_high"))).alias("range"),
        F.format_string("%d listings", c("comps_count")).alias("comps"),
        money.whole_dollars(c("resale_estimate")).alias("resale"),
        F.concat(F.format_number(c("profit_ratio"), 1), F.lit("x")).alias("ratio"),
        money.whole_dollars(c("est_profit")).alias("profit"),
        c("confidence"),
        F.when(flags == "", "None").otherwise(flags).alias("risk"),
        scoring.recommend(c("profit_ratio"), c("confidence")).alias("recommendation"),
    )


def deal_block(reports: DataFrame) -> DataFrame:
    """Text block of each report row."""
    # Fixed value: the lines of a block, in order.
    line = (
        "--- DEAL #%d ---\nTITLE:           %s\nURL:             %s\nCURRENT PRICE:   %s\n"
        "TIME REMAINING:  %s\nBIDS:            %d\nLOCATION:        %s\n\nRESALE COMPS (%s — \"%s\"):\n  Avg:    %s\n  Median: %s\n"
        "  Range:  %s\n  Comps:  %s\n  Est. resale value: %s\n\nPROFIT RATIO:    %s\nEST. PROFIT:     %s\n"
        "CONFIDENCE:      %s\nRISK FLAGS:      %s\nRECOMMENDATION:  %s"
    )
    parts = [
        "deal_number", "title", "url", "current_price", "time_remaining", "bids", "location",
        "comps_label", "comps_query", "avg", "median",
        "range", "comps", "resale", "ratio", "profit", "confidence", "risk", "recommendation",
    ]
    return reports.select("deal_number", F.format_string(line, *parts).alias("block"))


def pick_line(deals: DataFrame) -> DataFrame:
    """One line on each deal; meant for the top pick."""
    c = F.col
    place = F.when(c("comps_source") == S.PRIMARY_SOURCE, "eBay").otherwise("FB Marketplace")
    dollars = [F.format_number(c(n), 0) for n in ("price", "resale_estimate", "est_profit")]
    plain = [F.replace(d, F.lit(","), F.lit("")) for d in dollars]
    text = F.concat(
        F.lit("TOP PICK: "), c("title"), F.lit(" - bid at $"), plain[0], F.lit(", resells for ~$"), plain[1],
        F.lit(" on "), place, F.lit(" - "), F.format_number(c("profit_ratio"), 1), F.lit("x return (~$"), plain[2], F.lit(" profit)"))
    return deals.select("url", text.alias("line"))


def summary_table(deals: DataFrame) -> DataFrame:
    """Short form of each numbered deal: cut title and time, money, verdict."""
    c = F.col
    return deals.select(
        c("deal_number").alias("number"),
        F.substring("title", 1, 35).alias("item"),
        money.price_label(c("price_str"), c("price")).alias("bid"),
        money.whole_dollars(c("resale_estimate")).alias("resale"),
        F.concat(F.format_number(c("profit_ratio"), 1), F.lit("x")).alias("ratio"),
        scoring.recommend(c("profit_ratio"), c("confidence")).alias("rec"),
        F.substring(F.coalesce(c("time_left"), F.lit("")), 1, 20).alias("time_left"),
    )


def item_block(items: DataFrame) -> DataFrame:
    """Text block of each kept item."""
    c = F.col
    def known(name: str):
        return F.coalesce(c(name), F.lit(""))
    block = F.concat_ws(
        "\n",
        F.concat(F.lit("ITEM: "), known("title"), F.lit(" | LOT: "), known("lot"),
                 F.lit(" | SITE: "), known("site"), F.lit(" | URL: "), known("url")),
        F.concat(F.lit("BID: "), money.whole_dollars(c("bid")),
                 F.lit(" | MARKET VALUE: "), money.whole_dollars(c("market_value")),
                 F.lit(" | EST. PROFIT: "), money.whole_dollars(c("profit")),
                 F.lit(" | ENDS: "), F.coalesce(F.date_format("ends", "yyyy-MM-dd"), F.lit(""))),
        F.concat(F.lit("PICKUP: "), known("pickup")),
        F.concat(F.lit("PHOTOS: "), F.array_join("photos", " ")),
    )
    return items.select("url", block.alias("block"))
