"""Index pages as listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from resalelens import settings as S
from resalelens.functions import money, text, urls
from resalelens.operators.filters import has_title
from resalelens.operators.first import capped, first_per_key, first_per_title
from resalelens.sources import dom

# Fixed value: the first amount shown on a card.
CARD_PRICE = r"\$[\d,]+(?:\.\d{2})?"
BASE_URL = "https://www.publicsurplus.com"


def _cards(nodes: dom.Nodes) -> tuple:
    """Anchors to a listing, each with the text of the item around it, else of its parent."""
    found, shown = [], {}
    for at, n in enumerate(nodes, 1):
        if n[dom.TAG] == "a" and n[dom.HREF] and urls.VIEW_PATH in n[dom.HREF]:
            frame = n[dom.ITEM] or n[dom.PARENT]
            if frame not in shown:
                shown[frame] = dom.shown_of(nodes, frame)
            found.append({"href": n[dom.HREF], "anchor_text": dom.shown_of(nodes, at), "card": shown[frame]})
    return (found,)


def scan_cards(pages: DataFrame) -> DataFrame:
    """Anchors to a listing with the lines and first price of the card around them."""
    found = (
        dom.page_values(
            pages.select("page_id", "html"), _cards, "cards ARRAY<STRUCT<href: STRING, anchor_text: STRING, card: STRING>>", rendered=True)
        .select("page_id", F.posexplode("cards").alias("pos", "c")).select("page_id", "pos", "c.*")
    )
    return found.select(
        "page_id", "pos", "href", text.strip(F.col("anchor_text")).alias("anchor_text"),
        F.regexp_extract("card", CARD_PRICE, 0).alias("price_str"),
        text.card_lines(F.col("card")).alias("card_lines"),
    )


def listings_of(cards: DataFrame, base: str = BASE_URL, max_lines: int | None = None) -> DataFrame:
    """Typed listing of every card. ``pos`` orders by page, then by place on the page. The text
    of a card is that of all its lines, of the first ``max_lines`` if given."""
    lines = F.col("card_lines")
    linked = cards.filter(urls.is_listing_link(F.col("href"))).withColumn(
        "url", urls.absolutize(F.col("href"), base))
    return linked.withColumn("card_text", text.card_text(lines, max_lines)).select(
        urls.listing_key(F.col("url")).alias("id"),
        text.card_title(F.col("card_text"), F.col("anchor_text")).alias("title"),
        "url",
        money.price_of(F.col("price_str")).alias("price"),
        "price_str",
        text.time_left(lines).alias("time_left"),
        text.bid_count(lines).alias("bids"),
        text.state_of(lines).alias("location"),
        "card_text",
        F.struct("page_id", "pos").alias("pos"),
    )


def distinct_listings(listings: DataFrame, max_rows: int | None = None) -> DataFrame:
    """First listing per key, then titled ones, then the cap, then first per title.

    The order matters: a key is taken even if its first title is bad, and the cap
    counts rows that the title step may still remove.
    """
    titled = first_per_key(listings).filter(has_title(F.col("title")))
    kept = titled if max_rows is None else capped(titled, max_rows)
    return first_per_title(kept)


def with_details(listings: DataFrame, details: DataFrame) -> DataFrame:
    """Detail fields of each listing's page; a detail title needs four characters."""
    one = first_per_key(details, "url", ["page_id"]).select(
        "url",
        F.col("title").alias("_title"),
        "description", "condition",
        F.col("location").alias("_location"),
        "photo_count",
    )
    titled = F.when(F.length("_title") >= 4, F.col("_title"))
    placed = text.blank_to_null(F.col("_location"))
    return listings.join(one, "url", "left").select(
        *[c for c in listings.columns if c != "title"],
        F.coalesce(titled, F.col("title")).alias("title"),
        "description", "condition",
        F.coalesce(placed, F.col("location")).alias("pickup_location"),
        "photo_count",
    )
