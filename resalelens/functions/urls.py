"""Link and listing-key columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from resalelens.functions.text import blank_to_null

# How a listing link is recognised and keyed.
VIEW_PATH = "/auction/view"
AUCTION_KEY = r"auc=(\d+)"


def absolutize(href: Column, base: Column | str) -> Column:
    """Prefix the host unless the link already starts with ``http``."""
    base = F.lit(base) if isinstance(base, str) else base
    return F.when(href.startswith("http"), href).otherwise(F.concat(base, href))


def listing_key(url: Column) -> Column:
    """Auction number of a link, else the link itself."""
    return F.coalesce(blank_to_null(F.regexp_extract(url, AUCTION_KEY, 1)), url)


def is_listing_link(href: Column) -> Column:
    return F.coalesce(F.contains(href, F.lit(VIEW_PATH)), F.lit(False))


def sold_search_url(query: Column) -> Column:
    """Address of the completed-and-sold search that captures a query's prices."""
    return F.concat(
        F.lit("https://www.ebay.com/sch/i.html?_nkw="), F.url_encode(query),
        F.lit("&LH_Sold=1&LH_Complete=1&_sop=13"),
    )
