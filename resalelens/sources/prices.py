"""Pages of sold and of current prices."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from resalelens import settings as S
from resalelens.functions import money
from resalelens.functions.text import BLANKS
from resalelens.sources import dom

# Where prices stand on a page of sold items and on one of current items.
SOLD_CLASS = r"(^|\s)s-item__price(\s|$)"
CURRENT_TAG, CURRENT_DIR = "span", "auto"


_SOLD = re.compile(SOLD_CLASS, re.ASCII)
_TEXTS = "ARRAY<STRING>"


def _sold(nodes: dom.Nodes, rendered: bool) -> list[str]:
    read = dom.shown_of if rendered else dom.clean_of
    return [read(nodes, at).strip(BLANKS) for at, n in enumerate(nodes, 1) if n[dom.CLS] is not None and _SOLD.search(n[dom.CLS])]


def _current(nodes: dom.Nodes) -> list[str]:
    return [
        dom.shown_of(nodes, at).strip(BLANKS) for at, n in enumerate(nodes, 1)
        if n[dom.TAG] == CURRENT_TAG and n[dom.DIR] == CURRENT_DIR]


def _price_texts(pages: DataFrame, read: Callable, fields: str, rendered: bool) -> DataFrame:
    return dom.page_values(pages.select("query", "page_id", "html"), read, fields, rendered=rendered)


def _kept(texts: Column, name: str, source: str) -> Column:
    """Texts as entries with their place on the page and their source; current ones only if
    they start with a dollar sign."""
    entries = F.transform(texts, lambda t, i: F.struct(i.alias("pos"), t.alias("price_text"), F.lit(source).alias("source")))
    return entries if name == "sold" else F.filter(entries, lambda e: F.startswith(e["price_text"], F.lit("$")))


def _entries(found: DataFrame, **sources: str) -> DataFrame:
    entries = F.concat(*[_kept(F.col(name), name, source) for name, source in sources.items()])
    return found.select("query", "page_id", F.explode(entries).alias("e")).select("query", "page_id", "e.*")


def scan_sold(pages: DataFrame, rendered: bool = True) -> DataFrame:
    """Price texts of sold-result pages in page order.

    ``pages`` has ``query, page_id, html``. ``rendered`` reads the text a browser
    shows; otherwise every piece is trimmed and the pieces are joined.
    """
    found = _price_texts(pages, lambda nodes: (_sold(nodes, rendered),), f"sold {_TEXTS}", rendered)
    return _entries(found, sold=S.PRIMARY_SOURCE)


def scan_current(pages: DataFrame) -> DataFrame:
    """Price texts of current-listing pages; only texts that start with a dollar sign."""
    found = _price_texts(pages, lambda nodes: (_current(nodes),), f"current {_TEXTS}", True)
    return _entries(found, current=S.SECONDARY_SOURCE)


def scan_both(pages: DataFrame) -> DataFrame:
    """Sold and current price texts of pages that hold both, each page parsed once."""
    found = _price_texts(pages, lambda nodes: (_sold(nodes, True), _current(nodes)), f"sold {_TEXTS}, current {_TEXTS}", True)
    return _entries(found, sold=S.PRIMARY_SOURCE, current=S.SECONDARY_SOURCE)


def scored_prices(texts: DataFrame) -> DataFrame:
    """Prices for scoring: low end of ranges, within the scorer's bounds."""
    return texts.withColumn("price", money.comp_price_low(F.col("price_text"))).filter("price IS NOT NULL")


def market_prices(texts: DataFrame) -> DataFrame:
    """Prices for a market value: midpoints of ranges, single prices within bounds."""
    return texts.withColumn("price", money.comp_price_mid(F.col("price_text"))).filter("price IS NOT NULL")
