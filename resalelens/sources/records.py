"""Listing-detail pages as typed records, driven by site rules.

A new site is one more rule. Rules are data: one literal table routes a link to its site,
and a page is read by the compiled patterns of its own site, all labels in one pass over its
texts. Neither the plan nor the work on a page grows with the number of rules. The texts
under the labels are all that leaves the pass; amounts and dates are read from them by
built-in functions.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame, functions as F

from resalelens import settings as S
from resalelens.functions import money
from resalelens.functions.dates import DATE_IN_TEXT
from resalelens.functions.text import BLANKS
from resalelens.functions.urls import absolutize
from resalelens.sources import dom


@dataclass(frozen=True)
class SiteRule:
    """How one site writes its listing pages. Patterns search anywhere in a text."""

    site: str
    host: str
    title_tags: tuple[str, ...]          # tried in order
    lot_patterns: tuple[str, ...]        # tried in order, group 1
    bid_label: str
    date_label: str
    location_label: str
    location_mode: str                   # parent | sibling_or_parent | sibling
    photo_pattern: str
    base_url: str                        # "" keeps links and repeats as they are
    spaced_bid: bool                     # join the pieces of the bid's text by blanks
    descriptions: tuple[tuple[str, str], ...] = ()   # (tag, class pattern), tried in order


# The labels, patterns and hosts of the supported sites, in routing order.
SITE_RULES = (
    SiteRule(
        site="ironplanet", host="ironplanet.com",
        title_tags=("h1", "h2"),
        lot_patterns=(r"/item/(\d+)", r"itemId=(\d+)"),
        bid_label=r"(?i)Current Bid|Winning Bid|Reserve Price|Buy Now|Starting Bid",
        date_label=r"(?i)Auction Closes|Closing Date|Sale Date|End Date",
        location_label=r"(?i)^Location$|Country|Region|Yard",
        location_mode="sibling",
        photo_pattern=r"(?i)photo|image|item|equipment|/photos/",
        base_url="https://www.ironplanet.com",
        spaced_bid=True,
        descriptions=(("div", r"(?i)desc|detail|condition|spec|info"),),
    ),
    SiteRule(
        site="publicsurplus", host="publicsurplus.com",
        title_tags=("h1",),
        lot_patterns=(r"[?&]id=(\d+)", r"auc=(\d+)"),
        bid_label=r"(?i)Current Bid|Minimum Bid|High Bid",
        date_label=r"(?i)Auction Ends|Close Date|Closing",
        location_label=r"(?i)Location|Agency",
        location_mode="parent",
        photo_pattern=r"(?i)photo",
        base_url="",
        spaced_bid=False,
    ),
    SiteRule(
        site="bidspotter", host="bidspotter.com",
        title_tags=("h1", "h2"),
        lot_patterns=(r"/lots/(\w+)",),
        bid_label=r"(?i)Current Bid|Starting Bid|Reserve|Bid Now",
        date_label=r"(?i)Auction Ends|Closing|End Time|Close Date",
        location_label=r"(?i)^Location$|Auction Location|Pickup",
        location_mode="sibling_or_parent",
        photo_pattern=r"(?i)photo|image|lot|item|/img/",
        base_url="https://www.bidspotter.com",
        spaced_bid=True,
        descriptions=(("div", r"(?i)desc|detail|lot.?info|item.?info"), ("section", r"(?i)desc|detail")),
    ),
)

# Selectors of the generic detail view, as tag and class/id tests.
TITLE_CLASS = r"title"
DESCRIPTION_CLASS = r"desc"
DESCRIPTION_ID = "description"
CONDITION_CLASS = r"condition|status"
LOCATION_CLASS = r"location|pickup|agency"
DETAIL_PHOTO = r"auction|photo|img"


UNKNOWN = "unknown"
_SHORT_TEXT = 64


def site_of(url: Column, rules=SITE_RULES) -> Column:
    """Site of the first rule whose host occurs in the link; NULL without one."""
    table = F.from_json(F.lit(json.dumps([[r.host, r.site] for r in rules])), "array<array<string>>")
    return F.try_element_at(F.filter(table, lambda r: F.contains(url, r[0])), F.lit(1))[1]


def routed(pages: DataFrame, rules=SITE_RULES) -> DataFrame:
    """Add ``site``, and ``error`` for pages no rule covers."""
    site = site_of(F.col("url"), rules)
    return pages.withColumn("site", F.coalesce(site, F.lit(UNKNOWN))).withColumn(
        "error", F.when(site.isNull(), S.UNSUPPORTED))


def accepted(records: DataFrame) -> DataFrame:
    return records.filter(F.col("error").isNull())


def rejects(records: DataFrame) -> DataFrame:
    return records.filter(F.col("error").isNotNull()).select("url", "site", "error")


class _Reader:
    """Reads pages of one site. A page's texts are searched for any label first; the few
    that hit are then tried for each kind of label."""

    FIELDS = (
        "title STRING, lot STRING, bids ARRAY<STRING>, dates ARRAY<STRING>, location STRING, photos ARRAY<STRING>, "
        "description STRING, base STRING")

    def __init__(self, rule: SiteRule):
        self.rule = rule
        self.lots = [re.compile(p) for p in rule.lot_patterns]
        labels = (rule.bid_label, rule.date_label, rule.location_label)
        self.labels = [re.compile(p) for p in labels]
        self.any_label = re.compile("|".join(f"(?:{_scoped(p)})" for p in labels))
        self.kinds = lru_cache(4096)(self.kinds_of)
        self.photo = re.compile(rule.photo_pattern)
        self.descriptions = [(tag, re.compile(p)) for tag, p in rule.descriptions]

    def kinds_of(self, text: str) -> tuple[int, ...]:
        """Kinds of label in a text. Pages of one site repeat the short texts of their layout."""
        return tuple(k for k, p in enumerate(self.labels) if p.search(text)) if self.any_label.search(text) else ()

    def lot(self, url: str) -> str | None:
        return next((m[1] for p in self.lots if (m := p.search(url)) and m[1]), None)

    def location(self, nodes: dom.Nodes, parents: list[int]) -> str | None:
        mode = self.rule.location_mode
        if mode == "parent":
            return dom.clean_of(nodes, parents[0]) if parents else None
        for p in parents:
            beside = nodes[p - 1][dom.NEXT]
            text = dom.clean_of(nodes, beside) if beside else dom.clean_of(nodes, p) if mode == "sibling_or_parent" else ""
            if text:
                return text
        return None

    def read(self, nodes: dom.Nodes, url: str) -> tuple:
        parents = bids, dates, places = [], [], []
        photos, titles, descriptions = [], {}, {}
        title_tags, kinds, kinds_of = self.rule.title_tags, self.kinds, self.kinds_of
        for at, (kind, parent, _, _, _, tag, text, _, _, cls, _, src, _) in enumerate(nodes, 1):
            if kind != dom.ELEMENT:
                for k in kinds(text) if len(text) <= _SHORT_TEXT else kinds_of(text):
                    parents[k].append(parent)
                continue
            if tag in title_tags:
                titles.setdefault(tag, at)
            if src is not None and tag == "img" and self.photo.search(src):
                photos.append(src)
            if cls is not None:
                for k, (of, pattern) in enumerate(self.descriptions):
                    if of == tag and k not in descriptions and pattern.search(cls):
                        descriptions[k] = at
        # The first heading counts even if it is empty.
        title = next((titles[t] for t in self.rule.title_tags if t in titles), None)
        about = min(descriptions) if descriptions else None
        bid_text = (lambda p: dom.clean_of(nodes, p, " ")) if self.rule.spaced_bid else (lambda p: dom.raw_of(nodes, p))
        return (
            None if title is None else dom.clean_of(nodes, title), self.lot(url), list(map(bid_text, bids)),
            [dom.raw_of(nodes, p, " ") for p in dates], self.location(nodes, places), photos,
            None if about is None else dom.clean_of(nodes, descriptions[about], " "), self.rule.base_url)


def _scoped(pattern: str) -> str:
    """A pattern whose leading flag holds for itself only, to stand beside others."""
    return f"(?i:{pattern[4:]})" if pattern.startswith("(?i)") else pattern


def _page_reader(rules):
    """Reader of pages by their site; patterns are compiled once per worker and site."""
    of_site = {r.site: r for r in reversed(rules)}
    readers: dict[str, _Reader] = {}

    def read(nodes: dom.Nodes, url: str, site: str) -> tuple:
        if site not in readers:
            readers[site] = _Reader(of_site[site])
        return readers[site].read(nodes, url)
    return read


def extract_records(
    pages: DataFrame, rules=SITE_RULES, loose: bool = False, max_location: int | None = None,
    max_photos: int | None = None, max_description: int | None = None,
) -> DataFrame:
    """One record per page. ``pages`` has ``page_id, url, html``.

    Absent texts are NULL here; :func:`with_sentinels` gives the output form. Locations,
    photos and descriptions are whole unless a limit is given.
    """
    sited = routed(pages.select("page_id", "url", "html"), rules)
    known = dom.page_values(accepted(sited).drop("error"), _page_reader(rules), _Reader.FIELDS, ("url", "site"))
    bids = F.transform("bids", lambda t: money.bid_of(t, loose))
    dates = F.transform("dates", lambda t: F.regexp_extract(t, DATE_IN_TEXT, 0))
    links = F.when(F.col("base") == "", F.col("photos")).otherwise(
        F.array_distinct(F.transform("photos", lambda s: absolutize(s, F.col("base")))))

    def cut(text: str, limit: int | None) -> Column:
        return (F.col(text) if limit is None else F.substring(text, 1, limit)).alias(text)

    found = known.select(
        "page_id", "url", "site", "title", "lot",
        _first(bids, lambda b: b > 0).alias("current_bid"),
        _first(dates, lambda d: d != "").alias("end_date"),
        cut("location", max_location),
        (links if max_photos is None else F.slice(links, 1, max_photos)).alias("photos"),
        cut("description", max_description),
        F.lit(None).cast("string").alias("error"),
    )
    unknown = sited.filter(F.col("error").isNotNull()).select("page_id", "url", "site", "error")
    return found.unionByName(unknown, allowMissingColumns=True)


def _first(values: Column, test) -> Column:
    return F.try_element_at(F.filter(values, test), F.lit(1))


def with_sentinels(records: DataFrame) -> DataFrame:
    """Output form: absent texts are empty, an absent bid is zero."""
    texts = {c: "" for c in ("title", "lot", "end_date", "location", "description")}
    return records.fillna({**texts, "current_bid": 0.0})


_DETAIL_FIELDS = "title STRING, description STRING, condition STRING, location STRING, photo_count INT"
_TITLE, _DESCRIPTION, _CONDITION, _LOCATION, _PHOTO = map(
    re.compile, (TITLE_CLASS, DESCRIPTION_CLASS, CONDITION_CLASS, LOCATION_CLASS, DETAIL_PHOTO))


def _detail(nodes: dom.Nodes) -> tuple:
    first: dict[int, int] = {}
    photos = 0
    for at, n in enumerate(nodes, 1):
        if n[dom.KIND] != dom.ELEMENT:
            continue
        tag, cls = n[dom.TAG], n[dom.CLS] or ""
        hits = (
            tag in ("h1", "h2") or _TITLE.search(cls), _DESCRIPTION.search(cls) or n[dom.ID] == DESCRIPTION_ID,
            _CONDITION.search(cls), _LOCATION.search(cls))
        for k, hit in enumerate(hits):
            if hit:
                first.setdefault(k, at)
        if tag == "img" and n[dom.SRC] and _PHOTO.search(n[dom.SRC]):
            photos += 1
    return *(dom.shown_of(nodes, first[k]).strip(BLANKS) if k in first else None for k in range(4)), photos


def detail_fields(pages: DataFrame) -> DataFrame:
    """Generic detail view of a page: first element that matches each selector."""
    return dom.page_values(pages.select("page_id", "url", "html"), _detail, _DETAIL_FIELDS, rendered=True)
