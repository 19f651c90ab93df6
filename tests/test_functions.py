"""Golden values of the column functions."""

import math

import pytest
from pyspark.sql import functions as F

from resalelens import settings as S
from resalelens.functions import dates, geo, money, scoring, text, urls

C = F.col


@pytest.mark.parametrize("raw, want", [
    ("MILWAUKEE m18 it's 3d/rotary", "Milwaukee M18 It'S 3D/Rotary"),
    ("café déjà-vu", "Café Déjà-Vu"),
    ("ßeta", "Sseta"),
    ("", ""),
])
def test_title_case_follows_letters(one, raw, want):
    assert one(text.title_case(C("t")), t=raw) == want == raw.title()


def test_strip_removes_every_blank(one):
    assert one(text.strip(C("t")), t=" \t\n\xa0 a b 　\r") == "a b"


def test_norm_title_is_unicode(one):
    assert one(text.norm_title(C("t")), t="  Café--Table_2 (NEW!) ") == "café table_2 new"


def test_search_terms_keep_first_long_words(one):
    title = "An old DeWalt 20V café drill & 3 bits for sale now"
    assert one(text.search_terms(C("t"), 6), t=title) == ["old", "DeWalt", "20V", "café", "drill", "bits"]
    assert one(text.search_query(C("t"), 5), t=title) == "old DeWalt 20V café drill"
    assert one(text.search_query(C("t")), t="a an") == ""


def test_card_text_takes_eight_lines(one):
    raw = "\n a \n\n b\nc\nd\ne\nf\ng\nh\ni\n"
    assert one(text.card_lines(C("t")), t=raw) == list("abcdefghi")
    assert one(text.card_text(text.card_lines(C("t")), S.CARD_LINES), t=raw) == "a | b | c | d | e | f | g | h"


@pytest.mark.parametrize("card, anchor, want", [
    ("View | #12 - OLD drill's kit | $5", "x", "Old Drill'S Kit"),
    ("#12 - lone title", "x", "Lone Title"),
    ("12 - no mark | $5", " Anchor text ", "Anchor text"),
])
def test_card_title(one, card, anchor, want):
    assert one(text.card_title(C("c"), C("a")), c=card, a=anchor) == want


def test_first_lines(one):
    lines = F.split(C("t"), "\n")
    raw = "Minimum bid $5\n2 days left\nArizona\nAZ\nTX\nNo bids\n3 Bids\n4 bids"
    assert one(text.time_left(lines), t=raw) == "Minimum bid $5"   # the raw rule
    assert one(dates.time_left_minutes(text.time_left(lines)), t=raw) is None
    assert one(text.state_of(lines), t=raw) == "AZ"
    assert one(text.bid_count(lines), t=raw) == 3
    assert one(text.bid_count(lines), t="nothing") is None


def test_time_left_minutes(one):
    assert one(dates.time_left_minutes(C("t")), t="2 Days 3 hrs 4 min") == 2 * 1440 + 184


@pytest.mark.parametrize("raw, want", [
    ("$1,234.50", 1234.5), ("now $7 or $9", 7.0), ("$5.5", 5.0), ("12.00", None), ("$,", None), ("", None),
])
def test_price_of(one, raw, want):
    assert one(money.price_of(C("t")), t=raw) == want


@pytest.mark.parametrize("raw, strict, loose", [
    ("Current Bid (3 bids) $50", 50.0, 3.0),
    ("Current Bid $1,250.75", 1250.75, 1250.75),
    ("Starting Bid 40", 40.0, 40.0),
    ("Current Bid", None, None),
])
def test_bid_of(one, raw, strict, loose):
    assert one(money.bid_of(C("t")), t=raw) == strict
    assert one(money.bid_of(C("t"), loose=True), t=raw) == loose


@pytest.mark.parametrize("raw, low, mid", [
    ("$1,234.50", 1234.5, 1234.5),
    ("$50.00 to $75.00", 50.0, 62.5),
    ("$50.00 TO $75.00", 50.0, 62.5),
    ("$50.00 to offer", 50.0, None),
    ("$0.99", None, None),
    ("$1", 1.0, None),
    ("$1.01", 1.01, 1.01),
    ("$49,999.99", 49999.99, 49999.99),
    ("$50,000", None, 50000.0),
    ("$100,000", None, None),
    ("$100,000 to $300,000", None, 200000.0),   # midpoints have no bounds
    ("75", None, 75.0),
    ("free", None, None),
])
def test_comp_prices(one, raw, low, mid):
    assert one(money.comp_price_low(C("t")), t=raw) == low
    assert one(money.comp_price_mid(C("t")), t=raw) == mid


def test_labels(one):
    assert one(money.whole_dollars(C("x")), x=1234.5) == "$1,234"
    assert one(money.price_label(C("s"), C("x")), s="", x=0.0) == "$0.00"
    assert one(money.price_label(C("s"), C("x")), s="$9", x=9.0) == "$9"
    assert one(money.cents(C("x")), x=2.675) == 2.68


@pytest.mark.parametrize("raw, want", [
    ("1/5/26", "2026-01-05"), ("01/05/2026", "2026-01-05"), ("12/31/2025", "2025-12-31"),
    ("1/5/123", None), ("", None), ("13/40/2026", None),
])
def test_end_date(one, raw, want):
    got = one(F.date_format(dates.end_date(C("t")), "yyyy-MM-dd"), t=raw)
    assert got == want


def test_urls(one):
    base = "https://h.example"
    assert one(urls.absolutize(C("t"), base), t="/a?b") == base + "/a?b"
    assert one(urls.absolutize(C("t"), base), t="http://x/") == "http://x/"
    assert one(urls.listing_key(C("t")), t="https://h/auction/view?auc=12&x=1") == "12"
    assert one(urls.listing_key(C("t")), t="https://h/auction/view/9") == "https://h/auction/view/9"
    assert one(urls.is_listing_link(F.lit(None).cast("string"))) is False
    assert "_nkw=a+b%26c&" in one(urls.sold_search_url(C("t")), t="a b&c")


def test_miles(one):
    lit = F.lit
    phoenix_tucson = one(geo.miles_between(lit(33.4484), lit(-112.0740), lit(32.2226), lit(-110.9747)))
    assert 100 < phoenix_tucson < 112
    assert one(geo.near_latitude(lit(33.4484), lit(32.2226), 112.0)) is True
    assert one(geo.miles_between(lit(1.0), lit(2.0), lit(1.0), lit(2.0))) == 0


@pytest.mark.parametrize("n, want", [(0, "LOW"), (2, "LOW"), (3, "MED"), (4, "MED"), (5, "HIGH")])
def test_confidence(one, n, want):
    assert one(scoring.confidence(C("n")), n=n) == want


@pytest.mark.parametrize("ratio, conf, want", [
    (2.5, "HIGH", "BUY"), (2.5, "LOW", "WATCH"), (2.49, "HIGH", "WATCH"), (1.8, "LOW", "WATCH"), (1.79, "HIGH", "SKIP"),
])
def test_recommendation(one, ratio, conf, want):
    assert one(scoring.recommend(C("r"), C("c")), r=ratio, c=conf) == want


def test_risk_and_resale(one):
    risk = scoring.condition_risk(C("c"), C("d"))
    assert one(risk, c="Sold AS-IS", d="") is True
    assert one(risk, c="fine", d="Untested unit") is True
    assert one(risk, c="fine", d="fine") is False
    null = F.lit(None).cast("string")
    assert one(scoring.condition_risk(C("c"), null), c="for parts") is True
    resale = scoring.resale_estimate(C("m"), C("a"), C("r"))
    assert one(resale, m=100.0, a=50.0, r=False) == 100.0
    assert one(resale, m=0.0, a=50.0, r=False) == 50.0
    assert math.isclose(one(resale, m=100.0, a=50.0, r=True), 70.0)
    assert one(scoring.profit_ratio(C("x"), C("y")), x=10.0, y=0.0) == 0.0
    assert one(scoring.risk_flags(F.lit(True))) == ["AS-IS / Condition risk (-30% applied)"]
    assert one(scoring.risk_flags(F.lit(False))) == []


@pytest.mark.parametrize("raw, want", [
    ("2005 Ford Truck", True), ("utility trailers", True), ("vanity table", False), ("busbar", False),
    ("lathe 1,200 lbs", True), ("anvil 200 lb", False), ("anvil 200.5 pounds", True), ("drill", False),
])
def test_excluded_kinds(one, raw, want):
    assert one(scoring.excluded_kind(C("t")), t=raw) is want
