"""Fixed values and parameters of the deal finder."""

from __future__ import annotations

from dataclasses import dataclass, field

# Result thresholds, bounds and caps. They decide results and must
# not drift.
MIN_RATIO = 1.8
MIN_PROFIT = 100.0
BUY_RATIO = 2.5
HIGH_COMPS = 5
MED_COMPS = 3
CONDITION_DISCOUNT = 0.70
SCORER_BOUNDS = (0.99, 50000.0)
MARKET_BOUNDS = (1.0, 100000.0)
MARKET_SAMPLE = 20
PRIMARY_TERMS = 6
SECONDARY_TERMS = 5
CARD_LINES = 8
MAX_PHOTOS = 10
MAX_LOCATION = 100
MAX_DESCRIPTION = 2000
MAX_EXPORT_TITLE = 100
RECORD_LIMITS = {"max_location": MAX_LOCATION, "max_photos": MAX_PHOTOS, "max_description": MAX_DESCRIPTION}
MAX_LISTINGS = 50
DEFAULT_HOURS = 72
CLOSING_HOURS = 24
DEFAULT_CONDITION = "Used - Good"
RISK_LABEL = "AS-IS / Condition risk (-30% applied)"
PRIMARY_SOURCE = "ebay_sold"
SECONDARY_SOURCE = "facebook_marketplace"
MARKET_SOURCE = "ebay_completed"
NO_SALES_NOTE = "No sold listings found"
PRIMARY_LABEL = "eBay Sold Listings"
SECONDARY_LABEL = "Facebook Marketplace Phoenix"
UNSUPPORTED = "Unsupported site"

# Phrases that mark a condition risk.
RISK_PHRASES = ("as-is", "as is", "untested", "for parts", "unknown condition", "non-working")

# Kinds of item that are never kept, and the heaviest load a buyer can carry (lb).
EXCLUDED_WORDS = (
    "vehicle", "truck", "sedan", "suv", "pickup truck", "van", "bus", "motorcycle",
    "trailer", "camper", "rv", "real estate", "house", "land parcel", "acreage",
)
MAX_WEIGHT_LB = 200.0


@dataclass(frozen=True)
class Search:
    """One search entry: what to look for and within which bids."""

    keywords: str = ""
    category: str = ""
    state: str = ""
    min_bid: float | None = None
    max_bid: float | None = None


@dataclass(frozen=True)
class ScanConfig:
    """Parameters of one scan; the values are the defaults of a missing file."""

    max_listings_per_search: int = 3
    your_city_state: str = "Phoenix, AZ"
    your_zip: str = "85001"
    radius_miles: float = 100.0
    state: str = "AZ"
    max_bid: float = 1500.0
    min_profit: float = 100.0
    max_daily_posts: int = 5
    searches: tuple[Search, ...] = field(default=(
        Search(category="Tools & Equipment"),
        Search(category="Electronics & Computers"),
        Search(category="Generators & Power Equipment"),
    ))
