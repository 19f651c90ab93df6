"""Listing filters. Each is a plain predicate that Catalyst can push down."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from resalelens import settings as S
from resalelens.functions.geo import miles_between, near_latitude


def has_title(title: Column, shortest: int = 3) -> Column:
    return F.length(title) >= shortest


def has_price(price: Column) -> Column:
    return price > 0


def affordable(bid: Column, max_bid: float) -> Column:
    return (bid > 0) & (bid < max_bid)


def open_long_enough(ends: Column, as_of: Column, hours: int = S.CLOSING_HOURS) -> Column:
    """Ends a known time from now that is at least ``hours`` away."""
    return ends.isNotNull() & (ends >= as_of + F.make_dt_interval(hours=F.lit(hours)))


def profitable(ratio: Column | None, profit: Column, min_ratio: float | None, min_profit: float) -> Column:
    """Profit threshold, and the ratio threshold where there is one."""
    keep = profit >= min_profit
    return keep if min_ratio is None else keep & (ratio >= min_ratio)


def closing_within(listings: DataFrame, as_of: Column, hours: int = S.DEFAULT_HOURS) -> DataFrame:
    """Listings that close within ``hours`` of now."""
    close = F.col("close_ts")
    return listings.filter((close >= as_of) & (close <= as_of + F.make_dt_interval(hours=F.lit(hours))))


def five_digits(code: Column) -> Column:
    """Five-digit code of a plain or nine-digit one; NULL for anything else."""
    found = F.regexp_extract(code, r"^\s*(\d{5})(?:-?\d{4})?\s*$", 1)
    return F.when(found != "", found)


def zip_table(centroids: DataFrame) -> DataFrame:
    """One centroid per five-digit code, which bounds the table at 100,000 rows."""
    five = centroids.withColumn("zip", five_digits(F.col("zip"))).filter("zip IS NOT NULL")
    return five.groupBy("zip").agg(
        F.min_by("lat", F.struct("lat", "lon")).alias("lat"),
        F.min_by("lon", F.struct("lat", "lon")).alias("lon"),
    )


def _miles_from(centroids: DataFrame, home_zip: str, miles: float | None = None) -> DataFrame:
    """Distance of every code from home, of those within ``miles`` if given."""
    zips = zip_table(centroids)
    home = zips.filter(F.col("zip") == five_digits(F.lit(home_zip))).first()   # one row: codes are unique
    if home is None:
        raise ValueError(f"no centroid for the home code {home_zip!r}")
    lat0, lon0 = F.lit(home["lat"]), F.lit(home["lon"])
    if miles is not None:
        zips = zips.filter(near_latitude(F.col("lat"), lat0, miles))
    far = zips.select("zip", miles_between(lat0, lon0, F.col("lat"), F.col("lon")).alias("miles"))
    return far if miles is None else far.filter(F.col("miles") <= miles)


def within_radius(listings: DataFrame, centroids: DataFrame, home_zip: str, miles: float) -> DataFrame:
    """Listings whose ``zip`` lies within ``miles`` of ``home_zip``; adds ``miles``.

    Distances are worked out once per code, not once per listing, and only codes
    inside the radius reach the join. Nine-digit codes count as their first five; see
    :func:`unplaced` for listings whose distance cannot be told.
    """
    near = _miles_from(centroids, home_zip, miles).withColumnRenamed("zip", "_zip")
    return listings.join(F.broadcast(near), five_digits(F.col("zip")) == F.col("_zip")).drop("_zip")


def unplaced(listings: DataFrame, centroids: DataFrame) -> DataFrame:
    """Listings without a code that has a centroid: the rejects of a radius search."""
    known = zip_table(centroids).select(F.col("zip").alias("_zip"))
    return listings.join(F.broadcast(known), five_digits(F.col("zip")) == F.col("_zip"), "left_anti")


def code_of(location: Column) -> Column:
    """Code of a location: its last five-digit number, since a street number comes before it."""
    codes = F.regexp_extract_all(location, F.lit(r"\b(\d{5})(?:-\d{4})?\b"), F.lit(1))
    return F.try_element_at(codes, F.lit(-1))


def code_on_card(text: Column) -> Column:
    """Code on a card: the last one that follows a state, since lots are numbers too."""
    codes = F.regexp_extract_all(text, F.lit(r"\b[A-Z]{2},?\s+(\d{5})(?:-\d{4})?\b"), F.lit(1))
    return F.try_element_at(codes, F.lit(-1))


def not_too_far(
    records: DataFrame, centroids: DataFrame, home_zip: str, miles: float, code: Column | None = None,
) -> DataFrame:
    """Records without those whose location names a code more than ``miles`` away; ``code``
    is the code of ``location`` if none is given. A record without a known code stays: its
    distance cannot be told.
    """
    far = _miles_from(centroids, home_zip).select(F.col("zip").alias("_zip"), F.col("miles").alias("_miles"))
    own = code_of(F.col("location")) if code is None else code
    return (
        records.withColumn("_code", own).join(F.broadcast(far), F.col("_code") == F.col("_zip"), "left")
        .filter(F.col("_miles").isNull() | (F.col("_miles") <= miles))
        .drop("_code", "_zip", "_miles")
    )


def missing_fields(df: DataFrame, required: list[str]) -> DataFrame:
    """Number of rows that lack each required field, as one row per field."""
    def lacking(name: str) -> Column:
        c = F.col(name)
        return F.count_if(c.isNull() | (c.cast("string") == "")).alias(name)
    counts = df.agg(F.count(F.lit(1)).alias("rows"), *[lacking(n) for n in required])
    return counts.unpivot(["rows"], required, "field", "missing").select("field", "missing", "rows")
