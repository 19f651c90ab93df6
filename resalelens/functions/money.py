"""Price columns. An absent price is NULL; outputs turn it into a sentinel."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from resalelens import settings as S

# The patterns that read an amount.
DOLLARS = r"\$([\d,]+(?:\.\d{2})?)"
NUMBER = r"[\d,]+\.?\d*"
ANCHORED_BID = r"\$\s*(\d+\.?\d*)"
LOOSE_BID = r"\$?(\d+\.?\d*)"


def amount(digits: Column) -> Column:
    """Number of a text of digits and commas; NULL if it is none."""
    return F.replace(digits, F.lit(","), F.lit("")).try_cast("double")


def price_of(text: Column) -> Column:
    """First dollar amount of a text."""
    return amount(F.regexp_extract(text, DOLLARS, 1))


def bid_of(text: Column, loose: bool = False) -> Column:
    """Amount of a labelled bid.

    The amount after a dollar sign, else the first bare number. ``loose`` takes the
    first number whether or not a dollar sign precedes it.
    """
    plain = F.replace(text, F.lit(","), F.lit(""))
    bare = F.regexp_extract(plain, LOOSE_BID, 1).try_cast("double")
    if loose:
        return bare
    return F.coalesce(F.regexp_extract(plain, ANCHORED_BID, 1).try_cast("double"), bare)


def between_exclusive(price: Column, bounds: tuple[float, float]) -> Column:
    low, high = bounds
    return (price > low) & (price < high)


def comp_price_low(text: Column, bounds: tuple[float, float] = S.SCORER_BOUNDS) -> Column:
    """Sold price, a range counting as its lower end; NULL outside the bounds."""
    price = price_of(text)
    return F.when(between_exclusive(price, bounds), price)


def comp_price_mid(text: Column, bounds: tuple[float, float] = S.MARKET_BOUNDS) -> Column:
    """Sold price, a range counting as its midpoint; bounds hold for single prices only."""
    ends = F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))
    low, high = amount(F.try_element_at(ends, F.lit(1))), amount(F.try_element_at(ends, F.lit(2)))
    single = amount(F.regexp_extract(F.replace(text, F.lit(","), F.lit("")), NUMBER, 0))
    return (
        F.when(F.contains(F.lower(text), F.lit(" to ")), (low + high) / 2)
        .when(between_exclusive(single, bounds), single)
    )


def cents(c: Column) -> Column:
    """Round a money or ratio column to two places, half up."""
    return F.round(c, 2)


def whole_dollars(c: Column) -> Column:
    """``$1,234`` label."""
    return F.concat(F.lit("$"), F.format_number(c, 0))


def price_label(price_str: Column, price: Column) -> Column:
    """Price text as captured, else ``$0.00`` form of the number."""
    shown = F.when(F.length(price_str) > 0, price_str)
    return F.coalesce(shown, F.format_string("$%.2f", F.coalesce(price, F.lit(0.0))))


def plain(amount: Column) -> Column:
    """Amount in cents as text without an exponent, with one decimal at least."""
    return F.regexp_replace(amount.cast("decimal(22,2)").cast("string"), r"0$", "")
