"""Search entries against listings, and the caps that follow.

An entry meets only listings that can match it. An entry with a keyword of three characters
or more is looked up by the rarest three characters of the keyword, any other by the parts
of its bid range, which are ranges of powers of two that do not overlap. Both are equi-joins
together with the category, and both give each pair once; the whole entry is then checked on
the pairs. An entry whose keyword holds three characters that no title has is dropped before
the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from resalelens.operators.first import first_rows
from resalelens.operators.storage import is_small, written

GRAM = 3
#: Bids are told apart up to two to this power of dollars; larger ones share the last bin.
LEVELS = 42
_TOP = (1 << LEVELS) - 1
#: Lookups that one table on every executor may hold.
SMALL = 100_000


def _words() -> Column:
    return F.coalesce(F.lower("keywords"), F.lit(""))


def _wanted() -> Column:
    """Predicate of one search entry; empty fields and absent bounds match all."""
    words = F.coalesce(F.lower("s.keywords"), F.lit(""))
    state = F.coalesce(F.col("s.state"), F.lit(""))
    return (
        F.contains(F.lower("l.title"), words)
        & ((state == "") | (F.col("l.state") == state))
        & (F.col("s.min_bid").isNull() | (F.col("l.price") >= F.col("s.min_bid")))
        & (F.col("s.max_bid").isNull() | (F.col("l.price") <= F.col("s.max_bid")))
    )


def grams(text: Column, size: int = GRAM) -> Column:
    """Distinct runs of three characters, or another number; none in a shorter text."""
    starts = F.sequence(F.lit(1), F.length(text) - (size - 1))
    runs = F.transform(starts, lambda i: F.substr(text, i, F.lit(size)))
    return F.when(F.length(text) >= size, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def _dollars(bid: Column) -> Column:
    """Whole dollars within the bins, NULL for no bid; not a number is above any amount."""
    return F.when(F.isnan(bid), _TOP).when(bid.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(_TOP), F.floor(bid)))).cast("long")


def _part_key(level: Column, part: Column) -> Column:
    return F.concat(F.lit("p"), level.cast("string"), F.lit(":"), part.cast("string"))


def range_parts(low: Column, high: Column) -> Column:
    """The fewest ranges of powers of two, aligned to their size, that make up a range of
    bids: ``array<struct<level, part>>``. An absent bound is open."""
    return _parts_between(F.coalesce(_dollars(low), F.lit(0)), F.coalesce(_dollars(high), F.lit(_TOP)))


def _parts_between(low: Column, high: Column) -> Column:
    """Parts that make up a range of whole numbers; none if it is empty."""
    kind = "struct<low:bigint,high:bigint,parts:array<struct<level:int,part:bigint>>>"
    start = F.struct(
        low.alias("low"), high.alias("high"), F.array().alias("parts")).cast(kind)

    def part(level: Column, at: Column, taken: Column) -> Column:
        one = F.array(F.struct(level.alias("level"), at.alias("part")))
        return F.when(taken, one).otherwise(F.array().cast("array<struct<level:int,part:bigint>>"))

    def step(acc: Column, level: Column) -> Column:
        """Take the ends that are no half of a larger part, then go to parts twice as large."""
        low, high = acc["low"], acc["high"]
        odd, even = (low <= high) & (low % 2 == 1), (low <= high) & (high % 2 == 0)
        return F.struct(
            F.shiftright(low + odd.cast("long"), 1).alias("low"), (F.shiftright(high + 1 - even.cast("long"), 1) - 1).alias("high"),
            F.concat(acc["parts"], part(level, low, odd), part(level, high, even)).alias("parts")).cast(kind)

    return F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS)), start, step)["parts"]


def entry_keys(listings: DataFrame, searches: DataFrame) -> DataFrame:
    """``searches`` with the category and key of each lookup, ``_category, _key``; stored."""
    category = F.coalesce("category", F.lit("")).alias("_category")
    entries = searches.withColumn("_words", _words())
    long = entries.filter(F.length("_words") >= GRAM)
    asked = written(long.select(F.explode(grams(F.col("_words"))).alias("_gram")).distinct(), "asked-grams")
    held = listings.select(F.explode(grams(F.lower("title"))).alias("_gram"))
    freq = held.join(asked, "_gram", "left_semi").groupBy("_gram").agg(F.count(F.lit(1)).alias("_n"))
    rarest = (
        long.select("_words").distinct().select("_words", F.explode(grams(F.col("_words"))).alias("_gram"))
        .join(freq, "_gram", "left").groupBy("_words")
        .agg(F.min_by("_gram", F.struct("_n", "_gram")).alias("_key"), F.min(F.coalesce("_n", F.lit(0))).alias("_least"))
        .filter("_least > 0").select("_words", "_key"))
    by_gram = long.join(rarest, "_words").select(*searches.columns, category, F.concat(F.lit("t"), "_key").alias("_key"))
    open_range = F.col("min_bid").isNull() & F.col("max_bid").isNull()
    parts = F.transform(range_parts(F.col("min_bid"), F.col("max_bid")), lambda p: _part_key(p["level"], p["part"]))
    keys = F.when(open_range, F.array(F.lit("a"))).otherwise(parts)
    by_bid = entries.filter(F.length("_words") < GRAM).select(*searches.columns, category, F.explode(keys).alias("_key"))
    return written(by_gram.unionByName(by_bid), "search-keys")


def _listing_keys(used: list[str]) -> Column:
    """All keys under which a listing may be looked up; ``used`` are the kinds in use."""
    kinds = []
    if "a" in used:
        kinds.append(F.array(F.lit("a")))
    if "t" in used:
        kinds.append(F.transform(grams(F.lower("title")), lambda g: F.concat(F.lit("t"), g)))
    levels = sorted(int(u[1:]) for u in used if u[0] == "p")
    if levels:
        bid = _dollars(F.col("price"))
        kinds.append(F.when(F.col("price").isNotNull(), F.array(*[_part_key(F.lit(n), F.shiftright(bid, n)) for n in levels])))
    return F.flatten(F.array_compact(F.array(*kinds)))


def candidates(listings: DataFrame, searches: DataFrame) -> DataFrame:
    """Pairs of a listing ``l`` and an entry ``s`` that the index brings together."""
    keyed = entry_keys(listings, searches)
    kind = F.when(F.col("_key").startswith("p"), F.substring_index("_key", ":", 1)).otherwise(F.substring("_key", 1, 1))
    used = [r[0] for r in keyed.select(kind).distinct().collect()] or ["a"]   # 45 kinds at most
    places = F.array_distinct(F.array(F.coalesce("category", F.lit("")), F.lit("")))
    spread = listings.select("*", F.explode(_listing_keys(used)).alias("_key"))
    asked = keyed.select("_key").distinct()
    left = spread.join(asked, "_key", "left_semi").withColumn("_category", F.explode(places))
    # A stored table of many entries is small only as a compressed file.
    keyed = keyed if is_small(keyed, SMALL) else keyed.hint("merge")
    return left.alias("l").join(
        keyed.alias("s"), (F.col("l._category") == F.col("s._category")) & (F.col("l._key") == F.col("s._key")))


def search_matches(listings: DataFrame, searches: DataFrame) -> DataFrame:
    """Listings of each search entry: same category, and the entry's other terms.

    ``listings`` has ``category, title, state, price``; ``searches`` has
    ``search_id, category, keywords, state, min_bid, max_bid``. An entry without a
    category takes all: each listing is looked up by its category and by the empty one.
    """
    return candidates(listings, searches).filter(_wanted()).select(
        F.col("s.search_id").alias("search_id"), "l.*").drop("_category", "_key")


# --- first matches of each entry, without all pairs ------------------------------------

_ASK = ["_words", "_place", "_state", "min_bid", "max_bid"]
_WHERE = ["_words", "_place", "_state", "_key"]
_EDGE = "e"   # kind of key of the bins that hold a bound


def _cents(bid: Column) -> Column:
    return _dollars(bid * 100)


def held_words(titles: DataFrame, words: DataFrame) -> DataFrame:
    """Words ``_words`` that each distinct title ``_title`` holds, by the rarest run of characters."""
    sized = words.filter("_words != ''").select("_words", F.least(F.length("_words"), F.lit(GRAM)).alias("_size"))
    sizes = [r[0] for r in sized.select("_size").distinct().collect()]   # three at most
    if not sizes:
        return titles.join(words, F.lit(False)).select("_title", "_words")
    runs = F.flatten(F.array(*[grams(F.col("_title"), n) for n in sizes]))
    by_size = F.when(F.col("_size") == 1, grams(F.col("_words"), 1)).when(F.col("_size") == 2, grams(F.col("_words"), 2))
    asked = written(sized.select("_words", F.explode(by_size.otherwise(grams(F.col("_words")))).alias("_gram")), "asked-runs")
    met = titles.select("_title", F.explode(runs).alias("_gram")).join(asked.select("_gram").distinct(), "_gram", "left_semi")
    freq = met.groupBy("_gram").agg(F.count(F.lit(1)).alias("_n"))
    rarest = asked.join(freq, "_gram", "left").groupBy("_words").agg(
        F.min_by("_gram", F.struct(F.coalesce("_n", F.lit(0)), "_gram")).alias("_gram"))
    return met.join(rarest, "_gram").filter(F.contains("_title", F.col("_words"))).select("_title", "_words")


def _ask_keys() -> Column:
    """Keys of an entry's bids: the parts strictly between its bounds' bins, and those bins."""
    low, high = _cents(F.col("min_bid")), _cents(F.col("max_bid"))
    between = _parts_between(F.coalesce(low + 1, F.lit(0)), F.coalesce(high - 1, F.lit(_TOP)))
    parts = F.transform(between, lambda p: _part_key(p["level"], p["part"]))
    edges = F.transform(F.array_distinct(F.array_compact(F.array(low, high))), lambda b: F.concat(F.lit(_EDGE), b.cast("string")))
    return F.when(low.isNull() & high.isNull(), F.array(F.lit("a"))).otherwise(F.concat(parts, edges))


def first_matches(listings: DataFrame, searches: DataFrame, cap: int) -> DataFrame:
    """First ``cap`` listings of each search entry in the order of ``pos``: the rows of
    ``capped_per_search(search_matches(listings, searches), cap)``, without making all pairs.

    Listings that no entry can tell apart, being equal in price, category, state and the
    keywords they hold, are cut to the first ``cap`` of them. Of each keyword, category, state
    and part of the bids the first ``cap`` are listed, and so are those of each price. An entry
    reads the lists of the parts inside its range, whose every row fits, and the prices in the
    bins of its bounds, which are checked. Equal entries are looked up once.
    """
    entries = searches.select(
        "search_id", _words().alias("_words"), F.coalesce("category", F.lit("")).alias("_place"),
        F.coalesce("state", F.lit("")).alias("_state"), "min_bid", "max_bid")
    asks = written(entries.select(*_ASK).distinct().withColumn("_ask", F.monotonically_increasing_id()), "asks")
    keyed = written(asks.select("_ask", *_ASK, F.explode(_ask_keys()).alias("_key")), "ask-keys")
    kinds = F.when(F.col("_key").startswith("p"), F.substring_index("_key", ":", 1)).otherwise(F.substring("_key", 1, 1))
    used = [r[0] for r in keyed.select(kinds).distinct().collect()]   # 45 kinds at most
    if not used:
        return listings.select(F.lit(None).cast(searches.schema["search_id"].dataType).alias("search_id"), "*").filter("false")
    places = asks.select("_words", "_place", "_state").distinct()
    words = written(asks.select("_words").distinct(), "words")

    columns = listings.columns
    titled = listings.filter(F.col("title").isNotNull()).withColumn("_title", F.lower("title"))
    held = held_words(titled.select("_title").distinct(), words).groupBy("_title").agg(F.sort_array(F.collect_list("_words")).alias("_held"))
    told = titled.join(held, "_title", "left").withColumn("_held", F.coalesce("_held", F.array().cast("array<string>")))
    classes = written(first_rows(told, ["_held", "category", "state", "price"], ["pos"], cap).select("_held", *columns), "classes")

    own = lambda c: F.array_distinct(F.array(F.coalesce(c, F.lit("")), F.lit("")))
    placed = classes.withColumn("_words", F.explode(F.concat("_held", F.array(F.lit("")))))
    placed = placed.withColumn("_place", F.explode(own("category"))).withColumn("_state", F.explode(own("state")))
    placed = placed.join(places, ["_words", "_place", "_state"], "left_semi").drop("_held")
    bin_of = _cents(F.col("price"))
    keys = [F.array(F.lit("a"))] if "a" in used else []
    by_bid = [_part_key(F.lit(int(u[1:])), F.shiftright(bin_of, int(u[1:]))) for u in used if u[0] == "p"]
    by_bid += [F.concat(F.lit(_EDGE), bin_of.cast("string"))] if _EDGE in used else []
    if by_bid:
        keys.append(F.when(F.col("price").isNotNull(), F.array(*by_bid)))
    listed = placed.withColumn("_key", F.explode(F.flatten(F.array_compact(F.array(*keys)))))
    # A bin that holds a bound keeps the first of each price, any other part the first of all.
    apart = F.when(F.col("_key").startswith(_EDGE), F.col("price"))
    lists = first_rows(listed.withColumn("_apart", apart), [*_WHERE, "_apart"], ["pos"], cap).drop("_apart")

    low, high = F.col("k.min_bid"), F.col("k.max_bid")
    fits = (low.isNull() | (F.col("l.price") >= low)) & (high.isNull() | (F.col("l.price") <= high))
    same = [F.col(f"l.{c}") == F.col(f"k.{c}") for c in _WHERE]
    # Stored keys are small only as a compressed file: no broadcast of them.
    met = lists.alias("l").join(keyed.hint("merge").alias("k"), same).filter(fits).select("k._ask", *[F.col(f"l.{c}") for c in columns])
    first = first_rows(met, ["_ask"], ["pos"], cap)
    ids = entries.alias("s").join(asks.hint("merge").alias("k"), [F.col(f"s.{c}").eqNullSafe(F.col(f"k.{c}")) for c in _ASK])
    found = ids.select("s.search_id", "k._ask").join(first.hint("merge"), "_ask").drop("_ask")
    return capped_per_search(found, cap)


def in_state(searches: DataFrame, state: str) -> DataFrame:
    """Entries with the scan's state where they name none."""
    own = F.when(F.col("state") != "", F.col("state"))
    return searches.withColumn("state", F.coalesce(own, F.lit(state)))


def capped_per_search(matches: DataFrame, cap: int) -> DataFrame:
    """First ``cap`` listings of each search entry in scan order."""
    return first_rows(matches, ["search_id"], ["pos"], cap)


def union_of_searches(matches: DataFrame) -> DataFrame:
    """Distinct listing links over all search entries."""
    return matches.select("url").distinct()
