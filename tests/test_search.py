"""Search entries against every listing, and what the index lets through."""

import random
import re

import pytest
from pyspark.sql import functions as F

from resalelens.operators import search

LISTING = "url STRING, title STRING, category STRING, state STRING, price DOUBLE, pos LONG"
ENTRY = "search_id LONG, keywords STRING, category STRING, state STRING, min_bid DOUBLE, max_bid DOUBLE"
NAN = float("nan")


def lists(rng, n):
    words = ["Saw", "drill", "LATHE", "éclair", "pump", "Straße", "x", "日本語"]
    return [(f"u{i}", rng.choice([None, "", " ".join(rng.choices(words, k=rng.randint(1, 4)))] + [" ".join(rng.choices(words, k=3))] * 8),
             rng.choice(["A", "B", "", None]), rng.choice(["AZ", "TX", None]),
             rng.choice([None, NAN, 0.0, -5.0, 1e14, 2.5] + [rng.uniform(0, 5000)] * 9), i) for i in range(n)]


def asks(rng, n):
    bound = lambda: rng.choice([None, 0.0, -1.0, 1e13, rng.uniform(0, 5000), float(rng.randint(0, 5000))])
    return [(i, rng.choice([None, "", "a", "saw", "LAT", "w d", "p s", "aße", "nothing", "ill pu", "日本", "日本語"]),
             rng.choice(["A", "B", "C", "", None]), rng.choice(["AZ", "", None]), bound(), bound()) for i in range(n)]


def fits(entry, listing):
    _, words, category, state, low, high = entry
    _, title, place, where, price, _ = listing
    if title is None or (words or "").lower() not in title.lower() or category and category != place or state and state != where:
        return False
    order = lambda x: (x != x, x)
    return all(b is None or price is not None and (order(price) >= order(b) if up else order(price) <= order(b)) for b, up in ((low, 1), (high, 0)))


@pytest.mark.parametrize("broadcast", ["-1", "10m"])
def test_matches_equal_all_pairs(spark, broadcast):
    rng = random.Random(6)
    listings, entries = lists(rng, 250), asks(rng, 200)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        got = search.search_matches(spark.createDataFrame(listings, LISTING), spark.createDataFrame(entries, ENTRY))
        pairs = [(r.search_id, r.url) for r in got.collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    want = [(e[0], x[0]) for e in entries for x in listings if fits(e, x)]
    assert sorted(pairs) == sorted(want) and len(want) > 600


def test_range_parts(spark):
    """Parts cover a range once, are aligned, and are few."""
    rng = random.Random(2)
    ranges = [(0.0, 0.0), (3.0, 4.0), (5.0, 4.0), (7.5, None), (None, None), (None, 0.0), (1e30, None)]
    ranges += [tuple(sorted((float(rng.randrange(1 << 10)), float(rng.randrange(1 << 10))))) for _ in range(60)]
    df = spark.createDataFrame(ranges, "low DOUBLE, high DOUBLE").select("low", "high", search.range_parts(F.col("low"), F.col("high")).alias("parts"))
    for r in df.collect():
        low, high = (0 if r.low is None else min(int(r.low), search._TOP)), (search._TOP if r.high is None else min(int(r.high), search._TOP))
        spans = sorted((p.part << p.level, (p.part + 1 << p.level) - 1) for p in r.parts)
        ends = [low - 1, *(b for _, b in spans)]
        assert [a for a, _ in spans] == [e + 1 for e in ends[:-1]] and (ends[-1] == high or low > high and not spans)
        assert len(spans) <= 2 * search.LEVELS


def test_index_lets_little_else_through(spark):
    """Of many entries few meet a listing they do not match."""
    listings = spark.range(3000).select(
        F.concat(F.lit("u"), F.col("id")).alias("url"), F.concat_ws(" ", F.lit("model"), F.hex(F.col("id") * 7919 + 100_000)).alias("title"),
        F.lit("A").alias("category"), F.lit("AZ").alias("state"), (F.col("id") * 1.7).alias("price"), F.col("id").alias("pos"))
    entries = spark.range(4000).select(
        F.col("id").alias("search_id"), F.when(F.col("id") % 2 == 0, F.hex(F.col("id") * 7919 + 100_000)).otherwise("").alias("keywords"),
        F.lit("A").alias("category"), F.lit("").alias("state"),
        F.when(F.col("id") % 2 == 1, F.col("id") * 1.0).alias("min_bid"), F.when(F.col("id") % 2 == 1, F.col("id") * 1.02 + 20).alias("max_bid"))
    met, matched = search.candidates(listings, entries).count(), search.search_matches(listings, entries).count()
    assert 1500 < matched <= met < 3 * matched


def test_empty_sides(spark):
    listings, entries = spark.createDataFrame([], LISTING), spark.createDataFrame([], ENTRY)
    one = spark.createDataFrame([(1, "saw", "", "", None, None)], ENTRY)
    assert search.search_matches(listings, one).collect() == []
    assert search.search_matches(spark.createDataFrame(lists(random.Random(1), 5), LISTING), entries).collect() == []


@pytest.mark.parametrize("cap", [1, 3, 40])
def test_first_matches_equal_first_of_all_pairs(spark, cap):
    """Also with equal listings, equal entries, and prices that share a cent with a bound."""
    rng = random.Random(cap)
    listings, entries = lists(rng, 120), asks(rng, 150)
    near = [10.0, 10.001, 10.004, 10.009, 10.01, 9.999, 11.0]
    listings += [(f"n{i}", "saw pump", "A", "AZ", rng.choice(near), 120 + i) for i in range(60)]
    entries += [(150 + i, rng.choice(["", "saw", "x", "é"]), "A", "", rng.choice(near), rng.choice(near)) for i in range(60)]
    entries += [(500 + e[0], *e[1:]) for e in entries[:40]]
    got = search.first_matches(spark.createDataFrame(listings, LISTING), spark.createDataFrame(entries, ENTRY), cap)
    assert got.columns == ["search_id", "url", "title", "category", "state", "price", "pos"]
    want = [(e[0], x[0]) for e in entries for x in [x for x in listings if fits(e, x)][:cap]]
    assert sorted((r.search_id, r.url) for r in got.collect()) == sorted(want) and len(want) > 60


def test_first_matches_make_no_pairs(spark):
    """What entries read grows with the entries, not with their matches."""
    listings = spark.range(2000).select(
        F.concat(F.lit("u"), F.col("id")).alias("url"), F.lit("old saw").alias("title"), F.lit("A").alias("category"),
        F.lit("AZ").alias("state"), (F.col("id") / 7).alias("price"), F.col("id").alias("pos"))
    entries = spark.range(2000).select(
        F.col("id").alias("search_id"), F.lit("saw").alias("keywords"), F.lit("A").alias("category"), F.lit("").alias("state"),
        (F.col("id") / 20).alias("min_bid"), (F.col("id") / 20 + 100).alias("max_bid"))
    found = search.first_matches(listings, entries, 2)
    assert found.count() == 4000
    plan = str(found._jdf.queryExecution().executedPlan())
    assert "SortMergeJoin" in plan and not re.search(r"BroadcastHashJoin \[_ask|BroadcastNestedLoopJoin|CartesianProduct", plan)


def test_first_matches_of_empty_sides(spark):
    listings, entries = spark.createDataFrame([], LISTING), spark.createDataFrame([], ENTRY)
    one = spark.createDataFrame([(1, "saw", "", "", None, None)], ENTRY)
    assert search.first_matches(listings, one, 2).collect() == []
    assert search.first_matches(spark.createDataFrame(lists(random.Random(1), 5), LISTING), entries, 2).collect() == []
