"""Operators on small tables with known results, and against brute force."""

import random
import statistics
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from resalelens import settings as S
from resalelens.functions import text
from resalelens.operators import comps, filters, found, match, posting, ranking, search
from resalelens.operators import first as first_module
from resalelens.operators.first import first_per_key, first_per_title, first_rows, near_first
from resalelens.operators.storage import fresh_path, is_small, written
from resalelens.plans import deals
from resalelens.sources.cards import distinct_listings, with_details

LISTING = "id STRING, title STRING, url STRING, price DOUBLE, card_text STRING, location STRING, pos LONG"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def listing(pos, title, key=None, price=10.0, card=""):
    key = key or str(pos)
    return (key, title, f"u{key}", price, card, "AZ", pos)


# --- dedup ------------------------------------------------------------------------

def test_key_is_taken_before_title_is_checked(spark):
    df = spark.createDataFrame([listing(1, "ab", "k"), listing(2, "good title", "k"), listing(3, "other")], LISTING)
    assert [r.title for r in distinct_listings(df).collect()] == ["other"]


def test_cap_comes_before_title_dedup(spark):
    df = spark.createDataFrame([listing(1, "Same!"), listing(2, "same"), listing(3, "third")], LISTING)
    assert [r.title for r in distinct_listings(df, 2).collect()] == ["Same!"]
    assert len(distinct_listings(df, None).collect()) == 2


def test_dedup_is_idempotent_and_keeps_the_first(spark):
    random.seed(1)
    data = [listing(i, f"t {random.randint(0, 9)}", str(random.randint(0, 20))) for i in range(200)]
    df = spark.createDataFrame(data, LISTING)
    once = first_per_key(df)
    want = {}
    for r in data:
        want.setdefault(r[0], r)
    assert rows(once) == sorted(want.values(), key=repr)
    assert rows(first_per_key(once)) == rows(once)
    assert rows(first_per_title(first_per_title(df))) == rows(first_per_title(df))


def test_large_group_limit_equals_small(spark, monkeypatch):
    monkeypatch.setattr(first_module, "_PLANNED_LIMIT", 2)
    df = spark.range(1000).select((F.col("id") % 3 == 0).alias("k"), F.col("id").alias("pos"))
    got = first_rows(df, ["k"], ["pos"], 50)
    want = sorted([(True, i) for i in range(0, 1000, 3)][:50] + [(False, i) for i in range(1000) if i % 3][:50])
    assert sorted(map(tuple, got.collect())) == want


def test_group_limit_runs_before_the_shuffle(spark):
    df = spark.range(10).select((F.col("id") % 3).alias("id"), F.col("id").alias("pos"))
    plan = first_per_key(df)._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan =="):]
    assert physical.index("Exchange") < physical.rindex("WindowGroupLimit")


# --- comps ------------------------------------------------------------------------

def comp_rows(n_hot=3000):
    random.seed(7)
    data = [("hot", S.PRIMARY_SOURCE, random.randint(100, 900000) / 100) for _ in range(n_hot)]
    data += [("flat", S.PRIMARY_SOURCE, 12.5)] * 501
    for q, n in (("one", 1), ("two", 2), ("three", 3), ("four", 4)):
        data += [(q, S.SECONDARY_SOURCE, float(10 * i + 1)) for i in range(n)]
    return data


def grouped(data):
    by = defaultdict(list)
    for q, s, p in data:
        by[q, s].append(p)
    return {k: sorted(v) for k, v in by.items()}


def test_comp_stats_against_brute_force(spark):
    data = comp_rows()
    got = {(r["query"], r["source"]): r for r in comps.comp_stats(
        spark.createDataFrame(data, "query STRING, source STRING, price DOUBLE")).collect()}
    want = grouped(data)
    assert set(got) == set(want)
    for key, p in want.items():
        r = got[key]
        assert (r["count"], r["median"], r["low"], r["high"]) == (len(p), p[len(p) // 2], p[0], p[-1])
        assert r["avg"] == pytest.approx(sum(p) / len(p), abs=0.006)
        assert r["median"] in p


def test_comp_stats_with_copies(spark):
    data = comp_rows(200)
    counted = [(*k, n) for k, n in Counter(data).items()]
    plain = comps.comp_stats(spark.createDataFrame(data, "query STRING, source STRING, price DOUBLE"))
    weighted = comps.comp_stats(spark.createDataFrame(counted, "query STRING, source STRING, price DOUBLE, copies LONG"))
    assert rows(plain) == rows(weighted)


@pytest.mark.parametrize("crowded", [0, 60, 10_000])
def test_comp_stats_ranks_short_groups_and_counts_crowded_ones(spark, monkeypatch, crowded):
    """The two ways agree on every group, one without a query included; the counts by band
    are made for crowded buckets only."""
    banded = []
    count = comps.price_counts
    monkeypatch.setattr(comps, "price_counts", lambda df: banded.append(df.count()) or count(df))
    monkeypatch.setattr(comps, "CROWDED", crowded)
    data = comp_rows() + [(None, "ebay_sold", float(n)) for n in range(1, 71)] + [("few", "ebay_sold", 3.0)]
    got = {(r["query"], r["source"]): r for r in comps.comp_stats(
        spark.createDataFrame(data, "query STRING, source STRING, price DOUBLE")).collect()}
    want = grouped(data)
    assert set(got) == set(want)
    for key, p in want.items():
        assert (got[key]["count"], got[key]["median"], got[key]["low"], got[key]["high"]) == (len(p), p[len(p) // 2], p[0], p[-1])
    assert banded == ([sum(len(p) for p in want.values() if len(p) > crowded)] if crowded < 10_000 else [])


def test_price_list_is_whole_and_sorted(spark):
    data = comp_rows(500)
    df = comps.price_list(spark.createDataFrame(data, "query STRING, source STRING, price DOUBLE"))
    got = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r["query"], r["first_rank"])):
        assert r["first_rank"] == len(got[r["query"], r["source"]]) + 1
        got[r["query"], r["source"]] += [r["price"]] * r["copies"]
    assert got == grouped(data)


@pytest.mark.parametrize("lead", ["LONG", "STRING"])
def test_near_first_cuts_long_lists_and_keeps_every_first_row(spark, lead):
    """Long lists with ties and null leads beside a short list, which leaves no highest bound."""
    rng = random.Random(3)
    data = [(key, (rng.choice([None, rng.randrange(400), rng.randrange(400), 7]), n), float(n)) for key in "ab" for n in range(3_000)]
    data = [(k, (v if v is None or lead == "LONG" else f"{v:05d}", n), p) for k, (v, n), p in data if v is not None or n < 9]
    short = [("c", (5 if lead == "LONG" else "5", n), 1.0) for n in range(4)]
    for values in (data, data + short):
        df = spark.createDataFrame(values, f"item STRING, pos STRUCT<lead: {lead}, n: INT>, price DOUBLE")
        near = near_first(df, "item", "pos", 20)
        assert near.columns == df.columns
        assert near.filter("pos.lead IS NULL").count() == df.filter("pos.lead IS NULL").count()
        assert near.count() < 0.5 * len(values)
        assert rows(first_rows(near, ["item"], ["pos"], 20)) == rows(first_rows(df, ["item"], ["pos"], 20))


def test_market_value_uses_first_twenty_in_page_order(spark):
    random.seed(3)
    prices = [("a", i, float(random.randint(2, 500))) for i in range(25)] + [("b", 0, 10.0), ("b", 1, 13.0)]
    random.shuffle(prices)
    items = spark.createDataFrame([("a",), ("b",), ("c",)], "item STRING")
    df = comps.market_value(items, spark.createDataFrame(prices, "item STRING, pos INT, price DOUBLE"))
    got = {r["item"]: r for r in df.collect()}
    first = [p for _, _, p in sorted(x for x in prices if x[0] == "a")[:20]]
    assert got["a"]["median_price"] == round(statistics.median(first), 2)
    assert (got["a"]["sample_size"], got["a"]["price_range"]) == (20, f"${min(first)}–${max(first)}")
    assert (got["b"]["median_price"], got["b"]["price_range"]) == (11.5, "$10.0–$13.0")
    assert tuple(got["c"])[1:] == (0.0, "unknown", 0, "ebay_completed", "No sold listings found")


@pytest.mark.parametrize("n1, n2, want", [
    (0, 0, None), (0, 1, "b"), (1, 1, "a"), (2, 3, "b"), (2, 2, "a"), (3, 9, "a"), (1, 0, "a"),
])
def test_fallback_source(spark, n1, n2, want):
    data = [("q6", S.PRIMARY_SOURCE, 5.0)] * n1 + [("q5", S.SECONDARY_SOURCE, 7.0)] * n2
    stats = comps.comp_stats(spark.createDataFrame(data, "query STRING, source STRING, price DOUBLE"))
    ask = spark.createDataFrame([("x", "q6", "q5")], "id STRING, query STRING, query2 STRING")
    r = comps.with_comps(ask, stats).first()
    source = {"a": S.PRIMARY_SOURCE, "b": S.SECONDARY_SOURCE}.get(want)
    assert (r["comps"]["source"] if r["comps"] else None) == source


# --- term match ---------------------------------------------------------------------

@pytest.mark.parametrize("per_salt", [200_000, 3])
def test_term_match_against_brute_force(spark, monkeypatch, per_salt):
    monkeypatch.setattr(match, "ROWS_PER_SALT", per_salt)
    random.seed(5)
    vocab = ["the"] * 30 + [f"w{i:02d}x" for i in range(25)]
    titles = [(i, " ".join(random.choices(vocab, k=random.randint(1, 12)))) for i in range(150)]
    titles += [(1000 + i, "the same copy w01x") for i in range(80)] + [(2000, ""), (2001, None)]
    asks = [(i, " ".join(random.choices(vocab, k=random.randint(1, 3)))) for i in range(40)]
    asks += [(100, "the"), (101, "the the"), (102, "nowhere the"), (103, ""), (104, "the same")]
    as_sets = lambda data, key: spark.createDataFrame(data, f"{key} INT, t STRING").select(
        key, text.term_set(F.col("t")).alias("terms"))
    got = match.term_match(as_sets(asks, "query_id"), as_sets(titles, "title_id"))
    words = lambda t: {w for w in (t or "").split() if len(w) > 2}
    want = sorted((q, t) for q, a in asks for t, b in titles if words(a) and words(a) <= words(b))
    assert sorted(map(tuple, got.collect())) == want


def test_matched_prices_count_copies(spark):
    ask = spark.createDataFrame([("red drill", ["drill", "red"])], "query STRING, terms ARRAY<STRING>")
    sold = spark.createDataFrame(
        [(["drill", "red"], "p", 5.0)] * 3 + [(["big", "drill", "red"], "p", 5.0), (["drill"], "p", 9.0)],
        "terms ARRAY<STRING>, source STRING, price DOUBLE")
    got = match.matched_prices(ask, sold).groupBy("query", "source", "price").agg(F.sum("copies"))
    assert rows(got) == [("red drill", "p", 5.0, 4)]


# --- searches -----------------------------------------------------------------------

def searched(spark):
    listings = spark.createDataFrame(
        [("u1", "Old Laptop", "E", "AZ", 100.0, 1), ("u2", "laptop bag", "E", "TX", 20.0, 2),
         ("u3", "Desk", "F", "AZ", 50.0, 3), ("u4", "gaming LAPTOP", "E", "AZ", 400.0, 4)],
        "url STRING, title STRING, category STRING, state STRING, price DOUBLE, pos INT")
    entries = spark.createDataFrame(
        [(0, "laptop", "E", "", None, None), (1, "laptop", "E", "AZ", 0.0, 300.0), (2, "", "F", "", None, None),
         (3, "laptop", "F", "", None, None)],
        "search_id INT, keywords STRING, category STRING, state STRING, min_bid DOUBLE, max_bid DOUBLE")
    return listings, entries


def test_search_matches(spark, monkeypatch):
    listings, entries = searched(spark)
    want = [(0, "u1"), (0, "u2"), (0, "u4"), (1, "u1"), (2, "u3")]
    pairs = lambda df: rows(df.select("search_id", "url"))
    matches = search.search_matches(listings, entries)
    assert pairs(matches) == want
    assert pairs(search.capped_per_search(matches, 2)) == [(0, "u1"), (0, "u2"), (1, "u1"), (2, "u3")]
    assert rows(search.union_of_searches(matches)) == [("u1",), ("u2",), ("u3",), ("u4",)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert pairs(search.search_matches(listings, entries)) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_search_without_category_takes_all(spark):
    listings, _ = searched(spark)
    schema = "search_id INT, category STRING, keywords STRING, state STRING, min_bid DOUBLE, max_bid DOUBLE"
    entries = spark.createDataFrame([(0, "", "", "", None, None), (1, None, None, None, None, None), (2, "no such", "", "", None, None)], schema)
    n = listings.count()
    found = search.search_matches(listings, entries)
    assert found.columns == ["search_id", *listings.columns]
    assert found.filter("search_id = 0").count() == found.filter("search_id = 1").count() == n == found.count() / 2
    assert [r.state for r in search.in_state(entries, "AZ").orderBy("search_id").collect()] == ["AZ"] * 3


def test_radius(spark):
    zips = spark.createDataFrame(
        [("85001", 33.45, -112.07), ("85001", 99.0, 0.0), ("85701", 32.22, -110.97), ("90001", 33.97, -118.25), ("x", 33.4, -112.0)],
        "zip STRING, lat DOUBLE, lon DOUBLE")
    df = spark.createDataFrame([(1, "85001-1234"), (2, "85701"), (3, "90001"), (4, "x"), (5, None)], "id INT, zip STRING")
    near = lambda miles, home="85001": [r.id for r in filters.within_radius(df, zips, home, miles).orderBy("id").collect()]
    assert near(100) == [1]
    assert near(120) == [1, 2]
    assert near(500) == [1, 2, 3]
    assert sorted(r.id for r in filters.unplaced(df, zips).collect()) == [4, 5]
    with pytest.raises(ValueError):
        near(500, "00000")


def test_not_too_far(spark):
    zips = spark.createDataFrame([("85001", 33.45, -112.07), ("90001", 33.97, -118.25)], "zip STRING, lat DOUBLE, lon DOUBLE")
    places = ["Phoenix, AZ 85001-1234", "90001 Main St, Phoenix 85001", "Los Angeles 90001", "Tempe", "code 00000", None]
    df = spark.createDataFrame(list(enumerate(places)), "id INT, location STRING")
    kept = filters.not_too_far(df, zips, "85001", 100.0)
    assert sorted(r.id for r in kept.collect()) == [0, 1, 3, 4, 5] and kept.columns == df.columns
    with pytest.raises(ValueError):
        filters.not_too_far(df, zips, "11111", 100.0)


def test_open_long_enough_edges(spark):
    df = spark.sql("""SELECT * FROM VALUES (1, TIMESTAMP'2026-01-02 00:00:00'), (2, TIMESTAMP'2026-01-01 23:59:59'), (3, NULL)
                      AS t(id, ends)""")
    keep = df.filter(filters.open_long_enough(F.col("ends"), F.lit("2026-01-01").cast("timestamp")))
    assert [r.id for r in keep.collect()] == [1]


def test_missing_fields(spark):
    df = spark.createDataFrame([("a", None), ("", None), ("b", 1)], "x STRING, y INT")
    assert rows(filters.missing_fields(df, ["x", "y"])) == [("x", 1, 3), ("y", 2, 3)]


# --- found items ----------------------------------------------------------------------

def test_merge(spark):
    old = spark.createDataFrame([("u1", "old")], "url STRING, title STRING")
    batch = spark.createDataFrame(
        [("u1", "new", 1), ("u2", "second", 3), ("u2", "first", 2), ("", "blank", 4), (None, "null", 5)],
        "url STRING, title STRING, pos INT")
    assert rows(found.merged(old, batch)) == [("u1", "old"), ("u2", "first")]
    assert tuple(found.merge_counts(old, batch).first()) == (1, 2)
    empty = batch.filter("false")
    assert tuple(found.merge_counts(old, empty).first()) == (0, 1)


# --- deals ----------------------------------------------------------------------------

def deal_inputs(spark):
    data = [
        ("1", "free", 0.0, "", 1), ("2", "good", 100.0, "", 2), ("3", "as is good", 100.0, "Sold As Is", 3),
        ("4", "no comps", 100.0, "", 4), ("5", "thin", 100.0, "", 5), ("6", "tie", 100.0, "", 6)]
    df = spark.createDataFrame(data, "id STRING, title STRING, price DOUBLE, card_text STRING, pos INT")
    prices = {"good": [300.0] * 5, "as is good": [300.0] * 3, "thin": [199.0] * 9, "tie": [300.004] * 2}
    comp = spark.createDataFrame(
        [(q, S.PRIMARY_SOURCE, p) for q, ps in prices.items() for p in ps], "query STRING, source STRING, price DOUBLE")
    asked = df.withColumn("query", F.col("title")).withColumn("query2", F.col("title"))
    return asked, comps.comp_stats(comp)


def test_find_deals(spark):
    asked, stats = deal_inputs(spark)
    got = {r["id"]: r for r in deals.find_deals(asked, stats).collect()}
    assert set(got) == {"2", "3", "6"}
    assert (got["2"]["profit_ratio"], got["2"]["est_profit"], got["2"]["confidence"]) == (3.0, 200.0, "HIGH")
    assert (got["3"]["resale_estimate"], got["3"]["confidence"]) == (210.0, "MED")
    assert got["3"]["risk_flags"] == [S.RISK_LABEL] and got["2"]["risk_flags"] == []
    assert "query" not in deals.find_deals(asked, stats).columns


def test_thresholds_test_unrounded_values(spark):
    asked, stats = deal_inputs(spark)
    barely = deals.find_deals(asked, stats, min_ratio=2.1000001, min_profit=0)
    assert "3" not in [r["id"] for r in barely.collect()]   # rounds to 2.1, is below


def test_rank_is_stable_on_rounded_ratio(spark):
    asked, stats = deal_inputs(spark)
    got = deals.ranked_deals(asked, stats)
    assert [(r["deal_number"], r["id"]) for r in got.orderBy("deal_number").collect()] == [(1, "2"), (2, "6"), (3, "3")]
    assert ranking.top_deals(deals.find_deals(asked, stats)).first()["id"] == "2"


def test_funnel_adds_up(spark):
    asked, stats = deal_inputs(spark)
    got = dict(map(tuple, deals.funnel(asked, asked, stats).collect()))
    assert got == {"found": 6, "unique": 6, "no_price": 1, "no_comps": 1, "below_threshold": 1, "deal": 3}


def test_details_win_and_fall_back(spark):
    base = spark.createDataFrame([listing(1, "Card one"), listing(2, "Card two"), listing(3, "Card three")], LISTING)
    detail = spark.createDataFrame(
        [(2, "u1", "Full title", "works", "used", "Dock 4", 3), (1, "u2", "abc", "untested", "", "", 0), (9, "u2", "Later title", "x", "x", "x", 9)],
        "page_id INT, url STRING, title STRING, description STRING, condition STRING, location STRING, photo_count INT")
    got = {r["id"]: r for r in with_details(base, detail).collect()}
    assert (got["1"]["title"], got["1"]["pickup_location"]) == ("Full title", "Dock 4")
    assert (got["2"]["title"], got["2"]["description"], got["2"]["pickup_location"]) == ("Card two", "untested", "AZ")
    assert (got["3"]["title"], got["3"]["description"]) == ("Card three", None)


def test_numbered_over_many_partitions(spark):
    df = spark.range(0, 5000, 1, 7).select(
        F.when(F.col("id") % 3 == 0, 2.0).otherwise((F.col("id") % 50).cast("double")).alias("profit_ratio"), F.col("id").alias("pos"))
    got = ranking.numbered(df, ranking.best_first()).orderBy("deal_number").collect()
    want = sorted(((2.0 if i % 3 == 0 else float(i % 50)), i) for i in range(5000))
    want.sort(key=lambda r: (-r[0], r[1]))
    assert [tuple(r) for r in got] == [(n + 1, *r) for n, r in enumerate(want)]
    assert ranking.numbered(df.filter("false"), ranking.best_first()).count() == 0


# --- posting --------------------------------------------------------------------------

def test_selection(spark):
    df = spark.range(1, 6).withColumnRenamed("id", "n")
    pick = lambda choice: [r.n for r in posting.selected(df, choice).orderBy("n").collect()]
    assert pick("all") == [1, 2, 3, 4, 5]
    assert pick(" 1, 3,5 ") == [1, 3, 5]
    assert pick("none") == pick("") == []
    chosen = spark.createDataFrame([(2,), (2,), (9,)], "n LONG")
    assert [r.n for r in posting.selected_by(df, chosen).collect()] == [2]


def test_daily_cap_counts_successes(spark):
    oks = {"2026-01-01": [True, False, True, True, False], "2026-01-02": [False, False], "2026-01-03": [True]}
    data = [(d, n, "t", ok, None if ok else "why") for d, l in oks.items() for n, ok in enumerate(l)]
    df = spark.createDataFrame(data, "posted_on STRING, n INT, title STRING, ok BOOLEAN, reason STRING")
    made = posting.within_daily_cap(df, 2)
    assert rows(made.groupBy("posted_on").count()) == [("2026-01-01", 3), ("2026-01-02", 2), ("2026-01-03", 1)]
    report = {r["posted_on"]: r["summary"] for r in posting.outcome_report(made).collect()}
    assert report["2026-01-01"] == "Posted 2 / 3 items successfully. Failed: 1"
    assert posting.failures(made).count() == 3


def test_export_rows(spark):
    df = spark.createDataFrame(
        [(1, "t" * 120, None, 250.75, "c", "", "d", ["p"]), (2, "x", 99.0, 250.0, "c", "New", "d", [])],
        "n INT, title STRING, list_price DOUBLE, market_value DOUBLE, category STRING, condition STRING, description STRING, photos ARRAY<STRING>")
    a, b = posting.export_rows(df, "Phoenix, AZ", S.MAX_EXPORT_TITLE).orderBy("n").collect()
    assert (len(a["title"]), a["price"], a["condition"], a["location"]) == (100, "250", "Used - Good", "Phoenix, AZ")
    assert (b["price"], b["condition"]) == ("99", "New")


# --- storage --------------------------------------------------------------------------

def test_written_tables(spark):
    df = spark.range(5)
    again = written(df, "t")
    assert rows(again) == rows(df) and again.dtypes == df.dtypes
    assert is_small(df, 5) and not is_small(df, 4)
    assert fresh_path(spark, "a").startswith(spark.conf.get("spark.checkpoint.dir"))
