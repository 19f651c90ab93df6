"""Listing hygiene, search, filter and found-item queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from resalelens import settings as S
from resalelens.functions import dates, money, scoring, text, urls
from resalelens.operators import filters, found, search
from resalelens.operators.first import capped, first_per_key, first_per_title
from resalelens.sources.cards import distinct_listings, with_details
from workload.registry import query, words_sql
from workload.standins import (
    FOUND_SQL, LINE_ORDER, LISTING_SQL, LOTS, SEARCH_SQL, VIEW,
    found_items, line_items, order_items, part_listings, searches, table,
)

NORM_SQL = r"trim(regexp_replace(lower(title), '[^\p{L}\p{N}_]+', ' ', 'g'))"
ORDER_SQL = ", ".join(LINE_ORDER)


def _line_listings(spark, d) -> DataFrame:
    """Sales as cards: half of the links carry the auction number, half do not; short titles occur."""
    part = F.col("l_partkey").cast("string")
    keyed = F.col("l_partkey") % 2 == 0
    url = F.when(keyed, F.concat(F.lit(VIEW), part)).otherwise(F.concat(F.lit("https://www.publicsurplus.com/auction/view/"), part))
    title = F.when(F.col("l_linenumber") == 1, "ab").otherwise(F.concat(F.col("l_returnflag"), F.lit(" Lot-"), part))
    return table(spark, d, "lineitem").select(
        urls.listing_key(url).alias("id"), title.alias("title"), url.alias("url"), F.struct(*LINE_ORDER).alias("pos"))


LINE_LISTING_SQL = f"""card AS (
  SELECT CASE WHEN l_partkey % 2 = 0 THEN '{VIEW}' ELSE 'https://www.publicsurplus.com/auction/view/' END || l_partkey AS url,
         CASE WHEN l_linenumber = 1 THEN 'ab' ELSE l_returnflag || ' Lot-' || l_partkey END AS title,
         row_number() OVER (ORDER BY {ORDER_SQL}) AS pos FROM lineitem),
keyed AS (SELECT *, coalesce(nullif(regexp_extract(url, 'auc=(\\d+)', 1), ''), url) AS id FROM card),
firsts AS (SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY id ORDER BY pos) = 1)"""


@query(f"WITH {LINE_LISTING_SQL}\nSELECT id, title, url FROM firsts")
def dedup_by_key(spark, d):
    return first_per_key(_line_listings(spark, d)).select("id", "title", "url")


@query(f"""WITH {LISTING_SQL}
SELECT id, title, {NORM_SQL} AS norm FROM listing QUALIFY row_number() OVER (PARTITION BY norm ORDER BY pos) = 1""")
def dedup_by_title(spark, d):
    return first_per_title(part_listings(spark, d)).select(
        "id", "title", text.norm_title(F.col("title")).alias("norm"))


@query(f"""WITH {LINE_LISTING_SQL},
kept AS (SELECT * FROM firsts WHERE length(title) >= 3 ORDER BY pos LIMIT 50)
SELECT id, title, url FROM kept QUALIFY row_number() OVER (PARTITION BY {NORM_SQL} ORDER BY pos) = 1""")
def capped_then_deduped(spark, d):
    """Key, then title, then the cap of 50, then title dedup."""
    return distinct_listings(_line_listings(spark, d), max_rows=50).select("id", "title", "url")


@query(r"""SELECT doc_id, array_to_string(list_transform(
    regexp_extract_all(lower(text), '(\p{L}+|\P{L}+)', 1), lambda w: replace(upper(w[1]), 'ẞ', 'Ss') || w[2:]), '') AS title
FROM documents""")
def title_case(spark, d):
    return table(spark, d, "documents").select("doc_id", text.title_case(F.col("text")).alias("title"))


def _cards(spark, d) -> DataFrame:
    key, size = F.col("p_partkey").cast("string"), F.col("p_size")
    named = F.concat(F.lit("#"), key, F.lit(" - "), F.upper("p_name"), F.lit(" it's 3d/rotary"))
    lines = F.concat(
        F.lit("\n  "), F.when(size % 4 == 0, F.col("p_name")).otherwise(named), F.lit("  \n\n"),
        F.lit(" $"), F.format_number("p_retailprice", 2), F.lit("\nClosing soon\n"),
        F.when(size % 5 == 0, "Minimum bid $5\n").otherwise(""),
        size.cast("string"), F.lit(" days 4 hours\n"),
        F.when(size % 3 == 0, "AZ\n").otherwise("Arizona\n"),
        F.when(size % 2 == 0, F.concat((size % 7).cast("string"), F.lit(" Bids\n"))).otherwise(""),
        F.lit("one\ntwo\nthree\nfour\n"))
    return table(spark, d, "part").select("p_partkey", F.col("p_name").alias("anchor"), text.card_lines(lines).alias("lines"))


@query(r"""WITH card AS (
  SELECT p_partkey, p_name, p_size,
    CASE WHEN p_size % 4 = 0 THEN p_name ELSE '#' || p_partkey || ' - ' || upper(p_name) || ' it''s 3d/rotary' END AS l1,
    '$' || format('{:,.2f}', p_retailprice) AS l2,
    list_filter([l1, l2, 'Closing soon', CASE WHEN p_size % 5 = 0 THEN 'Minimum bid $5' ELSE '' END,
      p_size || ' days 4 hours', CASE WHEN p_size % 3 = 0 THEN 'AZ' ELSE 'Arizona' END,
      CASE WHEN p_size % 2 = 0 THEN (p_size % 7) || ' Bids' ELSE '' END, 'one', 'two', 'three', 'four'],
      lambda x: x <> '') AS lines FROM part),
parts AS (SELECT *, string_split(p_name, ' ') AS w FROM card)
SELECT p_partkey, array_to_string(lines[1:8], ' | ') AS card_text,
  CASE WHEN p_size % 4 = 0 THEN p_name
       ELSE array_to_string(list_transform(w, lambda x: upper(x[1]) || x[2:]), ' ') || ' It''S 3D/Rotary' END AS title,
  CAST(replace(l2[2:], ',', '') AS DOUBLE) AS price,
  CASE WHEN p_size % 5 = 0 THEN 'Minimum bid $5' ELSE p_size || ' days 4 hours' END AS time_left,
  CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size * 1440 + 240 END AS minutes,
  CASE WHEN p_size % 2 = 0 THEN p_size % 7 END AS bids,
  CASE WHEN p_size % 3 = 0 THEN 'AZ' END AS location
FROM parts""")
def card_fields(spark, d):
    lines = F.col("lines")
    cards = _cards(spark, d).withColumn("card_text", text.card_text(lines, S.CARD_LINES))
    return cards.select(
        "p_partkey", "card_text",
        text.card_title(F.col("card_text"), F.col("anchor")).alias("title"),
        money.price_of(F.array_join(lines, " ")).alias("price"),
        text.time_left(lines).alias("time_left"),
        dates.time_left_minutes(text.time_left(lines)).alias("minutes"),
        text.bid_count(lines).alias("bids"),
        text.state_of(lines).alias("location"))


@query(f"""WITH {LISTING_SQL}, {SEARCH_SQL}
SELECT search_id, id, title, price FROM matched
QUALIFY row_number() OVER (PARTITION BY search_id ORDER BY pos) <= 3""")
def search_match(spark, d):
    matches = search.search_matches(part_listings(spark, d), searches(spark))
    return search.capped_per_search(matches, 3).select("search_id", "id", "title", "price")


@query(f"WITH {LISTING_SQL}, {SEARCH_SQL}\nSELECT DISTINCT url FROM matched")
def union_urls(spark, d):
    return search.union_of_searches(search.search_matches(part_listings(spark, d), searches(spark)))


@query(f"WITH {FOUND_SQL}\nSELECT url, title, bid FROM item ANTI JOIN found USING (url)")
def skip_found(spark, d):
    return found.not_found(order_items(spark, d), found_items(spark, d)).select("url", "title", "bid")


@query(f"WITH {FOUND_SQL}\nSELECT * FROM found UNION ALL SELECT * FROM fresh")
def merge_found(spark, d):
    return found.merged(found_items(spark, d), line_items(spark, d))


@query(f"""WITH {FOUND_SQL}
SELECT (SELECT count(*) FROM fresh) AS added, (SELECT count(*) FROM fresh) + (SELECT count(*) FROM found) AS total""")
def merge_counts(spark, d):
    return found.merge_counts(found_items(spark, d), line_items(spark, d))


@query(f"""WITH {FOUND_SQL}
SELECT url = '' AS missing, count(*) AS n FROM batch GROUP BY ALL""")
def url_missing(spark, d):
    missing = F.coalesce(F.col("url"), F.lit("")) == ""
    return line_items(spark, d).groupBy(missing.alias("missing")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH zips AS (
  SELECT n_nationkey, printf('%05d', 85001 + n_nationkey * 7) AS zip,
         33.45 + n_nationkey * 0.2 AS lat, -112.07 + n_nationkey * 0.15 AS lon FROM nation),
far AS (
  SELECT z.n_nationkey, z.zip, 2 * 3958.7613 * asin(sqrt(
      pow(sin(radians(z.lat - h.lat) / 2), 2)
      + cos(radians(h.lat)) * cos(radians(z.lat)) * pow(sin(radians(z.lon - h.lon) / 2), 2))) AS miles
  FROM zips z, zips h WHERE h.n_nationkey = 0)
SELECT o_orderkey, zip, round(miles, 3) AS miles
FROM orders JOIN customer ON c_custkey = o_custkey JOIN far ON n_nationkey = c_nationkey WHERE miles <= 100""")
def radius(spark, d):
    key = F.col("n_nationkey")
    centroids = table(spark, d, "nation").select(
        F.format_string("%05d", F.lit(85001) + key * 7).alias("zip"),
        (F.lit(33.45) + key * F.lit(0.2)).alias("lat"), (F.lit(-112.07) + key * F.lit(0.15)).alias("lon"))
    place = table(spark, d, "customer").select(
        F.col("c_custkey").alias("o_custkey"),
        F.format_string("%05d", F.lit(85001) + F.col("c_nationkey") * 7).alias("zip"))
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey").join(place, "o_custkey")
    return filters.within_radius(orders, centroids, "85001", 100.0).select(
        "o_orderkey", "zip", F.round("miles", 3).alias("miles"))


def _dated_orders(spark, d) -> DataFrame:
    when, kind = F.col("o_orderdate"), F.col("o_orderkey") % 5
    short = F.when(F.year(when) >= 2000, F.date_format(when, "MM/dd/yy")).otherwise(F.date_format(when, "MM/dd/yyyy"))
    shown = (
        F.when(kind == 0, F.date_format(when, "M/d/yyyy")).when(kind == 1, short)
        .when(kind == 2, "").when(kind == 3, "1/5/123").otherwise(F.date_format(when, "MM/dd/yyyy")))
    return table(spark, d, "orders").select("o_orderkey", shown.alias("end_date"))


@query(r"""WITH dated AS (
  SELECT o_orderkey, CASE o_orderkey % 5
    WHEN 0 THEN strftime(o_orderdate, '%-m/%-d/%Y')
    WHEN 1 THEN CASE WHEN year(o_orderdate) >= 2000 THEN strftime(o_orderdate, '%m/%d/%y') ELSE strftime(o_orderdate, '%m/%d/%Y') END
    WHEN 2 THEN '' WHEN 3 THEN '1/5/123' ELSE strftime(o_orderdate, '%m/%d/%Y') END AS end_date FROM orders),
parsed AS (
  SELECT *, CASE WHEN regexp_matches(end_date, '/\d{4}$') THEN try_strptime(end_date, '%m/%d/%Y')
                 WHEN regexp_matches(end_date, '/\d{2}$') THEN try_strptime(end_date, '%m/%d/%y') END AS ends FROM dated)
SELECT o_orderkey, end_date, CAST(ends AS DATE) AS ends FROM parsed
WHERE ends >= TIMESTAMP '1998-06-01 12:00:00' + INTERVAL 24 HOUR""")
def closing_window(spark, d):
    dated = _dated_orders(spark, d).withColumn("ends", dates.end_date(F.col("end_date")))
    as_of = F.lit("1998-06-01 12:00:00").cast("timestamp")
    return dated.filter(filters.open_long_enough(F.col("ends"), as_of)).select(
        "o_orderkey", "end_date", F.col("ends").cast("date").alias("ends"))


@query("""SELECT o_orderkey, o_orderdate AS close_ts, o_totalprice AS price FROM orders
WHERE o_orderdate >= TIMESTAMP '1998-06-01' AND o_orderdate <= TIMESTAMP '1998-06-01' + INTERVAL 72 HOUR
ORDER BY o_orderdate, o_orderkey LIMIT 50""")
def closing_soon(spark, d):
    """Closing within 72 hours, soonest first, 50 at most."""
    orders = table(spark, d, "orders").select(
        "o_orderkey", F.col("o_orderdate").alias("close_ts"), F.col("o_totalprice").alias("price"))
    as_of = F.lit("1998-06-01").cast("timestamp_ntz")
    return capped(filters.closing_within(orders, as_of), 50, ["close_ts", "o_orderkey"])


KINDS = ["pickup truck", "weighs 250 lbs", "12 lb", "vans", "2 acre land parcel", "vanity", "1,200 pounds", "bus bar holder", "",
         "10 lb bag, pallet weighs 900 lbs", "engine 2 tons", "95 kg", "90 kg"]


@query(rf"""WITH listed AS (
  SELECT p_partkey, p_name || ' ' || {KINDS!r}[p_partkey % {len(KINDS)} + 1] AS text FROM part),
weighed AS (
  SELECT *, list_max(
      list_transform(regexp_extract_all(lower(text), '(\d[\d,]*(?:\.\d+)?)\s*(?:lbs?|pounds?)\b', 1), lambda x: TRY_CAST(replace(x, ',', '') AS DOUBLE))
      || list_transform(regexp_extract_all(lower(text), '(\d[\d,]*(?:\.\d+)?)\s*tons?\b', 1), lambda x: TRY_CAST(replace(x, ',', '') AS DOUBLE) * 2000)
      || list_transform(regexp_extract_all(lower(text), '(\d[\d,]*(?:\.\d+)?)\s*(?:kgs?|kilos?|kilograms?)\b', 1), lambda x: TRY_CAST(replace(x, ',', '') AS DOUBLE) * 2.2046226218)) AS lb
  FROM listed)
SELECT p_partkey, text, lb AS weight_lb,
  regexp_matches(lower(text), '\b(vehicle|truck|sedan|suv|pickup truck|van|bus|motorcycle|trailer|camper|rv|real estate|house|land parcel|acreage)s?\b')
  OR coalesce(lb > 200, false) AS excluded
FROM weighed""")
def excluded_kinds(spark, d):
    kinds = F.array(*[F.lit(k) for k in KINDS])
    kind = F.element_at(kinds, (F.col("p_partkey") % len(KINDS) + 1).cast("int"))
    listed = table(spark, d, "part").select("p_partkey", F.concat("p_name", F.lit(" "), kind).alias("text"))
    return listed.select(
        "p_partkey", "text", scoring.weight_lb(F.col("text")).alias("weight_lb"),
        scoring.excluded_kind(F.col("text")).alias("excluded"))


@query("SELECT o_orderkey, o_totalprice AS bid FROM orders WHERE o_totalprice > 0 AND o_totalprice < 150000")
def max_bid(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("bid"))
    return orders.filter(filters.affordable(F.col("bid"), 150000.0))


@query(f"""WITH {LISTING_SQL}, detail AS (
  SELECT '{VIEW}' || l_partkey AS url,
    CASE l_linenumber % 3 WHEN 0 THEN 'abc' WHEN 1 THEN upper(l_returnflag) || ' full title' ELSE '' END AS title,
    'shipped ' || l_linestatus AS description, CASE WHEN l_quantity > 25 THEN 'Used' ELSE 'New' END AS condition,
    CASE WHEN l_linenumber % 2 = 0 THEN 'Dock ' || l_suppkey ELSE '' END AS location, CAST(l_quantity AS INT) AS photo_count
  FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY {ORDER_SQL}) = 1)
SELECT l.id, CASE WHEN length(d.title) >= 4 THEN d.title ELSE l.title END AS title, d.description, d.condition,
  coalesce(nullif(d.location, ''), l.state) AS pickup_location, d.photo_count
FROM listing l LEFT JOIN detail d USING (url)""")
def detail_enrich(spark, d):
    n = F.col("l_linenumber")
    details = table(spark, d, "lineitem").select(
        F.struct(*LINE_ORDER).alias("page_id"),
        F.concat(F.lit(VIEW), F.col("l_partkey").cast("string")).alias("url"),
        F.when(n % 3 == 0, "abc").when(n % 3 == 1, F.concat(F.upper("l_returnflag"), F.lit(" full title"))).otherwise("").alias("title"),
        F.concat(F.lit("shipped "), F.col("l_linestatus")).alias("description"),
        F.when(F.col("l_quantity") > 25, "Used").otherwise("New").alias("condition"),
        F.when(n % 2 == 0, F.concat(F.lit("Dock "), F.col("l_suppkey").cast("string"))).otherwise("").alias("location"),
        F.col("l_quantity").cast("int").alias("photo_count"))
    listings = part_listings(spark, d).withColumn("location", F.col("state"))
    return with_details(listings, details).select(
        "id", "title", "description", "condition", "pickup_location", "photo_count")


@query(f"""WITH {LISTING_SQL}, total AS (SELECT count(*) AS rows FROM listing)
SELECT field, missing, rows FROM (
  SELECT 'title' AS field, count(*) FILTER (title IS NULL OR title = '') AS missing FROM listing
  UNION ALL SELECT 'state', count(*) FILTER (state IS NULL OR state = '') FROM listing
  UNION ALL SELECT 'price_str', count(*) FILTER (price_str IS NULL OR price_str = '') FROM listing
  UNION ALL SELECT 'price', count(*) FILTER (price IS NULL) FROM listing), total""")
def required_fields(spark, d):
    return filters.missing_fields(part_listings(spark, d), ["title", "state", "price_str", "price"])


@query(f"""WITH {LISTING_SQL}, entry AS (
  SELECT p_partkey AS search_id, CASE WHEN p_size % 5 = 0 THEN '' ELSE upper(substr(p_name, 3, 5)) END AS keywords,
    CASE WHEN p_size % 11 = 0 THEN '' ELSE p_type END AS kind, CASE WHEN p_size % 7 <> 0 THEN p_retailprice * 0.98 END AS low,
    p_retailprice * 1.02 AS high FROM part)
SELECT search_id, id, title, price FROM entry JOIN listing
  ON (kind = '' OR kind = category) AND contains(lower(title), lower(keywords)) AND (low IS NULL OR price >= low) AND price <= high
QUALIFY row_number() OVER (PARTITION BY search_id ORDER BY pos) <= 3""")
def search_entries(spark, d):
    """As many search entries as listings: keywords, categories and bid ranges of all parts."""
    size, price = F.col("p_size"), F.col("p_retailprice")
    entries = table(spark, d, "part").select(
        F.col("p_partkey").alias("search_id"), F.when(size % 5 == 0, "").otherwise(F.upper(F.substring("p_name", 3, 5))).alias("keywords"),
        F.when(size % 11 == 0, "").otherwise(F.col("p_type")).alias("category"), F.lit("").alias("state"),
        F.when(size % 7 != 0, price * 0.98).alias("min_bid"), (price * 1.02).alias("max_bid"))
    return search.first_matches(part_listings(spark, d), entries, 3).select("search_id", "id", "title", "price")
