"""Configured scan, item logs, posting and streaming queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from resalelens import settings as S
from resalelens.functions import money
from resalelens.operators import filters, posting
from resalelens.operators.first import first_per_key
from resalelens.operators.storage import fresh_path
from resalelens.plans import post, report, scan
from resalelens.sources import cards, config, found, logs, records
from resalelens.streaming import incremental
from workload.deal_queries import RANK_SQL, numbered_part_deals
from workload.page_queries import AUCTION_SQL, auction_pages, index_pages
from workload.registry import cents_sql, query
from workload.standins import (
    FOUND_SQL, LINE_ORDER, PART_DEALS_SQL, UNIT_SQL, found_items, line_items, order_items, spread, table,
    table_stream, unit_price,
)

AS_OF = "2026-03-01 00:00:00"

SCAN_SQL = f"""{AUCTION_SQL},
checked AS (
  SELECT *, try_strptime(end_date, '%m/%d/%Y') AS ends_at FROM record
  WHERE error IS NULL AND current_bid > 0 AND current_bid < 1500
    AND ends_at >= TIMESTAMP '{AS_OF}' + INTERVAL 24 HOUR),
price AS (
  SELECT p_name AS item, {UNIT_SQL} AS price, {", ".join(LINE_ORDER)} FROM lineitem JOIN part ON p_partkey = l_partkey),
kept AS (
  SELECT item, price FROM price WHERE price > 1 AND price < 100000
  QUALIFY row_number() OVER (PARTITION BY item ORDER BY {", ".join(LINE_ORDER)}) <= 20),
agg AS (SELECT item, list_sort(list(price)) AS p, count(*) AS n FROM kept GROUP BY item),
worth AS (SELECT item, {cents_sql("(p[(n + 1) // 2] + p[n // 2 + 1]) / 2")} AS market_value FROM agg),
item AS (
  SELECT title, lot, site, url, current_bid AS bid, market_value, {cents_sql("market_value - current_bid")} AS profit,
         location AS pickup, strftime(ends_at, '%Y-%m-%d') AS ends, photos
  FROM checked JOIN worth ON item = title WHERE market_value > 0 AND market_value - current_bid >= 100)"""


def kept_items(spark, d) -> DataFrame:
    """Records of pages, market values of their titles, thresholds."""
    names = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("item"))
    sold = table(spark, d, "lineitem").select("l_partkey", F.struct(*LINE_ORDER).alias("pos"), unit_price().alias("price"))
    prices = sold.filter(money.between_exclusive(F.col("price"), (1.0, 100000.0))).join(names, "l_partkey")
    found_records = records.extract_records(auction_pages(spark, d), **S.RECORD_LIMITS)
    return scan.scan(found_records, prices, F.lit(AS_OF).cast("timestamp"))


@query(f"WITH {SCAN_SQL}\nSELECT * FROM item")
def scan_items(spark, d):
    return scan.items_out(kept_items(spark, d)).withColumn("photos", F.array_join("photos", " "))


PLACE_SQL = """place AS (
  SELECT n_nationkey, printf('%05d', 85001 + n_nationkey * 7) AS zip,
         33.45 + n_nationkey * 0.2 AS lat, -112.07 + n_nationkey * 0.15 AS lon FROM nation),
far AS (
  SELECT z.zip, 2 * 3958.7613 * asin(sqrt(
      pow(sin(radians(z.lat - h.lat) / 2), 2)
      + cos(radians(h.lat)) * cos(radians(z.lat)) * pow(sin(radians(z.lon - h.lon) / 2), 2))) AS miles
  FROM place z, place h WHERE h.n_nationkey = 0)"""


def _centroids(spark, d) -> DataFrame:
    key = F.col("n_nationkey")
    return table(spark, d, "nation").select(
        F.format_string("%05d", F.lit(85001) + key * 7).alias("zip"),
        (F.lit(33.45) + key * F.lit(0.2)).alias("lat"), (F.lit(-112.07) + key * F.lit(0.15)).alias("lon"))


@query(f"""WITH {PLACE_SQL}
SELECT o_orderkey AS pos, o_orderdate AS close_ts, zip, round(miles, 3) AS miles
FROM orders JOIN customer ON c_custkey = o_custkey JOIN far ON zip = printf('%05d', 85001 + c_nationkey * 7)
WHERE o_orderdate >= TIMESTAMP '1998-06-01' AND o_orderdate <= TIMESTAMP '1998-06-01' + INTERVAL 72 HOUR AND miles <= 100
ORDER BY o_orderdate, o_orderkey LIMIT 50""")
def closing_nearby(spark, d):
    """Closing within 72 hours and 100 miles, soonest first, 50 at most."""
    code = F.format_string("%05d", F.lit(85001) + F.col("c_nationkey") * 7)
    places = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), code.alias("zip"))
    listings = table(spark, d, "orders").join(places, "o_custkey").select(
        F.col("o_orderkey").alias("pos"), F.col("o_orderdate").alias("close_ts"), "zip")
    found = scan.closing_nearby(listings, _centroids(spark, d), F.lit("1998-06-01").cast("timestamp_ntz"), max_rows=50)
    return found.select("pos", "close_ts", "zip", F.round("miles", 3).alias("miles"))


@query(f"""WITH {PLACE_SQL}, sited AS (
  SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'Yard ' || c_custkey || ', AZ ' || printf('%05d', 85001 + c_nationkey * 7)
    WHEN 1 THEN 'AZ ' || printf('%05d', 85001 + c_nationkey * 7) || '-1234' WHEN 2 THEN 'Tempe' ELSE 'code 00001' END AS location,
    CASE WHEN o_orderkey % 4 < 2 THEN printf('%05d', 85001 + c_nationkey * 7) END AS zip
  FROM orders JOIN customer ON c_custkey = o_custkey)
SELECT o_orderkey, location FROM sited LEFT JOIN far USING (zip) WHERE miles IS NULL OR miles <= 100""")
def near_home(spark, d):
    """Records whose location does not name a place too far away."""
    kind, code = F.col("o_orderkey") % 4, F.format_string("%05d", F.lit(85001) + F.col("c_nationkey") * 7)
    sited = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).select(
        "o_orderkey",
        F.when(kind == 0, F.concat(F.lit("Yard "), F.col("c_custkey").cast("string"), F.lit(", AZ "), code))
        .when(kind == 1, F.concat(F.lit("AZ "), code, F.lit("-1234")))
        .when(kind == 2, "Tempe").otherwise("code 00001").alias("location"))
    return filters.not_too_far(sited, _centroids(spark, d), "85001", 100.0)


@query(f"""WITH {SCAN_SQL}
SELECT url, 'ITEM: ' || title || ' | LOT: ' || lot || ' | SITE: ' || site || ' | URL: ' || url || chr(10)
  || 'BID: $' || format('{{:,.0f}}', bid) || ' | MARKET VALUE: $' || format('{{:,.0f}}', market_value)
  || ' | EST. PROFIT: $' || format('{{:,.0f}}', profit) || ' | ENDS: ' || ends || chr(10)
  || 'PICKUP: ' || pickup || chr(10) || 'PHOTOS: ' || photos AS block FROM item""")
def item_blocks(spark, d):
    return report.item_block(kept_items(spark, d))


@query(f"""WITH {FOUND_SQL}, matched AS (
  SELECT title AS search, url, pos FROM item
  WHERE (title IN ('1-URGENT', '2-HIGH') AND bid BETWEEN 1000 AND 200000) OR (title = '5-LOW' AND bid <= 90000)),
first AS (SELECT * FROM matched QUALIFY row_number() OVER (PARTITION BY search ORDER BY pos) <= 25)
SELECT url FROM first ANTI JOIN found USING (url)""")
def links_to_fetch(spark, d):
    """Search entries over orders, 25 links an entry, found items removed."""
    searches = spark.createDataFrame(
        [(0, "urgent", "1-URGENT", "", 1000.0, 200000.0), (1, "", "2-HIGH", "", 1000.0, 200000.0),
         (2, "low", "5-LOW", "", None, 90000.0)],
        "search_id INT, keywords STRING, category STRING, state STRING, min_bid DOUBLE, max_bid DOUBLE")
    listings = order_items(spark, d).select(
        "url", "title", F.col("bid").alias("price"), F.col("title").alias("category"), F.lit("AZ").alias("state"), "pos")
    return scan.links_to_fetch(listings, searches, found_items(spark, d), cap=25)


def _run_logs(spark, d) -> DataFrame:
    """Run texts with a fenced object, a fenced list, a broken block, or none."""
    key, kind = F.col("event_id").cast("string"), F.col("event_id") % 4
    item = F.concat(
        F.lit('{"title": "'), F.col("event_type"), F.lit(' item", "lot": "'), key, F.lit('", "url": "https://e.example/'), key,
        F.lit('", "bid": '), F.col("value").cast("string"), F.lit(', "photos": ["a", "b"], "extra": '), F.col("props"), F.lit("}"))
    text = (
        F.when(kind == 0, F.concat(F.lit('Done.\n```json\n{"items": ['), item, F.lit(", "), item, F.lit(']}\n```\nand\n```json\n{"items": []}\n```')))
        .when(kind == 1, F.concat(F.lit("Kept:\n```json\n["), item, F.lit("]\n```")))
        .when(kind == 2, F.concat(F.lit('```json\n{"items": ['), item, F.lit(", ]}\n```")))
        .otherwise("nothing kept"))
    events = spread(spark, d, "events", "event_id", "event_type", "value", "props")
    return events.select(F.col("event_id").alias("run_id"), text.alias("text"))


@query("""WITH hit AS (
  SELECT event_id AS run_id, unnest(generate_series(0, CASE event_id % 4 WHEN 0 THEN 1 ELSE 0 END)) AS pos, * FROM events WHERE event_id % 4 < 2)
SELECT run_id, CAST(pos AS INT) AS pos, event_type || ' item' AS title, CAST(event_id AS VARCHAR) AS lot,
  'https://e.example/' || event_id AS url, value AS bid, 'a b' AS photos FROM hit""")
def items_json(spark, d):
    return logs.extract_items(_run_logs(spark, d)).select(
        "run_id", "pos", "title", "lot", "url", "bid", F.array_join("photos", " ").alias("photos"))


def _block_logs(spark, d) -> DataFrame:
    """Run texts with a good block of a good and a mistyped item and an entry that is no
    object, then a block that is broken or has no items, by the event's number."""
    key = F.col("event_id").cast("string")
    fence = lambda body: F.concat(F.lit("Kept:\n```json\n"), body, F.lit("\n```\n"))
    good = F.concat(
        F.lit('{"items": [{"title": "'), F.col("event_type"), F.lit('", "lot": "'), key, F.lit('", "bid": '), F.col("value").cast("string"),
        F.lit(', "seen": {"by": "'), key, F.lit('"}}, {"title": "t", "bid": "much"}, '), key, F.lit("]}"))
    other = F.when(F.col("event_id") % 2 == 0, F.lit('[{"title": ]')).otherwise(F.lit('{"other": 1}'))
    events = spread(spark, d, "events", "event_id", "event_type", "value")
    return events.select(F.col("event_id").alias("run_id"), F.concat(fence(good), fence(other)).alias("text"))


@query("""SELECT event_id AS run_id, 0 AS block, 0 AS pos, NULL AS error, event_type AS title, CAST(event_id AS VARCHAR) AS lot, value AS bid,
  '' AS mistyped, CAST(event_id AS VARCHAR) AS seen_by FROM events
UNION ALL SELECT event_id, 0, 1, NULL, 't', NULL, NULL, 'bid', NULL FROM events
UNION ALL SELECT event_id, 0, 2, 'not an object', NULL, NULL, NULL, NULL, NULL FROM events
UNION ALL SELECT event_id, 1, 0, CASE WHEN event_id % 2 = 0 THEN 'not json' ELSE 'no list' END, NULL, NULL, NULL, NULL, NULL FROM events""")
def items_all_blocks(spark, d):
    return logs.all_items(_block_logs(spark, d)).select(
        "run_id", "block", "pos", "error", "title", "lot", "bid", F.array_join("mistyped", " ").alias("mistyped"),
        F.try_variant_get("item", "$.seen.by", "string").alias("seen_by"))


@query("""SELECT n, title, price, category, condition, description, location, photos FROM (
  SELECT p_partkey + 1 AS n, left(repeat(p_name || ' ', 12), 100) AS title, CAST(CAST(floor(p_retailprice) AS BIGINT) AS VARCHAR) AS price,
    p_type AS category, CASE WHEN p_size % 2 = 0 THEN 'New' ELSE 'Used - Good' END AS condition, p_brand AS description,
    'Phoenix, AZ' AS location, 'p1 p2' AS photos FROM part)
WHERE n IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""")
def export_rows(spark, d):
    items = table(spark, d, "part").select(
        (F.col("p_partkey") + 1).alias("n"), F.repeat(F.concat("p_name", F.lit(" ")), 12).alias("title"),
        F.lit(None).cast("double").alias("list_price"), F.col("p_retailprice").alias("market_value"),
        F.col("p_type").alias("category"), F.when(F.col("p_size") % 2 == 0, "New").otherwise("").alias("condition"),
        F.col("p_brand").alias("description"), F.lit("p1 p2").alias("photos"))
    chosen = table(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("n"))
    return posting.export_rows(posting.selected_by(items, chosen), "Phoenix, AZ", S.MAX_EXPORT_TITLE)


CAP = 3


def _attempts(spark, d) -> DataFrame:
    return table(spark, d, "orders").select(
        F.col("o_orderdate").cast("date").alias("posted_on"), F.col("o_orderkey").alias("n"),
        F.col("o_orderpriority").alias("title"), (F.col("o_orderstatus") != "F").alias("ok"),
        F.when(F.col("o_orderstatus") == "F", "form error").alias("reason"))


ATTEMPT_SQL = f"""attempt AS (
  SELECT CAST(o_orderdate AS DATE) AS posted_on, o_orderkey AS n, o_orderpriority AS title, o_orderstatus <> 'F' AS ok FROM orders),
counted AS (
  SELECT *, coalesce(sum(ok::INT) OVER (PARTITION BY posted_on ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM attempt),
made AS (SELECT * FROM counted WHERE before < {CAP})"""


@query(f"WITH {ATTEMPT_SQL}\nSELECT posted_on, n, title, ok FROM made")
def daily_cap(spark, d):
    return posting.within_daily_cap(_attempts(spark, d), CAP).select("posted_on", "n", "title", "ok")


@query(f"""WITH {ATTEMPT_SQL}
SELECT posted_on, count(*) FILTER (ok) AS posted, count(*) AS attempted, count(*) FILTER (NOT ok) AS failed,
  'Posted ' || count(*) FILTER (ok) || ' / ' || count(*) || ' items successfully. Failed: ' || count(*) FILTER (NOT ok) AS summary
FROM made GROUP BY posted_on""")
def outcome_report(spark, d):
    return post.posted(_attempts(spark, d), CAP)


@query(f"WITH {ATTEMPT_SQL}\nSELECT posted_on, n, title, 'form error' AS reason FROM made WHERE NOT ok")
def post_failures(spark, d):
    return posting.failures(posting.within_daily_cap(_attempts(spark, d), CAP))


# --- streams ------------------------------------------------------------------------

@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark, d):
    """New (user, type) keys of the event stream; the watermark spans the data."""
    out = fresh_path(spark, "stream-dedup")
    keys = incremental.new_keys(table_stream(spark, d, "events"), ["user_id", "event_type"], "ts", "400 days")
    incremental.append_to(keys.select("user_id", "event_type"), f"{out}/rows", f"{out}/state").awaitTermination()
    return spark.read.parquet(f"{out}/rows")


@query("""SELECT 'https://e.example/' || user_id AS url, event_type AS title, value AS bid, event_id AS pos FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1""")
def stream_merge(spark, d):
    """Found items kept up from the event stream: first item per link."""
    out = fresh_path(spark, "stream-merge")
    items = table_stream(spark, d, "events").select(
        F.concat(F.lit("https://e.example/"), F.col("user_id").cast("string")).alias("url"),
        F.col("event_type").alias("title"), F.col("value").alias("bid"), F.col("event_id").alias("pos"))
    incremental.keep_found(items, f"{out}/found", f"{out}/state").awaitTermination()
    return incremental.read_batches(spark, f"{out}/found", items.schema)


@query("""SELECT page_id, CASE WHEN contains(url, '.example.com') THEN 'com' WHEN contains(url, '.example.org') THEN 'org' END AS site,
  trim(replace(regexp_replace(regexp_extract(html, '<h1>(.*?)</h1>', 1, 's'), '&amp;?', '&', 'g'), '&quot;', '"')) AS title
FROM pages WHERE contains(url, '.example.com') OR contains(url, '.example.org')""")
def stream_records(spark, d):
    """Records of newly captured pages, appended exactly once. A page without a heading has an
    empty title, a link without a page has none."""
    from workload.page_queries import PAGE_RULES
    out = fresh_path(spark, "stream-records")
    # Whether there is a page goes along with its number, so that pages are read once.
    key = F.struct("page_id", F.col("html").isNull().alias("unread")).alias("page_id")
    captured = table_stream(spark, d, "pages").select(key, "url", "html")
    read = records.with_sentinels(records.accepted(records.extract_records(captured, PAGE_RULES)))
    found_records = read.select(
        "page_id.page_id", "site", F.when(F.col("page_id.unread"), None).otherwise(F.col("title")).alias("title"))
    incremental.append_to(found_records, f"{out}/rows", f"{out}/state").awaitTermination()
    return spark.read.schema(found_records.schema).parquet(f"{out}/rows")


# --- configuration, found items and result files ---------------------------------------

@query("""SELECT n_nationkey AS search_id, lower(n_name) AS keywords, 'R' || n_regionkey AS category,
  CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE substr(n_name, 1, 2) END AS state,
  n_nationkey * 10.0 AS min_bid, CASE WHEN n_nationkey % 4 <> 0 THEN n_nationkey * 25.5 END AS max_bid,
  900.0 AS price_limit, 100.0 AS min_profit FROM nation""")
def search_config(spark, d):
    """A config file written from a table and read again; absent parameters take defaults."""
    key = F.col("n_nationkey")
    entry = F.struct(
        key, F.lower("n_name").alias("keywords"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("category"),
        F.when(key % 3 != 0, F.substring("n_name", 1, 2)).alias("state"), (key * F.lit(10.0)).alias("min_bid"),
        F.when(key % 4 != 0, key * F.lit(25.5)).alias("max_bid"))
    document = F.to_json(F.struct(F.lit(900.0).alias("max_bid"), F.sort_array(F.collect_list(entry)).alias("searches")), {"pretty": "true"})
    path = fresh_path(spark, "config")
    table(spark, d, "nation").agg(document.alias("value")).write.text(path, lineSep=" ")
    read = config.read_config(spark, path)
    limits = read.select(F.col("max_bid").alias("price_limit"), "min_profit")
    return config.searches_of(read.withColumnsRenamed({"max_bid": "_", "min_profit": "__"})).join(F.broadcast(limits), F.lit(True))


@query(f"WITH {FOUND_SQL}\nSELECT * FROM found UNION ALL SELECT * FROM fresh")
def found_appended(spark, d):
    """A found-items store with one run's items, a second run added twice, and read back."""
    path, schema = fresh_path(spark, "found"), "url STRING, title STRING, bid DOUBLE"
    found.append_found(found_items(spark, d), path, schema, order="url", run="first")
    for _ in range(2):
        found.append_found(line_items(spark, d), path, schema, run="second")
    return found.read_found(spark, path, schema)


@query(f"""WITH {PART_DEALS_SQL}
SELECT {RANK_SQL} AS deal_number, id, title, url, price, comps_median, comps_count, resale_estimate, profit_ratio, est_profit, confidence
FROM deal""")
def deals_json(spark, d):
    """Numbered deals as JSON lines, read back."""
    path = fresh_path(spark, "deals-json")
    found.write_deals(numbered_part_deals(spark, d), path)
    return spark.read.json(path).select(
        "deal_number", "id", "title", "url", "price", "comps_median", "comps_count", "resale_estimate", "profit_ratio", "est_profit", "confidence")


@query(f"WITH {SCAN_SQL}\nSELECT title, lot, url, bid, market_value, profit, pickup, ends, photos FROM item")
def items_document(spark, d):
    """Kept items as JSON objects with ``items``, one per part, read back."""
    path = fresh_path(spark, "items")
    found.write_items_document(scan.items_out(kept_items(spark, d)), path, parts=3)
    whole = F.from_json("value", f"STRUCT<items: ARRAY<STRUCT<{logs.ITEM_FIELDS}>>>")
    read = spark.read.text(path, wholetext=True).select(F.explode(whole["items"]).alias("i")).select("i.*")
    return read.select("title", "lot", "url", "bid", "market_value", "profit", "pickup", "ends", F.array_join("photos", " ").alias("photos"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS id, p_size || ' hours' AS time_left FROM part WHERE p_size <= 24")
def closing_cards(spark, d):
    """Listings of index pages whose card says that they close within a day."""
    listings = cards.listings_of(cards.scan_cards(index_pages(spark, d)))
    return first_per_key(scan.within_reach(listings, hours=24)).select("id", "time_left")
