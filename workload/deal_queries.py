"""Comps, scoring, ranking and report queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from resalelens import settings as S
from resalelens.functions import money, scoring, text, urls
from resalelens.operators import comps, match, ranking
from resalelens.operators.first import first_per_title
from resalelens.operators.storage import written
from resalelens.plans import deals, report
from workload.registry import ORACLES, cents_sql, query, words_sql
from workload.standins import (
    ASKED_SQL, DEAL_SQL, LINE_ORDER, LISTING_SQL, PART_DEALS_SQL, SCORED_SQL, STATS_SQL, UNIT_SQL,
    comp_sql, part_comps, part_listings, table, unit_price, with_part_query,
)

DEAL_COLUMNS = [
    "id", "title", "url", "price", "comps_avg", "comps_median", "comps_low", "comps_high", "comps_count",
    "comps_query", "comps_source", "resale_estimate", "profit_ratio", "est_profit", "confidence",
]
RANK_SQL = "row_number() OVER (ORDER BY profit_ratio DESC, pos)"


def part_stats(spark, d) -> DataFrame:
    """Stored stats: deals read them once per source."""
    return written(comps.comp_stats(part_comps(spark, d)), "stats")


def part_deals(spark, d) -> DataFrame:
    return deals.find_deals(with_part_query(part_listings(spark, d)), part_stats(spark, d))


def numbered_part_deals(spark, d) -> DataFrame:
    return deals.ranked_deals(with_part_query(part_listings(spark, d)), part_stats(spark, d))


@query(f"""WITH {PART_DEALS_SQL}
SELECT {RANK_SQL} AS deal_number, {", ".join(DEAL_COLUMNS)}, risk FROM deal""")
def deals_ranked(spark, d):
    return numbered_part_deals(spark, d).select(
        "deal_number", *DEAL_COLUMNS, F.array_join("risk_flags", ", ").alias("risk"))


@query(f"""WITH {PART_DEALS_SQL}
SELECT id, title, url, resale_estimate, profit_ratio, est_profit FROM deal
ORDER BY profit_ratio DESC, pos LIMIT 1""")
def top_pick(spark, d):
    return ranking.top_deals(part_deals(spark, d)).select(
        "id", "title", "url", "resale_estimate", "profit_ratio", "est_profit")


@query(f"WITH {comp_sql()},\n{STATS_SQL}\nSELECT * FROM stats")
def comp_stats(spark, d):
    return comps.comp_stats(part_comps(spark, d))


@query(f"""WITH {comp_sql()}
SELECT query, source, price, count(*) AS copies,
       CAST(sum(count(*)) OVER (PARTITION BY query, source ORDER BY price) - count(*) + 1 AS BIGINT) AS first_rank
FROM comp GROUP BY query, source, price""")
def price_lists(spark, d):
    return comps.price_list(part_comps(spark, d))


@query(f"""WITH price AS (
  SELECT l_partkey AS item, {UNIT_SQL} AS price, {", ".join(LINE_ORDER)} FROM lineitem),
kept AS (
  SELECT item, price FROM price WHERE price > 1 AND price < 100000
  QUALIFY row_number() OVER (PARTITION BY item ORDER BY {", ".join(LINE_ORDER)}) <= 20),
agg AS (
  SELECT item, list_sort(list(price)) AS p, min(price) AS lo, max(price) AS hi, count(*) AS n FROM kept GROUP BY item)
SELECT p_partkey AS item,
       coalesce({cents_sql("(p[(n + 1) // 2] + p[n // 2 + 1]) / 2")}, 0.0) AS median_price,
       coalesce('$' || lo || '–$' || hi, 'unknown') AS price_range,
       coalesce(n, 0) AS sample_size,
       'ebay_completed' AS source,
       CASE WHEN n IS NULL THEN 'No sold listings found' END AS note
FROM part LEFT JOIN agg ON item = p_partkey""")
def market_value(spark, d):
    price = unit_price()
    prices = table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("item"), F.struct(*LINE_ORDER).alias("pos"), price.alias("price"),
    ).filter(money.between_exclusive(F.col("price"), (1.0, 100000.0)))
    items = table(spark, d, "part").select(F.col("p_partkey").alias("item"))
    return comps.market_value(items, prices)


def _price_texts(spark, d) -> DataFrame:
    """Every kind of price text a result page shows."""
    ext = F.format_number("l_extendedprice", 2)
    high = F.format_number(F.col("l_extendedprice") + F.col("l_quantity"), 2)
    kind = F.col("l_linenumber")
    shown = (
        F.when(kind == 1, F.concat(F.lit("$"), ext))
        .when(kind == 2, F.concat(F.lit("$"), ext, F.lit(" to $"), high))
        .when(kind == 3, F.concat(F.lit("Sold for "), F.col("l_quantity").cast("int").cast("string")))
        .when(kind == 4, "Best offer accepted")
        .when(kind == 5, F.concat(F.lit("$"), ext, F.lit(" to negotiate")))
        .when(kind == 6, F.element_at(F.array(F.lit("$0.99"), F.lit("$1"), F.lit("$50,000"), F.lit("$100,000.00")),
                                      (F.col("l_orderkey") % 4 + 1).cast("int")))
        .otherwise(F.concat(F.lit("US $"), F.format_number("l_quantity", 2)))
    )
    return table(spark, d, "lineitem").select(*LINE_ORDER[:4], shown.alias("price_text"))


PRICE_TEXT_SQL = f"""texts AS (
  SELECT {", ".join(LINE_ORDER[:4])}, l_extendedprice AS ext, l_quantity AS qty, l_linenumber AS kind,
    CASE l_linenumber
      WHEN 1 THEN '$' || format('{{:,.2f}}', l_extendedprice)
      WHEN 2 THEN '$' || format('{{:,.2f}}', l_extendedprice) || ' to $' || format('{{:,.2f}}', l_extendedprice + l_quantity)
      WHEN 3 THEN 'Sold for ' || CAST(l_quantity AS INT)
      WHEN 4 THEN 'Best offer accepted'
      WHEN 5 THEN '$' || format('{{:,.2f}}', l_extendedprice) || ' to negotiate'
      WHEN 6 THEN ['$0.99', '$1', '$50,000', '$100,000.00'][l_orderkey % 4 + 1]
      ELSE 'US $' || format('{{:,.2f}}', l_quantity) END AS price_text
  FROM lineitem)"""


@query(f"""WITH {PRICE_TEXT_SQL}, read AS (
  SELECT *, TRY_CAST(replace(regexp_extract(price_text, '\\$([\\d,]+(?:\\.\\d{{2}})?)', 1), ',', '') AS DOUBLE) AS p FROM texts)
SELECT {", ".join(LINE_ORDER[:4])}, price_text, CASE WHEN p > 0.99 AND p < 50000 THEN p END AS price FROM read""")
def comp_price_low(spark, d):
    return _price_texts(spark, d).withColumn("price", money.comp_price_low(F.col("price_text")))


@query(f"""WITH {PRICE_TEXT_SQL}, read AS (
  SELECT *, contains(lower(price_text), ' to ') AS ranged,
    regexp_extract_all(price_text, '[\\d,]+\\.?\\d*') AS nums,
    TRY_CAST(regexp_extract(replace(price_text, ',', ''), '[\\d,]+\\.?\\d*') AS DOUBLE) AS p FROM texts)
SELECT {", ".join(LINE_ORDER[:4])}, price_text,
  CASE WHEN ranged AND len(nums) >= 2
         THEN (CAST(replace(nums[1], ',', '') AS DOUBLE) + CAST(replace(nums[2], ',', '') AS DOUBLE)) / 2
       WHEN NOT ranged AND p > 1 AND p < 100000 THEN p END AS price FROM read""")
def comp_price_mid(spark, d):
    return _price_texts(spark, d).withColumn("price", money.comp_price_mid(F.col("price_text")))


@query(f"""WITH {LISTING_SQL}, {comp_sql("l_discount = 0.05")}, {STATS_SQL}, {ASKED_SQL}, {SCORED_SQL}
SELECT id, c.source AS comps_source, c.count AS comps_count, c.median AS comps_median FROM scored""")
def comp_fallback(spark, d):
    """Few primary prices, so that the secondary source is often taken."""
    stats = written(comps.comp_stats(part_comps(spark, d, F.col("l_discount") == 0.05)), "stats")
    return comps.with_comps(with_part_query(part_listings(spark, d)), stats).select(
        "id", F.col("comps.source").alias("comps_source"), F.col("comps.count").alias("comps_count"),
        F.col("comps.median").alias("comps_median"))


@query(f"""WITH {PART_DEALS_SQL}
SELECT confidence,
       CASE WHEN profit_ratio >= 2.5 AND confidence <> 'LOW' THEN 'BUY' WHEN profit_ratio >= 1.8 THEN 'WATCH' ELSE 'SKIP' END
         AS recommendation, count(*) AS n
FROM deal GROUP BY ALL""")
def confidence_mix(spark, d):
    rec = scoring.recommend(F.col("profit_ratio"), F.col("confidence"))
    return part_deals(spark, d).groupBy("confidence", rec.alias("recommendation")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {LISTING_SQL}, {comp_sql()}, {STATS_SQL},
asked AS (SELECT *, id AS query, id AS query2 FROM listing
          QUALIFY row_number() OVER (PARTITION BY title ORDER BY pos) = 1), {SCORED_SQL}
SELECT 'found' AS reason, count(*) AS n FROM listing
UNION ALL SELECT 'unique', count(*) FROM asked
UNION ALL SELECT CASE WHEN NOT coalesce(price > 0, false) THEN 'no_price' WHEN coalesce(n, 0) = 0 THEN 'no_comps'
                      WHEN ratio_raw >= 1.8 AND profit_raw >= 100 THEN 'deal' ELSE 'below_threshold' END, count(*)
FROM scored GROUP BY 1""")
def funnel(spark, d):
    found = part_listings(spark, d)
    return deals.funnel(found, with_part_query(first_per_title(found)), part_stats(spark, d))


@query(ORACLES["funnel"])
def funnel_observed(spark, d):
    """The same counts, observed while the deals themselves are found."""
    seen = deals.Funnel()
    unique = with_part_query(seen.unique(first_per_title(seen.found(part_listings(spark, d)))))
    written(deals.find_deals(unique, part_stats(spark, d), funnel=seen), "deals")
    return seen.rows(spark)


USD = "'$' || format('{{:,.0f}}', {})"


def _usd(c: str) -> str:
    return USD.format(c)


@query(f"""WITH {PART_DEALS_SQL}
SELECT {RANK_SQL} AS deal_number, title, url,
  CASE WHEN price_str <> '' THEN price_str ELSE printf('$%.2f', price) END AS current_price,
  time_left AS time_remaining, bids, state AS location, comps_query,
  CASE comps_source WHEN 'ebay_sold' THEN 'eBay Sold Listings' ELSE 'Facebook Marketplace Phoenix' END AS comps_label,
  {_usd("comps_avg")} AS avg, {_usd("comps_median")} AS median,
  {_usd("comps_low")} || ' – ' || {_usd("comps_high")} AS range,
  comps_count || ' listings' AS comps, {_usd("resale_estimate")} AS resale,
  format('{{:,.1f}}', profit_ratio) || 'x' AS ratio, {_usd("est_profit")} AS profit, confidence,
  CASE risk WHEN '' THEN 'None' ELSE risk END AS risk,
  CASE WHEN profit_ratio >= 2.5 AND confidence <> 'LOW' THEN 'BUY' WHEN profit_ratio >= 1.8 THEN 'WATCH' ELSE 'SKIP' END
    AS recommendation
FROM deal""")
def report_rows(spark, d):
    return report.deal_report(numbered_part_deals(spark, d))


@query(f"""WITH {PART_DEALS_SQL}
SELECT {RANK_SQL} AS deal_number, '--- DEAL #' || {RANK_SQL} || ' ---' || chr(10)
  || 'TITLE:           ' || title || chr(10) || 'URL:             ' || url || chr(10)
  || 'CURRENT PRICE:   ' || CASE WHEN price_str <> '' THEN price_str ELSE printf('$%.2f', price) END || chr(10)
  || 'TIME REMAINING:  ' || time_left || chr(10) || 'BIDS:            ' || bids || chr(10)
  || 'LOCATION:        ' || state || chr(10) || chr(10) || 'RESALE COMPS (' || CASE comps_source WHEN 'ebay_sold' THEN 'eBay Sold Listings' ELSE 'Facebook Marketplace Phoenix' END
  || ' — "' || comps_query || '"):' || chr(10) || '  Avg:    ' || {_usd("comps_avg")} || chr(10) || '  Median: ' || {_usd("comps_median")} || chr(10)
  || '  Range:  ' || {_usd("comps_low")} || ' – ' || {_usd("comps_high")} || chr(10)
  || '  Comps:  ' || comps_count || ' listings' || chr(10) || '  Est. resale value: ' || {_usd("resale_estimate")} || chr(10) || chr(10)
  || 'PROFIT RATIO:    ' || format('{{:,.1f}}', profit_ratio) || 'x' || chr(10)
  || 'EST. PROFIT:     ' || {_usd("est_profit")} || chr(10) || 'CONFIDENCE:      ' || confidence || chr(10)
  || 'RISK FLAGS:      ' || CASE risk WHEN '' THEN 'None' ELSE risk END || chr(10) || 'RECOMMENDATION:  '
  || CASE WHEN profit_ratio >= 2.5 AND confidence <> 'LOW' THEN 'BUY' WHEN profit_ratio >= 1.8 THEN 'WATCH' ELSE 'SKIP' END
    AS block
FROM deal""")
def deal_blocks(spark, d):
    return report.deal_block(report.deal_report(numbered_part_deals(spark, d)))


@query(f"""WITH {PART_DEALS_SQL}
SELECT url, 'TOP PICK: ' || title || ' - bid at $' || format('{{:.0f}}', price) || ', resells for ~$'
  || format('{{:.0f}}', resale_estimate) || ' on ' || CASE comps_source WHEN 'ebay_sold' THEN 'eBay' ELSE 'FB Marketplace' END
  || ' - ' || format('{{:,.1f}}', profit_ratio) || 'x return (~$' || format('{{:.0f}}', est_profit) || ' profit)' AS line
FROM deal ORDER BY profit_ratio DESC, pos LIMIT 1""")
def pick_line(spark, d):
    return report.pick_line(ranking.top_deals(part_deals(spark, d)))


@query(f"""WITH {PART_DEALS_SQL}
SELECT {RANK_SQL} AS number, substr(title, 1, 35) AS item,
  CASE WHEN price_str <> '' THEN price_str ELSE printf('$%.2f', price) END AS bid,
  {_usd("resale_estimate")} AS resale, format('{{:,.1f}}', profit_ratio) || 'x' AS ratio,
  CASE WHEN profit_ratio >= 2.5 AND confidence <> 'LOW' THEN 'BUY' WHEN profit_ratio >= 1.8 THEN 'WATCH' ELSE 'SKIP' END AS rec,
  substr(time_left, 1, 20) AS time_left
FROM deal""")
def summary_rows(spark, d):
    return report.summary_table(numbered_part_deals(spark, d))


# --- term match: benchmark texts ask, documents are the sold titles ----------------

ASK_SQL = rf"""ask AS (
  SELECT item_id, list_distinct(list_transform({words_sql("text")}[1:6], lambda w: lower(w))) AS terms FROM benchmark),
term AS (SELECT item_id, len(terms) AS n, unnest(terms) AS term FROM ask),
sold AS (SELECT doc_id, unnest(list_distinct({words_sql("lower(text)")})) AS term FROM documents),
hit AS (
  SELECT item_id, doc_id FROM term JOIN sold USING (term) GROUP BY item_id, doc_id, n HAVING count(*) = n)"""


@query(f"WITH {ASK_SQL}\nSELECT item_id AS query_id, doc_id AS title_id FROM hit")
def term_match(spark, d):
    ask = table(spark, d, "benchmark").select(
        F.col("item_id").alias("query_id"), text.term_set(text.search_query(F.col("text"), S.PRIMARY_TERMS)).alias("terms"))
    sold = table(spark, d, "documents").select(
        F.col("doc_id").alias("title_id"), text.term_set(F.col("text")).alias("terms"))
    return match.term_match(ask, sold)


def _sold_documents(spark, d) -> DataFrame:
    source = F.when(F.col("doc_id") % 2 == 0, S.PRIMARY_SOURCE).otherwise(S.SECONDARY_SOURCE)
    return table(spark, d, "documents").select(
        F.col("text").alias("title"), source.alias("source"),
        (F.col("n_chars") + 0.5).cast("double").alias("price"),
    ).filter(money.between_exclusive(F.col("price"), S.SCORER_BOUNDS))


def _asking_listings(spark, d) -> DataFrame:
    return deals.with_queries(table(spark, d, "benchmark").select(
        F.col("item_id").cast("string").alias("id"), F.col("text").alias("title"),
        (F.col("item_id") + 1).cast("double").alias("price"), F.col("text").alias("card_text"),
        F.col("item_id").alias("pos")))


@query(rf"""WITH asked AS (
  SELECT CAST(item_id AS VARCHAR) AS id, CAST(item_id + 1 AS DOUBLE) AS price, text AS card_text, item_id AS pos,
         array_to_string({words_sql("text")}[1:6], ' ') AS query, array_to_string({words_sql("text")}[1:5], ' ') AS query2
  FROM benchmark),
term AS (
  SELECT query, len(terms) AS n, unnest(terms) AS term FROM (
    SELECT query, list_distinct({words_sql("lower(query)")}) AS terms
    FROM (SELECT query FROM asked UNION SELECT query2 FROM asked))),
sold AS (SELECT doc_id, unnest(list_distinct({words_sql("lower(text)")})) AS term FROM documents),
hit AS (SELECT query, doc_id FROM term JOIN sold USING (term) GROUP BY query, doc_id, n HAVING count(*) = n),
comp AS (
  SELECT query, CASE doc_id % 2 WHEN 0 THEN 'ebay_sold' ELSE 'facebook_marketplace' END AS source,
         CAST(n_chars + 0.5 AS DOUBLE) AS price
  FROM hit JOIN documents USING (doc_id) WHERE n_chars + 0.5 > 0.99 AND n_chars + 0.5 < 50000),
{STATS_SQL}, {SCORED_SQL}, {DEAL_SQL}
SELECT id, price, comps_avg, comps_median, comps_count, comps_query, comps_source, resale_estimate, profit_ratio, confidence
FROM deal""")
def deals_by_title(spark, d):
    """The whole way from titles: terms, matching sales, stats, score, thresholds."""
    listings = _asking_listings(spark, d)
    stats = deals.stats_by_title(listings, _sold_documents(spark, d))
    return deals.find_deals(listings, stats).select(
        "id", "price", "comps_avg", "comps_median", "comps_count", "comps_query", "comps_source",
        "resale_estimate", "profit_ratio", "confidence")


@query(rf"""SELECT doc_id, array_to_string({words_sql("text")}[1:6], ' ') AS query6,
  array_to_string({words_sql("text")}[1:5], ' ') AS query5,
  'https://www.ebay.com/sch/i.html?_nkw=' || replace(url_encode(array_to_string({words_sql("text")}[1:6], ' ')), '%20', '+')
    || '&LH_Sold=1&LH_Complete=1&_sop=13' AS search_url
FROM documents""")
def search_terms(spark, d):
    title = F.col("text")
    return table(spark, d, "documents").select(
        "doc_id", text.search_query(title, 6).alias("query6"), text.search_query(title, 5).alias("query5"),
        urls.sold_search_url(text.search_query(title, 6)).alias("search_url"))
