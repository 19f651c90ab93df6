"""Roles of the deal finder mapped onto the driver tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from resalelens import settings as S
from resalelens.functions import money
from workload.registry import cents_sql

VIEW = "https://www.publicsurplus.com/sms/auction/view?auc="
LOTS = "https://www.bidspotter.com/en-us/auction-catalogues/a/lots/"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def spread(spark: SparkSession, d: str, name: str, key: str, *columns: str) -> DataFrame:
    """Columns of a table, dealt over all cores by a unique key. A few MB of a compressed file
    are one task, however long the work on its rows takes: deal the short rows before pages or
    texts are made from them. The number is given, since rows of few bytes would be merged
    into few tasks again."""
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    return table(spark, d, name).select(key, *columns).repartition(parts, key)


def table_stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    """Stream of a table that is one file or a folder of files. The path is a pattern for its
    name alone: a stream takes a single file by a pattern only."""
    return spark.readStream.schema(table(spark, d, name).schema).parquet(f"{d}/[{name[0]}]{name[1:]}.parquet")


# --- listings: part --------------------------------------------------------------

def title():
    """Name of a part with half its number: every title has two listings."""
    return F.concat_ws(" ", "p_name", F.floor(F.col("p_partkey") / 2).cast("string"))


TITLE_SQL = "p_name || ' ' || p_partkey // 2"


def part_listings(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("p_partkey").cast("string")
    size = F.col("p_size")
    return table(spark, d, "part").select(
        key.alias("id"),
        title().alias("title"),
        F.concat(F.lit(VIEW), key).alias("url"),
        F.col("p_retailprice").alias("price"),
        F.when(size % 4 == 0, "").otherwise(F.format_string("$%.2f", "p_retailprice")).alias("price_str"),
        F.concat((size % 5).cast("string"), F.lit(" days "), size.cast("string"), F.lit(" min")).alias("time_left"),
        (size % 7).alias("bids"),
        F.when(size % 3 == 0, "AZ").when(size % 3 == 1, "TX").otherwise("").alias("state"),
        F.col("p_type").alias("category"),
        F.concat(F.lit("#"), key, F.lit(" - "), F.col("p_name"),
                 F.when(F.col("p_type") == "ECONOMY", " | sold as-is").otherwise("")).alias("card_text"),
        F.col("p_partkey").alias("pos"),
    )


LISTING_SQL = f"""listing AS (
  SELECT CAST(p_partkey AS VARCHAR) AS id, {TITLE_SQL} AS title, '{VIEW}' || p_partkey AS url,
         p_retailprice AS price,
         CASE WHEN p_size % 4 = 0 THEN '' ELSE printf('$%.2f', p_retailprice) END AS price_str,
         (p_size % 5) || ' days ' || p_size || ' min' AS time_left,
         p_size % 7 AS bids,
         CASE p_size % 3 WHEN 0 THEN 'AZ' WHEN 1 THEN 'TX' ELSE '' END AS state,
         p_type AS category,
         '#' || p_partkey || ' - ' || p_name || CASE WHEN p_type = 'ECONOMY' THEN ' | sold as-is' ELSE '' END AS card_text,
         p_partkey AS pos
  FROM part)"""


def with_part_query(listings: DataFrame) -> DataFrame:
    return listings.withColumn("query", F.col("id")).withColumn("query2", F.col("id"))


# --- sold prices: lineitem -------------------------------------------------------

def unit_price():
    return money.cents(F.col("l_extendedprice") / F.col("l_quantity"))


UNIT_SQL = cents_sql("l_extendedprice / l_quantity")

LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]


def part_comps(spark: SparkSession, d: str, primary=None) -> DataFrame:
    """Sales with flag R, and ``primary`` if given, are of the primary source, all others
    of the secondary."""
    first = F.col("l_returnflag") == "R"
    first = first if primary is None else first & primary
    source = F.when(first, S.PRIMARY_SOURCE).otherwise(S.SECONDARY_SOURCE)
    return (
        table(spark, d, "lineitem")
        .select(F.col("l_partkey").cast("string").alias("query"), source.alias("source"), unit_price().alias("price"))
        .filter(money.between_exclusive(F.col("price"), S.SCORER_BOUNDS))
    )


def comp_sql(primary: str = "true") -> str:
    return f"""comp AS (
  SELECT * FROM (
    SELECT CAST(l_partkey AS VARCHAR) AS query,
           CASE WHEN l_returnflag = 'R' AND {primary} THEN '{S.PRIMARY_SOURCE}' ELSE '{S.SECONDARY_SOURCE}' END AS source,
           {UNIT_SQL} AS price
    FROM lineitem)
  WHERE price > 0.99 AND price < 50000)"""


STATS_SQL = f"""stats AS (
  SELECT query, source,
         {cents_sql("CAST(sum(CAST(price AS DECIMAL(18,4))) AS DOUBLE) / count(*)")} AS avg,
         list_sort(list(price))[count(*) // 2 + 1] AS median,
         min(price) AS low, max(price) AS high, count(*) AS count
  FROM comp GROUP BY query, source)"""


# listing (id, price, card_text, query, query2) and stats to scored
SCORED_SQL = f"""paired AS (
  SELECT l.*, a.count AS n1, b.count AS n2,
         coalesce(a.count, 0) < 3 AND coalesce(b.count, 0) > coalesce(a.count, 0) AS second,
         a AS sa, b AS sb
  FROM asked l
  LEFT JOIN (SELECT * FROM stats WHERE source = '{S.PRIMARY_SOURCE}') a ON a.query = l.query
  LEFT JOIN (SELECT * FROM stats WHERE source = '{S.SECONDARY_SOURCE}') b ON b.query = l.query2),
chosen AS (
  SELECT * EXCLUDE (sa, sb), CASE WHEN second THEN sb ELSE sa END AS c FROM paired),
valued AS (
  SELECT *, coalesce(nullif(c.median, 0), c.avg)
            * CASE WHEN lower(card_text) LIKE '%as-is%' THEN 0.7 ELSE 1.0 END::DOUBLE AS resale_raw,
         lower(card_text) LIKE '%as-is%' AS risky
  FROM chosen),
scored AS (
  SELECT *, CASE WHEN price > 0 THEN resale_raw / price ELSE 0 END AS ratio_raw, resale_raw - price AS profit_raw,
         c.count AS n FROM valued)"""

DEAL_SQL = f"""deal AS (
  SELECT *, c.avg AS comps_avg, c.median AS comps_median, c.low AS comps_low, c.high AS comps_high,
         c.count AS comps_count, c.query AS comps_query, c.source AS comps_source,
         {cents_sql("resale_raw")} AS resale_estimate, {cents_sql("ratio_raw")} AS profit_ratio,
         {cents_sql("profit_raw")} AS est_profit,
         CASE WHEN n >= 5 THEN 'HIGH' WHEN n >= 3 THEN 'MED' ELSE 'LOW' END AS confidence,
         CASE WHEN risky THEN '{S.RISK_LABEL}' ELSE '' END AS risk
  FROM scored WHERE price > 0 AND n > 0 AND ratio_raw >= 1.8 AND profit_raw >= 100)"""

ASKED_SQL = "asked AS (SELECT *, id AS query, id AS query2 FROM listing)"
PART_DEALS_SQL = ",\n".join([LISTING_SQL, comp_sql(), STATS_SQL, ASKED_SQL, SCORED_SQL, DEAL_SQL])


# --- search entries --------------------------------------------------------------

SEARCHES = [
    (0, "widget", "STANDARD", "", None, None),
    (1, "", "PROMO", "AZ", None, 1000.0),
    (2, "red", "SMALL", "TX", 0.0, 5000.0),
    (3, "gear", "LARGE", "", 950.0, None),
    (4, "", "ECONOMY", "", None, None),
    (5, "old rod", "MEDIUM", "", None, None),
    (6, "laptop", "NO SUCH CATEGORY", "", None, None),
]


def searches(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        SEARCHES, "search_id INT, keywords STRING, category STRING, state STRING, min_bid DOUBLE, max_bid DOUBLE")


def _lit(v) -> str:
    return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)


SEARCH_SQL = f"""search AS (
  SELECT * FROM (VALUES {", ".join("(" + ", ".join(_lit(v) for v in s) + ")" for s in SEARCHES)})
  AS t(search_id, keywords, category, state, min_bid, max_bid)),
matched AS (
  SELECT s.search_id, l.* FROM listing l JOIN search s ON l.category = s.category
    AND contains(lower(l.title), lower(s.keywords)) AND (s.state = '' OR s.state = l.state)
    AND (s.min_bid IS NULL OR l.price >= s.min_bid) AND (s.max_bid IS NULL OR l.price <= s.max_bid))"""


# --- found items and incoming batches ---------------------------------------------

def order_items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(
        F.concat(F.lit(LOTS), F.col("o_orderkey").cast("string")).alias("url"),
        F.col("o_orderpriority").alias("title"),
        F.col("o_totalprice").alias("bid"),
        F.col("o_orderkey").alias("pos"),
    )


def found_items(spark: SparkSession, d: str) -> DataFrame:
    """The items an earlier scan kept: those of every tenth order number."""
    return order_items(spark, d).filter(F.col("pos") % 10 == 0).select("url", "title", "bid")


def line_items(spark: SparkSession, d: str) -> DataFrame:
    """A batch with repeated links, and with blank links on line 7."""
    link = F.when(F.col("l_linenumber") == 7, "").otherwise(
        F.concat(F.lit(LOTS), F.col("l_orderkey").cast("string")))
    return table(spark, d, "lineitem").select(
        link.alias("url"), F.col("l_linestatus").alias("title"), F.col("l_extendedprice").alias("bid"),
        F.struct(*LINE_ORDER).alias("pos"))


FOUND_SQL = f"""item AS (
  SELECT '{LOTS}' || o_orderkey AS url, o_orderpriority AS title, o_totalprice AS bid, o_orderkey AS pos FROM orders),
found AS (SELECT url, title, bid FROM item WHERE pos % 10 = 0),
batch AS (
  SELECT CASE WHEN l_linenumber = 7 THEN '' ELSE '{LOTS}' || l_orderkey END AS url,
         l_linestatus AS title, l_extendedprice AS bid,
         row_number() OVER (ORDER BY {", ".join(LINE_ORDER)}) AS pos FROM lineitem),
fresh AS (
  SELECT url, title, bid FROM batch b WHERE url <> '' AND NOT EXISTS (SELECT 1 FROM found f WHERE f.url = b.url)
  QUALIFY row_number() OVER (PARTITION BY url ORDER BY pos) = 1)"""
