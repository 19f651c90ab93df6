"""Queries over captured pages, and over pages that Spark builds from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from resalelens import settings as S
from resalelens.functions import money
from resalelens.functions.urls import absolutize
from resalelens.operators.filters import has_title
from resalelens.operators.first import first_per_key
from resalelens.operators.storage import fresh_path
from resalelens.plans import deals
from resalelens.sources import captures, cards, dom, links, prices, records
from resalelens.sources.records import SiteRule
from workload.registry import query
from workload.standins import DEAL_SQL, SCORED_SQL, STATS_SQL, TITLE_SQL, UNIT_SQL, part_listings, spread, table, title, unit_price

TEXT_SQL = r"""trim(replace(replace(replace(replace(replace(regexp_replace({}, '&(lt|gt|quot|#39|nbsp|amp);?', '&\1;', 'g'),
  '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&amp;', '&'))"""

LINK_SQL = r"""found AS (
  SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) AS hrefs,
         regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) AS texts FROM pages),
link AS (
  SELECT page_id, i - 1 AS pos, hrefs[i] AS href, texts[i] AS text
  FROM (SELECT *, unnest(generate_series(1, len(hrefs))) AS i FROM found)),
firsts AS (
  SELECT page_id, href, row_number() OVER (PARTITION BY page_id ORDER BY min(pos)) - 1 AS pos
  FROM link GROUP BY page_id, href)"""


def pages(spark, d) -> DataFrame:
    return table(spark, d, "pages")


@query(rf"""WITH {LINK_SQL}
SELECT page_id, CAST(pos AS INT) AS pos, {TEXT_SQL.format("href")} AS href, {TEXT_SQL.format("text")} AS text FROM link
WHERE length({TEXT_SQL.format("text")}) >= 3""")
def links_named(spark, d):
    return links.named_links(links.scan_links(pages(spark, d)))


@query(rf"""WITH {LINK_SQL}
SELECT page_id, CAST(count(*) AS INT) AS total, CAST(count(*) FILTER (regexp_matches(href, '^/[A-Z]')) AS INT) AS matching
FROM firsts GROUP BY page_id""")
def link_counts(spark, d):
    return links.link_counts(pages(spark, d), "^/[A-Z]")


@query(rf"""WITH {LINK_SQL}
SELECT page_id, CAST(pos AS INT) AS pos, {TEXT_SQL.format('href')} AS href FROM firsts""")
def distinct_links(spark, d):
    return links.distinct_links(pages(spark, d))


@query(rf"""WITH {LINK_SQL}
SELECT page_id, CAST(pos AS INT) AS pos, {TEXT_SQL.format('href')} AS href FROM firsts WHERE pos < 3""")
def first_links(spark, d):
    return links.first_links(pages(spark, d), 3)


@query(rf"""WITH {LINK_SQL}
SELECT page_id, CAST(pos AS INT) AS pos, regexp_extract(url, '^https?://[^/]+') || {TEXT_SQL.format('href')} AS url
FROM firsts JOIN pages USING (page_id)""")
def absolute_links(spark, d):
    host = F.regexp_extract("url", r"^https?://[^/]+", 0)
    based = pages(spark, d).select("page_id", "html", host.alias("host"))
    hrefs = F.array_distinct(F.transform(links.anchors(F.col("html")), lambda a: a["href"]))
    found = based.select("page_id", "host", F.posexplode(hrefs).alias("pos", "href"))
    return found.select("page_id", "pos", absolutize(F.col("href"), F.col("host")).alias("url"))


@query(rf"""SELECT page_id, {TEXT_SQL.format("regexp_extract(html, '<h1>(.*?)</h1>', 1, 's')")} AS title FROM pages""")
def page_titles(spark, d):
    nodes = F.col("nodes")
    paged = dom.page_nodes(pages(spark, d).select("page_id", "html"))
    at = dom.first_position(nodes, lambda n: dom.is_element(n, "h1", "h2"))
    return paged.select("page_id", dom.clean_text(nodes, at).alias("title"))


# Rules for the hosts of the pages table; other hosts are unsupported.
PAGE_RULES = tuple(
    SiteRule(
        site=site, host=host, title_tags=("h1", "h2"), lot_patterns=(r"/(\d+)", r"page=(\d+)"),
        bid_label=r"(?i)Current Bid", date_label=r"(?i)Closing", location_label="^©",
        location_mode="parent", photo_pattern="photo", base_url="", spaced_bid=True,
        descriptions=(("section", "ad"), ("div", "^ad$")),
    )
    for site, host in (("com", ".example.com"), ("org", ".example.org"))
)


@query("""SELECT page_id, CASE WHEN contains(url, '.example.com') THEN 'com' WHEN contains(url, '.example.org') THEN 'org' ELSE 'unknown' END AS site,
  CASE WHEN NOT contains(url, '.example.com') AND NOT contains(url, '.example.org') THEN 'Unsupported site' END AS error FROM pages""")
def site_route(spark, d):
    return records.routed(pages(spark, d).select("page_id", "url"), PAGE_RULES).select("page_id", "site", "error")


@query(rf"""WITH routed AS (
  SELECT *, CASE WHEN contains(url, '.example.com') THEN 'com' WHEN contains(url, '.example.org') THEN 'org' END AS site FROM pages)
SELECT page_id, site,
  {TEXT_SQL.format("regexp_extract(html, '<h1>(.*?)</h1>', 1, 's')")} AS title,
  coalesce(nullif(regexp_extract(url, '/(\d+)', 1), ''), nullif(regexp_extract(url, 'page=(\d+)', 1), ''), '') AS lot,
  left({TEXT_SQL.format("regexp_extract(html, '<div class=.ad.>(.*?)</div>', 1, 's')")}, 2000) AS description
FROM routed WHERE site IS NOT NULL""")
def page_records(spark, d):
    found = records.extract_records(pages(spark, d), PAGE_RULES, **S.RECORD_LIMITS)
    return records.with_sentinels(records.accepted(found)).select("page_id", "site", "title", "lot", "description")


# --- detail pages built from part, one layout per site ------------------------------

def auction_pages(spark, d) -> DataFrame:
    """A listing page per part, in the layout of one of three sites; some hosts are unknown."""
    key, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    price, name = F.format_number("p_retailprice", 2), F.col("p_name")
    date = F.concat((F.col("p_size") % 12 + 1).cast("string"), F.lit("/"), (F.col("p_size") % 28 + 1).cast("string"), F.lit("/2026"))

    def html(*pieces):
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in pieces])

    surplus = html(
        "<html><body><!-- Current Bid $1 --><h1> ", name, " &amp; <b>", F.col("p_brand"), "</b></h1>",
        "<p>Current Bid: none</p><table><tr><td>Minimum Bid</td></tr></table>",
        "<div>High Bid <b>$", price, "</b> USD</div><div><span>Auction Ends</span></div><p>Closing on ", date, " at noon",
        "<p>Agency: Yard <i>", size, "</i></p><img src='/a/photo", key, ".jpg'><img src='/a/logo.png'><img src='/a/photo", key, ".jpg'>")
    spotter = html(
        "<html><body><h2>", name, "</h2><div class='bids'>Starting Bid <em>", size, " bids</em> $", price, "</div>",
        "<div>End Time <b>", date, "</b></div><dl><dt>Location</dt><dd> City ", size, " </dd></dl>",
        "<img src='/img/", key, "'><img src='/img/", key, "'><img src='https://cdn.example.com/lot", key, ".jpg'><img src='/x/y.gif'>",
        "<section class='details'>not this</section><div class='lot info'>Good <b>", F.col("p_type"), "</b> order</div>")
    planet = html(
        "<html><body><h1>", name, "</h1><ul><li>Reserve Price</li></ul><p>Buy Now for ", price, "</p>",
        "<p>Sale Date: TBA</p><p>End Date: ", date, "</p>",
        "<span>Location</span><span> </span><b>Region</b><i>West ", size, "</i>",
        "<img src='/photos/", key, ".png'><div class='spec-sheet'>Size <i>", size, "</i></div>")
    layout = F.col("p_partkey") % 4
    url = (
        F.when(layout == 0, F.concat(F.lit("https://www.publicsurplus.com/sms/auction/view?auc="), key))
        .when(layout == 1, F.concat(F.lit("https://www.bidspotter.com/en-us/auction-catalogues/a/lots/L"), key))
        .when(layout == 2, F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("https://www.ironplanet.com/item/"), key))
              .otherwise(F.concat(F.lit("https://www.ironplanet.com/jsp/s/item.ips?itemId="), key)))
        .otherwise(F.concat(F.lit("https://www.example.com/"), key)))
    body = F.when(layout == 0, surplus).when(layout == 1, spotter).otherwise(planet)
    parts = spread(spark, d, "part", "p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")
    return parts.select(F.col("p_partkey").alias("page_id"), url.alias("url"), body.alias("html"))


AUCTION_SQL = """auction AS (
  SELECT p_partkey AS page_id, p_partkey % 4 AS layout, p_name, p_size, p_retailprice, p_brand, p_type,
    (p_size % 12 + 1) || '/' || (p_size % 28 + 1) || '/2026' AS day FROM part),
record AS (
  SELECT page_id,
    CASE layout WHEN 0 THEN 'https://www.publicsurplus.com/sms/auction/view?auc=' || page_id
      WHEN 1 THEN 'https://www.bidspotter.com/en-us/auction-catalogues/a/lots/L' || page_id
      WHEN 2 THEN CASE WHEN p_size % 2 = 0 THEN 'https://www.ironplanet.com/item/' ELSE 'https://www.ironplanet.com/jsp/s/item.ips?itemId=' END || page_id
      ELSE 'https://www.example.com/' || page_id END AS url,
    CASE layout WHEN 0 THEN 'publicsurplus' WHEN 1 THEN 'bidspotter' WHEN 2 THEN 'ironplanet' ELSE 'unknown' END AS site,
    CASE layout WHEN 0 THEN p_name || ' &' || p_brand WHEN 3 THEN '' ELSE p_name END AS title,
    CASE layout WHEN 1 THEN 'L' || page_id WHEN 3 THEN '' ELSE CAST(page_id AS VARCHAR) END AS lot,
    CASE layout WHEN 3 THEN 0.0 ELSE p_retailprice END AS current_bid,
    CASE layout WHEN 3 THEN '' ELSE day END AS end_date,
    CASE layout WHEN 0 THEN 'Agency: Yard' || p_size WHEN 1 THEN 'City ' || p_size WHEN 2 THEN 'West ' || p_size ELSE '' END AS location,
    CASE layout WHEN 0 THEN '/a/photo' || page_id || '.jpg /a/photo' || page_id || '.jpg'
      WHEN 1 THEN 'https://www.bidspotter.com/img/' || page_id || ' https://cdn.example.com/lot' || page_id || '.jpg'
      WHEN 2 THEN 'https://www.ironplanet.com/photos/' || page_id || '.png' ELSE '' END AS photos,
    CASE layout WHEN 1 THEN 'Good ' || p_type || ' order' WHEN 2 THEN 'Size ' || p_size ELSE '' END AS description,
    CASE layout WHEN 3 THEN 'Unsupported site' END AS error
  FROM auction)"""


@query(f"WITH {AUCTION_SQL}\nSELECT * FROM record")
def auction_records(spark, d):
    found = records.with_sentinels(records.extract_records(auction_pages(spark, d), **S.RECORD_LIMITS))
    return found.withColumn("photos", F.coalesce(F.array_join("photos", " "), F.lit("")))


@query(f"WITH {AUCTION_SQL}\nSELECT url, site, error FROM record WHERE error IS NOT NULL")
def rejected_pages(spark, d):
    return records.rejects(records.extract_records(auction_pages(spark, d), **S.RECORD_LIMITS))


@query("""SELECT p_partkey AS page_id, p_name || ' kit' AS title, 'Runs well.
Size ' || p_size AS description, 'Used ' || p_type AS condition, 'Dock ' || p_size AS location, 2 AS photo_count FROM part""")
def detail_views(spark, d):
    """Generic detail view of pages built from part."""
    html = F.concat(
        F.lit("<div class='page-title'><b>"), F.col("p_name"), F.lit("</b> kit</div><h1>Other</h1><div id='description'>Runs well.<br>Size "),
        F.col("p_size").cast("string"), F.lit("</div><span class='item-status'>Used "), F.col("p_type"),
        F.lit("</span><p class='pickup'>Dock "), F.col("p_size").cast("string"),
        F.lit("</p><img src='/img/1'><img src='/photo/2'><img src='/logo'>"))
    built = spread(spark, d, "part", "p_partkey", "p_name", "p_type", "p_size").select(
        F.col("p_partkey").alias("page_id"), F.lit("").alias("url"), html.alias("html"))
    return records.detail_fields(built).drop("url")


# --- index pages built from part, 25 cards a page -----------------------------------

def index_pages(spark, d) -> DataFrame:
    key, size = F.col("p_partkey").cast("string"), F.col("p_size")
    link = F.concat(F.lit("<a href='/sms/auction/view?auc="), key, F.lit("'>"))
    card = F.concat(
        F.lit("<li class='row'>"), link, F.lit("<img src='/x'></a><div>"), link, F.lit("View</a></div>"),
        F.lit("<p>#"), key, F.lit(" - "), title(), F.lit("<p>Bid: <b>$"), F.format_number("p_retailprice", 2), F.lit("</b>"),
        F.lit("<div>"), size.cast("string"), F.lit(" hours<br>"), F.when(size % 3 == 0, "AZ").otherwise("Tempe"),
        F.lit("</div><span>"), (size % 7).cast("string"), F.lit(" bids</span>"))
    cards_ = table(spark, d, "part").select(
        F.floor(F.col("p_partkey") / 25).alias("page_id"), F.struct("p_partkey", card.alias("html")).alias("card"))
    paged = cards_.groupBy("page_id").agg(F.array_sort(F.collect_list("card")).alias("cards"))
    return paged.select("page_id", F.concat(
        F.lit("<html><body><a href='/home'>Home</a><ul>"), F.array_join(F.col("cards.html"), ""), F.lit("</ul>")).alias("html"))


@query("""SELECT CAST(p_partkey AS VARCHAR) AS id,
  array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || x[2:]), ' ') || ' ' || p_partkey // 2 AS title,
  'https://www.publicsurplus.com/sms/auction/view?auc=' || p_partkey AS url, p_retailprice AS price,
  '$' || format('{:,.2f}', p_retailprice) AS price_str, p_size || ' hours' AS time_left, p_size % 7 AS bids,
  CASE WHEN p_size % 3 = 0 THEN 'AZ' END AS location,
  'View | #' || p_partkey || ' - ' || p_name || ' ' || p_partkey // 2 || ' | Bid: $' || format('{:,.2f}', p_retailprice) || ' | ' || p_size || ' hours | '
    || CASE WHEN p_size % 3 = 0 THEN 'AZ' ELSE 'Tempe' END || ' | ' || (p_size % 7) || ' bids' AS card_text
FROM part""")
def index_listings(spark, d):
    found = cards.listings_of(cards.scan_cards(index_pages(spark, d)))
    return first_per_key(found).filter(has_title(F.col("title"))).drop("pos")


# --- result pages built from orders ---------------------------------------------------

def price_pages(spark, d) -> DataFrame:
    total = F.col("o_totalprice")
    shown = F.format_number(total, 2)
    html = F.concat(
        F.lit("<ul><li><span class='s-item__price'>$"), shown, F.lit("</span><li><b class='x s-item__price'><i>$20.00</i> to <i>$"),
        F.format_number(F.floor(total % 1000) + 21, 2), F.lit("</i></b><li><span class='s-item__price'>Free</span>"),
        F.lit("<li><span class='s-item__prices'>$7</span></ul><span dir='auto'> $"), F.format_number(F.floor(total % 97) + 2, 0),
        F.lit("</span><span dir='auto'>Only $5</span><span>$6</span>"))
    return spread(spark, d, "orders", "o_orderkey", "o_orderpriority", "o_totalprice").select(
        F.col("o_orderpriority").alias("query"), F.col("o_orderkey").alias("page_id"), html.alias("html"))


@query("""WITH page AS (
  SELECT o_orderpriority AS query, o_orderkey AS page_id, o_totalprice AS t FROM orders),
price AS (
  SELECT query, page_id, 0 AS pos, 'ebay_sold' AS source, CASE WHEN t > 0.99 AND t < 50000 THEN t END AS price FROM page
  UNION ALL SELECT query, page_id, 1, 'ebay_sold', 20.0 FROM page
  UNION ALL SELECT query, page_id, 0, 'facebook_marketplace', floor(t % 97) + 2 FROM page)
SELECT * FROM price WHERE price IS NOT NULL""")
def scored_prices(spark, d):
    return prices.scored_prices(prices.scan_both(price_pages(spark, d))).drop("price_text")


@query("""WITH page AS (
  SELECT o_orderpriority AS query, o_orderkey AS page_id, o_totalprice AS t FROM orders),
price AS (
  SELECT query, page_id, 0 AS pos, CASE WHEN t > 1 AND t < 100000 THEN t END AS price FROM page
  UNION ALL SELECT query, page_id, 1, (41.0 + floor(t % 1000)) / 2 FROM page)
SELECT * FROM price WHERE price IS NOT NULL""")
def market_prices(spark, d):
    return prices.market_prices(prices.scan_sold(price_pages(spark, d))).select("query", "page_id", "pos", "price")


# --- pages to deals -------------------------------------------------------------------

def detail_pages(spark, d) -> DataFrame:
    """A detail page for every part; some say untested, some have a title that is too short."""
    key, size = F.col("p_partkey").cast("string"), F.col("p_size")
    html = F.concat(
        F.lit("<h1>"), F.when(size % 8 == 0, "abc").when(size % 2 == 0, F.upper(title())).otherwise(title()),
        F.lit("</h1><div class='item-desc'>"), F.when(size % 6 == 0, "Sold untested").otherwise("Works"), F.lit("</div>"))
    return spread(spark, d, "part", "p_partkey", "p_name", "p_size").select(
        F.col("p_partkey").alias("page_id"),
        F.concat(F.lit("https://www.publicsurplus.com/sms/auction/view?auc="), key).alias("url"), html.alias("html"))


def sold_titles(spark, d) -> DataFrame:
    """All sales of parts, under the listing's title and the part's brand."""
    names = table(spark, d, "part").select(
        F.col("p_partkey").alias("l_partkey"), F.concat_ws(" - ", title(), "p_brand").alias("title"))
    first = F.col("l_returnflag") == "R"
    return table(spark, d, "lineitem").join(names, "l_partkey").select(
        "title", F.when(first, S.PRIMARY_SOURCE).otherwise(S.SECONDARY_SOURCE).alias("source"), unit_price().alias("price"),
    ).filter(money.between_exclusive(F.col("price"), S.SCORER_BOUNDS))


# Words of more than two characters decide which sales belong to a listing.
SOUGHT_SQL = """p_name || CASE WHEN length(CAST(p_partkey // 2 AS VARCHAR)) > 2 THEN ' ' || p_partkey // 2 ELSE '' END"""


@query(f"""WITH named AS (SELECT *, {SOUGHT_SQL} AS sought FROM part),
sold AS (
  SELECT sought, p_name AS words, length(CAST(p_partkey // 2 AS VARCHAR)) > 2 AS numbered, l_returnflag, {UNIT_SQL} AS price
  FROM lineitem JOIN named ON p_partkey = l_partkey),
asked_query AS (SELECT DISTINCT sought, p_name AS words, length(CAST(p_partkey // 2 AS VARCHAR)) > 2 AS numbered FROM named),
matched AS (
  SELECT a.sought AS query, l_returnflag, price FROM asked_query a JOIN sold s ON a.sought = s.sought WHERE a.numbered
  UNION ALL SELECT a.sought, l_returnflag, price FROM asked_query a JOIN sold s ON a.words = s.words WHERE NOT a.numbered),
comp AS (
  SELECT * FROM (
    SELECT query, CASE l_returnflag WHEN 'R' THEN 'ebay_sold' ELSE 'facebook_marketplace' END AS source, price FROM matched)
  WHERE price > 0.99 AND price < 50000),
{STATS_SQL},
asked AS (
  SELECT CAST(p_partkey AS VARCHAR) AS id,
    CASE WHEN p_size % 8 = 0 THEN array_to_string(list_transform(string_split({TITLE_SQL}, ' '), lambda x: upper(x[1]) || x[2:]), ' ')
         WHEN p_size % 2 = 0 THEN upper({TITLE_SQL}) ELSE {TITLE_SQL} END AS title,
    p_retailprice AS price, CASE WHEN p_size % 6 = 0 THEN 'as-is' ELSE '' END AS card_text,
    sought AS query, sought AS query2, p_partkey AS pos
  FROM named QUALIFY row_number() OVER (PARTITION BY {TITLE_SQL} ORDER BY p_partkey) = 1),
{{SCORED}}, {{DEAL}}
SELECT row_number() OVER (ORDER BY profit_ratio DESC, pos) AS deal_number, id, title, price, comps_avg, comps_median, comps_count,
  resale_estimate, profit_ratio, est_profit, confidence, risk
FROM deal""".replace("{SCORED}", SCORED_SQL).replace("{DEAL}", DEAL_SQL))
def deals_from_pages(spark, d):
    """The whole deterministic scan: index and detail pages, sold titles, numbered deals."""
    found = deals.deals_from_pages(index_pages(spark, d), sold_titles(spark, d), detail_pages(spark, d), max_rows=None)
    return found.select(
        "deal_number", "id", "title", "price", "comps_avg", "comps_median", "comps_count",
        "resale_estimate", "profit_ratio", "est_profit", "confidence", F.array_join("risk_flags", ", ").alias("risk"))


# --- captures kept for lookup -----------------------------------------------------------

@query("""SELECT CASE WHEN p_size % 2 = 0 THEN p_partkey + 100000000 ELSE p_partkey END AS page_id,
  'https://www.publicsurplus.com/sms/auction/view?auc=' || p_partkey AS url, CAST(p_partkey AS VARCHAR) AS lot,
  CASE WHEN p_size % 2 = 0 THEN p_name || ' &' || p_brand ELSE 'First ' || p_partkey END AS title
FROM part WHERE p_partkey % 4 = 0""")
def latest_captures(spark, d):
    """Every part's page is captured, those of even size again later, and some captures are
    stored twice; all listing links are then looked up."""
    again = auction_pages(spark, d).join(
        table(spark, d, "part").filter("p_size % 2 = 0").select(F.col("p_partkey").alias("page_id")), "page_id", "left_semi")
    again = again.withColumn("page_id", F.col("page_id") + 100000000)
    title = F.concat(F.lit("<h1>First "), F.col("page_id").cast("string"), F.lit("</h1>"))
    store = fresh_path(spark, "captures")
    captures.keep(auction_pages(spark, d).withColumn("html", title), store, buckets=16)
    captures.keep(again.unionByName(again.filter("length(url) % 2 = 0")), store)
    found = records.extract_records(captures.latest(spark, store, part_listings(spark, d)))
    return records.accepted(found).select("page_id", "url", "lot", "title")
