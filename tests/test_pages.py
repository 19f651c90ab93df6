"""Hand-written pages with the records expected of them."""

import json
import os
import random
from dataclasses import replace
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from resalelens import settings as S
from resalelens.operators.first import first_per_key
from resalelens.sources import cards, config, dom, links, logs, prices, records
from resalelens.sources import found as found_source
from resalelens.plans import report, scan
from workload import page_queries, scan_queries


def pages(spark, *rows, schema="page_id LONG, url STRING, html STRING"):
    return spark.createDataFrame(list(rows), schema)


def record(spark, url, html, **kw):
    df = records.with_sentinels(records.extract_records(pages(spark, (1, url, html)), **kw))
    return df.first().asDict()


LAYOUT_A = """<html><head><title>x</title><script>var s = "$9";</script></head><body>
<!-- High Bid $8 --><h1> Table <b>saw</b>
</h1><h2>no</h2>
<p>Current Bid: $0.00</p><p>Minimum Bid <b>(2 bids)</b> $1,250.50</p>
<div>Closing soon</div><div><span>Auction Ends: </span>on 3/14/26</div><div>Auction Ends 3/15/2026</div>
<div> Agency: <i>City of</i> Tempe </div><div>Location: elsewhere</div>
<img src="/Photo/1.jpg"><img src="/logo.png"><img src="/Photo/1.jpg"><img alt="photo"></body></html>"""


def test_layout_a(spark):
    r = record(spark, "https://www.publicsurplus.com/sms/auction/view?auc=77&id=5", LAYOUT_A)
    assert r["site"] == "publicsurplus" and r["title"] == "Tablesaw" and r["lot"] == "5"
    assert r["current_bid"] == 1250.5
    assert r["end_date"] == "3/15/2026"      # the span's own text has no date
    assert r["location"] == "Agency:City ofTempe"
    assert r["photos"] == ["/Photo/1.jpg", "/Photo/1.jpg"] and r["description"] == "" and r["error"] is None
    assert record(spark, "https://www.publicsurplus.com/x", LAYOUT_A, loose=True)["current_bid"] == 2.0
    assert record(spark, "https://www.publicsurplus.com/v?auc=77", LAYOUT_A)["lot"] == "77"


LAYOUT_B = """<body><h2>Lathe &amp; tools</h2><div>Starting Bid: <em>USD</em> 1,040.00</div>
<ul><li>End Time 12/01/2026 10:00</li></ul>
<table><tr><th>Location</th> <td> Houston,
 <b>TX</b> </td></tr></table>
<img src="/img/a.jpg"><img src="/img/a.jpg"><img src="http://cdn/x/LOT9.png"><img src="/z.gif">
<section class="details">S</section><div class="big lot-info">""" + "word " * 600 + "</div>"


def test_layout_b(spark):
    r = record(spark, "https://www.bidspotter.com/en-us/x/lots/ab12?x", LAYOUT_B, max_description=S.MAX_DESCRIPTION)
    assert (r["title"], r["lot"], r["current_bid"], r["end_date"]) == ("Lathe & tools", "ab12", 1040.0, "12/01/2026")
    assert r["location"].replace("\n ", "\n") == "Houston,TX"
    assert r["photos"] == ["https://www.bidspotter.com/img/a.jpg", "http://cdn/x/LOT9.png"]
    assert len(r["description"]) == 2000 and r["description"].startswith("word word")


def test_layout_b_location_without_sibling_and_section(spark):
    html = "<h1></h1><h2>second</h2><div><span>Pickup at dock 3</span></div><section class=Details>Good <b>one</b></section>"
    r = record(spark, "https://www.bidspotter.com/a", html)
    assert (r["title"], r["location"], r["description"]) == ("", "Pickup at dock 3", "Good one")
    assert (r["lot"], r["current_bid"], r["end_date"], r["photos"]) == ("", 0.0, "", [])


LAYOUT_C = """<body><h1>Excavator</h1><p>Reserve Price</p><p>Buy Now <b>$45,000</b></p><p>Sale Date: 1/2/2026</p>
<span>Country</span><span> </span><b>Region</b><i>West</i><div class="Specs">Hours <i>12</i></div>
<img src="/equipment/1.png"><img src="/equipment/2.png">"""


@pytest.mark.parametrize("url, lot", [
    ("https://www.ironplanet.com/item/123?x", "123"),
    ("https://www.ironplanet.com/jsp/s/item.ips?itemId=456", "456"),
    ("https://www.ironplanet.com/other", ""),
])
def test_layout_c(spark, url, lot):
    r = record(spark, url, LAYOUT_C)
    assert (r["title"], r["lot"], r["current_bid"], r["end_date"]) == ("Excavator", lot, 45000.0, "1/2/2026")
    assert (r["location"], r["description"]) == ("West", "Hours 12")
    assert r["photos"] == [f"https://www.ironplanet.com/equipment/{i}.png" for i in (1, 2)]


def test_photos_and_location_are_cut(spark):
    html = "<h1>x</h1><p>Location: " + "y" * 200 + "</p>" + "".join(f"<img src='/photo{i}'>" for i in range(15))
    r = record(spark, "https://www.publicsurplus.com/x", html, **S.RECORD_LIMITS)
    assert len(r["location"]) == 100 and r["photos"] == [f"/photo{i}" for i in range(10)]
    r = record(spark, "https://www.publicsurplus.com/x", html)
    assert len(r["location"]) == 210 and len(r["photos"]) == 15


def test_unsupported_host_and_route_order(spark):
    df = records.extract_records(pages(
        spark, (1, "https://x.example/", "<h1>x</h1>"),
        (2, "https://www.ironplanet.com/item/1?from=publicsurplus.com", "<h1>y</h1>"), (3, None, None)))
    assert [(r["url"], r["site"], r["error"]) for r in records.rejects(df).orderBy("url").collect()] == [
        (None, "unknown", "Unsupported site"), ("https://x.example/", "unknown", "Unsupported site")]
    assert [r["site"] for r in records.accepted(df).collect()] == ["ironplanet"]


def test_malformed_pages_keep_their_neighbours(spark):
    html = ["<p>one<p>two &lt;b&gt; </b></div><h1>T", "<![weird[x]><h1>lost</h1>", "", "<h1>ok</h1>", "plain < text & more"]
    df = dom.page_nodes(pages(spark, *[(i, "", h) for i, h in enumerate(html)]))
    title = dom.clean_text(F.col("nodes"), dom.first_position(F.col("nodes"), lambda n: dom.is_element(n, "h1")))
    got = dict(map(tuple, df.select("page_id", title).collect()))
    assert got[0] == "T" and got[2] is None and got[3] == "ok" and len(got) == 5
    texts = dom.node_rows(df).filter("page_id = 4 AND text IS NOT NULL").select("text").collect()
    assert [r.text for r in texts] == ["plain < text & more"]


def test_script_text_is_no_element_text(spark):
    df = dom.page_nodes(pages(spark, (1, "", "<div>a<script>b</script><!-- c --><style>d</style>e</div>")))
    assert df.select(dom.raw_text(F.col("nodes"), F.lit(1))).first()[0] == "ae"


@pytest.mark.parametrize("html, bid", [
    ("<script>x = 'High Bid 9'</script><p>Current Bid $5</p>", 9.0),          # a script's own text counts
    ("<div><!-- Current Bid --><script>7</script>now $5</div>", 5.0),          # a comment labels its parent
    ("Current Bid <b>$4</b> left", 4.0),                                        # a bare label has the whole page
    ("<template><p>Current Bid $9</p></template><p>Current Bid $5</p>", 5.0),
])
def test_labels_in_hidden_text(spark, html, bid):
    assert record(spark, "https://www.publicsurplus.com/x", html)["current_bid"] == bid


INDEX = """<a href="/home">Home</a><table><tr><td><a href="/sms/auction/view?auc=1"><img></a></td><td>#1 - OLD drill</td><td>$5.00</td></tr>
<tr><td><a href="/sms/auction/view?auc=1">again</a><td>x</table>
<div class="big ps-card"><p><a href="https://www.publicsurplus.com/sms/auction/view?auc=2">Band saw</a><p>Price $1,200.50 or $7<div>2 Days</div><b>AZ</b><br>3 bids</div>
<div><a href="/auction/view/9"> Lone <i>link</i> </a>beside</div><a>no link</a>"""


def test_index_cards(spark):
    df = cards.scan_cards(pages(spark, (1, "", INDEX)))
    got = {r["pos"]: r for r in df.collect()}
    assert [got[i]["href"] for i in range(4)] == [
        "/sms/auction/view?auc=1", "/sms/auction/view?auc=1",
        "https://www.publicsurplus.com/sms/auction/view?auc=2", "/auction/view/9"]
    assert got[0]["card_lines"] == ["#1 - OLD drill\t$5.00"] and got[0]["price_str"] == "$5.00"
    assert got[2]["card_lines"] == ["Band saw", "Price $1,200.50 or $7", "2 Days", "AZ", "3 bids"]
    assert (got[3]["card_lines"], got[3]["price_str"], got[3]["anchor_text"]) == (["Lone link beside"], "", "Lone link")

    listings = {r["id"]: r for r in first_per_key(cards.listings_of(df)).collect()}
    assert set(listings) == {"1", "2", "https://www.publicsurplus.com/auction/view/9"}
    two = listings["2"]
    assert (two["title"], two["price"], two["time_left"], two["bids"], two["location"]) == ("Band saw", 1200.5, "2 Days", 3, "AZ")
    assert listings["1"]["title"] == "Old Drill\t$5.00".title()
    assert listings["https://www.publicsurplus.com/auction/view/9"]["price"] is None


def test_detail_fields(spark):
    html = """<p class="subtitle">First</p><h1>Second</h1><div id="description">A<br>B</div><p class="status-line">Used</p>
    <p class="agency">Dock</p><img src="/img/1"><img src="/auction/2"><img src="/logo"><img>"""
    r = records.detail_fields(pages(spark, (1, "u", html), (2, "v", ""))).orderBy("page_id").collect()
    assert tuple(r[0])[2:] == ("First", "A\nB", "Used", "Dock", 2)
    assert tuple(r[1])[2:] == (None, None, None, None, 0)


def test_prices_in_page_order(spark):
    html = """<span class="s-item__price">$5.00</span><span class="a s-item__price"><i>$50.00</i> to <i>$75.00</i></span>
    <span class="s-item__prices">$9</span><span class="s-item__price">free</span><span dir="auto">$3</span><span dir="auto">was $4</span>"""
    df = pages(spark, ("q", 1, html), schema="query STRING, page_id LONG, html STRING")
    texts = lambda d: [r["price_text"] for r in d.orderBy("pos").collect()]
    assert texts(prices.scan_sold(df)) == ["$5.00", "$50.00 to $75.00", "free"]
    assert texts(prices.scan_sold(df, rendered=False)) == ["$5.00", "$50.00to$75.00", "free"]
    assert texts(prices.scan_current(df)) == ["$3"]
    assert [r["price"] for r in prices.scored_prices(prices.scan_sold(df)).orderBy("pos").collect()] == [5.0, 50.0]
    assert [r["price"] for r in prices.market_prices(prices.scan_sold(df)).orderBy("pos").collect()] == [5.0, 62.5]


def test_links_with_quotes_and_references(spark):
    html = """<a title='a>b' href='/x'>one &eacute;</a><a data-href="/no" href="/y&#x27;&#8211;?a=1&amp;b&copy=2&copy;">t<b title="<i>">wo</b></a>
      <a title="open href=/z>three</a><a href=/w&lt;>&nbsp;four &notit; five</a>"""
    df = spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id LONG, html STRING")
    got = [(r["href"], r["text"]) for r in links.scan_links(df).orderBy("pos").collect()]
    assert ("/x", "one é") in got and ("/y'–?a=1&b&copy=2©", "two") in got and ("/w<", "four ¬it; five") in got


def test_links(spark):
    html = """<!-- <a href="/c">c</a> --><script>"<a href='/s'>"</script><A class=x HREF='/a?x=1&amp;y=2'> One <b>two</b></A>
    <a name=n>none</a><a href=/plain>pl</a><abbr href="/no">z</abbr><a href="/a?x=1&amp;y=2">again</a><a data-href="/no" href="/z">open"""
    df = pages(spark, (1, "", html))
    got = [(r["href"], r["text"]) for r in links.scan_links(df).orderBy("pos").collect()]
    assert got == [("/a?x=1&y=2", "One two"), ("/plain", "pl"), ("/a?x=1&y=2", "again"), ("/z", "open")]
    assert [r["href"] for r in links.distinct_links(df).orderBy("pos").collect()] == ["/a?x=1&y=2", "/plain", "/z"]
    assert [r["text"] for r in links.named_links(links.scan_links(df)).orderBy("pos").collect()] == ["One two", "again", "open"]
    assert tuple(links.link_counts(df, r"\?").first()) == (1, 3, 1)
    assert [r["href"] for r in links.first_links(df, 1, "^/[pz]").collect()] == ["/plain"]


def test_references_without_semicolon(spark):
    df = pages(spark, (1, "", "<a href='/x?a=1&amplitude=2&amp'>A &amp B&amp</a>"))
    r = links.scan_links(df).first()
    assert (r["href"], r["text"]) == ("/x?a=1&amplitude=2&", "A & B&")


# --- config, state, logs, sinks -------------------------------------------------------

def test_config(spark, tmp_path):
    path = tmp_path / "config.json"
    path.write_text(json.dumps({
        "max_bid": 900, "your_zip": "77001", "markup_percent": 80,
        "searches": [{"keywords": "forklift", "category": "M", "state": "TX", "min_bid": 0, "max_bid": 5000}, {"category": "E"}]}, indent=1))
    df = config.read_config(spark, str(path))
    r = df.first()
    assert (r["max_bid"], r["your_zip"], r["min_profit"], r["max_listings_per_search"]) == (900.0, "77001", 100.0, 3)
    entries = config.searches_of(df).orderBy("search_id").collect()
    assert tuple(entries[0]) == (0, "forklift", "M", "TX", 0.0, 5000.0)
    assert tuple(entries[1]) == (1, None, "E", None, None, None)
    default = config.read_config(spark, str(tmp_path / "missing.json"))
    assert default.first()["max_bid"] == 1500.0 and config.searches_of(default).count() == 3


ITEM = ("t", "l", "s", "u1", 10.0, 200.0, 190.0, "Tempe", None, ["p1", "p2"])


def test_found_items_round_trip(spark, tmp_path):
    path = str(tmp_path / "found")
    assert found_source.read_found(spark, path).count() == 0
    batch = spark.createDataFrame(
        [(*ITEM, 1), (*ITEM[:3], "u2", *ITEM[4:], 2), (*ITEM[:3], "", *ITEM[4:], 3)], found_source.ITEM_SCHEMA + ", pos INT")
    found_source.append_found(batch, path)
    found_source.append_found(batch, path)
    assert sorted(r["url"] for r in found_source.read_found(spark, path).collect()) == ["u1", "u2"]


def test_items_document(spark, tmp_path):
    items = spark.createDataFrame([ITEM], found_source.ITEM_SCHEMA)
    doc = json.loads(found_source.items_lines(scan.items_out(items)).first()["json"])
    assert doc == {"title": "t", "lot": "l", "site": "s", "url": "u1", "bid": 10.0, "market_value": 200.0,
                   "profit": 190.0, "pickup": "Tempe", "ends": "", "photos": ["p1", "p2"]}
    found_source.write_items(items.filter("false"), str(tmp_path / "none"))
    assert spark.read.text(str(tmp_path / "none")).count() == 0
    found_source.write_items(spark.range(120_000).select(F.col("id").cast("string").alias("url")), str(tmp_path / "many"))
    assert spark.read.text(str(tmp_path / "many")).count() == 120_000
    found_source.write_deals(items, str(tmp_path / "deals"))
    assert spark.read.json(str(tmp_path / "deals")).first()["url"] == "u1"


def test_item_block(spark):
    block = report.item_block(spark.createDataFrame([ITEM], found_source.ITEM_SCHEMA)).first()["block"]
    assert block == ("ITEM: t | LOT: l | SITE: s | URL: u1\nBID: $10 | MARKET VALUE: $200 | EST. PROFIT: $190 | ENDS: \n"
                     "PICKUP: Tempe\nPHOTOS: p1 p2")


def test_items_from_logs(spark):
    good = '{"url": "a", "bid": 1}'
    texts = [
        (1, f'x ```json\n{{"items": [{good}, {{"url": "b"}}]}}\n``` y ```json\n{{"items": []}}\n```'),
        (2, f"```json [{good}] ```"), (3, '```json\n{"items": [}\n```'), (4, "none"),
        (5, '```json\n{"items": []}\n```'), (6, f'```json\n[{good}, ]\n```'), (7, None)]
    df = logs.extract_items(spark.createDataFrame(texts, "run_id LONG, text STRING"))
    assert [(r["run_id"], r["pos"], r["url"], r["bid"]) for r in df.orderBy("run_id", "pos").collect()] == [
        (1, 0, "a", 1.0), (1, 1, "b", None), (2, 0, "a", 1.0)]


def test_scan_filters(spark):
    schema = ("title STRING, lot STRING, site STRING, url STRING, current_bid DOUBLE, end_date STRING, location STRING, "
              "photos ARRAY<STRING>, description STRING, error STRING")
    def rec(url, title="saw", bid=100.0, end="3/1/2026", error=None):
        return (title, "1", "s", url, bid, end, "Tempe", ["p"], "", error)
    df = spark.createDataFrame([
        rec("ok"), rec("zero", bid=0.0), rec("null", bid=None), rec("at max", bid=1500.0), rec("no date", end=""),
        rec("soon", end="1/2/2026"), rec("truck", title="truck"), rec("bad", error="x"), rec("thin", bid=450.0),
        rec("unknown", title="never sold")], schema)
    sold = spark.createDataFrame([("saw", 1, 490.0), ("saw", 2, 510.0)], "item STRING, pos INT, price DOUBLE")
    got = scan.scan(df, sold, F.lit("2026-01-01 12:00:00").cast("timestamp")).collect()
    assert [(r["url"], r["market_value"], r["profit"], str(r["ends"])) for r in got] == [("ok", 500.0, 400.0, "2026-03-01")]


def test_bounds_are_fixed():
    assert S.SCORER_BOUNDS == (0.99, 50000.0) and S.MARKET_BOUNDS == (1.0, 100000.0)


def test_plan_does_not_grow_with_rules(spark):
    """Three and two hundred rules give plans of the same size, and pages find their rule."""
    many = tuple(replace(records.SITE_RULES[0], site=f"s{i}", host=f"host{i}.example") for i in range(200))
    df = pages(spark, (1, "https://a.host7.example/item/5", "<h1>x</h1>"), (2, "https://host199.example/", "<h1>y</h1><p>Buy Now 7</p>"))
    few, all_ = (records.extract_records(df, rules)._jdf.queryExecution().executedPlan().treeString() for rules in (many[:3], many))
    assert len(few.splitlines()) == len(all_.splitlines()) and all_.count("CASE") == few.count("CASE")
    got = records.extract_records(df, many).orderBy("page_id").collect()
    assert [(r.site, r.title, r.lot, r.current_bid) for r in got] == [("s7", "x", "5", None), ("s199", "y", None, 7.0)]


def test_items_of_all_blocks(spark):
    def block(body):
        return f"said:\n```json\n{body}\n```\n"
    texts = [
        (1, block('{"items": [{"title": "a } b", "bid": 5, "color": "red"}, 7, {"bid": "much", "photos": ["p"], "url": null}]}') + block('[{"title": "c"}]')),
        (2, block('{"items": [ }') + block('{"other": 1}') + block('{"items": []}') + block('{"items": null}')),
        (3, "no block"), (4, None), (5, ""), (6, block("[null]")),
        (7, block('[{"title": "' + "x" * 200_000 + '"}]')),
    ]
    df = logs.all_items(spark.createDataFrame(texts, "run_id LONG, text STRING"))
    got = {(r.run_id, r.block, r.pos): (r.error, r.mistyped, r.bid) for r in df.collect()}
    assert got == {
        (1, 0, 0): (None, [], 5.0), (1, 0, 1): ("not an object", None, None), (1, 0, 2): (None, ["bid"], None),
        (1, 1, 0): (None, [], None), (2, 0, 0): ("not json", None, None), (2, 1, 0): ("no list", None, None),
        (2, 3, 0): ("no list", None, None), (6, 0, 0): ("not an object", None, None), (7, 0, 0): (None, [], None)}
    first = df.filter("run_id = 1 AND block = 0 AND pos = 0").selectExpr("variant_get(item, '$.color', 'string') c", "title").first()
    assert tuple(first) == ("red", "a } b")
    assert df.filter("run_id = 1 AND pos = 2").first().photos == ["p"]
    assert df.filter("run_id = 7").selectExpr("length(title) n").first().n == 200_000


def test_pages_are_made_on_all_cores(spark):
    """One small file is one task; the pages made from its rows are not."""
    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("driver tables not present")
    for make in (page_queries.auction_pages, page_queries.detail_pages, page_queries.price_pages, scan_queries._run_logs, scan_queries._block_logs):
        rows = make(spark, d).groupBy(F.spark_partition_id()).count().collect()
        assert len(rows) >= spark.sparkContext.defaultParallelism, make.__name__


def test_prices_of_both_kinds_in_one_pass(spark):
    html = "<b class='x s-item__price'> $1 </b><i class='s-item__prices'>$2</i><span dir=auto>$3</span><span dir='auto'>no</span><span dir='auto'>$4</span>"
    built = spark.createDataFrame([("q", 1, html), ("r", 2, None)], "query STRING, page_id LONG, html STRING")
    both = prices.scan_both(built)
    apart = prices.scan_sold(built).unionByName(prices.scan_current(built))
    got = sorted(map(tuple, both.select(apart.columns).collect()))
    assert got == sorted(map(tuple, apart.collect())) and both.schema == apart.select(both.columns).schema
    assert sorted((r.source, r.pos, r.price_text) for r in both.collect()) == [
        ("ebay_sold", 0, "$1"), ("facebook_marketplace", 0, "$3"), ("facebook_marketplace", 2, "$4")]
    assert str(both._jdf.queryExecution().executedPlan()).count("MapInArrow") == 1


def test_plain_tags_read_as_the_library_reads_them():
    class Library(dom._Nodes):
        parse_starttag, parse_endtag = HTMLParser.parse_starttag, HTMLParser.parse_endtag

    bits = [
        "<p>", "<P Class='a b'>", '<a href="x?a&amp;b">', "<a href='y' id=z>", "<br/>", "</p>", "</P >", "</a>", "<script>", "</script>",
        "<style x='y'>", "</style>", "text ", "&lt;", "<", "<!--c-->", "<a title='>' class='k'>", "<x a='", "'>", '"', "<li>", '<td class="">',
        "<div\tid='i'\nclass=\"c\" >", "<textarea>", "</>", "<p", "<a href='1'class='2'>", "<a dir='' dir='auto'>"]
    rng = random.Random(1)
    for k in range(3000):
        html = "".join(rng.choices(bits, k=rng.randint(1, 14)))
        assert dom._Nodes(k % 2 == 0).read(html) == Library(k % 2 == 0).read(html), html


def test_plain_pages_are_read_without_the_library(monkeypatch):
    """A page is walked tag by tag as far as it is plain; the nodes are those of the library."""
    class Library(dom._Nodes):
        def _read_plain(self, html):
            return 0

    bits = [
        "<p>", "<P Class='a card'>", '<a href="x?a&amp;b">', "<br>", "<br/>", "</p>", "</P >", "<script>", "</script>", "<template>",
        "</template>", "text ", "&lt;", "&am", " ", "<", ">", "<!--c-->", "<!-- a-b -->", "<!-->", "<!DOCTYPE html>", "<![CDATA[x]]>",
        "<li>", "<td>", "<tr>", "<hr>", "</tr>", "<title>", "</title>", "<img src='/1'>", "<div class='x" + "y" * 300 + "'>", "</div>"]
    rng = random.Random(2)
    for k in range(4000):
        html = "".join(rng.choices(bits, k=rng.randint(0, 16)))
        assert dom._Nodes(k % 2 == 0).read(html) == Library(k % 2 == 0).read(html), html

    plain = "<!DOCTYPE html><html><!-- Closing --><h1> A &amp; <b>B</b></h1><ul><li class='card'>x<li>y</ul><img src='/1'>Location &lt;"
    want = Library(True).read(plain)
    monkeypatch.setattr(HTMLParser, "feed", lambda self, html: pytest.fail(html) if html else None)
    assert dom._Nodes(True).read(plain) == want


def test_labels_of_texts_seen_before_are_remembered():
    reader = records._Reader(records.SITE_RULES[1])
    page = dom._Nodes(False).read("<h1>x</h1><td>Current Bid</td>$5<p>Closing 1/2/2026</p><i>Agency: " + "y" * 100 + "</i>")
    first = reader.read(page, "?id=1")
    assert reader.read(page, "?id=1") == first
    assert first[2:5] == (["Current Bid"], ["Closing 1/2/2026"], "Agency: " + "y" * 100)
    found = reader.kinds.cache_info()
    assert (found.misses, found.hits) == (4, 4)     # the long text is not kept


@pytest.mark.parametrize("build", [page_queries.auction_pages, scan_queries._run_logs])
def test_queries_deal_short_rows_over_all_cores(spark, build):
    """A small file is one task; the pages and texts made of its rows are not."""
    built = build(spark, "/root/testdata/sf0.001")
    assert built.select(F.spark_partition_id()).distinct().count() >= spark.sparkContext.defaultParallelism
