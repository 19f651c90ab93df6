"""Capture store: lookups against plain Python, and their plans."""

import random
import re

import pytest
from pyspark.sql import functions as F

from resalelens.sources import captures, records

SCHEMA = "page_id LONG, url STRING, html STRING"
HOSTS = ["www.publicsurplus.com/v?id=", "www.bidspotter.com/lots/", "www.ironplanet.com/item/", "other.example/"]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def address(k):
    return f"https://{HOSTS[k % 4]}{k}"


def captured(rng, n):
    """Links captured up to many times, one of them in a third of all rows; some rows twice."""
    rows = []
    for page_id in range(n):
        k = 4 if rng.random() < .33 else rng.randrange(60)
        rows.append((page_id, address(k), f"<h1>{page_id}</h1>"))
    return rows + rows[:20]


@pytest.fixture
def store(spark, tmp_path):
    rows = captured(random.Random(3), 500)
    path = f"{tmp_path}/store"
    captures.keep(frame(spark, rows[:300]), path, buckets=5)
    captures.keep(frame(spark, rows[300:]), path)
    return path, rows


def test_latest_capture_of_each_link(spark, store):
    path, rows = store
    links = [address(k) for k in range(0, 80, 3)]
    newest = {}
    for page_id, url, html in rows:
        if url in links and page_id >= newest.get(url, (-1, ""))[0]:
            newest[url] = (page_id, None if "other" in url else html)
    asked = spark.createDataFrame([(u,) for u in links * 2], "url STRING")
    got = captures.latest(spark, path, asked).collect()
    assert len(got) == len(newest) and {r.url: (r.page_id, r.html) for r in got} == newest
    plain = captures.latest_of(frame(spark, rows), asked).collect()
    assert {r.url: r.page_id for r in plain} == {u: i for u, (i, _) in newest.items()} and len(plain) == len(newest)


def formatted(df):
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.mark.parametrize("broadcast", ["-1", "10m"])
def test_bodies_are_not_shuffled_and_sites_are_pruned(spark, store, broadcast):
    path, _ = store
    known = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        links = spark.range(40).select(F.concat(F.lit("https://www.ironplanet.com/item/"), F.col("id")).alias("url"))
        plan = formatted(captures.latest(spark, path, links, rules=records.SITE_RULES[:1]))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", known)
    moved = re.findall(r"\) (?:Broadcast)?Exchange\n(.*?)\n\n", plan, re.S)
    assert moved and not any("html" in m for m in moved)
    scans = [s for s in re.findall(r"\) Scan parquet.*?\n\n", plan, re.S) if "html" in s]
    assert len(scans) == 1 and re.search(r"PartitionFilters: .*site.*ironplanet", scans[0]) and "SelectedBucketsCount: 5 out of 5" in scans[0]
    narrow = [s for s in re.findall(r"\) Scan parquet.*?\n\n", plan, re.S) if "page_id" in s and "html" not in s]
    assert narrow and all("ReadSchema: struct<page_id:bigint,url:string>" in s for s in narrow)


def test_store_is_found_again(spark, store):
    """A session without a catalog entry for the store reads the same."""
    path, rows = store
    before = captures.stored(spark, path).count()
    name = captures._table(spark, path, 5)
    spark.sql(f"DROP TABLE {name}")
    assert captures.stored(spark, path).count() == before == len(rows)
    assert captures.stored(spark, path).filter("site = 'bidspotter'").count() == sum("bidspotter" in u for _, u, _ in rows)


def test_nulls_empty_tables_and_missing_stores(spark, tmp_path):
    path = f"{tmp_path}/s"
    assert not captures.is_store(spark, path)
    with pytest.raises(ValueError):
        captures.stored(spark, path)
    captures.keep(frame(spark, []), path, buckets=2)
    links = spark.createDataFrame([(address(0),), (None,)], "url STRING")
    assert captures.latest(spark, path, links).collect() == []
    captures.keep(frame(spark, [(1, None, "x"), (2, address(0), None), (None, address(0), "y")]), path)
    assert [tuple(r) for r in captures.latest(spark, path, links).collect()] == [(2, address(0), None)]
