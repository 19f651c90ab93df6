"""Captured pages laid out for lookup by link.

A store is a folder of Parquet files, partitioned by site and bucketed by (url, page_id).
Pages are shuffled once, when they are added. A lookup then finds the latest capture of
each link from the columns ``url`` and ``page_id`` alone and joins it to the stored pages
bucket by bucket: page bodies are read from the wanted sites only and never shuffled.

Buckets are dealt by both columns, so a link that is captured again and again is spread
over all buckets, and only its latest capture is ever joined. The number of buckets is
fixed when a store is started and kept beside it; the catalog entry that tells Spark about
the buckets is made anew in each session that opens the store.
"""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from resalelens.sources.records import SITE_RULES, UNKNOWN, site_of

BUCKETS = 256
KEYS = ["url", "page_id"]
LAYOUT = "_layout"


def _buckets(spark: SparkSession, path: str) -> int | None:
    try:
        return spark.read.schema("buckets INT").json(f"{path}/{LAYOUT}").first().buckets
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def is_store(spark: SparkSession, path: str) -> bool:
    return _buckets(spark, path) is not None


def stored(spark: SparkSession, path: str) -> DataFrame:
    """All captures of a store: ``page_id, url, html, site``."""
    buckets = _buckets(spark, path)
    if buckets is None:
        raise ValueError(f"no capture store in {path}")
    return spark.table(_table(spark, path, buckets))


def _table(spark: SparkSession, path: str, buckets: int) -> str:
    name = f"captures_{hashlib.md5(path.encode()).hexdigest()}"
    if not spark.catalog.tableExists(name):
        spark.sql(
            f"CREATE TABLE {name} (page_id BIGINT, url STRING, html STRING, site STRING) USING parquet PARTITIONED BY (site) "
            f"CLUSTERED BY (url, page_id) SORTED BY (url, page_id) INTO {buckets} BUCKETS LOCATION '{path}'")
        spark.catalog.recoverPartitions(name)
    return name


def keep(pages: DataFrame, path: str, rules=SITE_RULES, buckets: int = BUCKETS) -> None:
    """Add ``page_id, url, html`` to a store, which is started if there is none. Each task
    writes one bucket, so an addition makes one file per bucket and site."""
    spark = pages.sparkSession
    known = _buckets(spark, path)
    if known is None:
        spark.createDataFrame([(buckets,)], "buckets INT").coalesce(1).write.json(f"{path}/{LAYOUT}")
        known = buckets
    name = _table(spark, path, known)
    site = F.coalesce(site_of(F.col("url"), rules), F.lit(UNKNOWN))
    pages.select("page_id", "url", "html", site.alias("site")).repartition(known, *KEYS).write.insertInto(name)


def newest(captures: DataFrame, links: DataFrame) -> DataFrame:
    """``url, page_id`` of the latest capture of each link. Captures are narrowed to two
    columns and meet per link before the shuffle, whatever their number."""
    latest = captures.groupBy("url").agg(F.max("page_id").alias("page_id"))
    return latest.join(links.select("url").distinct(), "url", "left_semi")


def latest(spark: SparkSession, path: str, links: DataFrame, rules=SITE_RULES) -> DataFrame:
    """Latest stored capture of each link: ``page_id, url, html``, one row per captured link.

    Only the partitions of the sites of ``rules`` are opened for page bodies; links to other
    sites come without one. A capture that was stored twice counts once.
    """
    pages = stored(spark, path)
    sites = [r.site for r in rules]
    wanted = newest(pages, links).withColumn("_site", F.coalesce(site_of(F.col("url"), rules), F.lit(UNKNOWN)))
    bodies = pages.filter(F.col("site").isin(sites))
    read = (
        # The links of a bucket are hashed and the bucket's pages pass by, unsorted.
        bodies.join(wanted.filter(F.col("_site") != UNKNOWN).hint("shuffle_hash"), KEYS)
        .select("page_id", "url", "html").dropDuplicates(KEYS))
    others = wanted.filter(F.col("_site") == UNKNOWN).select("page_id", "url", F.lit(None).cast("string").alias("html"))
    return read.unionByName(others)


def latest_of(pages: DataFrame, links: DataFrame) -> DataFrame:
    """The same for a table of pages without a layout, whose bodies may be shuffled once."""
    return pages.select("page_id", "url", "html").join(newest(pages, links), KEYS).dropDuplicates(KEYS)
