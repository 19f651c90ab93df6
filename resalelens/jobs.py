"""Jobs for ``spark-submit resalelens/jobs.py <job> ...``: tables in, tables out.

deals   index pages, sold titles and optional detail pages to ranked deals
scan    listings, pages, sold prices and found items to new items
post    numbered items to posting rows under the daily cap, and the report of attempts
watch   newly captured detail pages to the found-records table, as a stream
keep    captured pages into a store that later scans look links up in
"""

from __future__ import annotations

import argparse
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession, functions as F  # noqa: E402

from resalelens import settings as S  # noqa: E402
from resalelens.operators.search import in_state  # noqa: E402
from resalelens.operators.storage import written  # noqa: E402
from resalelens.plans import deals, post, report, scan  # noqa: E402
from resalelens.session import session  # noqa: E402
from resalelens.sources import captures, config, found, records  # noqa: E402
from resalelens.streaming import incremental  # noqa: E402

PAGE_SCHEMA = "page_id LONG, url STRING, html STRING"


def run_deals(spark: SparkSession, a: argparse.Namespace) -> None:
    details = spark.read.parquet(a.details) if a.details else None
    near, seen = None, deals.Funnel() if a.funnel else None
    if a.hours is not None or a.radius is not None:
        if a.radius is not None and not (a.zip and a.zips):
            raise SystemExit("--radius needs --zip and --zips")
        zips = spark.read.parquet(a.zips) if a.radius is not None else None
        near = lambda listings: scan.within_reach(listings, a.hours, zips, a.zip, a.radius)
    ranked = deals.deals_from_pages(
        spark.read.parquet(a.index), spark.read.parquet(a.sold), details, a.max,
        min_ratio=a.min_ratio, min_profit=a.min_profit, reach=near, funnel=seen)
    if a.json:
        found.write_deals(ranked, a.out)
    else:
        report.deal_report(ranked).write.mode("overwrite").parquet(a.out)
    if a.funnel:
        seen.rows(spark).coalesce(1).write.mode("overwrite").json(a.funnel)


def run_scan(spark: SparkSession, a: argparse.Namespace) -> None:
    table = config.read_config(spark, a.config)
    row = table.drop("searches").first()   # one row of parameters
    params = S.ScanConfig(**row.asDict(), searches=())
    known = found.read_found(spark, a.found, but=a.run_id)
    searches = in_state(config.searches_of(table), params.state)
    links = scan.links_to_fetch(spark.read.parquet(a.listings), searches, known, params.max_listings_per_search)
    if captures.is_store(spark, a.pages):
        pages = captures.latest(spark, a.pages, links)
    else:
        pages = captures.latest_of(spark.read.parquet(a.pages), links)
    centroids = spark.read.parquet(a.zips) if a.zips else None
    as_of = F.lit(a.as_of).cast("timestamp") if a.as_of else F.current_timestamp()
    read = written(records.extract_records(pages, **S.RECORD_LIMITS), "records")
    if a.rejects:
        records.rejects(read).write.mode("overwrite").parquet(a.rejects)
    items = written(scan.scan(read, spark.read.parquet(a.prices), as_of, params, centroids), "items")
    if a.document:
        found.write_items_document(scan.items_out(items), a.out, a.document)
    else:
        found.write_items(scan.items_out(items), a.out)
    found.append_found(items, a.found, order="url", run=a.run_id)


def run_keep(spark: SparkSession, a: argparse.Namespace) -> None:
    captures.keep(spark.read.parquet(a.pages), a.store, buckets=a.buckets)


def run_post(spark: SparkSession, a: argparse.Namespace) -> None:
    params = config.read_config(spark, a.config).first()   # one row of parameters
    post.export(spark.read.parquet(a.items), a.choice, params["your_city_state"], params["max_daily_posts"]).write.mode(
        "overwrite").parquet(a.out)
    if a.attempts and a.report:
        post.posted(spark.read.parquet(a.attempts), params["max_daily_posts"]).write.mode("overwrite").parquet(a.report)


def run_watch(spark: SparkSession, a: argparse.Namespace) -> None:
    pages = incremental.captures(spark, a.pages, spark.createDataFrame([], PAGE_SCHEMA).schema, a.files)
    read = records.extract_records(pages, **S.RECORD_LIMITS)
    incremental.keep_records(read, a.found, a.state, a.rejects).awaitTermination()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    jobs = p.add_subparsers(dest="job", required=True)

    d = jobs.add_parser("deals")
    d.add_argument("--index", required=True, help="pages: page_id, html")
    d.add_argument("--sold", required=True, help="sold titles: title, source, price")
    d.add_argument("--details", help="pages: page_id, url, html")
    d.add_argument("--out", required=True)
    d.add_argument("--min-ratio", type=float, default=S.MIN_RATIO)
    d.add_argument("--min-profit", type=float, default=S.MIN_PROFIT)
    d.add_argument("--max", type=int, help="row cap; none by default")
    d.add_argument("--hours", type=int, help="only listings whose card says that they close within so many hours")
    d.add_argument("--zip", help="home code, for --radius")
    d.add_argument("--radius", type=float, help="only listings whose card names a code within so many miles of home")
    d.add_argument("--zips", help="centroids: zip, lat, lon")
    d.add_argument("--funnel", help="where the counts of the steps go")
    d.add_argument("--json", action="store_true", help="raw deals as JSON lines instead of report rows")
    d.set_defaults(run=run_deals)

    s = jobs.add_parser("scan")
    s.add_argument("--config", default="config.json")
    s.add_argument("--listings", required=True, help="url, title, category, state, price, pos")
    s.add_argument("--pages", required=True, help="page_id, url, html: a table, or a store of the keep job")
    s.add_argument("--prices", required=True, help="sold prices: item, pos, price")
    s.add_argument("--found", required=True, help="found-items table, read and added to")
    s.add_argument("--zips", help="centroids: zip, lat, lon")
    s.add_argument("--as-of", help="time of the scan, now by default")
    s.add_argument("--rejects", help="table of pages that gave no record, with the reason")
    s.add_argument("--run-id", help="name of the run: repeated after a failure, it gives the same items and replaces its own found items")
    s.add_argument("--document", type=int, help="write so many JSON objects with items, instead of JSON lines")
    s.add_argument("--out", required=True)
    s.set_defaults(run=run_scan)

    q = jobs.add_parser("post")
    q.add_argument("--config", default="config.json")
    q.add_argument("--items", required=True, help="items numbered in n")
    q.add_argument("--choice", default="all", help="all, none, or numbers such as 1,3,5")
    q.add_argument("--attempts", help="posted_on, n, title, ok, reason")
    q.add_argument("--report", help="where the report of the attempts goes")
    q.add_argument("--out", required=True)
    q.set_defaults(run=run_post)

    w = jobs.add_parser("watch")
    w.add_argument("--pages", required=True, help="folder of captured pages")
    w.add_argument("--found", required=True)
    w.add_argument("--state", required=True, help="stream checkpoint folder")
    w.add_argument("--rejects", help="table of pages that gave no record, with the reason, by batch")
    w.add_argument("--files", type=int, help="files per batch")
    w.set_defaults(run=run_watch)

    k = jobs.add_parser("keep")
    k.add_argument("--pages", required=True, help="page_id, url, html")
    k.add_argument("--store", required=True, help="capture store, started if there is none")
    k.add_argument("--buckets", type=int, default=captures.BUCKETS, help="of a new store")
    k.set_defaults(run=run_keep)
    return p


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    args.run(session(), args)


if __name__ == "__main__":
    main()
