"""Jobs from tables on disk to tables on disk."""

import json
import os
import subprocess
import sys

from resalelens import jobs
from resalelens.sources import found


def write(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(path)
    return path


def test_deals_job(spark, tmp_path):
    card = "<li><a href='/sms/auction/view?auc={0}'>go</a><p>#{0} - {1}</p>${2}.00<p>3 hours left<p>Tempe, AZ 85001-1234</li>"
    index = write(spark, f"{tmp_path}/index", [
        (1, card.format(1, "red DRILL kit", 100) + card.format(2, "red drill kit", 90)), (2, card.format(3, "lost thing", 10))],
        "page_id LONG, html STRING")
    sold = write(spark, f"{tmp_path}/sold", [("Drill, red (kit)", "ebay_sold", 250.0 + i) for i in range(5)] + [("red saw", "ebay_sold", 5.0)],
                 "title STRING, source STRING, price DOUBLE")
    details = write(spark, f"{tmp_path}/details", [
        (1, "https://www.publicsurplus.com/sms/auction/view?auc=1", "<h1>Kit drill red</h1><div class=desc>for parts</div>")],
        "page_id LONG, url STRING, html STRING")
    args = ["deals", "--index", index, "--sold", sold, "--min-profit", "50", "--min-ratio", "1.5"]
    jobs.main([*args, "--out", f"{tmp_path}/a", "--json", "--funnel", f"{tmp_path}/funnel"])
    funnel = {r.reason: r.n for r in spark.read.json(f"{tmp_path}/funnel").collect()}
    assert funnel == {"found": 3, "unique": 2, "no_comps": 1, "deal": 1}
    r = spark.read.json(f"{tmp_path}/a").collect()
    assert [(x["deal_number"], x["id"], x["comps_median"], x["profit_ratio"]) for x in r] == [(1, "1", 252.0, 2.52)]
    zips = write(spark, f"{tmp_path}/zips", [("85001", 33.45, -112.07), ("90001", 33.97, -118.25)], "zip STRING, lat DOUBLE, lon DOUBLE")
    for reach, n in (["--hours", "5"], 1), (["--hours", "1"], 0), (["--zip", "85001", "--radius", "50", "--zips", zips], 1), (
            ["--zip", "90001", "--radius", "50", "--zips", zips], 0):
        out = f"{tmp_path}/reach-{reach[1]}-{n}"
        jobs.main([*args, *reach, "--out", out])
        assert spark.read.parquet(out).count() == n
    jobs.main([*args, "--details", details, "--out", f"{tmp_path}/b"])
    b = spark.read.parquet(f"{tmp_path}/b").collect()
    assert [(x["title"], x["ratio"], x["recommendation"]) for x in b] == [("Kit drill red", "1.8x", "SKIP")]


def test_scan_job_adds_items_once(spark, tmp_path):
    (tmp_path / "config.json").write_text(json.dumps({"searches": [{"keywords": "saw", "category": "T"}], "max_listings_per_search": 2}))
    urls = [f"https://www.publicsurplus.com/x?id={i}" for i in range(4)]
    listings = write(spark, f"{tmp_path}/listings", [(u, "Band saw", "T", "AZ", 50.0, i) for i, u in enumerate(urls)],
                     "url STRING, title STRING, category STRING, state STRING, price DOUBLE, pos INT")
    pages = write(spark, f"{tmp_path}/pages", [
        (i, u, f"<h1>Band saw</h1><p>Current Bid ${50 + i}</p><p>Closing 3/{i + 1}/2026</p><p>Location 85001</p>") for i, u in enumerate(urls)],
        "page_id LONG, url STRING, html STRING")
    prices = write(spark, f"{tmp_path}/prices", [("Band saw", i, 300.0) for i in range(3)], "item STRING, pos INT, price DOUBLE")
    zips = write(spark, f"{tmp_path}/zips", [("85001", 33.45, -112.07)], "zip STRING, lat DOUBLE, lon DOUBLE")
    store = f"{tmp_path}/store"
    jobs.main(["keep", "--pages", pages, "--store", store, "--buckets", "3"])

    def run(pages=pages):
        jobs.main(["scan", "--config", str(tmp_path / "config.json"), "--listings", listings, "--pages", pages, "--prices", prices,
                   "--zips", zips, "--found", f"{tmp_path}/found-{os.path.basename(pages)}", "--as-of", "2026-02-01", "--out", f"{tmp_path}/out"])
        return [json.loads(r[0]) for r in spark.read.text(f"{tmp_path}/out").collect()]
    first = run()
    assert sorted((i["lot"], i["bid"], i["profit"], i["ends"]) for i in first) == [
        ("0", 50.0, 250.0, "2026-03-01"), ("1", 51.0, 249.0, "2026-03-02")]
    assert run() == []      # the capped links are known now
    assert found.read_found(spark, f"{tmp_path}/found-{os.path.basename(pages)}").count() == 2
    assert run(store) == first


def test_watch_job(spark, tmp_path):
    def capture(name, rows):
        write(spark, f"{tmp_path}/in/{name}", rows, "page_id LONG, url STRING, html STRING")
    def run():
        jobs.main(["watch", "--pages", f"{tmp_path}/in/*", "--found", f"{tmp_path}/found", "--state", f"{tmp_path}/state",
                   "--rejects", f"{tmp_path}/rejects"])
        return sorted((r["url"][-1], r["title"]) for r in spark.read.parquet(f"{tmp_path}/found").collect())
    capture("a", [(1, "https://www.ironplanet.com/item/1", "<h1>one</h1>"), (2, "https://other.example/2", "<h1>x</h1>")])
    assert run() == [("1", "one")]
    capture("b", [(3, "https://www.ironplanet.com/item/1", "<h1>again</h1>"), (4, "https://www.ironplanet.com/item/3", "<h1>three</h1>")])
    assert run() == [("1", "one"), ("3", "three")]
    refused = spark.read.parquet(f"{tmp_path}/rejects").collect()
    assert [(r.url, r.error) for r in refused] == [("https://other.example/2", "Unsupported site")]


def test_workers_find_the_package_from_any_folder(spark, tmp_path):
    """A job of its own process, started elsewhere without a search path, reads pages."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    pages = write(spark, f"{tmp_path}/pages", [(1, "https://www.publicsurplus.com/sms/auction/view?auc=1", "<h1>Band saw</h1>")],
                  "page_id LONG, url STRING, html STRING")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYSPARK_PYTHON": sys.executable}
    done = subprocess.run(
        [sys.executable, f"{root}/resalelens/jobs.py", "watch", "--pages", pages, "--found", f"{tmp_path}/found", "--state", f"{tmp_path}/state"],
        cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert spark.read.parquet(f"{tmp_path}/found").count() == 1
