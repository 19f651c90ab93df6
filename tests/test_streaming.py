"""Streams give what the batch gives."""

import shutil

import pytest
from pyspark.sql import functions as F

from resalelens.operators.found import merged
from resalelens.streaming import incremental
from workload.scan_queries import stream_records
from workload.standins import table_stream


@pytest.fixture
def split(spark, tmp_path):
    """600 items over six files, links repeated within and across files."""
    df = spark.range(600).select(
        F.concat(F.lit("u"), (F.col("id") * 7 % 90).cast("string")).alias("url"),
        F.col("id").cast("string").alias("title"),
        F.col("id").alias("pos"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 60).alias("ts"))
    for i in range(6):
        df.filter((F.col("id") >= i * 100) & (F.col("id") < i * 100 + 100)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return df, str(tmp_path / "in"), str(tmp_path)


def test_found_table_equals_batch_merge(spark, split):
    df, path, tmp = split
    for _ in range(2):   # the second run finds nothing new
        stream = incremental.captures(spark, path, df.schema, files_per_batch=1)
        incremental.keep_found(stream, f"{tmp}/found", f"{tmp}/state").awaitTermination()
    got = incremental.read_batches(spark, f"{tmp}/found", df.schema)
    want = merged(df.filter("false"), df)
    assert sorted(map(tuple, got.select("url", "pos").collect())) == sorted(map(tuple, want.select("url", "pos").collect()))
    assert got.count() == 90


def test_repeated_batch_replaces_itself(spark, split):
    df, path, tmp = split
    def run(state):
        stream = incremental.captures(spark, path, df.schema, files_per_batch=2)
        incremental.keep_found(stream, f"{tmp}/again", state).awaitTermination()
    run(f"{tmp}/s1")
    run(f"{tmp}/s2")     # a lost checkpoint replays every batch
    assert incremental.read_batches(spark, f"{tmp}/again", df.schema).count() == 90


def test_new_keys_equal_distinct(spark, split):
    df, path, tmp = split
    keys = incremental.new_keys(incremental.captures(spark, path, df.schema, 1), ["url"], "ts", "2 days")
    incremental.append_to(keys.select("url"), f"{tmp}/keys", f"{tmp}/keys-state").awaitTermination()
    got = [r["url"] for r in spark.read.parquet(f"{tmp}/keys").collect()]
    assert sorted(got) == sorted(r["url"] for r in df.select("url").distinct().collect())


@pytest.mark.parametrize("folder", [False, True])
def test_table_stream_reads_a_file_or_a_folder(spark, tmp_path, folder):
    parts, at = str(tmp_path / "parts"), tmp_path / "pages.parquet"
    spark.range(100).repartition(1 if not folder else 3).write.parquet(parts)
    if folder:
        shutil.copytree(parts, at)
    else:
        shutil.copy(next((tmp_path / "parts").glob("*.parquet")), at)
    spark.range(7).write.parquet(str(tmp_path / "pages2.parquet"))
    stream = table_stream(spark, str(tmp_path), "pages")
    incremental.append_to(stream, str(tmp_path / "rows"), str(tmp_path / "state")).awaitTermination()
    assert sorted(r[0] for r in spark.read.parquet(str(tmp_path / "rows")).collect()) == list(range(100))


def test_stream_records_without_a_heading(spark, tmp_path):
    """Titles are empty without a heading and NULL only without a page, as in the query's SQL.
    A reference cut before its semicolon is read as in page_records."""
    com, org = "https://a.example.com/1", "https://a.example.org/1"
    rows = [(1, com, "<h1>a</h1>"), (2, com, "<p>no heading</p>"), (3, org, ""), (4, org, None), (5, "https://a.example.net/1", None),
            (6, com, "<h1>a &quot</h1>")]
    spark.createDataFrame(rows, "page_id LONG, url STRING, html STRING").write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted(map(tuple, stream_records(spark, str(tmp_path)).collect()))
    assert got == [(1, "com", "a"), (2, "com", ""), (3, "org", ""), (4, "org", None), (6, "com", 'a "')]
