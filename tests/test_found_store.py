"""Found-items store: many writers, repeated writers, crashes between its steps."""

import random

import pytest
from pyspark.sql import functions as F

from resalelens.sources import found, found_store
from resalelens.streaming import incremental

SCHEMA = "url STRING, title STRING, pos LONG"


def batch(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).coalesce(1)


def content(spark, path):
    return sorted(map(tuple, found_store.read(spark, path, SCHEMA).collect()))


def firsts(batches):
    known = {}
    for rows in batches:
        for url, title, pos in sorted(rows, key=lambda r: r[2]):
            if url and url not in known:
                known[url] = (url, title, pos)
    return sorted(known.values())


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(found_store, "FAN_IN", 3)
    monkeypatch.setattr(found_store, "bucket_of", lambda url: F.pmod(F.xxhash64(url), F.lit(2)).cast("int"))


def made(rng, n, links=40):
    return [[(rng.choice([f"u{rng.randrange(links)}"] * 9 + ["", None]), f"t{k}", 100 * k + i) for i in range(8)] for k in range(n)]


def test_writers_are_merged_by_generation(spark, tmp_path, small):
    path, batches = str(tmp_path / "store"), made(random.Random(4), 13)
    for k, rows in enumerate(batches):
        found_store.add(batch(spark, rows), path, str(k))
    assert content(spark, path) == firsts(batches)
    folders = [p.name for b in tmp_path.glob("store/bucket=*") for p in b.iterdir() if p.is_dir()]
    assert len(folders) <= 2 * 2 * 3 and any(f.startswith("writer=g2") for f in folders)


def test_repeated_writer_replaces_itself(spark, tmp_path, small):
    path, batches = str(tmp_path / "store"), made(random.Random(5), 2)
    found_store.add(batch(spark, batches[0]), path, "a")
    for _ in range(2):
        found_store.add(batch(spark, batches[1]), path, "b")
    assert content(spark, path) == firsts(batches)


@pytest.mark.parametrize("step", ["data", "list"])
def test_crash_while_merging(spark, tmp_path, small, monkeypatch, step):
    """The table reads the same if a merge stops after its folder or after its line."""
    path, batches = str(tmp_path / "store"), made(random.Random(6), 5)
    with monkeypatch.context() as patch:
        patch.setattr(found_store, "merge", lambda *a: None)
        for k, rows in enumerate(batches[:3]):
            found_store.add(batch(spark, rows), path, str(k))
    for b in (0, 1):
        parts = [p.name.removeprefix("writer=") for p in (tmp_path / "store" / f"bucket={b}").iterdir() if p.is_dir()]
        rows = [spark.read.schema(SCHEMA).parquet(f"{path}/bucket={b}/writer={w}") for w in parts]
        whole = rows[0]
        for more in rows[1:]:
            whole = whole.unionByName(more)
        whole.write.parquet(f"{path}/bucket={b}/writer=g1-x{b}")
        if step == "list":
            spark.createDataFrame([(b, f"g1-x{b}", parts)], found_store._MERGE).write.json(f"{path}/{found_store._MERGES}/g1-x{b}")
    assert content(spark, path) == firsts(batches[:3])
    for k, rows in enumerate(batches[3:], 3):
        found_store.add(batch(spark, rows), path, str(k))
    assert content(spark, path) == firsts(batches)


def test_only_touched_buckets_are_read(spark, tmp_path):
    path = str(tmp_path / "store")
    found_store.add(batch(spark, [(f"u{i}", "t", i) for i in range(400)]), path, "a")
    plan = found_store.read(spark, path, SCHEMA, [3, 5]).select("url")._jdf.queryExecution().executedPlan().treeString()
    assert "bucket" in plan.split("PartitionFilters: ")[1].split("]")[0] and "ReadSchema: struct<url:string>" in plan
    want = sum(r.b in (3, 5) for r in spark.range(400).select(found_store.bucket_of(F.concat(F.lit("u"), F.col("id"))).alias("b")).collect())
    assert found_store.read(spark, path, SCHEMA, [3, 5]).count() == want > 0


def test_empty_store_and_batches(spark, tmp_path):
    path = str(tmp_path / "store")
    found_store.add(batch(spark, []), path, "a")
    assert content(spark, path) == []
    found_store.add(batch(spark, [("", "x", 1), (None, "y", 2)]), path, "b")
    found_store.add(batch(spark, [("u", "x", 2), ("u", "y", 1)]), path, "c")
    assert content(spark, path) == [("u", "y", 1)]


def test_run_between_two_results(spark, tmp_path):
    """A run that stopped after its found items gives the same items when it is repeated."""
    path = str(tmp_path / "store")
    items = spark.createDataFrame([("a", "u1"), ("b", "u2")], "title STRING, url STRING")
    found.append_found(items, path, order="url", run="r1")
    known = found.read_found(spark, path, but="r1")
    assert items.join(known, "url", "left_anti").count() == 2
    found.append_found(items, path, order="url", run="r1")
    assert found.read_found(spark, path).count() == 2


def test_stream_of_many_batches(spark, tmp_path, small):
    df = spark.range(120).select(
        F.concat(F.lit("u"), (F.col("id") * 7 % 31).cast("string")).alias("url"), F.col("id").cast("string").alias("title"), F.col("id").alias("pos"))
    for i in range(12):
        df.filter(F.col("id").between(i * 10, i * 10 + 9)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for state in ("s1", "s2"):     # a lost checkpoint replays every batch
        stream = incremental.captures(spark, str(tmp_path / "in"), df.schema, files_per_batch=1)
        incremental.keep_found(stream, str(tmp_path / "found"), str(tmp_path / state)).awaitTermination()
    got = incremental.read_batches(spark, str(tmp_path / "found"), df.schema)
    assert sorted(r.url for r in got.collect()) == sorted({f"u{i * 7 % 31}" for i in range(120)})
