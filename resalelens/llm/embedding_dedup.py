"""Near-duplicate vectors by random-hyperplane sign hashing.

Equal vectors are one class with a number of copies. Each class is put into one bucket in
each of several tables by the signs of its products with random hyperplanes; vectors that
meet in a bucket are compared exactly, block against block, in double precision. A pair
that meets in several tables is counted in the first of them, which both sides' codes
show. Buckets of more than ``BLOCK_ROWS`` classes are cut into blocks, and each pair of
blocks is a group of its own, so no task holds more than two blocks.

The number of hyperplanes per table follows the number of classes, so that buckets stay
about as large as a block at any scale; the number of tables then follows from the
chance, below ``MISS``, that a pair at the threshold meets in none.

A block reports for each vector how many others it links to and one edge to a vector it is
connected with, never its pairs. Components come from those edges.

Vectors that are null, zero or hold null or non-finite components link with nothing.
Vectors of different lengths never meet. ``vec_id`` may repeat; each row counts.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from resalelens.llm.components import components
from resalelens.llm.tables import bounded_batches
from resalelens.operators.storage import written

BLOCK_ROWS = 1024
MISS = 1e-6
SEED = 4


def plan(classes: int, threshold: float, miss: float = MISS) -> tuple[int, int]:
    """Hyperplanes per table and tables."""
    bits = max(3, min(30, math.ceil(math.log2(max(1, classes) / BLOCK_ROWS))))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log1p(-meet))


def usable(vector: Column) -> Column:
    """Whether a vector can be compared at all."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows divided by the power of two above their largest component, which changes no
    cosine and keeps squares of very large and very small components in range."""
    _, power = np.frexp(np.abs(x).max(axis=1, initial=0))
    return np.ldexp(x, -power[:, None])


def coder(bits: int, tables: int):
    """Column function: vector to its bucket code in each table."""
    planes: dict[int, np.ndarray] = {}

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def codes(vectors: pa.Array) -> pa.Array:
        out = []
        for v in vectors:
            x = scaled(np.asarray(v.values, np.float64)[None, :])[0]
            if len(x) not in planes:
                planes[len(x)] = np.random.default_rng([SEED, len(x)]).standard_normal((len(x), bits * tables))
            sign = (x @ planes[len(x)] > 0).reshape(tables, bits)
            out.append(sign @ (1 << np.arange(bits)))
        return pa.array([c.tolist() for c in out], pa.list_(pa.int32()))
    return codes


def _labels(linked: np.ndarray) -> np.ndarray:
    """Smallest index that each row is connected to in a symmetric matrix."""
    n = len(linked)
    label = np.arange(n)
    while True:
        low = np.where(linked, label[None, :], n).min(axis=1, initial=n)
        new = np.minimum(label, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


FOUND = "key long, n long, root long"


def comparer(threshold: float):
    """Group function: links of one pair of blocks of a bucket."""
    def compare(keys: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        t, i, j = int(keys[0]), int(keys[3]), int(keys[4])
        rows = rows.sort_values(["block", "key"])
        x = scaled(np.array(rows["vector"].tolist(), np.float64))
        norm = np.sqrt((x * x).sum(axis=1))
        codes = np.array(rows["codes"].tolist(), np.int32)
        key, copies = rows["key"].to_numpy(), rows["copies"].to_numpy()
        block = rows["block"].to_numpy()
        a, b = np.flatnonzero(block == i), np.flatnonzero(block == j)
        near = (x[a] @ x[b].T) / (norm[a][:, None] * norm[b][None, :]) >= threshold
        near &= key[a][:, None] != key[b][None, :]
        p, q = np.nonzero(near)
        first = (codes[a[p], :t] != codes[b[q], :t]).all(axis=1)
        p, q = p[first], q[first]
        n = np.zeros(len(rows), np.int64)
        np.add.at(n, a[p], copies[b[q]])
        if i != j:
            np.add.at(n, b[q], copies[a[p]])
        linked = np.zeros((len(rows), len(rows)), bool)
        linked[a[p], b[q]] = linked[b[q], a[p]] = True
        root = key[_labels(linked)] if len(p) else key
        hit = n > 0
        return pd.DataFrame({"key": key[hit], "n": n[hit], "root": root[hit]})
    return compare


def near_vectors(
    rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", threshold: float = 0.95, miss: float = MISS,
) -> DataFrame:
    """Per row ``vec_id, n_links, component_id, kept``."""
    spark = rows.sparkSession
    bounded_batches(spark)
    v = F.col(vector)
    keyed = rows.select(F.col(vec_id).alias("vec_id"), v.alias("vector"), F.when(usable(v), F.xxhash64(v)).alias("key"))
    classes = written(
        keyed.filter("key IS NOT NULL").groupBy("key").agg(
            F.any_value("vector").alias("vector"), F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies")), "vectors")
    bits, tables = plan(classes.count(), threshold, miss)

    coded = written(classes.select("key", "vector", "copies", coder(bits, tables)("vector").alias("codes")), "coded")
    placed = coded.select("*", F.size("vector").alias("d"), F.posexplode("codes").alias("t", "code"))
    large = written(
        placed.groupBy("t", "code", "d").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > BLOCK_ROWS)
        .withColumn("blocks", F.ceil(F.col("_n") / BLOCK_ROWS).cast("int")).drop("_n"), "large-buckets")
    blocks = F.coalesce("blocks", F.lit(1))
    cut = placed.join(large, ["t", "code", "d"], "left").withColumn("blocks", blocks).withColumn(
        "block", F.pmod(F.xxhash64("key", F.lit(SEED)), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("_o")
    paired = cut.select("*", other).select(
        "t", "code", "d", F.least("block", "_o").alias("i"), F.greatest("block", "_o").alias("j"),
        "block", "key", "vector", "copies", "codes")
    found = written(paired.groupBy("t", "code", "d", "i", "j").applyInPandas(comparer(threshold), FOUND), "found")

    links = found.groupBy("key").agg(F.sum("n").alias("n"))
    groups = components(found.select(F.col("key").alias("a"), F.col("root").alias("b")))
    of_class = classes.select("key", "first", "copies").join(links, "key", "left").join(
        groups.withColumnRenamed("node", "key"), "key", "left").withColumn("group", F.coalesce("component", "key"))
    lowest = of_class.groupBy("group").agg(F.min("first").alias("component_id"))
    facts = of_class.join(lowest, "group").select(
        "key", "component_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return keyed.select("vec_id", "key").join(facts, "key", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
