"""Entropy balancing against bisection in plain Python."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from resalelens.llm import mixing
from resalelens.llm.queries import op11_source_mix

SCHEMA = "doc_id long, text string, source string, size string, target string"


def words(text):
    return len(re.findall("[^\x20\x09-\x0d]+", text or ""))


def shared(sizes):
    """Targets by source: excess over three times the size is shared again until there is none."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, held = sum(sizes.values()), set()
    while True:
        rest, open_ = total - sum(3 * sizes[s] for s in held), [s for s in order if s not in held]
        target = {s: 3 * sizes[s] if s in held else rest * weight[s] / sum(weight[o] for o in open_) for s in order}
        over = {s for s in open_ if target[s] > 3 * sizes[s]}
        if not over:
            return target
        held |= over


def dual(sizes, target):
    """Rate per size with the words wanted, by bisection over the exponent."""
    taken = lambda y: sum(min(3, math.exp(min(y * n, 2))) * n for n in sizes)
    low, high = -1e3, 2.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if taken(mid) < target else (low, mid)
    return lambda n: min(3, math.exp(min(high * n, 2)))


def table(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, s, "clash", "clash") for i, t, s in rows], SCHEMA).repartition(parts)


def text(rng, n):
    return "".join(rng.choice(["wörd", "a\x1f", "\U0001F600", "x\x00y"]) + rng.choice([" ", "\n", "\x0b ", "\t"]) for _ in range(n))


def corpus(rng, n, sources, most=60):
    return [(i, text(rng, min(most, int(rng.expovariate(1 / 12)))), rng.choice(sources)) for i in range(n)]


@pytest.mark.parametrize("case", ["even", "skewed", "long", "one", "blank", "copies", "caps"])
def test_mix(spark, case):
    rng = random.Random(case)
    rows = {
        "even": lambda: corpus(rng, 600, ["a", "b", "c", "é", "\U0001F600", None]),
        "skewed": lambda: corpus(rng, 900, ["a"] * 30 + ["b", "c", "d", None]),
        "long": lambda: corpus(rng, 200, ["a", "b"]) + [(900 + i, text(rng, 20_000), s) for i, s in enumerate("abac")],
        "one": lambda: corpus(rng, 50, [None]),
        "blank": lambda: [(1, None, "a"), (2, " \n", "a"), (3, "", None), (4, "x", "b"), (None, "y y", "b")],
        "copies": lambda: [(i, "four words are here", "a") for i in range(500)] + corpus(rng, 300, ["b", "c"]),
        "caps": lambda: [(i, text(rng, 9), s) for i, s in enumerate(["a"] * 200 + ["b"] * 2 + ["c"] * 9 + ["d"] * 2)],
    }[case]()
    df = table(spark, rows)
    got = mixing.mix(df, mixing.weights_in_turn(df)).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows)
    text_of = {(i, s): t for i, t, s in rows}
    sizes = {s: sum(words(t) for _, t, o in rows if o == s) for s in {r[2] for r in rows}}
    target = shared(sizes)
    for r in got:
        assert r.size == words(text_of[r.doc_id, r.source]) and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(target[r.source])
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3
    for s in sizes:
        mine = [r for r in got if r.source == s and r.size]
        if not mine:
            continue
        rate = dual([r.size for r in mine], target[s])
        assert all(r.rate == pytest.approx(rate(r.size), rel=1e-6, abs=1e-9) for r in mine)
        small = [r for r in mine if r.size <= 64]
        off = sum(r.taken for r in mine) - target[s]
        assert abs(off) <= max((r.size for r in small), default=0) / 2 + 1 or all(r.copies == (0 if off > 0 else 3) for r in small)
        for n in {r.size for r in mine}:
            copies = [r.copies for r in mine if r.size == n]
            assert max(copies) - min(copies) <= 1


def test_reruns_agree(spark):
    """Order and partitions of the input do not matter."""
    rows = corpus(random.Random(7), 800, ["a", "a", "a", "b", None])
    seen = set()
    for parts, order in ((1, rows), (7, rows[::-1])):
        df = table(spark, order, parts)
        seen.add(tuple(sorted((r.doc_id, r.copies, r.rate) for r in mixing.mix(df, mixing.weights_in_turn(df)).collect())))
    assert len(seen) == 1


def test_repeated_keys_and_missing_weights(spark):
    rows = [(1, "same key here", "a")] * 40 + [(i, "other key here", "a") for i in range(2, 30)] + [(99, "no weight", "z")]
    df = table(spark, rows)
    weights = spark.createDataFrame([("a", 2)], "source string, weight int")
    got = mixing.mix(df, weights).collect()
    assert len({r.copies for r in got if r.doc_id == 1}) == 1
    assert [(r.target, r.copies) for r in got if r.source == "z"] == [(0.0, 0)]


def test_empty(spark):
    df = table(spark, [])
    assert mixing.mix(df, mixing.weights_in_turn(df)).collect() == []


def test_query_and_plan(spark):
    d = "/root/testdata/sf0.001"
    found = op11_source_mix(spark, d)
    plan = found._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    near = found.groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("w")).collect()
    assert found.count() == 200 and len(near) == 20
    assert all(abs(r.t - r.w) <= .06 * r.w for r in near)   # ten documents a source
