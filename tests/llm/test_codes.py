"""Vector codes against plain nearest entries."""

import hashlib
import math
import random

import numpy as np
import pytest

from resalelens.llm import vector_codes
from resalelens.llm.queries import op12_vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string"


def plain(rows, entries=64, rounds=2):
    """The contract, one part and entry at a time; rows are (vec_id, vector, label)."""
    kept = [(i, [math.floor(256 * x) for x in v], l) for i, v, l in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(q) for _, q, _ in kept), default=0) // 16)
    kept = [(i, q + [0] * (16 * width - len(q)), l) for i, q, l in kept]
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    cut = [[q[p * width:(p + 1) * width] for _, q, _ in kept] for p in range(16)]
    books = [[list(q[p * width:(p + 1) * width]) for _, q, _ in order[:entries]] for p in range(16)]

    def nearest(book, x):
        return min((sum((a - b) ** 2 for a, b in zip(e, x)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(16):
            mine = {}
            for x in cut[p]:
                mine.setdefault(nearest(books[p], x)[1], []).append(x)
            for k, xs in mine.items():
                books[p][k] = [sum(c) // len(xs) for c in zip(*xs)]
    found = [[nearest(books[p], cut[p][r]) for p in range(16)] for r in range(len(kept))]
    by_label, out = {}, []
    for (_, _, l), f in zip(kept, found):
        by_label[l] = by_label.get(l, 0) + sum(d for d, _ in f)
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    for (i, _, l), f in zip(kept, found):
        out.append((i, "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f), by_label[l], sha))
    return out


def coded(spark, rows, **how):
    df = spark.createDataFrame([(i, v, l, "other") for i, v, l in rows], SCHEMA)
    found, books = vector_codes.encode(df, **how)
    sha = vector_codes.checksum(books)
    return [(r.vec_id, r.code, r.error, r.label_error, sha) for r in vector_codes.with_label_error(found).collect()]


def key(row):
    return (row[0] is None, row[0] or 0, *row[1:])


def as_floats(rows):
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], l) for i, v, l in rows]


@pytest.mark.parametrize("case", ["clusters", "few", "ties", "faults", "short", "empty"])
def test_codes_match_plain(spark, case):
    rng = random.Random(case)
    centre = [[rng.gauss(0, .2) for _ in range(32)] for _ in range(9)]
    near = lambda: [c + rng.gauss(0, .03) for c in rng.choice(centre)]
    rows = {
        "clusters": lambda: [(i, near(), rng.choice([0, 1, None])) for i in rng.sample(range(-50, 400), 200)],
        "few": lambda: [(i, near(), 1) for i in range(5)],
        "ties": lambda: [(i % 20, [rng.choice([-.5, 0, .5])] * 16, i % 3) for i in range(150)],
        "faults": lambda: [(i, v, 1) for i, v in enumerate(
            [None, [], near(), [None] + near()[1:], [float("nan")] * 32, [float("-inf")] * 32, near(), near()])] + [(None, near(), None)] * 2,
        "short": lambda: [(i, near()[:rng.choice([1, 7, 16, 20])], 2) for i in range(90)],
        "empty": lambda: [],
    }[case]()
    rows = as_floats(rows)
    assert sorted(coded(spark, rows), key=key) == sorted(plain(rows), key=key)


def test_small_memo_changes_nothing(monkeypatch):
    rng = np.random.default_rng(3)
    x, book = rng.integers(-200, 200, (500, 4)), rng.integers(-200, 200, (64, 4))
    whole = vector_codes.Cells(book).nearest(x)
    monkeypatch.setattr(vector_codes, "MEMO_CELLS", 3)
    monkeypatch.setattr(vector_codes, "BLOCK", 700)
    cut = vector_codes.Cells(book)
    halves = [cut.nearest(h) for h in (x[:250], x[250:], x[:0])]
    assert np.array_equal(np.concatenate([h[0] for h in halves]), whole[0])
    distance = ((x[:, None] - book[None]) ** 2).sum(axis=2)
    assert np.array_equal(whole[0], distance.argmin(axis=1)) and np.array_equal(whole[1], distance.min(axis=1))


def test_dominated_entries_are_left_out():
    rng = np.random.default_rng(5)
    cells = vector_codes.Cells(rng.integers(-300, 300, (64, 4)))
    x = rng.integers(-300, 300, (2_000, 4))
    cells.nearest(x)
    assert cells.counts.mean() < 32


def test_decoded_is_the_entry(spark):
    rows = as_floats([(i, [i / 10] * 16, 0) for i in range(4)])
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    found, books = vector_codes.encode(df, rounds=0)
    assert all(r.error == 0 and vector_codes.decoded(books, r.code) == [math.floor(256 * rows[r.vec_id][1][0])] * 16 for r in found.collect())


def test_query_matches_plain(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    got = [tuple(r) for r in op12_vector_codes(spark, d).collect()]
    assert sorted(got, key=key) == sorted(plain(rows), key=key)
