"""The trie model against plain dictionaries."""

import collections
import math
import zlib

import numpy as np
import pytest

from resalelens.llm import ngram_lm
from resalelens.llm.elias_fano import EliasFano
from resalelens.llm.queries import op7_ngram_lm

SF_DIR = "/root/testdata/sf0.001"


def tokens(text):
    return (text or "").encode().lower().split() + [None]


def expected(rows):
    """Counts, base score and unquantised model score of every row."""
    one, two, context = collections.Counter(), collections.Counter(), collections.Counter()
    for key, text in rows:
        if zlib.crc32(str(key).encode()) % 7 != 2:
            seq = ["start"] + tokens(text)
            one.update(seq[1:])
            two.update(zip(seq, seq[1:]))
            context.update(seq[:-1])
    n, v = sum(one.values()), len(one)
    kept = {p: c for p, c in two.items() if c >= ngram_lm.MIN_PAIR}
    mass = collections.Counter()
    for (a, _), c in kept.items():
        mass[a] += (c - ngram_lm.DISCOUNT) / context[a]
    out = {}
    for key, text in rows:
        seq = ["start"] + tokens(text)
        base = score = 0.0
        for a, b in zip(seq, seq[1:]):
            low = (one[b] + 1) / (n + v + 1)
            base += math.log10(low)
            if context[a]:
                score += math.log10(max(kept.get((a, b), 0) - ngram_lm.DISCOUNT, 0) / context[a] + (1 - mass[a]) * low)
            else:
                score += math.log10(low)
        held = zlib.crc32(str(key).encode()) % 7 == 2
        out[key] = (held, len(seq) - 1, sum(one[t] > 0 for t in seq[1:]), n, base, score)
    return out


def agree(got, want):
    assert len(got) == len(want)
    for r in got:
        held, n, known, total, base, score = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(base, abs=1e-6)
        assert r.score == pytest.approx(score, abs=0.01 * n + 0.01)      # 8-bit codes


def test_op7_on_the_small_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    got = op7_ngram_lm(spark, SF_DIR).collect()
    agree(got, expected(rows))
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_many_batches_and_odd_texts(spark, monkeypatch, tmp_path):
    rows = [(i, " ".join(f"w{(i * j) % 13} the" for j in range(i % 30))) for i in range(200)]
    rows += [(500, None), (501, ""), (502, "the " * 30_000), (503, "Ünknown ÜNKNOWN the"), (504, " \x0b\t the")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, score int").repartition(5)
    df = df.withColumn("held_out", ngram_lm.held_out(df.doc_id))
    got = ngram_lm.score_texts(df, df.filter("NOT held_out")).collect()
    agree(got, expected(rows))
    none = ngram_lm.score_texts(df, df.limit(0)).collect()
    assert all(r.score == pytest.approx(r.base_score) == 0 and r.n_known == 0 for r in none)
    assert ngram_lm.score_texts(df.limit(0), df).count() == 0


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(4)
    a, b = np.sort(rng.integers(1, 9, 400).astype(np.uint64)), rng.integers(0, 60, 400).astype(np.uint64)
    pairs = ngram_lm._counted(a, b, np.ones(400, np.int64))
    shard = ngram_lm.Shard(np.frombuffer(ngram_lm.Shard.build(pairs, (a[:0], a[:0], np.zeros(0, np.int64))), np.uint8))
    for context in range(1, 9):
        word = np.arange(64, dtype=np.uint64) << np.uint64(64 - ngram_lm.SUCCESSOR_BITS)
        _, rest, begin, end, base = shard.words_at(np.full(64, context, np.uint64))
        assert shard.discounted(word, begin, end, base).sum() + rest[0] == pytest.approx(1, rel=0.04)


@pytest.mark.parametrize("n, top", [(0, 10), (1, 1), (1, 1 << 63), (5, 3), (1000, 10 ** 6), (5000, (1 << 64) - 1), (128, 1)])
def test_elias_fano(n, top):
    rng = np.random.default_rng(n)
    v = np.sort(rng.integers(0, top, n, dtype=np.uint64, endpoint=True))
    coded = EliasFano.of(EliasFano.build(v).arrays())
    assert (coded.get(np.arange(n)) == v).all()
    asked = np.concatenate([v, rng.integers(0, top, 300, dtype=np.uint64, endpoint=True), np.array([0, (1 << 64) - 1], np.uint64)])
    there = set(v.tolist())
    assert coded.find(asked).tolist() == [int(np.searchsorted(v, np.uint64(x))) if x in there else -1 for x in asked.tolist()]


def test_pairs_seen_once_count(spark, monkeypatch):
    rows = [(i, f"left w{i} right once{i} end") for i in range(60)] + [(i, "left w0 right once0 end") for i in range(60, 120)]
    with monkeypatch.context() as whole:
        whole.setattr(ngram_lm, "MIN_PAIR", 1)
        want = expected(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df = df.withColumn("held_out", ngram_lm.held_out(df.doc_id))
    agree(ngram_lm.score_texts(df, df.filter("NOT held_out")).collect(), want)
