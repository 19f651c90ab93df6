"""Repeated strings against a dictionary of all windows."""

import hashlib
import random
from collections import Counter

from resalelens.llm import suffix_dedup
from resalelens.llm.queries import op3_suffix_dedup

SF_DIR = "/root/testdata/sf0.001"
SPAN = suffix_dedup.SPAN


def expected(texts):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i:i + SPAN] for r in raw for i in range(len(r) - SPAN + 1))
    out = []
    for r in raw:
        covered = bytearray(len(r))
        for i in range(len(r) - SPAN + 1):
            if seen[r[i:i + SPAN]] > 1:
                covered[i:i + SPAN] = b"\1" * SPAN
        spans = sum(1 for i, c in enumerate(covered) if c and (i == 0 or not covered[i - 1]))
        kept = bytes(b for b, c in zip(r, covered) if not c)
        out.append((len(r), sum(covered), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_op3_on_the_small_table(spark):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect())
    got = sorted(op3_suffix_dedup(spark, SF_DIR).collect())
    assert [tuple(r)[1:] for r in got] == expected([t for _, t in rows])
    assert sum(r.n_removed for r in got) > 0


def test_borders_copies_and_odd_texts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 700)      # several pieces per text
    rng = random.Random(6)
    letters = "abcdefgh "

    def text(n):
        return "".join(rng.choice(letters) for _ in range(n))

    passage, base = text(320), text(900)
    texts = [None, "", "x" * 199, "y" * 200, "z" * 201, "ab" * 300, text(199), base, base, base]
    for _ in range(40):
        texts.append(text(rng.randint(0, 400)) + passage[rng.randint(0, 80):320 - rng.randint(0, 60)] + text(rng.randint(0, 400)))
    for _ in range(40):
        edited = list(base)
        for _ in range(rng.randint(1, 6)):
            edited[rng.randrange(len(edited))] = rng.choice(letters)
        texts.append("".join(edited)[rng.randint(0, 50):])
    texts += [text(150) + base[300:499] + text(99), base[300:500], "é" * 150, "né" * 100 + base[5:300], passage + passage]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, doc int").repartition(5)
    got = sorted(suffix_dedup.drop_repeats(df).collect())
    assert [(r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in got] == expected(texts)


def test_repeated_rows_and_no_rows(spark):
    df = spark.createDataFrame([(1, "q" + "w" * 10 + "e" * 250), (1, "q" + "w" * 10 + "e" * 250), (None, None)], "doc_id long, text string")
    got = suffix_dedup.drop_repeats(df).collect()
    assert sorted((r.n_bytes, r.n_removed, r.n_spans) for r in got) == [(0, 0, 0), (261, 261, 1), (261, 261, 1)]
    assert suffix_dedup.drop_repeats(df.limit(0)).count() == 0
