"""Near-duplicate operators against all pairs."""

import itertools
import random

import numpy as np
import pytest

from resalelens.llm import components, embedding_dedup, minhash
from resalelens.llm.queries import op4_embedding_dedup, op9_minhash

SF_DIR = "/root/testdata/sf0.001"


def labels(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def groups(pairs):
    out = {}
    for node, label in pairs:
        out.setdefault(label, set()).add(node)
    return {frozenset(g) for g in out.values()}


@pytest.mark.parametrize("edges", [
    [], [(1, 1)], [(i, i + 1) for i in range(200)], [(0, i) for i in range(1, 300)],
    [(i, j) for i in range(12) for j in range(i)] + [(100 + i, 101 + i) for i in range(7)],
])
def test_components(spark, edges):
    df = spark.createDataFrame([(a, b) for a, b in edges], "a long, b long")
    got = groups((r.node, r.component) for r in components.components(df).collect())
    nodes = {n for a, b in edges if a != b for n in (a, b)}
    assert got == groups(labels(nodes, [e for e in edges if e[0] != e[1]]).items())


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def by_all_pairs(rows, k, percent):
    sets = [(i, shingles(t, k)) for i, t in rows]
    links = []
    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if a and b:
            n = len(a & b)
            if 100 * n >= percent * (len(a) + len(b) - n):
                links.append((i, j))
    label = labels([i for i, _ in rows], links)
    return {i: (len(s), label[i], label[i] == i) for i, s in sets}


def test_op9_on_the_small_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in op9_minhash(spark, SF_DIR).collect()}
    assert got == by_all_pairs(rows, 3, 85)


def test_minhash_edited_copies_of_one_text(spark):
    """Many copies around the threshold: most pairs meet, few are links."""
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(4000)]
    base = [rng.choice(vocabulary) for _ in range(150)]
    rows = [(0, None), (1, ""), (2, " \n"), (3, "One two"), (4, "one TWO"), (5, "one")]
    for i in range(6, 160):
        words = list(base)
        for _ in range(rng.randint(0, 9)):
            words[rng.randrange(150)] = rng.choice(vocabulary)
        rows.append((i, " ".join(words)))
    rows += [(i, rows[20][1]) for i in range(160, 170)] + [(170, "z " * 20_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n long").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df, width=3, percent=85).collect()}
    assert got == by_all_pairs(rows, 3, 85)
    kept = minhash.keep_one(df, width=3, percent=85)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, g in got.items() if g[2])


def test_minhash_edits_of_an_absent_text_from_few_words(spark, monkeypatch):
    """Edits that texts share, sizes that differ, no text in the middle, parts of a few
    classes: the prefix bounds lose no link at 80 percent."""
    monkeypatch.setattr(minhash, "PART", 3)
    rng = random.Random(5)
    base = [[f"{g}-{i}" for i in range(90)] for g in "ab"]
    rows = []
    for i in range(160):
        words = list(base[i % 2])
        for _ in range(rng.randint(1, 6)):
            at = rng.randrange(len(words))
            words[at:at + 1] = rng.choice([["x"], ["y"], ["z", "z"], []])
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df, width=5, percent=80).collect()}
    assert got == by_all_pairs(rows, 5, 80)


def test_minhash_candidates_are_all_links_and_few_pairs(spark):
    """Through rare shingles alone, every link between labels is found; copies of a text
    whose edits are their own do not meet each other."""
    def starts(texts, percent):
        sets = [shingles(t, 3) for t in texts]
        facts = spark.createDataFrame([(i, len(s), None) for i, s in enumerate(sets)], "key long, n long, signature binary")
        named = spark.createDataFrame(list(enumerate(texts)), "key long, text string")
        found = minhash._starts(facts.select("key"), facts, named, 3, percent)
        return sets, minhash._at_shared(found, spark.createDataFrame([], "key long, label long"))

    rng = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choice(["p", "q"]) if rng.random() < 0.04 else w for w in base[:rng.randint(52, 60)]) for _ in range(60)]
    texts = sorted(set(texts))
    sets, rows = starts(texts, 85)
    got = {tuple(sorted((r.a, r.b))) for r in minhash._through_rare(rows, 85).collect()}
    links = {(i, j) for i, j in itertools.combinations(range(len(sets)), 2)
             if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])}
    assert links and links <= got

    apart = [" ".join(f"{w}-{t}" if i % 9 == 4 else w for i, w in enumerate(base)) for t in range(80)]
    assert minhash._through_rare(starts(apart, 85)[1], 85).count() == 0


@pytest.mark.parametrize("percent", [50, 80, 85, 99, 100])
def test_minhash_bands_follow_from_the_threshold(percent):
    bands = 2 * minhash.permutations(percent) / minhash.ROWS
    assert bands == int(bands)
    miss = (1 - (percent / 100) ** minhash.ROWS) ** bands
    assert miss <= minhash.MISS


def test_minhash_repeated_rows_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, None)], "doc_id long, text string")
    assert len(minhash.near_duplicates(df).collect()) == 4
    assert minhash.keep_one(df).count() == 2
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def by_cosine(rows, threshold=0.95):
    ok = [(i, np.array(v, float)) for i, v in rows if v is not None and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)]
    links = [(i, j) for (i, x), (j, y) in itertools.combinations(ok, 2)
             if len(x) == len(y) and x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= threshold]
    label = labels([i for i, _ in rows], links)
    n = dict.fromkeys(label, 0)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    return {i: (n[i], label[i], label[i] == i) for i in label}


def test_op4_on_the_small_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in op4_embedding_dedup(spark, SF_DIR).collect()}
    assert got == by_cosine(rows)


def test_vectors_in_large_buckets_and_odd_ones(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK_ROWS", 40)
    rng = np.random.default_rng(2)
    centre = rng.standard_normal((3, 16))
    made = [(c + 0.2 * rng.standard_normal(16)).astype(np.float32).tolist() for c in centre for _ in range(60)]
    rows = list(enumerate(made)) + [(500 + i, made[0]) for i in range(30)]
    rows += [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [None] + [1.0] * 15),
             (904, [float("inf")] * 16), (905, []), (906, [1.0]), (907, [2.0]), (908, [-1.0])]
    df = spark.createDataFrame([(*r, 5) for r in rows], "vec_id long, embedding array<float>, key int").repartition(4)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_vectors(df).collect()}
    assert got == by_cosine(rows)
    assert embedding_dedup.near_vectors(df.limit(0)).count() == 0


def test_very_large_and_small_components(spark):
    """Squares of these leave the range of doubles; their cosines do not."""
    rows = [(1, [1e200, 1e200]), (2, [1e200, 1.01e200]), (3, [1e-200, 0.0]), (4, [2e-200, 0.0]), (5, [0.0, 5e-324]), (6, [0.0, 1.7e308]), (7, [-1e-300, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_vectors(df).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (1, 3), 4: (1, 3), 5: (1, 5), 6: (1, 5), 7: (0, 7)}
