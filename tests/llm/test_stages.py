"""Language ID, line dedup, URL rules, decontamination and the pipeline on small tables."""

import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from resalelens.llm import decontaminate, language, line_dedup, url_rules
from resalelens.llm.queries import op1_language, op2_decontaminate
from tools.check_oracles import compare, connect

SF_DIR = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("name", ["op8_line_dedup", "op10_url_rules"])
def test_query_agrees_with_sql(spark, name):
    assert name in queries() and name in oracle_sql()
    assert compare(spark, connect(SF_DIR), SF_DIR, name)[0] == "ok"


# --- line dedup ---------------------------------------------------------------------

def by_lines(rows, ratio, least):
    pages, seen = Counter(), defaultdict(Counter)
    for _, host, text in rows:
        pages[host] += 1
        seen[host].update({x.strip(" \t\r") for x in (text or "").split("\n")} - {""} if text is not None else ())
    out = []
    for key, host, text in rows:
        if text is None:
            out.append((key, None, 0, 0))
            continue
        lines = text.split("\n")
        kept = [x for x in lines if not (seen[host][x.strip(" \t\r")] >= least and seen[host][x.strip(" \t\r")] > ratio * pages[host])]
        out.append((key, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def test_line_dedup(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "b", None]), "\n".join(rng.choice(["menu", " menu \r", f"line {i}", "", "rare", "x" * 3000]) for _ in range(rng.randint(0, 6)))) for i in range(120)]
    rows += [(500, "a", None), (501, "a", ""), (502, "c", "menu"), (502, "c", "menu"), (None, None, "\n\n")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, source string, text string, _n int").repartition(4)
    got = line_dedup.drop_lines(df, ratio=0.3, min_pages=4)
    assert got.columns == ["doc_id", "source", "text", "_n", "n_lines", "n_dropped"]
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()), key=repr) == by_lines(rows, 0.3, 4)
    assert line_dedup.drop_lines(df.limit(0)).count() == 0


# --- URL rules ----------------------------------------------------------------------

def test_globs_against_regular_expressions():
    rng = random.Random(2)
    for _ in range(60):
        globs = ["".join(rng.choice("ab/?*@") for _ in range(rng.randint(1, 9))) for _ in range(30)]
        globs = [g for g in globs if set(g) - set("*@")] or ["a"]
        texts = ["".join(rng.choice("ab/?") for _ in range(rng.randint(0, 10))) for _ in range(50)]
        hit = url_rules.GlobSet(globs).match([t.encode() for t in texts])
        for j, g in enumerate(globs):
            # A run of wildcards is one: any run of characters if one of them is.
            shape = re.sub(r"[*@]+", lambda m: ".*" if "*" in m[0] else "[^/?]*", g.replace("?", "[?]"))
            for i, t in enumerate(texts):
                assert hit[i, j] == bool(re.fullmatch(shape, t)), (g, t)


def test_url_rules(spark):
    want = {
        "http://a.net/x": ("net/", "block"), "https://example.net/en/1": ("example.net/en/", "allow"), "http://example.net/de/": ("net/", "block"),
        "http://m.EXAMPLE.com/de/1?x#y": ("example.com/de/", "block"), "http://badexample.com/de/": (None, "allow"),
        "http://x.org/fr/a": ("org/fr/", "allow"), "http://x.org/FR/a": (None, "allow"), "http://a.net": (None, "allow"), "http://a.net?/": (None, "allow"),
        "http://a.net#/": (None, "allow"), "http://a.com/x.net/": (None, "allow"), "http://a.net:80/": (None, "allow"), "a.net/x": (None, "allow"),
        "": (None, "allow"), None: (None, "allow"), "http://net/": ("net/", "block"), "://a.net/": ("net/", "block"),
        "http://x.com?a.net/y": (None, "allow"), "http://x.com?q=.org/fr/login": (None, "block"),
        "http://x.com#.net/": (None, "allow"), "http://x.com?.example.com/de/": (None, "allow"), "http://a.com/login": (None, "block"), "http://a.com/a.zip": (None, "block"), "http://a.com/x?sessionid=1": (None, "block"),
        "http://é.com/ü" + "q" * 100_000: (None, "allow"), "http://a.org/fr/login": ("org/fr/", "allow"), "x\ny://B.net/\nz": ("net/", "block"),
    }
    df = spark.createDataFrame([(i, u, "mine") for i, u in enumerate([*want, "http://a.net/x"])], "page_id long, url string, host string")
    got = url_rules.judge_urls(df)
    assert got.columns == ["page_id", "url", "host", "path", "rule", "verdict", "pattern"]
    rows = got.collect()
    assert len(rows) == len(want) + 1 and {r.url: (r.rule, r.verdict) for r in rows} == want
    parts = {r.url: (r.host, r.path) for r in rows}
    assert parts["http://m.EXAMPLE.com/de/1?x#y"] == ("m.example.com", "/de/1") and parts[None] == parts["a.net/x"] == ("", "")
    assert url_rules.judge_urls(df.limit(0)).count() == 0


# --- decontamination ----------------------------------------------------------------

def plain_score(item, text):
    table = np.zeros((len(item) + 1, len(text) + 1), int)
    for i, j in itertools.product(range(1, len(item) + 1), range(1, len(text) + 1)):
        same = 1 if item[i - 1] == text[j - 1] else -1
        table[i, j] = max(0, table[i - 1, j - 1] + same, table[i - 1, j] - 1, table[i, j - 1] - 1)
    return table.max()


def test_local_score():
    rng = np.random.default_rng(3)
    for _ in range(100):
        a, b = (rng.integers(0, 4, rng.integers(1, 15)).astype(np.uint64) for _ in range(2))
        assert decontaminate.local_score(a, b) == plain_score(a, b)


def test_find_items(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    item = [word() for _ in range(40)]
    filler = lambda n: [word() for _ in range(n)]
    edited = [word() if i % 8 == 7 else w for i, w in enumerate(item)]
    dropped = [w for i, w in enumerate(item) if i % 9]
    docs = {
        1: filler(200) + item + filler(50), 2: filler(30) + edited, 3: dropped + filler(3000), 4: filler(500), 5: item[:8] + filler(90),
        6: [w.upper() + "," for w in item], 7: (item + filler(100)) * 3, 8: ["tiny", "item"], 9: filler(20) + ["Tiny", "item."], 10: item, 11: item,
    }
    rows = [(k, " ".join(v), "x") for k, v in docs.items()] + [(12, None, "x"), (13, "", "x"), (10, " ".join(item), "x"), (None, " ".join(item), "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, matches string").repartition(3)
    items = spark.createDataFrame([(70, " ".join(item)), (71, "tiny item"), (72, ""), (73, None), (70, " ".join(item))], "item_id long, text string")
    got = Counter((r.doc_id, tuple(sorted({m.item_id for m in r.matches}))) for r in decontaminate.find_items(df, items).collect())
    assert got == Counter({(1, (70,)): 1, (2, (70,)): 1, (3, (70,)): 1, (4, ()): 1, (5, ()): 1, (6, (70,)): 1, (7, (70,)): 1, (8, (71,)): 1,
                           (9, (71,)): 1, (10, (70,)): 2, (11, (70,)): 1, (12, ()): 1, (13, ()): 1, (None, (70,)): 1})
    assert all(not r.matches for r in decontaminate.find_items(df, items.limit(0)).collect())
    assert decontaminate.find_items(df.limit(0), items).count() == 0


def test_op2_finds_exact_passages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    items = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()
    want = {(d.doc_id, i.item_id) for d in docs for i in items if i.text in d.text}
    found = op2_decontaminate(spark, SF_DIR).collect()
    assert want and want <= {(r.doc_id, r.item_id) for r in found}
    assert all(r.score >= decontaminate.THRESHOLD for r in found)


# --- language ID --------------------------------------------------------------------

def test_op1_accuracy(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    got = op1_language(spark, SF_DIR).collect()
    assert len(got) == len(docs)
    assert sum(r.language == docs[r.doc_id].lang for r in got) >= 0.98 * len(docs)
    assert sum(r.kept for r in got) >= 0.99 * len(docs)


def test_language_of_held_out_and_odd_rows(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text", "lang", "source")
    languages, model = language.train(docs.filter("doc_id % 2 = 0"), "text", "lang")
    assert languages == sorted(languages[:-1]) + ["und"]
    held = docs.filter("doc_id % 2 = 1")
    right = language.identify(held, "text", languages, model).filter("language = lang").count()
    assert right >= 0.97 * held.count()
    odd = spark.createDataFrame([
        (1, None, None, None), (2, "", "en", "a.de"), (3, "12 34 !!", "en", "a.de"), (4, "Re.", "fr", None), (5, "the of and " * 20_000, "de", "x"),
        (5, "the of and " * 20_000, "de", "x"), (6, "日本語の文章", None, "b.fr:80"),
    ], "doc_id long, text string, language string, _host string")
    got = language.identify(odd, "text", languages, model, F.col("language"), F.col("_host")).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 7 and not any(by[k].accepted for k in (1, 2, 3)) and by[4].language == "fr" and by[5].language == "en"
    assert all(0 < r.confidence <= 1 for r in got)
    assert language.identify(odd.limit(0), "text", languages, model).count() == 0
    none, flat = language.train(docs.limit(0), "text", "lang")
    assert none == ["und"] and language.identify(odd, "text", none, flat).filter("accepted").count() == 0


# --- pipeline -----------------------------------------------------------------------

def shingles(text, k=5):
    w = text.encode().lower().split()
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    tables = [docs]
    for _, stage in corpus_pipeline.STAGES:
        tables.append(stage(spark, tables[-1], SF_DIR).cache())
    for table in tables[1:-1]:
        assert table.columns == docs.columns and [f.dataType for f in table.schema] == [f.dataType for f in docs.schema]
    lined, unique, clean, coded = tables[2:]
    # One of each group of near copies, by all pairs.
    before = {r.doc_id: shingles(r.text) for r in lined.collect()}
    root = {i: i for i in before}
    for i, j in itertools.combinations(sorted(before), 2):
        common = len(before[i] & before[j])
        if common and 100 * common >= 80 * (len(before[i]) + len(before[j]) - common):
            a, b = root[i], root[j]
            root = {k: min(a, b) if v in (a, b) else v for k, v in root.items()}
    assert {r.doc_id for r in unique.collect()} == set(root.values())
    items = [r.text for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    assert not [r.doc_id for r in clean.collect() if any(i in r.text for i in items)]
    assert coded.count() == clean.count() and set(coded.columns) == {*docs.columns, "ids", "decoded", "n_tokens"}


def test_pipeline_of_odd_rows(spark, tmp_path):
    rows = [(1, None, "en", "s", 0), (2, "", None, None, None), (3, "123", "en", "s", 3), (4, "the rest of and", "en", "s", 15), (4, "the rest of and", "en", "s", 15),
            (None, "the of and in " * 9_000, "en", None, 1), (5, "the the the\nand and and", None, "s", 2)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/none/documents.parquet")
    for folder in (tmp_path, tmp_path / "none"):
        spark.createDataFrame([(1, "some item that no text here has")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id for r in got), key=repr) == [4, 5, None]
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


# --- copies in the pipeline ---------------------------------------------------------

def test_pipeline_keeps_one_full_text_of_many_copies(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    line = lambda: " ".join(word() for _ in range(12))
    copied, near = ["\n".join(line() for _ in range(12)) for _ in range(2)]
    rows = [(i, "home | login\n" + "\n".join(line() for _ in range(4))) for i in range(60)]
    rows += [(100 + i, copied) for i in range(40)]
    # Near copies, each with a word of its own and none without one.
    for i in range(40):
        lines = near.split("\n")
        lines[i % 12] = lines[i % 12].rsplit(" ", 1)[0] + " " + word()
        rows.append((200 + i, "\n".join(lines)))
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], DOCS).repartition(4)
    lined = corpus_pipeline.line_stage(spark, docs, "")
    by = {r.doc_id: r.text for r in lined.collect()}
    assert not any("login" in by[k] for k in range(60)) and all(by.values()) and len(by) == len(rows)
    got = [r.text for r in corpus_pipeline.near_stage(spark, lined, "").collect()]
    assert got.count(copied) == 1
    assert sum(len(shingles(t) & shingles(near)) >= 0.8 * len(shingles(near)) for t in got) == 1
    assert sum(t.count("\n") == 3 for t in got) == 60


# --- rare languages and copies in training ------------------------------------------

def test_training_covers_rare_languages_and_counts_copies_once(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("text", "lang")
    plain = docs.filter("lang <> 'es'").dropDuplicates(["text"])
    spanish = docs.filter("lang = 'es'").dropDuplicates(["text"]).orderBy(F.xxhash64("text").desc()).limit(2).cache()
    # More than 2,000 texts have smaller hashes than the two Spanish ones.
    many = spark.range(6_000).select(F.concat(F.lit("the of and "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"))
    languages, _ = language.train(plain.union(many).union(spanish), "text", "lang")
    assert languages == ["de", "en", "es", "fr", "und"]
    once = language.train(plain.union(spanish), "text", "lang")
    copies = spanish.limit(1).crossJoin(spark.range(3_000)).select("text", "lang")
    again = language.train(plain.union(spanish).union(copies).repartition(7), "text", "lang")
    assert once[0] == again[0] and np.array_equal(once[1], again[1])


# --- edited copies down to the threshold --------------------------------------------

def test_find_items_agrees_with_all_pairs(spark):
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(80)]
    word = lambda: rng.choice(vocabulary)
    items = [[word() for _ in range(n)] for n in (3, 4, 14, 14, 18, 18, 25, 40)]
    texts = []
    for item in items:
        for step in (2, 3, 4, 5):
            replaced = [word() if i % step == step - 1 else w for i, w in enumerate(item)]
            inserted = [x for i, w in enumerate(item) for x in ([w, word()] if i % step == step - 1 else [w])]
            dropped = [w for i, w in enumerate(item) if i % step != step - 1]
            texts += [[word() for _ in range(30)] + t + [word() for _ in range(20)] for t in (replaced, inserted, dropped)]
    # Many copies of an edited passage.
    texts += [texts[-6]] * 20 + [[word() for _ in range(400)]]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id long, text string")
    number = {w: i for i, w in enumerate(vocabulary)}
    code = lambda t: np.array([number[w] for w in t])
    want = {}
    for (i, t), (k, item) in itertools.product(enumerate(texts), enumerate(items)):
        score = decontaminate.local_score(code(item), code(t)) / len(item)
        # Of three or four words two in a row are asked for.
        pairs = {*zip(item, item[1:])} & {*zip(t, t[1:])}
        if score >= decontaminate.THRESHOLD and pairs:
            want[i, k] = score
    got = {(r.doc_id, m.item_id): m.score for r in decontaminate.find_items(df, asked).collect() for m in r.matches}
    assert got == pytest.approx(want) and len({k for _, k in want}) == len(items)
