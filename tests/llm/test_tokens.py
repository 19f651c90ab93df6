"""Encoding against the tokenizers library, and the file format against plain loops."""

import array
import hashlib
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from resalelens.llm import bpe, token_files
from resalelens.llm.queries import VOCABULARY, op5_bpe, op6_token_files

PATH = public_tokenizers.path(VOCABULARY)
SF_DIR = "/root/testdata/sf0.001"
TEXTS = [
    None, "", " \n\t ", "It's the THE students' 'll I'LLve we've 1234 x2y", "Σίσυφος ΣΑΣ İstanbul ß Ñandú",
    "<|endoftext|>a<|startoftext|> b<|endoftext", "a\x1cb\x1dc\x85d e", "é ́ 가", "日本語 👍🏽 ½ Ⅷ ٣",
    "x" * 5000, "ab " * 3000, "!!!???...a..b", "￾ ͸ q",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def codec():
    with open(PATH, encoding="utf-8") as f:
        return bpe.Codec(f.read())


def ids(codec, text):
    return array.array("I", codec.encode(text)).tolist()


def test_codec_agrees_with_the_library(codec, library):
    rng = random.Random(3)
    alphabet = list("aAbtheinsSΣσİßéÉ12'-_.,!<|>  \n\t\x1c\x85́ ñÑ日👍") + ["<|endoftext|>", "'ll", "'ve"]
    made = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    for text in [t or "" for t in TEXTS] + made:
        want = library.encode(text, add_special_tokens=False).ids
        assert ids(codec, text) == want, text
        assert codec.decode(want) == library.decode(want, skip_special_tokens=False)


def test_automaton_applies_equal_pairs_from_the_left():
    vocab = {s: i for i, s in enumerate(bpe.byte_symbols() + [s + "</w>" for s in bpe.byte_symbols()])}
    for extra in ("aa", "aaaa", "aab</w>"):
        vocab[extra] = len(vocab)
    merges = [("a", "a"), ("aa", "aa"), ("aa", "b</w>")]
    auto = bpe.Automaton(vocab, merges, "</w>")

    def plain(word):
        parts = [*word[:-1], word[-1] + "</w>"]
        for a, b in merges:
            i = 0
            while i < len(parts) - 1:
                if (parts[i], parts[i + 1]) == (a, b):
                    parts[i:i + 2] = [a + b]
                i += 1
        return parts

    for n in range(1, 12):
        for word in ("a" * n, "a" * n + "b", "b" + "a" * n + "b", "ab" * n):
            assert [auto.labels[t] for t in auto.encode(word.encode())] == plain(word)


def test_encode_decode_of_odd_rows(spark, library):
    rows = [(i, t, 7) for i, t in enumerate(TEXTS)] + [(None, "the same", 1), (None, "the same", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = {(r.doc_id, r.text): r for r in bpe.encode_decode(df, "text", PATH).collect()}
    for key, text, _ in rows:
        want = library.encode(text or "", add_special_tokens=False).ids
        row = got[key, text]
        assert array.array("I", row.ids).tolist() == want and row.n_tokens == len(want)
        assert row.decoded == library.decode(want, skip_special_tokens=False)
    assert bpe.encode_decode(df.limit(0), "text", PATH).count() == 0


def test_op5_on_the_small_table(spark, library):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in op5_bpe(spark, SF_DIR).collect()}
    assert len(got) == len(docs)
    for doc in docs:
        want = library.encode(doc.text or "", add_special_tokens=False).ids
        row = got[doc.doc_id]
        assert row.n_tokens == len(want)
        assert row.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(library.decode(want, skip_special_tokens=False).encode()).hexdigest()


@pytest.mark.parametrize("values", [
    [], [0], [5], [1 << 59], [1 << 60], [(1 << 64) - 1] * 5, [0] * 500, [1] * 129, list(range(1000)),
    [0, 1 << 63, 0, 3, (1 << 60) - 1, 1 << 60, 2] * 40, [49407] * 128 + [1 << 62],
])
def test_simple8b_round_trip(values):
    ids = np.array(values, np.uint64)
    assert token_files.unpack(token_files.pack(ids)).tolist() == values


def test_simple8b_random_round_trip():
    rng = np.random.default_rng(5)
    for _ in range(60):
        n = int(rng.integers(0, 700))
        ids = rng.integers(0, 1 << 63, n, dtype=np.uint64) >> rng.integers(0, 63, n, dtype=np.uint64)
        assert (token_files.unpack(token_files.pack(ids)) == ids).all()


def test_simple8b_packs_small_ids_densely():
    ids = np.arange(10_000, dtype=np.uint64) % 1000
    assert len(token_files.pack(ids)) < 10_000 * 8 / 5


def test_files_keep_order_ties_and_empty_texts(spark, library, tmp_path):
    rows = [(3, "c c"), (None, None), (1, ""), (2, "long " * 70_000), (1, "b"), (1, "b"), (9, None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, start string").repartition(3)
    read = token_files.through_files(df, PATH).collect()
    assert len(read) == len(rows)
    order = sorted(read, key=lambda r: r.start)
    assert [r.doc_id for r in order] == [None, 1, 1, 1, 2, 3, 9]
    total = 0
    for r in order:
        assert r.start == total
        total += r.n_tokens
        assert array.array("I", r.ids).tolist()[-1] == token_files.END_ID
    want = sorted(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)
    assert sorted(r.n_tokens for r in read) == want
    assert token_files.through_files(df.limit(0), PATH).count() == 0


def test_op6_on_the_small_table(spark, library):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = {r.doc_id: r for r in op6_token_files(spark, SF_DIR).collect()}
    start = 0
    for doc in docs:
        want = library.encode(doc.text or "", add_special_tokens=False).ids + [token_files.END_ID]
        row = got[doc.doc_id]
        assert (row.start, row.n_tokens) == (start, len(want))
        assert row.ids_crc32 == zlib.crc32(np.array(want, "<u4").tobytes())
        start += len(want)


def test_file_encoder_agrees_on_every_code_point(library):
    """Each code point of the first two planes as a word, within one and at its end, with
    those that normal form takes apart among words of letters."""
    with open(PATH, encoding="utf-8") as f:
        encoder = token_files.LibraryEncoder(f.read())
    points = [chr(c) for c in range(0x20000) if not 0xD800 <= c < 0xE000]
    texts = [" ".join(f"ab{ch}cd {ch} q{ch}" for ch in points[i:i + 64]) for i in range(0, len(points), 64)]
    texts += ["क़लम और ज़मीन", "ਸ਼ਹਿਰ", "שּׁלום יִ", "Å Å ﬁ ſ K"]
    want = [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]
    got = encoder.encode_all(texts)
    assert [t for t, a, b in zip(texts, got, want) if a != b] == []


def test_latin_words_skip_the_splitter_and_memos_stay_bounded(library, monkeypatch):
    """Words of Latin letters go to the library's model itself; ids stay the library's, and
    what a batch adds beyond the memo's bounds is dropped after it."""
    monkeypatch.setattr(token_files, "MEMO_CHUNKS", 8)
    with open(PATH, encoding="utf-8") as f:
        encoder = token_files.LibraryEncoder(f.read())
    split = []
    ids = encoder._ids
    monkeypatch.setattr(encoder, "_ids", lambda texts: split.extend(texts) or ids(texts))
    texts = ["Straße, über Ærø Naïve! plain words; don't", "плотва 42 plain. İstanbul e\u0301te\u0301 " + "longword" * 20, None, ""]
    want = [np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    for _ in range(2):
        assert encoder.encode_all(texts) == want
    assert {"плотва"} <= set(split) and not {w for t in split for w in t.split()} & {"straße", "über", "ærø", "naïve", "plain", "words", "été"}
    assert len(encoder.memo) <= 8 and max(map(len, encoder.memo)) <= token_files.MEMO_KEY


def test_words_are_encoded_once_whatever_their_case_and_the_punctuation_after_them(library, monkeypatch):
    """Nothing but words of other letters, punctuation and mixed chunks goes to the library's
    splitter, and a batch's ids are the library's on random texts."""
    with open(PATH, encoding="utf-8") as f:
        encoder = token_files.LibraryEncoder(f.read())
    split = []
    ids = encoder._ids
    monkeypatch.setattr(encoder, "_ids", lambda texts: split.extend(texts) or ids(texts))
    texts = ["word Word, WORD### word) Ñandú$$$ ñandú\"", "word-word ##", "", None, "x's"]
    want = [np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert encoder.encode_all(texts) == want
    assert {t for t in split if any(ch.isalpha() for ch in t)} == {"word-word", "x's"} and {"word", "ñandú"} <= set(encoder.memo)

    rng = random.Random(11)
    alphabet = list("aAbJKß\u0301\u030cΣσİéÉ12'-_.,!#<|>   \n\t\x1c\x85\xa0\u3000日क़") + ["<|endoftext|>", "'ll", "ing"]
    for size in (0, 1, 400):
        made = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(size)]
        want = [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch(made, add_special_tokens=False)]
        assert encoder.encode_all(made) == want


def test_simple8b_takes_the_selector_with_most_ids():
    """Payloads equal those of a plain loop over the ids of each block."""
    def plain(values):
        words, starts = [], []
        for b in range(0, len(values), token_files.BLOCK):
            block, at = values[b:b + token_files.BLOCK], 0
            starts.append(len(words))
            while at < len(block):
                for k in range(1, 16):
                    count, bits = int(token_files.COUNTS[k]), int(token_files.BITS[k])
                    if all(v < 1 << bits for v in block[at:at + count]):
                        words.append(k << 60 | sum(v << j * bits for j, v in enumerate(block[at:at + count])))
                        at += count
                        break
                else:
                    words += [0, block[at]]
                    at += 1
        return np.array([len(values)], "<u8").tobytes() + np.array(starts, "<u4").tobytes() + np.array(words, "<u8").tobytes()

    rng = np.random.default_rng(8)
    for dtype, top in ((np.uint64, 64), (np.dtype("<u4"), 17), (np.dtype("<u4"), 32)):
        for n in (0, 1, 127, 128, 129, 700):
            ids = (rng.integers(0, 1 << 63, n, np.uint64) >> rng.integers(64 - top, 64, n, np.uint64)).astype(dtype)
            ids[rng.random(n) < 0.3] = 0
            assert token_files.pack(ids) == plain(ids.tolist())


def test_long_words_take_linear_time(codec):
    start = time.perf_counter()
    word = "abcdefghij" * 40_000
    assert codec.decode(np.frombuffer(codec.encode(word), "<u4").tolist()).replace(" ", "") == word + "</w>"
    assert time.perf_counter() - start < 20


def test_workers_forget_other_operators(codec):
    from resalelens.llm import shingles, tables
    shingles.shingle_sets(["some words here"], 2)
    assert len(shingles.WORDS) == 3
    tables.at_work("bpe")
    assert len(shingles.WORDS) == 0
    memo = bpe.Memo(len)
    assert memo["a" * 1000] == 1000 and memo["ab"] == 2 and list(memo) == ["ab"]
