"""BPE encoding and decoding with a deterministic automaton over tokens.

Compilation starts from one state in which every base symbol loops, and applies one
gadget per merge ``(a, b) -> c``, in order of rank. Let ``q`` be the state that ``a``
leads to. A copy of ``q`` without its ``b`` arc becomes the new target of ``a``, and
``c`` gets an arc to where ``b`` led, from every state that has an ``a`` arc. The
sequences that the automaton accepts are then exactly those that BPE produces.

All arcs of one token lead to the same state, because each gadget moves them together.
So the table is one target per token plus, per state, the state it was copied from and
the arc it lost. Whether a state has an arc for a token is read off that table once and
kept in a transition table that fills as words are seen, up to ``MEMO_ARCS`` arcs.

Every prefix of a word has exactly one accepted token sequence. Encoding walks the word
once, follows the vocabulary's trie from each reached position, and takes the arcs the
automaton has. Decoding emits the label of each arc.

Texts are pre-split into chunks between white space, which no token crosses; each
worker keeps the ids of chunks it has seen, in a memo of bounded size that it drops when
another operator runs in it.

Null and empty texts give no tokens.
"""

from __future__ import annotations

import json
import struct
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from resalelens.llm.tables import at_work, bounded_batches, keeps

#: Entries of the memos; keys of more than ``MEMO_KEY`` characters or bytes are not kept, so
#: these bound bytes as well.
MEMO_CHUNKS = 250_000
MEMO_ARCS = 1_000_000
MEMO_KEY = 48
ROOT = 0
TOKEN = -1


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    table = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [table[b] for b in range(256)]


class Automaton:
    """Token automaton of a merge list; ``labels`` are the tokens' strings by id."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str):
        self.labels = {i: t for t, i in vocab.items()}
        symbols = byte_symbols()
        self.base = [vocab.get(s) for s in symbols]
        self.last = [vocab.get(s + end) for s in symbols]
        self._compile([(vocab[a], vocab[b], vocab[a + b]) for a, b in merges])
        self._spell(vocab, symbols, end)
        self.arcs: list[dict[int, int]] = [{} for _ in self.copied]
        self.filled = 0

    def _compile(self, merges: list[tuple[int, int, int]]) -> None:
        self.copied, self.lost, self.born = [ROOT], [-1], [-1]
        self.left: dict[int, tuple[int, int]] = {}
        self.target: dict[int, int] = {}
        for rank, (a, b, c) in enumerate(merges):
            q, after = self.target.get(a, ROOT), self.target.get(b, ROOT)
            if c in self.left or not self._has(q, b):
                continue     # the pair can no longer meet: the merge never applies
            self.copied.append(q)
            self.lost.append(b)
            self.born.append(rank)
            self.target[a] = len(self.copied) - 1
            self.left[c] = (a, rank)
            self.target[c] = after

    def _has(self, state: int, token: int) -> bool:
        """Whether ``state`` has an arc for ``token``.

        A merged token inherited its arcs from its left part at the time of its merge, so
        an arc lost by a left part counts if it was lost no later than that."""
        until = {token: len(self.born)}
        part = token
        while part in self.left:
            part, rank = self.left[part]
            until[part] = rank
        lost, born, copied = self.lost, self.born, self.copied
        while state != ROOT:
            arc = lost[state]
            if arc in until and born[state] <= until[arc]:
                return False
            state = copied[state]
        return True

    def _spell(self, vocab: dict[str, int], symbols: list[str], end: str) -> None:
        """Trie of the tokens' symbols: bytes, and 256 + byte for the last of a word."""
        code = {s: b for b, s in enumerate(symbols)}
        live = {t for t in self.base + self.last if t is not None} | set(self.left)
        self.trie: dict[int, dict | int] = {TOKEN: -1}
        self.longest = 1
        for text, token in vocab.items():
            if token not in live:
                continue
            final = text.endswith(end)
            chars = text[: -len(end)] if final else text
            path = [code[ch] for ch in chars]
            if final:
                path[-1] += 256
            node = self.trie
            self.longest = max(self.longest, len(path))
            for sym in path:
                node = node.setdefault(sym, {TOKEN: -1})
            node[TOKEN] = token

    def encode(self, word: bytes) -> list[int]:
        """Ids of one pre-split word."""
        n = len(word)
        path = list(word)
        path[-1] += 256
        trie, rows = self.trie, self.arcs
        states: list[int] = [ROOT] + [-1] * n
        taken = [0] * (n + 1)
        starts = [0] * (n + 1)
        for i in range(n):
            state = states[i]
            if state < 0:
                continue
            row, node, j = rows[state], trie, i
            for sym in path[i:i + self.longest]:
                node = node.get(sym)
                if node is None:
                    break
                j += 1
                token = node[TOKEN]
                if token < 0 or states[j] >= 0:
                    continue
                to = row.get(token)
                if to is None:
                    to = self.target.get(token, ROOT) if self._has(state, token) else -1
                    if self.filled < MEMO_ARCS:
                        row[token] = to
                        self.filled += 1
                if to >= 0:
                    states[j], taken[j], starts[j] = to, token, i
        ids = []
        while n:
            ids.append(taken[n])
            n = starts[n]
        return ids[::-1]


class Codec:
    """Texts to ids and back, as a tokenizer file of this kind states them."""

    def __init__(self, spec_text: str):
        spec = json.loads(spec_text)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.automaton = Automaton(model["vocab"], [tuple(m) for m in model["merges"]], self.end)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(split["pattern"]["Regex"])
        self.markers = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.names = dict(self.automaton.labels) | {i: t for t, i in self.special.items()}
        self.memo = Memo(self.encode_chunk)
        self.words = Memo(self.encode_word, MEMO_CHUNKS // 2)

    def encode_chunk(self, chunk: str) -> bytes:
        """Little-endian 32-bit ids of a run of characters without white space."""
        plain = lower(unicodedata.normalize("NFC", chunk))
        return b"".join(map(self.words.__getitem__, self.split(plain)))

    def split(self, plain: str) -> list[str]:
        """Words of a chunk. Characters that the standard library's Unicode tables do not
        know yet count as neither letters nor numbers."""
        if plain.isascii() or all(unicodedata.category(ch) != "Cn" for ch in plain):
            return self.pieces.findall(plain)
        known = "".join("\ufffe" if unicodedata.category(ch) == "Cn" else ch for ch in plain)
        return [plain[m.start():m.end()] for m in self.pieces.finditer(known)]

    def encode_word(self, word: str) -> bytes:
        ids = self.automaton.encode(word.encode())
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str | None) -> bytes:
        """Little-endian 32-bit ids of a whole text."""
        if not text:
            return b""
        if "<|" not in text:
            return b"".join(map(self.memo.__getitem__, chunks(text)))
        return b"".join(
            struct.pack("<I", self.special[part]) if part in self.special
            else b"".join(map(self.memo.__getitem__, chunks(part)))
            for part in self.markers.split(text))

    def decode(self, ids) -> str:
        """Labels of the ids, with a space between them."""
        return " ".join(map(self.names.__getitem__, ids))


class Memo(dict):
    """Results of a function of one text, up to a bounded number of short ones."""

    def __init__(self, function, most: int = MEMO_CHUNKS):
        super().__init__()
        self.function, self.most = function, most

    def __missing__(self, key):
        value = self.function(key)
        if len(self) < self.most and len(key) <= MEMO_KEY:
            self[key] = value
        return value


SEPARATORS = regex.compile("[\x1c-\x1f]")
NOT_SPACE = regex.compile(r"[^\s]+")


def chunks(text: str) -> list[str]:
    """Runs between white space. Four control characters split in ``str.split`` only."""
    return NOT_SPACE.findall(text) if SEPARATORS.search(text) else text.split()


def lower(text: str) -> str:
    """Lower case of each character by itself, so a final sigma stays a plain one."""
    return text.replace("Σ", "σ").lower()


@lru_cache(maxsize=2)
def codec(spec_text: str) -> Codec:
    """One codec per worker and vocabulary."""
    return Codec(spec_text)


keeps("bpe", codec.cache_clear)


def vocabulary(spark: SparkSession, path: str) -> Broadcast[str]:
    """A tokenizer file for the workers; its size is that of the vocabulary."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def coder(spec: Broadcast[str]):
    """Column function: text to ``ids``, little-endian unsigned 32-bit integers, and the
    text that they stand for, in one pass through one worker."""
    kind = pa.struct([("ids", pa.binary()), ("decoded", pa.string())])

    @F.arrow_udf(T.StructType([T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())]))
    def code(texts: pa.Array) -> pa.Array:
        at_work("bpe")
        one = codec(spec.value)
        ids = [one.encode(t.as_py()) for t in texts]
        decoded = (one.decode(np.frombuffer(b, "<u4").tolist()) for b in ids)
        return pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], fields=list(kind))
    return code


def encode_decode(df: DataFrame, text: str, path: str) -> DataFrame:
    """Add ``n_tokens``, ``ids`` (binary) and ``decoded`` to every row, replacing columns of
    those names. A null text counts as an empty one."""
    bounded_batches(df.sparkSession)
    spec = vocabulary(df.sparkSession, path)
    coded = df.withColumn("__bpe", coder(spec)(F.col(text)))
    names = ("ids", "decoded", "n_tokens")
    return coded.select(
        *[c for c in df.columns if c not in names], "__bpe.ids", "__bpe.decoded",
        (F.octet_length("__bpe.ids") / 4).cast("long").alias("n_tokens"))
