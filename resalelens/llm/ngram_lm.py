"""Bigram language model in an Elias-Fano trie, and its scores of whole texts.

Counting. Tasks count the word pairs of their training texts and send each shard (by the
leading bits of a hash of the context) sorted, packed counts, so a common word or pair is
one count per batch before it is shuffled. Each shard adds up what it gets. The number of
shards follows the size of the corpus.

Model. Interpolated absolute discounting: ``p(w | v) = (c(v w) - D) / c(v) + a(v) p(w)``
with ``p(w) = (c(w) + 1) / (N + V + 1)``. All pairs are kept, those seen once as well
(``MIN_PAIR``). A context that training has not seen leaves ``p(w)``.

Trie. One file per shard in the shared folder. Level one is the Elias-Fano sequence of its
words' hashes with their counts and 8-bit weights ``a``; monotone pointers, Elias-Fano as
well, lead to level two, the successors of each context. A successor is stored relative
to the context: the last value of the context before it is added, so that the whole level
increases and is one Elias-Fano sequence; its discounted probability is an 8-bit code on
a logarithmic scale. Scoring tasks map the files and read the pages that they touch.

Words are told apart by 64-bit hashes, successors within a context by 40 bits of them.
Null and empty texts are one end token. Repeated rows count and are scored each; a row
without ``doc_id`` takes the crc32 of an empty string.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, functions as F, types as T

from resalelens.llm.elias_fano import EliasFano
from resalelens.llm.shingles import word_hashes, words
from resalelens.llm.tables import bounded_batches
from resalelens.operators.storage import fresh_path, written

U = np.uint64
END, START = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)
SUCCESSOR_BITS = 40
MIN_PAIR = 1
DISCOUNT = 0.75
#: Text per shard, and tokens that a counting task gathers before it sends them.
SHARD_BYTES = 16 << 20
HELD_TOKENS = 2_000_000
#: Codes 1 to 255 for log10 of a probability down to -LOWEST.
LOWEST = 8.0


def sequences(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, each ending in END, and how many each has."""
    parts = [words(t) for t in texts]
    size = np.array([len(p) + 1 for p in parts], np.int64)
    code = np.full(int(size.sum()), END, U)
    inside = np.ones(len(code), bool)
    inside[np.cumsum(size) - 1] = False
    code[inside] = word_hashes([w for p in parts for w in p])
    return code, size


def numbered(code: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct tokens in order with START after them, the place of each token among them,
    and the place of the token before it."""
    names, place = np.unique(code, return_inverse=True)
    before = np.empty_like(place)
    before[1:] = place[:-1]
    before[np.cumsum(size) - size] = len(names)
    return np.append(names, START), place, before


def _counted(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in order, with their sums."""
    order = np.lexsort((b, a))
    a, b, n = a[order], b[order], n[order]
    first = np.ones(len(a), bool)
    first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    at = np.flatnonzero(first)
    return a[at], b[at], np.add.reduceat(n, at) if len(at) else n


def _encode(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted pairs: distinct contexts, successors per context, five bytes a successor, and
    one byte a count with the rest of larger ones aside."""
    start = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, np.int64)
    per = np.diff(np.append(start, len(a))).astype(np.uint32)
    five = np.ascontiguousarray(b.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :5]
    small = np.minimum(n, 255).astype(np.uint8)
    return (struct.pack("<QQ", len(start), len(a)) + a[start].tobytes() + per.tobytes()
            + five.tobytes() + small.tobytes() + n[n >= 255].astype("<u8").tobytes())


def _decode(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    k, m = struct.unpack_from("<QQ", blob)
    at = 16
    a = np.frombuffer(blob, U, k, at)
    per = np.frombuffer(blob, np.uint32, k, at + 8 * k)
    at += 12 * k
    wide = np.zeros((m, 8), np.uint8)
    wide[:, :5] = np.frombuffer(blob, np.uint8, 5 * m, at).reshape(-1, 5)
    n = np.frombuffer(blob, np.uint8, m, at + 5 * m).astype(np.int64)
    n[n == 255] = np.frombuffer(blob, "<u8", -1, at + 6 * m).astype(np.int64)
    return np.repeat(a, per), wide.view(U).reshape(-1), n


def successor(code: np.ndarray) -> np.ndarray:
    return code >> U(64 - SUCCESSOR_BITS)


def shard_of(code: np.ndarray, bits: int) -> np.ndarray:
    return (code >> U(64 - bits)).astype(np.int64) if bits else np.zeros(len(code), np.int64)


COUNTS = "shard int, pairs binary, tokens binary"


def count_pairs(train: DataFrame, text: str, bits: int) -> DataFrame:
    """Packed pair and token counts per shard."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: list[tuple] = []
        tokens: list[tuple] = []
        held = 0

        def send():
            a, b, n = _merge(pairs)
            near, none, total = _merge(tokens)
            cut = np.searchsorted(shard_of(a, bits), np.arange(2 ** bits + 1))
            own = np.searchsorted(shard_of(near, bits), np.arange(2 ** bits + 1))
            for s in range(2 ** bits):
                i, j, k, m = *cut[s:s + 2], *own[s:s + 2]
                if i < j or k < m:
                    yield pa.RecordBatch.from_arrays([
                        pa.array([s], pa.int32()), pa.array([_encode(a[i:j], b[i:j], n[i:j])], pa.binary()),
                        pa.array([_encode(near[k:m], none[k:m], total[k:m])], pa.binary())], names=["shard", "pairs", "tokens"])

        for batch in batches:
            code, size = sequences(batch.column(0).to_pylist())
            if len(code):
                names, place, before = numbered(code, size)
                pair, n = np.unique(before * len(names) + place, return_counts=True)
                pairs.append((names[pair // len(names)], successor(names[pair % len(names)]), n))
                tokens.append((names[:-1], names[:-1] * U(0), np.bincount(place, minlength=len(names) - 1)))
                held += len(code)
            if held >= HELD_TOKENS:
                yield from send()
                pairs, tokens, held = [], [], 0
        if held:
            yield from send()
    return train.select(F.col(text)).mapInArrow(count, COUNTS)


def _merge(blobs: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _counted(*(np.concatenate(x) for x in zip(*blobs))) if blobs else (np.zeros(0, U), np.zeros(0, U), np.zeros(0, np.int64))


def quantise(p: np.ndarray) -> np.ndarray:
    step = LOWEST / 254
    return np.clip(np.rint((np.log10(np.maximum(p, 1e-300)) + LOWEST) / step), 0, 254).astype(np.uint8) + np.uint8(1)


def weight(codes: np.ndarray) -> np.ndarray:
    return 10.0 ** ((codes.astype(np.float64) - 1) * (LOWEST / 254) - LOWEST)


class Shard:
    """The trie of one range of contexts."""

    @staticmethod
    def build(pairs: tuple, tokens: tuple) -> bytes:
        a, b, n = pairs
        names = np.union1d(a, tokens[0])
        count = np.zeros(len(names), np.int64)
        count[np.searchsorted(names, tokens[0])] = tokens[2]
        place = np.searchsorted(names, a)
        total = np.bincount(place, weights=n, minlength=len(names))
        kept = n >= MIN_PAIR
        place, b, n = place[kept], b[kept], n[kept]
        p = (n - DISCOUNT) / total[place] if len(n) else np.zeros(0)
        code = quantise(p)
        left = 1 - np.bincount(place, weights=p, minlength=len(names))
        per = np.bincount(place, minlength=len(names))
        pointer = np.concatenate([[0], np.cumsum(per)])
        # The last value of the context before, plus one, is added to each successor.
        last = np.zeros(len(names), U)
        last[per > 0] = b[pointer[1:][per > 0] - 1] + U(1) if len(b) else last[per > 0]
        base = np.concatenate([[U(0)], np.cumsum(last, dtype=U)[:-1]]) if len(names) else last
        parts = [
            *EliasFano.build(names).arrays(), count.astype(U), quantise(np.where(total > 0, left, 1.0)),
            (total > 0).astype(np.uint8), *EliasFano.build(pointer).arrays(),
            *EliasFano.build(b + base[place] if len(b) else b).arrays(), code]
        head, body, at = [], [], 0
        for part in parts:
            raw = np.ascontiguousarray(part).tobytes()
            head += [at, part.nbytes, part.dtype.itemsize]
            body.append(raw + bytes(-len(raw) % 8))
            at += len(body[-1])
        return struct.pack(f"<Q{len(head)}Q", len(parts), *head) + b"".join(body)

    def __init__(self, raw: np.ndarray):
        n = int(raw[:8].view(U)[0])
        head = raw[8:8 + 24 * n].view(U).astype(np.int64).reshape(n, 3)
        start = 8 + 24 * n
        parts = [raw[start + at:start + at + size].view(np.uint8 if width == 1 else U) for at, size, width in head.tolist()]
        self.words = EliasFano.of(parts[:4])
        self.count, self.left, self.known = parts[4:7]
        self.pointers, self.successors, self.code = EliasFano.of(parts[7:11]), EliasFano.of(parts[11:15]), parts[15]

    def words_at(self, code: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of each word: its count, the weight it leaves to the lower order as a context,
        the range of its successors, and what is added to them."""
        count, weights = np.zeros(len(code), np.int64), np.ones(len(code))
        begin, end, base = np.zeros(len(code), np.int64), np.zeros(len(code), np.int64), np.zeros(len(code), U)
        at = self.words.find(code)
        there = np.flatnonzero(at >= 0)
        count[there] = self.count[at[there]].astype(np.int64)
        there = there[self.known[at[there]] > 0]
        weights[there] = weight(self.left[at[there]])
        begin[there], end[there] = (self.pointers.get(at[there] + k).astype(np.int64) for k in (0, 1))
        later = np.flatnonzero((begin < end) & (begin > 0))
        base[later] = self.successors.get(begin[later] - 1) + U(1)
        return count, weights, begin, end, base

    def discounted(self, word: np.ndarray, begin: np.ndarray, end: np.ndarray, base: np.ndarray) -> np.ndarray:
        """Discounted probability of each word in a context's range, 0 if it is not kept."""
        p = np.zeros(len(word))
        hit = self.successors.find(base + successor(word))
        found = (hit >= begin) & (hit < end)
        p[found] = weight(self.code[hit[found]])
        return p


BUILT = "shard int, tokens long, words long"


def _folder(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def build_shards(counts: DataFrame, path: str, shards: int) -> DataFrame:
    """Write a file per shard; returns the tokens and words of each."""
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(shard, pairs, tokens):
            near = _merge(tokens)
            where, root = _folder(path)
            where.create_dir(root, recursive=True)
            # Written aside and moved, so a task that runs twice leaves one whole file.
            aside = f"{root}/_{shard}-{np.random.default_rng().integers(1 << 62)}"
            with where.open_output_stream(aside) as f:
                f.write(Shard.build(_merge(pairs), near))
            if where.get_file_info(f"{root}/{shard}").type == fs.FileType.NotFound:
                where.move(aside, f"{root}/{shard}")
            else:
                where.delete_file(aside)
            row = [[shard], [int(near[2].sum())], [len(near[0])]]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, (pa.int32(), pa.int64(), pa.int64()))], names=["shard", "tokens", "words"])

        now, pairs, tokens = None, [], []
        for batch in batches:
            for shard, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                if shard != now and now is not None:
                    yield close(now, pairs, tokens)
                    pairs, tokens = [], []
                now = shard
                pairs.append(_decode(a))
                tokens.append(_decode(b))
        if now is not None:
            yield close(now, pairs, tokens)
    return counts.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(merge, BUILT)


class Model:
    """All shards of a model folder, mapped where the folder is a local or mounted path."""

    def __init__(self, path: str, bits: int, tokens: int, distinct: int):
        self.bits, self.tokens, self.distinct = bits, tokens, distinct
        self.path, self.open = path, {}

    def shard(self, s: int) -> Shard | None:
        if s not in self.open:
            where, root = _folder(self.path)
            if where.get_file_info(f"{root}/{s}").type == fs.FileType.NotFound:
                self.open[s] = None
            elif isinstance(where, fs.LocalFileSystem):
                self.open[s] = Shard(np.memmap(f"{root}/{s}", np.uint8, "r"))
            else:
                with where.open_input_file(f"{root}/{s}") as f:
                    self.open[s] = Shard(np.frombuffer(f.read(), np.uint8))
        return self.open[s]

    def _by_shard(self, own: np.ndarray) -> Iterator[tuple[Shard, np.ndarray]]:
        """Shards that are there, and the places whose number in ``own`` is theirs."""
        order = np.argsort(own.astype(np.uint16) if self.bits <= 16 else own, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(own[order])) + 1):
            if len(part) and (shard := self.shard(int(own[part[0]]))) is not None:
                yield shard, part

    def score(self, code: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per token: its training count, log10 base probability, log10 probability."""
        if not len(code):
            return np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
        names, place, before = numbered(code, size)
        own = shard_of(names, self.bits)
        facts = (np.zeros(len(names), np.int64), np.ones(len(names)), np.zeros(len(names), np.int64), np.zeros(len(names), np.int64), np.zeros(len(names), U))
        for shard, at in self._by_shard(own):
            for column, values in zip(facts, shard.words_at(names[at])):
                column[at] = values
        count, weights, begin, end, base = facts
        low = (count + 1) / (self.tokens + self.distinct + 1)
        p = np.zeros(len(code))
        todo = np.flatnonzero((begin < end)[before])
        for shard, at in self._by_shard(own[before[todo]]):
            at = todo[at]
            c = before[at]
            p[at] = shard.discounted(code[at], begin[c], end[c], base[c])
        return count[place], np.log10(low)[place], np.log10(p + weights[before] * low[place])


@lru_cache(maxsize=2)
def model(path: str, bits: int, tokens: int, distinct: int) -> Model:
    return Model(path, bits, tokens, distinct)


SCORED = T.StructType([
    T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()),
    T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])


def scorer(path: str, bits: int, tokens: int, distinct: int):
    """Column function: text to its token counts and scores."""
    @F.arrow_udf(SCORED)
    def score(texts: pa.Array) -> pa.Array:
        code, size = sequences(texts.to_pylist())
        count, base, full = model(path, bits, tokens, distinct).score(code, size)
        start = np.cumsum(size) - size
        sums = [np.add.reduceat(x, start) if len(size) else x for x in ((count > 0).astype(np.int64), base, full)]
        return pa.StructArray.from_arrays([pa.array(x) for x in (size, *sums)], names=["n_tokens", "n_known", "base_score", "score"])
    return score


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def score_texts(docs: DataFrame, train: DataFrame, text: str = "text", train_text: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with ``n_tokens, n_known, train_tokens, base_score,
    score`` added or replaced, by a model of ``train``."""
    spark = docs.sparkSession
    bounded_batches(spark)
    volume = train.agg(F.sum(F.octet_length(train_text))).first()[0] or 0
    bits = max(3, int(volume // SHARD_BYTES).bit_length())
    path = fresh_path(spark, "ngram-trie")
    built = written(build_shards(count_pairs(train, train_text, bits), path, 2 ** bits), "ngram-shards")
    tokens, distinct = built.agg(F.sum("tokens"), F.sum("words")).first()
    tokens, distinct = int(tokens or 0), int(distinct or 0)
    scored = docs.withColumn("__scored", scorer(path, bits, tokens, distinct)(F.col(text)))
    names = ("n_tokens", "n_known", "base_score", "score")
    return scored.withColumns({c: F.col(f"__scored.{c}") for c in names} | {"train_tokens": F.lit(tokens).cast("long")}).drop("__scored")
