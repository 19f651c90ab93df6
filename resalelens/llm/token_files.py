"""Token ids in files of Simple-8b words.

A file is a row of a Parquet table: documents are dealt by ranges of ``doc_id``, each
task writes its own files in order, and Spark's writer places them, so any store that
Spark reaches will do and a lost task is simply run again. A file holds whole documents,
about ``FILE_IDS`` ids of them, and their lengths.

The payload is cut into blocks of ``BLOCK`` ids. Each 64-bit word has a 4-bit selector
that says how many ids of how many bits follow; a value of 60 bits or more is an escape
word and the raw value. The payload starts with the number of ids and, per block, the
offset of its first word, so every block is found without reading the ones before it
and all blocks are packed and unpacked at once with array operations.

Null and empty texts hold the end id alone. Rows with equal or null ``doc_id`` are kept,
nulls first, ties ordered by a hash of the text.
"""

from __future__ import annotations

import os
import string
import struct
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from resalelens.llm.bpe import MEMO_CHUNKS, MEMO_KEY, byte_symbols, lower, vocabulary
from resalelens.llm.tables import at_work, bounded_batches, keeps
from resalelens.operators.storage import fresh_path, written

# Fixed values of the format: ids per word and bits per id for each selector.
COUNTS = np.array([0, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
BITS = np.array([64, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], np.int64)
MASKS = np.array([(1 << int(b)) - 1 for b in BITS], np.uint64)
ESCAPE = 0
BLOCK = 128
FILE_IDS = 1 << 16
END_ID = 2
# Texts encoded at a time: the more, the fewer distinct chunks there are for each of them.
BATCH_ROWS = 2_000
BATCH_BYTES = 8 << 20


def bit_lengths(values: np.ndarray) -> np.ndarray:
    """Bits of each unsigned integer, read off floats that hold it, or its halves, exactly."""
    if int(values.max(initial=0)) < 1 << 24:
        return np.maximum((values.astype(np.float32).view(np.int32) >> 23) - 126, 0).astype(np.uint8)
    low = np.frexp((values & np.uint64(0xFFFFFFFF)).astype(np.float64))[1]
    high = np.frexp((values >> np.uint64(32)).astype(np.float64))[1]
    return np.where(high > 0, high + 32, low).astype(np.uint8)


def _selectors(width: np.ndarray) -> np.ndarray:
    """The selector with most ids that fits, at every position. Places of a block go down the
    array, so that all blocks are scanned at once; what lies beyond a block has no width. A
    selector fits if one of fewer ids does not fit less, so those that fit need only be counted."""
    widest = np.zeros((BLOCK + int(COUNTS.max()) // 2, width.shape[1]), np.uint8)
    widest[:BLOCK] = width
    fits = np.zeros(width.shape, np.uint8)
    seen = 1
    for k in range(len(COUNTS) - 1, 0, -1):
        further = int(COUNTS[k]) - seen      # never more than the ids seen so far
        if further:
            widest[:BLOCK] = np.maximum(widest[:BLOCK], widest[further:BLOCK + further])
            seen += further
        fit = widest[:BLOCK] <= BITS[k]
        if not fit.any():
            break
        fits += fit
    return np.where(fits > 0, len(COUNTS) - fits, ESCAPE).astype(np.uint8)


def pack(ids: np.ndarray) -> bytes:
    """Simple-8b payload of unsigned integers of up to 64 bits."""
    n = len(ids)
    if not n:
        return struct.pack("<Q", 0)
    blocks = -(-n // BLOCK)
    width = np.zeros(blocks * BLOCK, np.uint8)
    width[:n] = bit_lengths(ids)
    best = _selectors(np.ascontiguousarray(width.reshape(blocks, BLOCK).T)).ravel()

    # All blocks go from word to word at once.
    jump = (np.maximum(COUNTS, 1) * blocks)[best]
    first = np.zeros(blocks * BLOCK, bool)
    at = np.arange(blocks)
    while len(at):
        first[at] = True
        at = at + jump[at]
        at = at[at < len(first)]
    start = np.flatnonzero(first.reshape(BLOCK, blocks).T.ravel()[:n])
    k = best.reshape(BLOCK, blocks).T.ravel()[start]

    length = np.diff(start, append=n)
    shift = (np.arange(n) - np.repeat(start, length)) * np.repeat(BITS[k], length)
    joined = np.bitwise_or.reduceat(ids.astype(np.uint64) << shift.astype(np.uint64), start)
    escape = k == ESCAPE
    place = np.cumsum(1 + escape) - (1 + escape)
    words = np.zeros(len(k) + int(escape.sum()), np.uint64)
    words[place] = np.where(escape, np.uint64(0), k.astype(np.uint64) << np.uint64(60) | joined)
    words[place[escape] + 1] = joined[escape]
    starts = place[np.searchsorted(start, np.arange(blocks) * BLOCK)].astype("<u4")
    return struct.pack("<Q", n) + starts.tobytes() + words.astype("<u8").tobytes()


def unpack(payload: bytes) -> np.ndarray:
    """The integers of a payload."""
    (n,) = struct.unpack_from("<Q", payload)
    blocks = -(-n // BLOCK)
    starts = np.frombuffer(payload, "<u4", blocks, 8).astype(np.int64)
    words = np.frombuffer(payload, "<u8", -1, 8 + 4 * blocks)
    select = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    raw[1:] = select[:-1] == ESCAPE      # an escaped value has a bit above the 60th
    select[raw] = ESCAPE
    count = np.where(raw, 1, COUNTS[select])
    before = np.cumsum(count) - count
    block = np.searchsorted(starts, np.arange(len(words)), "right") - 1
    length = np.minimum(count, BLOCK - (before - before[starts][block]))
    end = np.cumsum(length)
    total = int(end[-1]) if blocks else 0
    shift = (np.arange(total) - np.repeat(end - length, length)) * np.repeat(BITS[select], length)
    return (np.repeat(words, length) >> shift.astype(np.uint64) & np.repeat(MASKS[select], length))[:n]


def _remember(memo: dict[str, bytes], keys: list[str], values: list[bytes], times: list[int]) -> None:
    """Add to a bounded memo: first what a batch has more than once; the rest takes a quarter
    of the memo at most."""
    for least, most in ((2, MEMO_CHUNKS), (1, MEMO_CHUNKS // 4)):
        for key, value, n in zip(keys, values, times):
            if len(memo) >= most:
                break
            if n >= least and len(key) <= MEMO_KEY:
                memo[key] = value


def _borders(values: pa.Array) -> np.ndarray:
    """Where each text or binary begins and ends, in bytes, if they stand one after the other."""
    borders = np.zeros(len(values) + 1, np.int64)
    np.cumsum(pc.binary_length(values).to_numpy(), out=borders[1:])
    return borders


def _data(values: pa.Array) -> pa.Buffer:
    """Bytes of texts or binaries that a function has just made, one after the other."""
    return values.buffers()[2] or pa.py_buffer(b"")


class LibraryEncoder:
    """Ids from the tokenizers library. White space ends every token of this vocabulary,
    and so does the border of letters and punctuation: a text's ids are those of its chunks,
    and a chunk's those of a word of letters and of the punctuation after it. Arrow finds the
    distinct ones of a batch, and each is encoded once, or never while the bounded memos hold
    it; other chunks are encoded whole. Words of Latin letters alone, in normal form and lower
    case, are one piece to the library's splitter and go to its model without it. Words are
    encoded many at a time, with a space between them, and told apart by their last tokens."""

    TAIL = string.punctuation
    AT_ONCE = 500
    LATIN_END = "\u0250"

    def __init__(self, spec_text: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = Tokenizer.from_str(spec_text)
        self.latin = Tokenizer(self.tokenizer.model)
        self.latin.pre_tokenizer = WhitespaceSplit()
        self.symbols = dict(enumerate(byte_symbols())) | {ord(" "): " "}
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.memo: dict[str, bytes] = {}
        self.whole: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _latin_ids(self, texts: list[str]) -> list[bytes]:
        spelt = [t if t.isascii() else t.encode().decode("latin-1").translate(self.symbols) for t in texts]
        found = self.latin.encode_batch_fast(spelt, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _word_ids(self, words: list[str], encode: Callable[[list[str]], list[bytes]]) -> dict[str, bytes]:
        """Ids of words of letters in normal form and lower case. A group in which the library
        sees other borders than the spaces is encoded word by word."""
        out = {}
        for i in range(0, len(words), self.AT_ONCE):
            group = words[i:i + self.AT_ONCE]
            (ids,) = encode([" ".join(group)])
            cuts = (4 * (np.flatnonzero(self.ends[np.frombuffer(ids, "<u4")]) + 1)).tolist()
            if len(cuts) != len(group):
                out |= zip(group, encode(group))
                continue
            out |= zip(group, map(ids.__getitem__, map(slice, [0, *cuts], cuts)))
        return out

    def _pieces(self, chunks: pa.StringArray) -> pa.StringArray:
        """Chunks in normal form and lower case, each as two: what stands before the punctuation
        at its end, and that punctuation. No chunk holds a line end, and none joins with what
        stands beside it."""
        (lines,) = pc.binary_join(pa.ListArray.from_arrays([0, len(chunks)], chunks), "\n").to_pylist()
        plain = pc.split_pattern(pa.array([lower(unicodedata.normalize("NFC", lines))]), "\n").flatten()
        borders = np.zeros(2 * len(chunks) + 1, np.int32)
        borders[::2] = _borders(plain)
        borders[1::2] = borders[:-1:2] + pc.binary_length(pc.ascii_rtrim(plain, characters=self.TAIL)).to_numpy()
        return pa.Array.from_buffers(pa.string(), 2 * len(chunks), [None, pa.py_buffer(borders), _data(plain)])

    def _piece_ids(self, pieces: list[str], times: list[int]) -> tuple[list[bytes], np.ndarray]:
        """Ids of pieces, and which are neither words nor punctuation at the end of chunks."""
        ids = list(map(self.memo.get, pieces))
        missing = [k for k, known in enumerate(ids) if known is None]
        fresh = [pieces[k] for k in missing]
        words = list(filter(str.isalpha, fresh))
        latin = [w for w in words if w.isascii() or max(w) < self.LATIN_END]
        new = self._word_ids(latin, self._latin_ids)
        if len(latin) < len(words):
            new |= self._word_ids([w for w in words if w not in new], self._ids)
        ends = [p for p in fresh if not p or p[-1] in self.TAIL]
        new |= zip(ends, self._ids(ends))
        found = list(map(new.get, fresh))
        _remember(self.memo, fresh, found, [times[k] for k in missing])
        odd = np.zeros(len(pieces), bool)
        for k, known in zip(missing, found, strict=True):
            odd[k] = known is None
            ids[k] = known or b""
        return ids, odd

    def _whole_ids(self, chunks: list[str], times: list[int]) -> list[bytes]:
        """Ids of chunks that the library has to split."""
        fresh = [c for c in chunks if c not in self.whole]
        known = self.whole | dict(zip(fresh, self._ids(fresh)))
        ids = list(map(known.__getitem__, chunks))
        _remember(self.whole, chunks, ids, times)
        return ids

    def _chunk_ids(self, chunks: pa.StringArray, times: np.ndarray) -> pa.LargeBinaryArray:
        """Ids of distinct chunks that a batch has so many times."""
        halves = self._pieces(chunks).dictionary_encode()
        at = halves.indices.to_numpy()
        pieces = halves.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids, odd = self._piece_ids(pieces, np.bincount(at, np.repeat(times, 2)).tolist())
        joined = pa.array(ids, pa.large_binary()).take(halves.indices)
        borders = np.ascontiguousarray(_borders(joined)[::2])
        coded = pa.Array.from_buffers(pa.large_binary(), len(chunks), [None, pa.py_buffer(borders), _data(joined)])
        whole = np.flatnonzero(odd[at[::2]])
        if not len(whole):
            return coded
        own = self._whole_ids(chunks.take(pa.array(whole)).to_pylist(), times[whole].tolist())
        place = np.arange(len(chunks))
        place[whole] = len(chunks) + np.arange(len(whole))
        return pa.concat_arrays([coded, pa.array(own, pa.large_binary())]).take(pa.array(place))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """32-bit ids of whole texts, one after the other, and how many each text has."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        found = split.flatten().dictionary_encode()
        if not len(found):
            return np.zeros(0, "<u4"), np.zeros(len(texts), np.int64)
        times = np.bincount(found.indices.to_numpy())
        joined = self._chunk_ids(found.dictionary, times).take(found.indices)
        borders = _borders(joined) // 4
        starts = split.offsets.to_numpy()
        return np.frombuffer(_data(joined), "<u4", int(borders[-1])), np.diff(borders[starts - starts[0]])

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 32-bit ids of whole texts."""
        ids, count = self.encode(pa.array(texts, pa.string()))
        return [part.tobytes() for part in np.split(ids, np.cumsum(count)[:-1])] if texts else []


@lru_cache(maxsize=2)
def library_encoder(spec_text: str) -> LibraryEncoder:
    return LibraryEncoder(spec_text)


keeps("token files", library_encoder.cache_clear)


FILES = "part int, seq int, start_in_part long, doc_ids array<long>, lengths array<long>, payload binary"


def write_files(docs: DataFrame, path: str, vocabulary_path: str, end_id: int = END_ID) -> None:
    """Write the ids of all texts, each followed by ``end_id``, in ascending ``doc_id``."""
    spark = docs.sparkSession
    bounded_batches(spark, BATCH_ROWS, BATCH_BYTES)
    spec = vocabulary(spark, vocabulary_path)

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, start = TaskContext.get().partitionId(), 0, 0
        keys, lengths, ids, held = [], [], [], 0
        at_work("token files")
        encode = library_encoder(spec.value).encode

        def file():
            row = [[part], [seq], [start], [keys], [lengths], [pack(np.concatenate(ids))]]
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, FILE_SCHEMA)], schema=FILE_SCHEMA)

        for batch in batches:
            coded, count = encode(batch.column(1))
            coded = np.insert(coded, np.cumsum(count), end_id)
            begin = at = 0
            for key, n in zip(batch.column(0).to_pylist(), (count + 1).tolist()):
                keys.append(key)
                lengths.append(n)
                at += n
                held += n
                if held >= FILE_IDS:
                    ids.append(coded[begin:at])
                    yield file()
                    seq, start, begin = seq + 1, start + held, at
                    keys, lengths, ids, held = [], [], [], 0
            ids.append(coded[begin:at])
        if keys:
            yield file()

    tie = F.xxhash64("text")
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)
    ordered.mapInArrow(files, FILES).write.parquet(path)


FILE_SCHEMA = pa.schema([
    ("part", pa.int32()), ("seq", pa.int32()), ("start_in_part", pa.int64()),
    ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("payload", pa.binary())])

READ = "part int, doc_id long, start_in_part long, n_tokens long, ids binary"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Per document ``doc_id, start, n_tokens, ids`` from the files; ``start`` counts the
    ids of all documents before it. Ids are little-endian unsigned 32-bit integers."""
    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f in batch.to_pylist():
                ids = unpack(f["payload"]).astype("<u4").tobytes()
                n = np.array(f["lengths"], np.int64)
                ends = np.cumsum(n)
                yield pa.RecordBatch.from_arrays([
                    pa.array([f["part"]] * len(n), pa.int32()), pa.array(f["doc_ids"], pa.int64()),
                    pa.array(f["start_in_part"] + ends - n), pa.array(n),
                    pa.array([ids[4 * (e - k):4 * e] for e, k in zip(ends.tolist(), n.tolist())], pa.binary()),
                ], names=["part", "doc_id", "start_in_part", "n_tokens", "ids"])

    stored = spark.read.schema(FILES).parquet(path)
    # One row per writing task; sizes come from the lengths, not the payloads.
    length = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
    sizes = stored.groupBy("part").agg(F.sum(length).alias("_size"))
    earlier = F.sum("_size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = written(sizes.select("part", F.coalesce(earlier, F.lit(0)).alias("_before")), "token-offsets")
    return (
        stored.select("part", "seq", "start_in_part", "doc_ids", "lengths", "payload").mapInArrow(documents, READ)
        .join(offsets, "part")
        .select("doc_id", (F.col("start_in_part") + F.col("_before")).alias("start"), "n_tokens", "ids")
    )


def through_files(docs: DataFrame, vocabulary_path: str, end_id: int = END_ID) -> DataFrame:
    """Write the files to the shared folder and read them back."""
    path = fresh_path(docs.sparkSession, "token-files")
    write_files(docs, path, vocabulary_path, end_id)
    return read_files(docs.sparkSession, path)


def checksum(ids: str):
    """Unsigned crc32 of a binary column."""
    return F.crc32(F.col(ids))
