"""Find benchmark items in training texts, edited copies included.

Seeds are all word pairs of the items. An alignment of a score ``t`` times the ``m`` words
of an item has ``M`` matches and at most ``M - t m`` edits, which cut the matches into one
run more than there are edits. So it holds ``t m - 1`` seeds or more, and these lie on
diagonals at most ``(1 - t) m`` apart, as every gap shifts them by one. Where a text has
that many hits of an item on such diagonals, the stretch that any alignment around them
can cover is aligned with the item by Smith-Waterman over words. Nothing that reaches the
threshold is passed over, however the item was edited. The score is the best local
alignment as a share of the item's words: matches count 1, other words and gaps -1.

The reference set is read in blocks of ``BLOCK_ITEMS`` items, so what a worker holds does
not grow with it; each block is run against all texts. Texts are never shuffled. Each is
looked up with array operations. A text with many hits of one item has its stretches
joined, so no word is aligned with the same item twice.

Words are runs between white space in lower case, less punctuation at their ends. Items
and texts without words match nothing; items of one or two words are one seed. Repeated rows are rows of their own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F, types as T

from resalelens.llm.bpe import Memo
from resalelens.llm.shingles import MIX, mixed
from resalelens.llm.tables import at_work, bounded_batches, keeps

SEED_WORDS = 2
THRESHOLD = 0.5
BLOCK_ITEMS = 5_000
BLOOM = 1 << 22

EDGES = re.compile(rb"^[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+$")


def _bare(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(EDGES.sub(b"", word) or word)


CODES = Memo(_bare, most=200_000)
keeps("decontamination", CODES.clear)


def coded(text: str | None) -> np.ndarray:
    parts = text.lower().encode().split() if text else []
    return np.fromiter(map(CODES.__getitem__, parts), np.uint64, len(parts))


def ngrams(code: np.ndarray, n: int) -> np.ndarray:
    value = np.zeros(max(0, len(code) - n + 1), np.uint64)
    for j in range(n):
        value = mixed(value * MIX + code[j:j + len(value)])
    return value


class Items:
    """A block of items with its seeds, as arrays that travel to the workers."""

    def __init__(self, rows: list[tuple[int, str]], width: int):
        self.rows = [(i, c) for i, c in ((i, coded(t)) for i, t in rows) if len(c)]
        seeds = [(g, k, at) for k, (_, c) in enumerate(self.rows)
                 for at, g in enumerate(ngrams(c, min(width, len(c))).tolist())]
        seeds.sort()
        self.seed = np.array([s[0] for s in seeds], np.uint64)
        self.item = np.array([s[1] for s in seeds], np.int64)
        self.offset = np.array([s[2] for s in seeds], np.int64)
        self.widths = sorted({min(width, len(c)) for _, c in self.rows})
        self.size = np.array([len(c) for _, c in self.rows], np.int64)
        self.distinct = np.unique(self.seed)
        self.bloom = np.zeros(BLOOM, bool)
        self.bloom[(self.distinct & np.uint64(BLOOM - 1)).astype(np.int64)] = True

    def hits(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in a text and the seeds found there."""
        at, found = [], []
        for width in self.widths:
            grams = ngrams(code, width)
            maybe = np.flatnonzero(self.bloom[(grams & np.uint64(BLOOM - 1)).astype(np.int64)])
            if len(maybe) and len(self.distinct):
                place = np.minimum(np.searchsorted(self.distinct, grams[maybe]), len(self.distinct) - 1)
                real = self.distinct[place] == grams[maybe]
                at.append(maybe[real])
                found.append(grams[maybe][real])
        if not at:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return np.concatenate(at), np.concatenate(found)

    def candidates(self, code: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """Items and diagonals (place in the text less place in the item) of the hits that
        an alignment of that score can hold."""
        at, found = self.hits(code)
        low = np.searchsorted(self.seed, found)
        many = np.searchsorted(self.seed, found, "right") - low
        own = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        item, begin = self.item[own], np.repeat(at, many) - self.offset[own]
        order = np.lexsort((begin, item))
        item, begin = item[order], begin[order]
        need = np.maximum(1, np.ceil(threshold * self.size[item] - 1e-9).astype(np.int64) - 1)
        # The last of the hits needed, if it is of the same item and near enough.
        last = np.arange(len(item)) + need - 1
        here = np.flatnonzero(last < len(item))
        last = last[here]
        apart = (1 - threshold) * self.size[item[here]] + 1e-9
        good = (item[last] == item[here]) & (begin[last] - begin[here] <= apart)
        # Hits in any such range.
        cover = np.zeros(len(item) + 1, np.int64)
        np.add.at(cover, here[good], 1)
        np.add.at(cover, last[good] + 1, -1)
        stay = np.cumsum(cover[:-1]) > 0
        pairs = np.unique(np.stack([item[stay], begin[stay]]), axis=1)
        return pairs[0], pairs[1]

    def matches(self, code: np.ndarray, threshold: float) -> list[dict]:
        """Items that a text holds: item, score, and the stretch of words that was aligned."""
        spans: dict[int, list[tuple[int, int]]] = {}
        for k, begin in zip(*(x.tolist() for x in self.candidates(code, threshold))):
            # As far as gaps can take an alignment that starts or ends on this diagonal.
            size = len(self.rows[k][1])
            slack = int((1 - threshold) * size) + 1
            spans.setdefault(k, []).append((max(0, begin - slack), min(len(code), begin + size + slack)))
        out = []
        for k, own in spans.items():
            item_id, item = self.rows[k]
            best = max(((local_score(item, code[a:b]) / len(item), a, b) for a, b in joined(own)))
            if best[0] >= threshold:
                out.append({"item_id": item_id, "score": best[0], "from_word": best[1], "to_word": best[2]})
        return sorted(out, key=lambda m: m["item_id"])


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping stretches as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def local_score(item: np.ndarray, stretch: np.ndarray) -> int:
    """Smith-Waterman score: +1 a match, -1 a mismatch or gap. One row of the table at a
    time; gaps along the row are a running maximum."""
    steps = np.arange(1, len(stretch) + 1)
    row, best = np.zeros(len(stretch) + 1, np.int64), 0
    for word in item:
        cell = np.maximum(row[:-1] + np.where(stretch == word, 1, -1), row[1:] - 1)
        cell = np.maximum(cell, 0)
        row[1:] = np.maximum.accumulate(cell + steps) - steps
        best = max(best, int(row.max()))
    return best


MATCH = T.ArrayType(T.StructType([
    T.StructField("item_id", T.LongType()), T.StructField("score", T.DoubleType()),
    T.StructField("from_word", T.LongType()), T.StructField("to_word", T.LongType())]))


def blocks(items: DataFrame, item_id: str, text: str, width: int) -> Iterator[Items]:
    """The reference set, block by block."""
    n = max(1, -(-items.count() // BLOCK_ITEMS))
    own = items.select(F.col(item_id).alias("i"), F.col(text).alias("t"))
    for b in range(n):
        part = own.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b).distinct()
        yield Items([(r.i, r.t) for r in part.toLocalIterator()], width)


def aligner(block: Broadcast[Items], threshold: float):
    """Column function: text to the items it holds."""
    kind = pa.list_(pa.struct([
        ("item_id", pa.int64()), ("score", pa.float64()), ("from_word", pa.int64()), ("to_word", pa.int64())]))

    @F.arrow_udf(MATCH)
    def align(texts: pa.Array) -> pa.Array:
        at_work("decontamination")
        return pa.array((block.value.matches(coded(t), threshold) for t in texts.to_pylist()), kind)
    return align


def find_items(
    docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    width: int = SEED_WORDS, threshold: float = THRESHOLD,
) -> DataFrame:
    """All rows and columns with ``matches`` added or replaced: an array of ``item_id``,
    ``score``, ``from_word``, ``to_word``, empty for clean texts."""
    spark = docs.sparkSession
    bounded_batches(spark)
    found = F.array().cast(MATCH)
    for block in blocks(items, item_id, item_text, width):
        align = aligner(spark.sparkContext.broadcast(block), threshold)
        found = F.concat(found, align(F.col(text)))
    return docs.withColumn("matches", found)
