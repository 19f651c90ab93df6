"""Word shingles of whole texts as arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

from resalelens.llm.bpe import Memo
from resalelens.llm.tables import at_work, keeps

MIX = np.uint64(0x9E3779B97F4A7C15)
WORDS = Memo(xxhash.xxh3_64_intdigest, most=200_000)
keeps("shingles", WORDS.clear)


def words(text: str | None) -> list[bytes]:
    """Runs of bytes other than space and 09 to 0D, with A-Z in lower case."""
    return text.encode().lower().split() if text else []


def word_hashes(parts: list[bytes]) -> np.ndarray:
    return np.fromiter(map(WORDS.__getitem__, parts), np.uint64, len(parts))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, one after the other, and how many each
    has. A text of fewer words than ``width`` has one shingle, without words none."""
    at_work("shingles")
    parts = [words(t) for t in texts]
    size = np.array([len(p) for p in parts], np.int64)
    code = word_hashes([w for p in parts for w in p])
    start = np.cumsum(size) - size
    count = np.where(size >= width, size - width + 1, np.minimum(size, 1))
    owner = np.repeat(np.arange(len(texts)), count)
    at = np.repeat(start - (np.cumsum(count) - count), count) + np.arange(len(owner))
    value = np.zeros(len(at), np.uint64)
    for j in range(width):
        inside = at + j < (start + size)[owner]
        step = mixed(code[np.minimum(at + j, max(0, len(code) - 1))] + MIX * np.uint64(j + 1)) if len(code) else value
        value = np.where(inside, mixed(value * MIX + step), value)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    first = np.ones(len(value), bool)
    first[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[first], owner[first]
    return value, np.bincount(owner, minlength=len(texts)).astype(np.int64)
