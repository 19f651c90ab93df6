"""Product codes of vectors: one byte per part, nearest entries found through memoised grid cells.

Components become integers, ``floor(256 * x)``, and each vector is cut into ``PARTS`` equal
consecutive parts. The codebook of a part starts as that part of the vectors with the
smallest ids and is moved ``rounds`` times to the floor of the mean of its parts, so all
arithmetic is exact and results do not depend on the order of rows.

The nearest entry of a part is looked up by its grid cell. For a cell seen for the first
time the entries are bounded from below and above over the cell's whole box; an entry whose
lower bound exceeds the smallest upper bound is dominated and can win nowhere in the box.
The others are kept in a memo, and only they are evaluated exactly, for every part that
falls into the cell. The memo lives as long as a task and is emptied at ``MEMO_CELLS``
cells per part, which costs time and changes no result.

A round sends one row of sums per codebook component and task to the shuffle; the codebooks
(``ENTRIES`` vectors) are all that ever reaches the driver or is sent to the workers.

Rows whose vector is null or holds a null or non-finite component are dropped. Vectors
shorter than the longest one, and lengths that are no multiple of ``PARTS``, count as
padded with zeros. Integers are held within +-2**24, which components below 65,536 never
reach. Fewer rows than entries give a smaller codebook; an empty table gives no rows.
Repeated ids are rows of their own, null ids come last; labels may be null.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from resalelens.llm.tables import bounded_batches
from resalelens.operators.storage import written

SCALE = 256
PARTS = 16
ENTRIES = 64
ROUNDS = 2
LIMIT = 1 << 24
MEMO_CELLS = 10_000
#: Component differences evaluated at once.
BLOCK = 1 << 20


class Cells:
    """Nearest entry of one part's codebook, ties to the lower index."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.shift = self._width()
        self.forget()

    def _width(self) -> int:
        """Power of two of the cell width: about the usual gap between entries, per axis."""
        e = self.entries
        if len(e) < 2 or not e.shape[1]:
            return 0
        gap = ((e[:, None, :] - e[None, :, :]) ** 2).sum(axis=2).astype(np.float64)
        np.fill_diagonal(gap, np.inf)
        usual = np.sqrt(np.median(gap.min(axis=1)) / e.shape[1])
        return int(np.log2(max(usual, 1.0)))

    def forget(self) -> None:
        self.slots: dict[bytes, int] = {}
        self.counts = np.zeros(0, np.int64)
        self.starts = np.zeros(0, np.int64)
        self.listed = np.zeros(0, np.int64)

    def undominated(self, cells: np.ndarray) -> np.ndarray:
        """Which entries may be nearest to some point of each cell's box."""
        low = (cells << self.shift)[:, None, :]
        high = low + (1 << self.shift) - 1
        e = self.entries[None, :, :]
        least = (np.maximum(np.maximum(low - e, e - high), 0) ** 2).sum(axis=2)
        most = (np.maximum(np.abs(e - low), np.abs(e - high)) ** 2).sum(axis=2)
        return least <= most.min(axis=1, keepdims=True)

    def _slots_of(self, cells: np.ndarray) -> np.ndarray:
        names = [c.tobytes() for c in cells]
        new = [i for i, name in enumerate(names) if name not in self.slots]
        if len(self.slots) + len(new) > MEMO_CELLS:
            self.forget()
            new = list(range(len(names)))
        step = max(1, BLOCK // max(1, self.entries.size))
        for at in range(0, len(new), step):
            some = new[at:at + step]
            keep = self.undominated(cells[some])
            counts = keep.sum(axis=1)
            first = len(self.listed) + np.cumsum(counts) - counts
            for i in some:
                self.slots[names[i]] = len(self.slots)
            self.counts = np.concatenate([self.counts, counts])
            self.starts = np.concatenate([self.starts, first])
            self.listed = np.concatenate([self.listed, np.nonzero(keep)[1]])
        return np.array([self.slots[name] for name in names], np.int64)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry and its squared distance for each row of ``x``."""
        if not x.shape[1]:
            return np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        cells = np.ascontiguousarray(x >> self.shift)
        _, first, of_row = np.unique(
            cells.view(np.dtype((np.void, cells.dtype.itemsize * cells.shape[1]))).ravel(), return_index=True, return_inverse=True)
        slots = self._slots_of(cells[first])[of_row]
        index, error = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
        step = max(1, BLOCK // max(1, self.entries.size))
        for at in range(0, len(x), step):
            index[at:at + step], error[at:at + step] = self._exact(x[at:at + step], slots[at:at + step])
        return index, error

    def _exact(self, x: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts = self.counts[slots]
        ends = np.cumsum(counts)
        row = np.repeat(np.arange(len(x)), counts)
        entry = self.listed[np.arange(ends[-1]) - np.repeat(ends - counts - self.starts[slots], counts)]
        distance = ((x[row] - self.entries[entry]) ** 2).sum(axis=1)
        best = np.minimum.reduceat(distance, ends - counts)
        hit = np.flatnonzero(distance == best[row])
        lowest = hit[np.flatnonzero(np.diff(row[hit], prepend=-1))]
        return entry[lowest], best


class Coder:
    """Codes of whole batches: ``codebooks`` is (part, entry, component)."""

    def __init__(self, codebooks: np.ndarray):
        self.codebooks = codebooks
        self.cells = [Cells(book) for book in codebooks]

    def code(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``x`` is (row, part, component); codes and squared distances are (row, part)."""
        found = [cells.nearest(np.ascontiguousarray(x[:, p])) for p, cells in enumerate(self.cells)]
        return np.stack([i for i, _ in found], axis=1), np.stack([d for _, d in found], axis=1)


def _whole(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False))


def _parted(column: pa.Array, width: int) -> np.ndarray:
    """Stored integers of a batch as (row, part, component)."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), PARTS, width)


def _quantiser(width: int):
    def quantise(batches):
        for batch in batches:
            vectors = batch.column("parts")
            lengths = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            out = np.zeros((len(vectors), PARTS * width), np.int32)
            row = np.repeat(np.arange(len(vectors)), lengths)
            place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            out[row, place] = np.clip(np.floor(np.clip(flat, -LIMIT, LIMIT) * SCALE), -LIMIT, LIMIT)
            offsets = pa.array(np.arange(len(vectors) + 1, dtype=np.int32) * (PARTS * width))
            yield pa.record_batch(
                [batch.column("vec_id"), batch.column("label"), pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))],
                names=["vec_id", "label", "parts"])
    return quantise


def _summer(codebooks: np.ndarray):
    """Per task: rows (place, total, n), ``place`` counting components of the codebooks."""
    def sums(batches):
        coder = Coder(codebooks)
        parts, entries, width = codebooks.shape
        total, n = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            x = _parted(batch.column("parts"), width)
            index, _ = coder.code(x)
            for p in range(parts):
                np.add.at(total[p], index[:, p], x[:, p])
                n[p] += np.bincount(index[:, p], minlength=entries)
        used = np.repeat(n.ravel(), width)
        place = np.flatnonzero(used)
        yield pa.record_batch(
            [pa.array(place), pa.array(total.ravel()[place]), pa.array(used[place])], names=["place", "total", "n"])
    return sums


def _coded(codebooks: np.ndarray):
    def code(batches):
        coder = Coder(codebooks)
        for batch in batches:
            index, error = coder.code(_parted(batch.column("parts"), codebooks.shape[2]))
            names = [row.tobytes().hex() for row in index.astype(np.uint8)]
            yield pa.record_batch(
                [batch.column("vec_id"), batch.column("label"), pa.array(names, pa.string()), pa.array(error.sum(axis=1))],
                names=["vec_id", "label", "code", "error"])
    return code


def _moved(parts: DataFrame, codebooks: np.ndarray) -> np.ndarray:
    """Codebooks after one round."""
    sums = parts.select("parts").mapInArrow(_summer(codebooks), "place long, total long, n long")
    means = sums.groupBy("place").agg(F.sum(F.col("total").cast("decimal(20,0)")).alias("total"), F.sum("n").alias("n"))
    moved = codebooks.copy().ravel()
    for row in means.collect():   # one row per component of the codebooks at most
        moved[row.place] = int(row.total) // row.n
    return moved.reshape(codebooks.shape)


def encode(
    rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
    entries: int = ENTRIES, rounds: int = ROUNDS,
) -> tuple[DataFrame, np.ndarray]:
    """Per kept row ``vec_id, label, code, error``, stored, and the codebooks as (part, entry,
    component). ``code`` has two hex digits per part; ``entries`` is 256 at most."""
    spark = rows.sparkSession
    bounded_batches(spark)
    kept = rows.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("parts")).filter(_whole(F.col("parts")))
    longest = kept.agg(F.max(F.size("parts"))).first()[0] or 0
    width = -(-longest // PARTS)
    kinds = dict(kept.dtypes)
    ids = f"vec_id {kinds['vec_id']}, label {kinds['label']}"
    parts = written(kept.mapInArrow(_quantiser(width), f"{ids}, parts array<int>"), "vector-parts")
    first = parts.orderBy(F.col("vec_id").asc_nulls_last(), "parts").limit(entries).collect()
    codebooks = np.array([r.parts for r in first], np.int64).reshape(len(first), PARTS, width).transpose(1, 0, 2)
    if len(first):
        for _ in range(rounds):
            codebooks = _moved(parts, codebooks)
    return written(parts.mapInArrow(_coded(codebooks), f"{ids}, code string, error long"), "vector-codes"), codebooks


def decoded(codebooks: np.ndarray, code: str) -> list[int]:
    """Integer components that a code stands for, padding included."""
    return [int(x) for p, i in enumerate(bytes.fromhex(code)) for x in codebooks[p, i]]


def checksum(codebooks: np.ndarray) -> str:
    """SHA-256 of all entries' components by part, entry and position, ``,``-joined."""
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def with_label_error(coded: DataFrame) -> DataFrame:
    """``label_error``: the error of all rows of the same label, null being a label."""
    totals = coded.groupBy(F.col("label").alias("__of")).agg(F.sum("error").alias("label_error"))
    return coded.join(totals, F.col("label").eqNullSafe(F.col("__of")), "left").drop("__of")
