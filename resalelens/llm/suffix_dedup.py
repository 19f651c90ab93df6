"""Remove every byte that a string of ``SPAN`` bytes covers which also starts elsewhere.

Prefix doubling over all positions would sort several times sixteen bytes for each byte of
text. Here the same idea runs on few positions:

1. In a task, names of 1, 2, 4, ... 32 bytes are formed by doubling: the name of a position
   at twice the length is made of the names at it and at the growing offset. Of the 169
   names inside a window of 200 bytes the smallest (leftmost if equal) is the window's
   anchor. Equal windows have the same anchor at the same place, so only anchors, about
   one in 85 positions, are ranked. An anchor stands for the run of windows that have it.
2. Spark groups anchors by name. One whose name is unique is done: none of its windows
   recurs. If an anchor's whole run (all bytes of all its windows) recurs, all its windows
   do, and one anchor per distinct run is kept to be compared with the others.
3. What is left is ranked again by longer strings: the run is halved, and each half is
   named by the bytes that all its windows share, 116, 158, ... 200 bytes; unique ones are
   done, recurring runs are done, the rest is halved again, until a half is one window.

So all decisions are equalities of strings that lie inside the windows; every window ends
as unique, or as recurring at the full length. A border of a repeated passage costs a row
per round. Names are 64-bit hashes. A hot name is a partial count before the shuffle and a
join on a key that is unique on the other side; one row of each distinct run goes on.

Null texts count as empty. Strings are judged on the input and never cross texts. Repeated
rows are texts of their own, so both lose what they share.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from resalelens.llm.shingles import mixed
from resalelens.llm.tables import Scratch, bounded_batches
from resalelens.operators.storage import is_small

SPAN = 200
GRAM = 32
#: Bytes of text that a task turns into names at a time.
PIECE = 1 << 20

ANCHOR = T.StructType([
    T.StructField("name", T.LongType()), T.StructField("run", T.LongType()),
    T.StructField("at", T.LongType()), T.StructField("lo", T.LongType()), T.StructField("hi", T.LongType())])


def byte_names() -> np.ndarray:
    return mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


BYTES = byte_names()


def names(flat: np.ndarray) -> np.ndarray:
    """Names of the ``GRAM`` bytes at each position, by doubling."""
    name, length = BYTES[flat], 1
    while length < GRAM:
        name = name[:-length] * np.uint64(0x9FB21C651E98DF25) + name[length:]
        name ^= name >> np.uint64(29)
        length *= 2
    return name * np.uint64(0xBF58476D1CE4E5B9)


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest value of every window, from running minima within blocks of its width."""
    n = len(values) - width + 1
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:len(values)] = values
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[width - 1:width - 1 + n])


def _runs(flat: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchors of all windows that lie within one owner: name, position, first and last
    window."""
    if len(flat) < SPAN:
        return (np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)))
    name = names(flat)
    # The position in the low half makes the leftmost of equal names the smallest.
    ranked = (name & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(name), dtype=np.uint64)
    anchor = (window_minima(ranked, SPAN - GRAM + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    window = np.flatnonzero(owner[:len(anchor)] == owner[SPAN - 1:SPAN - 1 + len(anchor)])
    anchor = anchor[window]
    new = np.ones(len(window), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (window[1:] != window[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(window)) - 1
    return name[anchor[first]], anchor[first], window[first], window[last]


def anchors():
    """Column function: text to its anchors, with positions in bytes of the text."""
    @F.arrow_udf(T.ArrayType(ANCHOR))
    def find(texts: pa.Array) -> pa.Array:
        raw = [(t or "").encode() for t in texts.to_pylist()]
        # Long texts are cut into pieces that share SPAN - 1 bytes; short ones are joined.
        pieces = [(i, s, r[s:s + PIECE + SPAN - 1]) for i, r in enumerate(raw) for s in range(0, max(1, len(r) - SPAN + 1), PIECE)]
        columns: list[list[np.ndarray]] = [[], [], [], [], [], []]
        at = 0
        while at < len(pieces):
            to, held = at, 0
            while to < len(pieces) and (to == at or held + len(pieces[to][2]) <= PIECE):
                held += len(pieces[to][2])
                to += 1
            part = pieces[at:to]
            joined = b"".join(p[2] for p in part)
            size = np.array([len(p[2]) for p in part], np.int64)
            start = np.cumsum(size) - size
            owner = np.repeat(np.arange(len(part), dtype=np.int32), size)
            name, place, lo, hi = _runs(np.frombuffer(joined, np.uint8), owner)
            mine = owner[lo]
            shift = np.array([p[1] for p in part], np.int64)[mine] - start[mine]
            run = np.fromiter(
                (xxhash.xxh3_64_intdigest(joined[a:b + SPAN], b - c) for a, b, c in zip(lo.tolist(), hi.tolist(), place.tolist())),
                np.uint64, len(lo)) if len(lo) else np.zeros(0, np.uint64)
            for column, values in zip(columns, (name, run, place + shift, lo + shift, hi + shift, np.array([p[0] for p in part], np.int64)[mine])):
                column.append(values)
            at = to
        name, run, place, lo, hi, text = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in columns)
        ends = np.concatenate([[0], np.cumsum(np.bincount(text.astype(np.int64), minlength=len(raw)))]).astype(np.int32)
        rows = pa.StructArray.from_arrays(
            [pa.array(x.astype(np.uint64).view(np.int64)) for x in (name, run)] + [pa.array(x.astype(np.int64)) for x in (place, lo, hi)],
            names=["name", "run", "at", "lo", "hi"])
        return pa.ListArray.from_arrays(pa.array(ends), rows)
    return find


CUT = T.StructType([
    T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()),
    T.StructField("n_spans", T.LongType()), T.StructField("kept", T.BinaryType())])


def cutter():
    """Column function: text and covered stretches to what is left of the text."""
    @F.arrow_udf(CUT)
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        rows = []
        for text, own in zip(texts.to_pylist(), spans.to_pylist()):
            raw = (text or "").encode()
            kept, at, removed, n = [], 0, 0, 0
            for lo, hi in joined_spans(own or []):
                kept.append(raw[at:lo])
                at, removed, n = hi, removed + hi - lo, n + 1
            kept.append(raw[at:])
            rows.append({"n_bytes": len(raw), "n_removed": removed, "n_spans": n, "kept": b"".join(kept)})
        return pa.array(rows, pa.struct([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())]))
    return cut


def joined_spans(spans: list[dict]) -> list[tuple[int, int]]:
    """Stretches that overlap or touch, as one."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted((s["lo"], s["hi"]) for s in spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def _judge(rows: DataFrame, keep: list[str], scratch: Scratch, turn: int) -> DataFrame:
    """One round over rows with ``name, run, active``: stores the recurring runs of active
    rows (``doc, lo, hi``) and returns one row of each distinct run that must go on."""
    runs = rows.groupBy("name", "run").agg(
        F.count(F.lit(1)).alias("_n"), F.bool_or("active").alias("_active"), F.min(F.struct(*keep)).alias("_one"))
    runs = scratch.store(runs, f"runs-{turn}")
    # A name goes on if it has several runs, and one of them may still recur in part.
    several = runs.groupBy("name").agg(
        F.count(F.lit(1)).alias("_runs"), F.bool_or(F.col("_active") & (F.col("_n") == 1)).alias("_open"))
    several = several.filter((F.col("_runs") > 1) & F.col("_open")).select("name")
    again = runs.filter("_n > 1 AND _active").select("name", "run")
    scratch.store(rows.filter("active").join(again, ["name", "run"]).select("doc", "lo", "hi"), f"found-{turn}")
    return runs.join(several, "name").select("_one.*", (F.col("_active") & (F.col("_n") == 1)).alias("active"))


def _row_key(doc_id: str, text: str) -> Column:
    return F.xxhash64(F.col(doc_id), F.col(text))


PLACE = ["doc", "at", "lo", "hi"]
CELL = [*PLACE, "from", "near", "far", "bytes"]


def repeated_windows(docs: DataFrame, doc_id: str, text: str, scratch: Scratch) -> DataFrame:
    """``doc, lo, hi``: runs of positions in a text at which a recurring window starts."""
    named = scratch.store(
        docs.select(_row_key(doc_id, text).alias("doc"), F.explode(anchors()(F.col(text))).alias("_a")).select("doc", "_a.*"), "anchors")
    several = named.groupBy("name").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("name")
    # Stored, so that the join below deals both sides anew and a hot name can be split.
    several = scratch.store(several, "several")
    shared = scratch.store(named.join(several, "name").withColumn("active", F.lit(True)), "shared-anchors")
    scratch.drop("anchors", "several")
    onward = scratch.store(_judge(shared, PLACE, scratch, 0), "onward")
    scratch.drop("shared-anchors", "runs-0")

    # The bytes around the anchors that go on, as cells of one range of windows.
    places = onward.groupBy("doc").agg(F.collect_list(F.struct("at", "lo", "hi", "active")).alias("_places"))
    raw = F.encode(F.col("text"), "UTF-8")
    texts = docs.select(_row_key(doc_id, text).alias("doc"), F.col(text).alias("text")).join(places, "doc")
    sliced = F.transform("_places", lambda p: F.struct(
        p["at"].alias("at"), p["lo"].alias("lo"), p["hi"].alias("hi"), p["active"].alias("active"),
        F.substring(raw, p["lo"].cast("int") + 1, (p["hi"] - p["lo"]).cast("int") + SPAN).alias("bytes")))
    # A window starts ``back`` bytes before its anchor; cells are ranges of ``back``.
    cells = texts.select("doc", F.explode(sliced).alias("_p")).select("doc", "_p.*")
    cells = cells.select("*", F.col("lo").alias("from"), F.lit(0).alias("near"), F.lit(SPAN - GRAM).alias("far"))
    turn = 1
    while True:
        cells = scratch.store(_named(_halved(cells.filter("near < far"))), f"cells-{turn}")
        scratch.drop("onward" if turn == 1 else f"runs-{turn - 1}")
        if is_small(cells, 0):
            break
        cells = _judge(cells, CELL, scratch, turn)
        if turn > 1:
            scratch.drop(f"cells-{turn - 1}")
        turn += 1
    spark = docs.sparkSession
    found = [spark.read.schema("doc long, lo long, hi long").parquet(scratch.paths[f"found-{t}"]) for t in range(turn)]
    return reduce(DataFrame.union, found)


def _halved(cells: DataFrame) -> DataFrame:
    """Both halves of each cell, with the part of the row's windows that lies in them."""
    middle = F.floor((F.col("near") + F.col("far")) / 2).cast("int")
    halves = F.array(
        F.struct(F.col("near").alias("near"), middle.alias("far")),
        F.struct((middle + 1).alias("near"), F.col("far").alias("far")))
    both = cells.withColumn("_h", F.explode(halves)).withColumns({"near": F.col("_h.near"), "far": F.col("_h.far")}).drop("_h")
    return both.withColumns({
        "lo": F.greatest("lo", F.col("at") - F.col("far")), "hi": F.least("hi", F.col("at") - F.col("near"))}).filter("lo <= hi")


def _named(cells: DataFrame) -> DataFrame:
    """Name: the bytes that all windows of the cell share. Run: all bytes of the row's
    windows in it, and where they start."""
    start = (F.col("at") - F.col("near") - F.col("from")).cast("int")
    core = F.substring("bytes", start + 1, F.col("near") - F.col("far") + SPAN)
    whole = F.substring("bytes", (F.col("lo") - F.col("from")).cast("int") + 1, (F.col("hi") - F.col("lo")).cast("int") + SPAN)
    return cells.withColumns({
        "name": F.xxhash64(core, "near", "far"), "run": F.xxhash64(whole, F.col("at") - F.col("lo"), F.col("near"))})


def drop_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row ``doc_id, n_bytes, n_removed, n_spans, kept``; ``kept`` holds the remaining
    bytes, which need not be whole characters."""
    bounded_batches(docs.sparkSession)
    spans = repeated_windows(docs, doc_id, text, Scratch(docs.sparkSession)).groupBy("doc").agg(
        F.collect_list(F.struct("lo", (F.col("hi") + SPAN).alias("hi"))).alias("_spans"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), _row_key(doc_id, text).alias("doc"))
    done = rows.join(spans, "doc", "left").select("doc_id", cutter()(F.col("text"), F.col("_spans")).alias("_c"))
    return done.select("doc_id", "_c.*")
