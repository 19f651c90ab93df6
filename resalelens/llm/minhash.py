"""Near-duplicate documents by min-max hashing.

A document is the set of its word shingles. Under each of some hash functions
both the smallest and the largest value are kept, two signature values for one hash
evaluation. Bands of ``ROWS`` values are the buckets in which documents meet; documents
that never meet in a band are never compared.

Equal sets are one class, and only classes are compared. Links are confirmed on the full
sets of both texts. What is asked for are groups, so pairs that are already connected are
not compared again:

1. In every bucket one class is compared with all others (a star), and what is linked
   gets one label. That settles the usual groups of copies.
2. What is left are classes of buckets that hold several labels. Their shingles are put
   in one order, rarest first. Two linked sets must share a shingle near the start of
   both orders (the exact prefix bounds of set similarity joins), so classes of different
   labels meet through those shingles only, and sizes and places bound the rest. Texts
   that are alike in what all of them share, and differ in what is rare, never meet.
3. At each such shingle, the label that most of its classes have is not compared with
   itself; a shingle of many classes is cut into parts. Nothing is cut off.

The number of bands follows from the threshold: a pair at it meets in no band with a
probability below ``MISS``.

Null and empty texts have no shingles, link with nothing, and are kept. Repeated rows are
rows of their own. ``doc_id`` may repeat or be null: rows are told apart by their text.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from resalelens.llm.components import components
from resalelens.llm.shingles import shingle_sets, words
from resalelens.llm.tables import bounded_batches
from resalelens.operators.storage import is_small, written

#: Values per band: the smallest and largest of two permutations.
ROWS = 4
#: Chance that a pair at the threshold meets in no band.
MISS = 1e-6
SEED = 20
#: A pair is compared if its signatures agree in this share less than the threshold: over
#: six standard deviations of the estimate.
SLACK = 0.25
#: Classes per part of a shared shingle.
PART = 512

SIGNED = T.StructType([
    T.StructField("n_shingles", T.LongType()), T.StructField("class", T.LongType()),
    T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("signature", T.BinaryType())])


def permutations(percent: int) -> int:
    """Permutations whose bands miss a pair at the threshold with a chance of ``MISS``."""
    meet = (percent / 100) ** ROWS
    bands = 1 if meet >= 1 else math.ceil(math.log(MISS) / math.log1p(-meet))
    return bands * ROWS // 2


def multipliers(count: int) -> np.ndarray:
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(value: np.ndarray, count: np.ndarray, percent: int) -> np.ndarray:
    """Smallest and largest value under each permutation, side by side, for documents with
    shingles."""
    start = (np.cumsum(count) - count)[count > 0]
    factors = multipliers(permutations(percent))
    out = np.empty((len(start), 2 * len(factors)), np.uint32)
    for p, factor in enumerate(factors):
        hashed = ((value * factor) >> np.uint64(32)).astype(np.uint32)
        out[:, 2 * p] = np.minimum.reduceat(hashed, start)
        out[:, 2 * p + 1] = np.maximum.reduceat(hashed, start)
    return out


def signer(width: int, percent: int):
    """Column function: text to its set size, class, band values and signature."""
    @F.arrow_udf(SIGNED)
    def sign(texts: pa.Array) -> pa.Array:
        value, count = shingle_sets(texts.to_pylist(), width)
        ends = np.cumsum(count)
        sig = iter(signatures(value, count, percent) if len(value) else ())
        rows = []
        for n, end in zip(count.tolist(), ends.tolist()):
            if not n:
                rows.append({"n_shingles": 0, "class": None, "bands": None, "signature": None})
                continue
            mine = next(sig).tobytes()
            step = 4 * ROWS
            bands = [xxhash.xxh3_64_intdigest(mine[i:i + step], i) for i in range(0, len(mine), step)]
            own = xxhash.xxh3_64_intdigest(value[end - n:end].tobytes())
            rows.append({
                "n_shingles": n, "class": own - (1 << 63),
                "bands": [b - (1 << 63) for b in bands], "signature": mine})
        return pa.array(rows, pa.struct([
            ("n_shingles", pa.int64()), ("class", pa.int64()), ("bands", pa.list_(pa.int64())), ("signature", pa.binary())]))
    return sign


def agreement():
    """Column function: share of equal values of two signatures."""
    @F.arrow_udf(T.DoubleType())
    def agree(a: pa.Array, b: pa.Array) -> pa.Array:
        x, y = (np.frombuffer(b"".join(s.to_pylist()), np.uint32).reshape(len(s), -1) for s in (a, b))
        return pa.array((x == y).mean(axis=1) if len(x) else np.zeros(0))
    return agree


def _set(text: str, width: int) -> set:
    w = words(text)
    return set(zip(*(w[j:] for j in range(width)))) if len(w) >= width else {tuple(w)}


def similar(width: int, percent: int):
    """Column function: whether two texts' full sets reach ``percent``."""
    @F.arrow_udf(T.BooleanType())
    def test(a: pa.Array, b: pa.Array) -> pa.Array:
        out, last, one = [], None, set()
        for x, y in zip(a.to_pylist(), b.to_pylist()):
            if x != last:
                last, one = x, _set(x, width)
            other = _set(y, width)
            common = len(one & other)
            out.append(100 * common >= percent * (len(one) + len(other) - common))
        return pa.array(out, pa.bool_())
    return test


def shingle_lists(width: int):
    """Column function: text to its shingle hashes."""
    @F.arrow_udf(T.ArrayType(T.LongType()))
    def lists(texts: pa.Array) -> pa.Array:
        value, count = shingle_sets(texts.to_pylist(), width)
        return pa.ListArray.from_arrays(
            pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pa.array(value.view(np.int64)))
    return lists


def _row_key(doc_id: str, text: str) -> Column:
    return F.xxhash64(F.col(doc_id), F.col(text))


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80,
) -> DataFrame:
    """Per row ``doc_id, row_key, n_shingles, component_id, kept, chosen``.

    ``component_id`` is the smallest ``doc_id`` of the group (nulls first); ``kept`` marks
    rows whose own id that is. ``row_key`` is a hash of id and text, for joining the result
    back; ``chosen`` marks the one row key of each group."""
    bounded_batches(docs.sparkSession)
    sign = signer(width, percent)
    rows = docs.select(F.col(doc_id).alias("doc_id"), _row_key(doc_id, text).alias("row_key"), sign(F.col(text)).alias("_s"))
    signed = written(rows.select("doc_id", "row_key", "_s.*"), "signed")
    classes = written(
        signed.filter("n_shingles > 0").groupBy("class").agg(
            F.min(F.struct("doc_id", "row_key")).alias("first"), F.any_value("n_shingles").alias("n"),
            F.any_value("bands").alias("bands"), F.any_value("signature").alias("signature"))
        .withColumn("row_key", F.col("first.row_key")), "classes")

    groups = _groups(docs, doc_id, text, classes, width, percent)
    of_class = classes.join(groups, F.col("class") == F.col("key"), "left").select(
        "class", "first", F.coalesce("label", "class").alias("group"))
    lowest = of_class.groupBy("group").agg(F.min("first").alias("_first"))
    named = of_class.join(lowest, "group").select("class", "_first")
    component = F.coalesce(F.col("_first.doc_id"), F.col("doc_id"))
    return signed.join(named, "class", "left").select(
        "doc_id", "row_key", "n_shingles", component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
        F.coalesce(F.col("row_key") == F.col("_first.row_key"), F.lit(True)).alias("chosen"))


def keep_one(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80,
) -> DataFrame:
    """One row of each group, and all rows without words, with the columns of ``docs``."""
    found = near_duplicates(docs, doc_id, text, width, percent)
    chosen = found.filter("chosen").select(
        F.col("row_key").alias("__mh_key"), (F.col("n_shingles") == 0).alias("__mh_empty")).distinct()
    stay = docs.withColumn("__mh_key", _row_key(doc_id, text)).join(chosen, "__mh_key")
    # A repeated row has the same key; its copies go as well.
    one = stay.filter("NOT __mh_empty").dropDuplicates(["__mh_key"])
    return one.unionByName(stay.filter("__mh_empty")).select(*docs.columns)


def _merged(label: DataFrame | None, links: DataFrame, name: str) -> DataFrame:
    """``key, label`` of all linked classes: the labels so far, joined by new links."""
    if label is None:
        return components(links).select(F.col("node").alias("key"), F.col("component").alias("label"))
    now = lambda c: label.select(F.col("key").alias(c), F.col("label").alias(f"_{c}"))
    of = lambda c: F.coalesce(f"_{c}", c)
    drawn = written(links.join(now("a"), "a", "left").join(now("b"), "b", "left").select(of("a").alias("a"), of("b").alias("b")), f"{name}-drawn")
    joined = components(drawn).select(F.col("node").alias("_old"), F.col("component").alias("_new"))
    # Classes that had no label yet are nodes of the new graph themselves.
    fresh = joined.select(F.col("_old").alias("key"), F.col("_old").alias("label")).join(label, "key", "left_anti")
    every = label.union(fresh).join(joined, F.col("label") == F.col("_old"), "left")
    return written(every.select("key", F.coalesce("_new", "label").alias("label")), name)


def _groups(docs: DataFrame, doc_id: str, text: str, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """``key, label``: classes that links connect share a label; others may be absent."""
    bands = classes.select(F.explode("bands").alias("bucket"), F.col("class").alias("key"))
    shared = bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    members = written(bands.join(shared, "bucket"), "members")
    met = members.select(F.col("key").alias("class")).distinct()
    info = written(classes.join(met, "class", "left_semi").select(F.col("class").alias("key"), "row_key", "n", "signature"), "info")
    texts = written(
        docs.select(_row_key(doc_id, text).alias("row_key"), F.col(text).alias("text"))
        .join(info.select("key", "row_key"), "row_key").groupBy("key").agg(F.any_value("text").alias("text")), "texts")

    agree, test = agreement(), similar(width, percent)
    least = percent / 100 - SLACK

    facts = info.select("key", "n", "signature")

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        """Pairs whose signatures are near and whose full sets are linked."""
        of = lambda c: facts.select(*(F.col(x).alias(f"{x}_{c}") for x in facts.columns))
        near = (
            pairs.distinct()
            .join(of("a"), F.col("a") == F.col("key_a")).join(of("b"), F.col("b") == F.col("key_b"))
            .filter(_possible(F.least("n_a", "n_b"), F.col("n_a"), F.col("n_b"), percent))
            .filter(agree("signature_a", "signature_b") >= least)
            .select("a", "b")
        )
        with_texts = (
            near.join(texts.select(F.col("key").alias("a"), F.col("text").alias("_ta")), "a")
            .join(texts.select(F.col("key").alias("b"), F.col("text").alias("_tb")), "b"))
        return written(with_texts.filter(test("_ta", "_tb")).select("a", "b"), name)

    pivot = members.groupBy("bucket").agg(F.min("key").alias("a"))
    stars = members.join(pivot, "bucket").filter("key <> a").select("a", F.col("key").alias("b"))
    label = _merged(None, confirmed(stars, "links"), "labels")

    left = written(_open(members, label), "open")
    if is_small(left, 0):
        return label
    starts = written(_starts(left, facts, texts, width, percent), "starts")
    label = _merged(label, confirmed(_to_centres(_at_shared(starts, label)), "centre-links"), "centre-labels")
    return _merged(label, confirmed(_through_rare(_at_shared(starts, label), percent), "more-links"), "more-labels")


def _possible(common: Column, n: Column, m: Column, percent: int) -> Column:
    """Whether sets of sizes ``n`` and ``m`` can be linked if they share ``common`` at most."""
    return (100 + percent) * common >= percent * (n + m)


def _open(members: DataFrame, label: DataFrame) -> DataFrame:
    """``key`` of the classes of buckets that hold several labels."""
    now = members.join(label, "key", "left").withColumn("label", F.coalesce("label", "key"))
    several = now.groupBy("bucket").agg(F.min("label").alias("_lo"), F.max("label").alias("_hi")).filter("_lo <> _hi").select("bucket")
    return now.join(several, "bucket", "left_semi").select("key").distinct()


def _starts(left: DataFrame, facts: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """``shingle, key, n, at, short``: the shingles of each class that may be the
    first one it shares with a linked class. Shingles are ordered by the number of classes
    that have them, then by value; ``at`` counts the class's own shingles before this one.

    With ``at`` shingles gone, ``n - at`` can be shared. A partner that is no larger has at
    least ``percent`` of the size; one that is no smaller has at least the same size, which
    leaves fewer places: ``short`` marks those."""
    listed = written(
        texts.join(left, "key").select("key", F.explode(shingle_lists(width)("text")).alias("shingle")), "listed")
    counted = listed.groupBy("shingle").agg(F.count(F.lit(1)).alias("_classes"))
    shared = listed.join(counted.filter("_classes > 1"), "shingle")
    sizes = facts.join(left, "key").select("key", "n")
    # Shingles of one class come first in the order and meet nobody.
    own = shared.groupBy("key").agg(F.count(F.lit(1)).alias("_shared"))
    sized = sizes.join(own, "key").withColumn("_own", F.col("n") - F.col("_shared")).filter(100 * F.col("_shared") >= percent * F.col("n"))
    place = F.row_number().over(Window.partitionBy("key").orderBy("_classes", "shingle"))
    at = shared.join(sized, "key").withColumn("at", F.col("_own") + place - 1)
    rest = F.col("n") - F.col("at")
    return at.filter(100 * rest >= percent * F.col("n")).select(
        "shingle", "key", "n", "at", _possible(rest, F.col("n"), F.col("n"), percent).alias("short"))


def _at_shared(starts: DataFrame, label: DataFrame) -> DataFrame:
    """Rows of ``starts`` at shingles of several labels, with the label of now, the number
    of ``parts`` of the shingle, and whether the label is not the usual one there."""
    now = starts.join(label, "key", "left").withColumn("label", F.coalesce("label", "key"))
    per_label = now.groupBy("shingle", "label").agg(F.count(F.lit(1)).alias("_n"))
    usual = per_label.groupBy("shingle").agg(
        F.max(F.struct("_n", "label")).alias("_most"), F.sum("_n").alias("_all")).filter(F.col("_most._n") < F.col("_all"))
    parts = F.ceil(F.col("_all") / PART).cast("int")
    return written(
        now.join(usual.select("shingle", F.col("_most.label").alias("_usual"), parts.alias("parts")), "shingle")
        .withColumn("rare", F.col("label") != F.col("_usual")).drop("_usual"), "starts-shared")


def _to_centres(rows: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of the class with the fewest rarer shingles, of those with the usual
    label at a shingle, and the classes with other labels there: the text that others were
    edited from, if it is there, links most of them."""
    centre = rows.filter("NOT rare").groupBy("shingle").agg(F.min(F.struct("at", "key")).alias("_centre"))
    return rows.filter("rare").join(centre, "shingle").select(F.col("_centre.key").alias("a"), F.col("key").alias("b"))


def _through_rare(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` of classes with different labels that share a shingle of ``rows``
    and may be linked."""
    # Two labels that differ are not both the usual one: one side is always rare.
    named = lambda df, c: df.select("shingle", "part", *(F.col(x).alias(f"{x}_{c}") for x in ("key", "label", "n", "at")))
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    copied = rows.filter("rare").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rest = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
    # ``b`` is the smaller set; of equal ones, that of the smaller key.
    ordered = (F.col("n_b") < F.col("n_a")) | ((F.col("n_b") == F.col("n_a")) & (F.col("key_b") < F.col("key_a")))
    fits = ordered & (F.col("label_a") != F.col("label_b")) & _possible(rest, F.col("n_a"), F.col("n_b"), percent)
    meet = lambda a, b: named(a, "a").join(named(b, "b"), ["shingle", "part"]).filter(fits).select(F.col("key_a").alias("a"), F.col("key_b").alias("b"))
    return meet(copied, dealt.filter("short")).union(meet(dealt.filter("NOT rare"), copied.filter("short")))
