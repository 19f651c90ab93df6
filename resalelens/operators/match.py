"""Match queries to sold titles that hold all of their terms.

Titles are read once. A filter of the words that any query asks for (a bit array sized by
their number) is tested inside the title's row, so a title keeps only such words: a match
depends on no others, titles that differ in other words alone become one, and those without
any go. Everything after that works on these short sets.

Each query is looked up by its rarest term only: a title that holds every term
holds that one. The lookup is therefore an equi-join that yields, per query, no
more rows than its rarest term has titles, and the other terms are then checked
on the title's own terms. Equal term sets are matched once, on both sides.
A lookup term is split over as many salts as its frequency asks for.

The kept titles, distinct term sets and rarest terms are read several times, so they are
written once to the shared folder.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from resalelens.operators.storage import written

ROWS_PER_SALT = 200_000
#: Bits per asked word, and the powers of two between which the filter is sized: 1 MB at
#: most. A fuller filter lets more words through and changes no result.
BITS_PER_WORD = 16
SMALLEST, LARGEST = 10, 23


def set_key(terms: Column) -> Column:
    """128-bit digest under which equal sorted term arrays meet; never NULL."""
    digest = F.unhex(F.md5(F.array_join(terms, "\n").cast("binary")))
    return F.coalesce(digest, F.lit(bytearray()))


def distinct_sets(df: DataFrame, key: str) -> DataFrame:
    """One row per term set, stored. Copies meet before the shuffle."""
    rows = df.select(set_key(F.col("terms")).alias(key), "terms")
    return written(rows.groupBy(key).agg(F.any_value("terms").alias("terms")), f"{key}-sets")


def title_sets(kept: DataFrame) -> DataFrame:
    """One row per set of kept titles, stored."""
    return written(kept.groupBy("title_key").agg(F.any_value("terms").alias("terms")), "title-sets")


def _places(word: Column, bits: int) -> tuple[Column, Column]:
    """The two bits of a word."""
    h = F.xxhash64(word)
    return F.pmod(h, F.lit(bits)), F.pmod(F.shiftrightunsigned(h, 29), F.lit(bits))


def _by(function: str, value: Column, n: Column) -> Column:
    return F.call_function(function, value, n.cast("int"))


def word_filter(asked: DataFrame) -> Callable[[Column], Column]:
    """Test of a word that is true for all words of the stored table ``asked`` (``term``) and
    for few others."""
    size = 1 << min(LARGEST, max(SMALLEST, math.ceil(math.log2(max(1, asked.count()) * BITS_PER_WORD))))
    place = asked.select(F.explode(F.array(*_places(F.col("term"), size))).alias("p"))
    bit = _by("shiftleft", F.lit(1).cast("long"), F.col("p").bitwiseAND(F.lit(63)))
    longs = place.groupBy(F.shiftright("p", 6).cast("int").alias("id")).agg(F.bit_or(bit).alias("bits"))
    filled = [0] * (size // 64)
    for row in longs.collect():   # no more than the filter's own size
        filled[row.id] = row.bits
    # A literal, since functions over arrays take no subquery.
    table = F.from_json(F.lit(json.dumps(filled)), "array<bigint>")

    def test(word: Column) -> Column:
        hits = [
            _by("shiftrightunsigned", F.element_at(table, (F.shiftright(p, 6) + 1).cast("int")), p.bitwiseAND(F.lit(63))) % 2 != 0
            for p in _places(word, size)]
        return hits[0] & hits[1]
    return test


def asked_words(queries: DataFrame) -> DataFrame:
    """Words of all queries, stored."""
    return written(queries.select(F.explode("terms").alias("term")).distinct(), "asked-terms")


def kept_titles(titles: DataFrame, asked: DataFrame) -> DataFrame:
    """``titles`` whose ``terms`` are cut to asked words, with ``title_key``; stored. Titles
    without such a word match nothing and are left out."""
    wanted = word_filter(asked)
    cut = titles.withColumn("terms", F.filter("terms", wanted)).filter(F.size("terms") > 0)
    return written(cut.withColumn("title_key", set_key(F.col("terms"))), "kept-titles")


def match_sets(queries: DataFrame, titles: DataFrame) -> DataFrame:
    """Pairs ``query_key, title_key`` where the title holds every query term.

    ``queries`` has ``query_key, terms`` and ``titles`` has ``title_key, terms``,
    one row per distinct set.
    """
    wanted = queries.select("query_key", F.explode("terms").alias("term"))
    postings = titles.select("title_key", F.explode("terms").alias("term"))
    freq = postings.groupBy("term").agg(F.count(F.lit(1)).alias("freq"))

    # A query with a term no title holds matches nothing.
    rarest = written((
        wanted.join(freq, "term", "left")
        .groupBy("query_key")
        .agg(
            F.min_by("term", F.struct("freq", "term")).alias("term"),
            F.min("freq").alias("freq"),
            F.bool_and(F.col("freq").isNotNull()).alias("complete"),
        )
        .filter("complete").drop("complete")
    ), "rarest")

    salts = (F.floor(F.col("freq") / ROWS_PER_SALT) + 1).cast("int")
    lookups = rarest.select("query_key", "term", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    split = written(rarest.groupBy("term").agg(F.max(salts).alias("salts")), "lookup-terms")
    salted = postings.join(split, "term").select(
        "title_key", "term", F.pmod(F.xxhash64("title_key"), F.col("salts")).cast("int").alias("salt"))
    candidates = lookups.join(salted, ["term", "salt"]).select("query_key", "title_key")

    return (
        candidates
        .join(queries.select("query_key", F.col("terms").alias("_q")), "query_key")
        .join(titles.select("title_key", F.col("terms").alias("_t")), "title_key")
        .filter(F.size(F.array_except("_q", "_t")) == 0)
        .select("query_key", "title_key")
    )


def term_match(queries: DataFrame, titles: DataFrame) -> DataFrame:
    """Pairs ``query_id, title_id`` where the title holds all query terms.

    ``queries`` has ``query_id, terms``; ``titles`` has ``title_id, terms``.
    """
    kept = kept_titles(titles.select("title_id", "terms"), asked_words(queries))
    pairs = match_sets(distinct_sets(queries, "query_key"), title_sets(kept))
    q = queries.select("query_id", set_key(F.col("terms")).alias("query_key"))
    return pairs.join(q, "query_key").join(kept.select("title_id", "title_key"), "title_key").select("query_id", "title_id")


def matched_prices(queries: DataFrame, sold: DataFrame) -> DataFrame:
    """Prices of each query's matching sold titles: ``query, source, price, copies``.

    ``queries`` has ``query, terms``; ``sold`` has ``terms, source, price``. Equal
    sales are counted before they are matched and again per query.
    """
    kept = kept_titles(sold.select("terms", "source", "price"), asked_words(queries))
    pairs = match_sets(distinct_sets(queries, "query_key"), title_sets(kept))
    q = queries.select("query", set_key(F.col("terms")).alias("query_key")).distinct()
    counted = kept.groupBy("title_key", "source", "price").agg(F.count(F.lit(1)).alias("copies"))
    return (
        pairs.join(counted, "title_key").join(q, "query_key")
        .groupBy("query", "source", "price").agg(F.sum("copies").alias("copies"))
    )
