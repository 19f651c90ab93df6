"""Drop the boilerplate lines of each site.

A line is boilerplate on a host if more than ``ratio`` of the host's pages contain it and
at least ``min_pages`` do. Lines are compared without the spaces, tabs and carriage
returns around them; blank lines are never boilerplate. A line counts once per page.

Lines are counted by (host, 64-bit hash) with partial aggregation, so the lines
themselves are never shuffled and a common line or a large host is one partial count per
task. The hashes that a host drops are kept as one array: at most ``lines per page /
ratio`` of them, as their counts add up to no more than all lines of the host. A line is
dropped wrongly only if its hash equals that of one of these few.

A null text stays null and has no lines; a page that loses all lines keeps an empty
text. Pages without a host form one host. Repeated rows are pages of their own.

``copies_apart`` is for tables from which copies have yet to go. Equal texts of a host are
then one page, so a copied text is not boilerplate because of its copies. Near copies are
different texts, and the lines that they share may still be above the ratio; a page that
would lose all its lines is therefore left whole, and of the pages that would lose the
same lines and nearly all of their text one text is. The copies left whole are for
near-dedup to settle; no text is lost with all its copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from resalelens.operators.storage import written

BLANKS = " \t\r"
RATIO = 0.05
MIN_PAGES = 5
#: With ``copies_apart``: a page that keeps at most this share of its characters may be a
#: near copy.
REMNANT = 0.2


def _key(line: Column) -> Column:
    return F.xxhash64(F.trim(line, F.lit(BLANKS)))


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def boilerplate(
    pages: DataFrame, host: str, text: str, ratio: float, min_pages: int, copies_apart: bool = False,
) -> DataFrame:
    """Per host the hashes of its boilerplate lines: ``_host, _drop``."""
    solid = F.filter(_lines(F.col(text)), lambda x: F.trim(x, F.lit(BLANKS)) != "")
    keys = F.array_distinct(F.transform(solid, _key))
    pages = pages.select(F.col(host), keys.alias("__site_keys"), F.xxhash64(text).alias("__site_page"))
    if copies_apart:
        pages = pages.groupBy(host, "__site_page").agg(F.any_value("__site_keys").alias("__site_keys"))
    counts = (
        pages.select(F.col(host).alias("__site_host"), F.explode("__site_keys").alias("__site_line"))
        .groupBy("__site_host", "__site_line").agg(F.count(F.lit(1)).alias("__site_n"))
        .filter(F.col("__site_n") >= min_pages)
    )
    totals = pages.groupBy(F.col(host).alias("__site_of")).agg(F.count(F.lit(1)).alias("__site_pages"))
    return (
        counts.join(totals, F.col("__site_host").eqNullSafe(F.col("__site_of")))
        .filter(F.col("__site_n") > F.col("__site_pages") * F.lit(ratio))
        .groupBy("__site_host").agg(F.collect_list("__site_line").alias("__site_drop"))
    )


def drop_lines(
    pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES,
    copies_apart: bool = False,
) -> DataFrame:
    """All rows and columns with ``text`` less its boilerplate lines, and the number of
    lines before and dropped, ``n_lines`` and ``n_dropped``."""
    # Stored, so that the planner knows how large the table is.
    bad = written(boilerplate(pages, host, text, ratio, min_pages, copies_apart), "boilerplate")
    listed = F.coalesce(F.col("__site_drop"), F.array().cast("array<long>"))
    kept = F.filter(_lines(F.col(text)), lambda x: ~F.array_contains(listed, _key(x)))
    before = F.coalesce(F.size(_lines(F.col(text))), F.lit(0))
    joined = pages.join(bad, F.col(host).eqNullSafe(F.col("__site_host")), "left").withColumn("__site_kept", kept)
    if copies_apart:
        joined = _left_whole(joined, host, text, listed)
    return (
        joined
        .withColumn("n_lines", F.when(F.col(text).isNull(), 0).otherwise(before).cast("long"))
        .withColumn("n_dropped", (F.col("n_lines") - F.when(F.col(text).isNull(), 0).otherwise(F.size("__site_kept"))).cast("long"))
        .withColumn(text, F.array_join("__site_kept", "\n"))
        .drop("__site_kept", "__site_drop", "__site_host")
    )


def _left_whole(joined: DataFrame, host: str, text: str, listed: Column) -> DataFrame:
    """Pages with all lines kept where nothing would be left, and where one of the near
    copies is to stay."""
    lost = F.xxhash64(F.filter(F.transform(_lines(F.col(text)), _key), lambda x: F.array_contains(listed, x)))
    left = F.array_join("__site_kept", "\n")
    dropped = F.size("__site_kept") < F.size(_lines(F.col(text)))
    remnant = dropped & (F.length(left) <= F.length(text) * F.lit(REMNANT))
    marked = joined.withColumn("__site_lost", F.when(remnant, F.xxhash64(F.col(host), lost)))
    first = written(
        marked.filter("__site_lost IS NOT NULL").groupBy(F.col("__site_lost").alias("__site_set"))
        .agg(F.min(F.xxhash64(text)).alias("__site_one")), "whole-pages")
    nothing = dropped & (F.trim(F.regexp_replace(left, "\n", " "), F.lit(BLANKS)) == "")
    whole = F.coalesce(nothing | (F.xxhash64(text) == F.col("__site_one")), F.lit(False))
    return (
        marked.join(first, F.col("__site_lost") == F.col("__site_set"), "left")
        .withColumn("__site_kept", F.when(whole, _lines(F.col(text))).otherwise(F.col("__site_kept")))
        .drop("__site_lost", "__site_set", "__site_one")
    )
