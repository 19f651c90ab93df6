"""Link tables of captured pages.

Anchors are found with built-in functions; one Arrow function then resolves the character
references of their links and texts, of which there are over two thousand names.
"""

from __future__ import annotations

import html as html_text
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from resalelens.functions.text import strip

_HIDDEN = r"(?is)<!--.*?-->|<(script|style|template)\b.*?</\1\s*>"
# Inside a tag a quoted value may hold any character; a quote without an end is one itself.
_INSIDE = r"""(?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+>"""
_ANCHOR = rf"(?is)<a\s{_INSIDE}.*?(?=</a\s*>|<a\s|$)"
_BEFORE = r"""(?:\s++|[^\s>"']++|"[^"]*+"|'[^']*+')*?(?<=\s)"""
_HREF = rf"""(?is)^<a(?=\s){_BEFORE}href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))"""
_TAG = rf"<{_INSIDE}"

_LINK = T.ArrayType(T.StructType([T.StructField("href", T.StringType()), T.StructField("text", T.StringType())]))
_REFERENCE = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z0-9]{1,32});?(?=(.?))", re.S)


def unescape(text: str, attribute: bool = False) -> str:
    """Resolve references. The semicolon may be missing; in an attribute only where no
    letter, digit or equals sign follows."""
    if "&" not in text:
        return text
    if not attribute:
        return html_text.unescape(text)

    def resolve(m: re.Match) -> str:
        open_end = not m[0].endswith(";") and (m[1] == "=" or m[1].isalnum())
        return m[0] if open_end else html_text.unescape(m[0])
    return _REFERENCE.sub(resolve, text)


@F.arrow_udf(_LINK)
def _resolved(found: pa.Array) -> pa.Array:
    rows = [links and [
        {"href": unescape(x["href"], attribute=True), "text": unescape(x["text"])} for x in links] for links in found.to_pylist()]
    return pa.array(rows, pa.list_(pa.struct([("href", pa.string()), ("text", pa.string())])))


def anchors(html: Column) -> Column:
    """``array<struct<href, text>>`` of the anchors with a link, in page order."""
    shown = F.regexp_replace(html, _HIDDEN, "")
    found = F.filter(F.regexp_extract_all(shown, F.lit(_ANCHOR), F.lit(0)), lambda a: a.rlike(_HREF))
    raw = F.transform(found, lambda a: F.struct(
        F.concat(*[F.regexp_extract(a, _HREF, g) for g in (1, 2, 3)]).alias("href"),
        F.regexp_replace(a, _TAG, "").alias("text")))
    return F.transform(_resolved(raw), lambda x: F.struct(x["href"].alias("href"), strip(x["text"]).alias("text")))


def scan_links(pages: DataFrame) -> DataFrame:
    """One row per link: ``page_id, pos, href, text``."""
    return (
        pages.select("page_id", F.posexplode(anchors(F.col("html"))).alias("pos", "a"))
        .select("page_id", "pos", "a.href", "a.text")
    )


def named_links(links: DataFrame, shortest: int = 3) -> DataFrame:
    """Links whose text is long enough to name something."""
    return links.filter(F.length("text") >= shortest)


def distinct_links(pages: DataFrame) -> DataFrame:
    """Distinct links of each page in the order of their first occurrence."""
    hrefs = F.array_distinct(F.transform(anchors(F.col("html")), lambda a: a["href"]))
    return pages.select("page_id", F.posexplode(hrefs).alias("pos", "href"))


def first_links(pages: DataFrame, n: int, pattern: str | None = None) -> DataFrame:
    """First ``n`` distinct links of each page, of those that match a pattern."""
    hrefs = F.array_distinct(F.transform(anchors(F.col("html")), lambda a: a["href"]))
    if pattern is not None:
        hrefs = F.filter(hrefs, lambda h: h.rlike(pattern))
    return pages.select("page_id", F.posexplode(F.slice(hrefs, 1, n)).alias("pos", "href"))


def link_counts(pages: DataFrame, pattern: str) -> DataFrame:
    """Number of distinct links of each page, and of those that match a pattern."""
    hrefs = F.array_distinct(F.transform(anchors(F.col("html")), lambda a: a["href"]))
    paged = pages.select("page_id", hrefs.alias("hrefs"))
    return paged.select(
        "page_id",
        F.size("hrefs").alias("total"),
        F.size(F.filter("hrefs", lambda h: h.rlike(pattern))).alias("matching"),
    )
