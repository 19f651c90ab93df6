"""Captured HTML pages as node arrays.

``page_values`` parses each page once and hands its nodes to a reader, which picks the few
texts that a job asks for; nothing else leaves the Python worker, and one page's nodes are
in memory at a time. ``page_nodes`` gives all nodes as an array for ad-hoc queries, which
are then array work on the page's own row. Neither shuffles. Nodes are in document order;
an element's text is the run of text nodes up to its ``stop`` position.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from resalelens.functions.text import BLANKS, strip

# Kinds of node. HIDDEN are comments; RAW is the text of the RAW_TAGS, which counts as
# text of those elements only.
ELEMENT, TEXT, HIDDEN, RAW = 0, 1, 2, 3
RAW_TAGS = ("script", "style", "template")

NODE = T.StructType([
    T.StructField("kind", T.IntegerType()),
    T.StructField("parent", T.IntegerType()),      # 1-based position; 0 for the document
    T.StructField("stop", T.IntegerType()),        # last position inside the element
    T.StructField("next_elem", T.IntegerType()),   # next sibling element; 0 if none
    T.StructField("item", T.IntegerType()),        # nearest list item around it; 0 if none
    T.StructField("tag", T.StringType()),
    T.StructField("text", T.StringType()),         # of text nodes
    T.StructField("gap", T.StringType()),          # rendered break before this node
    T.StructField("id", T.StringType()),
    T.StructField("cls", T.StringType()),
    T.StructField("href", T.StringType()),
    T.StructField("src", T.StringType()),
    T.StructField("dir", T.StringType()),
])
KIND, PARENT, STOP, NEXT, ITEM, TAG, TEXT_OF, GAP, ID, CLS, HREF, SRC, DIR = range(13)   # places in a node
_ARROW = pa.struct([(f.name, pa.int32() if isinstance(f.dataType, T.IntegerType) else pa.string()) for f in NODE.fields])
_PAGES_PER_BATCH = 256
_BYTES_PER_BATCH = 8 << 20
_DOCUMENT = "#document"   # tag of the node around all others, always at position 1

# Fixed values of HTML: elements without content, elements that start a new line,
# and elements whose start ends an open one of the listed kinds.
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_LINE = frozenset(
    "address article aside blockquote body dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr li main nav ol p pre section table tbody thead tr ul".split()
)
_ENDS = {
    "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"},
}
_SCOPE = {"li": {"ul", "ol"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"},
          "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}}
_ENDS_P = _LINE - {"body", "tbody", "thead", "tr"}
# Elements that frame one listing on an index page.
_ITEM_TAGS = frozenset({"li", "tr"})
_ITEM_CLASSES = frozenset({"auction-item", "ps-card", "card"})
_ATTRS = frozenset({"id", "class", "href", "src", "dir"})
# Tags that read the same whatever follows them, with quoted values without
# references. All others are left to the library's parser.
_PLAIN_START = re.compile(r"""<([a-zA-Z][a-zA-Z0-9]*)((?:[ \t\n\r\f]+[a-zA-Z][a-zA-Z0-9-]*=(?:'[^'<>&]*'|"[^"<>&]*"))*)[ \t\n\r\f]*>""")
_PLAIN_END = re.compile(r"</([a-zA-Z][a-zA-Z0-9]*)>")
_PLAIN_ATTR = re.compile(r"""([a-zA-Z][a-zA-Z0-9-]*)=(?:'([^']*)'|"([^"]*)")""")
_PLAIN_COMMENT = re.compile(r"!--([^->]+)--")
_SHORT_TAG = 256
_PLAIN_TYPE = re.compile(r"!(?i:doctype)[^<>]*")
_START, _END, _COMMENT, _TYPE = range(4)


def _kept_of(attrs) -> dict[str, str]:
    kept: dict[str, str] = {}
    for name, value in attrs:
        if name in _ATTRS:
            kept.setdefault(name, value or "")
    return kept


@lru_cache(4096)
def _plain_tag(head: str) -> tuple | None:
    """What stands between ``<`` and the next ``>``: an end tag, a comment, a document type or a start tag with
    the last places of its node, whether it frames a listing, is void, and what break it makes
    if there is none. NULL if it is none of these in plain writing. The same few are most of all."""
    if found := _PLAIN_END.fullmatch(f"<{head}>"):
        return _END, found[1].lower()
    if found := _PLAIN_COMMENT.fullmatch(head):
        return _COMMENT, found[1]
    if _PLAIN_TYPE.fullmatch(head):
        return _TYPE,
    found = _PLAIN_START.fullmatch(f"<{head}>")
    if found is None or (tag := found[1].lower()) in HTMLParser.CDATA_CONTENT_ELEMENTS or tag in RAW_TAGS:
        return None
    kept = _kept_of((m[1].lower(), m[2] or m[3]) for m in _PLAIN_ATTR.finditer(found[2]))
    last = (tag, None, "", *map(kept.get, ("id", "class", "href", "src", "dir")))
    return _START, tag, last, _frames(tag, kept.get("class")), tag in _VOID, _break_at(tag)


def _frames(tag: str, cls: str | None) -> bool:
    """Whether an element frames one listing."""
    return tag in _ITEM_TAGS or bool(cls and not _ITEM_CLASSES.isdisjoint(cls.split()))


def _break_at(tag: str) -> str:
    """Break that a start tag makes; a tab counts only where there is no other."""
    return "\n" if tag in _LINE or tag in ("br", "hr") else "\t" if tag in ("td", "th") else ""


@lru_cache(4096)
def _plain_attrs(written: str) -> dict[str, str]:
    """Attributes of a plain tag; the same few tags are most of all."""
    return _kept_of((m[1].lower(), m[2] or m[3]) for m in _PLAIN_ATTR.finditer(written))


class _Nodes(HTMLParser):
    """Collects the nodes of one page as rows in the order of ``NODE``.

    An end tag closes up to its nearest open element and is ignored without one.
    With ``rendered`` start tags also end open elements the way a browser ends them.
    """

    def __init__(self, rendered: bool):
        super().__init__(convert_charrefs=True)
        self.rendered = rendered
        self.rows: list[list] = [[ELEMENT, 0, 1, 0, 0, _DOCUMENT, None, "", *[None] * 5]]
        self.open = [(_DOCUMENT, 1, 0, False)]             # tag, position, nearest item, raw
        self.last_child: dict[int, int] = {}
        self.gap = ""
        self.joined = False                                # last event was text

    def _close_to(self, depth: int) -> None:
        here = len(self.rows)
        for tag, at, _, _ in self.open[depth:]:
            self.rows[at - 1][STOP] = here
            if tag in _LINE:
                self.gap = "\n"
        del self.open[depth:]

    def _imply_ends(self, tag: str) -> None:
        ends, scope, ends_p = _ENDS.get(tag, ()), _SCOPE.get(tag, ()), tag in _ENDS_P
        if not ends and not ends_p:
            return
        for depth in range(len(self.open) - 1, -1, -1):
            name = self.open[depth][0]
            if name in ends or (ends_p and name == "p"):
                self._close_to(depth)
            if name in scope:
                break

    def updatepos(self, i, j):
        """Lines and columns are of no use here."""
        return j

    def parse_starttag(self, i):
        plain = _PLAIN_START.match(self.rawdata, i)
        if plain is None:
            return super().parse_starttag(i)
        tag, attrs = plain[1].lower(), plain[2]
        if tag in self.CDATA_CONTENT_ELEMENTS:
            return super().parse_starttag(i)
        read = _plain_attrs if len(attrs) <= _SHORT_TAG else _plain_attrs.__wrapped__
        self._start(tag, read(attrs) if attrs else {})
        return plain.end()

    def parse_endtag(self, i):
        plain = _PLAIN_END.match(self.rawdata, i)
        if plain is None or self.cdata_elem is not None:
            return super().parse_endtag(i)
        self.handle_endtag(plain[1].lower())
        return plain.end()

    def handle_starttag(self, tag, attrs):
        self._start(tag, _kept_of(attrs))

    def _start(self, tag: str, kept: dict[str, str]) -> None:
        self.joined = False
        if self.rendered:
            self._imply_ends(tag)
        gap = _break_at(tag)
        if gap == "\n" or not self.gap:
            self.gap = gap
        _, parent, item, raw = self.open[-1]
        at = len(self.rows) + 1
        cls = kept.get("class")
        if _frames(tag, cls):
            item = at
        self.rows.append([
            ELEMENT, parent, at, 0, item, tag, None, "",
            kept.get("id"), cls, kept.get("href"), kept.get("src"), kept.get("dir")])
        before = self.last_child.get(parent)
        if before:
            self.rows[before - 1][NEXT] = at
        self.last_child[parent] = at
        if tag not in _VOID:
            self.open.append((tag, at, item, raw or tag in RAW_TAGS))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.joined = False
        for depth in range(len(self.open) - 1, -1, -1):
            if self.open[depth][0] == tag:
                self._close_to(depth)
                return

    def _add_text(self, kind: int, text: str, gap: str) -> None:
        _, parent, item, _ = self.open[-1]
        self.rows.append([
            kind, parent, len(self.rows) + 1, 0, item, None, text, gap, None, None, None, None, None])

    def handle_data(self, data):
        if self.joined:
            self.rows[-1][TEXT_OF] += data
            return
        if self.open[-1][3]:
            self._add_text(RAW, data, "")
        elif data.isspace():
            self._add_text(TEXT, data, "")   # a blank run leaves the break to the next text
        else:
            self._add_text(TEXT, data, self.gap)
            self.gap = ""
        self.joined = True

    def handle_comment(self, data):
        self.joined = False
        self._add_text(HIDDEN, data, "")

    def unknown_decl(self, data):
        if data.upper().startswith("CDATA["):
            self.handle_data(data[6:])
            self.joined = False
        else:
            self.handle_comment(data)

    def parse_marked_section(self, i, report=1):
        """A marked section of an unknown kind is a comment up to its next ``>``, and the
        page goes on after it; one without an end is text."""
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:
            end = self.rawdata.find(">", i)
            if end < 0:
                self.handle_data(self.rawdata[i:])
                return len(self.rawdata)
            self.handle_comment(self.rawdata[i + 2:end])
            return end + 1

    def _read_plain(self, html: str) -> int:
        """Read from the start as far as tags and comments are written plainly. What follows
        is left to the library, which reads on from there as if it had read the rest."""
        rows, opened, last_child = self.rows, self.open, self.last_child
        text, *parts = html.split("<")
        done = len(text)
        if text:
            self.handle_data(unescape(text))
        for part in parts:
            head, closed, text = part.partition(">")
            tag = (_plain_tag if len(head) <= _SHORT_TAG else _plain_tag.__wrapped__)(head) if closed else None
            if tag is None or tag[0] == _TYPE and self.joined:
                break
            done += len(part) + 1
            self.joined = False
            if tag[0] == _START:
                _, name, last, frames, void, gap = tag
                if self.rendered:
                    self._imply_ends(name)
                if gap and (gap == "\n" or not self.gap):
                    self.gap = gap
                _, parent, item, raw = opened[-1]
                at = len(rows) + 1
                if frames:
                    item = at
                rows.append([ELEMENT, parent, at, 0, item, *last])
                before = last_child.get(parent)
                if before:
                    rows[before - 1][NEXT] = at
                last_child[parent] = at
                if not void:
                    opened.append((name, at, item, raw))
            elif tag[0] == _END:
                if opened[-1][0] == tag[1]:
                    rows[opened.pop()[1] - 1][STOP] = len(rows)
                    if tag[1] in _LINE:
                        self.gap = "\n"
                else:
                    self.handle_endtag(tag[1])
            elif tag[0] == _COMMENT:
                self.handle_comment(tag[1])
            if text:
                self.joined = True
                if "&" in text:
                    text = unescape(text)
                gap = ""
                if not text.isspace():     # a blank run leaves the break to the next text
                    gap, self.gap = self.gap, ""
                _, parent, item, _ = opened[-1]
                rows.append([TEXT, parent, len(rows) + 1, 0, item, None, text, gap, None, None, None, None, None])
        return done

    def read(self, html: str) -> list[list]:
        self.feed(html[self._read_plain(html):])
        self.close()
        self._close_to(0)
        return self.rows


def _arrow_nodes(rendered: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, _PAGES_PER_BATCH):
                batch = whole.slice(start, _PAGES_PER_BATCH)
                rows: list[list] = []
                offsets = [0]
                for html in batch.column("html"):
                    rows.extend(_Nodes(rendered).read(html.as_py() or ""))
                    offsets.append(len(rows))
                nodes = pa.StructArray.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], fields=list(_ARROW))
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), nodes)
                keep = [n for n in batch.schema.names if n != "html"]
                yield pa.RecordBatch.from_arrays([batch.column(n) for n in keep] + [lists], keep + ["nodes"])
    return run


Nodes = list[list]


def texts_of(nodes: Nodes, at: int) -> list[list]:
    """Text nodes inside the element at a position."""
    element = nodes[at - 1]
    kinds = (TEXT, RAW) if element[TAG] in RAW_TAGS else (TEXT,)
    return [n for n in nodes[at - 1:element[STOP]] if n[KIND] in kinds]


def raw_of(nodes: Nodes, at: int, sep: str = "") -> str:
    """Text of an element as written."""
    return sep.join(n[TEXT_OF] for n in texts_of(nodes, at))


def clean_of(nodes: Nodes, at: int, sep: str = "") -> str:
    """Text of an element with every piece trimmed and blank pieces left out."""
    return sep.join(t for n in texts_of(nodes, at) if (t := n[TEXT_OF].strip(BLANKS)))


_BLANK_RUN = re.compile(r"[ \t\n\x0b\f\r]+")


def shown_of(nodes: Nodes, at: int) -> str:
    """Text of an element with the line breaks a reader sees."""
    return "".join(n[GAP] + _BLANK_RUN.sub(" ", n[TEXT_OF]) for n in texts_of(nodes, at))


def _arrow_values(read: Callable, schema: pa.Schema, rendered: bool, keep: list[str], drop: list[str]):
    names = [n for n in schema.names if n not in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, start, size = [], 0, 0
            pages = [batch.column(c).to_pylist() for c in drop]
            for i, (html, *known) in enumerate(zip(batch.column("html").to_pylist(), *pages)):
                found = read(_Nodes(rendered).read(html or ""), *known)
                rows.append(found)
                size += sum(len(str(v)) for v in found)
                if size > _BYTES_PER_BATCH or i == batch.num_rows - 1:
                    picked = [pa.array(list(c), schema.field(n).type) for n, c in zip(names, zip(*rows))]
                    whole = [batch.column(n).slice(start, len(rows)) for n in keep]
                    yield pa.RecordBatch.from_arrays(whole + picked, keep + names)
                    rows, start, size = [], i + 1, 0
    return run


def page_values(pages: DataFrame, read: Callable, fields: str, known: tuple[str, ...] = (), rendered: bool = False) -> DataFrame:
    """Replace ``html`` by the columns ``fields``. ``read(nodes, *known)`` gives their values
    for a page, from its nodes and the page's columns ``known``. Filter and project pages
    before this call: neither crosses a Python map."""
    kept = [f for f in pages.schema.fields if f.name != "html"]
    schema = T.StructType(kept + T.StructType.fromDDL(fields).fields)
    run = _arrow_values(read, to_arrow_schema(schema), rendered, [f.name for f in kept], list(known))
    return pages.mapInArrow(run, schema)


def page_nodes(pages: DataFrame, rendered: bool = False) -> DataFrame:
    """Replace ``html`` by ``nodes``. Filter and project pages before this call:
    neither crosses a Python map."""
    kept = [f for f in pages.schema.fields if f.name != "html"]
    schema = T.StructType(kept + [T.StructField("nodes", T.ArrayType(NODE))])
    return pages.mapInArrow(_arrow_nodes(rendered), schema)


def node_rows(paged: DataFrame) -> DataFrame:
    """One row per node, for ad-hoc queries."""
    others = [c for c in paged.columns if c != "nodes"]
    return paged.select(*others, F.posexplode("nodes").alias("pos", "n")).select(*others, "pos", "n.*")


def _texts(nodes: Column, at: Column) -> Column:
    """Text nodes inside the element at a position."""
    element = F.element_at(nodes, at)
    raw = F.coalesce(element["tag"].isin(*RAW_TAGS), F.lit(False))
    inside = F.slice(nodes, at, element["stop"] - at + 1)
    return F.filter(inside, lambda n: (n["kind"] == TEXT) | (raw & (n["kind"] == RAW)))


def raw_text(nodes: Column, at: Column, sep: str = "") -> Column:
    """Text of an element as written."""
    return F.array_join(F.transform(_texts(nodes, at), lambda n: n["text"]), sep)


def clean_text(nodes: Column, at: Column, sep: str = "") -> Column:
    """Text of an element with every piece trimmed and blank pieces left out."""
    pieces = F.transform(_texts(nodes, at), lambda n: strip(n["text"]))
    return F.array_join(F.filter(pieces, lambda t: t != ""), sep)


def rendered_text(nodes: Column, at: Column) -> Column:
    """Text of an element with the line breaks a reader sees."""
    shown = F.transform(
        _texts(nodes, at),
        lambda n: F.concat(n["gap"], F.regexp_replace(n["text"], r"\s+", " ")))
    return F.array_join(shown, "")


def positions(nodes: Column, test) -> Column:
    """Positions of the nodes that pass a test, in document order."""
    marked = F.transform(nodes, lambda n, i: F.when(test(n), i + 1))
    return F.array_compact(marked)


def first_position(nodes: Column, test) -> Column:
    return F.try_element_at(positions(nodes, test), F.lit(1))


def is_element(n: Column, *tags: str) -> Column:
    element = n["kind"] == ELEMENT
    return element & n["tag"].isin(*tags) if tags else element
