"""Judge URLs by glob rules with a bit-parallel wildcard automaton.

All patterns are packed one after the other into an array of 64-bit words, one bit per
literal character. Reading a character shifts every state by one, keeps those whose next
literal it is, and keeps those that stand before a wildcard which may swallow it
(Shift-And with self loops). Shifts carry over word borders, so the number of patterns is
not limited by the word. The states of a batch of URLs are a matrix: one array step per
character position moves all patterns on all URLs that are still being read.

Patterns are matched against ``.host path ?query`` (the canonical URL below) as a whole:
``*`` is any run of characters and ``@`` any run without a slash or
question mark, so that ``@`` stays within the host.

Host rules ``host/path`` become ``@.host/path*``: the host itself and its subdomains, and
paths that start with the rule's. The longest fitting host rule decides. Where none fits,
the glob rules do: block if a blocking glob fits and no allowing one does.

Canonical URL: the host is what lies between the first ``://`` and the next ``/``, ``?``,
``#`` or the end, with A-Z in lower case; the path runs from there to ``?``, ``#`` or the
end; then comes ``?`` and the query if there is one, without the fragment. A null URL, or
one without ``://``, has an empty host and path and fits no host rule.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from resalelens.llm.tables import bounded_batches

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = 64
#: Bytes that ``@`` does not cross: a host ends at a slash or a question mark.
PART_ENDS = list(b"/?")


@dataclass(frozen=True)
class HostRule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def glob(self) -> str:
        return f"@.{self.host}{self.path}*"


@dataclass(frozen=True)
class GlobRule:
    glob: str
    verdict: str


# Host rules of the contract.
HOST_RULES = (
    HostRule("net", "/", "block"), HostRule("example.net", "/en/", "allow"),
    HostRule("example.com", "/de/", "block"), HostRule("org", "/fr/", "allow"),
)

# What a crawl has no use for: sessions, accounts, carts, searches, feeds, binaries.
GLOB_RULES = tuple(GlobRule(g, "block") for g in (
    "*/login*", "*/signin*", "*/logout*", "*/register*", "*/account/*", "*/cart*", "*/checkout*",
    "*/wp-login*", "*/wp-admin/*", "*/cgi-bin/*", "*/search?*", "*/tag/*", "*/feed/", "*/rss*",
    "*?*sessionid=*", "*?*phpsessid=*", "*?*replytocom=*", "*?*sort=*&*order=*", "*?*print=1*",
    "*.zip", "*.exe", "*.tar.gz", "*.mp4", "*.jpg", "*.png", "*.css", "*.js",
    "@.ads.*", "@.adserver.*", "@.tracker.*", "*/../*",
)) + (GlobRule("*/robots.txt", "allow"), GlobRule("*/sitemap*.xml", "allow"))


class GlobSet:
    """Multiword Shift-And automaton of several whole-string globs over bytes."""

    def __init__(self, globs: list[str]):
        parsed = [self._parse(g) for g in globs]
        n = sum(len(lits) for lits, _ in parsed)
        self.words = max(1, -(-n // WORD))
        accept = [[] for _ in range(256)]
        loops = [np.zeros(self.words, np.uint64) for _ in range(2)]     # any byte, no part end
        self.always = np.zeros(self.words, np.uint64)                    # starts anywhere
        self.no_slash = np.zeros(self.words, np.uint64)                  # starts before a part end
        self.first = np.zeros(self.words, np.uint64)                     # starts at the start
        self.ends: list[tuple[int, np.uint64]] = []
        bit = 0
        for lits, gaps in parsed:
            for i, byte in enumerate(lits):
                word, mask = divmod(bit, WORD)[0], np.uint64(1) << np.uint64(bit % WORD)
                accept[byte].append((word, mask))
                if i == 0:
                    start = {"*": self.always, "@": self.no_slash, "": self.first}[gaps[0]]
                    start[word] |= mask
                if gaps[i + 1] == "*":
                    loops[0][word] |= mask
                elif gaps[i + 1] == "@":
                    loops[1][word] |= mask
                bit += 1
            self.ends.append((word, mask))
        self.accept = np.zeros((256, self.words), np.uint64)
        for byte, places in enumerate(accept):
            for word, mask in places:
                self.accept[byte, word] |= mask
        self.loop = np.tile(loops[0] | loops[1], (256, 1))
        for byte in PART_ENDS:
            self.loop[byte] = loops[0]
        # A literal may only follow the literal before it in its own pattern.
        self.begin = self.first | self.always | self.no_slash

    @staticmethod
    def _parse(glob: str) -> tuple[bytes, list[str]]:
        """Literals, and the wildcard before each of them and after the last."""
        lits, gaps = bytearray(), [""]
        for byte in glob.encode():
            if byte in b"*@":
                gaps[-1] = "*" if "*" in (chr(byte), gaps[-1]) else "@"
            else:
                lits.append(byte)
                gaps.append("")
        if not lits:
            raise ValueError(f"a pattern needs a literal: {glob!r}")
        return bytes(lits), gaps

    def match(self, texts: list[bytes]) -> np.ndarray:
        """Matrix texts x globs: which globs fit which texts as a whole."""
        size = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-size, kind="stable")
        flat = np.frombuffer(b"".join(texts), np.uint8)
        at = np.cumsum(size) - size
        state = np.zeros((len(texts), self.words), np.uint64)     # rows in order of length
        slashed = np.zeros(len(texts), bool)
        sorted_at, sorted_size = at[order], size[order]
        one, top = np.uint64(1), np.uint64(WORD - 1)
        for i in range(int(size.max(initial=0))):
            live = int(np.searchsorted(-sorted_size, -i, "left"))   # those longer than i
            byte = flat[sorted_at[:live] + i]
            old = state[:live]
            moved = old << one
            moved[:, 1:] |= old[:, :-1] >> top
            # What moves into a pattern's first literal comes from the pattern before it.
            moved &= ~self.begin
            moved |= self.always
            moved[~slashed[:live]] |= self.no_slash
            if i == 0:
                moved |= self.first
            state[:live] = (moved & self.accept[byte]) | (old & self.loop[byte])
            slashed[:live] |= np.isin(byte, PART_ENDS)
        out = np.zeros((len(texts), len(self.ends)), bool)
        for g, (word, mask) in enumerate(self.ends):
            out[order, g] = (state[:, word] & mask) != 0
        return out


def _lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """Host, path and query with its question mark; empty where absent."""
    shape = r"(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?"
    host, path, query = (F.coalesce(F.regexp_extract(url, shape, i), F.lit("")) for i in (1, 2, 3))
    return _lower(host), path, query


def verdict_of(host_rules: tuple[HostRule, ...], glob_rules: tuple[GlobRule, ...]):
    """Column function: canonical URL to ``rule``, ``verdict`` and the ``pattern`` that blocks."""
    ranked = sorted(range(len(host_rules)), key=lambda i: -len(host_rules[i].name))
    shape = T.StructType([T.StructField(c, T.StringType()) for c in ("rule", "verdict", "pattern")])

    @F.arrow_udf(shape)
    def judge(urls: pa.Array) -> pa.Array:
        globs = GlobSet([r.glob for r in host_rules] + [r.glob for r in glob_rules])
        hit = globs.match([(u or "").encode() for u in urls.to_pylist()])
        rows = []
        for fits in hit:
            rule = next((host_rules[i] for i in ranked if fits[i]), None)
            own = [r for r, ok in zip(glob_rules, fits[len(host_rules):]) if ok]
            allowed = any(r.verdict == "allow" for r in own)
            blocked = next((r.glob for r in own if r.verdict == "block" and not allowed), None)
            if rule:
                rows.append({"rule": rule.name, "verdict": rule.verdict, "pattern": None})
            else:
                rows.append({"rule": None, "verdict": "block" if blocked else "allow", "pattern": blocked})
        return pa.array(rows, pa.struct([(c, pa.string()) for c in ("rule", "verdict", "pattern")]))
    return judge


def judge_urls(
    pages: DataFrame, url: str = "url",
    host_rules: tuple[HostRule, ...] = HOST_RULES, glob_rules: tuple[GlobRule, ...] = GLOB_RULES,
) -> DataFrame:
    """All rows and columns with ``host, path, rule, verdict, pattern`` added or replaced."""
    bounded_batches(pages.sparkSession)
    host, path, query = url_parts(F.col(url))
    judged = verdict_of(host_rules, glob_rules)(F.concat(F.lit("."), host, path, query))
    return pages.withColumns({"host": host, "path": path, "__judged": judged}).select(
        *[c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "pattern")],
        "host", "path", "__judged.rule", "__judged.verdict", "__judged.pattern")
