"""Text columns: titles, card lines, search terms."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Everything a text trim removes: ASCII and Unicode blanks, not only the space.
BLANKS = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# The patterns that read a card.
NON_WORD = r"[^\p{L}\p{N}_]+"
CARD_TITLE = r"#\d+ - (.+?)(?:\s*\||\s*$)"
TIME_WORDS = r"(?i)hour|day|min"
HAS_DIGIT = r"\d+"
STATE_LINE = r"^[A-Z]{2}$"
BID_COUNT = r"(?i)(\d+)\s*bid"


def strip(c: Column) -> Column:
    """Trim every kind of blank from both ends."""
    return F.btrim(c, F.lit(BLANKS))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def title_case(c: Column) -> Column:
    """Title-case the first letter of each run of letters, lower-case the rest.

    A letter whose upper case is two letters gives one capital: sharp s becomes Ss.
    """
    runs = F.regexp_extract_all(F.lower(c), F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))

    def cased(w: Column) -> Column:
        first = F.upper(F.substring(w, 1, 1))
        return F.concat(F.substring(first, 1, 1), F.lower(F.substr(first, F.lit(2))), F.substr(w, F.lit(2)))

    return F.array_join(F.transform(runs, cased), "")


def norm_title(title: Column) -> Column:
    """Key under which two titles count as the same item."""
    return F.trim(F.regexp_replace(F.lower(title), NON_WORD, " "))


def search_terms(title: Column, n: int | None = None) -> Column:
    """Words of more than two characters, the first ``n`` if given."""
    words = F.filter(F.split(title, NON_WORD), lambda w: F.length(w) > 2)
    return words if n is None else F.slice(words, 1, n)


def term_set(text: Column) -> Column:
    """Distinct lower-case words of more than two characters, sorted."""
    words = F.split(F.lower(text), NON_WORD)
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: F.length(w) > 2)))


def search_query(title: Column, n: int | None = None) -> Column:
    return F.array_join(search_terms(title, n), " ")


def card_lines(text: Column) -> Column:
    """Trimmed, non-empty lines of a card."""
    lines = F.transform(F.split(text, "\n"), strip)
    return F.filter(lines, lambda line: line != "")


def card_text(lines: Column, n: int | None = None) -> Column:
    return F.array_join(lines if n is None else F.slice(lines, 1, n), " | ")


def card_title(text: Column, anchor_text: Column) -> Column:
    """Title after ``#<number> -`` in the card, title-cased; else the link's own text."""
    named = title_case(strip(F.regexp_extract(text, CARD_TITLE, 1)))
    return F.when(F.regexp_like(text, F.lit(CARD_TITLE)), named).otherwise(strip(anchor_text))


def first_line(lines: Column, *patterns: str) -> Column:
    """First line that matches every pattern; NULL if there is none."""
    def matches(line: Column) -> Column:
        hit = line.rlike(patterns[0])
        for p in patterns[1:]:
            hit = hit & line.rlike(p)
        return hit
    return F.try_element_at(F.filter(lines, matches), F.lit(1))


def time_left(lines: Column) -> Column:
    return strip(first_line(lines, TIME_WORDS, HAS_DIGIT))


def state_of(lines: Column) -> Column:
    return first_line(F.transform(lines, strip), STATE_LINE)


def bid_count(lines: Column) -> Column:
    line = first_line(lines, BID_COUNT)
    return F.regexp_extract(line, BID_COUNT, 1).try_cast("int")


def contains_any(text: Column, words) -> Column:
    """True if the lower-cased text holds any of the words, anywhere."""
    quoted = "|".join("\\Q" + w + "\\E" for w in words)
    return F.lower(text).rlike(quoted)


def has_word(text: Column, words) -> Column:
    """True if the text holds any of the words between word boundaries."""
    return F.lower(text).rlike(r"\b(" + "|".join(words) + r")s?\b")
