"""Small string helpers that the other function modules build on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Members of a character class: what a browser counts as white space. The same text is valid for Java's and for RE2 patterns.
SPACES = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
WS = f"[{SPACES}]"
NOT_WS = f"[^{SPACES}]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: The same members as text, for trimming.
SPACE_CHARS = "\t\n\x0b\f\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def wide_trim(c: Column) -> Column:
    """Without white space of any kind at both ends (trim() takes blanks only). Only the ends are read."""
    return F.btrim(c, F.lit(SPACE_CHARS))


def present(c: Column) -> Column:
    """The trimmed text; null where nothing is left."""
    return F.nullif(wide_trim(c), F.lit(""))


def first_present(*cs: Column) -> Column:
    return F.coalesce(*[present(c) for c in cs])


def group(c: Column, pattern: str, index: int = 1) -> Column:
    """A capture group of the first match; null without a match."""
    return F.nullif(F.regexp_extract(c, pattern, index), F.lit(""))


def has_any(c: Column, *parts: str) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | c.contains(p)
    return out


def word_count(c: Column) -> Column:
    """A1: runs of anything but white space; 0 for null."""
    plain = F.translate(c, SPACE_CHARS, " " * len(SPACE_CHARS))  # one kind of white space makes a much simpler pattern
    return F.coalesce(F.regexp_count(plain, F.lit("[^ ]+")), F.lit(0)).cast("long")


def reading_minutes(words: Column, per_minute: int = 200) -> Column:
    return F.greatest(F.lit(1), F.ceil(words / per_minute)).cast("long")
