"""Words: the longest runs of the letters a-z and digits after lower-casing and removing accents."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

_SEPARATORS = re.compile("[^a-z0-9]+")
_MARKS = "".join(map(chr, range(0x300, 0x370)))
_MARK = re.compile("[\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f]")


def _unaccented() -> dict[int, str]:
    """Letters whose canonical decomposition is an ASCII letter and combining marks only."""
    out = {}
    for code in range(0xC0, 0x2000):
        base, *marks = unicodedata.normalize("NFD", chr(code))
        if marks and base.isascii() and all(map(unicodedata.combining, marks)):
            out[code] = base
    return out


UNACCENTED = _unaccented()
_FROM = "".join(chr(c) for c, b in UNACCENTED.items() if b.islower())
_TO = "".join(b for b in UNACCENTED.values() if b.islower())


def plain(text: str | None) -> str:
    """Lower case without accents."""
    low = (text or "").lower()
    return low if low.isascii() else _MARK.sub("", unicodedata.normalize("NFD", low))


def words(text: str | None) -> list[str]:
    """The words of a text; none if it is null or empty."""
    return _SEPARATORS.sub(" ", plain(text)).split()


def word_text(c: Column) -> Column:
    """The words joined by one blank, as a native expression; null gives ''."""
    bare = F.translate(F.lower(F.coalesce(c, F.lit(""))), _FROM + _MARKS, _TO)
    return F.trim(F.regexp_replace(bare, "[^a-z0-9]+", " "))


def name_key(c: Column) -> Column:
    """A key under which the spellings of a database name agree: no path, file ending, letter case, accents or separators.

    Runs of digits count by their value, so that 7, 07 and 007 agree; a separator between two of them is kept.
    """
    bare = F.regexp_replace(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"^.*[/\\]", "")), r"(?i)\.(sqlite3?|db)\s*$", "")
    marked = F.regexp_replace(F.translate(F.lower(bare), _FROM + _MARKS, _TO), "[^a-z0-9]+", "_")
    return F.regexp_replace(F.regexp_replace(marked, "(?<![0-9])_|_(?![0-9])", ""), "(?<![0-9])0+(?=[0-9])", "")


def strict_name_key(c: Column) -> Column:
    """The same with digits as they are written, to tell names apart that differ only in leading zeros."""
    return F.regexp_replace(word_text(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?i)^.*[/\\]|\.(sqlite3?|db)\s*$", "")), " ", "")
