"""Whitespace, folding and length rules.

The catalogue counts lengths in code points, reports highlight offsets in
UTF-16 units, and treats more characters as blank than Spark's ``trim`` does.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters that count as whitespace, for use inside [...].
SPACE = r"\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"

# The same characters, spelled out for the trimming functions.
_SPACE_CHARS = (
    "\t\n\x0b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
)

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def trim_space(col: Column) -> Column:
    """Strip leading and trailing whitespace of every kind."""
    return F.btrim(col, F.lit(_SPACE_CHARS))


def pieces(col: Column, pattern: str) -> Column:
    """Split at a pattern; no character of the text has a meaning of its own."""
    return F.split(col, pattern)


def lines_of(col: Column) -> Column:
    """Split at CRLF, CR or LF."""
    unix = F.replace(col, F.lit("\r\n"), F.lit("\n"))
    return F.split(F.translate(unix, "\r", "\n"), "\n")


def collapse_space(col: Column) -> Column:
    """Replace each whitespace run by one space, then strip."""
    return trim_space(F.regexp_replace(col, rf"[{SPACE}]+", " "))


def ascii_fold(col: Column) -> Column:
    """Lower-case A-Z only, the folding of a SQL ``LIKE``."""
    return F.translate(col, _UPPER, _UPPER.lower())


def contains_literal(col: Column, needle: Column | str) -> Column:
    """``LIKE %needle%`` with ASCII folding; ``%`` and ``_`` mean themselves."""
    needle = F.lit(needle) if isinstance(needle, str) else needle
    return F.contains(ascii_fold(col), ascii_fold(needle))


def char_fold(col: Column) -> Column:
    """Lower-case character by character, keeping one code point per character.

    ``lower`` on a whole string turns a final capital sigma into another letter
    and the dotted capital I into two code points; both would shift offsets.
    The dotted I is mapped to a noncharacter, so it only ever equals itself.
    """
    return F.lower(F.translate(col, "\u03a3\u0130", "\u03c3\ufdd0"))


def utf16_length(col: Column) -> Column:
    """Length in UTF-16 code units."""
    return F.shiftright(F.octet_length(F.encode(col, "UTF-16BE")), 1)
