"""Bytes of a text file to a string."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _after(content: Column, skip: int) -> Column:
    return F.substring(content, skip + 1, F.length(content))


def decode_text(content: Column) -> Column:
    """Byte-order marks first, then strict UTF-8, then GBK.

    The session needs ``allow_text_decoding`` for the GBK branch.
    """
    mark = F.hex(F.substring(content, 1, 3))
    utf8 = content.cast("string")
    little = _after(content, 2)
    whole_units = F.substring(little, 1, F.length(little) - F.pmod(F.length(little), F.lit(2)))
    return (
        F.when(F.startswith(mark, F.lit("EFBBBF")), F.make_valid_utf8(_after(content, 3).cast("string")))
        .when(F.startswith(mark, F.lit("FFFE")), F.decode(whole_units, "UTF-16LE"))
        .when(F.startswith(mark, F.lit("FEFF")), F.decode(_after(content, 2), "UTF-16BE"))
        .when(F.is_valid_utf8(utf8), utf8)
        .otherwise(F.decode(content, "GBK"))
    )
