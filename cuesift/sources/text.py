"""Plain text and the dispatch over file formats.

Every parser is a projection on the row that holds the file, so turning files
into segments needs no shuffle and no grouping.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import (
    EVENT_CUE_EXTENSIONS,
    PLAIN_TEXT_EXTENSIONS,
    TEXT_EXTENSIONS,
    TIMED_CUE_EXTENSIONS,
)
from ..functions.text import SPACE, lines_of, trim_space
from ..schemas import PARSED
from .subtitles import event_cues, timed_cues

SEGMENT_CHARS = 2000
# A long line breaks after the last blank of the final fifth of its window.
_WINDOW_FLOOR = SEGMENT_CHARS - SEGMENT_CHARS // 5
_CHUNK = (
    rf"(?s).{{1,{SEGMENT_CHARS}}}\z"
    rf"|.{{{_WINDOW_FLOOR},{SEGMENT_CHARS - 1}}}[{SPACE}]"
    rf"|.{{{SEGMENT_CHARS}}}"
)

# A segment id packs the asset id and the ordinal. An asset id has 39 bits and an
# ordinal 24; a number beyond that stops the job, as it would name another segment.
ORDINAL_BITS = 24
ASSET_BITS = 63 - ORDINAL_BITS


def segment_id(asset_id: Column, ordinal: Column) -> Column:
    """The number of a segment, unique over all assets."""
    fits = asset_id.between(0, (1 << ASSET_BITS) - 1) & ordinal.between(0, (1 << ORDINAL_BITS) - 1)
    number = F.shiftleft(asset_id.cast("long"), ORDINAL_BITS) + ordinal
    message = F.format_string("segment %s of asset %s has no segment id", ordinal, asset_id)
    return F.when(asset_id.isNull() | fits, number).otherwise(F.raise_error(message).cast("long"))


def _drop_blank(lines: Column) -> Column:
    return F.filter(F.transform(lines, trim_space), lambda line: line != "")


def text_lines(content: Column) -> Column:
    """Trimmed non-blank lines; over-long ones are cut near whitespace."""
    lines = _drop_blank(lines_of(content))
    return F.flatten(
        F.transform(
            lines,
            lambda line: F.when(
                F.length(line) > SEGMENT_CHARS,
                _drop_blank(F.regexp_extract_all(line, F.lit(_CHUNK), F.lit(0))),
            ).otherwise(F.array(line)),
        )
    )


def untimed(lines: Column) -> Column:
    """Segments without times: unknown is null, never zero."""
    return F.transform(
        lines,
        lambda line: F.struct(
            line.alias("text"),
            F.lit(None).cast("long").alias("start_ms"),
            F.lit(None).cast("long").alias("end_ms"),
        ),
    )


def can_import(ext: Column) -> Column:
    """Whether the text of a file can be read without recognition."""
    return F.lower(ext).isin(TEXT_EXTENSIONS)


def parse_text(content: Column, ext: Column) -> Column:
    """Segments of one file by its extension; unknown formats give none."""
    kind = F.lower(ext)
    return (
        F.when(kind.isin(PLAIN_TEXT_EXTENSIONS), untimed(text_lines(content)))
        .when(kind.isin(TIMED_CUE_EXTENSIONS), timed_cues(content))
        .when(kind.isin(EVENT_CUE_EXTENSIONS), event_cues(content))
        .otherwise(F.array().cast(PARSED))
    )


def number_segments(df: DataFrame, items: Column, source: Column | str = "file") -> DataFrame:
    """One row per parsed segment, numbered from zero within its asset."""
    source = F.lit(source) if isinstance(source, str) else source
    return (
        df.select("asset_id", source.alias("source"), F.posexplode(items).alias("ordinal", "item"))
        .select(
            segment_id(F.col("asset_id"), F.col("ordinal")).alias("segment_id"),
            "asset_id",
            "source",
            "ordinal",
            F.col("item.text").alias("text"),
            F.col("item.start_ms").alias("start_ms"),
            F.col("item.end_ms").alias("end_ms"),
        )
    )


def segment_texts(files: DataFrame) -> DataFrame:
    """Segments of ``files(asset_id, ext, content string)``."""
    return number_segments(files, parse_text(F.col("content"), F.col("ext")))
