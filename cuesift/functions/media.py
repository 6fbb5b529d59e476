"""Facts read from the text log of a media probe."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE

_DURATION = rf"Duration:[{SPACE}]*(\d+):(\d{{2}}):(\d{{2}})\.(\d{{1,3}})"
_STREAM = rf"(?m)^[{SPACE}]*Stream #\d+:\d+.*?:[{SPACE}]*(Audio|Video|Subtitle)[{SPACE}]*:"


def clock_ms(hours: Column, minutes: Column, seconds: Column, fraction: Column) -> Column:
    """Milliseconds of a clock reading; the fraction is left-aligned."""
    return (
        hours.cast("long") * 3_600_000
        + minutes.cast("long") * 60_000
        + seconds.cast("long") * 1_000
        + F.rpad(fraction, 3, "0").cast("long")
    )


def media_info(log: Column) -> Column:
    """``struct(duration_ms, has_audio, has_video)`` of a probe log."""
    part = [F.regexp_extract(log, _DURATION, i) for i in range(1, 5)]
    streams = F.regexp_extract_all(log, F.lit(_STREAM), F.lit(1))
    return F.struct(
        F.when(part[0] != "", clock_ms(*part)).alias("duration_ms"),
        F.array_contains(streams, "Audio").alias("has_audio"),
        F.array_contains(streams, "Video").alias("has_video"),
    )
