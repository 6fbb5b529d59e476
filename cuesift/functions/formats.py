"""Display formats, engine labels and prompt text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _whole_seconds(ms: Column) -> Column:
    return F.greatest(F.floor((ms + 500) / 1000), F.lit(0)).cast("long")


def clock_short(ms: Column) -> Column:
    """``m:ss``, minutes unbounded; null stays null."""
    total = _whole_seconds(ms)
    text = F.format_string("%d:%02d", F.floor(total / 60).cast("long"), F.pmod(total, F.lit(60)))
    return F.when(ms.isNotNull(), text)


def clock_long(ms: Column) -> Column:
    """``mm:ss``, or ``h:mm:ss`` from one hour on; null gives an empty string."""
    total = _whole_seconds(ms)
    hours = F.floor(total / 3600).cast("long")
    minutes = F.floor(F.pmod(total, F.lit(3600)) / 60).cast("long")
    seconds = F.pmod(total, F.lit(60))
    return (
        F.when(ms.isNull(), F.lit(""))
        .when(hours > 0, F.format_string("%d:%02d:%02d", hours, minutes, seconds))
        .otherwise(F.format_string("%02d:%02d", minutes, seconds))
    )


def byte_size(size: Column) -> Column:
    """Size with a binary unit; one decimal below ten."""

    def scaled(power: int, unit: str) -> Column:
        value = size / float(1024**power)
        return F.when(
            value >= 10, F.format_string(f"%d {unit}", F.floor(value + 0.5).cast("long"))
        ).otherwise(F.format_string(f"%.1f {unit}", value))

    return (
        F.when(size < 1024, F.format_string("%d B", size.cast("long")))
        .when(size < 1024**2, scaled(1, "KB"))
        .when(size < 1024**3, scaled(2, "MB"))
        .when(size < 1024**4, scaled(3, "GB"))
        .otherwise(scaled(4, "TB"))
    )


def minute_stamp(ms: Column) -> Column:
    """``yyyy-MM-dd HH:mm`` in the session time zone; null gives a dash."""
    return F.coalesce(F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd HH:mm"), F.lit("—"))


def engine_label(base: Column | str, script: Column | str) -> Column:
    """Cache label of a parser version and a target script."""
    as_col = lambda v: F.lit(v) if isinstance(v, str) else v
    return F.concat_ws("+", as_col(base), as_col(script))


def label_text(base: str, script: str) -> str:
    """The same label where both parts are plain values."""
    return f"{base}+{script}"


# Version and wording of the message sent for one asset.
PROMPT_VERSION = "polish-v1"
PROMPT_NAME_PREFIX = "素材："
PROMPT_TEXT_HEADING = "以下是这个素材里提取出的文字："


def prompt_text(asset_name: Column, text: Column) -> Column:
    """User message for one asset: its name, a heading, its text."""
    return F.concat_ws(
        "\n",
        F.concat(F.lit(PROMPT_NAME_PREFIX), asset_name),
        F.lit(""),
        F.lit(PROMPT_TEXT_HEADING),
        F.lit(""),
        text,
    )


def convert_script(col: Column, mapping: dict[str, str]) -> Column:
    """Character-level script conversion with a caller-supplied table."""
    if any(len(k) != 1 or len(v) != 1 for k, v in mapping.items()):
        raise ValueError("script tables map one character to one character")
    return F.translate(col, "".join(mapping), "".join(mapping.values()))
