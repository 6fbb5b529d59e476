"""Speech recogniser output, kept as JSON, to segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bind import bind
from ..functions.text import trim_space
from .text import number_segments, untimed

_NUMERIC = r"^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL.*)$"


def _text_at(value: Column, path: str) -> Column:
    """Trimmed string at a path; any other type counts as empty."""
    is_text = F.schema_of_variant(F.try_variant_get(value, path, "variant")) == "STRING"
    return F.when(is_text, trim_space(F.try_variant_get(value, path, "string"))).otherwise("")


def _millis_at(value: Column, path: str) -> Column:
    """Seconds at a path as rounded milliseconds; null unless it is a number."""
    is_number = F.schema_of_variant(F.try_variant_get(value, path, "variant")).rlike(_NUMERIC)
    seconds = F.try_variant_get(value, path, "double")
    return F.when(is_number, F.floor(seconds * 1000 + 0.5).cast("long"))


def transcript_items(output: Column) -> Column:
    """Segments of one recogniser result; malformed output gives none.

    Blank chunks go, missing times stay null, and the whole text is used where
    there are no chunks.
    """

    def items(value: Column) -> Column:
        chunks = F.try_variant_get(value, "$.chunks", "array<variant>")
        timed = F.transform(
            chunks,
            lambda chunk: F.struct(
                _text_at(chunk, "$.text").alias("text"),
                _millis_at(chunk, "$.timestamp[0]").alias("start_ms"),
                _millis_at(chunk, "$.timestamp[1]").alias("end_ms"),
            ),
        )
        whole = untimed(F.array(_text_at(value, "$.text")))
        return F.when(F.size(chunks) > 0, timed).otherwise(whole)

    return F.filter(bind(F.try_parse_json(output), items), lambda item: item["text"] != "")


def segment_transcripts(outputs: DataFrame) -> DataFrame:
    """Segments of ``outputs(asset_id, output json string)``."""
    return number_segments(outputs, transcript_items(F.col("output")), source="audio")
