"""Prompts built from extracted text, and a caller's function run over them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.formats import PROMPT_VERSION, prompt_text
from ..functions.text import utf16_length
from ..session import salted_join

# Input limit in UTF-16 units and the reason codes.
MAX_INPUT_CHARS = 120_000
NO_CONTENT = "EXTRACTION_NO_CONTENT"
TOO_LARGE = "POLISH_INPUT_TOO_LARGE"
ASSET_NOT_FOUND = "ASSET_NOT_FOUND"
UPSTREAM = "CREDENTIALS_UPSTREAM"

# Segments joined into one part of a full text.
PART_SEGMENTS = 500

RESULT_ROWS = (
    "asset_id long, body string, model string, prompt_version string, status string, "
    "error_code string, error_message string, input_chars long, input_tokens long, "
    "output_tokens long"
)


def text_sizes(segments: DataFrame) -> DataFrame:
    """``asset_id, input_chars``: UTF-16 length of the joined text, line feeds included."""
    return segments.groupBy("asset_id").agg(
        (F.sum(utf16_length(F.col("text"))) + F.count(F.lit(1)) - 1).alias("input_chars")
    )


def prompt_gate(assets: DataFrame, segments: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted(asset_id)`` with input size and, where it must not run, a reason.

    Sizes are summed without joining any text, so an over-large asset is turned
    away before its text is put together.
    """
    known = assets.select("asset_id", "file_name", F.lit(True).alias("__known"))
    rows = wanted.join(known, "asset_id", "left").join(text_sizes(segments), "asset_id", "left")
    chars = F.coalesce("input_chars", F.lit(0))
    reason = (
        F.when(F.col("__known").isNull(), F.lit(ASSET_NOT_FOUND))
        .when(chars == 0, F.lit(NO_CONTENT))
        .when(chars > MAX_INPUT_CHARS, F.lit(TOO_LARGE))
    )
    return rows.select(
        "asset_id", "file_name", chars.alias("input_chars"), reason.alias("gate_reason")
    )


def text_parts(segments: DataFrame, per_part: int = PART_SEGMENTS) -> DataFrame:
    """``asset_id, part, text``: the whole text of every asset in ordered parts.

    A part is the text of ``per_part`` ordinals, so no group grows with the
    asset; parts joined by line feeds in their order are the full text.
    """
    part = F.floor(F.col("ordinal") / per_part).cast("long").alias("part")
    return segments.groupBy("asset_id", part).agg(
        F.expr("listagg(text, '\n') within group (order by ordinal)").alias("text")
    )


def asset_texts(segments: DataFrame, max_chars: int = MAX_INPUT_CHARS) -> DataFrame:
    """``asset_id, input_chars, text`` of the assets that the gate admits.

    Only assets within the limit are joined, so each group is bounded; the gate
    reports the larger ones, and ``text_parts`` has the text of all.
    """
    small = text_sizes(segments).where(F.col("input_chars") <= max_chars)
    rows = salted_join(
        segments.select("asset_id", "ordinal", "text", "segment_id"),
        small,
        ["asset_id"],
        "inner",
        F.col("segment_id"),
    )
    return rows.groupBy("asset_id", "input_chars").agg(
        F.expr("listagg(text, '\n') within group (order by ordinal)").alias("text")
    )


def prompts(assets: DataFrame, segments: DataFrame, wanted: DataFrame) -> DataFrame:
    """``asset_id, file_name, input_chars, text, prompt`` of the admitted assets."""
    admitted = prompt_gate(assets, segments, wanted).where(F.col("gate_reason").isNull())
    texts = asset_texts(segments.join(wanted, "asset_id", "left_semi")).drop("input_chars")
    return admitted.drop("gate_reason").join(texts, "asset_id").withColumn(
        "prompt", prompt_text(F.col("file_name"), F.col("text"))
    )


def transform_texts(
    ready: DataFrame,
    function: Callable[[str], dict],
    model: str,
    prompt_version: str = PROMPT_VERSION,
    tasks: int | None = None,
) -> DataFrame:
    """Run ``function(prompt)`` over prompts; every prompt yields one result row.

    The function returns ``body`` and optionally ``stop_reason, model,
    input_tokens, output_tokens``. Exceptions, refusals, cut-off and empty
    answers become failure rows.
    """

    def verdict(answer: dict) -> tuple[str | None, str | None]:
        """Error code and message of an answer that cannot be used."""
        if answer.get("stop_reason") == "refusal":
            return UPSTREAM, "refused"
        if answer.get("stop_reason") == "max_tokens":
            return TOO_LARGE, "output was cut off"
        if not (answer.get("body") or "").strip():
            return UPSTREAM, "no content"
        return None, None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for asset_id, chars, prompt in batch.itertuples(index=False, name=None):
                try:
                    answer = function(prompt)
                    code, message = verdict(answer)
                except Exception as error:  # one bad call must not end the job
                    answer, code, message = {}, UPSTREAM, str(error)
                good = code is None
                rows.append(
                    {
                        "asset_id": asset_id,
                        "body": answer["body"].strip() if good else "",
                        "model": answer.get("model") or model,
                        "prompt_version": prompt_version,
                        "status": "succeeded" if good else "failed",
                        "error_code": code,
                        "error_message": message,
                        "input_chars": chars,
                        "input_tokens": answer.get("input_tokens") if good else None,
                        "output_tokens": answer.get("output_tokens") if good else None,
                    }
                )
            frame = pd.DataFrame(rows, columns=[part.split()[0] for part in RESULT_ROWS.split(", ")])
            whole = {"input_chars": "Int64", "input_tokens": "Int64", "output_tokens": "Int64"}
            yield frame.astype(whole)

    work = ready.select("asset_id", "input_chars", "prompt")
    work = work.repartition(tasks, "asset_id") if tasks else work.repartition("asset_id")
    return work.mapInPandas(run, RESULT_ROWS)
