"""Which assets still need their text, and recording the outcome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import extraction_plan
from .ids import number_rows

EXTRACTION_FAILED = "EXTRACTION_FAILED"


def plan_extraction(assets: DataFrame) -> DataFrame:
    """Assets with how their text is obtained."""
    return assets.withColumn("extraction_plan", extraction_plan(F.col("kind"), F.col("ext")))


def cached_runs(assets: DataFrame, runs: DataFrame, label: str) -> DataFrame:
    """``asset_id, run_id``: latest success for the same file state and label."""
    done = runs.where((F.col("status") == "succeeded") & (F.col("engine_label") == label))
    latest = done.groupBy("asset_id", "fingerprint").agg(F.max("run_id").alias("run_id"))
    return assets.select("asset_id", "fingerprint").join(latest, ["asset_id", "fingerprint"]).select(
        "asset_id", "run_id"
    )


def extraction_worklist(assets: DataFrame, runs: DataFrame, label: str) -> DataFrame:
    """Assets without a cached result; a changed file or label misses the cache."""
    done = runs.where((F.col("status") == "succeeded") & (F.col("engine_label") == label))
    return assets.join(done, ["asset_id", "fingerprint"], "left_anti")


def replace_segments(old: DataFrame, new: DataFrame, touched: DataFrame) -> DataFrame:
    """Segments after re-extraction: touched assets keep only their new rows."""
    return old.join(touched.select("asset_id"), "asset_id", "left_anti").unionByName(
        new.select(*old.columns)
    )


def run_rows(
    outcomes: DataFrame, label: str, source: str, now_ms: int, after: Column
) -> tuple[DataFrame, DataFrame]:
    """Run and source rows for ``outcomes(asset_id, fingerprint, segment_count,
    skipped_reason, error_code, error_message)``, numbered following ``after``."""
    failed = F.col("error_code").isNotNull()
    staged = number_rows(outcomes, ["asset_id"], "run_id", after)
    runs = staged.select(
        "run_id",
        "asset_id",
        "fingerprint",
        F.when(failed, F.lit("failed")).otherwise(F.lit("succeeded")).alias("status"),
        F.lit(label).alias("engine_label"),
        "error_code",
        "error_message",
        F.lit(now_ms).alias("started_at"),
    )
    sources = staged.select(
        "run_id",
        F.lit(source).alias("source"),
        F.when(failed, F.lit("failed"))
        .when(F.col("skipped_reason").isNotNull(), F.lit("skipped"))
        .otherwise(F.lit("succeeded"))
        .alias("status"),
        F.when(failed, F.lit(0)).otherwise(F.col("segment_count")).cast("long").alias("segment_count"),
        "error_code",
        F.coalesce("error_message", "skipped_reason").alias("error_message"),
    )
    return runs, sources


def apply_outcomes(assets: DataFrame, outcomes: DataFrame, now_ms: int) -> DataFrame:
    """Assets with the status, error and times their extraction left behind.

    A known duration replaces the old one; an unknown one leaves it.
    """
    result = outcomes.select(
        "asset_id",
        F.lit(True).alias("__ran"),
        F.col("error_message").alias("__error"),
        F.col("error_code").isNull().alias("__ok"),
        F.col("duration_ms").alias("__duration")
        if "duration_ms" in outcomes.columns
        else F.lit(None).cast("long").alias("__duration"),
    )
    joined = assets.join(result, "asset_id", "left")
    ok, ran = F.coalesce(F.col("__ok"), F.lit(False)), F.col("__ran").isNotNull()
    changes = {
        "extract_status": F.when(ok, F.lit("done")).when(ran, F.lit("failed")).otherwise(F.col("extract_status")),
        "extract_error": F.when(ran, F.col("__error")).otherwise(F.col("extract_error")),
        "extracted_at": F.when(ok, F.lit(now_ms)).otherwise(F.col("extracted_at")),
        "duration_ms": F.when(ok, F.coalesce("__duration", "duration_ms")).otherwise(F.col("duration_ms")),
        "updated_at": F.when(ran, F.lit(now_ms)).otherwise(F.col("updated_at")),
    }
    return joined.select(*[changes[c].alias(c) if c in changes else F.col(c) for c in assets.columns])
