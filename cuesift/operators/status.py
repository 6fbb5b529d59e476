"""Extraction status derived from jobs and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import salted_join

ACTIVE = ["queued", "running"]


def latest_active(jobs: DataFrame) -> DataFrame:
    """``asset_id, active_status`` of the newest active extraction per asset."""
    active = jobs.where(
        (F.col("type") == "extract") & F.col("target_id").isNotNull() & F.col("status").isin(ACTIVE)
    )
    return active.groupBy(F.col("target_id").alias("asset_id")).agg(
        F.max_by("status", "job_id").alias("active_status")
    )


def latest_run(runs: DataFrame) -> DataFrame:
    """``asset_id, run_status`` of the newest run per asset."""
    return runs.groupBy("asset_id").agg(F.max_by("status", "run_id").alias("run_status"))


def derive_status(assets: DataFrame, jobs: DataFrame, runs: DataFrame) -> DataFrame:
    """Assets with ``derived_status``: an active job first, then the last run."""
    derived = (
        F.when(F.col("active_status") == "running", F.lit("running"))
        .when(F.col("active_status").isNotNull(), F.lit("pending"))
        .when(F.col("run_status").isNull(), F.lit("none"))
        .when(F.col("run_status") == "succeeded", F.lit("done"))
        .otherwise(F.lit("failed"))
    )
    return (
        assets.join(latest_active(jobs), "asset_id", "left")
        .join(latest_run(runs), "asset_id", "left")
        .withColumn("derived_status", derived)
        .drop("active_status", "run_status")
    )


def status_drift(assets: DataFrame, jobs: DataFrame, runs: DataFrame) -> DataFrame:
    """Assets shown as in progress whose records say otherwise."""
    in_progress = assets.where(F.col("extract_status").isin("pending", "running"))
    return derive_status(in_progress, jobs, runs).where(
        F.col("extract_status") != F.col("derived_status")
    )


def sync_status(assets: DataFrame, jobs: DataFrame, runs: DataFrame, now_ms: int) -> DataFrame:
    """Assets with their derived status; the extraction time moves only on done."""
    derived = derive_status(assets, jobs, runs)
    done = F.col("derived_status") == "done"
    return derived.select(
        *[
            F.col("derived_status").alias(c)
            if c == "extract_status"
            else F.when(done, F.lit(now_ms)).otherwise(F.col(c)).alias(c)
            if c == "extracted_at"
            else F.lit(now_ms).alias(c)
            if c == "updated_at"
            else F.col(c)
            for c in assets.columns
        ]
    )


def active_conflicts(jobs: DataFrame) -> DataFrame:
    """Active jobs that repeat an earlier active job of the same type and target."""
    active = jobs.where(F.col("status").isin(ACTIVE))
    first = active.groupBy("type", "target_id").agg(F.min("job_id").alias("first_job_id"))
    joined = salted_join(active, first, ["type", "target_id"], "inner", F.col("job_id"))
    return joined.where(F.col("job_id") != F.col("first_job_id"))
