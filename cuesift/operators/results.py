"""Versioned results of text transformations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import salted_join
from .ids import highest, number_rows

UNKNOWN_ERROR = "UNKNOWN"


def current_results(results: DataFrame) -> DataFrame:
    """The newest success per asset; a later failure does not displace it."""
    good = results.where(F.col("status") == "succeeded")
    rest = [c for c in results.columns if c not in ("asset_id", "result_id")]
    newest = F.max_by(F.struct("result_id", *rest), F.col("result_id"))
    return good.groupBy("asset_id").agg(newest.alias("r")).select("asset_id", "r.*")


def mark_current(results: DataFrame) -> DataFrame:
    """The whole history with ``is_current``."""
    newest = (
        results.where(F.col("status") == "succeeded")
        .groupBy("asset_id")
        .agg(F.max("result_id").alias("__current"))
    )
    joined = salted_join(results, newest, ["asset_id"], "left", F.col("result_id"))
    return joined.withColumn(
        "is_current", F.coalesce(F.col("result_id") == F.col("__current"), F.lit(False))
    ).drop("__current")


def save_results(history: DataFrame, rows: DataFrame, created_at: int) -> DataFrame:
    """The rows to append for new results: ids after the highest in use, and a time.

    ``history`` needs its ``result_id`` only. Nothing stored is rewritten: which
    result is current follows from the ids, see ``mark_current``. ``rows`` hold at
    most one result per asset and model.
    """
    numbered = number_rows(rows, ["asset_id", "model"], "result_id", highest(history, "result_id"))
    return numbered.withColumn("created_at", F.lit(created_at).cast("long"))


def last_failures(results: DataFrame) -> DataFrame:
    """Why the newest failed attempt of each asset failed."""
    bad = results.where(F.col("status") == "failed")
    newest = F.max_by(F.struct("error_code", "error_message", "created_at"), F.col("result_id"))
    return (
        bad.groupBy("asset_id")
        .agg(newest.alias("r"))
        .select(
            "asset_id",
            F.coalesce("r.error_code", F.lit(UNKNOWN_ERROR)).alias("error_code"),
            F.coalesce("r.error_message", F.lit("")).alias("error_message"),
            F.col("r.created_at").alias("created_at"),
        )
    )
