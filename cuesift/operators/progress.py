"""Download progress that never runs backwards."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _so_far(key: list[str], order: str) -> Window:
    return Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def running(
    rows: DataFrame,
    key: list[str],
    order: str,
    value: str,
    name: str,
    combine: Callable[[Column], Column],
    span: int | None = None,
) -> DataFrame:
    """Running ``combine`` (sum or max) of ``value`` along ``order``.

    A plain window, which reads ``rows`` once and spills a long history. ``span``
    changes nothing any more: joining histories cut into spans read the rows
    twice at every step, so that seven steps in a row read them 192 times.
    """
    return rows.withColumn(name, combine(F.col(value)).over(_so_far(key, order)))


def download_progress(events: DataFrame) -> DataFrame:
    """``download_id, seq, phase, loaded, total, percent`` for each known event.

    ``events(download_id, seq, status, file, loaded, total)``. Bytes add up over
    the files of a download; a finished file counts its whole size even where
    the event omits it. The percentage is the highest reached so far.
    The events are shuffled twice, by file and by download.
    """
    known = events.where(F.col("status").isin("initiate", "download", "progress", "done")).select(
        "download_id",
        "seq",
        "status",
        F.when(F.coalesce("file", F.lit("")) == "", F.lit("current file")).otherwise(F.col("file")).alias("file"),
        F.greatest(F.coalesce("loaded", F.lit(0)), F.lit(0)).cast("long").alias("reported"),
        F.when(F.col("total") > 0, F.col("total")).cast("long").alias("declared"),
    )
    # the size last declared for the file, then how far the file has come
    file = ["download_id", "file"]
    sized = _latest(known, file, "seq", "declared", "file_total")
    finished = (F.col("status") == "done") & F.col("file_total").isNotNull()
    far = F.when(F.col("status") == "initiate", F.lit(0)).otherwise(
        F.when(finished, F.greatest("reported", "file_total")).otherwise(F.col("reported"))
    )
    reached = running(sized.withColumn("far", far.cast("long")), file, "seq", "far", "file_loaded", F.max)
    steps = _steps(_steps(reached, "file_loaded", "d_loaded"), "file_total", "d_total")
    loaded = running(steps, ["download_id"], "seq", "d_loaded", "loaded", F.sum)
    total = running(loaded, ["download_id"], "seq", "d_total", "total", F.sum)
    downloading = (F.col("status") != "initiate") & (F.col("total") > 0)
    percent = F.when(
        downloading, F.least(F.lit(100.0), F.floor(F.col("loaded") / F.col("total") * 100 + 0.5))
    )
    marked = running(
        total.withColumn("now", percent.cast("double")), ["download_id"], "seq", "now", "high", F.max
    )
    return marked.select(
        "download_id",
        "seq",
        F.when(F.col("status") == "initiate", "preparing").otherwise("downloading").alias("phase"),
        F.col("loaded").cast("long").alias("loaded"),
        F.col("total").cast("long").alias("total"),
        F.when(downloading, F.col("high")).cast("long").alias("percent"),
    )


def _latest(rows: DataFrame, key: list[str], order: str, value: str, name: str) -> DataFrame:
    """Last non-null ``value`` so far.

    Values given at the same place all count, each in a row of its own; rows
    without a place or without a whole key neither give nor take a value.
    """
    placed = F.col(order).isNotNull()
    for column in key:
        placed = placed & F.col(column).isNotNull()
    here = Window.partitionBy(*key).orderBy(order).rangeBetween(Window.currentRow, Window.currentRow)
    given = rows.withColumn("__here", F.collect_list(F.when(placed, F.col(value))).over(here))
    last = F.last(F.when(F.size("__here") > 0, F.col("__here")), ignorenulls=True)
    return (
        given.withColumn("__last", last.over(_so_far(key, order)))
        .withColumn(name, F.explode_outer("__last"))
        .drop("__here", "__last")
    )


def _steps(rows: DataFrame, value: str, name: str) -> DataFrame:
    """Change of ``value`` since the previous event of the same file."""
    before = F.lag(value).over(Window.partitionBy("download_id", "file").orderBy("seq"))
    return rows.withColumn(name, F.coalesce(F.col(value), F.lit(0)) - F.coalesce(before, F.lit(0)))
