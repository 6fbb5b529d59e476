"""From a folder of files to stored segments."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.formats import convert_script, label_text
from ..operators.extraction import (
    EXTRACTION_FAILED,
    apply_outcomes,
    cached_runs,
    extraction_worklist,
    replace_segments,
    run_rows,
)
from ..operators.ids import highest
from ..operators.manifest import apply_diff, diff_manifest, listed_files, scan_errors, scan_summary
from ..session import spread, stored
from ..sources.buckets import BucketStore
from ..sources.files import MAX_TEXT_BYTES, read_bytes, read_named
from ..sources.text import can_import, number_segments, parse_text
from ..sources.walk import Lister, list_entries, walk

PARSER = "text-parser-1"
SOURCE = "file"


@dataclass(frozen=True)
class ScanResult:
    assets: DataFrame
    diff: DataFrame
    summary: DataFrame
    errors: DataFrame


def scan_folders(assets: DataFrame, roots: DataFrame, now_ms: int, list_one: Lister = list_entries) -> ScanResult:
    """Walk ``roots(directory_id, path)`` and bring the asset table up to date with them.

    A root that cannot be listed is not completed and loses nothing; neither do
    subdirectories that cannot. Every error is a row of the listing.
    """
    seen = walk(roots, list_one)
    return apply_scan(assets, seen.listing, seen.scans, now_ms, seen.unread)


def scan_folder(
    spark: SparkSession, assets: DataFrame, directory_id: int, root: str, now_ms: int
) -> ScanResult:
    """The same for one folder."""
    return scan_folders(assets, spark.createDataFrame([(directory_id, root)], "directory_id long, path string"), now_ms)


def apply_scan(
    assets: DataFrame, listing: DataFrame, scans: DataFrame, now_ms: int, unread: DataFrame | None = None
) -> ScanResult:
    """The same for a listing of many directories, however it was made."""
    files = listed_files(listing)
    previous = assets.select("asset_id", "directory_id", "path_key", "path", "fingerprint")
    diff = stored(diff_manifest(previous, files, scans, unread), "diff")
    return ScanResult(apply_diff(assets, diff, now_ms), diff, scan_summary(listing, files, diff), scan_errors(listing))


@dataclass(frozen=True)
class ImportResult:
    """Everything one import leaves behind; ``outcomes`` has a row per asset tried, ``fresh`` are the
    segments read now."""

    outcomes: DataFrame
    fresh: DataFrame
    segments: DataFrame
    runs: DataFrame
    run_sources: DataFrame
    assets: DataFrame
    reused: DataFrame


def import_texts(
    assets: DataFrame,
    contents: DataFrame | None,
    segments: DataFrame,
    runs: DataFrame,
    now_ms: int,
    script: str = "simplified",
    script_table: dict[str, str] | None = None,
    read_one: Callable[[str], bytes] = read_bytes,
) -> ImportResult:
    """Import the text of all assets that need it.

    Every file is parsed once: what that gives is written to the shared folder,
    and all results are read from there.
    Without ``contents`` the files are read where the assets say they lie: those
    that need it and no others. ``contents(asset_id, content)`` gives decoded
    files instead; an asset without a row there could not be read. Over-large and unreadable assets fail with a
    reason and keep their old segments; the others are replaced. The label
    names the parser and the script, so a changed preference misses the cache.
    """
    label = label_text(PARSER, script)
    importable = assets.where(can_import(F.col("ext")))
    work = extraction_worklist(importable, runs, label).select(
        "asset_id", "path", "ext", "size_bytes", "fingerprint"
    )
    items = parse_text(F.col("content"), F.col("ext"))
    too_large = F.col("size_bytes") > MAX_TEXT_BYTES
    megabytes = F.round(F.col("size_bytes") / (1024 * 1024)).cast("long").cast("string")
    unreadable = F.lit("text file could not be read")
    if contents is None:
        # files are read where the worklist stands; their bodies are never shuffled
        small = read_named(spread(work.where(~too_large), "asset_id"), read_one)
        large = work.where(too_large).select("*", *[F.lit(None).cast("string").alias(c) for c in ("content", "read_error")])
        opened = small.unionByName(large)
        unreadable = F.concat(unreadable, F.lit(": "), F.col("read_error"))
    else:
        opened = work.join(contents, "asset_id", "left")
    tried = opened.select(
        "asset_id",
        "fingerprint",
        F.when(~too_large & F.col("content").isNotNull(), items).alias("items"),
        F.when(too_large | F.col("content").isNull(), F.lit(EXTRACTION_FAILED)).alias("error_code"),
        F.when(too_large, F.concat(F.lit("text file too large: "), megabytes, F.lit(" MB")))
        .when(F.col("content").isNull(), unreadable)
        .alias("error_message"),
    )
    tried = stored(tried, "parsed-files")
    outcomes = tried.select(
        "asset_id",
        "fingerprint",
        F.coalesce(F.size("items"), F.lit(0)).alias("segment_count"),
        F.lit(None).cast("string").alias("skipped_reason"),
        "error_code",
        "error_message",
    )
    done = tried.where(F.col("error_code").isNull())
    fresh = number_segments(done, F.col("items"), SOURCE)
    if script_table:
        fresh = fresh.withColumn("text", convert_script(F.col("text"), script_table))
    run_table, source_table = run_rows(outcomes, label, SOURCE, now_ms, highest(runs, "run_id"))
    return ImportResult(
        outcomes=outcomes,
        fresh=fresh,
        segments=replace_segments(segments, fresh, done),
        runs=run_table,
        run_sources=source_table,
        assets=apply_outcomes(assets, outcomes, now_ms),
        reused=cached_runs(importable, runs, label),
    )


def store_import(done: ImportResult, segments: BucketStore) -> None:
    """Put the segments an import has read into their store; only the folders they fall into change."""
    read = done.outcomes.where(F.col("error_code").isNull())
    segments.replace(done.fresh, read.select("asset_id"))
