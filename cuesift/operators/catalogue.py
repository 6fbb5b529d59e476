"""Listing, detail and maintenance of the catalogue tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import file_name, path_key
from ..functions.text import contains_literal, trim_space
from ..session import salted_join
from .ids import IdSet
from .recall import filter_assets

# Page sizes of the listings where none is asked for.
ASSET_PAGE = 50
SEGMENT_PAGE = 200

DIRECTORY_DUPLICATE = "DIRECTORY_DUPLICATE"
DIRECTORY_NOT_FOUND = "DIRECTORY_NOT_FOUND"

SUMMARY = [
    "asset_id",
    "directory_id",
    "path",
    "file_name",
    "ext",
    "kind",
    "size_bytes",
    "mtime_ms",
    "extract_status",
    "updated_at",
]


def page_size(value: int | None, default: int) -> int:
    """Rows asked for, at least one; a larger page is given as asked."""
    return max(default if value is None else value, 1)


def tags_by_asset(asset_tags: DataFrame, tags: DataFrame) -> DataFrame:
    """``asset_id, tags`` with the tags of each asset ordered by name."""
    named = salted_join(
        asset_tags.select("asset_id", "tag_id"),
        tags.select("tag_id", "name", "color"),
        ["tag_id"],
        "inner",
        F.col("asset_id"),
    )
    return named.groupBy("asset_id").agg(
        F.array_sort(F.collect_list(F.struct("name", "tag_id", "color"))).alias("tags")
    )


def _with_tags(rows: DataFrame, tags: DataFrame, asset_tags: DataFrame) -> DataFrame:
    links = asset_tags.join(rows.select("asset_id"), "asset_id", "left_semi")
    grouped = tags_by_asset(links, tags)
    nothing = F.array().cast("array<struct<name:string,tag_id:bigint,color:string>>")
    return rows.join(grouped, "asset_id", "left").withColumn(
        "tags", F.coalesce("tags", nothing)
    )


def asset_summaries(
    assets: DataFrame, tags: DataFrame, asset_tags: DataFrame, ids: DataFrame
) -> DataFrame:
    """Summaries with tags for ``ids(asset_id)``; ids without an asset are skipped."""
    present = [c for c in SUMMARY if c in assets.columns]
    rows = assets.select(*present).join(ids, "asset_id", "left_semi")
    return _with_tags(rows, tags, asset_tags)


def find_assets(
    assets: DataFrame,
    kind: str | None = None,
    extract_status: str | None = None,
    directory_id: int | None = None,
    name_contains: str | None = None,
) -> DataFrame:
    """Assets that pass every given condition; its count is the listing's total."""
    found = filter_assets(assets, kind, extract_status, directory_id)
    if name_contains:
        found = found.where(contains_literal(F.col("file_name"), name_contains))
    return found


def list_assets(
    found: DataFrame,
    limit: int | None = None,
    offset: int | None = None,
    after: tuple[str, int] | None = None,
) -> DataFrame:
    """A page of assets by name, then id.

    ``after`` is the name and id of the last asset seen. It goes into the scan
    as a condition, so a page far down costs what the first one costs; an
    offset has to pass over everything before it.
    """
    present = [c for c in SUMMARY if c in found.columns]
    if after is not None:
        name, last = after
        same = (F.col("file_name") == name) & (F.col("asset_id") > last)
        found = found.where((F.col("file_name") >= name) & ((F.col("file_name") > name) | same))
    return (
        found.select(*present)
        .orderBy("file_name", "asset_id")
        .offset(max(offset or 0, 0))
        .limit(page_size(limit, ASSET_PAGE))
    )


def list_assets_with_tags(
    found: DataFrame,
    tags: DataFrame,
    asset_tags: DataFrame,
    limit: int | None = None,
    offset: int | None = None,
    after: tuple[str, int] | None = None,
) -> DataFrame:
    """The page of ``list_assets`` with the tags of its assets only."""
    page = _with_tags(list_assets(found, limit, offset, after), tags, asset_tags)
    return page.orderBy("file_name", "asset_id")


def asset_details(
    assets: DataFrame, segments: DataFrame, tags: DataFrame, asset_tags: DataFrame
) -> DataFrame:
    """Every asset with its tags and its number of segments."""
    counted = segments.groupBy("asset_id").agg(F.count(F.lit(1)).alias("segment_count"))
    rows = assets.join(counted, "asset_id", "left").withColumn(
        "segment_count", F.coalesce("segment_count", F.lit(0))
    )
    return _with_tags(rows, tags, asset_tags)


def list_segments(
    segments: DataFrame,
    asset_id: int,
    limit: int | None = None,
    offset: int | None = None,
    after: int | None = None,
) -> DataFrame:
    """A page of one asset's segments in reading order, ``after`` the last ordinal seen."""
    own = segments.where(F.col("asset_id") == asset_id)
    if after is not None:
        own = own.where(F.col("ordinal") > after)
    return (
        own.orderBy("ordinal")
        .offset(max(offset or 0, 0))
        .limit(page_size(limit, SEGMENT_PAGE))
    )


def segment_counts(segments: DataFrame) -> DataFrame:
    return segments.groupBy("asset_id").agg(F.count(F.lit(1)).alias("segment_count"))


def list_jobs(
    jobs: DataFrame,
    job_type: str | None = None,
    target_id: int | None = None,
    active_only: bool = False,
) -> DataFrame:
    """Jobs that pass the conditions, newest first."""
    if job_type is not None:
        jobs = jobs.where(F.col("type") == job_type)
    if target_id is not None:
        jobs = jobs.where(F.col("target_id") == target_id)
    if active_only:
        jobs = jobs.where(F.col("status").isin("queued", "running"))
    return jobs.orderBy(F.desc("job_id"))


def list_directories(directories: DataFrame) -> DataFrame:
    return directories.orderBy("created_at", "directory_id")


def register_directories(
    existing: DataFrame, requests: DataFrame, case_insensitive: bool = False
) -> DataFrame:
    """``requests(request_id, path, label)`` with their outcome.

    The first request of each path key that is not registered yet is accepted;
    the others carry a reason. The first request per key is found by a
    combinable minimum, so one path asked for over and over costs nothing extra.
    """
    keyed = requests.withColumn("path_key", path_key(F.col("path"), case_insensitive))
    first = keyed.groupBy("path_key").agg(F.min("request_id").alias("__first"))
    known = existing.select("path_key", F.lit(True).alias("__known"))
    verdict = first.join(known, "path_key", "left")
    judged = salted_join(keyed, verdict, ["path_key"], "left", F.col("request_id"))
    label = trim_space(F.coalesce(F.col("label"), F.lit("")))
    name = file_name(F.col("path"))
    reason = F.when(F.col("path_key") == "", F.lit(DIRECTORY_NOT_FOUND)).when(
        F.coalesce("__known", F.lit(False)) | (F.col("__first") != F.col("request_id")),
        F.lit(DIRECTORY_DUPLICATE),
    )
    return judged.select(
        "request_id",
        "path",
        "path_key",
        F.when(label != "", label).when(name != "", name).otherwise(F.col("path")).alias("label"),
        reason.alias("error_code"),
    )


def mark_scanned(directories: DataFrame, scans: DataFrame) -> DataFrame:
    """Directories with the time of their latest scan ``(directory_id, scanned_at)``."""
    latest = scans.groupBy("directory_id").agg(F.max("scanned_at").alias("__at"))
    return (
        directories.join(latest, "directory_id", "left")
        .withColumn("last_scanned_at", F.coalesce("__at", "last_scanned_at"))
        .drop("__at")
    )


@dataclass(frozen=True)
class Remaining:
    """What is left after directories are removed, and how much went."""

    directories: DataFrame
    assets: DataFrame
    children: dict[str, DataFrame]
    removed: DataFrame


def remove_directories(
    directories: DataFrame, assets: DataFrame, children: dict[str, DataFrame], ids: DataFrame
) -> Remaining:
    """Drop directories ``ids(directory_id)`` with their assets and child rows.

    ``children`` are tables with an ``asset_id``. The removed assets are a set of
    bitmaps that every child table is tested against where it is read, so no
    child row is shuffled; see ``IdSet`` for sets too wide for that.
    """
    gone = assets.join(ids, "directory_id", "left_semi").select("asset_id", "directory_id")
    counted = gone.groupBy("directory_id").agg(F.count(F.lit(1)).alias("removed_assets"))
    removed = ids.join(counted, "directory_id", "left").select(
        "directory_id", F.coalesce("removed_assets", F.lit(0)).alias("removed_assets")
    )
    removed_assets = IdSet(gone, "asset_id")
    kept = {name: removed_assets.absent_from(table) for name, table in children.items()}
    return Remaining(
        directories.join(ids, "directory_id", "left_anti"),
        assets.join(ids, "directory_id", "left_anti"),
        kept,
        removed,
    )


def detach_runs(segments: DataFrame, removed_runs: DataFrame) -> DataFrame:
    """Segments whose run was removed keep their text and lose the reference."""
    marked = removed_runs.select("run_id", F.lit(True).alias("__gone"))
    joined = salted_join(segments, marked, ["run_id"], "left", F.col("segment_id"))
    return joined.withColumn(
        "run_id", F.when(F.col("__gone").isNull(), F.col("run_id"))
    ).drop("__gone")
