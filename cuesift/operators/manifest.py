"""Comparing file listings between scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import extension, file_kind, file_name, fingerprint, path_key
from .ids import highest, number_rows

NEW, CHANGED, UNCHANGED, REMOVED, KEPT = "new", "changed", "unchanged", "removed", "kept"


def listed_files(listing: DataFrame, case_insensitive: bool = False) -> DataFrame:
    """Readable rows of ``listing(directory_id, path, size_bytes, mtime_ms[, error])``."""
    if "error" in listing.columns:
        listing = listing.where(F.col("error").isNull())
    path = F.col("path")
    return listing.select(
        "directory_id",
        "path",
        path_key(path, case_insensitive).alias("path_key"),
        file_name(path).alias("file_name"),
        extension(path).alias("ext"),
        file_kind(extension(path)).alias("kind"),
        "size_bytes",
        F.floor("mtime_ms").cast("long").alias("mtime_ms"),
        fingerprint(F.col("size_bytes"), F.col("mtime_ms")).alias("fingerprint"),
    )


def _below(missing: DataFrame, unread: DataFrame) -> DataFrame:
    """``asset_id`` of the files under a directory that could not be listed.

    Each file names the directories above it, so this is a join by equality.
    """
    parts = F.split("old_path", "/")
    depths = F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1)))
    above = F.transform(depths, lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    rows = missing.select("asset_id", "directory_id", F.explode(above).alias("path"))
    return rows.join(unread, ["directory_id", "path"], "left_semi").select("asset_id").distinct()


def diff_manifest(
    previous: DataFrame, files: DataFrame, scans: DataFrame, unread: DataFrame | None = None
) -> DataFrame:
    """Classify every file of the scanned directories by one full join.

    ``previous(asset_id, directory_id, path_key, path, fingerprint)`` is the
    catalogue, ``files`` comes from ``listed_files``, and
    ``scans(directory_id, completed)`` lists the directories walked. A file that
    was not seen is removed only if its directory was walked to the end, and
    kept if it lies below one of the ``unread(directory_id, path)`` directories.
    New files have no id yet; ``apply_diff`` gives them one.
    """
    supported = files.where(F.col("kind").isNotNull())
    before = previous.join(scans, "directory_id").select(
        "directory_id",
        "path_key",
        "asset_id",
        "completed",
        F.col("path").alias("old_path"),
        F.col("fingerprint").alias("old_fingerprint"),
    )
    both = before.join(supported, ["directory_id", "path_key"], "full_outer")
    if unread is not None:
        spared = _below(both.where(F.col("fingerprint").isNull()), unread).withColumn("__spared", F.lit(True))
        both = both.join(spared, "asset_id", "left").withColumn(
            "completed", F.col("completed") & F.col("__spared").isNull()
        )
    change = (
        F.when(F.col("asset_id").isNull(), F.lit(NEW))
        .when(F.col("fingerprint").isNull() & F.col("completed"), F.lit(REMOVED))
        .when(F.col("fingerprint").isNull(), F.lit(KEPT))
        .when(F.col("fingerprint") == F.col("old_fingerprint"), F.lit(UNCHANGED))
        .otherwise(F.lit(CHANGED))
    )
    return both.select(
        "directory_id",
        "path_key",
        "asset_id",
        F.coalesce("path", "old_path").alias("path"),
        "file_name",
        "ext",
        "kind",
        "size_bytes",
        "mtime_ms",
        "fingerprint",
        change.alias("change_type"),
    )


def apply_diff(assets: DataFrame, diff: DataFrame, now_ms: int) -> DataFrame:
    """The next asset table: ids survive, unscanned directories are untouched.

    New files are numbered after the highest id in use.
    """
    columns = assets.columns
    removed = diff.where(F.col("change_type") == REMOVED).select("asset_id")
    changed = diff.where(F.col("change_type") == CHANGED)
    facts = ["path", "file_name", "ext", "kind", "size_bytes", "mtime_ms", "fingerprint"]
    updates = changed.select(
        "asset_id", *[F.col(c).alias(f"__{c}") for c in facts], F.lit(True).alias("__changed")
    )
    old = assets.join(removed, "asset_id", "left_anti").join(updates, "asset_id", "left")
    refreshed = {c: F.when(F.col("__changed"), F.col(f"__{c}")).otherwise(F.col(c)) for c in facts}
    stamp = F.when(F.col("__changed"), F.lit(now_ms)).otherwise(F.col("updated_at"))
    kept = old.select(
        *[
            refreshed[c].alias(c) if c in facts else stamp.alias(c) if c == "updated_at" else F.col(c)
            for c in columns
        ]
    )
    defaults = {
        "extract_status": F.lit("none"),
        "created_at": F.lit(now_ms),
        "updated_at": F.lit(now_ms),
    }
    fresh = number_rows(
        diff.where(F.col("change_type") == NEW).drop("asset_id"),
        ["directory_id", "path_key"],
        "asset_id",
        highest(assets, "asset_id"),
    )
    added = fresh.select(
        *[
            F.col(c)
            if c in fresh.columns
            else defaults.get(c, F.lit(None)).cast(assets.schema[c].dataType).alias(c)
            for c in columns
        ]
    )
    return kept.unionByName(added)


def scan_summary(listing: DataFrame, files: DataFrame, diff: DataFrame) -> DataFrame:
    """Counters of each scanned directory."""
    errors = (
        listing.where(F.col("error").isNotNull())
        if "error" in listing.columns
        else listing.where(F.lit(False))
    )
    events = (
        diff.select("directory_id", F.col("change_type").alias("event"))
        .unionByName(files.where(F.col("kind").isNull()).select("directory_id", F.lit("skipped").alias("event")))
        .unionByName(errors.select("directory_id", F.lit("error").alias("event")))
    )

    def times(*names: str):
        return F.sum(F.col("event").isin(*names).cast("long"))

    return events.groupBy("directory_id").agg(
        times(NEW, CHANGED, UNCHANGED, "skipped", "error").alias("visited"),
        times(NEW).alias("indexed"),
        times(CHANGED).alias("updated"),
        times(UNCHANGED).alias("unchanged"),
        times("skipped").alias("skipped_unsupported"),
        times(REMOVED).alias("removed"),
    )


def scan_errors(listing: DataFrame, per_directory: int | None = None) -> DataFrame:
    """The unreadable paths of a scan; for a short report the first ones of each directory.

    Spark keeps the first rows of a directory before it shuffles them.
    """
    bad = listing.where(F.col("error").isNotNull()).select("directory_id", "path", "error")
    if per_directory is None:
        return bad
    order = Window.partitionBy("directory_id").orderBy("path")
    return bad.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_directory).drop("n")
