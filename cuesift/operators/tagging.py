"""The tag dictionary and the links between assets and tags.

Requests come as a table and are judged as if they had arrived one after the
other in ``request_id`` order. "First of its kind" is a combinable minimum per
key, joined back in salted shares, so a tag asked for on a third of all assets
is neither collected nor sorted in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tagnames import TAG_INVALID, tag_display, tag_key
from ..session import salted_join

ASSET_NOT_FOUND = "ASSET_NOT_FOUND"


def tag_id_of(key: Column) -> Column:
    """Id of a tag created now; the same on every retry."""
    return F.xxhash64(key)


def tag_dictionary(names: DataFrame) -> DataFrame:
    """``name_key, name, color, created_at`` for ``names(request_id, name, color, created_at)``.

    The first spelling and colour of each key win.
    """
    shown = names.withColumn("name", tag_display(F.col("name"))).where(F.col("name").isNotNull())
    first = F.min(F.struct("request_id", "name", "color", "created_at"))
    return (
        shown.withColumn("name_key", tag_key(F.col("name")))
        .groupBy("name_key")
        .agg(first.alias("f"))
        .select("name_key", "f.name", "f.color", "f.created_at")
    )


@dataclass(frozen=True)
class LinkOutcome:
    """Verdict per request, and the rows to add to the two tables."""

    requests: DataFrame
    new_tags: DataFrame
    new_links: DataFrame


def link_tags(
    assets: DataFrame, tags: DataFrame, asset_tags: DataFrame, requests: DataFrame
) -> LinkOutcome:
    """Find or create tags and link them to assets.

    ``requests(request_id, asset_id, name, color, source, created_at)``. An
    existing tag keeps its name and colour; a request for a missing asset
    creates nothing; a repeated link is no error.
    """
    known_assets = assets.select("asset_id", F.lit(True).alias("__asset"))
    shown = requests.withColumn("display", tag_display(F.col("name")))
    judged = (
        salted_join(shown, known_assets, ["asset_id"], "left", F.col("request_id"))
        .withColumn(
            "error_code",
            F.when(F.col("display").isNull(), F.lit(TAG_INVALID)).when(
                F.col("__asset").isNull(), F.lit(ASSET_NOT_FOUND)
            ),
        )
        .drop("__asset")
    )
    keyed = judged.withColumn(
        "name_key", F.when(F.col("error_code").isNull(), tag_key(F.col("display")))
    )
    valid = keyed.where(F.col("error_code").isNull())

    first = valid.groupBy("name_key").agg(
        F.min(F.struct("request_id", "display", "color", "created_at")).alias("f")
    )
    resolved = first.join(
        tags.select("name_key", "tag_id", "name", F.col("color").alias("__color")),
        "name_key",
        "left",
    )
    per_key = resolved.select(
        "name_key",
        F.coalesce("tag_id", tag_id_of(F.col("name_key"))).alias("tag_id"),
        F.coalesce("name", "f.display").alias("tag_name"),
        F.when(F.col("tag_id").isNull(), F.col("f.request_id")).alias("__created_by"),
    )
    new_tags = resolved.where(F.col("tag_id").isNull()).select(
        tag_id_of(F.col("name_key")).alias("tag_id"),
        F.col("f.display").alias("name"),
        "name_key",
        F.col("f.color").alias("color"),
        F.col("f.created_at").alias("created_at"),
    )

    named = salted_join(keyed, per_key, ["name_key"], "left", F.col("request_id"))
    link = ["asset_id", "tag_id"]
    first_link = (
        named.where(F.col("error_code").isNull())
        .groupBy(*link)
        .agg(F.min(F.struct("request_id", "source", "created_at")).alias("f"))
        .join(asset_tags.select(*link, F.lit(True).alias("__linked")), link, "left")
    )
    verdicts = salted_join(
        named,
        first_link.select(*link, F.col("f.request_id").alias("__first"), "__linked"),
        link,
        "left",
        F.col("request_id"),
    )
    already = F.col("__linked").isNotNull() | (F.col("__first") != F.col("request_id"))
    outcome = verdicts.select(
        "request_id",
        "asset_id",
        F.col("name").alias("raw_name"),
        "display",
        "tag_id",
        "tag_name",
        "error_code",
        F.when(F.col("error_code").isNull(), already).alias("already_linked"),
        F.when(
            F.col("error_code").isNull(),
            F.coalesce(F.col("__created_by") == F.col("request_id"), F.lit(False)),
        ).alias("tag_created"),
    )
    new_links = first_link.where(F.col("__linked").isNull()).select(
        *link, F.col("f.source").alias("source"), F.col("f.created_at").alias("created_at")
    )
    return LinkOutcome(outcome, new_tags, new_links)


def archive_keywords(
    assets: DataFrame, tags: DataFrame, asset_tags: DataFrame, requests: DataFrame
) -> LinkOutcome:
    """Link a batch of words per asset: ``requests(request_id, asset_id, name, created_at)``.

    Repeats of a display name within an asset's batch are ignored; every other
    word lands in one bucket: linked, already or invalid. An unknown asset is
    an error of its own.
    """
    shown = requests.withColumn("__shown", tag_display(F.col("name")))
    repeats = shown.where(F.col("__shown").isNotNull()).groupBy("asset_id", "__shown").agg(
        F.min("request_id").alias("request_id")
    )
    batch = (
        shown.where(F.col("__shown").isNull())
        .select("request_id")
        .unionByName(repeats.select("request_id"))
    )
    kept = requests.join(batch, "request_id", "left_semi")
    outcome = link_tags(
        assets,
        tags,
        asset_tags,
        kept.withColumn("color", F.lit(None).cast("string")).withColumn("source", F.lit("extracted")),
    )
    bucket = (
        F.when(F.col("error_code") == ASSET_NOT_FOUND, F.lit("missing"))
        .when(F.col("error_code").isNotNull(), F.lit("invalid"))
        .when(F.col("already_linked"), F.lit("already"))
        .otherwise(F.lit("linked"))
    )
    return LinkOutcome(
        outcome.requests.withColumn("bucket", bucket), outcome.new_tags, outcome.new_links
    )


def unlink_tags(asset_tags: DataFrame, removals: DataFrame) -> DataFrame:
    """Links left after ``removals(asset_id, tag_id)``; absent links do not matter."""
    return asset_tags.join(removals, ["asset_id", "tag_id"], "left_anti")


def tag_usage(tags: DataFrame, asset_tags: DataFrame) -> DataFrame:
    """Every tag with its number of assets; zero is kept."""
    used = asset_tags.groupBy("tag_id").agg(F.count("asset_id").alias("usage_count"))
    return (
        tags.join(used, "tag_id", "left")
        .withColumn("usage_count", F.coalesce("usage_count", F.lit(0)))
        .orderBy("name")
    )


def orphan_tags(tags: DataFrame, asset_tags: DataFrame) -> DataFrame:
    """Tags no asset carries."""
    return tags.join(asset_tags.select("tag_id").distinct(), "tag_id", "left_anti")


def prune_orphan_tags(tags: DataFrame, asset_tags: DataFrame) -> DataFrame:
    """The tag table without its orphans."""
    return tags.join(asset_tags.select("tag_id").distinct(), "tag_id", "left_semi")
