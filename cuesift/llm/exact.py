"""Exact duplicates: rows grouped by a 128-bit hash, bytes compared inside groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored

# White space that does not count: 0x20 and 0x09-0x0D.
SPACES = (" ", "\t", "\n", "\x0b", "\x0c", "\r")


def without_spaces(text: Column) -> Column:
    """``text`` less its ASCII white space; null is empty."""
    bare = F.coalesce(text, F.lit(""))
    for space in SPACES:
        bare = F.replace(bare, F.lit(space), F.lit(""))
    return bare


def exact_groups(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    digest: Column | None = None,
) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts that agree after deleting white space form a group; the row with most
    code points in its original text stays, then the smallest id. ``digest`` is
    the 128-bit hash of ``__bare``, md5 unless given.

    The texts are grouped by hash *and* text: rows meet by hash, and two texts
    under one hash are told apart by comparing their bytes. Copies are combined
    before the shuffle, so one text in a third of all rows costs each task one
    row. Members then find their group by hash and SHA-256 without their text;
    two texts that agree in both would stop the job instead of being merged.

    Null text counts as empty, all empty texts are one group. A null id sorts
    first among equals. Repeated rows keep one result row each, ``kept`` for all
    rows that carry the id that stays. An empty table gives no rows. Only the
    two named columns are read, other columns may have any name.
    """
    bare = without_spaces(F.col(text_column))
    rows = docs.select(
        F.col(id_column).alias("doc_id"),
        F.char_length(F.coalesce(F.col(text_column), F.lit(""))).cast("long").alias("__size"),
        bare.alias("__bare"),
    ).withColumn("__hash", F.unhex(F.md5("__bare")) if digest is None else digest)
    texts = rows.groupBy("__hash", "__bare").agg(
        F.count(F.lit(1)).alias("group_size"),
        F.min(F.struct((-F.col("__size")).alias("less"), "doc_id")).alias("__first"),
    )
    groups = (
        texts.withColumn("__sha", F.unhex(F.sha2("__bare", 256)))
        .groupBy("__hash", "__sha")
        .agg(
            F.max("group_size").alias("group_size"),
            F.min("__first").alias("__first"),
            F.count(F.lit(1)).alias("__texts"),
        )
        .select(
            "__hash",
            "__sha",
            "group_size",
            F.when(F.col("__texts") == 1, F.col("__first.doc_id"))
            .otherwise(F.raise_error(F.lit("two different texts share both digests")).cast("long"))
            .alias("keep_id"),
        )
    )
    # written, so that both sides of the join are dealt out anew and Spark can split a hot group
    groups = stored(groups, "exact-groups")
    members = rows.select("doc_id", "__hash", F.unhex(F.sha2("__bare", 256)).alias("__sha"))
    return members.join(groups, ["__hash", "__sha"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("__sha")).alias("text_sha256"),
    )
