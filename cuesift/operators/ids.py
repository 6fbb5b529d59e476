"""Dense ids for new rows, without passing them through one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, fits_broadcast

ID_BUCKETS = 1024

# Bitmaps of 4 KB, for 32,768 ids each, that may be sent to every executor: 32 MB.
BITMAPS = 8192


def number_rows(rows: DataFrame, key: list[str], name: str, after: Column, buckets: int = ID_BUCKETS) -> DataFrame:
    """Add ``name``: consecutive numbers following ``after``; ``key`` is unique.

    Rows are numbered within hash buckets of the key, and each bucket starts
    where the ones before it end, so the numbers do not depend on how often a
    task is retried. Unique keys fill the buckets evenly.
    """
    bucket = F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")
    placed = rows.withColumn("__bucket", bucket)
    sizes = placed.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__size"))
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    # one row per bucket, so the window and the broadcast are bounded
    starts = sizes.select(
        "__bucket", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__start")
    )
    within = F.row_number().over(Window.partitionBy("__bucket").orderBy(*key))
    return (
        placed.withColumn("__n", within)
        .join(F.broadcast(starts), "__bucket")
        .withColumn(name, (after + F.col("__start") + F.col("__n")).cast("long"))
        .drop("__bucket", "__n", "__start")
    )


def highest(table: DataFrame, column: str) -> Column:
    """The largest id in use, zero for an empty table, as a scalar subquery."""
    return table.agg(F.coalesce(F.max(column), F.lit(0)).alias("highest")).scalar()


def id_bitmaps(ids: DataFrame, column: str) -> DataFrame:
    """``bucket, bits``: the ids as bitmaps, one row for each range of 32,768 that holds any."""
    bucket, place = F.bitmap_bucket_number(column), F.bitmap_bit_position(column)
    rows = ids.where(F.col(column).isNotNull()).select(bucket.alias("bucket"), place.alias("place"))
    return rows.groupBy("bucket").agg(F.bitmap_construct_agg("place").alias("bits"))


class IdSet:
    """Ids to be left out of many tables: a bit test at each scan instead of a join of the ids.

    The bitmaps are made once. Where their ranges are too many to be sent to
    every executor, the ids are joined instead.
    """

    def __init__(self, ids: DataFrame, column: str):
        self.column = column
        self.ids = cut_lineage(ids.select(column).distinct())
        bitmaps = cut_lineage(id_bitmaps(self.ids, column))
        self.bitmaps = bitmaps if fits_broadcast(bitmaps, BITMAPS) else None

    def absent_from(self, rows: DataFrame) -> DataFrame:
        """The rows whose id is not in the set; rows without an id stay."""
        if self.bitmaps is None:
            return rows.join(self.ids, self.column, "left_anti")
        met, held = self._met(rows, "left")
        return met.where(~F.coalesce(held, F.lit(False))).drop("__bucket", "__bits")

    def present_in(self, rows: DataFrame) -> DataFrame:
        """The rows whose id is in the set."""
        if self.bitmaps is None:
            return rows.join(self.ids, self.column, "left_semi")
        met, held = self._met(rows, "inner")
        return met.where(held).drop("__bucket", "__bits")

    def _met(self, rows: DataFrame, how: str) -> tuple[DataFrame, Column]:
        bits = self.bitmaps.select(F.col("bucket").alias("__bucket"), F.col("bits").alias("__bits"))
        met = rows.join(F.broadcast(bits), F.bitmap_bucket_number(self.column) == F.col("__bucket"), how)
        place = F.bitmap_bit_position(self.column)
        byte = F.conv(F.hex(F.substring(F.col("__bits"), (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10)
        return met, F.getbit(byte.cast("long"), F.pmod(place, F.lit(8)).cast("int")) == 1
