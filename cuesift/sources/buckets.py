"""A table kept in folders by a hash of its key, replaced folder by folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, fits_broadcast, stored


class BucketStore:
    """Rows by key in plain Parquet folders ``bucket=n``.

    All rows of a key lie in one folder, so replacing some keys rewrites the
    folders they fall into and reads no other; Spark exchanges these folders
    when the write is complete. Doing the same replacement again gives the same
    table. Every folder written holds one row without a key, which readers
    leave out: a folder whose keys are all gone is replaced like any other.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, buckets: int = 256):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path, schema, key, buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, held: list[int]) -> None:
        columns = [c.split()[0] for c in self.schema.split(", ")]
        markers = self.spark.createDataFrame([(n,) for n in held], "bucket int")
        rows = rows.select(*columns, self._bucket().alias("bucket"))
        (
            rows.hint("rebalance", F.col("bucket"))
            .unionByName(markers, allowMissingColumns=True)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("bucket")
            .parquet(self.path)
        )

    def build(self, rows: DataFrame) -> None:
        self._write(rows, list(range(self.buckets)))

    def _stored(self) -> DataFrame:
        rows = self.spark.read.schema(f"{self.schema}, bucket int").parquet(self.path)
        return rows.where(F.col(self.key).isNotNull())

    def read(self) -> DataFrame:
        return self._stored().drop("bucket")

    def of(self, keys: DataFrame) -> DataFrame:
        """The rows of ``keys``, from their folders only."""
        keys = cut_lineage(keys.select(self.key).distinct())
        return self._joined(self._held(keys), keys, "left_semi").drop("bucket")

    def _held(self, keys: DataFrame) -> list[int]:
        """The folders of some keys, at most one number for each folder there is."""
        return sorted(r[0] for r in keys.select(self._bucket().alias("b")).distinct().collect())

    def _joined(self, held: list[int], keys: DataFrame, how: str) -> DataFrame:
        rows = self._stored().where(F.col("bucket").isin(held))
        return rows.join(F.broadcast(keys) if fits_broadcast(keys) else keys, self.key, how)

    def kept(self, touched: DataFrame) -> DataFrame:
        """In the folders of ``touched``, the rows of the other keys."""
        return self._joined(self._held(touched), touched, "left_anti").drop("bucket")

    def replace(self, rows: DataFrame, touched: DataFrame) -> None:
        """Replace every row of the keys in ``touched`` by ``rows``; a key without rows is emptied.

        Rows of other keys in ``rows`` replace theirs too.
        """
        rows = stored(rows, "replacing")
        keys = touched.select(self.key).unionByName(rows.select(self.key)).where(F.col(self.key).isNotNull())
        touched = cut_lineage(keys.distinct())
        fresh = self.kept(touched).unionByName(rows, allowMissingColumns=True)
        held = self._held(touched)
        if held:
            self._write(fresh, held)
