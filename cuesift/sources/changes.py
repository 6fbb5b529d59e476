"""Tables kept as plain Parquet folders of changes.

Every write adds one folder ``stamp=n`` with the new rows of the keys it
touches and a mark for each of these keys. Readers take, for each key, the rows
of its newest mark. So a write costs what it brings, however large the table,
and writing a stamp again replaces that stamp alone.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import salted_join


def write_stamp(rows: DataFrame, path: str, stamp: int) -> None:
    """Add ``rows`` as the folder of ``stamp``, or replace what it held."""
    (
        rows.withColumn("stamp", F.lit(stamp).cast("long"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("stamp")
        .parquet(path)
    )


def read_stamps(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All rows written so far with their ``stamp``; none where nothing was written."""
    try:
        return spark.read.schema(f"{schema}, stamp long").parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{schema}, stamp long")


class ChangeTable:
    """Rows that are replaced by key. Stamps of later writes must be larger."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str):
        self.spark, self.path, self.schema, self.key = spark, path.rstrip("/"), schema, key

    def replace(self, rows: DataFrame, touched: DataFrame, stamp: int) -> None:
        """Replace every row of the keys in ``touched`` by ``rows``.

        A key that has no new row is emptied.
        """
        marks = touched.select(self.key).distinct().withColumn("is_mark", F.lit(True))
        fresh = rows.withColumn("is_mark", F.lit(False))
        write_stamp(fresh.unionByName(marks, allowMissingColumns=True), self.path, stamp)

    def read(self) -> DataFrame:
        written = read_stamps(self.spark, self.path, f"{self.schema}, is_mark boolean")
        newest = written.where("is_mark").groupBy(self.key).agg(F.max("stamp").alias("stamp"))
        rows = written.where(~F.col("is_mark")).drop("is_mark")
        others = [c for c in rows.columns if c not in (self.key, "stamp")]
        return salted_join(rows, newest, [self.key, "stamp"], "inner", F.struct(*others)).select(
            *[c for c in rows.columns if c != "stamp"]
        )

    def compacted(self, path: str, stamp: int) -> ChangeTable:
        """The current rows as one stamp of a new table."""
        out = ChangeTable(self.spark, path, self.schema, self.key)
        rows = self.read()
        out.replace(rows, rows, stamp)
        return out
