"""New text files become segments as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.decode import decode_text
from ..functions.paths import extension
from ..session import allow_text_decoding
from ..sources.changes import ChangeTable, read_stamps, write_stamp
from ..sources.files import BINARY_SCHEMA, FILE_TOO_LARGE, plain_path
from ..sources.text import can_import, segment_texts

ASSET_NOT_FOUND = "ASSET_NOT_FOUND"
UNSUPPORTED = "UNSUPPORTED_FORMAT"
FAILURES = "path string, error string"


def stream_segments(texts: DataFrame, table: ChangeTable, checkpoint: str) -> StreamingQuery:
    """Store the segments of streaming ``texts(asset_id, ext, content)``.

    Each micro-batch replaces the segments of its assets under its own number,
    so a batch that is run again after a failure leaves the same table.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        table.replace(segment_texts(batch), batch, batch_id)

    return (
        texts.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_texts(
    spark: SparkSession,
    root: str,
    assets: DataFrame,
    table: ChangeTable,
    failures: str,
    checkpoint: str,
    glob: str = "*",
    max_bytes: int | None = None,
) -> StreamingQuery:
    """Import files under ``root`` that belong to ``assets(asset_id, path)``.

    Every file ends in ``table`` or, with a reason, in the folder ``failures``:
    files of no known asset, of a format without text, or above ``max_bytes``.
    ``retry_paths`` names the ones to import again once their asset is known.
    """
    allow_text_decoding(spark)
    files = (
        spark.readStream.format("binaryFile")
        .schema(BINARY_SCHEMA)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .load(root)
    )

    def store(batch: DataFrame, batch_id: int) -> None:
        rows = plain_path(batch).withColumn("ext", extension(F.col("path")))
        rows = rows.join(assets.select("asset_id", "path"), "path", "left")
        too_large = F.lit(False) if max_bytes is None else F.col("length") > max_bytes
        error = (
            F.when(~can_import(F.col("ext")), F.lit(UNSUPPORTED))
            .when(too_large, F.lit(FILE_TOO_LARGE))
            .when(F.col("asset_id").isNull(), F.lit(ASSET_NOT_FOUND))
        )
        judged = rows.withColumn("error", error)
        good = judged.where(F.col("error").isNull())
        texts = good.select("asset_id", "ext", decode_text(F.col("content")).alias("content"))
        table.replace(segment_texts(texts), good, batch_id)
        write_stamp(judged.where(F.col("error").isNotNull()).select("path", "error"), failures, batch_id)

    return (
        files.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def import_failures(spark: SparkSession, failures: str) -> DataFrame:
    """``path, error, stamp`` of every file that a stream could not import."""
    return read_stamps(spark, failures, FAILURES)


def retry_paths(spark: SparkSession, failures: str, assets: DataFrame) -> DataFrame:
    """Files that came before their asset and whose asset is known now."""
    early = import_failures(spark, failures).where(F.col("error") == ASSET_NOT_FOUND)
    return early.select("path").distinct().join(assets.select("asset_id", "path"), "path")
