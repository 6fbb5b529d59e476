"""File listings and bulk reads."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.decode import decode_text
from ..functions.paths import extension, file_kind, file_name, fingerprint, path_key
from ..session import allow_text_decoding
from .text import can_import
from .walk import file_system, reason_of

# The size from which a file is refused on import, and the reason given.
MAX_TEXT_BYTES = 16 * 1024 * 1024
FILE_TOO_LARGE = "FILE_TOO_LARGE"

# Bytes of files a task holds before it hands them on.
_READ_BYTES = 4 << 20

BINARY_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def read_bytes(path: str) -> bytes:
    store, inside = file_system(path)
    with store.open_input_stream(inside) as stream:
        return stream.read()


def _binary_files(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)


def plain_path(df: DataFrame) -> DataFrame:
    """Local files lose their ``file:`` scheme; other schemes stay."""
    return df.withColumn("path", F.regexp_replace("path", r"\Afile:(?=/)", ""))


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """``path, size_bytes, mtime_ms`` of every file; no bytes are read.

    As everywhere in Spark, names that start with ``_`` or ``.`` are hidden;
    pass an external manifest of the same shape where those matter.
    """
    return plain_path(_binary_files(spark, root)).select(
        "path",
        F.col("length").alias("size_bytes"),
        F.unix_millis("modificationTime").cast("double").alias("mtime_ms"),
    )


def classify_files(files: DataFrame, case_insensitive: bool = False) -> DataFrame:
    """Add name, extension, kind, key and fingerprint; a null kind is unsupported."""
    path = F.col("path")
    return files.select(
        *files.columns,
        path_key(path, case_insensitive).alias("path_key"),
        file_name(path).alias("file_name"),
        extension(path).alias("ext"),
        file_kind(extension(path)).alias("kind"),
        fingerprint(F.col("size_bytes"), F.col("mtime_ms")).alias("fingerprint"),
    )


def read_named(work: DataFrame, read_one: Callable[[str], bytes] = read_bytes) -> DataFrame:
    """``work(…, path)`` with ``content`` and ``read_error`` of the files it names, and of no others.

    Tasks read their rows' files, in batches of a few megabytes; the list never
    passes through the driver. A file that cannot be read gives the reason.
    """
    names = work.columns
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in work.schema.fields)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: pa.RecordBatch, bodies: list, errors: list) -> pa.RecordBatch:
            columns = [*rows.columns, pa.array(bodies, pa.binary()), pa.array(errors, pa.string())]
            return pa.RecordBatch.from_arrays(columns, [*names, "body", "read_error"])

        for rows in batches:
            begin, bodies, errors, held = 0, [], [], 0
            for at, path in enumerate(rows.column("path").to_pylist()):
                try:
                    bodies.append(read_one(path))
                    errors.append(None)
                    held += len(bodies[-1])
                except (OSError, pa.ArrowInvalid) as error:
                    bodies.append(None)
                    errors.append(reason_of(error))
                if held > _READ_BYTES:
                    yield batch(rows.slice(begin, at + 1 - begin), bodies, errors)
                    begin, bodies, errors, held = at + 1, [], [], 0
            yield batch(rows.slice(begin), bodies, errors)

    allow_text_decoding(work.sparkSession)
    done = work.mapInArrow(read, f"{kinds}, body binary, read_error string")
    return done.select(*names, decode_text(F.col("body")).alias("content"), "read_error")


def read_texts(spark: SparkSession, root: str, max_bytes: int | None = None) -> DataFrame:
    """``path, ext, size_bytes, content, error`` of importable files, decoded.

    Files above ``max_bytes`` are listed with an error and never opened: they come
    from a listing without the bytes, the others from a scan with the condition.
    """
    allow_text_decoding(spark)
    files = plain_path(_binary_files(spark, root)).withColumn("ext", extension(F.col("path")))
    files = files.where(can_import(F.col("ext")))

    def rows(part: DataFrame, content, error) -> DataFrame:
        return part.select(
            "path", "ext", F.col("length").alias("size_bytes"), content.alias("content"), error.alias("error")
        )

    nothing = F.lit(None).cast("string")
    if max_bytes is None:
        return rows(files, decode_text(F.col("content")), nothing)
    small = rows(files.where(F.col("length") <= max_bytes), decode_text(F.col("content")), nothing)
    large = rows(files.where(F.col("length") > max_bytes), nothing, F.lit(FILE_TOO_LARGE))
    return small.unionByName(large)
