"""Session settings and the few cluster-level helpers every job uses."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows a lookup side may hold and still be sent to every executor. Each such
# row is bounded too (a query term, a job parameter), so this proves the size.
BROADCAST_ROWS = 20_000

# Copies of the unique side of a salted join; one hot key then feeds this many
# tasks instead of one.
SALT_BUCKETS = 32


def build_session(app: str = "cuesift", master: str | None = None, **conf: str) -> SparkSession:
    """Session with adaptive execution and the decoders the text sources need."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    allow_text_decoding(spark)
    return spark


def allow_text_decoding(spark: SparkSession) -> None:
    """GBK is outside Spark's default charset list; bad bytes become U+FFFD."""
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    spark.conf.set("spark.sql.legacy.codingErrorAction", "true")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Spread a scan that yields fewer tasks than the cluster has cores.

    A small table often sits in one row group, so row-expanding work would run
    in one task. Large tables already have more splits than cores and pass
    through without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys)


def deal(df: DataFrame, key: str, rows: int = 20_000) -> DataFrame:
    """Deal rows that take long each to tasks of some ``rows`` of them.

    One row group is one task however many small rows it holds, so work that
    grows with rows and not with bytes cannot follow the splits of a file.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-df.count() // rows)), key)


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` holds at most ``max_rows`` rows; reads no more than that."""
    return df.limit(max_rows + 1).count() <= max_rows


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints.

    One process (``local[n]``) may use a temporary folder of its own; on a
    cluster no other executor would see it, so a missing setting is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get(
            "spark.checkpoint.dir", None
        )
        if not folder:
            if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="cuesift-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, for tables written along the way."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once below the shared folder and read back.

    Later steps read the files, so a lost executor costs no recomputation, and
    values that depend on the task (row numbers) stay what they were.
    """
    spark = df.sparkSession
    folder = scratch_folder(spark, name)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def salted_join(
    many: DataFrame,
    one: DataFrame,
    on: list[str],
    how: str,
    spread_by: Column,
    buckets: int = SALT_BUCKETS,
) -> DataFrame:
    """Join rows to a table unique on ``on`` when one key may hold most rows.

    The unique side is repeated once per salt, and ``spread_by`` (any column
    that varies within a key) decides the salt of each row, so a hot key is
    shared by ``buckets`` tasks. Spark still broadcasts ``one`` when its
    statistics show that it is small.
    """
    salt = "__salt"
    left = many.withColumn(salt, F.pmod(F.xxhash64(spread_by), F.lit(buckets)).cast("int"))
    copies = F.explode(F.sequence(F.lit(0), F.lit(buckets - 1)))
    right = one.withColumn(salt, copies)
    return left.join(right, [*on, salt], how).drop(salt)
