"""The incremental flows, run to the end of their input."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuesift.operators.progress import download_progress
from cuesift.schemas import SEGMENTS
from cuesift.session import scratch_folder
from cuesift.sources.changes import ChangeTable
from cuesift.streaming.ingest import stream_segments
from cuesift.streaming.status import active_status, job_states, stream_job_changes, stream_job_states

from . import adapters as a

QUERIES = {}
ORACLES = {}


def check(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


# Rows of a file of a micro-batch.
_FILE_ROWS = 20_000


def _arriving(spark, name, *writes):
    """A stream of several micro-batches: each write's files come after those of the one before.

    A write makes ``parts`` micro-batches by its key. All micro-batches have the
    same number of files, and the more rows there are the more files.
    """
    folder = scratch_folder(spark, name)
    part = lambda key, parts: F.pmod(F.hash(key), F.lit(parts))
    sizes = []
    for frame, parts, key in writes:
        found = {row.part: row["count"] for row in frame.groupBy(part(key, parts).alias("part")).count().collect()}
        sizes += [found.get(n, 0) for n in range(parts)]
    files = max(min(sizes) // _FILE_ROWS, 1)
    for frame, parts, key in writes:
        for n in range(parts):
            frame.where(part(key, parts) == n).repartition(files).write.mode("append").parquet(folder)
    schema = writes[0][0].schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


@check("stream_text_segments", f"WITH {a.SEGMENTS_SQL} SELECT asset_id, segment_id, ordinal, text FROM segments")
def stream_text_segments(spark, sf_dir):
    """Documents arrive in five micro-batches, first in an older state that is replaced."""
    folder = scratch_folder(spark, "segments")
    table = ChangeTable(spark, f"{folder}/table", SEGMENTS, "asset_id")
    docs = a.table(spark, sf_dir, "documents").select("doc_id", "text")
    older = docs.withColumn("text", F.concat(F.reverse("text"), F.lit("\nolder")))
    texts = _arriving(spark, "texts", (older, 2, "doc_id"), (docs, 3, "doc_id")).select(
        F.col("doc_id").alias("asset_id"), F.lit(".txt").alias("ext"), F.col("text").alias("content")
    )
    stream_segments(texts, table, f"{folder}/progress").awaitTermination()
    return table.read().select("asset_id", "segment_id", "ordinal", "text")


_STATES_SQL = """
SELECT job_id, arg_max(status, event_id) AS status, max(event_id) AS event_id
FROM (SELECT *, user_id * 10 + length(event_type) AS job_id,
             CASE event_type WHEN 'view' THEN 'running' WHEN 'click' THEN 'queued' ELSE 'succeeded' END AS status FROM events)
GROUP BY 1
"""


def _job_events(spark, sf_dir):
    """All events in three micro-batches, then earlier ones late and again in two more."""
    kind = F.col("event_type")
    events = a.table(spark, sf_dir, "events").select(
        (F.col("user_id") * 10 + F.length(kind)).alias("job_id"),
        F.lit("extract").alias("type"),
        F.when(kind == "view", "running").when(kind == "click", "queued").otherwise("succeeded").alias("status"),
        F.col("user_id").alias("target_id"),
        "event_id",
    )
    return _arriving(spark, "events", (events, 3, "event_id"), (events.where("event_id % 2 = 0"), 2, "event_id"))


def _job_states(spark, sf_dir, store=stream_job_states):
    folder = scratch_folder(spark, "jobs")
    store(_job_events(spark, sf_dir), f"{folder}/table", f"{folder}/progress").awaitTermination()
    return job_states(spark, f"{folder}/table")


@check("stream_job_states", _STATES_SQL)
def stream_job_states_query(spark, sf_dir):
    return _job_states(spark, sf_dir).select("job_id", "status", "event_id")


@check("stream_job_changes", _STATES_SQL)
def stream_job_changes_query(spark, sf_dir):
    """The same from keyed state, which only passes on what changes a job."""
    return _job_states(spark, sf_dir, stream_job_changes).select("job_id", "status", "event_id")


@check(
    "stream_active_status",
    f"""SELECT job_id // 10 AS asset_id, arg_max(status, job_id) AS active_status FROM ({_STATES_SQL})
    WHERE status IN ('queued', 'running') GROUP BY 1""",
)
def stream_active_status(spark, sf_dir):
    return active_status(_job_states(spark, sf_dir))


@check(
    "download_progress",
    """
    WITH e AS (
      SELECT user_id AS download_id, event_id AS seq, event_type AS status_name,
             CASE event_type WHEN 'signup' THEN 'initiate' WHEN 'purchase' THEN 'done' ELSE 'progress' END AS status,
             'f' || (CAST(floor(value) AS BIGINT) // 10) AS file, CAST(floor(value * 10) AS BIGINT) AS reported,
             CASE WHEN event_type IN ('signup', 'view') THEN 300 + CAST(floor(value) AS BIGINT) END AS declared
      FROM events),
    sized AS (SELECT *, last_value(declared IGNORE NULLS) OVER (PARTITION BY download_id, file ORDER BY seq) AS file_total FROM e),
    far AS (SELECT *, CASE WHEN status = 'initiate' THEN 0 WHEN status = 'done' AND file_total IS NOT NULL THEN greatest(reported, file_total) ELSE reported END AS far FROM sized),
    reached AS (SELECT *, max(far) OVER (PARTITION BY download_id, file ORDER BY seq) AS file_loaded FROM far),
    steps AS (SELECT *, file_loaded - coalesce(lag(file_loaded) OVER w, 0) AS dl, coalesce(file_total, 0) - coalesce(lag(file_total) OVER w, 0) AS dt
              FROM reached WINDOW w AS (PARTITION BY download_id, file ORDER BY seq)),
    sums AS (SELECT *, sum(dl) OVER (PARTITION BY download_id ORDER BY seq) AS loaded, sum(dt) OVER (PARTITION BY download_id ORDER BY seq) AS total FROM steps),
    now AS (SELECT *, CASE WHEN status <> 'initiate' AND total > 0 THEN least(100, floor(loaded / total * 100 + 0.5)) END AS pct FROM sums)
    SELECT download_id, seq, CASE WHEN status = 'initiate' THEN 'preparing' ELSE 'downloading' END AS phase,
           loaded::BIGINT AS loaded, total::BIGINT AS total,
           CASE WHEN pct IS NOT NULL THEN max(pct) OVER (PARTITION BY download_id ORDER BY seq) END::BIGINT AS percent
    FROM now
    """,
)
def download_progress_query(spark, sf_dir):
    kind = F.col("event_type")
    whole = F.floor("value").cast("long")
    events = a.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("download_id"),
        F.col("event_id").alias("seq"),
        F.when(kind == "signup", "initiate").when(kind == "purchase", "done").otherwise("progress").alias("status"),
        F.concat(F.lit("f"), F.floor(whole / 10).cast("string")).alias("file"),
        F.floor(F.col("value") * 10).cast("long").alias("loaded"),
        F.when(kind.isin("signup", "view"), whole + 300).alias("total"),
    )
    return download_progress(events)
