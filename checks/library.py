"""Catalogue, manifests and extraction bookkeeping."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cuesift.functions.paths import fingerprint
from cuesift.functions.payloads import json_field, read_jobs
from cuesift.operators import catalogue as ops
from cuesift.operators.extraction import (
    cached_runs,
    extraction_worklist,
    plan_extraction,
    replace_segments,
    run_rows,
)
from cuesift.operators.manifest import apply_diff, diff_manifest, listed_files, scan_errors, scan_summary

from cuesift.schemas import SEGMENTS
from cuesift.session import scratch_folder
from cuesift.sources.buckets import BucketStore

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


_PAGE = "asset_id, file_name, ext, kind, size_bytes, extract_status"


@check(
    "list_assets_page",
    f"""WITH {a.ASSETS_SQL} SELECT {_PAGE} FROM assets WHERE kind = 'text' AND contains(file_name, 'rc1')
    ORDER BY file_name, asset_id LIMIT 50 OFFSET 20""",
)
def list_assets_page(spark, sf_dir):
    found = ops.find_assets(a.assets(spark, sf_dir), kind="text", name_contains="RC1")
    return ops.list_assets(found, offset=20).select(*_PAGE.split(", "))


@check(
    "list_assets_walked",
    f"""WITH {a.ASSETS_SQL} SELECT {_PAGE}, n - 121 AS place FROM (
      SELECT *, row_number() OVER (ORDER BY file_name, asset_id) AS n FROM assets) WHERE n BETWEEN 121 AND 160""",
)
def list_assets_walked(spark, sf_dir):
    """The fourth page of forty, each page asked for after the last row of the one before."""
    found, last = a.assets(spark, sf_dir), None
    for _ in range(3):
        row = ops.list_assets(found, 40, after=last).collect()[-1]
        last = (row.file_name, row.asset_id)
    page = ops.list_assets(found, 40, after=last)
    # one page: its rows are numbered to compare their order too
    return page.select(*_PAGE.split(", "), (F.row_number().over(Window.orderBy("file_name", "asset_id")) - 1).cast("long").alias("place"))


@check(
    "list_assets_total",
    f"WITH {a.ASSETS_SQL} SELECT count(*) AS total FROM assets WHERE kind = 'text' AND contains(file_name, 'rc1')",
)
def list_assets_total(spark, sf_dir):
    found = ops.find_assets(a.assets(spark, sf_dir), kind="text", name_contains="RC1")
    return found.agg(F.count(F.lit(1)).alias("total"))


@check(
    "asset_detail",
    f"""WITH {a.SEGMENTS_SQL}, {a.ASSETS_SQL}, {a.TAGS_SQL}
    SELECT asset_id, file_name, fingerprint, coalesce(n, 0) AS segment_count, t.tags
    FROM assets LEFT JOIN (SELECT asset_id, count(*) AS n FROM segments GROUP BY 1) USING (asset_id)
    LEFT JOIN (SELECT asset_id, string_agg(name, ',' ORDER BY name) AS tags FROM tag_links GROUP BY 1) t USING (asset_id)""",
)
def asset_detail(spark, sf_dir):
    details = ops.asset_details(
        a.assets(spark, sf_dir), a.segments(spark, sf_dir), a.tags(spark, sf_dir), a.asset_tags(spark, sf_dir)
    )
    return details.select(
        "asset_id",
        "file_name",
        "fingerprint",
        "segment_count",
        F.array_join(F.transform("tags", lambda t: t["name"]), ",").alias("tags"),
    )


@check(
    "asset_summaries",
    f"""WITH {a.ASSETS_SQL}, {a.TAGS_SQL}
    SELECT asset_id, file_name, kind, t.n_tags FROM assets JOIN (SELECT DISTINCT doc_id AS asset_id FROM labels) USING (asset_id)
    JOIN (SELECT asset_id, count(*) AS n_tags FROM tag_links GROUP BY 1) t USING (asset_id)""",
)
def asset_summaries(spark, sf_dir):
    ids = a.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("asset_id"))
    found = ops.asset_summaries(a.assets(spark, sf_dir), a.tags(spark, sf_dir), a.asset_tags(spark, sf_dir), ids)
    return found.select("asset_id", "file_name", "kind", F.size("tags").cast("long").alias("n_tags"))


@check(
    "list_segments_page",
    f"""WITH {a.SEGMENTS_SQL} SELECT asset_id, ordinal, text FROM segments
    WHERE asset_id = 3 ORDER BY ordinal LIMIT 200 OFFSET 1""",
)
def list_segments_page(spark, sf_dir):
    return ops.list_segments(a.segments(spark, sf_dir), 3, offset=1).select("asset_id", "ordinal", "text")


@check(
    "job_list_ordered",
    f"""WITH {a.JOBS_SQL} SELECT job_id, status, row_number() OVER (ORDER BY job_id DESC) AS place FROM jobs WHERE target_id = 1""",
)
def job_list_ordered(spark, sf_dir):
    """The jobs of one target, newest first."""
    listed = ops.list_jobs(a.jobs(spark, sf_dir), target_id=1)
    return _placed(listed.select("job_id", "status"))


def _placed(listed):
    """A listing's rows with their places, to compare the order too."""
    at = listed.withColumn("__at", F.monotonically_increasing_id())
    return at.withColumn("place", F.row_number().over(Window.orderBy("__at")).cast("long")).drop("__at")


@check(
    "directories_ordered",
    """SELECT n_nationkey AS directory_id, n_name AS label, row_number() OVER (ORDER BY n_regionkey, n_nationkey) AS place FROM nation""",
)
def directories_ordered(spark, sf_dir):
    directories = a.table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("directory_id"), F.col("n_name").alias("label"), F.col("n_regionkey").alias("created_at")
    )
    return _placed(ops.list_directories(directories).select("directory_id", "label"))


@check(
    "job_payloads",
    """
    WITH raw AS (
      SELECT event_id AS job_id, CASE event_type
               WHEN 'view' THEN '{"assetId": ' || user_id || ', "deep": {"flag": true}}'
               WHEN 'click' THEN '{"assetId": "' || user_id || '", "deep": [1, {"flag": false}]}'
               WHEN 'error' THEN '{"assetId": ' || user_id
               WHEN 'purchase' THEN '[' || user_id || ']' END AS payload, event_type
      FROM events)
    SELECT job_id, payload IS NOT NULL AND json_valid(payload) AS is_json,
           CASE WHEN event_type IN ('view', 'click') THEN CAST(json_extract_string(payload, '$.assetId') AS BIGINT) END AS asset_id,
           CASE WHEN event_type = 'view' THEN true END AS flag
    FROM raw""",
)
def job_payloads(spark, sf_dir):
    """Open JSON of jobs; a damaged one is null and keeps nothing else from being read."""
    kind, user = F.col("event_type"), F.col("user_id").cast("string")
    text = (
        F.when(kind == "view", F.concat(F.lit('{"assetId": '), user, F.lit(', "deep": {"flag": true}}')))
        .when(kind == "click", F.concat(F.lit('{"assetId": "'), user, F.lit('", "deep": [1, {"flag": false}]}')))
        .when(kind == "error", F.concat(F.lit('{"assetId": '), user))
        .when(kind == "purchase", F.concat(F.lit("["), user, F.lit("]")))
    )
    jobs = read_jobs(a.table(spark, sf_dir, "events").select(F.col("event_id").alias("job_id"), text.alias("payload")))
    return jobs.select(
        "job_id",
        F.col("payload").isNotNull().alias("is_json"),
        json_field(F.col("payload"), "$.assetId", "bigint").alias("asset_id"),
        json_field(F.col("payload"), "$.deep.flag", "boolean").alias("flag"),
    )


@check(
    "job_list_active",
    f"""WITH {a.JOBS_SQL} SELECT job_id, target_id, type, status FROM jobs
    WHERE type = 'extract' AND status IN ('queued', 'running')""",
)
def job_list_active(spark, sf_dir):
    return ops.list_jobs(a.jobs(spark, sf_dir), job_type="extract", active_only=True)


_DIRS_SQL = r"""
known AS (SELECT '/src' || (year(ts) - 27) AS path_key FROM events GROUP BY 1),
asked AS (
  SELECT o_orderkey AS request_id, '/src' || year(o_orderdate) AS path_key,
         '//src' || year(o_orderdate) || CASE WHEN o_orderstatus = 'F' THEN '/./' ELSE '/x/..' END AS path,
         CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderpriority END AS label
  FROM orders)
"""


@check(
    "register_directories",
    f"""WITH {_DIRS_SQL}
    SELECT request_id, path_key,
           CASE WHEN label = '' THEN '..' ELSE label END AS label,
           CASE WHEN path_key IN (SELECT path_key FROM known) OR request_id <> min(request_id) OVER (PARTITION BY path_key)
                THEN 'DIRECTORY_DUPLICATE' END AS error_code
    FROM asked""",
)
def register_directories(spark, sf_dir):
    years = a.table(spark, sf_dir, "events").select((F.year("ts") - 27).cast("string").alias("y"))
    known = years.select(F.concat(F.lit("/src"), F.col("y")).alias("path_key")).distinct()
    orders = a.table(spark, sf_dir, "orders")
    number = F.year("o_orderdate").cast("string")
    tail = F.when(F.col("o_orderstatus") == "F", "/./").otherwise("/x/..")
    asked = orders.select(
        F.col("o_orderkey").alias("request_id"),
        F.concat(F.lit("//src"), number, tail).alias("path"),
        F.when(F.col("o_orderstatus") == "P", F.lit(" ")).otherwise(F.col("o_orderpriority")).alias("label"),
    )
    return ops.register_directories(known, asked).drop("path")


@check(
    "mark_scanned",
    "SELECT n_nationkey AS directory_id, max(epoch_ms(o_orderdate))::BIGINT AS last_scanned_at FROM nation "
    "LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1",
)
def mark_scanned(spark, sf_dir):
    dirs = a.table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("directory_id"), F.lit(None).cast("long").alias("last_scanned_at")
    )
    scans = a.table(spark, sf_dir, "orders").join(
        a.table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")
    ).select(F.col("c_nationkey").alias("directory_id"), a._day_ms("o_orderdate").alias("scanned_at"))
    return ops.mark_scanned(dirs, scans)


def _removed_dirs(spark, sf_dir):
    spanish = a.table(spark, sf_dir, "documents").where((F.col("lang") == "es") & (F.col("n_chars") > 2000))
    return spanish.select(F.substring("source", 4, 20).cast("long").alias("directory_id")).distinct()


_GONE_SQL = "gone AS (SELECT DISTINCT CAST(substr(source, 4) AS BIGINT) AS directory_id FROM documents WHERE lang = 'es' AND n_chars > 2000)"


@check(
    "cascade_delete",
    f"""WITH {a.SEGMENTS_SQL}, {a.ASSETS_SQL}, {a.TAGS_SQL}, {_GONE_SQL},
    kept AS (SELECT asset_id FROM assets WHERE directory_id NOT IN (SELECT directory_id FROM gone))
    SELECT 'assets' AS table_name, asset_id, count(*) AS n FROM kept GROUP BY ALL
    UNION ALL SELECT 'segments', asset_id, count(*) FROM segments JOIN kept USING (asset_id) GROUP BY ALL
    UNION ALL SELECT 'asset_tags', asset_id, count(*) FROM asset_tags JOIN kept USING (asset_id) GROUP BY ALL
    UNION ALL SELECT 'removed', directory_id, count(*) FROM assets JOIN gone USING (directory_id) GROUP BY ALL""",
)
def cascade_delete(spark, sf_dir):
    assets = a.assets(spark, sf_dir)
    left = ops.remove_directories(
        assets.select("directory_id").distinct(),
        assets,
        {"segments": a.segments(spark, sf_dir), "asset_tags": a.asset_tags(spark, sf_dir)},
        _removed_dirs(spark, sf_dir),
    )

    def counted(name, frame):
        return frame.groupBy("asset_id").agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(name).alias("table_name"), "asset_id", "n"
        )

    removed = left.removed.select(
        F.lit("removed").alias("table_name"),
        F.col("directory_id").alias("asset_id"),
        F.col("removed_assets").alias("n"),
    )
    return (
        counted("assets", left.assets)
        .unionByName(counted("segments", left.children["segments"]))
        .unionByName(counted("asset_tags", left.children["asset_tags"]))
        .unionByName(removed)
    )


@check(
    "detach_runs",
    f"""WITH {a.RESULTS_SQL}
    SELECT result_id AS segment_id, CASE WHEN asset_id NOT IN (SELECT asset_id FROM results WHERE error_code = 'E4') THEN asset_id END AS run_id
    FROM results""",
)
def detach_runs(spark, sf_dir):
    rows = a.results(spark, sf_dir)
    segments = rows.select(F.col("result_id").alias("segment_id"), F.col("asset_id").alias("run_id"))
    removed = rows.where("error_code = 'E4'").select(F.col("asset_id").alias("run_id")).distinct()
    return ops.detach_runs(segments, removed)


def _diff(spark, sf_dir, completed):
    return diff_manifest(
        a.manifest_before(spark, sf_dir),
        listed_files(a.manifest_now(spark, sf_dir)),
        a.scans(spark, sf_dir, completed),
    )


_DIFF_COLUMNS = "directory_id, path_key, old_asset_id AS asset_id, fingerprint, change_type"


def _comparable(diff):
    return diff.select("directory_id", "path_key", "asset_id", "fingerprint", "change_type")


@check("manifest_diff", f"WITH {a.MANIFEST_SQL.format(completed='true')} SELECT {_DIFF_COLUMNS} FROM diff")
def manifest_diff(spark, sf_dir):
    return _comparable(_diff(spark, sf_dir, F.lit(True)))


@check(
    "manifest_diff_cancelled",
    f"WITH {a.MANIFEST_SQL.format(completed='max(o_totalprice) < 400000')} SELECT {_DIFF_COLUMNS} FROM diff",
)
def manifest_diff_cancelled(spark, sf_dir):
    """Walks of directories with a very large file were cancelled: nothing is removed there."""
    return _comparable(_diff(spark, sf_dir, F.max("size_bytes") < 40_000_000))


@check(
    "manifest_applied",
    f"""WITH {a.MANIFEST_SQL.format(completed='true')}
    SELECT path_key, fingerprint, CAST(CASE WHEN change_type IN ('new', 'changed') THEN 99 ELSE 1 END AS BIGINT) AS updated_at
    FROM diff WHERE change_type IN ('new', 'changed', 'unchanged')
    UNION ALL SELECT path, fingerprint, 1 FROM manifest_before
    WHERE directory_id NOT IN (SELECT directory_id FROM scans)""",
)
def manifest_applied(spark, sf_dir):
    before = a.manifest_before(spark, sf_dir).select(
        "*",
        F.lit("old").alias("file_name"),
        F.lit(".mp4").alias("ext"),
        F.lit("video").alias("kind"),
        F.lit(0).cast("long").alias("size_bytes"),
        F.lit(0).cast("long").alias("mtime_ms"),
        F.lit("none").alias("extract_status"),
        F.lit(1).cast("long").alias("updated_at"),
    )
    after = apply_diff(before, _diff(spark, sf_dir, F.lit(True)), 99)
    return after.select("path_key", "fingerprint", "updated_at")


@check(
    "manifest_ids",
    f"""WITH {a.MANIFEST_SQL.format(completed='true')},
    fresh AS (SELECT count(*) AS n FROM diff WHERE change_type = 'new'),
    old AS (SELECT max(asset_id) AS top FROM manifest_before)
    SELECT n AS files, n AS ids, top AS first_free, top + n AS last_id FROM fresh, old""",
)
def manifest_ids(spark, sf_dir):
    """New files get distinct consecutive ids after the highest old one."""
    before = a.manifest_before(spark, sf_dir)
    after = apply_diff(before.withColumn("updated_at", F.lit(0)), _diff(spark, sf_dir, F.lit(True)), 1)
    old = before.agg(F.max("asset_id")).scalar()
    fresh = after.where(F.col("asset_id") > old)
    return fresh.agg(
        F.count(F.lit(1)).alias("files"),
        F.countDistinct("asset_id").alias("ids"),
        F.max(old).alias("first_free"),
        F.max("asset_id").alias("last_id"),
    )


@check(
    "scan_summary",
    f"""WITH {a.MANIFEST_SQL.format(completed='true')},
    events_all AS (
      SELECT directory_id, change_type AS event FROM diff
      UNION ALL SELECT directory_id, 'skipped' FROM manifest_now WHERE path LIKE '%.pdf')
    SELECT directory_id, count(*) FILTER (WHERE event <> 'removed') AS visited,
           count(*) FILTER (WHERE event = 'new') AS indexed, count(*) FILTER (WHERE event = 'changed') AS updated,
           count(*) FILTER (WHERE event = 'unchanged') AS unchanged, count(*) FILTER (WHERE event = 'skipped') AS skipped_unsupported,
           count(*) FILTER (WHERE event = 'removed') AS removed
    FROM events_all GROUP BY 1""",
)
def scan_summary_query(spark, sf_dir):
    now = a.manifest_now(spark, sf_dir)
    return scan_summary(now, listed_files(now), _diff(spark, sf_dir, F.lit(True)))


@check(
    "scan_errors",
    "SELECT o_custkey AS directory_id, '/d/' || o_orderkey AS path, o_orderpriority AS error FROM orders "
    "WHERE o_orderpriority = '1-URGENT'",
)
def scan_errors_query(spark, sf_dir):
    return scan_errors(_error_listing(spark, sf_dir))


@check(
    "scan_errors_report",
    "SELECT o_custkey AS directory_id, '/d/' || o_orderkey AS path, o_orderpriority AS error FROM orders "
    "WHERE o_orderpriority = '1-URGENT' "
    "QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY '/d/' || o_orderkey) <= 2",
)
def scan_errors_report(spark, sf_dir):
    return scan_errors(_error_listing(spark, sf_dir), per_directory=2)


def _error_listing(spark, sf_dir):
    return a.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("directory_id"),
        F.concat(F.lit("/d/"), F.col("o_orderkey").cast("string")).alias("path"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_orderpriority")).alias("error"),
    )


@check(
    "fingerprint",
    "SELECT o_orderkey, o_orderkey * 3 || ':' || CAST(floor(o_totalprice) AS BIGINT) AS fingerprint FROM orders",
)
def fingerprint_query(spark, sf_dir):
    orders = a.table(spark, sf_dir, "orders")
    return orders.select("o_orderkey", fingerprint(F.col("o_orderkey") * 3, F.col("o_totalprice")).alias("fingerprint"))


# assets whose fingerprint a run may carry: one per event value of a user
_EVENT_ASSETS_SQL = """
event_assets AS (
  SELECT user_id AS asset_id, max(CAST(floor(value) AS BIGINT)) || ':' || (user_id * 1000) AS fingerprint
  FROM events GROUP BY user_id)
"""


def _event_assets(spark, sf_dir):
    top = a.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("asset_id")).agg(F.max(F.floor("value")).alias("size"))
    return top.select("asset_id", fingerprint(F.col("size"), F.col("asset_id") * 1000).alias("fingerprint"))


_DONE = "SELECT * FROM runs WHERE status = 'succeeded' AND engine_label = 'parser-1+simplified'"


@check(
    "extraction_worklist",
    f"""WITH {a.JOBS_SQL}, {_EVENT_ASSETS_SQL} SELECT asset_id, fingerprint FROM event_assets e
    WHERE NOT EXISTS (SELECT 1 FROM ({_DONE}) r WHERE r.asset_id = e.asset_id AND r.fingerprint = e.fingerprint)""",
)
def extraction_worklist_query(spark, sf_dir):
    return extraction_worklist(_event_assets(spark, sf_dir), a.runs(spark, sf_dir), "parser-1+simplified")


@check(
    "extraction_reused",
    f"""WITH {a.JOBS_SQL}, {_EVENT_ASSETS_SQL} SELECT e.asset_id, max(run_id) AS run_id
    FROM event_assets e JOIN ({_DONE}) r ON r.asset_id = e.asset_id AND r.fingerprint = e.fingerprint GROUP BY 1""",
)
def extraction_reused(spark, sf_dir):
    return cached_runs(_event_assets(spark, sf_dir), a.runs(spark, sf_dir), "parser-1+simplified")


@check(
    "extraction_plan",
    f"""WITH {a.ASSETS_SQL} SELECT asset_id, CASE WHEN ext IN ('.txt', '.srt') THEN 'import' ELSE 'transcribe' END AS extraction_plan FROM assets
    UNION ALL SELECT page_id, 'unsupported' FROM pages""",
)
def extraction_plan_query(spark, sf_dir):
    files = a.assets(spark, sf_dir).select("asset_id", "kind", "ext")
    pictures = a.table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("asset_id"), F.lit("image").alias("kind"), F.lit(".PNG").alias("ext")
    )
    return plan_extraction(files.unionByName(pictures)).select("asset_id", "extraction_plan")


@check(
    "replace_segments",
    f"""WITH {a.SEGMENTS_SQL}, touched AS (SELECT doc_id FROM labels WHERE toxic = 1 OR quality = 0)
    SELECT asset_id, ordinal, CASE WHEN asset_id IN (SELECT doc_id FROM touched) THEN lower(text) ELSE text END AS text
    FROM segments WHERE NOT (asset_id IN (SELECT doc_id FROM labels WHERE toxic = 1))""",
)
def replace_segments_query(spark, sf_dir):
    """Toxic assets are re-read as empty, low-quality ones in lower case."""
    old = a.segments(spark, sf_dir)
    labels = a.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("asset_id"), "quality", "toxic")
    touched = labels.where("toxic = 1 OR quality = 0")
    new = old.join(touched.where("toxic = 0"), "asset_id", "left_semi").withColumn("text", F.lower("text"))
    return replace_segments(old, new, touched).select("asset_id", "ordinal", "text")


@check("replace_stored_segments", ORACLES["replace_segments"])
def replace_stored_segments(spark, sf_dir):
    """The same in a store that only rewrites the folders of the assets touched."""
    old = a.segments(spark, sf_dir)
    store = BucketStore(spark, scratch_folder(spark, "segments"), SEGMENTS, "asset_id", 32)
    store.build(old)
    labels = a.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("asset_id"), "quality", "toxic")
    touched = labels.where("toxic = 1 OR quality = 0")
    store.replace(store.of(touched.where("toxic = 0")).withColumn("text", F.lower("text")), touched)
    return store.read().select("asset_id", "ordinal", "text")


@check(
    "run_outcomes",
    f"""WITH {a.SEGMENTS_SQL}, counted AS (SELECT asset_id, count(*) AS n FROM segments GROUP BY 1)
    SELECT doc_id AS asset_id, CASE WHEN n_chars > 20000 THEN 'failed' ELSE 'succeeded' END AS run_status,
           CASE WHEN n_chars > 20000 THEN 'failed' WHEN n IS NULL THEN 'skipped' ELSE 'succeeded' END AS source_status,
           CASE WHEN n_chars > 20000 THEN 0 ELSE coalesce(n, 0) END AS segment_count
    FROM documents LEFT JOIN counted ON asset_id = doc_id""",
)
def run_outcomes(spark, sf_dir):
    """Run and source rows after an import that refuses long documents."""
    counted = ops.segment_counts(a.segments(spark, sf_dir))
    long = F.col("n_chars") > 20000
    outcomes = (
        a.table(spark, sf_dir, "documents")
        .select(F.col("doc_id").alias("asset_id"), "n_chars")
        .join(counted, "asset_id", "left")
        .select(
            "asset_id",
            fingerprint(F.col("n_chars"), F.col("asset_id")).alias("fingerprint"),
            F.coalesce("segment_count", F.lit(0)).alias("segment_count"),
            F.when(F.col("segment_count").isNull(), "no text").alias("skipped_reason"),
            F.when(long, "EXTRACTION_FAILED").alias("error_code"),
            F.when(long, "too large").alias("error_message"),
        )
    )
    runs, sources = run_rows(outcomes, "parser-1+simplified", "file", 1, F.lit(0))
    return runs.select("run_id", "asset_id", F.col("status").alias("run_status")).join(
        sources.select("run_id", F.col("status").alias("source_status"), "segment_count"), "run_id"
    ).drop("run_id")
