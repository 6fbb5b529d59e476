"""The catalogue model built from the test tables, in Spark and in SQL.

Each ``*_SQL`` text defines, as common table expressions, the same rows as the
Spark function beside it.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuesift.functions.paths import extension, file_kind, fingerprint, path_key
from cuesift.plans.search import Catalogue
from cuesift.session import spread
from cuesift.sources.text import number_segments, text_lines, untimed

WS = r"[\s\x{0b}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def trim_sql(value: str) -> str:
    return f"regexp_replace({value}, '^{WS}+|{WS}+$', '', 'g')"


# Queries that work on any catalogue and any table of queries: the registered
# ones make both from the test tables, the benchmark passes stored ones.
SERVED: dict = {}


def served(name: str):
    """Register ``function(found, asked)`` and return it as ``query(spark, sf_dir)``."""

    def register(function):
        SERVED[name] = function
        return lambda spark, sf_dir: function(catalogue(spark, sf_dir), queries(spark, sf_dir))

    return register


@lru_cache(maxsize=256)
def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table for row-expanding work."""
    return spread(table(spark, sf_dir, name))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def text_id(value: Column) -> Column:
    """A number for a name, computable in both engines."""
    return F.conv(F.substring(F.md5(value.cast("binary")), 1, 15), 16, 10).cast("long")


def text_id_sql(value: str) -> str:
    return f"CAST('0x' || substr(md5({value}), 1, 15) AS BIGINT)"


# ---- segments: the lines of documents.text

_CHUNK = f"(?s).{{1,1000}}$|.{{1000}}.{{1,1000}}$|.{{1000}}.{{600,999}}{WS}|.{{1000}}.{{1000}}"

SEGMENTS_SQL = f"""
seg_lists AS (
  SELECT doc_id, flatten(list_transform(
    list_filter(list_transform(string_split_regex(text, '\\r\\n|\\r|\\n'),
                lambda l: {trim_sql('l')}), lambda l: l <> ''),
    lambda l: CASE WHEN length(l) > 2000
      THEN list_filter(list_transform(regexp_extract_all(l, '{_CHUNK}'),
                       lambda c: {trim_sql('c')}), lambda c: c <> '')
      ELSE [l] END)) AS items
  FROM documents),
segments AS (
  SELECT doc_id AS asset_id, doc_id * 16777216 + ordinal AS segment_id, CAST(ordinal AS INTEGER) AS ordinal, text
  FROM (SELECT doc_id, unnest(items) AS text, generate_subscripts(items, 1) - 1 AS ordinal FROM seg_lists))
"""


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(F.col("doc_id").alias("asset_id"), "text")
    return number_segments(docs, untimed(text_lines(F.col("text"))))


# ---- assets: one file per document, its extension decided by language

ASSETS_SQL = """
assets AS (
  SELECT d.doc_id AS asset_id,
         CAST(substr(source, 4) AS BIGINT) AS directory_id,
         '/' || source || '/' || source || '_' || lang || '_' || d.doc_id || ext AS path,
         source || '_' || lang || '_' || d.doc_id || ext AS file_name,
         ext,
         CASE ext WHEN '.txt' THEN 'text' WHEN '.srt' THEN 'text' WHEN '.mp4' THEN 'video' ELSE 'audio' END AS kind,
         n_chars AS size_bytes,
         d.doc_id * 1000 AS mtime_ms,
         n_chars || ':' || (d.doc_id * 1000) AS fingerprint,
         CASE l.quality WHEN 1 THEN 'done' WHEN 0 THEN 'running' ELSE 'none' END AS extract_status
  FROM (SELECT *, CASE lang WHEN 'en' THEN '.txt' WHEN 'fr' THEN '.mp4' WHEN 'de' THEN '.srt' ELSE '.mp3' END AS ext
        FROM documents) d
  LEFT JOIN labels l ON l.doc_id = d.doc_id)
"""


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext = (
        F.when(F.col("lang") == "en", ".txt")
        .when(F.col("lang") == "fr", ".mp4")
        .when(F.col("lang") == "de", ".srt")
        .otherwise(".mp3")
    )
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    name = F.concat_ws("_", "source", "lang", F.concat(F.col("doc_id").cast("string"), ext))
    path = F.concat(F.lit("/"), F.col("source"), F.lit("/"), name)
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("asset_id"),
        F.substring("source", 4, 20).cast("long").alias("directory_id"),
        path.alias("path"),
        path_key(path).alias("path_key"),
        name.alias("file_name"),
        extension(path).alias("ext"),
        file_kind(extension(path)).alias("kind"),
        F.col("n_chars").alias("size_bytes"),
        (F.col("doc_id") * 1000).alias("mtime_ms"),
        fingerprint(F.col("n_chars"), F.col("doc_id") * 1000).alias("fingerprint"),
        F.when(F.col("quality") == 1, "done").when(F.col("quality") == 0, "running").otherwise("none").alias(
            "extract_status"
        ),
        (F.col("doc_id") * 1000).alias("updated_at"),
    )


# ---- tags: language, source and labels of a document; nations are never used

TAGS_SQL = f"""
tag_links AS (
  SELECT doc_id AS asset_id, lang AS name FROM documents
  UNION ALL SELECT doc_id, source FROM documents
  UNION ALL SELECT doc_id, 'quality ' || quality FROM labels
  UNION ALL SELECT doc_id, 'toxic ' || toxic FROM labels),
asset_tags AS (SELECT asset_id, {text_id_sql('name')} AS tag_id FROM tag_links),
tags AS (
  SELECT {text_id_sql('name')} AS tag_id, name, lower(name) AS name_key
  FROM (SELECT name FROM tag_links UNION SELECT n_name FROM nation))
"""


def tag_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``asset_id, name``."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    asset = F.col("doc_id").alias("asset_id")
    return (
        docs.select(asset, F.explode(F.array("lang", "source")).alias("name"))
        .unionByName(
            labels.select(
                asset,
                F.explode(
                    F.array(
                        F.concat(F.lit("quality "), F.col("quality").cast("string")),
                        F.concat(F.lit("toxic "), F.col("toxic").cast("string")),
                    )
                ).alias("name"),
            )
        )
    )


def asset_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tag_links(spark, sf_dir).select("asset_id", text_id(F.col("name")).alias("tag_id"))


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    unused = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"))
    names = tag_links(spark, sf_dir).select("name").unionByName(unused).distinct()
    return names.select(
        text_id(F.col("name")).alias("tag_id"),
        "name",
        F.lower("name").alias("name_key"),
        F.lit(None).cast("string").alias("color"),
    )


def catalogue(spark: SparkSession, sf_dir: str) -> Catalogue:
    return Catalogue(
        assets=assets(spark, sf_dir),
        segments=segments(spark, sf_dir),
        tags=tags(spark, sf_dir),
        asset_tags=asset_tags(spark, sf_dir),
    )


# ---- queries: all words of each benchmark passage, eight to a query

QUERIES_SQL = r"""
query_words AS (
  SELECT item_id, word, row_number() OVER (PARTITION BY item_id ORDER BY min(place)) - 1 AS n
  FROM (SELECT item_id, unnest(w) AS word, generate_subscripts(w, 1) AS place
        FROM (SELECT item_id, regexp_extract_all(lower(text), '\p{L}+') AS w FROM benchmark))
  GROUP BY item_id, word),
queries AS (
  SELECT item_id * 1000 + n // 8 AS query_id, string_agg(word, ' ' ORDER BY n) AS query FROM query_words GROUP BY ALL),
terms AS (
  SELECT query_id, word AS term, lower(word) AS folded
  FROM query_words JOIN queries ON query_id = item_id * 1000 + n // 8 WHERE length(query) <= 200)
"""


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``query_id, query``, derived inside each row."""
    words = F.array_distinct(
        F.regexp_extract_all(F.lower(F.col("text")), F.lit(r"\p{L}+"), F.lit(0))
    )
    last = F.floor((F.size("words") - 1) / 8).cast("int")
    eights = F.when(F.size("words") > 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.slice("words", i * 8 + 1, 8)))
    rows = table(spark, sf_dir, "benchmark").select("item_id", words.alias("words"))
    return rows.select("item_id", F.posexplode(eights).alias("n", "some")).select(
        (F.col("item_id") * 1000 + F.col("n")).alias("query_id"), F.array_join("some", " ").alias("query")
    )


# ---- jobs and runs: the events of a user are the jobs of an asset

JOBS_SQL = """
jobs AS (
  SELECT event_id AS job_id, user_id AS target_id,
         CASE WHEN event_type IN ('signup') THEN 'scan' ELSE 'extract' END AS type,
         CASE WHEN event_type = 'view' AND value >= 60 THEN 'running' WHEN event_type IN ('view', 'click') THEN 'succeeded'
              WHEN event_type = 'signup' THEN 'queued' WHEN event_type = 'error' THEN 'failed' ELSE 'canceled' END AS status
  FROM events),
runs AS (
  SELECT event_id AS run_id, user_id AS asset_id, CAST(floor(value) AS BIGINT) || ':' || (user_id * 1000) AS fingerprint,
         CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'running' ELSE 'succeeded' END AS status,
         CASE WHEN event_type IN ('click', 'view') THEN 'parser-1+traditional' ELSE 'parser-1+simplified' END AS engine_label
  FROM events)
"""


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("job_id"),
        F.col("user_id").alias("target_id"),
        F.when(kind == "signup", "scan").otherwise("extract").alias("type"),
        F.when((kind == "view") & (F.col("value") >= 60), "running")
        .when(kind.isin("view", "click"), "succeeded")
        .when(kind == "signup", "queued")
        .when(kind == "error", "failed")
        .otherwise("canceled")
        .alias("status"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("run_id"),
        F.col("user_id").alias("asset_id"),
        fingerprint(F.floor("value"), F.col("user_id") * 1000).alias("fingerprint"),
        F.when(kind == "error", "failed").when(kind == "signup", "running").otherwise("succeeded").alias("status"),
        F.when(kind.isin("click", "view"), "parser-1+traditional").otherwise("parser-1+simplified").alias("engine_label"),
    )


# ---- manifests: order states before and after an invented update

MANIFEST_SQL = """
manifest_before AS (
  SELECT o_orderkey AS asset_id, o_custkey AS directory_id, '/d' || o_custkey || '/' || o_orderkey || '.mp4' AS path,
         CAST(round(o_totalprice * 100) AS BIGINT) || ':' || CAST(epoch_ms(o_orderdate) AS BIGINT) AS fingerprint
  FROM orders WHERE o_orderpriority <> '1-URGENT'),
manifest_now AS (
  SELECT o_custkey AS directory_id,
         '/d' || o_custkey || '/' || o_orderkey || CASE WHEN o_orderpriority = '3-MEDIUM' AND o_orderstatus = 'O' THEN '.pdf' ELSE '.mp4' END AS path,
         CAST(round(o_totalprice * 100) AS BIGINT) + CASE WHEN o_orderpriority = '5-LOW' THEN 1 ELSE 0 END AS size_bytes,
         CAST(epoch_ms(o_orderdate) AS BIGINT) AS mtime_ms
  FROM orders WHERE o_orderstatus <> 'F'),
scans AS (
  SELECT o_custkey AS directory_id, {completed} AS completed FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1),
diff AS (
  SELECT coalesce(b.directory_id, n.directory_id) AS directory_id, coalesce(b.path, n.path) AS path_key,
         b.asset_id AS old_asset_id, n.size_bytes || ':' || n.mtime_ms AS fingerprint,
         CASE WHEN b.asset_id IS NULL THEN 'new'
              WHEN n.path IS NULL AND b.completed THEN 'removed'
              WHEN n.path IS NULL THEN 'kept'
              WHEN b.fingerprint = n.size_bytes || ':' || n.mtime_ms THEN 'unchanged'
              ELSE 'changed' END AS change_type
  FROM (SELECT m.*, s.completed FROM manifest_before m JOIN scans s ON s.directory_id = m.directory_id) b
  FULL JOIN (SELECT * FROM manifest_now WHERE path LIKE '%.mp4') n
    ON n.directory_id = b.directory_id AND n.path = b.path)
"""


def _day_ms(column: str) -> Column:
    """Epoch milliseconds of a calendar day, whatever the session time zone."""
    return F.unix_date(F.to_date(column)).cast("long") * 86_400_000


def _order_path(ext: Column) -> Column:
    return F.concat(
        F.lit("/d"), F.col("o_custkey").cast("string"), F.lit("/"), F.col("o_orderkey").cast("string"), ext
    )



def manifest_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spread_table(spark, sf_dir, "orders").where(F.col("o_orderpriority") != "1-URGENT")
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    path = _order_path(F.lit(".mp4"))
    return orders.select(
        F.col("o_orderkey").alias("asset_id"),
        F.col("o_custkey").alias("directory_id"),
        path.alias("path"),
        path_key(path).alias("path_key"),
        fingerprint(cents, _day_ms("o_orderdate")).alias("fingerprint"),
    )


def manifest_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spread_table(spark, sf_dir, "orders").where(F.col("o_orderstatus") != "F")
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    odd = (F.col("o_orderpriority") == "3-MEDIUM") & (F.col("o_orderstatus") == "O")
    return orders.select(
        F.col("o_custkey").alias("directory_id"),
        _order_path(F.when(odd, ".pdf").otherwise(".mp4")).alias("path"),
        (cents + F.when(F.col("o_orderpriority") == "5-LOW", 1).otherwise(0)).alias("size_bytes"),
        _day_ms("o_orderdate").cast("double").alias("mtime_ms"),
    )


def scans(spark: SparkSession, sf_dir: str, completed: Column) -> DataFrame:
    """``completed`` is an aggregate over the files of a directory."""
    now = manifest_now(spark, sf_dir)
    return now.groupBy("directory_id").agg(completed.alias("completed"))


# ---- results: the turns of a conversation are versions of one asset's result

RESULTS_SQL = """
results AS (
  SELECT conv_id * 100 + turn AS result_id, conv_id AS asset_id, text AS body, 'model-' || role AS model,
         CASE WHEN role = 'user' THEN 'failed' ELSE 'succeeded' END AS status,
         CASE WHEN role = 'user' AND turn > 0 THEN 'E' || turn END AS error_code,
         CASE WHEN role = 'user' THEN text END AS error_message,
         turn AS created_at
  FROM conversations)
"""


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = F.col("role") == "user"
    return table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("result_id"),
        F.col("conv_id").alias("asset_id"),
        F.col("text").alias("body"),
        F.concat(F.lit("model-"), F.col("role")).alias("model"),
        F.when(bad, "failed").otherwise("succeeded").alias("status"),
        F.when(bad & (F.col("turn") > 0), F.concat(F.lit("E"), F.col("turn").cast("string"))).alias("error_code"),
        F.when(bad, F.col("text")).alias("error_message"),
        F.col("turn").alias("created_at"),
    )
