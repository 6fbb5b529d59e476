"""Folders of files: walked, scanned, imported and stored."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuesift import schemas
from cuesift.plans.ingest import import_texts, scan_folders, store_import
from cuesift.session import scratch_folder
from cuesift.sources.buckets import BucketStore
from cuesift.sources.walk import file_system, walk

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


# every document as a file: some names hidden, some of a kind that is not supported
_FILES_SQL = """
files AS (
  SELECT doc_id, CAST(substr(source, 4) AS BIGINT) AS directory_id, coalesce(text, '') AS text,
         doc_id % 7 <> 0 AS supported,
         '/' || source || '/' || CASE WHEN doc_id % 3 = 0 THEN '.deep/' || lang || '/' ELSE '' END
             || CASE WHEN doc_id % 5 = 0 THEN '.' ELSE '' END || doc_id || CASE WHEN doc_id % 7 = 0 THEN '.bin' ELSE '.txt' END AS path
  FROM documents)
"""


def _made_folder(spark, sf_dir):
    """Write the documents as files below the shared folder; its path and its roots."""
    folder = scratch_folder(spark, "files")
    number = F.col("doc_id")
    when = lambda test, text: F.when(test, text).otherwise(F.lit(""))
    path = F.concat(
        F.lit("/"),
        "source",
        F.lit("/"),
        when(number % 3 == 0, F.concat(F.lit(".deep/"), "lang", F.lit("/"))),
        when(number % 5 == 0, F.lit(".")),
        number.cast("string"),
        F.when(number % 7 == 0, ".bin").otherwise(".txt"),
    )

    def write(batches):
        import pyarrow as pa

        store, inside = file_system(folder)
        made = set()
        for batch in batches:
            for name, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist()):
                place = name.rpartition("/")[0]
                if place not in made:
                    store.create_dir(f"{inside}{place}", recursive=True)
                    made.add(place)
                with store.open_output_stream(f"{inside}{name}") as out:
                    out.write((text or "").encode())
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    docs = a.documents(spark, sf_dir)
    docs.select(path.alias("path"), "text").mapInArrow(write, "n long").agg(F.sum("n")).collect()
    roots = docs.select(
        F.substring("source", 4, 20).cast("long").alias("directory_id"),
        F.concat(F.lit(f"{folder}/"), "source").alias("path"),
    ).distinct()
    gone = spark.createDataFrame([(-1, f"{folder}/gone")], "directory_id long, path string")
    return folder, roots.unionByName(gone)


def _inside(folder):
    """The path below the made folder, whether or not it names its store."""
    return F.substring_index("path", folder.rpartition("/")[2], -1)


@check(
    "walk_folder",
    f"""WITH {_FILES_SQL}
    SELECT directory_id, path, CAST(strlen(text) AS BIGINT) AS size_bytes, false AS bad, true AS completed FROM files
    UNION ALL SELECT -1, '/gone', NULL, true, false""",
)
def walk_folder(spark, sf_dir):
    """Every file below many roots, hidden ones too, and the root that is not there."""
    folder, roots = _made_folder(spark, sf_dir)
    seen = walk(roots)
    rows = seen.listing.select("directory_id", _inside(folder).alias("path"), "size_bytes", F.col("error").isNotNull().alias("bad"))
    return rows.join(seen.scans, "directory_id")


def _no_assets(spark):
    return spark.createDataFrame([], schemas.ASSETS)


@check(
    "scan_folder",
    f"""WITH {_FILES_SQL}
    SELECT directory_id, count(*) AS visited, count(*) FILTER (WHERE supported) AS indexed, 0::BIGINT AS updated, 0::BIGINT AS unchanged,
           count(*) FILTER (WHERE NOT supported) AS skipped_unsupported, 0::BIGINT AS removed FROM files GROUP BY 1
    UNION ALL SELECT -1, 1, 0, 0, 0, 0, 0""",
)
def scan_folder_query(spark, sf_dir):
    """What the first scan of the folders counts."""
    _, roots = _made_folder(spark, sf_dir)
    return scan_folders(_no_assets(spark), roots, 5).summary


@check(
    "rescan_folder",
    f"""WITH {_FILES_SQL}
    SELECT path, CASE WHEN supported THEN 'unchanged' ELSE 'skipped' END AS change_type FROM files WHERE supported
    UNION ALL SELECT '/src' || directory_id || '/' || doc_id || '.mp3', 'removed' FROM files""",
)
def rescan_folder(spark, sf_dir):
    """A second scan over a catalogue in which every file also had a recording that is gone."""
    folder, roots = _made_folder(spark, sf_dir)
    first = scan_folders(_no_assets(spark), roots, 5).assets
    # the recordings are entered by hand, beside the files the scan has found
    shift = 1 << 40
    lost = a.documents(spark, sf_dir).select(
        (F.col("doc_id") + shift).alias("asset_id"),
        F.substring("source", 4, 20).cast("long").alias("directory_id"),
        F.concat(F.lit(f"{folder}/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".mp3")).alias("path"),
    )
    lost = lost.withColumn("path_key", F.col("path")).withColumn("fingerprint", F.lit("0:0"))
    diff = scan_folders(first.unionByName(lost, allowMissingColumns=True), roots, 6).diff
    return diff.select(_inside(folder).alias("path"), "change_type")


@check(
    "import_texts",
    f"""WITH {a.SEGMENTS_SQL}, {_FILES_SQL}
    SELECT path, ordinal, segments.text FROM segments JOIN files ON asset_id = doc_id WHERE supported""",
)
def import_texts_query(spark, sf_dir):
    """From folders of files to stored segments: walked, read by name, parsed, written by bucket."""
    folder, roots = _made_folder(spark, sf_dir)
    assets = scan_folders(_no_assets(spark), roots, 5).assets
    done = import_texts(
        assets, None, spark.createDataFrame([], schemas.SEGMENTS), spark.createDataFrame([], schemas.RUNS), 6
    )
    store = BucketStore(spark, scratch_folder(spark, "segments"), schemas.SEGMENTS, "asset_id", 16)
    store.build(spark.createDataFrame([], schemas.SEGMENTS))
    store_import(done, store)
    named = done.assets.where("extract_status = 'done'").select("asset_id", _inside(folder).alias("path"))
    return store.read().join(named, "asset_id").select("path", "ordinal", "text")
