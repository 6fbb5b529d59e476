"""Manifests, imports, stored tables and the streaming flows."""

import pytest
from pyspark.sql import functions as F

from cuesift import schemas
from cuesift.operators.catalogue import mark_scanned, register_directories, remove_directories
from cuesift.operators.ids import number_rows
from cuesift.operators.manifest import diff_manifest, listed_files, scan_errors, scan_summary
from cuesift.plans.ingest import apply_scan, import_texts, scan_folder
from cuesift.sources.changes import ChangeTable, read_stamps
from cuesift.sources.text import segment_id, segment_texts
from cuesift.streaming.ingest import import_failures, retry_paths, stream_texts
from cuesift.streaming.status import active_status, compact_job_states, job_states, newest_states, stream_job_changes, stream_job_states

LISTING = "directory_id long, path string, size_bytes long, mtime_ms double, error string"


def listing(spark, *files):
    rows = [(*f, None) if len(f) == 4 else f for f in files]
    return spark.createDataFrame(rows, LISTING)


def scans(spark, *done):
    return spark.createDataFrame(list(done), "directory_id long, completed boolean")


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], schemas.ASSETS)


def state(assets):
    return {r.path: (r.asset_id, r.fingerprint) for r in assets.collect()}


def test_scans(spark, empty):
    first = apply_scan(empty, listing(spark, (1, "/a/x.mp4", 1, 1.9), (1, "/a/y.txt", 2, 2.0), (1, "/a/z.exe", 3, 3.0), (2, "/b/q.mp3", 4, 4.0)), scans(spark, (1, True), (2, True)), 100)
    summary = {r.directory_id: r for r in first.summary.collect()}
    assert (summary[1].visited, summary[1].indexed, summary[1].skipped_unsupported) == (3, 2, 1)
    before = state(first.assets)
    assert sorted(i for i, _ in before.values()) == [1, 2, 3] and before["/a/x.mp4"][1] == "1:1"
    # the first directory again: one changed, one gone, one new; the second is not walked
    second = apply_scan(first.assets, listing(spark, (1, "/a/x.mp4", 9, 1.0), (1, "/a/n.wav", 5, 5.0)), scans(spark, (1, True)), 200)
    after = state(second.assets)
    assert after.keys() == {"/a/x.mp4", "/a/n.wav", "/b/q.mp3"}
    assert after["/a/x.mp4"] == (before["/a/x.mp4"][0], "9:1") and after["/a/n.wav"][0] == 4
    row = second.summary.first()
    assert (row.visited, row.indexed, row.updated, row.unchanged, row.removed) == (2, 1, 1, 0, 1)
    # the same listing again changes nothing
    third = apply_scan(second.assets, listing(spark, (1, "/a/x.mp4", 9, 1.0), (1, "/a/n.wav", 5, 5.0)), scans(spark, (1, True)), 300)
    assert state(third.assets) == after and third.summary.first().unchanged == 2


def test_a_cancelled_scan_removes_nothing(spark, empty):
    first = apply_scan(empty, listing(spark, (1, "/a/x.mp4", 1, 1.0), (1, "/a/y.mp4", 1, 1.0)), scans(spark, (1, True)), 1)
    second = apply_scan(first.assets, listing(spark, (1, "/a/x.mp4", 2, 1.0)), scans(spark, (1, False)), 2)
    assert {p: f for p, (_, f) in state(second.assets).items()} == {"/a/x.mp4": "2:1", "/a/y.mp4": "1:1"}
    assert second.summary.first().removed == 0


def test_errors_are_counted_and_all_reported(spark, empty):
    rows = listing(spark, (1, "/a/x.mp4", 1, 1.0), *[(1, f"/a/bad{i:02}", None, None, "EACCES") for i in range(60)])
    files = listed_files(rows)
    diff = diff_manifest(empty.select("asset_id", "directory_id", "path_key", "path", "fingerprint"), files, scans(spark, (1, True)))
    assert scan_summary(rows, files, diff).first().visited == 61
    assert scan_errors(rows).count() == 60
    assert [r.path for r in scan_errors(rows, per_directory=2).orderBy("path").collect()] == ["/a/bad00", "/a/bad01"]


def test_dense_ids(spark):
    rows = spark.range(1000).select(F.concat(F.lit("k"), "id").alias("k"))
    got = [r.n for r in number_rows(rows, ["k"], "n", F.lit(10), buckets=7).collect()]
    assert sorted(got) == list(range(11, 1011))
    again = number_rows(rows.repartition(3), ["k"], "n", F.lit(10), buckets=7)
    assert again.exceptAll(number_rows(rows, ["k"], "n", F.lit(10), buckets=7)).count() == 0


def test_directories(spark):
    known = spark.createDataFrame([("/a",)], "path_key string")
    asked = [(1, "/a/", None), (2, "/b/./", " "), (3, "/b", "again"), (4, "  ", None), (5, "/c/d", "名")]
    out = register_directories(known, spark.createDataFrame(asked, "request_id long, path string, label string"))
    got = {r.request_id: (r.path_key, r.error_code) for r in out.collect()}
    assert got == {1: ("/a", "DIRECTORY_DUPLICATE"), 2: ("/b", None), 3: ("/b", "DIRECTORY_DUPLICATE"), 4: ("", "DIRECTORY_NOT_FOUND"), 5: ("/c/d", None)}
    dirs = spark.createDataFrame([(1, 5), (2, None)], "directory_id long, last_scanned_at long")
    times = spark.createDataFrame([(1, 7), (1, 6)], "directory_id long, scanned_at long")
    assert {r.directory_id: r.last_scanned_at for r in mark_scanned(dirs, times).collect()} == {1: 7, 2: None}


def test_removing_a_directory_takes_its_rows(spark):
    dirs = spark.createDataFrame([(1,), (2,), (3,)], "directory_id long")
    assets = spark.createDataFrame([(10, 1), (11, 1), (20, 2)], "asset_id long, directory_id long")
    segments = spark.createDataFrame([(100, 10), (200, 20)], "segment_id long, asset_id long")
    left = remove_directories(dirs, assets, {"segments": segments}, dirs.where("directory_id <> 2"))
    assert [r.asset_id for r in left.assets.collect()] == [20]
    assert [r.segment_id for r in left.children["segments"].collect()] == [200]
    assert {r.directory_id: r.removed_assets for r in left.removed.collect()} == {1: 2, 3: 0}


def asset_rows(spark, *rows):
    """``(id, ext, size, fingerprint)``."""
    full = [(i, 1, f"/d/{i}{e}", f"/d/{i}{e}", f"{i}{e}", e, "text", s, 1, f, "none", None, None, None, 1, 1) for i, e, s, f in rows]
    return spark.createDataFrame(full, schemas.ASSETS)


def test_import(spark):
    srt = "1\n00:00:01,000 --> 00:00:02,000\n軟體\n\n2\n00:00:03,000 --> 00:00:04,000\nb\n"
    assets = asset_rows(spark, (1, ".srt", 10, "10:1"), (2, ".txt", 17 * 2**20, "x"), (3, ".md", 5, "5:1"), (4, ".mp4", 5, "5:1"), (5, ".srt", 5, "5:1"))
    contents = spark.createDataFrame([(1, srt), (2, "large"), (5, "no cues")], "asset_id long, content string")
    old = spark.createDataFrame([(9, 1, "file", 0, "old", None, None), (8, 3, "file", 0, "kept", None, None)], schemas.SEGMENTS)
    runs = spark.createDataFrame([], schemas.RUNS)
    done = import_texts(assets, contents, old, runs, 50, script_table={"體": "体"})
    assert sorted((r.asset_id, r.ordinal, r.text) for r in done.segments.collect()) == [(1, 0, "軟体"), (1, 1, "b"), (3, 0, "kept")]
    after = {r.asset_id: (r.extract_status, r.extract_error, r.extracted_at) for r in done.assets.collect()}
    assert after[1] == ("done", None, 50) and after[5] == ("done", None, 50) and after[4] == ("none", None, None)
    assert after[2] == ("failed", "text file too large: 17 MB", None) and after[3][0] == "failed"
    made = {r.asset_id: r.status for r in done.runs.collect()}
    assert made == {1: "succeeded", 2: "failed", 3: "failed", 5: "succeeded"}
    # nothing changed: successes are reused, failures tried again
    runs = done.runs.select(*[c.split()[0] for c in schemas.RUNS.split(", ")])
    again = import_texts(done.assets, contents, done.segments, runs, 60)
    assert {r.asset_id for r in again.outcomes.collect()} == {2, 3}
    assert {r.asset_id for r in again.reused.collect()} == {1, 5}
    # another script preference misses the cache
    other = import_texts(done.assets, contents, done.segments, runs, 60, script="traditional")
    assert {r.asset_id for r in other.outcomes.collect()} == {1, 2, 3, 5}
    # so does a changed file, which then replaces the old segments
    changed = done.assets.withColumn("fingerprint", F.when(F.col("asset_id") == 1, "new").otherwise(F.col("fingerprint")))
    newer = import_texts(changed, contents.withColumn("content", F.lit("1\n00:00:01,000 --> 00:00:02,000\nnew\n")), done.segments, runs, 70)
    assert [r.text for r in newer.segments.where("asset_id = 1").collect()] == ["new"]


def test_every_file_is_parsed_once(spark):
    n = 30
    assets = spark.range(n).select(
        F.col("id").alias("asset_id"), F.lit(".txt").alias("ext"), F.lit(4).cast("long").alias("size_bytes"),
        F.lit("f").alias("fingerprint"), F.lit("none").alias("extract_status"),
    )
    full = spark.createDataFrame([], schemas.ASSETS)
    assets = full.unionByName(assets, allowMissingColumns=True)
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def content(_):
        read.add(1)
        return "a\nb\n"

    contents = spark.range(n).select(F.col("id").alias("asset_id"), content.asNondeterministic()("id").alias("content"))
    done = import_texts(assets, contents, spark.createDataFrame([], schemas.SEGMENTS), spark.createDataFrame([], schemas.RUNS), 5)
    assert done.segments.count() == 2 * n and done.runs.count() == n
    assert done.assets.where("extract_status = 'done'").count() == n and done.outcomes.count() == n
    assert read.value == n


def test_scan_a_folder(spark, empty, tmp_path):
    (tmp_path / "a.txt").write_text("x")
    (tmp_path / "b.bin").write_text("x")
    result = scan_folder(spark, empty, 7, str(tmp_path), 1)
    assert [(r.file_name, r.directory_id, r.asset_id) for r in result.assets.collect()] == [("a.txt", 7, 1)]
    assert result.summary.first().skipped_unsupported == 1


def test_replacing_by_key(spark, tmp_path):
    table = ChangeTable(spark, str(tmp_path / "t"), "k long, v string", "k")
    assert table.read().count() == 0
    rows = lambda *items: spark.createDataFrame(list(items), "k long, v string")
    table.replace(rows((1, "a"), (2, "b"), (2, "bb"), (3, "c")), rows((1, ""), (2, ""), (3, "")), 0)
    table.replace(rows((2, "B")), rows((2, ""), (3, "")), 1)
    assert sorted(map(tuple, table.read().collect())) == [(1, "a"), (2, "B")]
    table.replace(rows((2, "B")), rows((2, ""), (3, "")), 1)  # the same write again
    assert sorted(map(tuple, table.read().collect())) == [(1, "a"), (2, "B")]
    small = table.compacted(str(tmp_path / "small"), 1)
    assert sorted(map(tuple, small.read().collect())) == [(1, "a"), (2, "B")]
    small.replace(rows((1, "A")), rows((1, "")), 2)
    assert sorted(map(tuple, small.read().collect())) == [(1, "A"), (2, "B")]
    table.replace(rows().limit(0), rows((1, ""), (2, "")), 2)
    assert table.read().count() == 0


def test_a_write_costs_what_it_brings(spark, tmp_path):
    table = ChangeTable(spark, str(tmp_path / "t"), "k long, v string", "k")
    many = spark.range(5000).select(F.col("id").alias("k"), F.lit("v").alias("v"))
    table.replace(many, many, 0)
    table.replace(many.where("k = 3"), many.where("k = 3"), 1)
    assert spark.read.parquet(str(tmp_path / "t")).where("stamp = 1").count() == 2
    assert table.read().count() == 5000


def test_segment_ids_beyond_their_range_stop_the_job(spark):
    ids = spark.createDataFrame([(0, 0), (1, 5), ((1 << 39) - 1, (1 << 24) - 1)], "a long, o int")
    assert len({r[0] for r in ids.select(segment_id(F.col("a"), F.col("o"))).collect()}) == 3
    for a, o in ((1 << 39, 0), (1 << 40, 0), (-1, 0), (1, 1 << 24)):
        bad = spark.createDataFrame([(a, o)], "a long, o int")
        with pytest.raises(Exception, match="has no segment id"):
            bad.select(segment_id(F.col("a"), F.col("o"))).collect()


def test_streamed_files_equal_the_batch(spark, tmp_path):
    root, store = tmp_path / "in", ChangeTable(spark, str(tmp_path / "t"), schemas.SEGMENTS, "asset_id")
    root.mkdir()
    paths = {1: root / "a.srt", 2: root / "b.txt", 3: root / "c.bin"}
    paths[1].write_text("1\n00:00:01,000 --> 00:00:02,000\none\n")
    paths[2].write_text("x\ny\n")
    paths[3].write_text("no")
    early, large = root / "e.txt", root / "f.txt"
    early.write_text("early\n")
    large.write_text("z" * 5000)
    assets = spark.createDataFrame([*[(i, str(p)) for i, p in paths.items()], (6, str(large))], "asset_id long, path string")
    failures = str(tmp_path / "failures")
    run = lambda: stream_texts(spark, str(root), assets, store, failures, str(tmp_path / "progress"), max_bytes=4000).awaitTermination()
    run()
    files = spark.createDataFrame([(1, ".srt", paths[1].read_text()), (2, ".txt", "x\ny\n")], "asset_id long, ext string, content string")
    key = lambda frame: sorted((r.segment_id, r.text, r.start_ms or -1) for r in frame.collect())
    assert key(store.read()) == key(segment_texts(files))
    bad = {r.path.rsplit("/", 1)[1]: r.error for r in import_failures(spark, failures).collect()}
    assert bad == {"c.bin": "UNSUPPORTED_FORMAT", "e.txt": "ASSET_NOT_FOUND", "f.txt": "FILE_TOO_LARGE"}
    late = root / "d.txt"
    late.write_text("late\n")
    assets = assets.unionByName(spark.createDataFrame([(4, str(late)), (5, str(early))], assets.schema))
    run()
    assert [r.text for r in store.read().where("asset_id = 4").collect()] == ["late"]
    assert store.read().count() == 4
    assert [r.asset_id for r in retry_paths(spark, failures, assets).collect()] == [5]


def test_streamed_job_states_equal_the_batch(spark, tmp_path):
    schema = "job_id long, type string, status string, target_id long, event_id long"
    batches = [
        [(1, "extract", "queued", 10, 1), (2, "extract", "queued", 11, 2), (3, "scan", "queued", 10, 3)],
        [(1, "extract", "running", 10, 4), (2, "extract", "succeeded", 11, 5), (1, "extract", "queued", 10, 1)],
    ]
    path = str(tmp_path / "t")
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        events = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        stream_job_states(events, path, str(tmp_path / "progress")).awaitTermination()
    whole = spark.createDataFrame(batches[0] + batches[1], schema)
    columns = ["job_id", "status", "event_id"]
    pick = lambda frame: sorted(tuple(r) for r in frame.select(*columns).collect())
    assert pick(job_states(spark, path)) == pick(newest_states(whole))
    assert [tuple(r) for r in active_status(job_states(spark, path)).collect()] == [(10, "running")]
    compact_job_states(spark, path, str(tmp_path / "small"))
    assert pick(job_states(spark, str(tmp_path / "small"))) == pick(newest_states(whole))


def test_keyed_state_passes_on_only_what_changes(spark, tmp_path):
    """Five micro-batches with late and repeated events, against the batch result."""
    schema = "job_id long, type string, status string, target_id long, event_id long"
    batches = [
        [(1, "extract", "queued", 10, 1), (2, "extract", "queued", 11, 2), (3, "scan", "queued", 10, 3)],
        [(1, "extract", "running", 10, 4), (1, "extract", "queued", 10, 1)],
        [(2, "extract", "queued", 11, 2), (3, "scan", "queued", 10, 3)],
        [(1, "extract", "succeeded", 10, 9), (1, "extract", "failed", 10, 8), (2, "extract", "running", 11, 7)],
        [(1, "extract", "failed", 10, 8), (2, "extract", "canceled", 11, 5), (4, "scan", "queued", 12, 6)],
    ]
    path, root = str(tmp_path / "t"), str(tmp_path / "in")
    for number, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(root)
        events = spark.readStream.schema(schema).parquet(root)
        stream_job_changes(events, path, str(tmp_path / "progress")).awaitTermination()
    whole = spark.createDataFrame([e for batch in batches for e in batch], schema)
    pick = lambda frame: sorted(tuple(r) for r in frame.select("job_id", "status", "event_id").collect())
    assert pick(job_states(spark, path)) == pick(newest_states(whole))
    stored = read_stamps(spark, path, schema).groupBy("stamp").count().collect()
    assert sorted(r["count"] for r in stored) == [1, 1, 2, 3]  # the third batch changed nothing


def test_micro_batches_have_more_files_with_more_rows(spark, monkeypatch):
    from checks import streams

    monkeypatch.setattr(streams, "_FILE_ROWS", 10)
    rows = spark.range(0, 300, 1, 2).withColumnRenamed("id", "doc_id")
    seen = []

    def look(batch, number):
        found = batch.collect()
        seen.append((len({r.file for r in found}), {r.doc_id for r in found}))

    arriving = streams._arriving(spark, "texts", (rows, 2, "doc_id"), (rows, 3, "doc_id"))
    arriving = arriving.select("doc_id", F.input_file_name().alias("file"))
    arriving.writeStream.foreachBatch(look).trigger(availableNow=True).start().awaitTermination()
    assert len(seen) == 5 and {n for n, _ in seen} != {1} and len({n for n, _ in seen}) == 1
    assert sum(len(ids) for _, ids in seen[:2]) == sum(len(ids) for _, ids in seen[2:]) == 300


def test_slow_rows_are_dealt_to_tasks(spark):
    from cuesift.session import deal

    rows = spark.range(0, 500, 1, 1)
    assert deal(rows, "id", 10).rdd.getNumPartitions() == 50
