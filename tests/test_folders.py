"""Walks, reads by name, tables in buckets, id sets and open JSON."""

import os

import pytest
from pyspark.sql import functions as F

from cuesift import schemas
from cuesift.functions.payloads import json_field, read_jobs
from cuesift.operators.catalogue import remove_directories
from cuesift.operators.ids import IdSet
from cuesift.plans.ingest import import_texts, scan_folders, store_import
from cuesift.sources.buckets import BucketStore
from cuesift.sources.files import read_bytes, read_named
from cuesift.sources.walk import list_entries, walk

ROOTS = "directory_id long, path string"


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "root"
    for name in ("a.txt", ".hidden.txt", "_under.txt", "sub/b.txt", "sub/.dots/deep/c.srt", "closed/d.txt", "x.bin"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(name)
    (root / "empty").mkdir()
    os.symlink(root, root / "sub" / "loop")
    os.symlink(root / "a.txt", root / "link.txt")
    return root


def closed_lister(closed):
    def lister(path):
        if path == closed:
            raise PermissionError(13, "Permission denied")
        return list_entries(path)

    return lister


def test_walk_sees_hidden_names_and_passes_links_over(spark, tree):
    roots = spark.createDataFrame([(1, str(tree)), (2, str(tree / "sub")), (3, str(tree / "none")), (4, str(tree / "a.txt"))], ROOTS)
    seen = walk(roots)
    found = sorted((r.directory_id, r.path.removeprefix(str(tree))) for r in seen.listing.where("error IS NULL").collect())
    below = ["/sub/.dots/deep/c.srt", "/sub/b.txt"]
    mine = ["/.hidden.txt", "/_under.txt", "/a.txt", "/closed/d.txt", *below, "/x.bin"]
    assert found == [(1, p) for p in mine] + [(2, p) for p in below]
    facts = seen.listing.where("path LIKE '%/a.txt' AND directory_id = 1").first()
    assert facts.size_bytes == 5 and abs(facts.mtime_ms / 1000 - os.stat(tree / "a.txt").st_mtime) < 1
    assert {r.directory_id: r.completed for r in seen.scans.collect()} == {1: True, 2: True, 3: False, 4: False}
    assert sorted(r.directory_id for r in seen.unread.collect()) == [3, 4]
    assert seen.listing.where("error IS NOT NULL").count() == 2


def test_an_unread_directory_loses_nothing(spark, tree):
    roots = spark.createDataFrame([(1, str(tree)), (2, str(tree / "none"))], ROOTS)
    empty = spark.createDataFrame([], schemas.ASSETS)
    first = scan_folders(empty, roots, 5)
    assert first.assets.count() == 6 and first.errors.count() == 1
    lost = first.assets.limit(1).withColumn("asset_id", F.lit(99).cast("long")).withColumn("directory_id", F.lit(2).cast("long"))
    (tree / "sub" / "b.txt").unlink()
    (tree / "closed" / "d.txt").unlink()
    (tree / "a.txt").write_text("longer than before")
    again = scan_folders(first.assets.unionByName(lost), roots, 6, closed_lister(str(tree / "closed")))
    change = {r.path.removeprefix(str(tree)): r.change_type for r in again.diff.where("directory_id = 1").collect()}
    assert change.pop("/closed/d.txt") == "kept" and change.pop("/sub/b.txt") == "removed" and change.pop("/a.txt") == "changed"
    assert set(change.values()) == {"unchanged"}
    assert again.diff.where("directory_id = 2").first().change_type == "kept"
    assert again.assets.count() == 6
    assert sorted(r.error for r in again.errors.collect()) == ["No such file or directory", "Permission denied"]


def test_only_named_files_are_read(spark, tree):
    reads = spark.sparkContext.accumulator(0)

    def counting(path):
        reads.add(1)
        return read_bytes(path)

    rows = [(i, str(tree / n)) for i, n in enumerate(["a.txt", "sub/b.txt", "none.txt", ".hidden.txt"])]
    got = read_named(spark.createDataFrame(rows, "asset_id long, path string"), counting).collect()
    assert {r.asset_id: r.content for r in got} == {0: "a.txt", 1: "sub/b.txt", 2: None, 3: ".hidden.txt"}
    assert "No such file" in next(r.read_error for r in got if r.asset_id == 2)
    assert reads.value == 4


def test_import_reads_each_wanted_file_once_and_stores_it(spark, tree, tmp_path):
    reads = spark.sparkContext.accumulator(0)

    def counting(path):
        reads.add(1)
        return read_bytes(path)

    assets = scan_folders(spark.createDataFrame([], schemas.ASSETS), spark.createDataFrame([(1, str(tree))], ROOTS), 5).assets
    (tree / "closed" / "d.txt").unlink()
    store = BucketStore(spark, str(tmp_path / "s"), schemas.SEGMENTS, "asset_id", 4)
    store.build(spark.createDataFrame([], schemas.SEGMENTS))
    done = import_texts(assets, None, store.read(), spark.createDataFrame([], schemas.RUNS), 6, read_one=counting)
    store_import(done, store)
    assert reads.value == 6
    names = {r.asset_id: r.path.removeprefix(str(tree)) for r in assets.collect()}
    want = {"/a.txt": "a.txt", "/.hidden.txt": ".hidden.txt", "/_under.txt": "_under.txt", "/sub/b.txt": "sub/b.txt"}
    assert {names[r.asset_id]: r.text for r in store.read().collect()} == want
    state = {names[r.asset_id]: r.extract_status for r in done.assets.collect()}
    assert state.pop("/closed/d.txt") == "failed" and set(state.values()) == {"done"}
    failed = done.outcomes.where("error_code IS NOT NULL").first()
    assert failed.error_message.startswith("text file could not be read: ") and "No such file" in failed.error_message
    # another file changes: it alone is read, and the failed one tried again
    (tree / "a.txt").write_text("new\nlines")
    assets = scan_folders(done.assets, spark.createDataFrame([(1, str(tree))], ROOTS), 7).assets
    runs = done.runs.select(*[c.split()[0] for c in schemas.RUNS.split(", ")])
    before = reads.value
    store_import(import_texts(assets, None, store.read(), runs, 8, read_one=counting), store)
    assert reads.value - before == 1
    got = sorted(r.text for r in store.read().collect())
    assert got == sorted(["new", "lines", ".hidden.txt", "_under.txt", "sub/b.txt"])


def test_a_store_rewrites_only_touched_folders(spark, tmp_path):
    rows = spark.range(200).select(F.col("id").alias("k"), F.concat(F.lit("v"), "id").alias("v"))
    store = BucketStore(spark, str(tmp_path / "t"), "k long, v string", "k", 16)
    store.build(rows)
    age = lambda: {f.parent.name: f.stat().st_mtime_ns for f in (tmp_path / "t").glob("bucket=*/*.parquet")}
    before = age()
    assert len(before) == 16 and store.read().count() == 200
    touched = rows.where("k IN (3, 4, 5)")
    fresh = spark.createDataFrame([(3, "x"), (3, "y"), (1000, "z")], "k long, v string")
    for _ in range(2):  # the second time changes nothing
        store.replace(fresh, touched)
        got = sorted(map(tuple, store.read().collect()))
        want = sorted([(i, f"v{i}") for i in range(200) if i not in (3, 4, 5)] + [(3, "x"), (3, "y"), (1000, "z")])
        assert got == want
    changed = {b for b, t in age().items() if before[b] != t}
    assert 1 <= len(changed) <= 4
    assert "Exchange hashpartitioning" not in plan_of(store.kept(touched.select("k")))
    assert [tuple(r) for r in store.of(fresh.where("k = 1000")).collect()] == [(1000, "z")]
    store.replace(fresh.limit(0), store.read())
    assert store.read().count() == 0


def test_id_sets(spark):
    ids = [0, 1, 7, 8, 32767, 32768, 32769, 65536, 10**12, -1, -5, -40000]
    gone = spark.createDataFrame([(i,) for i in [*ids, 7, None]], "asset_id long")
    every = sorted({i + d for i in ids for d in (-2, -1, 0, 1, 2, 8)})
    rows = spark.createDataFrame([(i, "x") for i in [*every, None]], "asset_id long, v string")
    kept = IdSet(gone, "asset_id").absent_from(rows)
    assert kept.columns == ["asset_id", "v"]
    got = sorted((r.asset_id for r in kept.collect()), key=lambda i: (i is None, i or 0))
    assert got == [i for i in every if i not in ids] + [None]
    assert "Exchange hashpartitioning" not in plan_of(kept)
    within = IdSet(gone, "asset_id").present_in(rows)
    assert sorted(r.asset_id for r in within.collect()) == sorted(ids) and within.columns == kept.columns
    wide = IdSet(gone, "asset_id")
    wide.bitmaps = None
    assert sorted(map(str, wide.absent_from(rows).collect())) == sorted(map(str, kept.collect()))
    assert IdSet(gone.limit(0), "asset_id").absent_from(rows).count() == rows.count()


def test_a_cascade_shuffles_no_child(spark):
    dirs = spark.createDataFrame([(1,), (2,)], "directory_id long")
    assets = spark.range(1000).select(F.col("id").alias("asset_id"), (F.col("id") % 2 + 1).alias("directory_id"))
    segments = spark.range(5000).select(F.col("id").alias("segment_id"), (F.col("id") % 1000).alias("asset_id"))
    left = remove_directories(dirs, assets, {"segments": segments}, dirs.where("directory_id = 1"))
    assert "Exchange hashpartitioning" not in plan_of(left.children["segments"])
    assert left.children["segments"].count() == 2500


def test_open_json(spark):
    texts = ['{"a": 1, "b": {"c": "x"}}', '{"a": "no"}', "[1, 2]", "{broken", "", None, "null", '"text"']
    jobs = read_jobs(spark.createDataFrame(list(enumerate(texts)), "job_id long, result string"))
    rows = jobs.select(
        "job_id",
        F.col("result").isNotNull().alias("ok"),
        json_field(F.col("result"), "$.a", "bigint").alias("a"),
        json_field(F.col("result"), "$.b.c", "string").alias("c"),
        json_field(F.col("result"), "$[1]", "bigint").alias("second"),
    )
    got = {r.job_id: tuple(r)[1:] for r in rows.collect()}
    assert got[0] == (True, 1, "x", None) and got[1] == (True, None, None, None) and got[2] == (True, None, None, 2)
    assert all(not got[i][0] for i in (3, 4, 5)) and got[6][0] and got[7][0]
