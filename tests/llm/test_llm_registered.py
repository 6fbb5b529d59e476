"""Registered corpus queries against their SQL, and the pipeline against brute force."""

import collections
import glob
import os

import duckdb
import numpy as np
import public_tokenizers
import pytest
import zlib
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from checks.compare import digest
from cuesift.llm import registry
from test_llm_exact_mixing import filled
from test_llm_near_and_benchmark import expected_components, expected_hits

SF_DIR = "/root/testdata/sf0.001"

NOT_DOCUMENTS = ("op11_vector_codes", "op12_vector_duplicates", "op13_prefix_trie")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def test_one_query_for_each_operator():
    numbers = [name.split("_")[0] for name in registry.queries()]
    assert numbers == [f"op{n}" for n in range(1, 14)]
    assert set(registry.oracles()) <= set(registry.queries())


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, database, name):
    frame = registry.queries()[name](spark, SF_DIR)
    rows = frame.collect()
    if name not in NOT_DOCUMENTS:
        assert len(rows) == 200
    if name in registry.oracles():
        cursor = database.execute(registry.oracles()[name])
        columns = [c[0] for c in cursor.description]
        assert sorted(columns) == sorted(frame.columns)
        assert digest(frame.columns, rows) == digest(columns, cursor.fetchall())


def test_stages_match_brute_force(spark):
    docs = registry.table(spark, SF_DIR, "documents")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["drop_toxic", "drop_near_duplicates", "drop_contaminated", "mix_sources", "tokenize"]
    stage = dict(corpus_pipeline.STAGES)
    pairs = lambda frame: [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]

    clean = stage["drop_toxic"](spark, docs, SF_DIR).cache()
    rated = registry.op2_toxicity(spark, SF_DIR).collect()
    assert clean.columns == docs.columns
    assert {d for d, _ in pairs(clean)} == {r.doc_id for r in rated if not r.predicted}

    single = stage["drop_near_duplicates"](spark, clean, SF_DIR).cache()
    want = {r[0] for r in expected_components(pairs(clean)) if r[3]}
    assert single.columns == docs.columns and collections.Counter(d for d, _ in pairs(single)) == dict.fromkeys(want, 1)

    items = [(r.item_id, r.text) for r in registry.table(spark, SF_DIR, "benchmark").collect()]
    fresh = stage["drop_contaminated"](spark, single, SF_DIR).cache()
    want = {r[0] for r in expected_hits(pairs(single), items) if not r[5]}
    assert fresh.columns == docs.columns and {d for d, _ in pairs(fresh)} == want and fresh.count() == len(want)

    mixed = stage["mix_sources"](spark, fresh, SF_DIR).cache()
    words = lambda frame: {
        r.source: r.n for r in frame.groupBy("source").agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))).alias("n")).collect()
    }
    sizes = words(fresh)
    target = filled([sizes[s] for s in sorted(sizes)], [1 + i % 3 for i in range(len(sizes))])
    assert mixed.columns == docs.columns
    assert words(mixed) == {s: round(t) for s, t in zip(sorted(sizes), target) if round(t)}

    tokens = stage["tokenize"](spark, mixed, SF_DIR).collect()
    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    model.encode_special_tokens = True
    made = collections.Counter()
    for doc_id, text in pairs(mixed):
        ids = [*model.encode(text, add_special_tokens=False).ids, 0]
        made[doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert made == collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in tokens)


def test_run_goes_through_all_stages(spark):
    rows = corpus_pipeline.run(spark, SF_DIR)
    assert {"doc_id", "start", "n_tokens", "ids_crc32"} <= set(rows.columns) and rows.count() > 50


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_take_odd_and_empty_rows(spark, odd, empty, name, stage):
    columns = registry.table(spark, SF_DIR, "documents").columns
    for docs in (odd, empty):
        rows = stage(spark, docs, SF_DIR)
        assert rows.count() <= 3 * docs.count()
        if name != "tokenize":
            assert rows.columns == docs.columns and set(columns) <= set(rows.columns)
