"""First pages without ranking everything, and pages that go on after a row."""

import random

import pytest
from pyspark.sql import functions as F

from cuesift.operators.bm25 import score_hits
from cuesift.operators.bounded import counting_hits, label_leaders
from cuesift.operators.catalogue import list_assets, list_segments
from cuesift.operators.ranking import last_rows, next_page, result_page
from cuesift.operators.recall import term_hits
from cuesift.operators.terms import load_terms, normalize_queries
from cuesift.operators.trigram import segment_stats
from cuesift.plans.search import search, search_after, search_page, search_top
from cuesift.session import cut_lineage
from test_search import library

WORDS = ["common", "often", "rare", "seldom", "unique", "of", "in"]
WEIGHTS = [60, 30, 4, 3, 1, 20, 10]


@pytest.fixture(scope="module")
def found(spark):
    rng = random.Random(4)
    items = []
    for i in range(240):
        texts = [" ".join(rng.choices(WORDS, WEIGHTS, k=rng.randint(1, 12))) for _ in range(rng.randint(0, 4))]
        name = rng.choice(["rare.mp4", "clip.mp4", f"common {i}.mp4"]) if i % 9 == 0 else f"{i}.mp4"
        items.append((name, ["often"] if i % 31 == 0 else [], texts, rng.choice(["video", "audio"])))
    made = library(spark, items)
    return made


ASKED = ["common rare", "often seldom unique", "common", "of", "of rare", "rare common often in", "nothing", ""]


def batch(spark):
    return spark.createDataFrame(list(enumerate(ASKED)), "query_id long, query string")


@pytest.mark.parametrize("limit, offset, kind", [(3, 0, None), (5, 7, "video"), (30, 0, None), (500, 0, None)])
def test_top_equals_the_page_of_all(spark, found, limit, offset, kind):
    asked = batch(spark)
    candidates = search(found, asked, kind=kind).candidates
    rounded = candidates.withColumn("best_rank", -F.round(-F.col("best_rank"), 6) + F.lit(0.0))
    want = result_page(rounded, limit, offset)
    got = search_top(found, asked, limit, offset, kind=kind, digits=6)
    columns = sorted(want.columns)
    rows = lambda df: sorted(map(str, df.select(*columns).collect()))
    assert sorted(got.columns) == columns and rows(got) == rows(want)


def test_top_counts_fewer_hits(spark, found):
    asked = load_terms(normalize_queries(batch(spark).where("query_id IN (0, 1)")))
    terms = asked.long()
    hits = term_hits(found.segments, terms)
    scored = cut_lineage(score_hits(hits, segment_stats(found.segments), terms))
    nobody = spark.createDataFrame([], "query_id long, asset_id long")
    every = terms.asked_by(scored, "segment_id").count()
    counted = counting_hits(scored, terms, nobody, 3).count()
    assert 0 < counted < every / 3
    assert counting_hits(scored, terms, nobody, 10_000).count() == every


def test_leaders_meet_the_hits_once(spark, found):
    """Hits of candidates by name and tag all stay, and the hits are neither met nor grouped once per case."""
    asked = load_terms(normalize_queries(batch(spark).where("query_id IN (0, 1)")))
    terms = asked.long()
    scored = cut_lineage(score_hits(term_hits(found.segments, terms), segment_stats(found.segments), terms))
    every = terms.asked_by(scored, "segment_id").select("query_id", "asset_id", "segment_id", "score")
    leaders = cut_lineage(every.select("query_id", "asset_id").distinct().where("asset_id % 2 = 0"))
    hits = counting_hits(scored, terms, leaders, 3)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" not in plan and "LeftAnti" not in plan
    led = lambda df: sorted(map(tuple, df.where("asset_id % 2 = 0").collect()))
    assert led(hits) == led(every) and hits.count() < every.count()


def test_leaders_keep_whole_ties(spark):
    rows = [(0, i, 0 if i < 2 else 1, 2 if i < 4 else 1) for i in range(10)]
    labels = spark.createDataFrame(rows, "query_id long, asset_id long, tier int, n_terms int")
    kept = lambda n: sorted(r.asset_id for r in label_leaders(labels, n).collect())
    assert kept(1) == [0, 1] and kept(3) == [0, 1, 2, 3] and kept(5) == list(range(10))


def test_pages_go_on_after_the_last_row(spark, found):
    asked = batch(spark)
    candidates = cut_lineage(
        search(found, asked).candidates.withColumn("best_rank", -F.round(-F.col("best_rank"), 9) + F.lit(0.0))
    )
    pick = lambda page: sorted((r.query_id, r.position, r.asset_id) for r in page.collect())
    page, n = result_page(candidates, 7), 0
    while rows := pick(page):
        assert rows == pick(result_page(candidates, 7, 7 * n))
        page, n = next_page(candidates, cut_lineage(last_rows(page)), 7), n + 1
    assert n > 10 and pick(result_page(candidates, 7, 7 * n)) == []


def test_page_cost_does_not_depend_on_depth(spark, found):
    candidates = search(found, batch(spark)).candidates
    plans = set()
    for position in (30, 3000):
        last = spark.createDataFrame(
            [(0, 2, 0, -0.5, 7, position)],
            "query_id long, tier int, n_terms int, best_rank double, asset_id long, position int",
        )
        plan = next_page(cut_lineage(candidates), last)._jdf.queryExecution().executedPlan().toString()
        assert "WindowGroupLimit" in plan and "<= 30" in plan
        plans.add("".join(c for c in plan if not c.isdigit()))
    assert len(plans) == 1


def test_search_after_adds_summaries(spark, found):
    result = search(found, batch(spark).where("query_id = 2"))
    page = search_page(found, result, limit=4)
    rows = search_after(found, result, last_rows(page), 4).orderBy("position").collect()
    assert [r.position for r in rows] == [5, 6, 7, 8]
    want = search_page(found, result, limit=4, offset=4).orderBy("position").collect()
    assert [(r.asset_id, r.file_name) for r in rows] == [(r.asset_id, r.file_name) for r in want]


def test_listings_go_on_after_the_last_row(spark, found):
    seen, last = [], None
    while rows := list_assets(found.assets, 50, after=last).collect():
        seen += [(r.file_name, r.asset_id) for r in rows]
        last = seen[-1]
    assert len(seen) == 240 and seen == sorted(seen)
    one = found.segments.groupBy("asset_id").count().orderBy(F.desc("count")).first()
    first = list_segments(found.segments, one.asset_id, 2).collect()
    rest = list_segments(found.segments, one.asset_id, 10, after=first[-1].ordinal).collect()
    assert [r.ordinal for r in first + rest] == list(range(one["count"]))
