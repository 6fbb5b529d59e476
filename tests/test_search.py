"""Search on a small catalogue, with and without the index."""

import math
import re

import pytest
from pyspark.sql import functions as F

from cuesift.operators.counting import count_matches
from cuesift.operators.matching import match_terms
from cuesift.operators.ranking import page_limit, result_page
from cuesift.operators.terms import load_terms, normalize_queries
from cuesift.operators.trigram import (
    GramIndex,
    gram_blocks,
    gram_frequencies,
    phrase_hits,
    scan_hits,
    segment_stats,
    trigram_postings,
    write_blocks,
)
from cuesift.plans.search import Catalogue, one_query, page_snippets, search, search_page, search_totals
from cuesift.session import cut_lineage
from cuesift.sources.text import ORDINAL_BITS


def library(spark, items, indexed=False):
    """``items``: (file name, tags, segments[, kind])."""
    assets, segments, tags, links = [], [], {}, []
    for i, item in enumerate(items, start=1):
        name, names, texts = item[:3]
        kind = item[3] if len(item) > 3 else "video"
        assets.append((i, 1, f"/d/{name}", name, ".mp4", kind, 1, 1, "none", 1))
        for n, text in enumerate(texts):
            segments.append(((i << ORDINAL_BITS) + n, i, "file", n, text, None, None))
        for tag in names:
            links.append((i, tags.setdefault(tag, len(tags) + 1)))
    assets = spark.createDataFrame(
        assets,
        "asset_id long, directory_id long, path string, file_name string, ext string, kind string, "
        "size_bytes long, mtime_ms long, extract_status string, updated_at long",
    )
    segments = spark.createDataFrame(
        segments,
        "segment_id long, asset_id long, source string, ordinal int, text string, start_ms long, end_ms long",
    )
    tags = spark.createDataFrame([(i, n, None) for n, i in tags.items()], "tag_id long, name string, color string")
    links = spark.createDataFrame(links, "asset_id long, tag_id long")
    postings = gram_blocks(segments, 3) if indexed else None
    return Catalogue(assets, segments, tags, links, postings)


@pytest.fixture(params=[False, True], ids=["scan", "index"])
def run(request, spark):
    def go(items, query, **options):
        found = library(spark, items, request.param)
        page = {k: options.pop(k) for k in ("limit", "offset") if k in options}
        result = search(found, one_query(spark, query), **options)
        rows = result_page(result.candidates, **page).orderBy("position").collect()
        return found, result, rows

    return go


def ids(outcome):
    return [r.asset_id for r in outcome[2]]


def test_names(run):
    assert ids(run([("探店第三期.mp4", [], []), ("无关素材.mp4", [], [])], "探店")) == [1]


def test_tags(run):
    rows = run([("a.mp4", ["探店"], []), ("b.mp4", [], [])], "探店")[2]
    assert [(r.asset_id, r.matched_in, r.tier) for r in rows] == [(1, ["tag"], 0)]


def test_text_and_snippets(run):
    found, result, rows = run([("a.mp4", [], ["今天去火锅店吃饭"]), ("b.mp4", [], ["无"])], "火锅店")
    assert [(r.asset_id, r.matched_in, r.tier, r.matched_terms) for r in rows] == [(1, ["segment"], 2, [])]
    hit = page_snippets(found, result).collect()
    assert [(h.snippet, [tuple(x) for x in h.highlights]) for h in hit] == [("今天去火锅店吃饭", [(3, 6)])]


def test_long_and_short_terms_together(run):
    items = [("a.mp4", [], ["剪辑师在探店"]), ("b.mp4", [], ["别的"])]
    found, result, rows = run(items, "剪辑师 探店")
    assert [(r.asset_id, r.segment_hits) for r in rows] == [(1, 1)]
    hits = page_snippets(found, result).collect()
    assert len(hits) == 1 and [tuple(x) for x in hits[0].highlights] == [(0, 3), (4, 6)]


def test_short_terms_alone_have_no_rank(run):
    rows = run([("a.mp4", [], ["去探店"]), ("b.mp4", [], ["剪辑师"])], "探店")[2]
    assert [(r.asset_id, r.best_rank) for r in rows] == [(1, None)]


@pytest.mark.parametrize("query, expected", [("100%", [1]), ("_", [3]), ("\\", [4]), ('"', [5])])
def test_characters_mean_themselves(run, query, expected):
    items = [("100%纯棉.mp4", [], []), ("1000纯棉.mp4", [], []), ("a_b.mp4", [], []), ("c\\d.mp4", [], []), ('e"f.mp4', [], [])]
    assert ids(run(items, query)) == expected


@pytest.mark.parametrize("query", ["NEAR", "a-b", "x AND y", 'q"uo', "col:val", "st*r", "(par)"])
def test_operators_of_a_query_language_are_text(run, query):
    items = [("x.mp4", [], [f"before {query} after"]), ("y.mp4", [], ["something else"])]
    assert 1 in ids(run(items, query))


def test_tiers(run):
    items = [("正文.mp4", [], ["去火锅店吧"]), ("火锅店.mp4", [], []), ("x.mp4", ["火锅店"], []), ("火锅店", [], [])]
    rows = run(items, "火锅店")[2]
    assert [(r.asset_id, r.tier) for r in rows] == [(3, 0), (4, 0), (2, 1), (1, 2)]


def test_more_matching_terms_rank_through_bm25(run):
    items = [("a.mp4", [], ["剪辑师"]), ("b.mp4", [], ["剪辑师和转场效果"]), ("c.mp4", [], ["无关的一段话"])]
    assert ids(run(items, "剪辑师 转场效果"))[0] == 2


def test_name_terms_count(run):
    items = [("探店.mp4", [], []), ("探店火锅.mp4", [], [])]
    assert ids(run(items, "探店 火锅")) == [2, 1]


def test_body_terms_on_request(run):
    items = [("a.mp4", [], ["剪辑师"]), ("b.mp4", [], ["剪辑师 探店"])]
    rows = run(items, "剪辑师 探店", count_body_terms=True)[2]
    assert [(r.asset_id, r.n_terms) for r in rows] == [(2, 2), (1, 1)]


def test_paging(run):
    items = [(f"探店{i}.mp4", [], []) for i in range(3)]
    assert ids(run(items, "探店", limit=2)) == [1, 2]
    found, result, rows = run(items, "探店", limit=2, offset=2)
    assert [r.asset_id for r in rows] == [3]
    assert search_totals(result).first().total == 3
    assert [page_limit(x) for x in (None, 0, -5, 7, 999)] == [30, 30, 30, 7, 999]


def test_page_carries_summaries(run):
    found, result, _ = run([("探店.mp4", ["b", "a"], []), ("探店2.mp4", [], [])], "探店")
    rows = search_page(found, result).orderBy("position").collect()
    assert [(r.file_name, [t.name for t in r.tags]) for r in rows] == [("探店.mp4", ["a", "b"]), ("探店2.mp4", [])]


def test_segments_per_asset_and_true_counts(run):
    items = [("a.mp4", [], [f"第{i}次去火锅店" for i in range(5)])]
    found, result, rows = run(items, "火锅店")
    assert rows[0].segment_hits == 5
    assert page_snippets(found, result, per_asset=2).count() == 2


def test_many_hits_hide_nothing(run):
    items = [("a.mp4", [], [f"火锅店{i}" for i in range(2500)]), ("b.mp4", [], ["火锅店"])]
    found, result, rows = run(items, "火锅店 火锅")
    assert {r.asset_id: r.segment_hits for r in rows} == {1: 2500, 2: 1}
    shown = page_snippets(found, result).groupBy("asset_id").count().collect()
    assert {r.asset_id: r["count"] for r in shown} == {1: 100, 2: 1}


def test_filters_apply_to_every_path(run):
    items = [("探店.mp4", ["火锅店"], ["火锅店"], "video"), ("探店.mp3", ["火锅店"], ["火锅店"], "audio")]
    assert ids(run(items, "探店 火锅店", kind="audio")) == [2]
    assert ids(run(items, "探店 火锅店", extract_status="done")) == []


def test_case_folding(run):
    assert ids(run([("A.MP4", [], []), ("b.mov", [], ["ÉCLAIR cake"])], "mp4 éclair")) == [1, 2]


def test_empty_query(run):
    found, result, rows = run([("a.mp4", [], ["x"])], "   ")
    assert rows == [] and result.queries.first().error_code == "SEARCH_QUERY_EMPTY"


# ---- the parts, against brute force

TEXTS = ["aaaa", "AAAAaaa b", "ab", "", "xaabaax aab", "探店火锅店探店", "火锅店", "a😀b😀a😀b😀", "The Theatre the", "\\E.\\Q*"]
TERMS = ["aaa", "aaaa", "aab", "火锅店", "探店", "b", "the", "😀b😀", "😀", "\\e.", "the theatre", "探店火锅店", "zzz"]


def brute(texts, terms):
    out = {}
    for i, text in enumerate(texts):
        low = text.lower()
        for term in terms:
            t = term.lower()
            n = sum(low[p : p + len(t)] == t for p in range(len(low) - len(t) + 1))
            if n:
                out[(t, i)] = n
    return out


@pytest.fixture
def small(spark):
    segments = spark.createDataFrame([(i, i % 3, t) for i, t in enumerate(TEXTS)], "segment_id long, asset_id long, text string")
    # each term is a query of its own; blanks are kept by asking for terms directly
    from cuesift.operators.terms import QueryTerms, _TERM_ROW

    rows = [(i, 0, t, len(t), "fts" if len(t) >= 3 else "like", t.lower(), t.lower()) for i, t in enumerate(TERMS)]
    table = spark.createDataFrame(rows, _TERM_ROW)
    return segments, QueryTerms(table, table.collect()), QueryTerms(table, None)


@pytest.mark.parametrize("literal_limit, many", [(64, False), (0, False), (64, True)], ids=["literal", "gram", "salted"])
def test_match_terms(small, literal_limit, many):
    segments, few, large = small
    terms = (large if many else few).of_labels()
    pairs = match_terms(segments, "text", "segment_id", terms, F.lower, literal_limit)
    got = [(r.folded, r.segment_id) for r in pairs.collect()]
    assert len(got) == len(set(got)) and set(got) == set(brute(TEXTS, TERMS))


@pytest.mark.parametrize("many", [False, True], ids=["few", "many"])
def test_phrases_and_counts(small, many):
    segments, few, large = small
    terms = (large if many else few).long()
    want = {k: v for k, v in brute(TEXTS, TERMS).items() if len(k[0]) >= 3}
    from_index = phrase_hits(gram_blocks(segments, 4), terms)
    scanned = scan_hits(match_terms(segments, "text", "segment_id", terms, F.lower))
    for hits in (from_index, scanned):
        assert {(r.folded, r.segment_id): r.tf for r in hits.collect()} == want


def test_stored_index(spark, small, tmp_path):
    segments, few, _ = small
    index = GramIndex(spark, str(tmp_path / "p"), buckets=4, per_block=5)
    index.build(segments)
    terms = few.long()
    kept = index.blocks(terms)
    assert kept.count() < index.blocks().count()
    got = {(r.folded, r.segment_id): r.tf for r in phrase_hits(kept, terms).collect()}
    assert got == {k: v for k, v in brute(TEXTS, TERMS).items() if len(k[0]) >= 3}
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(gram_bucket" in plan or "PartitionFilters: [gram_bucket" in plan
    assert "In(gram" in plan


def test_postings_hold_every_position(spark, small):
    segments, _, _ = small
    want = {}
    for i, text in enumerate(TEXTS):
        low = text.lower()
        for p in range(len(low) - 2):
            want.setdefault((low[p : p + 3], i), []).append(p)
    rows = trigram_postings(gram_blocks(segments, 4)).collect()
    assert {(r.gram, r.segment_id): r.positions for r in rows} == want and len(rows) == len(want)


def test_phrases_read_the_postings_once(spark, small):
    segments, few, _ = small
    blocks = cut_lineage(gram_blocks(segments))
    plan = phrase_hits(blocks, few.long())._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Scan ExistingRDD\[gram#\d+,block", plan)) == 1
    assert plan.count("Exchange hashpartitioning") == 1


def test_blocks_are_searched_where_they_are_made(spark, small):
    segments, few, _ = small
    segments = segments.unionByName(segments.where("segment_id < 3"))  # rows that come twice
    found = phrase_hits(gram_blocks(segments, 4), few.long())
    # the texts go to their blocks, the postings nowhere
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    stored = phrase_hits(cut_lineage(gram_blocks(segments, 4)), few.long())
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, stored.collect()))


def searched(index, query, spark):
    terms = load_terms(normalize_queries(one_query(spark, query))).long()
    return index.hits(terms), terms


def test_index_follows_its_segments(spark, tmp_path):
    def segments(**texts):
        rows = [(int(k[1:]) * 10, int(k[1:]), t) for k, t in texts.items()]
        return spark.createDataFrame(rows, "segment_id long, asset_id long, text string")

    def assets(*ids):
        return spark.createDataFrame([(i,) for i in ids], "asset_id long")

    def held(index):
        return sorted((r.folded, r.asset_id, r.tf) for r in searched(index, "alpha beta", spark)[0].collect())

    index = GramIndex(spark, str(tmp_path / "i"), buckets=4)
    index.build(segments(a1="alpha beta", a2="alpha alpha", a3="beta"))
    assert held(index) == [("alpha", 1, 1), ("alpha", 2, 2), ("beta", 1, 1), ("beta", 3, 1)]
    index.update(segments(a1="beta beta", a4="alpha"), assets(1, 4), 1)
    index.update(segments(), assets(3), 2)
    want = [("alpha", 2, 2), ("alpha", 4, 1), ("beta", 1, 2)]
    assert held(index) == want
    # a write without its marks does not count, and a repeated one replaces what it left
    write_blocks(gram_blocks(segments(a2="beta")), f"{index.path}/blocks/stamp=3", 4)
    assert held(index) == want
    index.update(segments(a2="gamma"), assets(2), 3)
    index.update(segments(a2="alpha"), assets(2), 3)
    want[0] = ("alpha", 2, 1)
    assert held(index) == want
    merged = index.compacted(str(tmp_path / "j"))
    assert held(merged) == want and merged.read().count() == index.read().count() < trigram_postings(index.blocks()).count()
    with pytest.raises(ValueError):
        index.update(segments(), assets(1), 0)


def test_changed_index_is_read_by_gram(spark, tmp_path):
    rows = [(i, i // 10, f"alpha{i} common words") for i in range(200)]
    segments = spark.createDataFrame(rows, "segment_id long, asset_id long, text string")
    index = GramIndex(spark, str(tmp_path / "i"), buckets=8)
    index.build(segments)
    some = segments.where("asset_id < 3")
    index.update(some, some.select("asset_id").distinct(), 1)
    for one in (index, index.compacted(str(tmp_path / "j"))):
        hits, terms = searched(one, "alpha7", spark)
        plan = hits._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [gram_bucket" in plan and "In(gram" in plan
        assert one.blocks(terms).select("gram").distinct().count() == 2
        assert len(hits.collect()) == 11


def test_search_through_a_changed_index(spark, tmp_path):
    found = library(spark, [("a.mp4", [], ["去火锅店"]), ("b.mp4", [], ["在家做饭"])])
    index = GramIndex(spark, str(tmp_path / "i"), buckets=4)
    index.build(found.segments)
    swapped = found.segments.withColumn("text", F.when(F.col("asset_id") == 1, "无").otherwise("新火锅店"))
    index.update(swapped, found.assets.select("asset_id"), 1)
    now = Catalogue(found.assets, swapped, found.tags, found.asset_tags, index)
    result = search(now, one_query(spark, "火锅店"), count_body_terms=True)
    assert [(r.asset_id, r.matched_terms) for r in result.candidates.collect()] == [(2, ["火锅店"])]
    assert [h.snippet for h in page_snippets(now, result).collect()] == ["新火锅店"]


def test_gram_frequencies(spark, small):
    segments, _, _ = small
    rows = gram_frequencies(trigram_postings(gram_blocks(segments))).where("segment_id = 0").collect()
    assert [(r.gram, r.tf) for r in rows] == [("aaa", 2)]


def test_bm25(spark):
    texts = ["alpha beta", "alpha alpha", "gamma delta epsilon", "zeta", "ab"]
    segments = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "segment_id long, asset_id long, text string")
    terms = load_terms(normalize_queries(one_query(spark, "alpha beta")))
    from cuesift.operators.recall import recall_ranked

    got = {r.segment_id: r.rank for r in recall_ranked(segments, terms).collect()}
    sizes = [max(len(t) - 2, 0) for t in texts]
    mean = sum(sizes) / len(sizes)

    def score(tf, n, size):
        idf = max(math.log((len(texts) - n + 0.5) / (n + 0.5)), 1e-6)
        return -idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))

    want = {0: score(1, 2, sizes[0]) + score(1, 1, sizes[0]), 1: score(2, 2, sizes[1])}
    assert got.keys() == want.keys()
    assert all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)
    assert segment_stats(segments).where("n_grams = 0").count() == 1


def test_search_plans_have_no_cross_join(spark):
    found = library(spark, [("探店.mp4", ["火锅店"], ["去火锅店探店"])], indexed=True)
    result = search(found, one_query(spark, "火锅店 探店"))
    for frame in (result.candidates, search_page(found, result), page_snippets(found, result)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan
        assert "Python" not in plan


def test_batch_equals_single(spark):
    items = [("探店.mp4", ["剪辑师"], ["去火锅店", "在家"]), ("剪辑师.mp4", [], ["探店 火锅店"]), ("c.mp4", [], ["火锅"])]
    found = library(spark, items)
    asked = ["火锅店", "探店 剪辑师", "", "火锅"]
    batch = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")
    rows = result_page(search(found, batch).candidates).collect()
    for i, query in enumerate(asked):
        alone = result_page(search(found, one_query(spark, query)).candidates).collect()
        pick = lambda r: (r.position, r.asset_id, r.tier, r.n_terms, r.segment_hits)
        assert sorted(map(pick, alone)) == sorted(pick(r) for r in rows if r.query_id == i)


def test_many_terms_are_found_where_the_texts_are_read(spark):
    """More terms than literals, of every length: counts with overlaps, nothing joined or shuffled."""
    import random

    from cuesift.operators.matching import count_terms
    from cuesift.operators.recall import term_hits
    from cuesift.operators.terms import Terms

    draw = random.Random(4)
    texts = ["".join(draw.choices("abAß店𝄞", k=draw.randint(0, 40))) for _ in range(60)] + ["", "aaaa", None]
    texts += ["b" * 5000, "店" * 3]
    terms = sorted({"".join(draw.choices("abß店𝄞", k=draw.randint(1, 9))) for _ in range(300)} | {"aa", "店店"})
    segments = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "segment_id long, asset_id long, text string")
    table = spark.createDataFrame([(0, t, t) for t in terms], "query_id long, term string, folded string")
    wanted = Terms(table, table.collect())
    found = count_terms(segments, "text", wanted, F.lower, ["segment_id"])
    want = brute([t or "" for t in texts], terms)
    assert {(r.folded, r.segment_id): r.tf for r in found.collect()} == want and found.count() == len(want)
    pairs = match_terms(segments, "text", "segment_id", wanted, F.lower, keep=["segment_id"])
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    long = Terms(table.where("length(term) > 2"), [r for r in wanted.rows if len(r.term) > 2])
    assert {(r.folded, r.segment_id): r.tf for r in term_hits(segments, long).collect()} == {
        k: n for k, n in want.items() if len(k[0]) > 2
    }


def test_hits_are_gathered_by_asset_before_they_are_returned_to_queries(spark):
    from cuesift.operators.recall import recall_like, recall_ranked

    segments = spark.createDataFrame([(0, 0, "an apple"), (1, 0, "a pear")], "segment_id long, asset_id long, text string")
    asked = load_terms(normalize_queries(spark.createDataFrame([(1, "an apple"), (2, "pe pear")], "query_id long, query string")))
    for frame in (recall_ranked(segments, asked), recall_like(segments, asked)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(asset_id" in plan and "hashpartitioning(query_id" not in plan
    assert {(r.query_id, r.segment_id) for r in recall_like(segments, asked).collect()} == {(1, 0), (2, 1)}


def test_an_index_is_written_without_shuffling_its_postings(spark, small):
    segments, few, _ = small
    blocks = gram_blocks(segments, 4)
    plan = blocks._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan
    # a search ships flat arrays, not a struct for each entry
    plan = phrase_hits(cut_lineage(blocks), few.long())._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"FlatMapGroupsInArrow.*match\(gram#\d+, segment_id#\d+L?, asset_id", plan) or "flatten(entries" in plan


def test_compaction_ships_only_small_blocks(spark, tmp_path):
    """Full blocks stay where they are; marks of assets reach the rows as bits."""
    rows = [(i, i // 10, f"alpha{i} common words") for i in range(400)]
    segments = spark.createDataFrame([*rows, (999, None, "alpha of nobody")], "segment_id long, asset_id long, text string")
    index = GramIndex(spark, str(tmp_path / "i"), buckets=4, per_block=50)
    index.build(segments)
    for stamp in range(1, 5):
        some = segments.where(F.col("asset_id") == stamp).withColumn("text", F.lit(f"beta{stamp}"))
        index.update(some, some.select("asset_id").distinct(), stamp)
    live = index._live()
    assert "Exchange" not in live._jdf.queryExecution().executedPlan().toString()
    merged = index.compacted(str(tmp_path / "j"))
    pick = lambda one: sorted(map(str, one.read().select("gram", "segment_id", "asset_id", "n_grams", "positions").collect()))
    assert pick(merged) == pick(index)
    assert merged.blocks().select("block").distinct().count() < index.blocks().select("stamp", "block").distinct().count()
    one_row = merged.blocks().groupBy("gram", "block").count()
    assert one_row.where("count > 1").isEmpty()


def test_hits_reach_their_task_without_null_lists(spark, monkeypatch):
    """Spark asks for a batch's size at each row, and after null lists it counts from the last list again."""
    sent, kind = [], type(spark.range(0))
    to_python = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, *a, **b: sent.append(self) or to_python(self, *a, **b))
    terms = load_terms(normalize_queries(spark.createDataFrame([(1, "wolf ab"), (2, "fox")], "query_id long, query string")))
    hits = [(asset, asset * 10 + n, "wolf", -1.0) for asset in range(20) for n in range(3)]
    scored = spark.createDataFrame(hits, "asset_id long, segment_id long, folded string, score double")
    pairs = spark.createDataFrame([(3, 30, "ab"), (50, 500, "ab")], "asset_id long, segment_id long, folded string")
    labels = spark.createDataFrame(
        [(2, 3, ["x"], 1), (1, 3, [], 0), (2, 60, None, 2), (1, 7, ["y", None], None)],
        "query_id long, asset_id long, names array<string>, tier int",
    )
    got = {(r.query_id, r.asset_id): tuple(r)[2:] for r in count_matches(scored, pairs, labels, terms).collect()}
    want = {(1, asset): (3, -1.0, None, None) for asset in range(20)}
    want |= {(1, 3): (3, -1.0, [], 0), (2, 3): (None, None, ["x"], 1), (1, 7): (3, -1.0, ["y", None], None)}
    assert got == want | {(2, 60): (None, None, None, 2), (1, 50): (1, None, None, None)}
    rows = sent[-1].where("kind <> 0")
    assert rows.count() == 62 and rows.where("label.names IS NULL").count() == 0


def test_hits_of_a_segment_reach_their_task_as_one_row(spark, monkeypatch):
    sent, kind = [], type(spark.range(0))
    to_python = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, *a, **b: sent.append(self) or to_python(self, *a, **b))
    asked = spark.createDataFrame([(1, "wolf bear ab cd"), (2, "bear cd")], "query_id long, query string")
    terms = load_terms(normalize_queries(asked))
    # a row that comes twice, a term that nobody asks for, ids that are missing
    hits = [(a, a * 10, t, s) for a in range(9) for t, s in (("wolf", -1.0), ("bear", -2.0), ("lynx", -9.0))]
    hits += [(0, 0, "wolf", -1.0), (None, 70, "bear", -3.0), (None, None, "bear", -5.0)]
    scored = spark.createDataFrame(hits, "asset_id long, segment_id long, folded string, score double").coalesce(1)
    pairs = spark.createDataFrame(
        [(a, a * 10 + n, t) for a in (3, 50) for n in (0, 1) for t in ("ab", "cd")],
        "asset_id long, segment_id long, folded string",
    ).coalesce(1)
    labels = spark.createDataFrame([], "query_id long, asset_id long, names array<string>, tier int")
    got = {(r.query_id, r.asset_id): (r.segment_hits, r.best_rank) for r in count_matches(scored, pairs, labels, terms).collect()}
    want = {(query, a): (1, rank) for query, rank in ((1, -3.0), (2, -2.0)) for a in range(9)}
    want |= {(1, 0): (1, -4.0), (1, 3): (2, -3.0), (2, 3): (2, -2.0), (1, 50): (2, None), (2, 50): (2, None)}
    assert got == want | {(1, None): (2, -5.0), (2, None): (2, -5.0)}
    # a row for each segment of the long and of the short terms, a row for each hit before
    assert sent[-1].where("kind <> 0").count() == 9 + 2 + 4


def test_short_hits_are_counted_in_the_task_of_their_asset(spark):
    from cuesift.operators.recall import like_pairs, recall_like
    from cuesift.operators.terms import QueryTerms
    from cuesift.plans.search import _like_counts

    rows = [(s, s // 4, "ab cd" if s % 3 else "ab") for s in range(40)] + [(2, 0, "cd"), (99, None, "ab"), (None, None, "ab")]
    segments = spark.createDataFrame(rows, "segment_id long, asset_id long, text string")
    asked = spark.createDataFrame([(n, f"{w} wolf") for n, w in enumerate(["ab", "cd", "ab cd", "xy"])], "query_id long, query string")
    terms = load_terms(normalize_queries(asked))
    for some in (terms, QueryTerms(terms.table, None)):
        want = recall_like(segments, some).groupBy("query_id", "asset_id").count()
        got = _like_counts(like_pairs(segments, some.short()), some)
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, want.collect())))
        # where the terms are few, segments returned to their queries are not shuffled
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert ("hashpartitioning(query_id" in plan) == (some.rows is None)
