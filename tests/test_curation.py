"""Keywords, tags, results, statuses and quality checks."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cuesift.operators import quality, tagging
from cuesift.operators.keywords import HAN, drop_fragments, eligible_words, ngram_stats, pick_keywords, suggest_keywords
from cuesift.operators.progress import download_progress, running
from cuesift.operators.results import current_results, last_failures, mark_current, save_results
from cuesift.operators.status import active_conflicts, derive_status, status_drift
from cuesift.operators.transform import asset_texts, prompt_gate, text_parts, transform_texts

SIDES = "天地人风云雨雪山水花草木"


def surround(word, times):
    """The word between changing neighbours, one line each."""
    n = len(SIDES)
    return [f"{SIDES[i % n]}{word}{SIDES[(i * 5 + 1) % n]}" for i in range(times)]


def segments_of(spark, lines, asset=1):
    rows = [(asset, i, line) for i, line in enumerate(lines)]
    return spark.createDataFrame(rows, "asset_id long, ordinal int, text string")


def keywords(spark, lines, limit=12):
    words = drop_fragments(eligible_words(ngram_stats(segments_of(spark, lines), HAN)))
    rows = pick_keywords(words, limit).orderBy("position").collect()
    return [(r.word, r.frequency) for r in rows]


def test_a_frequent_word_is_found(spark):
    assert ("火锅店", 10) in keywords(spark, surround("火锅店", 10))


def test_rare_and_empty_text(spark):
    assert keywords(spark, ["今天去吃火锅店"]) == []


def test_fragments_of_a_word_are_removed(spark):
    found = [w for w, _ in keywords(spark, surround("阿姆罗", 12))]
    assert "阿姆罗" in found and not {"阿姆", "姆罗"} & set(found)


def test_an_independent_shorter_word_is_kept(spark):
    assert "火锅" in [w for w, _ in keywords(spark, surround("火锅", 20) + surround("火锅店", 5))]


@pytest.mark.parametrize("word", ["啊啊", "就是", "hello", "2024", "说，话"])
def test_what_is_no_word(spark, word):
    assert word not in [w for w, _ in keywords(spark, surround(word, 10))]


def test_order_and_limit(spark):
    lines = surround("火锅店", 20) + surround("剪辑师", 6)
    found = [w for w, _ in keywords(spark, lines)]
    assert found.index("火锅店") < found.index("剪辑师")
    many = [line for a, b in zip("甲乙丙丁戊己庚", "子丑寅卯辰巳午") for line in surround(a + b, 9)]
    assert [f for _, f in keywords(spark, many, limit=5)] == [9] * 5


def greedy(words, limit):
    picked = []
    for word, _, _ in sorted(words, key=lambda w: (-w[1], -len(w[0]), w[2])):
        if len(picked) < limit and not any(word in p or p in word for p in picked):
            picked.append(word)
    return picked


def test_greedy_choice_in_several_rounds(spark):
    # the best words of asset 1 all contain the first one, so one round is not enough
    hard = [("火锅", 1000, 0)] + [(f"{chr(0x5000 + i)}火锅", 900 - i, i + 1) for i in range(60)]
    hard += [(chr(0x6000 + 2 * i) + chr(0x6001 + 2 * i), 5, 100 + i) for i in range(20)]
    easy = [("探店", 9, 1), ("店主", 8, 2), ("探店主", 7, 3)]
    rows = [(1, *w) for w in hard] + [(2, *w) for w in easy] + [(3, "火锅", 3, 1)] + [(3, f"{chr(0x5000 + i)}火锅", 2, i) for i in range(30)]
    words = spark.createDataFrame(rows, "asset_id long, word string, frequency long, first_seen long")
    got = {}
    for r in pick_keywords(words, 12, window=8).orderBy("asset_id", "position").collect():
        got.setdefault(r.asset_id, []).append(r.word)
    assert got == {1: greedy(hard, 12), 2: greedy(easy, 12), 3: ["火锅"]}


def test_ngrams_against_brute_force(spark):
    lines = surround("火锅店", 7) + ["火锅，火锅店a火锅", "店店店店", "说 火锅"]
    want = Counter()
    left, right = {}, {}
    for line in lines:
        run = "".join(c if "一" <= c <= "鿿" else " " for c in line).split()
        for part in run:
            for i in range(len(part)):
                for size in (2, 3, 4):
                    if i + size <= len(part):
                        word = part[i : i + size]
                        want[word] += 1
                        if i:
                            left.setdefault(word, set()).add(part[i - 1])
                        if i + size < len(part):
                            right.setdefault(word, set()).add(part[i + size])
    rows = ngram_stats(segments_of(spark, lines), HAN).collect()
    assert {r.word: r.frequency for r in rows} == want
    assert all(r.left_varied == (len(left.get(r.word, ())) > 1) for r in rows)
    assert all(r.right_varied == (len(right.get(r.word, ())) > 1) for r in rows)


def test_suggestions_leave_out_existing_tags_by_spelling(spark):
    segments = segments_of(spark, surround("火锅店", 10))
    tags = spark.createDataFrame([(5, "火锅店")], "tag_id long, name string")
    links = spark.createDataFrame([(1, 5)], "asset_id long, tag_id long")
    with_tag = [r.word for r in suggest_keywords(segments, links, tags).collect()]
    without = [r.word for r in suggest_keywords(segments, links.where("false"), tags).collect()]
    assert "火锅店" in without and set(without) - set(with_tag) == {"火锅店"}


# ---- tags

REQUEST = "request_id long, asset_id long, name string, color string, source string, created_at long"


@pytest.fixture
def tables(spark):
    assets = spark.createDataFrame([(1,), (2,)], "asset_id long")
    tags = spark.createDataFrame([(7, "ＭＰ４", "mp4", "red")], "tag_id long, name string, name_key string, color string")
    links = spark.createDataFrame([(1, 7)], "asset_id long, tag_id long")
    return assets, tags, links


def test_linking(spark, tables):
    asked = [
        (1, 1, "mp4", "blue", "manual", 0),
        (2, 2, "MP4", "blue", "manual", 0),
        (3, 2, " 美食 ", "green", "manual", 0),
        (4, 2, "美食", None, "manual", 0),
        (5, 9, "新词", None, "manual", 0),
        (6, 1, "   ", None, "manual", 0),
        (7, 1, "x" * 51, None, "manual", 0),
        (8, 1, "ＦＯＯ", None, "manual", 0),
        (9, 2, "foo", None, "polished", 0),
    ]
    out = tagging.link_tags(*tables, spark.createDataFrame(asked, REQUEST))
    rows = {r.request_id: r for r in out.requests.collect()}
    got = {i: (r.error_code, r.already_linked, r.tag_created, r.tag_name) for i, r in rows.items()}
    assert got == {
        1: (None, True, False, "ＭＰ４"),
        2: (None, False, False, "ＭＰ４"),
        3: (None, False, True, "美食"),
        4: (None, True, False, "美食"),
        5: ("ASSET_NOT_FOUND", None, None, None),
        6: ("TAG_NAME_INVALID", None, None, None),
        7: ("TAG_NAME_INVALID", None, None, None),
        8: (None, False, True, "ＦＯＯ"),
        9: (None, False, False, "ＦＯＯ"),
    }
    assert {(r.name, r.name_key, r.color) for r in out.new_tags.collect()} == {("美食", "美食", "green"), ("ＦＯＯ", "foo", None)}
    assert {(r.asset_id, r.source) for r in out.new_links.collect()} == {(2, "manual"), (1, "manual"), (2, "polished")}
    assert out.new_links.count() == 4


def test_archiving(spark, tables):
    asked = [(1, 1, "mp4", 0), (2, 1, "火锅", 0), (3, 1, " 火锅 ", 0), (4, 1, "", 0), (5, 1, "火锅　店", 0), (6, 1, "Foo", 0), (7, 1, "foo", 0), (8, 9, "x", 0)]
    batch = spark.createDataFrame(asked, "request_id long, asset_id long, name string, created_at long")
    out = tagging.archive_keywords(*tables, batch)
    got = {r.request_id: r.bucket for r in out.requests.collect()}
    assert got == {1: "already", 2: "linked", 4: "invalid", 5: "linked", 6: "linked", 7: "already", 8: "missing"}
    assert {r.source for r in out.new_links.collect()} == {"extracted"}


def test_usage_orphans_and_unlinking(spark, tables):
    assets, tags, links = tables
    tags = tags.unionByName(spark.createDataFrame([(8, "空", "空", None)], tags.schema))
    assert [(r.name, r.usage_count) for r in tagging.tag_usage(tags, links).collect()] == [("空", 0), ("ＭＰ４", 1)]
    assert [r.tag_id for r in tagging.orphan_tags(tags, links).collect()] == [8]
    assert [r.tag_id for r in tagging.prune_orphan_tags(tags, links).collect()] == [7]
    removal = spark.createDataFrame([(1, 7), (1, 8)], "asset_id long, tag_id long")
    assert tagging.unlink_tags(links, removal).count() == 0


# ---- results and statuses


def test_results(spark):
    rows = [
        (1, 1, "old", "succeeded", None, None, 1),
        (2, 1, "new", "succeeded", None, None, 2),
        (3, 1, "", "failed", "E", "why", 3),
        (4, 2, "", "failed", None, None, 4),
    ]
    results = spark.createDataFrame(
        rows, "result_id long, asset_id long, body string, status string, error_code string, error_message string, created_at long"
    )
    assert [(r.asset_id, r.body) for r in current_results(results).collect()] == [(1, "new")]
    assert {r.result_id for r in mark_current(results).where("is_current").collect()} == {2}
    assert sorted(tuple(r) for r in last_failures(results).collect()) == [(1, "E", "why", 3), (2, "UNKNOWN", "", 4)]


def test_statuses(spark):
    assets = spark.createDataFrame([(i, s) for i, s in enumerate(["none", "running", "running", "running", "done", "pending", "running"])], "asset_id long, extract_status string")
    jobs = spark.createDataFrame(
        [(1, "extract", "queued", 1), (2, "extract", "running", 2), (3, "scan", "running", 3), (4, "extract", "failed", 4), (5, "extract", "queued", 6), (6, "extract", "running", 6)],
        "job_id long, type string, status string, target_id long",
    )
    runs = spark.createDataFrame([(1, 2, "succeeded"), (2, 3, "failed"), (3, 4, "failed"), (4, 4, "succeeded"), (5, 5, "partial")], "run_id long, asset_id long, status string")
    got = {r.asset_id: r.derived_status for r in derive_status(assets, jobs, runs).collect()}
    assert got == {0: "none", 1: "pending", 2: "running", 3: "failed", 4: "done", 5: "failed", 6: "running"}
    assert {r.asset_id for r in status_drift(assets, jobs, runs).collect()} == {1, 3, 5}
    assert [r.job_id for r in active_conflicts(jobs).collect()] == [6]


def test_gate_and_texts(spark):
    assets = spark.createDataFrame([(1, "a.mp4"), (2, "b.mp4"), (3, "c.mp4")], "asset_id long, file_name string")
    rows = [(10, 1, 1, "二"), (11, 1, 0, "一😀"), (20, 2, 0, "x" * 60_000), (21, 2, 1, "y" * 60_000)]
    segments = spark.createDataFrame(rows, "segment_id long, asset_id long, ordinal int, text string")
    wanted = spark.createDataFrame([(1,), (2,), (3,), (4,)], "asset_id long")
    got = {r.asset_id: (r.input_chars, r.gate_reason) for r in prompt_gate(assets, segments, wanted).collect()}
    assert got == {1: (5, None), 2: (120_001, "POLISH_INPUT_TOO_LARGE"), 3: (0, "EXTRACTION_NO_CONTENT"), 4: (0, "ASSET_NOT_FOUND")}
    assert [(r.asset_id, r.text) for r in asset_texts(segments).collect()] == [(1, "一😀\n二")]
    parts = {(r.asset_id, r.part): r.text for r in text_parts(segments, per_part=1).collect()}
    assert parts == {(1, 0): "一😀", (1, 1): "二", (2, 0): "x" * 60_000, (2, 1): "y" * 60_000}
    assert {r.asset_id: len(r.text) for r in text_parts(segments).collect()} == {1: 4, 2: 120_001}


def test_saved_results_get_new_ids(spark):
    schema = "result_id long, asset_id long, body string, model string, status string"
    history = spark.createDataFrame([(7, 1, "old", "m", "succeeded"), (9, 2, "only", "m", "succeeded")], schema)
    rows = spark.createDataFrame([(1, "new", "m", "succeeded"), (2, "", "m", "failed"), (3, "x", "m", "succeeded")], "asset_id long, body string, model string, status string")
    saved = save_results(history, rows, 5).collect()
    assert sorted(r.result_id for r in saved) == [10, 11, 12] and {r.created_at for r in saved} == {5}
    every = history.unionByName(save_results(history, rows, 5).drop("created_at"))
    assert {(r.asset_id, r.body) for r in current_results(every).collect()} == {(1, "new"), (2, "only"), (3, "x")}
    assert save_results(history.limit(0), rows, 5).count() == 3


def test_transform_outcomes(spark):
    def service(prompt):
        if prompt == "boom":
            raise ValueError("broken")
        return {"ok": {"body": " fine ", "input_tokens": 3, "model": "m2"}, "no": {"body": "x", "stop_reason": "refusal"}, "cut": {"body": "x", "stop_reason": "max_tokens"}, "empty": {"body": " "}}[prompt]

    ready = spark.createDataFrame(list(enumerate(["ok", "no", "cut", "empty", "boom"])), "asset_id long, prompt string").withColumn("input_chars", F.lit(1).cast("long"))
    rows = {r.asset_id: r for r in transform_texts(ready, service, "m1").collect()}
    assert [rows[i].status for i in range(5)] == ["succeeded"] + ["failed"] * 4
    assert [rows[i].error_code for i in range(5)] == [None, "CREDENTIALS_UPSTREAM", "POLISH_INPUT_TOO_LARGE", "CREDENTIALS_UPSTREAM", "CREDENTIALS_UPSTREAM"]
    assert (rows[0].body, rows[0].model, rows[0].input_tokens, rows[4].error_message) == ("fine", "m2", 3, "broken")


def test_integrity(spark):
    child = spark.createDataFrame([(1, 1), (2, 9), (3, 9), (4, None)], "i long, p long")
    parent = spark.createDataFrame([(1,)], "p long")
    checks = [
        quality.missing_parents("fk", child, "p", parent, "p"),
        quality.repeated_keys("key", child, ["p"]),
        quality.unexpected_values("values", child.select(F.col("p").cast("string").alias("s")), "s", ["1"]),
    ]
    assert {r.check_name: r.violations for r in quality.integrity_report(checks).collect()} == {"fk": 2, "key": 1, "values": 3}


def test_running_totals_across_spans(spark):
    rows = [(k, i, (i * 7) % 11) for k in (1, 2) for i in range(50)]
    frame = spark.createDataFrame(rows, "k long, i long, v long")
    for combine, plain in ((F.sum, sum), (F.max, max)):
        got = {(r.k, r.i): r.out for r in running(frame, ["k"], "i", "v", "out", combine, span=8).collect()}
        assert got == {(k, i): plain((j * 7) % 11 for j in range(i + 1)) for k in (1, 2) for i in range(50)}


def test_frequent_words_are_counted_length_by_length(spark):
    """The same rows as counting everything, from a part of the places."""
    import random

    from cuesift.operators import keywords

    draw = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = ["".join(draw.choices(letters, k=draw.randint(2, 7))) for _ in range(400)]
    texts = [(a, o, " ".join(draw.choices(words, k=14))) for a in range(6) for o in range(5)]
    texts += [(7, 0, "lonely"), (8, 0, ""), (9, 0, "anan anan anan")]
    segments = spark.createDataFrame(texts, "asset_id long, ordinal int, text string")
    every = keywords.ngram_stats(segments, keywords.LETTERS)
    pick = lambda df: sorted(map(tuple, df.select(sorted(df.columns)).collect()))
    for minimum in (2, 3):
        got = keywords.frequent_words(segments, keywords.LETTERS, minimum)
        assert pick(got) == pick(every.where(F.col("frequency") >= minimum))
    framed = keywords._framed(segments, keywords.LETTERS)
    pairs = every.where("length(word) = 2 AND frequency >= 3")
    rows, places = keywords.longer_words(framed, pairs, 3)
    counted = rows.select(F.explode(places)).count()
    plain = framed.select(F.explode(keywords._windows(F.col("framed"), 3))).count()
    assert 0 < counted < plain / 3


def test_download_progress_reads_its_events_once(spark, tmp_path):
    """Two shuffles, no joins; sizes, finished files and the highest percentage as before."""
    events = [
        (1, 1, "initiate", "a", None, 100), (1, 2, "progress", "a", 40, None), (1, 3, "initiate", "b", None, 300),
        (1, 4, "progress", "a", 30, None), (1, 5, "done", "a", None, None), (1, 6, "other", "a", 9, 9),
        (1, 7, "done", "b", None, None), (2, 8, "progress", None, 5, None), (2, 9, "progress", "", 7, 14),
    ]
    path = str(tmp_path / "events")
    schema = "download_id long, seq long, status string, file string, loaded long, total long"
    spark.createDataFrame(events, schema).write.parquet(path)
    got = download_progress(spark.read.parquet(path))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan and plan.count("Exchange") == 2
    assert sorted(tuple(r)[1:] for r in got.collect()) == [
        (1, "preparing", 0, 100, None), (2, "downloading", 40, 100, 40), (3, "preparing", 40, 400, None),
        (4, "downloading", 40, 400, 40), (5, "downloading", 100, 400, 40), (7, "downloading", 400, 400, 100),
        (8, "downloading", 5, 0, None), (9, "downloading", 7, 14, 50),
    ]


def test_tokens_are_met_where_the_texts_are_read(spark):
    """Terms found by all their tokens without joins; ids that come again as the joins find them."""
    texts = ["the end", "then he", "", None, "endless hen", "店の前 the"]
    segments = spark.createDataFrame(list(enumerate(texts)), "segment_id long, text string")
    terms = spark.createDataFrame([("the",), ("end",), ("hen",), ("x",), ("-",), ("店の前",)], "folded string")
    pick = lambda df: sorted(map(tuple, df.select("folded", "segment_id").collect()), key=str)
    again = segments.where("segment_id < 2").unionByName(segments.selectExpr("CAST(NULL AS BIGINT) AS segment_id", "text"))
    for cut in (quality.words, quality.runs_of(2)):
        asked = terms.select("folded", F.array_distinct(cut(F.col("folded"))).alias("tokens"))
        got = quality.token_hits(segments, terms, cut)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "Exchange" not in plan
        for rows in (segments, segments.unionByName(again)):
            assert pick(quality.token_hits(rows, terms, cut)) == pick(quality._joined_tokens(rows, asked, cut))
    assert pick(quality.token_hits(segments, terms, quality.runs_of(2))) == [
        ("end", 0), ("end", 4), ("hen", 0), ("hen", 1), ("hen", 4), ("the", 0), ("the", 1), ("the", 5), ("店の前", 5)
    ]


def test_words_are_counted_in_the_task_of_their_asset(spark):
    from cuesift.operators import keywords

    segments = spark.createDataFrame([(a, o, "alpha beta") for a in range(5) for o in range(3)], "asset_id long, ordinal int, text string")
    plan = keywords.ngram_stats(segments, keywords.LETTERS)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan


@pytest.mark.parametrize("many", [False, True], ids=["packed", "joined"])
def test_recall_is_counted_by_pair(spark, many, monkeypatch):
    if many:
        monkeypatch.setattr(quality, "BROADCAST_ROWS", 2)
    words = [f"w{n}" for n in range(40)]
    pairs = {
        "truth": [(w, s) for n, w in enumerate(words) for s in range(n % 7)] + [("w5", None)],
        "all": [(w, s) for w in words for s in (*range(7), None)] + [("w3", 1), ("other", 2), (None, 1)],
        "few": [("w1", 0), ("w1", 0), ("w2", 9)],
        "none": [],
    }
    tables = {k: spark.createDataFrame(v, "folded string, segment_id long").repartition(3) for k, v in pairs.items()}
    truth = tables.pop("truth")
    asked = spark.createDataFrame([(w,) for w in [*words, "w0", None]], "folded string")
    found = quality.recall_eval(truth, tables, asked)
    want = []
    for name in tables:
        for word in [*words, None]:
            true = {p for p in pairs["truth"] if word and p[0] == word}
            held = {p for p in pairs[name] if word and p[0] == word}
            want.append((name, word, len(true), len(held), len(true & held), len(true & held) / len(true) if true else 1.0))
    got = found.select("method", "folded", "expected", "returned", "hit", "recall").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    # no pair is shuffled by itself
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert bool(re.search(r"hashpartitioning\(folded#\d+, segment_id", plan)) == many
