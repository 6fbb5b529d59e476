import collections
import hashlib

from pyspark.sql import functions as F

from cuesift.llm.exact import SPACES, exact_groups
from cuesift.llm.mixing import mix, ranked, repeated, water_fill


def bare(text):
    return "".join(c for c in text or "" if c not in SPACES)


def expected_groups(rows):
    groups = collections.defaultdict(list)
    for doc_id, text in rows:
        groups[bare(text)].append((-len(text or ""), doc_id is not None, doc_id or 0, doc_id))
    out = []
    for doc_id, text in rows:
        members = groups[bare(text)]
        keep = min(members)[3]
        sha = hashlib.sha256(bare(text).encode()).hexdigest()
        out.append((doc_id, keep, len(members), keep == doc_id, sha))
    return sorted(out, key=str)


def test_exact_groups_match_brute_force(odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert sorted([tuple(r) for r in exact_groups(odd).collect()], key=str) == expected_groups(rows)


def test_exact_groups_tell_texts_with_one_hash_apart(odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    found = exact_groups(odd, digest=F.unhex(F.lit("00")))
    assert sorted([tuple(r) for r in found.collect()], key=str) == expected_groups(rows)


def test_exact_groups_of_nothing(empty):
    assert exact_groups(empty).collect() == []


def test_exact_plan_has_no_python(odd):
    plan = exact_groups(odd)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def filled(sizes, weights, cap=3):
    total, fixed = sum(sizes), {}
    while True:
        open_ = [i for i in range(len(sizes)) if i not in fixed]
        left = total - sum(fixed.values())
        share = {i: left * weights[i] / sum(weights[j] for j in open_) for i in open_}
        over = [i for i in open_ if share[i] > cap * sizes[i]]
        if not over:
            return [fixed.get(i, share.get(i)) for i in range(len(sizes))]
        fixed |= {i: cap * sizes[i] for i in over}


def test_water_fill_reshares_until_feasible(spark):
    sizes, weights = [1, 10, 100, 5, 1000, 0], [3, 3, 3, 1, 1, 2]
    rows = [(f"s{i}", w, n) for i, (n, w) in enumerate(zip(sizes, weights))]
    table = spark.createDataFrame(rows, "source string, weight long, source_size long")
    got = {r.source: r.target for r in water_fill(table).collect()}
    want = filled(sizes, weights)
    assert all(abs(got[f"s{i}"] - want[i]) < 1e-9 for i in range(len(sizes)))
    assert abs(sum(got.values()) - sum(sizes)) < 1e-9


def test_ranks_follow_code_points_and_put_null_last(spark):
    names = ["b", "a", None, "ä", "B", "", "\U0001f600", "ﬁ"]
    frame = spark.createDataFrame([(n,) for n in names], "source string").repartition(3)
    got = {r.source: r.place for r in ranked(frame, "source", "place").collect()}
    order = sorted((n for n in names if n is not None), key=lambda n: [ord(c) for c in n]) + [None]
    assert got == {n: i for i, n in enumerate(order)}


def test_mix_takes_the_target_of_every_source(spark):
    docs = spark.createDataFrame(
        [(i, " ".join(["w"] * (1 + i * i % 53)), f"s{i % 7 if i % 3 else 0}") for i in range(400)],
        "doc_id long, text string, source string",
    )
    rows = mix(docs, seed=5).collect()
    by_source = collections.defaultdict(list)
    for r in rows:
        by_source[r.source].append(r)
    want = filled(
        [sum(r.mix_size for r in by_source[s]) for s in sorted(by_source)],
        [1 + i % 3 for i in range(len(by_source))],
    )
    for source, target in zip(sorted(by_source), want):
        part = by_source[source]
        assert abs(part[0].mix_target - target) < 1e-6
        assert sum(r.mix_taken for r in part) == round(target)
        assert all(0 <= r.mix_taken <= 3 * r.mix_size for r in part)
        # whole and one more repetition only
        assert len({r.mix_copies for r in part}) <= 2 and sum(r.mix_rest > 0 for r in part) <= 1
    again = sorted(mix(docs.repartition(9), seed=5).collect(), key=lambda r: r.doc_id)
    assert again == sorted(rows, key=lambda r: r.doc_id)
    other = mix(docs, seed=6).collect()
    assert {(r.doc_id, r.mix_taken) for r in other} != {(r.doc_id, r.mix_taken) for r in rows}
    texts = repeated(mix(docs, seed=5)).collect()
    taken = collections.Counter()
    for r in texts:
        taken[r.doc_id] += len(r.text.split())
    assert taken == collections.Counter({r.doc_id: r.mix_taken for r in rows if r.mix_taken})


def test_mix_weights_and_odd_rows(spark, odd, empty):
    rows = mix(odd).collect()
    assert len(rows) == odd.count() and all(r.mix_taken <= 3 * r.mix_size for r in rows)
    assert set(odd.columns) <= set(rows[0].asDict())
    assert sum(r.mix_size for r in rows if r.source is None) == next(r.mix_source_size for r in rows if r.source is None)
    assert mix(empty).collect() == [] and repeated(mix(empty)).collect() == []
    weights = spark.createDataFrame([("a", 1), ("b", 1), (None, 1)], "source string, weight long")
    assert {r.source for r in mix(odd, weights).collect()} == {"a", "b", None}
    assert repeated(mix(odd)).columns == odd.columns
