import collections
import hashlib
import itertools
import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from cuesift.llm import near_dedup
from cuesift.llm.components import components
from cuesift.llm.decontamination import contamination, uncontaminated
from cuesift.llm.near_dedup import near_duplicates, shingle_sets, without_near_duplicates

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3)))


def expected_components(rows):
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            parent[root(j)] = root(i)
    least = collections.defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None and sets[i]:
            least[root(i)].append(doc_id)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        component = min(least[root(i)], default=None) if sets[i] else doc_id
        out.append((doc_id, len(sets[i]), component, doc_id == component))
    return sorted(out, key=str)


def copies(seed=3):
    """Families of edited copies, chains of edits, copies, short and unrelated texts."""
    draw = random.Random(seed)
    words = ["".join(draw.choice("abcdefgh") for _ in range(5)) for _ in range(3000)]
    rows = []
    for size, edits in ((40, 3), (60, 5), (25, 8), (3, 1), (10, 0)):
        base = [draw.choice(words) for _ in range(140)]
        for _ in range(size):
            text = list(base)
            for _ in range(draw.randrange(edits + 1)):
                text[draw.randrange(len(text))] = draw.choice(words)
            rows.append(" ".join(text))
    chain = [draw.choice(words) for _ in range(120)]
    for _ in range(30):
        chain = list(chain)
        chain[draw.randrange(len(chain))] = draw.choice(words)
        rows.append(" ".join(chain))
    rows += [" ".join(draw.choice(words) for _ in range(draw.randrange(1, 60))) for _ in range(60)]
    rows += ["one", "One", "one two", "one two three four", "one two three four", "a b b a", "b a a b"]
    ids = list(range(len(rows)))
    draw.shuffle(ids)
    return list(zip(ids, rows))


@pytest.mark.parametrize("short", [32, 2])
def test_near_duplicates_match_brute_force(spark, monkeypatch, short):
    """Also where lists of more than two classes are compared in small blocks."""
    monkeypatch.setattr(near_dedup, "SHORT_LIST", short)
    monkeypatch.setattr(near_dedup, "BLOCK_CLASSES", 7)
    rows = copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = near_duplicates(docs).collect()
    assert sorted([(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got], key=str) == expected_components(rows)
    assert sum(r.stays for r in got) == len({r.component_id for r in got})


def test_near_duplicates_of_odd_rows(odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = near_duplicates(odd).collect()
    assert sorted([(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got], key=str) == expected_components(rows)
    kept = without_near_duplicates(odd)
    assert kept.columns == odd.columns
    # one of the prose family, everything else, repeated wordless rows too
    assert sum((r.text or "").startswith("the quick") for r in kept.collect()) == 1
    assert near_duplicates(empty).collect() == [] and without_near_duplicates(empty).collect() == []


def shuffled_texts(frame):
    """Rows with a text that the exchanges of a collected ``frame`` wrote."""

    def walk(node):
        below = node.children()
        below = [node.plan()] if "QueryStage" in node.nodeName() else [below.apply(i) for i in range(below.size())]
        wrote = 0
        # half-made aggregates name a text first
        if node.nodeName() == "Exchange" and re.search("text#|first#", node.output().toString()):
            wrote = node.metrics().apply("shuffleRecordsWritten").value()
        return wrote + sum(walk(x) for x in below)

    return walk(frame._jdf.queryExecution().executedPlan().finalPhysicalPlan())


def test_only_texts_that_are_asked_for_are_shuffled(spark):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(20))) for i in range(300)]
    rows += [(300, rows[7][1]), (9, rows[9][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    wanted = docs.where("doc_id IN (5, 9)").select(near_dedup.row_key().alias("key"), F.col("doc_id").alias("class"))
    sets = shingle_sets(docs, wanted.distinct())
    assert sorted((r["class"], len(r.shingles)) for r in sets.collect()) == [(5, 17), (9, 17)]
    assert 0 < shuffled_texts(sets) <= 12
    kept = without_near_duplicates(docs)
    assert sorted(map(tuple, kept.collect())) == sorted(rows[:300])
    assert 0 < shuffled_texts(kept) <= 12


def test_keys_that_share_a_hash_are_told_apart(spark, odd, monkeypatch):
    docs = spark.createDataFrame(copies(), "doc_id long, text string").repartition(4)
    wide = [sorted(map(str, without_near_duplicates(d).collect())) for d in (docs, odd)]
    monkeypatch.setattr(near_dedup, "KEY_BITS", 3)
    assert [sorted(map(str, without_near_duplicates(d).collect())) for d in (docs, odd)] == wide


def test_components_of_a_long_path(spark):
    links = [(i + 1, i) for i in range(40)] + [(100, 101), (7, 7), (200, 200)]
    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 200: 200}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_block_links_span_components_once():
    rows = pd.DataFrame(
        [(c, c, side, list(range(c, c + 50))) for c in (0, 1, 2, 300) for side in (0, 1)],
        columns=["class", "component", "side", "shingles"],
    )
    links = near_dedup._block_links(rows, 80)
    assert len(links) == 2 and {x for pair in links for x in pair} == {0, 1, 2}


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def expected_hits(docs, items):
    windows = collections.defaultdict(set)
    for item, text in items:
        words = bench_words(text)
        for i in range(max(1, len(words) - 9) if words else 0):
            windows[tuple(words[i : i + 10])].add("" if item is None else str(item))
    sizes = {len(w) for w in windows}
    out = []
    for doc_id, text in docs:
        words, hit, found = bench_words(text), set(), set()
        for size in sizes:
            for i in range(len(words) - size + 1):
                if ids := windows.get(tuple(words[i : i + size])):
                    hit |= set(range(i, i + size))
                    found |= ids
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(words), len(hit), len(found), sha, bool(hit)))
    return sorted(out, key=str)


def planted(seed=5):
    draw = random.Random(seed)
    words = ["".join(draw.choice("abcé1") for _ in range(draw.randrange(1, 4))) for _ in range(60)]
    items = [(i, " ".join(draw.choice(words) for _ in range(draw.choice([0, 1, 3, 4, 5, 9, 10, 11, 30])))) for i in range(40)]
    items += [(3, items[8][1]), (None, "x y z"), (99, None), (70, "one, two - THREE four five six seven eight nine ten")]
    docs = []
    for i in range(120):
        text = [draw.choice(words) for _ in range(draw.randrange(60))]
        if i % 2:
            passage = (items[draw.randrange(40)][1] or "").split()
            cut = draw.randrange(3)
            at = draw.randrange(len(text) + 1)
            text[at:at] = passage[cut:]
        docs.append((i, draw.choice([" ", "\n", ", "]).join(text)))
    docs.append((500, "a ONE two three? four five six seven; eight nine ten b"))
    return docs, items


def test_contamination_matches_brute_force(spark, odd):
    docs, items = planted()
    docs += [(r.doc_id, r.text) for r in odd.collect()]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, window int")
    got = contamination(frame, bench)
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert sorted([tuple(r) for r in got.select(*names).collect()], key=str) == expected_hits(docs, items)
    clean = uncontaminated(frame, bench)
    hits = collections.Counter(r[0] for r in expected_hits(docs, items) if not r[-1])
    assert collections.Counter(r.doc_id for r in clean.collect()) == hits


def test_contamination_of_nothing(spark, odd, empty):
    bench = spark.createDataFrame([(1, "the quick brown fox")], "item_id long, text string")
    none = bench.limit(0)
    assert contamination(empty, bench).collect() == []
    assert not any(r.contaminated for r in contamination(odd, none).collect())
    assert sum(r.contaminated for r in contamination(odd, bench).collect()) == 4
    assert uncontaminated(odd, bench).columns == odd.columns
