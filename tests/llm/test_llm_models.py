import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from cuesift.llm import quality, toxicity
from cuesift.llm.arrays import flat


def corpus(spark, n=500, seed=9):
    draw = random.Random(seed)
    words = ["".join(draw.choice("etaoinshrd") for _ in range(draw.randrange(2, 9))) for _ in range(400)]
    rows = []
    for i in range(n):
        text = [draw.choice(words) for _ in range(draw.randrange(20, 90))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                text[draw.randrange(len(text))] = draw.choice(["numbskull", "dimwit", "blockhead", "Nincompoop,"])
        good = i % 5 != 0
        body = " ".join(text)
        if not good:
            body = " | ".join(text) if i % 2 else " ".join(w.upper() + "!!" for w in text)
        rows.append((i, body, int(toxic), int(good)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int, quality int").cache()


def kernel(a, b):
    """Weighted common subsequences, by brute force over all positions."""

    def counts(word):
        text = "^" + word
        out = {}
        n = len(text)
        for i in range(n):
            for j in range(i + 1, n):
                for k in range(j + 1, min(n, i + toxicity.REACH)):
                    key = text[i] + text[j] + text[k]
                    out[key] = out.get(key, 0) + toxicity.DECAY ** (k - i)
        return out

    x, y = counts(a), counts(b)
    dot = lambda p, q: sum(v * q.get(k, 0) for k, v in p.items())
    return dot(x, y) / np.sqrt(dot(x, x) * dot(y, y))


def features(word):
    feature, weight = toxicity.subsequences(*toxicity.strings(*flat(pa.array([word])))[:3])
    out = np.zeros(toxicity._FEATURES)
    np.add.at(out, feature[0], weight[0])
    return out


def test_features_give_the_string_kernel():
    for a, b in [("idle", "idly"), ("abab", "bababa"), ("banana", "bandana"), ("xyz", "abc")]:
        assert abs(features(a) @ features(b) - kernel(a, b)) < 1e-9


def cut(text):
    letters, begin, end, row = toxicity.strings(*flat(pa.array(text)))
    found = [(int(r), "".join(chr(97 + c) for c in letters[a:b])) for r, a, b in zip(row, begin, end)]
    return sorted(found)


def test_strings_of_words_signs_and_spelled_words():
    assert cut(["Some wo.rd", None, "a b c d, e"]) == [(0, "some"), (0, "word"), (2, "abcde")]
    assert (0, "idle") in cut(["idle|fools"]) and (0, "fools") in cut(["idle|fools"])
    assert cut(["ab", "cd"]) == [] and cut([None, ""]) == []
    long = cut(["abcdefghij" * 10])
    assert {len(w) for _, w in long} <= set(range(3, toxicity.LONGEST + 1)) and len(long) > 6


def test_machine_finds_gapped_and_unseen_spellings(spark):
    docs = corpus(spark)
    machine = toxicity.train(docs.select("doc_id", "text"), docs.select("doc_id", "toxic").where("doc_id % 3 <> 1"))
    rated = toxicity.toxicity(docs, machine).where("doc_id % 3 = 1").collect()
    right = sum((r.score >= 0.5) == (r.toxic == 1) for r in rated)
    assert right >= 0.97 * len(rated)
    probe = {"numbsxkull": 1, "num-bskull": 1, "n u m b s k u l l": 1, "dimmwit": 1, "theoretic": 0, "stone": 0}
    values = {}
    for text in probe:
        letters, begin, end, _ = toxicity.strings(*flat(pa.array([text])))
        values[text] = machine.values(letters, begin, end).max()
    assert min(values[t] for t, bad in probe.items() if bad) > max(values[t] for t, bad in probe.items() if not bad)


def test_toxicity_of_odd_rows(spark, odd, empty):
    docs = corpus(spark)
    labels = docs.select("doc_id", "toxic").unionByName(
        spark.createDataFrame([(None, 1), (1, None), (4, 1), (10_000, 1)], "doc_id long, toxic int")
    )
    machine = toxicity.train(docs, labels)
    rated = toxicity.toxicity(odd, machine)
    rows = rated.collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows)
    assert set(rated.columns) == {*odd.columns, "predicted"} - {"text"}
    kept = toxicity.not_toxic(odd, machine)
    assert kept.columns == odd.columns and kept.count() == sum(r.predicted == 0 for r in rows)
    assert toxicity.toxicity(empty, machine).collect() == []
    assert toxicity.train(docs, labels.limit(0)) is None and toxicity.train(empty, labels) is None
    assert {r.score for r in toxicity.toxicity(odd, None).collect()} == {0.0}
    assert toxicity.not_toxic(odd, None).count() == odd.count()


def test_fold_is_the_crc32_of_the_id(spark):
    import zlib

    rows = spark.range(50).select("id", toxicity.fold(F.col("id"), 3).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 3 for r in rows)


def test_prior_of_a_mixture():
    draw = np.random.default_rng(2)
    good = draw.normal(2, 1, 4000)
    mixed = np.where(draw.random(8000) < 0.6, draw.normal(2, 1, 8000), draw.normal(-2, 1, 8000))
    assert abs(quality.estimated_prior(good, mixed) - 0.6) < 0.06


def test_measures_do_not_depend_on_neighbours():
    texts = ["A b. A b.\nNext line!", None, "", "x" * 3000, "word " * 200, "é ñ\r\nZ", "| | |"]
    together = quality.measures(pa.array(texts))
    alone = np.vstack([quality.measures(pa.array([t], pa.string())) for t in texts])
    assert np.allclose(together, alone) and not together[1].any() and not together[2].any()


def test_classifier_learns_from_positives_only(spark, odd, empty):
    docs = corpus(spark, 900)
    good = docs.select("doc_id", "quality").where("doc_id % 7 <> 0")
    classifier = quality.train(docs, good)
    # zeros of the labels change nothing
    flipped = quality.train(docs, good.where("quality = 1"))
    assert np.allclose(classifier.weights, flipped.weights)
    rated = quality.quality(docs, classifier).where("doc_id % 7 = 0").collect()
    right = sum(r.predicted == r.quality for r in rated)
    assert right >= 0.95 * len(rated) and abs(classifier.prior - 0.8) < 0.12
    rows = quality.quality(odd, classifier).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert quality.quality(empty, classifier).collect() == []
    assert quality.train(docs, good.limit(0)) is None and quality.train(empty, good) is None
    assert {r.score for r in quality.quality(odd, None).collect()} == {0.5}


def test_rare_insults_still_make_a_machine(spark):
    """No string is telling by itself: the ones of the highest ratio are learned."""
    draw = np.random.default_rng(3)
    plain = [f"word{i}" for i in range(40)]
    rows = [(i, " ".join(draw.choice(plain, 12)) + f" grumblebug{'abcdefghij'[i]}") for i in range(10)]
    rows += [(i, " ".join(draw.choice(plain, 12))) for i in range(10, 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 10)) for i, _ in rows], "doc_id long, toxic int")
    machine = toxicity.train(docs, labels)
    assert machine is not None
    score = {r.doc_id: r.score for r in toxicity.toxicity(docs, machine).collect()}
    assert min(score[i] for i in range(10)) > max(score[i] for i in range(10, 20))
    assert toxicity.train(docs, labels.where("toxic = 1")) is None


def test_repeated_rows_do_not_change_the_sample(spark):
    rows = [(i, f"A good text number {i}. It has sentences." if i % 2 else "x9 $$ 1 | 2 | 3") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(1, 60, 4)], "doc_id long, quality int")
    one = quality.train(docs, labels, 10, 30)
    again = quality.train(docs.unionByName(docs.where("doc_id < 20")).unionByName(docs), labels, 10, 30)
    assert np.allclose(one.weights, again.weights) and one.prior == again.prior


def test_risk_is_that_of_all_documents(spark):
    """Few documents show the curvature; edges and prior are those of all, and the risk over all is brought down."""
    docs = corpus(spark, 700, 4)
    labels = docs.select("doc_id", "quality").where("doc_id % 3 = 0")
    few, many = (quality.train(docs, labels, curvature=n) for n in (120, 700))
    assert np.array_equal(few.edges, many.edges) and abs(few.prior - many.prior) < 0.01

    rows = docs.orderBy("doc_id").collect()
    every = quality.cells(quality.measures(pa.array([r.text for r in rows])))
    counts = [np.bincount(column, minlength=quality.CELLS) for column in every.T]
    assert np.array_equal(quality.bin_edges(np.array(counts)), many.edges)

    good = many.bins(every[[r.doc_id % 3 == 0 and r.quality == 1 for r in rows]])
    size = len(many.weights)
    held_good, held_all = np.zeros((len(good), size)), np.zeros((len(every), size))
    held_good[np.arange(len(good))[:, None], good] = 1
    held_all[np.arange(len(every))[:, None], many.bins(every)] = 1

    def risk(weights, offset):
        of_good, of_all = held_good @ weights + offset, held_all @ weights + offset
        p = many.prior
        negative = np.logaddexp(0, of_all).mean() - p * np.logaddexp(0, of_good).mean()
        return p * np.logaddexp(0, -of_good).mean() + max(0, negative) + 3e-4 * (weights**2).sum() / 2, negative

    least, left = risk(many.weights, many.offset)
    assert left >= 0
    for shrunk in (0.0, 0.5, 0.9):
        assert risk(shrunk * many.weights, shrunk * many.offset)[0] >= least


def test_equal_edges_and_constant_measures():
    counts = np.zeros((2, quality.CELLS), int)
    counts[0, 7] = 50
    counts[1, :100] = 1
    edges = quality.bin_edges(counts)
    assert edges.shape == (2, quality.BINS - 1) and set(edges[0]) == {7, 8}
    assert (np.diff(edges[1]) >= 0).all() and edges[1][0] == 1 and edges[1][-1] == 98
