"""The conversation trie against a plain one, over runs of any length."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuesift.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, key string, run long, path string, kept boolean"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "k", 1, "p", True) for r in rows], SCHEMA).repartition(3, "conv_id")


def expected(rows):
    digest = lambda r, t: hashlib.md5(f"{len(r)}:{r}{t}".encode()).hexdigest()
    found = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            found.setdefault(conv, []).append((turn is not None, turn or 0, digest(role or "", text or ""), (role or "", text or "")))
    found = {c: [t[3] for t in sorted(ts)] for c, ts in found.items()}
    rebuilt = {}
    for c, own in found.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        rebuilt[c] = tuple(found.get(base, [])[:h] + own[h:])
    members = {}
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
    below = {}
    for node in sorted(members, key=len, reverse=True):
        size = len(node[-1][1].encode()) if node else 0
        kids = [k for k in below if len(k) == len(node) + 1 and k[:-1] == node]
        saved = (len(members[node]) - 1) * size + sum(below[k][1] for k in kids)
        below[node] = (sum(below[k][0] for k in kids) if kids else 1, saved, len(kids))
    out = []
    for node, convs in members.items():
        ends = ",".join(map(str, sorted(c for c in convs if rebuilt[c] == node)))
        leaves, saved, kids = below[node]
        out.append(
            (min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), kids, leaves, saved,
             hashlib.sha256(ends.encode()).hexdigest())
        )
    return out


def talks(seed, count):
    rng = random.Random(seed)
    rows, scripts = [], []
    for c in range(count):
        if scripts and rng.random() < 0.6:
            script = list(rng.choice(scripts))[: rng.randint(0, 9)]
        else:
            script = []
        while len(script) < 8 and rng.random() < 0.7:
            script.append((rng.choice(["user", "assistant"]), rng.choice(["a", "b", "é longer", ""])))
        scripts.append(script)
        rows += [(c * rng.choice([1, 1, 1, 7]), i, *t) for i, t in enumerate(script)]
    rng.shuffle(rows)
    return rows


def order(rows):
    return sorted(map(tuple, rows), key=lambda r: [(x is None, x if x is not None else 0) for x in r])


@pytest.mark.parametrize("run", [1, 9, 60, 1 << 15])
def test_trie_equals_plain_trie(spark, monkeypatch, run):
    monkeypatch.setattr(prefix_trie, "RUN", run)
    rows = talks(1, 150)
    # one text opens a third of all conversations, and one conversation has many copies
    rows += [(1000 + 5 * c, 0, "system", "hello") for c in range(80)]
    rows += [(1000 + 5 * c, 1, "user", f"x{c % 9}") for c in range(0, 80, 2)]
    rows += [(2000 + 5 * c, t, "user", "same") for c in range(60) for t in range(3)]
    got = prefix_trie.prefix_trie(frame(spark, rows))
    assert got.columns == COLUMNS
    assert order(got.collect()) == order(expected(rows))


def test_odd_rows(spark):
    rows = [
        (None, 0, "user", "left out"),
        (0, None, None, None),
        (0, None, "", ""),
        (0, 3, "user", "é" * 50_000),
        (0, 3, "user", "é" * 50_000),
        (1, 2, "user", None),
        (1, 1, "user", "z"),
        (2, 0, "a", "bc"),
        (3, 0, "ab", "c"),
        (7, 0, "user", "no first conversation"),
        (-3, 0, "user", "below zero"),
        (9_000_000_000_005, 1, "user", "far"),
    ]
    assert order(prefix_trie.prefix_trie(frame(spark, rows)).collect()) == order(expected(rows))


def test_empty_and_single(spark):
    assert prefix_trie.prefix_trie(frame(spark, [])).collect() == []
    one = [(5, 0, "user", "x")]
    assert order(prefix_trie.prefix_trie(frame(spark, one)).collect()) == order(expected(one))
    turnless = [(3, 0, "user", "x")]  # the kept turns are those of conversation 0, which is not there
    assert order(prefix_trie.prefix_trie(frame(spark, turnless)).collect()) == order(expected(turnless))


def test_range_minimum():
    rng = np.random.default_rng(2)
    for n in (1, 2, 7, 64, 100):
        values = rng.integers(0, 6, n)
        table = prefix_trie.RangeMinimum(values)
        first = rng.integers(0, n, 200)
        last = np.maximum(first, rng.integers(0, n, 200))
        assert (table.over(first, last) == [values[a : b + 1].min() for a, b in zip(first, last)]).all()
        for start, least in zip(range(n), rng.integers(0, 6, n)):
            ahead = next((i for i, v in enumerate(values[start:]) if v < least), n - start)
            back = next((i for i, v in enumerate(values[start::-1]) if v < least), start + 1)
            ask = (np.array([start]), np.array([least]))
            assert table.reach(*ask, forward=True)[0] == ahead and table.reach(*ask, forward=False)[0] == back


def test_only_borders_are_added_up(spark):
    """Nodes that lie in one run are settled there; what is merged are the shared beginnings at borders."""
    rows = [(5 * c, t, "user", f"{c // 40}-{t}-{c if t > 1 else 0}") for c in range(400) for t in range(4)]
    runs = prefix_trie.sorted_runs(prefix_trie.sequences(frame(spark, rows)))
    held = runs.mapInArrow(prefix_trie._fragments, prefix_trie.FRAGMENTS)
    counts = held.agg(F.count("key").alias("open"), F.count(F.lit(1)).alias("all")).first()
    assert counts["open"] <= 2 * 5 * runs.count() and counts["all"] > 800
