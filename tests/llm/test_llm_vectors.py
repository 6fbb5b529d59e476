"""Vector codes and near-duplicate vectors against brute force, and odd rows."""

import hashlib
import math

import numpy as np
import pytest

from cuesift.llm import codes, grid_join

SCHEMA = "vec_id long, embedding array<float>, label int, id long, class long, n long, rank long, text string"


def frame(spark, rows, kind="float"):
    full = [(i, v, label, 7, 7, 7, 7, "x") for i, v, label in rows]
    return spark.createDataFrame(full, SCHEMA.replace("float", kind)).repartition(3, "vec_id")


def narrow(values):
    return [float(np.float32(x)) for x in values]


def whole(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def expected_codes(rows):
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    kept = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows if whole(v)]
    sized = sorted((r for r in kept if r[1] and len(r[1]) % 8 == 0), key=key)
    kept = [r for r in sized if len(r[1]) == len(sized[0][1])]
    if not kept:
        return []
    width = len(kept[0][1]) // 8
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(r[1], p) for r in kept[:16]] for p in range(8)]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda p, part: min((gap(part, e), k) for k, e in enumerate(books[p]))
    for _ in range(6):
        found = [[near(p, cut(r[1], p))[1] for r in kept] for p in range(8)]
        for p in range(8):
            for k in range(len(books[p])):
                own = [cut(r[1], p) for r, e in zip(kept, found[p]) if e == k]
                if own:
                    books[p][k] = [sum(c) // len(own) for c in zip(*own)]
    out, totals = [], {}
    for i, v, label in kept:
        each = [near(p, cut(v, p)) for p in range(8)]
        error = sum(d for d, _ in each)
        totals[label] = totals.get(label, 0) + error
        out.append((i, "".join(f"{e:02x}" for _, e in each), error, label))
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, code, error, totals[label], digest) for i, code, error, label in out]


def order(rows):
    return sorted(map(tuple, rows), key=lambda r: [(x is None, x if x is not None else 0) for x in r])


def mixed_vectors(seed, count, dims):
    """Loose vectors, copies, near copies and chains of near copies."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(count):
        kind = rng.integers(5)
        if kind < 2 or not rows:
            v = rng.normal(size=dims)
        else:
            v = np.array(rows[rng.integers(len(rows))][1])
            v = v + rng.normal(size=dims) * (0, 0.05, 0.25)[kind - 2] * np.linalg.norm(v) / math.sqrt(dims)
            if rng.integers(3) == 0:
                v = v * rng.uniform(0.1, 20)
        rows.append((i, narrow(v), None if i % 7 == 0 else int(i % 3)))
    return rows


ODD = [
    (50_000, None, 1),
    (50_001, [None] * 16, 1),
    (50_002, [float("nan")] + [0.0] * 15, None),
    (50_003, [float("inf")] + [0.0] * 15, 2),
    (50_004, [], 2),
    (50_005, [0.0] * 16, 2),
    (50_006, [1.0] * 24, None),
    (50_007, [1.0] * 12, None),
    (50_008, [1.0] * 16, None),
    (50_008, [1.0] * 16, None),
    (50_009, [-1.0] * 16, None),
    (None, [1.0] * 16, 1),
    (None, [0.5, -0.5] * 8, 1),
]


@pytest.mark.parametrize("leaves", [3, 8192])
def test_codes_equal_brute_force(spark, monkeypatch, leaves):
    monkeypatch.setattr(codes, "LEAVES", leaves)
    rows = mixed_vectors(1, 150, 16) + ODD
    got = codes.vector_codes(frame(spark, rows))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert order(got.collect()) == order(expected_codes(rows))


def test_codes_of_few_equal_and_absent_rows(spark):
    few = [(3, [0.25] * 8, None), (3, [0.25] * 8, 1), (9, [-0.3] * 8, 1)]
    assert order(codes.vector_codes(frame(spark, few)).collect()) == order(expected_codes(few))
    for rows in ([], [(1, None, 1), (2, [], 1), (3, [1.0] * 7, 1)]):
        assert codes.vector_codes(frame(spark, rows)).collect() == []


def test_codes_of_doubles_and_too_large_components(spark):
    rows = [(i, [(-1) ** j * (i * 31 + j) / 4096.5 for j in range(16)], i % 2) for i in range(40)]
    assert order(codes.vector_codes(frame(spark, rows, "double")).collect()) == order(expected_codes(rows))
    with pytest.raises(Exception, match="beyond 32768"):
        codes.vector_codes(frame(spark, [(1, [1e20] * 8, 1)])).collect()


def test_trie_walks_blocks_as_one(spark):
    rng = np.random.default_rng(5)
    parts = rng.integers(-3, 3, size=(500, 4))
    parts = parts[np.lexsort(parts.T[::-1])]
    book = rng.integers(-3, 3, size=(16, 4))
    gaps = ((parts[:, None, :] - book[None]) ** 2).sum(axis=2)
    one, many = codes.PartTrie(book), codes.PartTrie(book)
    entries, errors = one.nearest(parts)
    pieces = [many.nearest(parts[i : i + 7]) for i in range(0, 500, 7)]
    assert (entries == gaps.argmin(axis=1)).all() and (errors == gaps.min(axis=1)).all()
    assert (np.concatenate([p[0] for p in pieces]) == entries).all()
    assert (np.concatenate([p[1] for p in pieces]) == errors).all()


def expected_duplicates(rows, cosine=0.9):
    fit = [whole(v) and any(x != 0 for x in v) for _, v, _ in rows]
    unit = [np.array(v) / np.linalg.norm(v) if f else None for (_, v, _), f in zip(rows, fit)]
    links = [
        [j for j in range(len(rows)) if j != i and fit[i] and fit[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine]
        for i in range(len(rows))
    ]
    component = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i, near in enumerate(links):
            least = min([component[i], *(component[j] for j in near)])
            changed |= least != component[i]
            component[i] = least
    out = []
    for i, (name, _, _) in enumerate(rows):
        ids = [r[0] for r, c in zip(rows, component) if c == component[i] and r[0] is not None]
        smallest = min(ids) if ids else None
        out.append((name, len(links[i]), smallest, name == smallest))
    return out


@pytest.mark.parametrize("tile, leaf, fanout", [(16, 5, 2), (64, 16, 16), (8192, 512, 16)])
def test_duplicates_equal_brute_force(spark, monkeypatch, tile, leaf, fanout):
    monkeypatch.setattr(grid_join, "SMALLEST_TILE", tile)
    monkeypatch.setattr(grid_join, "LARGEST_TILE", tile)
    monkeypatch.setattr(grid_join, "LEAF", leaf)
    monkeypatch.setattr(grid_join, "FANOUT", fanout)
    rows = mixed_vectors(2, 300, 16) + ODD + [(60_000 + i, [1.0] * 15 + [1.5], 0) for i in range(40)]
    got = grid_join.vector_duplicates(frame(spark, rows))
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert order(got.collect()) == order(expected_duplicates(rows))


def test_far_intervals_are_never_compared(spark, monkeypatch):
    """Two tight groups far apart: no pair of their intervals reaches a task."""
    rng = np.random.default_rng(3)
    centre = np.eye(16)[0] * 10
    rows = [(i, narrow(centre * (1 if i < 60 else -1) + rng.normal(size=16) * 0.1), 0) for i in range(120)]
    monkeypatch.setattr(grid_join, "GRID_DIMS", 2)
    vectors = frame(spark, rows)
    classes = vectors.selectExpr("embedding AS vec", "vec_id AS class", "1L AS n")
    radius = math.sqrt(0.2)
    basis = grid_join.principal_directions(classes, 2)
    ordered = grid_join.grid_order(classes, basis, radius).collect()
    assert sorted(r.rank for r in ordered) == list(range(120))
    leaves = spark.createDataFrame(
        [
            (t, *(f(r[f"p{i}"] for r in ordered if r["rank"] // 10 == t) for i in range(2) for f in (min, max)))
            for t in range(12)
        ],
        "node long, lo0 double, hi0 double, lo1 double, hi1 double",
    )
    pairs = {(r.a, r.b) for r in grid_join.near_intervals(leaves, 2, radius).collect()}
    assert pairs == {(a, b) for a in range(12) for b in range(a, 12) if (a < 6) == (b < 6)}


def test_duplicates_of_few_huge_and_absent_rows(spark):
    huge = [(1, [1e300, 1e300], 0), (2, [1e-300, 1e-300], 0), (3, [1e300, -1e300], 0), (4, [2.0], 0), (5, [3.0], 0)]
    got = grid_join.vector_duplicates(frame(spark, huge, "double")).collect()
    assert order(got) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False)]
    assert grid_join.vector_duplicates(frame(spark, [])).collect() == []
    got = grid_join.vector_duplicates(frame(spark, [(1, None, 0), (None, [0.0], 0)])).collect()
    assert order(got) == [(1, 0, 1, True), (None, 0, None, True)]
