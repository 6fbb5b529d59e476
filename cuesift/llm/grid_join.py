"""Near-duplicate vectors by an epsilon grid order join."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .components import components

COSINE = 0.9

# Leading principal dimensions that the grid cuts.
GRID_DIMS = 8

# Vectors of a tile, the interval of the grid order that one task holds twice.
SMALLEST_TILE, LARGEST_TILE = 1024, 8192

# Children of an interval where pairs of intervals are refined by joins.
FANOUT = 16

# Interval inside a tile from which pairs are compared by products.
LEAF = 512

# Bounds are kept apart from the radius by more than rounding can make.
SLACK = 1e-6


def unit_rows(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision, padded with zeros, of vectors laid end to end."""
    rows = np.zeros((len(sizes), int(sizes.max(initial=0))))
    rows[np.arange(rows.shape[1]) < sizes[:, None]] = values
    if rows.size:
        rows /= np.abs(rows).max(axis=1, keepdims=True)
        rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    return rows


def _laid_out(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(column).to_numpy().astype(np.int64)


def principal_directions(classes: DataFrame, dims: int) -> np.ndarray:
    """``[component, direction]``: leading eigenvectors of the second moments of all unit vectors.

    Every task adds up its own moments; the sums, one number for each pair of
    components, are all that reaches the driver.
    """

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((0, 0))
        for batch in batches:
            rows = unit_rows(*_laid_out(batch.column("vec")))
            if rows.shape[1] > len(total):
                total = np.pad(total, (0, rows.shape[1] - len(total)))
            total[: rows.shape[1], : rows.shape[1]] += rows.T @ rows
        i, j = np.triu_indices(len(total))
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (i, j, total[i, j])], ["i", "j", "x"])

    sums = classes.select("vec").mapInArrow(moments, "i long, j long, x double")
    cells = sums.groupBy("i", "j").agg(F.sum("x").alias("x")).collect()
    size = max((c.j for c in cells), default=0) + 1
    matrix = np.zeros((size, size))
    for c in cells:
        matrix[c.i, c.j] = matrix[c.j, c.i] = c.x
    return np.linalg.eigh(matrix)[1][:, ::-1][:, :dims]


def _projected(rows: np.ndarray, basis: np.ndarray) -> np.ndarray:
    width = min(rows.shape[1], len(basis))
    return rows[:, :width] @ basis[:width]


def grid_order(classes: DataFrame, basis: np.ndarray, radius: float) -> DataFrame:
    """Classes with ``rank``, their place in the order of grid cells, and ``p0, p1, …``, their projections."""
    names = [f"p{i}" for i in range(basis.shape[1])]
    cells = [f"c{i}" for i in range(basis.shape[1])]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _projected(unit_rows(*_laid_out(batch.column("vec"))), basis)
            grid = np.floor(at / radius).astype(np.int64)
            columns = [*batch.columns, *map(pa.array, at.T), *map(pa.array, grid.T)]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, *names, *cells])

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema.fields)
    schema = ", ".join([types, *(f"{c} double" for c in names), *(f"{c} long" for c in cells)])
    order = [*cells, "class"]
    sorted_ = classes.mapInArrow(place, schema).repartitionByRange(*order).sortWithinPartitions(*order)
    # a row number holds its task and its place there; it is fixed once written
    sorted_ = stored(sorted_.drop(*cells).withColumn("at", F.monotonically_increasing_id()), "grid-order")
    task = F.shiftright("at", 33)
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    first = sorted_.groupBy(task.alias("task")).agg(F.count(F.lit(1)).alias("n")).select(
        "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")
    )  # one row for each task
    place_in_task = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        sorted_.withColumn("task", task)
        .join(F.broadcast(stored(first, "task-offsets")), "task")
        .withColumn("rank", F.col("first") + place_in_task)
        .drop("task", "first", "at")
    )


def near_intervals(leaves: DataFrame, dims: int, radius: float) -> DataFrame:
    """Pairs ``a <= b`` of intervals whose boxes lie within ``radius`` of each other.

    ``leaves`` holds ``node, lo0, hi0, …``, numbered in grid order. From the
    whole sequence downwards each pair of intervals meets the pairs of its
    children by joins on the parent, and pairs that are provably apart end there
    with everything below them.
    """
    sides = [f"{side}{i}" for i in range(dims) for side in ("lo", "hi")]
    bounds = [(F.min if s.startswith("lo") else F.max)(s).alias(s) for s in sides]
    levels = [leaves.select("node", *sides)]
    while levels[-1].agg(F.max("node")).first()[0]:
        up = levels[-1].groupBy(F.expr(f"node div {FANOUT}").alias("node")).agg(*bounds)
        levels.append(stored(up, "boxes"))
    pairs = levels.pop().select(F.col("node").alias("a"), F.col("node").alias("b"))
    while levels:
        boxes = levels.pop()
        parent = F.expr(f"node div {FANOUT}")
        of = lambda name: boxes.select(
            parent.alias(name), F.col("node").alias(f"{name}_node"), *[F.col(s).alias(f"{name}_{s}") for s in sides]
        )
        gaps = [
            F.greatest(F.col(f"a_lo{i}") - F.col(f"b_hi{i}"), F.col(f"b_lo{i}") - F.col(f"a_hi{i}"), F.lit(0.0))
            for i in range(dims)
        ]
        apart = reduce(lambda x, y: x + y, [g * g for g in gaps])
        met = pairs.join(of("a"), "a").join(of("b"), "b").where(F.col("a_node") <= F.col("b_node"))
        near = met.where(apart <= (radius + SLACK) ** 2)
        pairs = stored(near.select(F.col("a_node").alias("a"), F.col("b_node").alias("b")), "near-intervals")
    return pairs


class _Forest:
    """Components of the two sides of one tile pair; keeps one link for every union."""

    def __init__(self, size: int):
        self.label = np.arange(size)
        self.links: list[tuple[int, int]] = []

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        la, lb = self.label[a], self.label[b]
        open_ = la != lb
        if not open_.any():
            return
        low, high = np.minimum(la, lb)[open_], np.maximum(la, lb)[open_]
        _, at = np.unique(low * len(self.label) + high, return_index=True)
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                parent[x] = parent.get(up, up)
                x = up
            return x

        for x, y, i, j in zip(low[at], high[at], a[open_][at], b[open_][at]):
            x, y = root(int(x)), root(int(y))
            if x != y:
                parent[max(x, y)] = min(x, y)
                self.links.append((int(i), int(j)))
        renamed = np.arange(len(self.label))
        for x in list(parent):
            renamed[x] = root(x)
        self.label = renamed[self.label]


def _boxes(at: np.ndarray, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    part = at[begin:end]
    return part.min(axis=0), part.max(axis=0)


def packed_tiles(key: tuple, rows: pa.Table) -> pa.Table:
    """One tile as one row of plain bytes, in grid order; components in four bytes where that is exact."""
    rows = rows.sort_by("rank")
    values, sizes = _laid_out(rows.column("vec"))
    short = values.astype("<f4")
    values = short if (short == values).all() else values.astype("<f8")
    numbers = [rows.column(c).to_numpy().astype("<i8").tobytes() for c in ("class", "n")]
    columns = [pa.array([key[0].as_py()], pa.int64())]
    columns += [pa.array([v], pa.binary()) for v in (*numbers, sizes.astype("<i8").tobytes(), values.tobytes())]
    return pa.table(columns, ["tile", "class", "n", "sizes", "vec"])


def _unpacked(row: dict) -> tuple[np.ndarray, ...]:
    names, copies, sizes = (np.frombuffer(row[c], "<i8") for c in ("class", "n", "sizes"))
    values = np.frombuffer(row["vec"], "<f4" if len(row["vec"]) == 4 * sizes.sum() else "<f8")
    return names, copies, sizes, unit_rows(values, sizes)


def tile_links(tiles: list[tuple[np.ndarray, ...]], basis: np.ndarray, cosine: float) -> pa.Table:
    """Links between two tiles (or inside one): ``a, null, n`` for the copies that class ``a`` is
    linked with, ``a, b, null`` for a spanning forest of the links.

    Both sequences are halved together; pairs of intervals whose boxes lie apart
    are skipped, pairs of short ones compared.
    """
    radius = np.sqrt(2 - 2 * cosine) + SLACK
    same = len(tiles) == 1
    names, copies, sizes, rows = map(list, zip(*tiles))
    width = max(r.shape[1] for r in rows)
    rows = [np.pad(r, ((0, 0), (0, width - r.shape[1]))) for r in rows]
    at = [_projected(r, basis) for r in rows]
    x, y = 0, len(tiles) - 1
    linked = [np.zeros(len(r), np.int64) for r in rows]
    forest = _Forest(sum(map(len, rows)))
    shift = 0 if same else len(rows[0])
    mixed = len(np.unique(np.concatenate(sizes))) > 1
    open_ = [(0, len(rows[x]), 0, len(rows[y]))]
    while open_:
        a, b, c, d = open_.pop()
        if same and c < a:
            continue
        (lo_x, hi_x), (lo_y, hi_y) = _boxes(at[x], a, b), _boxes(at[y], c, d)
        gap = np.maximum(np.maximum(lo_x - hi_y, lo_y - hi_x), 0)
        if (gap * gap).sum() > radius * radius:
            continue
        if b - a > LEAF or d - c > LEAF:
            m, k = ((a + b) // 2 if b - a > LEAF else b), ((c + d) // 2 if d - c > LEAF else d)
            open_ += [(p, q, r, s) for p, q in ((a, m), (m, b)) if p < q for r, s in ((c, k), (k, d)) if r < s]
            continue
        near = rows[x][a:b] @ rows[y][c:d].T >= cosine
        if mixed:
            near &= sizes[x][a:b, None] == sizes[y][None, c:d]
        if same and a == c:
            near = np.triu(near, 1)
        i, j = np.nonzero(near)
        if len(i):
            np.add.at(linked[x], i + a, copies[y][j + c])
            np.add.at(linked[y], j + c, copies[x][i + a])
            forest.add(i + a, j + c + shift)
    names = np.concatenate(names)
    totals = np.concatenate(linked)
    met = np.flatnonzero(totals)
    ends = np.array(forest.links, np.int64).reshape(-1, 2)
    none = lambda n: pa.nulls(n, pa.int64())
    counted = pa.table([pa.array(names[met]), none(len(met)), pa.array(totals[met])], ["a", "b", "n"])
    edges = pa.table([pa.array(names[ends[:, 0]]), pa.array(names[ends[:, 1]]), none(len(ends))], ["a", "b", "n"])
    return pa.concat_tables([counted, edges])


def class_links(classes: DataFrame, cosine: float = COSINE) -> DataFrame:
    """``a, b, n`` of all linked classes ``class, vec, n``; see ``tile_links``."""
    radius = float(np.sqrt(2 - 2 * cosine))
    basis = principal_directions(classes, GRID_DIMS)
    dims = basis.shape[1]
    ordered = grid_order(classes, basis, radius)
    size = min(max(-(-classes.count() // 8), SMALLEST_TILE), LARGEST_TILE)
    tiled = ordered.withColumn("tile", F.expr(f"rank div {size}"))
    bounds = [f(f"p{i}").alias(f"{s}{i}") for i in range(dims) for s, f in (("lo", F.min), ("hi", F.max))]
    leaves = stored(tiled.groupBy(F.col("tile").alias("node")).agg(*bounds), "tiles")
    pairs = near_intervals(leaves, dims, radius)
    rows = tiled.select("tile", "rank", "class", "n", "vec").groupBy("tile")
    payload = stored(
        rows.applyInArrow(packed_tiles, "tile long, class binary, n binary, sizes binary, vec binary"), "tile-rows"
    )
    sides = pairs.select("a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("tile"))

    def compare(part: pa.Table) -> pa.Table:
        return tile_links([_unpacked(row) for row in part.sort_by("tile").to_pylist()], basis, cosine)

    return sides.join(payload, "tile").groupBy("a", "b").applyInArrow(compare, "a long, b long, n long")


def vector_duplicates(
    vectors: DataFrame, vector: str = "embedding", id: str = "vec_id", cosine: float = COSINE
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every vector.

    Equal vectors are one class and meet the others once. Unit vectors within
    an angle lie within a radius of each other, also in the projection on their
    leading principal directions. Classes are sorted by the cells of a grid of
    that radius there; intervals of this order are paired from the whole
    sequence down to tiles (``near_intervals``) and inside two tiles down to
    short intervals (``tile_links``), leaving out what provably lies apart. What
    remains is compared in double precision, so no link is lost or guessed. A
    tile pair gives back counts and a spanning forest, never its pairs.

    Vectors that are null, empty, zero or hold null, NaN or infinite components
    have no links and are components of their own. Vectors of different length
    are not linked. Repeated rows and ids each give a row and count as others;
    a null id is a component's smallest only where it has no other. An empty
    table gives no rows; only the two named columns are read.
    """
    x = F.col(f"`{vector}`")
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    rows = vectors.select(F.col(f"`{id}`").alias("id"), F.coalesce(whole, F.lit(False)).alias("whole"), x.alias("vec"))
    groups = rows.where("whole").groupBy("vec").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))
    groups = stored(groups.withColumn("class", F.monotonically_increasing_id()), "vector-classes")
    if groups.isEmpty():
        found = groups.select("vec", F.lit(0).cast("long").alias("n_links"), F.col("least").alias("component_id"))
    else:
        links = stored(class_links(groups.select("class", "vec", "n"), cosine), "vector-links")
        counts = links.where("b IS NULL").groupBy(F.col("a").alias("class")).agg(F.sum("n").alias("others"))
        joined = components(links.where("b IS NOT NULL").select("a", "b"))
        named = stored(
            groups.join(joined.select(F.col("node").alias("class"), "component"), "class", "left")
            .join(counts, "class", "left")
            .withColumn("component", F.coalesce("component", "class")),
            "named-vectors",
        )
        # written, so that Spark can split a large component where the two meet
        heads = stored(named.groupBy("component").agg(F.min("least").alias("component_id")), "component-heads")
        found = named.join(heads, "component").select(
            "vec", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id"
        )
    same = rows.where("whole").join(stored(found, "vector-results"), "vec").select("id", "n_links", "component_id")
    alone = rows.where("NOT whole").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return same.unionByName(alone).select(
        F.col("id").alias("vec_id"), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    )
