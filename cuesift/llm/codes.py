"""Vector codes: per-part codebooks, entries found over a trie of the distinct parts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096

# Integer components beyond this would let squared distances leave 64 bits.
LARGEST = 1 << 27

# Leaves swept at once; the path to the last one is carried to the next block.
LEAVES = 8192


class PartTrie:
    """Distances of parts to the entries of one codebook, over their trie.

    Parts come in lexicographic order, which is the order a depth-first walk
    meets the leaves in. A node of depth k holds the squared distances of its k
    components to all entries; every part below it goes on from that vector.
    The nodes of a block of leaves are made depth by depth, and the vectors on
    the path to its last leaf stay for the next block.
    """

    def __init__(self, book: np.ndarray):
        self.book = book
        self.last: np.ndarray | None = None
        self.path = np.zeros((book.shape[1], 1, len(book)), np.int64)

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry and squared distance of each of the sorted ``parts``."""
        entries, errors = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
        for begin in range(0, len(parts), LEAVES):
            chunk = slice(begin, begin + LEAVES)
            entries[chunk], errors[chunk] = self._block(parts[chunk])
        return entries, errors

    def _block(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        before = parts[:1] - 1 if self.last is None else self.last
        differs = parts != np.concatenate([before, parts[:-1]])
        opens = np.logical_or.accumulate(differs, axis=1)
        # node 0 of each depth is the one the block before ended in
        above, held = np.zeros(len(parts), np.int64), np.zeros((1, len(self.book)), np.int64)
        for depth in range(parts.shape[1]):
            at = np.flatnonzero(opens[:, depth])
            step = (parts[at, depth][:, None] - self.book[:, depth][None, :]) ** 2
            held = np.concatenate([self.path[depth], held[above[at]] + step])
            above = np.cumsum(opens[:, depth])
            self.path[depth] = held[above[-1]]
        self.last = parts[-1:]
        return held.argmin(axis=1)[above], held.min(axis=1)[above]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width).astype(np.int64)


def integer_vectors(vectors: DataFrame, vector: str = "embedding", id: str = "vec_id", label: str = "label") -> DataFrame:
    """``id, label, ints`` of the rows whose vector is whole; components as floor(4096 x)."""
    x = F.col(f"`{vector}`")
    finite: Column = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    ints = F.transform(x, lambda v: F.floor(v.cast("double") * SCALE))
    return vectors.where(F.coalesce(finite, F.lit(False))).select(
        F.col(f"`{id}`").alias("id"), F.col(f"`{label}`").alias("label"), ints.alias("ints")
    )


def _bounded(ints: np.ndarray) -> np.ndarray:
    if len(ints) and max(ints.max(), -ints.min()) > LARGEST:
        raise ValueError(f"a vector component lies beyond {LARGEST // SCALE} in absolute value")
    return ints


def distinct_parts(ints: DataFrame, width: int) -> DataFrame:
    """``pos, part, n``: every distinct part of every position, in lexicographic order within files."""
    cut = F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda i: F.slice("ints", i * width + 1, width))
    parts = ints.select(F.posexplode(cut).alias("pos", "part")).groupBy("pos", "part").agg(F.count(F.lit(1)).alias("n"))
    return stored(parts.repartitionByRange("pos", "part").sortWithinPartitions("pos", "part"), "parts")


def _totals(parts: DataFrame, books: np.ndarray) -> list:
    """Count and component sums of the parts of each entry, over all parts."""
    width = books.shape[2]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries = [PartTrie(book) for book in books]
        counts = np.zeros(books.shape[:2], np.int64)
        sums = np.zeros(books.shape, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            pos = batch.column("pos").to_numpy()
            weight = batch.column("n").to_numpy()
            rows = _bounded(_matrix(batch.column("part"), width))
            for p in np.unique(pos):
                of = pos == p
                entries, _ = tries[p].nearest(rows[of])
                np.add.at(counts[p], entries, weight[of])
                np.add.at(sums[p], entries, rows[of] * weight[of][:, None])
        p, e = np.nonzero(counts)
        each = [np.repeat(v, width) for v in (p, e, counts[p, e])]
        at = np.tile(np.arange(width), len(p))
        names = ["pos", "entry", "n", "at", "total"]
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (*each, at, sums[p, e].ravel())], names)

    sums = parts.mapInArrow(add, "pos long, entry long, n long, at long, total long")
    return sums.groupBy("pos", "entry", "at").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()


def train(ints: DataFrame, rounds: int = ROUNDS) -> np.ndarray | None:
    """Codebooks ``[part, entry, component]``; None without a vector to start from.

    The 16 smallest ids give the first entries (equal ids by their components,
    null ids last); fewer rows give fewer entries. Only the entries, 8 x 16 at
    most, and their sums ever reach the driver.
    """
    first = ints.orderBy(F.col("id").asc_nulls_last(), "ints").limit(ENTRIES).collect()
    if not first:
        return None
    start = _bounded(np.array([row.ints for row in first], np.int64))
    width = start.shape[1] // PARTS
    books = start.reshape(len(first), PARTS, width).transpose(1, 0, 2).copy()
    parts = distinct_parts(ints, width)
    for _ in range(rounds):
        for row in _totals(parts, books):
            books[row.pos, row.entry, row.at] = row.total // row.n
    return books


def encode(ints: DataFrame, books: np.ndarray) -> DataFrame:
    """``id, label, code, error`` of every row: one trie for each position of each batch."""
    width = books.shape[2]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digits = np.array([f"{i:02x}" for i in range(256)], "S2")
        for batch in batches:
            n = batch.num_rows
            rows = _bounded(_matrix(batch.column("ints"), width * PARTS)) if n else np.zeros((0, width * PARTS), np.int64)
            codes, errors = np.zeros((n, PARTS), np.int64), np.zeros(n, np.int64)
            for p in range(PARTS if n else 0):
                parts = rows[:, p * width : (p + 1) * width]
                order = np.lexsort(parts.T[::-1])
                codes[order, p], error = PartTrie(books[p]).nearest(parts[order])
                errors[order] += error
            text = [b"".join(row).decode() for row in digits[codes]]
            columns = [batch.column("id"), batch.column("label"), pa.array(text, pa.string()), pa.array(errors)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "label", "code", "error"])

    types = {f.name: f.dataType.simpleString() for f in ints.schema.fields}
    return ints.mapInArrow(assign, f"id {types['id']}, label {types['label']}, code string, error long")


def vector_codes(
    vectors: DataFrame, vector: str = "embedding", id: str = "vec_id", label: str = "label", rounds: int = ROUNDS
) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every whole vector.

    Each of the eight parts of a vector is replaced by the nearest entry of its
    codebook, after ``rounds`` rounds of moving the entries to the floor of
    their parts' mean; unused entries stay. Distances come from a trie of the
    distinct parts (``PartTrie``), so copies and shared prefixes cost once.

    Left out: vectors that are null or hold null, NaN or infinite components.
    The length is that of the smallest id with a whole vector of a multiple of
    eight components, none empty; vectors of another length have no code and are
    left out too. Components beyond 32768 raise an error instead of overflowing.
    Repeated rows and ids each give a row, null ids and labels stay (null labels
    share one ``label_error``). Empty tables give no rows. Other columns are
    never read.
    """
    ints = integer_vectors(vectors, vector, id, label)
    sized = ints.where((F.size("ints") > 0) & (F.size("ints") % PARTS == 0))
    first = sized.orderBy(F.col("id").asc_nulls_last(), "ints").select(F.size("ints").alias("n")).first()
    ints = ints.where(F.size("ints") == (first.n if first else -1))
    books = train(ints, rounds)
    if books is None:
        books = np.zeros((PARTS, 1, 1), np.int64)
    listed = ",".join(map(str, books.ravel().tolist()))
    coded = stored(encode(ints, books), "codes")
    totals = stored(
        coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of"), "label-errors"
    )
    return coded.join(totals, F.col("label").eqNullSafe(F.col("of"))).select(
        F.col("id").alias("vec_id"),
        "code",
        "error",
        "label_error",
        F.lit(hashlib.sha256(listed.encode()).hexdigest()).alias("codebooks_sha256"),
    )
