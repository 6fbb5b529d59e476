"""Prefix trie of conversations, read off their sorted order by range minima."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

# Conversations with their turns are kept in runs of about so many together.
RUN = 1 << 15

# Bytes of a turn's digest.
TURN = 16

EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()

FRAGMENTS = (
    "key binary, parent_key binary, run long, depth long, least long, parent_least long, n long, "
    "children long, leaves long, saved long, ends string, ends_sha256 string"
)


def sequences(turns: DataFrame) -> DataFrame:
    """``conv_id, path, sizes``: the digests of a conversation's turns end to end, and their texts' bytes.

    Turns go by number, null first; turns of one number by digest. Only digests
    are gathered, never texts.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text))
    size = F.octet_length(text).cast("long")
    rows = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", digest.alias("digest"), size.alias("size")).alias("t")
    )
    listed = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    return listed.select(
        "conv_id",
        F.unhex(F.array_join(F.transform("ts", lambda t: t["digest"]), "")).alias("path"),
        F.transform("ts", lambda t: t["size"]).alias("sizes"),
    )


def regrown(found: DataFrame, group: int = 5, longest: int = 9) -> DataFrame:
    """Every conversation after a prefix of the first one of its group of ids.

    Of ``conv_id`` c the first h = crc32(c) % ``longest`` turns are those of
    conversation c - c % ``group`` (fewer if it is shorter, none if it is not
    there), followed by c's own turns after its first h.
    """
    found = stored(found, "conversations")
    base = found.select(F.col("conv_id").alias("of"), F.col("path").alias("base_path"), F.col("sizes").alias("base_sizes"))
    kept = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % longest).cast("int")
    head = F.coalesce(F.expr(f"substring(base_path, 1, kept * {TURN})"), F.lit(b""))
    own = F.expr(f"substring(path, kept * {TURN} + 1)")
    sizes = F.concat(
        F.coalesce(F.slice("base_sizes", 1, F.col("kept")), F.array().cast("array<bigint>")),
        F.slice("sizes", F.col("kept") + 1, F.size("sizes")),
    )
    both = found.join(base, F.expr(f"conv_id - conv_id % {group}") == F.col("of"), "left").withColumn("kept", kept)
    return both.select("conv_id", F.concat(head, own).alias("path"), sizes.alias("sizes"))


def _common(a: bytes | None, b: bytes | None) -> int:
    """Turns that two paths begin with together; -1 without a second path."""
    if a is None or b is None:
        return -1
    n = min(len(a), len(b)) // TURN
    x, y = (np.frombuffer(v, "S%d" % TURN, n).view("<u8").reshape(n, 2) for v in (a, b)) if n else (np.zeros((0, 2)),) * 2
    other = np.flatnonzero((x != y).any(axis=1))
    return int(other[0]) if len(other) else n


def sorted_runs(rebuilt: DataFrame) -> DataFrame:
    """Conversations sorted by path and id, cut into runs that one row holds.

    ``before, after`` are the turns shared with the conversations next to the
    run; both are -1 at the ends of the whole order.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["run", "ids", "lengths", "paths", "sizes", "before", "after", "first", "last"]
        types = [pa.int64(), *[pa.binary()] * 4, *[pa.int64()] * 2, *[pa.binary()] * 2]
        number = TaskContext.get().partitionId() << 33
        held, weight, last = [], 0, None
        first_run = True

        def record(following: bytes | None) -> pa.RecordBatch:
            ids, paths, sizes = zip(*held)
            cells = [
                number,
                np.array(ids, "<i8").tobytes(),
                np.array([len(p) // TURN for p in paths], "<i8").tobytes(),
                b"".join(paths),
                np.concatenate([np.asarray(s, "<i8") for s in sizes]).tobytes(),
                None if first_run else _common(last, paths[0]),
                None if following is None else _common(paths[-1], following),
                paths[0] if first_run else None,
                paths[-1] if following is None else None,
            ]
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, types)], names)

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("conv_id", "path", "sizes"))
            for conv, path, sizes in zip(*columns):
                if weight >= RUN:
                    yield record(path)
                    last, first_run, number = held[-1][1], False, number + 1
                    held, weight = [], 0
                held.append((conv, path, sizes))
                weight += 1 + len(sizes)
        if held:
            yield record(None)

    order = ["path", "conv_id"]
    schema = "run long, ids binary, lengths binary, paths binary, sizes binary, before long, after long, first binary, last binary"
    runs = rebuilt.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(cut, schema)
    runs = stored(runs, "runs")
    # one or two rows for each task of the sort
    ends = runs.where("first IS NOT NULL OR last IS NOT NULL").select("run", "first", "last")
    by_run = Window.orderBy("run")
    past = F.last("last", ignorenulls=True).over(by_run.rowsBetween(Window.unboundedPreceding, -1))
    coming = F.first("first", ignorenulls=True).over(by_run.rowsBetween(1, Window.unboundedFollowing))
    met = ends.select("run", "first", "last", past.alias("past"), coming.alias("coming"))

    def common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, last, past, coming = (batch.column(c).to_pylist() for c in ("first", "last", "past", "coming"))
            columns = [
                batch.column("run"),
                pa.array([_common(a, b) for a, b in zip(past, first)], pa.int64()),
                pa.array([_common(a, b) for a, b in zip(last, coming)], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["run", "outer_before", "outer_after"])

    edges = stored(met.mapInArrow(common, "run long, outer_before long, outer_after long"), "run-edges")
    return runs.drop("first", "last").join(F.broadcast(edges), "run", "left").select(
        "run", "ids", "lengths", "paths", "sizes",
        F.coalesce("before", "outer_before").alias("before"), F.coalesce("after", "outer_after").alias("after"),
    )


class RangeMinimum:
    """Sparse table of minima over all power-of-two ranges."""

    def __init__(self, values: np.ndarray):
        self.rows = [values]
        while 2 * (step := 1 << (len(self.rows) - 1)) <= len(values):
            self.rows.append(np.minimum(self.rows[-1][:-step], self.rows[-1][step:]))

    def over(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Minima of the ranges ``first`` to ``last``, both included."""
        level = np.frexp((last - first + 1).astype(np.float64))[1] - 1
        out = np.empty(len(first), self.rows[0].dtype)
        for k in np.unique(level):
            of = level == k
            row = self.rows[k]
            out[of] = np.minimum(row[first[of]], row[last[of] - (1 << int(k)) + 1])
        return out

    def reach(self, start: np.ndarray, least: np.ndarray, forward: bool) -> np.ndarray:
        """How many values from ``start`` on (or back) stay at ``least`` or above, by binary search."""
        count = np.zeros(len(start), np.int64)
        for k in range(len(self.rows) - 1, -1, -1):
            row, step = self.rows[k], 1 << k
            at = start + count if forward else start - count - step + 1
            fits = (at >= 0) & (at < len(row))
            fits[fits] = row[at[fits]] >= least[fits]
            count[fits] += step
        return count


def run_fragments(run: int, ids, lengths, paths: bytes, sizes, before: int, after: int) -> pa.Table:
    """The trie nodes of one run: whole ones, and parts of those that reach beyond it.

    Every prefix (conversation i, depth d) looks for its own extents: as far as
    the shared lengths to the left and right stay at d. Prefixes with the same
    extents are one node, named by the leftmost. Nodes in order of first
    conversation and depth hold every subtree as one stretch, so sums over
    subtrees are differences of running sums.
    """
    m = len(ids)
    turns = np.frombuffer(paths, "<u8").reshape(-1, 2)
    first_turn = np.cumsum(lengths) - lengths
    # shared[i]: turns that conversations i - 1 and i begin with together
    shared = np.concatenate([[before], np.minimum(lengths[:-1], lengths[1:]), [after]])
    pair = np.repeat(np.arange(1, m), shared[1:m])
    place = np.arange(len(pair)) - np.repeat(np.cumsum(shared[1:m]) - shared[1:m], shared[1:m])
    other = (turns[first_turn[pair - 1] + place] != turns[first_turn[pair] + place]).any(axis=1)
    np.minimum.at(shared, pair[other], place[other])

    row = np.repeat(np.arange(m), lengths + 1)
    cut = np.cumsum(lengths + 1) - lengths - 1
    depth = np.arange(len(row)) - cut[row]
    inner = RangeMinimum(shared[1:m]) if m > 1 else None
    left, right = row.copy(), row.copy()
    if inner is not None:
        left -= inner.reach(row - 1, depth, forward=False)
        right += inner.reach(row, depth, forward=True)
    named = left == row
    node_of = (np.cumsum(named) - 1)[cut[left] + depth]
    parent_of = np.where(depth > 0, node_of[np.maximum(np.arange(len(row)) - 1, 0)], -1)

    low, high, depth_n, parent = left[named], right[named], depth[named], parent_of[named]
    count = high - low + 1
    starts = (low > 0) | (depth_n > before)
    ends = (high < m - 1) | (depth_n > after)
    open_ = ~(starts & ends)
    size = np.zeros(len(low), np.int64)
    size[depth_n > 0] = sizes[(first_turn[low] + depth_n - 1)[depth_n > 0]]

    children = np.bincount(parent[starts & (depth_n > 0)], minlength=len(low))
    leaf = np.concatenate([[0], np.cumsum(lengths > shared[1:])])
    leaves = leaf[high + 1] - leaf[low]
    # all members but the first one save the node's text; the first counts where the node begins
    weight = np.concatenate([[0], np.cumsum((count - starts) * size)])
    behind = np.searchsorted(low, high, side="right")
    saved = weight[behind] - weight[np.arange(len(low))]
    least = RangeMinimum(ids).over(low, high)

    chains = []
    for i, reach in ((0, before), (m - 1, after)):
        hashed, chain = hashlib.md5(), []
        for d in range(reach + 1):
            if d:
                at = first_turn[i] + d - 1
                hashed.update(paths[at * TURN : (at + 1) * TURN])
            chain.append(hashed.digest())
        chains.append(chain)
    key = [None] * len(low)
    for v in np.flatnonzero(open_):
        key[v] = chains[0][depth_n[v]] if not starts[v] else chains[1][depth_n[v]]
    above = [key[p] if p >= 0 else None for p in parent]
    parent_least = np.where(parent >= 0, least[parent], 0)
    hidden = np.array([p < 0 or key[p] is not None for p in parent], bool)

    closing = node_of[cut + lengths]
    ended = [None] * len(low)
    digest = [EMPTY_SHA256 if not o else None for o in open_]
    begins = np.flatnonzero(np.append(True, closing[1:] != closing[:-1])) if m else np.zeros(0, np.int64)
    for a, b in zip(begins, np.append(begins[1:], m)):
        listed, v = ",".join(map(str, ids[a:b].tolist())), closing[a]
        if open_[v]:
            ended[v] = listed
        else:
            digest[v] = hashlib.sha256(listed.encode()).hexdigest()
    columns = [
        pa.array(key, pa.binary()),
        pa.array(above, pa.binary()),
        pa.array(np.full(len(low), run)),
        pa.array(depth_n),
        pa.array(least),
        pa.array(parent_least, mask=hidden),
        *map(pa.array, (count, children, leaves, saved)),
        pa.array(ended, pa.string()),
        pa.array(digest, pa.string()),
    ]
    return pa.table(columns, [c.split()[0] for c in FRAGMENTS.split(", ")])


def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
            numbers = [np.frombuffer(row[c], "<i8") for c in ("ids", "lengths")]
            sizes = np.frombuffer(row["sizes"], "<i8")
            found = run_fragments(row["run"], *numbers, row["paths"], sizes, row["before"], row["after"])
            yield from found.combine_chunks().to_batches(max_chunksize=RUN)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of the id lists of each key, which come in order, a piece at a time."""
    current, hashed = None, None
    out = lambda: pa.RecordBatch.from_arrays(
        [pa.array([current], pa.binary()), pa.array([hashed.hexdigest()])], ["key", "ends_sha256"]
    )
    for batch in batches:
        for key, piece in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist()):
            if key == current:
                hashed.update(b"," + piece.encode())
                continue
            if current is not None:
                yield out()
            current, hashed = key, hashlib.sha256(piece.encode())
    if current is not None:
        yield out()


def prefix_trie(turns: DataFrame, group: int = 5, longest: int = 9) -> DataFrame:
    """The trie over the turns of all rebuilt conversations, one row a node.

    ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256``; see ``regrown`` for how conversations are
    rebuilt and ``run_fragments`` for how nodes are found. The sorted order is
    cut into runs, so a first turn that a third of all conversations share is
    met by many tasks; only the few nodes that reach beyond a run, the shared
    beginnings of the conversations at its borders, are added up by key.

    Null roles and texts count as empty. Rows without a conversation id belong
    to none and are left out; repeated rows are repeated turns; turns with one
    number (or none, which come first) go by the digest of role and text. Very
    long texts are hashed where they stand; the digests of one conversation, 16
    bytes a turn, make one row. An empty table has no conversation, so no root.
    Other columns are never read.
    """
    rebuilt = regrown(sequences(turns), group, longest)
    fragments = stored(sorted_runs(rebuilt).mapInArrow(_fragments, FRAGMENTS), "fragments")
    open_ = fragments.where("key IS NOT NULL")
    merged = open_.groupBy("key").agg(
        F.first("parent_key").alias("parent_key"),
        F.first("depth").alias("depth"),
        F.min("least").alias("least"),
        *[F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")],
    )
    pieces = open_.where("ends IS NOT NULL").select("key", "run", "ends")
    ends = pieces.repartition("key").sortWithinPartitions("key", "run").mapInArrow(_ends, "key binary, ends_sha256 string")
    values = ["depth", "least", "n", "children", "leaves", "saved", "ends_sha256"]
    merged = stored(
        merged.join(ends, "key", "left")
        .withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)))
        .select("key", "parent_key", *values),
        "open-nodes",
    )
    closed = fragments.where("key IS NULL")
    parents = merged.select(F.col("key").alias("parent_key"), F.col("least").alias("parent_least"))
    below = closed.where("parent_key IS NOT NULL").select("parent_key", *values).unionByName(
        merged.where("parent_key IS NOT NULL").select("parent_key", *values)
    )
    known = closed.where("parent_key IS NULL").select(*values, "parent_least")
    root = merged.where("parent_key IS NULL").select(*values, F.lit(None).cast("long").alias("parent_least"))
    nodes = known.unionByName(root).unionByName(below.join(parents, "parent_key").select(*values, "parent_least"))
    return nodes.select(
        F.col("least").alias("conv_id"),
        "depth",
        F.col("parent_least").alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        "ends_sha256",
    )
