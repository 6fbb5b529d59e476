"""Referential checks and recall evaluation."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import BROADCAST_ROWS, cut_lineage, fits_broadcast, salted_join

# Segments whose tokens are met as bits at once.
_BIT_ROWS = 2048
# Pairs that a task gathers before it packs them by segment.
_PAIRS = 1 << 20
# Segments times terms that are compared at once.
_CELLS = 1 << 22


def missing_parents(name: str, child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Number of child rows whose non-null key has no parent.

    Children are counted per key before the join, so a key that most rows share
    crosses the network once per task.
    """
    held = child.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__key")).count()
    lost = held.join(parent.select(F.col(parent_key).alias("__key")), "__key", "left_anti")
    return lost.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("violations")).select(
        F.lit(name).alias("check_name"), "violations"
    )


def repeated_keys(name: str, table: DataFrame, keys: list[str]) -> DataFrame:
    """Number of key values that occur more than once."""
    held = table.groupBy(*keys).count().where(F.col("count") > 1)
    return held.agg(F.count(F.lit(1)).alias("violations")).select(
        F.lit(name).alias("check_name"), "violations"
    )


def unexpected_values(name: str, table: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """Number of rows outside an enumeration."""
    bad = table.where(~F.col(column).isin(allowed) | F.col(column).isNull())
    return bad.agg(F.count(F.lit(1)).alias("violations")).select(
        F.lit(name).alias("check_name"), "violations"
    )


def integrity_report(checks: list[DataFrame]) -> DataFrame:
    """All checks in one table, one row each."""
    return reduce(DataFrame.unionByName, checks)


def words(text: Column) -> Column:
    """Tokenizer: runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def runs_of(size: int) -> Callable[[Column], Column]:
    """Tokenizer: every run of ``size`` characters."""
    pattern = rf"(?s)(?=(.{{{size}}}))."
    return lambda text: F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(1))


def token_hits(
    segments: DataFrame, terms: DataFrame, tokenizer: Callable[[Column], Column]
) -> DataFrame:
    """``folded, segment_id`` of segments holding every token of a term.

    Terms without a token match nothing, as in a real index.
    """
    asked = terms.select("folded", F.array_distinct(tokenizer(F.col("folded"))).alias("tokens"))
    if not fits_broadcast(asked):
        return _joined_tokens(segments, asked, tokenizer)
    covers = [(row.folded, row.tokens) for row in asked.collect() if row.folded is not None and row.tokens]
    # a segment id that comes again, or is missing, is judged by all its rows together
    again = segments.groupBy(F.col("segment_id").alias("__again")).count().where("count > 1 OR __again IS NULL")
    again = cut_lineage(again.select("__again"))
    if again.isEmpty():
        return _bit_tokens(segments, covers, tokenizer)
    same = F.col("segment_id").eqNullSafe(F.col("__again"))
    alone = _bit_tokens(segments.join(again, same, "left_anti"), covers, tokenizer)
    return alone.unionByName(_joined_tokens(segments.join(again, same, "left_semi"), asked, tokenizer))


def _bit_tokens(
    segments: DataFrame, covers: list[tuple[str, list[str]]], tokenizer: Callable[[Column], Column]
) -> DataFrame:
    """Few terms, found where the texts of segments with an id of their own are read."""
    tokens = segments.select("segment_id", tokenizer(F.col("text")).alias("tokens"))
    kind = tokens.schema["segment_id"].dataType.simpleString()
    return tokens.mapInArrow(_token_finder(covers), f"folded string, segment_id {kind}")


def _token_finder(covers: list[tuple[str, list[str]]]) -> Callable:
    """Terms of batches ``segment_id, tokens``: the segments that hold each token, as bits, met by term."""
    wanted = sorted({token for _, tokens in covers for token in tokens})

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {token: n for n, token in enumerate(wanted)}
        asked = [[number[token] for token in tokens] for _, tokens in covers]
        names, values = pa.array([folded for folded, _ in covers], pa.string()), pa.array(wanted, pa.string())
        for batch in batches:
            for begin in range(0, len(batch), _BIT_ROWS):
                part = batch.slice(begin, _BIT_ROWS)
                lists = part.column("tokens")
                which = pc.index_in(pc.list_flatten(lists), value_set=values)
                kept = pc.is_valid(which)
                held = np.zeros((len(wanted), len(part)), bool)
                held[
                    which.filter(kept).to_numpy(), pc.list_parent_indices(lists).filter(kept).to_numpy()
                ] = True
                rows = [np.flatnonzero(np.logical_and.reduce(held[tokens])) for tokens in asked]
                term = np.repeat(np.arange(len(rows)), np.array([len(r) for r in rows], np.int64))
                row = np.concatenate([np.zeros(0, np.int64), *rows])
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array(term)), part.column("segment_id").take(pa.array(row))], ["folded", "segment_id"]
                )

    return find


def _joined_tokens(segments: DataFrame, asked: DataFrame, tokenizer: Callable[[Column], Column]) -> DataFrame:
    """The same by joins, for terms too many to be sent to the tasks."""
    asked = asked.select("folded", F.size("tokens").alias("needed"), F.explode("tokens").alias("token"))
    offered = segments.select(
        "segment_id", F.explode(F.array_distinct(tokenizer(F.col("text")))).alias("token")
    )
    met = salted_join(offered, asked, ["token"], "inner", F.col("segment_id"))
    return (
        met.groupBy("folded", "needed", "segment_id")
        .count()
        .where(F.col("count") == F.col("needed"))
        .select("folded", "segment_id")
    )


def recall_eval(
    truth: DataFrame, methods: dict[str, DataFrame], terms: DataFrame
) -> DataFrame:
    """``method, folded, expected, returned, hit, recall`` against substring truth.

    ``truth`` and each method are ``folded, segment_id`` pairs. All are stacked,
    packed by segment as the numbers of their terms, and compared where the rows
    of a segment meet; a pair crosses the network as two bytes at most. Terms too
    many to be numbered on the driver are grouped pair by pair.
    """
    wanted = terms.select("folded").distinct()
    rows = wanted.limit(BROADCAST_ROWS + 1).collect()
    if len(rows) > BROADCAST_ROWS:
        counted = _joined_counts(truth, methods)
    else:
        counted = _packed_counts(truth, methods, sorted(row.folded for row in rows if row.folded is not None))
    names = F.array(*[F.lit(name) for name in methods])
    full = wanted.select("folded", F.explode(names).alias("method")).join(counted, ["method", "folded"], "left")
    full = full.fillna(0, ["expected", "returned", "hit"])
    return full.withColumn(
        "recall",
        F.when(F.col("expected") == 0, F.lit(1.0)).otherwise(F.col("hit") / F.col("expected")),
    )


def _packed_counts(truth: DataFrame, methods: dict[str, DataFrame], wanted: list[str]) -> DataFrame:
    """``method, folded, expected, returned, hit`` of the terms ``wanted``.

    Source 0 is the truth, the methods follow.
    """

    def packed(found: DataFrame, source: int) -> DataFrame:
        kind = found.schema["segment_id"].dataType.simpleString()
        form = f"segment_id {kind}, source int, dense boolean, terms binary"
        return found.select("folded", "segment_id").mapInArrow(_pack_terms(wanted, source), form)

    rows = reduce(DataFrame.unionByName, [packed(found, at) for at, found in enumerate([truth, *methods.values()])])
    met = rows.repartition("segment_id").sortWithinPartitions("segment_id")
    counted = met.mapInArrow(
        _count_terms(wanted, list(methods)), "method string, folded string, expected long, returned long, hit long"
    )
    return counted.groupBy("method", "folded").agg(*[F.sum(c).alias(c) for c in ("expected", "returned", "hit")])


def _codes(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """A number for each value of ``column``, null too, and the value of each number."""
    coded = column.dictionary_encode(null_encoding="encode")
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary


def _pack_terms(wanted: list[str], source: int) -> Callable:
    """Rows ``segment_id, source, dense, terms`` of pairs ``folded, segment_id``.

    The terms of a segment are bits where these are shorter, else numbers of two bytes.
    """
    width = -(-len(wanted) // 8)

    def rows(pairs: list[tuple[np.ndarray, pa.Array]]) -> Iterator[pa.RecordBatch]:
        term = np.concatenate([p[0] for p in pairs]).astype(np.int64)
        segment, ids = _codes(pa.chunked_array([p[1] for p in pairs]).combine_chunks())
        place = segment * len(wanted) + term
        order = np.argsort(place, kind="stable")
        order = order[np.append(True, np.diff(place[order]) != 0)]
        term, group = term[order], place[order] // len(wanted)
        first = np.flatnonzero(np.append(True, np.diff(group) != 0))
        size = np.diff(np.append(first, len(term)))
        for dense in (False, True):
            chosen = np.flatnonzero((size * 2 > width) == dense)
            step = max(_CELLS // len(wanted), 1) if dense else max(len(chosen), 1)
            for begin in range(0, len(chosen), step):
                some = chosen[begin : begin + step]
                row = np.repeat(np.arange(len(some)), size[some])
                at = np.arange(len(row)) + np.repeat(first[some] - (np.cumsum(size[some]) - size[some]), size[some])
                if dense:
                    bits = np.zeros((len(some), len(wanted)), bool)
                    bits[row, term[at]] = True
                    values, ends = np.packbits(bits, axis=1).reshape(-1), np.arange(len(some) + 1) * width
                else:
                    values = term[at].astype("<u2").view(np.uint8)
                    ends = np.append(0, np.cumsum(size[some])) * 2
                held = pa.Array.from_buffers(
                    pa.binary(), len(some), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(values)]
                )
                of = order[first[some]]
                columns = [ids.take(pa.array(segment[of])), pa.array(np.full(len(some), source, np.int32))]
                columns += [pa.array(np.full(len(some), dense)), held]
                yield pa.RecordBatch.from_arrays(columns, ["segment_id", "source", "dense", "terms"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, pairs = pa.array(wanted, pa.string()), []
        for batch in batches:
            term = pc.index_in(batch.column("folded"), value_set=values)
            known = pc.is_valid(term)
            pairs.append((term.filter(known).to_numpy(), batch.column("segment_id").filter(known)))
            if sum(len(p[0]) for p in pairs) >= _PAIRS:
                yield from rows(pairs)
                pairs = []
        if sum(len(p[0]) for p in pairs):
            yield from rows(pairs)

    return pack


def _count_terms(wanted: list[str], methods: list[str]) -> Callable:
    """Counts of a task by method and term, from rows of ``_pack_terms`` in the order of their segments."""
    step = max(_CELLS // max(len(wanted), 1), 1)

    def unpacked(terms: pa.Array, dense: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and term of every pair."""
        bits, few = np.flatnonzero(dense), np.flatnonzero(~dense)
        joined = lambda at: b"".join(terms.take(pa.array(at)).to_pylist())
        one = np.frombuffer(joined(bits), np.uint8).reshape(len(bits), -1 if len(bits) else 1)
        row, term = np.nonzero(np.unpackbits(one, axis=1))
        size = pc.binary_length(terms).to_numpy()[few] // 2
        other = np.frombuffer(joined(few), "<u2")
        return np.append(bits[row], np.repeat(few, size)), np.append(term, other)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expected = np.zeros(len(wanted), np.int64)
        returned, hit = (np.zeros((len(methods), len(wanted)), np.int64) for _ in range(2))
        rest = None
        for batch in chain(batches, [None]):
            parts = [b for b in (rest, batch) if b is not None and len(b)]
            if not parts:
                continue
            rows = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
            segment = _codes(rows.column("segment_id"))[0]
            starts = np.flatnonzero(np.append(True, np.diff(segment) != 0))
            # the last segment may go on
            end = len(rows) if batch is None else int(starts[-1])
            rest = rows.slice(end)
            for a, b in pairwise([*starts[starts < end][::step].tolist(), end]):
                some = rows.slice(a, b - a)
                row, term = unpacked(some.column("terms"), some.column("dense").to_numpy(False))
                within = np.cumsum(np.append(0, np.diff(segment[a:b]) != 0))
                held = np.zeros((len(methods) + 1, within[-1] + 1, len(wanted)), bool)
                held[some.column("source").to_numpy()[row], within[row], term] = True
                expected += held[0].sum(axis=0)
                for at in range(len(methods)):
                    returned[at] += held[at + 1].sum(axis=0)
                    hit[at] += (held[at + 1] & held[0]).sum(axis=0)
        method = pa.array(np.repeat(methods, len(wanted)).tolist(), pa.string())
        columns = [np.tile(expected, len(methods)), returned.reshape(-1), hit.reshape(-1)]
        yield pa.RecordBatch.from_arrays(
            [method, pa.array(wanted * len(methods), pa.string()), *map(pa.array, columns)],
            ["method", "folded", "expected", "returned", "hit"],
        )

    return count


def _joined_counts(truth: DataFrame, methods: dict[str, DataFrame]) -> DataFrame:
    """The counts of all terms that stand in a pair, grouped pair by pair."""
    none = F.lit(None).cast("string")
    rows = truth.select("folded", "segment_id", none.alias("method"))
    for name, found in methods.items():
        rows = rows.unionByName(found.select("folded", "segment_id", F.lit(name).alias("method")))
    # one row per pair: whether it is true, and the methods that found it
    by = [F.max(F.coalesce(F.col("method") == name, F.lit(False))) for name in methods]
    pairs = rows.groupBy("folded", "segment_id").agg(
        F.max(F.col("method").isNull()).alias("is_true"), F.array(*by).alias("found_by")
    )
    names = F.array(*[F.lit(name) for name in methods])
    judged = pairs.select("folded", "is_true", F.explode(F.arrays_zip(names.alias("method"), F.col("found_by").alias("found"))).alias("by"))
    judged = judged.select("folded", "is_true", "by.method", "by.found")
    found = F.col("found")
    return judged.groupBy("method", "folded").agg(
        F.sum(F.col("is_true").cast("long")).alias("expected"),
        F.sum(found.cast("long")).alias("returned"),
        F.sum((found & F.col("is_true")).cast("long")).alias("hit"),
    )
