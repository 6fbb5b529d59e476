"""Substring dedup by content-defined chunks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ids import IdSet
from ..session import stored
from .arrays import NOT_SPACE, flat, mix, row_key, slices, words

# A cut falls after about one byte in 2^CUT_BITS, and not within LEAST bytes of
# the cut before it; no chunk is longer than MOST bytes.
CUT_BITS = 5
LEAST = 20
MOST = 256

# Words that a repeated passage has before it counts.
RUN_WORDS = 16

# Bytes beside a seed that are compared first; seeds that agree in all of them
# are compared again over everything beside them.
AROUND = 96

_WINDOW = 16


def _gear() -> np.ndarray:
    return (mix(np.arange(1001, 1257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


GEAR = _gear()


def cuts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where chunks begin: the row bounds and the places their content decides.

    The gear hash of a place adds a number for each byte, shifted once for every
    byte that follows, and sees the last 16 bytes. It is added up for all
    places together by doubling the window, and never reaches into another row.
    A cut follows a place whose highest bits are zero, so an insertion moves only
    the cuts within a window of it. Characters are never split.
    """
    if not len(data):
        return np.zeros(0, np.int64)
    place = np.arange(len(data)) - np.repeat(bounds[:-1], np.diff(bounds))
    gear = GEAR[data]
    step = 1
    while step < _WINDOW:
        moved = np.zeros_like(gear)
        moved[step:] = gear[:-step] << np.uint32(step)
        moved[place < step] = 0
        gear = gear + moved
        step *= 2
    begin = np.zeros(len(data) + 1, bool)
    begin[1:] = gear >> np.uint32(32 - CUT_BITS) == 0
    begin[:-1] &= (data & 0xC0) != 0x80
    begin[len(data)] = False
    found = np.flatnonzero(begin)
    # a cut too near to the one before it, or to the row's begin, is dropped
    row_begin = bounds[np.searchsorted(bounds, found, "right") - 1]
    before = np.maximum(np.append(0, found[:-1]), row_begin) if len(found) else found
    found = found[found - before >= LEAST]
    heads = bounds[:-1][bounds[:-1] < bounds[1:]]
    found = np.union1d(found, heads)
    size = np.diff(np.append(found, len(data)))
    extra = (size - 1) // MOST
    if extra.any():
        first = np.repeat(found, extra)
        number = np.arange(len(first)) - np.repeat(np.cumsum(extra) - extra, extra) + 1
        forced = first + number * MOST
        for _ in range(3):
            forced = forced - ((data[forced] & 0xC0) == 0x80)
        found = np.union1d(found, forced)
    return found


def chunks(docs: DataFrame) -> DataFrame:
    """``key, doc_id, high, low, begins, sizes``: the chunks of every document in order.

    ``high, low`` are 96 bits of the chunks' digests, ``begins`` and ``sizes``
    their places and lengths in bytes of UTF-8.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, bounds = flat(part.column("text"))
                begin = cuts(data, bounds)
                end = np.append(begin[1:], len(data))[: len(begin)]
                text = data.tobytes()
                digests = b"".join(blake2b(text[a:b], digest_size=16).digest() for a, b in zip(begin, end))
                high = np.frombuffer(digests, np.int64)[::2]
                low = np.frombuffer(digests, np.int32)[2::4]
                upto = np.searchsorted(begin, bounds)
                inside = begin - np.repeat(bounds[:-1], np.diff(upto))
                columns = [high.copy(), low.copy(), inside.astype(np.int32), (end - begin).astype(np.int32)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), part.column("doc_id")]
                    + [pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.array(c)) for c in columns],
                    names=["key", "doc_id", "high", "low", "begins", "sizes"],
                )

    rows = docs.select(row_key().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(
        cut,
        "key binary, doc_id long, high array<long>, low array<int>, begins array<int>, sizes array<int>",
    )


def repeated_chunks(cut: DataFrame) -> DataFrame:
    """``row, key, repeats``: the chunks that stand earlier, and the place where they do.

    ``cut(row, key, doc_id, high, low, begins, sizes)``. The earliest place of a
    digest is that of the smallest id, then row, then place. Digests are counted
    without their places first; only places of repeated digests are joined and
    compared.
    """
    counts = (
        cut.select(F.inline(F.arrays_zip("high", "low")))
        .groupBy("high", "low")
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n > 1")
    )
    places = cut.select("row", "key", "doc_id", F.inline(F.arrays_zip("high", "low", "begins", "sizes"))).select(
        "row", "key", "doc_id", "high", "low", F.col("begins").alias("begin"), F.col("sizes").alias("size")
    )
    met = stored(places.join(counts.select("high", "low"), ["high", "low"]), "repeated-chunks")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row", "begin", "key")
    first = met.groupBy("high", "low").agg(F.min(order).alias("first"))
    later = met.join(first, ["high", "low"]).where(
        (F.col("row") != F.col("first.row")) | (F.col("begin") != F.col("first.begin"))
    )
    repeat = F.struct(
        "begin",
        (F.col("begin") + F.col("size")).alias("end"),
        F.col("first.key").alias("first_key"),
        F.col("first.begin").alias("first_begin"),
        F.col("first.doc_id").alias("first_id"),
    )
    return later.groupBy("row").agg(F.first("key").alias("key"), F.collect_list(repeat).alias("repeats"))


_SEED = (
    "row long, key binary, begin int, end int, n int, first_key binary, first_begin int, first_end int, "
    "first_id long, before int, after int, whole_left boolean, whole_right boolean"
)
_RUN = pa.schema(
    [("row", pa.int64()), ("key", pa.binary()), ("begin", pa.int32()), ("end", pa.int32()), ("n", pa.int32()),
     ("first_key", pa.binary()), ("first_begin", pa.int32()), ("first_end", pa.int32()), ("first_id", pa.int64()),
     ("before", pa.int32()), ("after", pa.int32()), ("whole_left", pa.bool_()), ("whole_right", pa.bool_())]
)
# Where no other seed bounds the text beside one.
_FREE = (1 << 31) - 1


def seeds(repeats: DataFrame) -> DataFrame:
    """Runs of repeated chunks whose first places follow each other in one text, ``n`` chunks each.

    ``before`` and ``after`` are the bytes up to the next runs that have their
    first places in the same text at the same distance: what agrees so far goes
    on there, so no text is compared twice.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for record in batch.to_pylist():
                runs = []
                for r in sorted(record["repeats"], key=lambda r: r["begin"]):
                    size = r["end"] - r["begin"]
                    last = runs[-1] if runs else None
                    if (
                        last
                        and last["end"] == r["begin"]
                        and last["first_key"] == r["first_key"]
                        and last["first_end"] == r["first_begin"]
                        and last["first_id"] == r["first_id"]
                    ):
                        last.update(end=r["end"], n=last["n"] + 1, first_end=last["first_end"] + size)
                    else:
                        own = {"row": record["row"], "key": record["key"], "n": 1, "first_end": r["first_begin"] + size}
                        runs.append(own | r)
                beside = {}
                for run in runs:
                    line = run["first_key"], run["first_begin"] - run["begin"]
                    run.update(before=_FREE, after=_FREE, whole_left=True, whole_right=True)
                    if line in beside:
                        run["before"] = beside[line]["after"] = run["begin"] - beside[line]["end"]
                    beside[line] = run
                out += runs
            yield pa.RecordBatch.from_pylist(out, schema=_RUN)

    return repeats.mapInArrow(join, _SEED)


_PLACE = ["key", "begin", "end", "before", "after"]


def surroundings(places: DataFrame, texts: DataFrame) -> DataFrame:
    """``left, right`` of the places: ``before`` and ``after`` bytes beside them, or what there is.

    ``left_all`` and ``right_all`` say that a side holds all there is of the text.
    """
    kinds = [pa.binary()] + [pa.int32()] * 4 + [pa.binary()] * 2 + [pa.bool_()] * 2
    shape = pa.schema(list(zip([*_PLACE, "left", "right", "left_all", "right_all"], kinds)))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                for record in part.to_pylist():
                    data = (record["text"] or "").encode()
                    out = []
                    held = 0
                    for place in record["places"]:
                        a, b, before, after = (place[name] for name in _PLACE[1:])
                        left, right = data[max(0, a - before) : a], data[b : b + after]
                        out.append(
                            place
                            | {"key": record["key"], "left": left, "right": right}
                            | {"left_all": a <= before, "right_all": b + after >= len(data)}
                        )
                        held += len(left) + len(right)
                        if held > 1 << 20:
                            yield pa.RecordBatch.from_pylist(out, schema=shape)
                            out, held = [], 0
                    yield pa.RecordBatch.from_pylist(out, schema=shape)

    listed = places.groupBy("key").agg(F.collect_set(F.struct(*_PLACE[1:])).alias("places"))
    return listed.join(texts, "key").mapInArrow(
        take,
        "key binary, begin int, end int, before int, after int, "
        "left binary, right binary, left_all boolean, right_all boolean",
    )


def _same(mine: bytes, other: bytes) -> int:
    """Length of the common beginning."""
    size = min(len(mine), len(other))
    if mine[:size] == other[:size]:
        return size
    a, b = np.frombuffer(mine, np.uint8, size), np.frombuffer(other, np.uint8, size)
    return int(np.argmax(a != b))


def _reach(mine: bytes, other: bytes, mine_all: bool, other_all: bool, most: int) -> tuple[int, bool, bool]:
    """How far two sides agree, whether no word of the other goes on there, and whether more is to be read."""
    far = _same(mine, other)
    if far == most:
        return far, True, False
    more = (far == len(mine) and not mine_all) or (far == len(other) and not other_all)
    return far, not other[far : far + 1].strip(), more


def _texts_of(keys: DataFrame, texts: DataFrame) -> DataFrame:
    """The rows of ``texts`` that may belong to ``keys``.

    A bit for each of 2^25 hashes, at most 4 MB in all, is tested where the
    texts are read, so that texts without a seed are not shuffled.
    """
    number = F.pmod(F.xxhash64("key"), F.lit(1 << 25))
    marked = IdSet(keys.select(number.alias("hash")), "hash")
    return marked.present_in(texts.withColumn("hash", number)).drop("hash").dropDuplicates(["key"])


def extended(runs: DataFrame, texts: DataFrame, around: int = AROUND) -> DataFrame:
    """``row, begin, end, n, first_id, whole_left, whole_right`` of the seeds, as far as both texts agree.

    The bytes beside a seed are compared with those beside its first place. Seeds
    that agree in all that was read go into a second round, where the side that agreed is read on to its end.
    ``whole_left`` and ``whole_right`` say that no word of the first text goes on
    where the agreement ends.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                out = []
                for r in batch.slice(at, 64).to_pylist():
                    left, whole_left, more_left = _reach(
                        r["left"][::-1], r["first_left"][::-1], r["left_all"], r["first_left_all"], r["most_before"]
                    )
                    right, whole_right, more_right = _reach(
                        r["right"], r["first_right"], r["right_all"], r["first_right_all"], r["most_after"]
                    )
                    for name, by in (("begin", -left), ("first_begin", -left), ("end", right), ("first_end", right)):
                        r[name] += by
                    r["whole_left"] &= whole_left or more_left
                    r["whole_right"] &= whole_right or more_right
                    r["before"] = (r["most_before"] - left) * more_left
                    r["after"] = (r["most_after"] - right) * more_right
                    r["more"] = more_left or more_right
                    out.append({name: r[name] for name in shape.names})
                yield pa.RecordBatch.from_pylist(out, schema=shape)

    shape = _RUN.append(pa.field("more", pa.bool_()))
    done = []
    for width in (around, _FREE):
        near = runs.withColumns(
            {f"most_{c}": F.col(c) for c in _PLACE[3:]} | {c: F.least(c, F.lit(width)) for c in _PLACE[3:]}
        )
        firsts = near.select(*[F.col(f"first_{c}").alias(c) for c in _PLACE[:3]], *_PLACE[3:])
        places = near.select(*_PLACE).unionByName(firsts).distinct()
        sides = stored(surroundings(places, _texts_of(places.select("key"), texts)), "surroundings")
        of_first = sides.select(
            *[F.col(c) if c in _PLACE[3:] else F.col(c).alias(f"first_{c}") for c in sides.columns]
        )
        both = near.join(sides, _PLACE).join(of_first, ["first_key", "first_begin", "first_end", *_PLACE[3:]])
        reached = stored(both.mapInArrow(compare, f"{_SEED}, more boolean"), "extended-seeds")
        done.append(reached.where("not more"))
        runs = reached.where("more").select(*_RUN.names)
        if runs.isEmpty():
            break
    return reduce(DataFrame.unionByName, done).select(
        "row", "begin", "end", "n", "first_id", "whole_left", "whole_right"
    )


def _runs(at: np.ndarray, held: np.ndarray, least: int) -> list[tuple[int, int]]:
    """First and last+1 place of the runs in ``at`` that cover enough words, or everything."""
    breaks = np.flatnonzero(np.diff(at) != 1) + 1
    out = []
    for run in np.split(at, breaks):
        first, last = int(run[0]), int(run[-1]) + 1
        if held[first:last].sum() >= least or last - first == len(held):
            out.append((first, last))
    return out


def substring_dedup(docs: DataFrame, run_words: int = RUN_WORDS) -> DataFrame:
    """``doc_id, n_chunks, n_repeated, removed_words, spans, first_ids, text`` of every document.

    Chunks whose digest stands earlier in the corpus are seeds. Each run of them
    is extended on both sides as far as the text agrees with the one where it
    stands first. Neighbouring whole words covered by this, at least
    ``run_words`` or all of the document, are removed from the text; shorter
    runs stay. ``spans`` are the removed code points (begin, end), ``first_ids``
    the documents in which the removed words stand first.

    Null and empty texts have no chunks and stay as they are. Null ids come last
    in the order. Of repeated rows the first written keeps its text. An empty
    table gives no rows. Only ``doc_id`` and ``text`` are read.
    """
    cut = stored(chunks(docs).withColumn("row", F.monotonically_increasing_id()), "chunks")
    texts = docs.select(row_key().alias("key"), "text")
    found = stored(seeds(repeated_chunks(cut)), "seeds")
    repeats = extended(found, texts).groupBy("row").agg(
        F.collect_list(F.struct("begin", "end", "n", "first_id", "whole_left", "whole_right")).alias("repeats")
    )
    # repeated rows share a key and a text, and are told apart by their place in it
    numbered = cut.select("row", "key", "doc_id", F.size("begins").alias("n_chunks")).join(repeats, "row", "left")
    numbered = numbered.groupBy("key", "doc_id").agg(
        F.collect_list(F.struct("row", "n_chunks", F.coalesce("repeats", F.array()).alias("repeats"))).alias("rows")
    )
    span = pa.struct([("begin", pa.int64()), ("end", pa.int64())])

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for record in part.to_pylist():
                    for row in record["rows"]:
                        rows.append((record["doc_id"], *_cleaned(record["text"], row, run_words)))
                kinds = [pa.int64()] * 4 + [pa.list_(span), pa.list_(pa.int64()), pa.string()]
                names = ["doc_id", "n_chunks", "n_repeated", "removed_words", "spans", "first_ids", "text"]
                columns = list(zip(*rows)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names
                )

    return numbered.join(texts.dropDuplicates(["key"]), "key").select("doc_id", "rows", "text").mapInArrow(
        clean,
        "doc_id long, n_chunks long, n_repeated long, removed_words long, "
        "spans array<struct<begin: long, end: long>>, first_ids array<long>, text string",
    )


def _cleaned(text: str | None, row: dict, run_words: int) -> tuple:
    """What one document's result row has after its id."""
    if not row["repeats"]:
        return row["n_chunks"], 0, 0, [], [], text
    repeats = sorted(row["repeats"], key=lambda r: (r["begin"], -r["end"]))
    n_repeated = sum(r["n"] for r in repeats)
    data = (text or "").encode()
    flags = np.frombuffer(data, np.uint8)
    starts, ends, _ = words(flags, np.array([0, len(data)]), NOT_SPACE)
    # what touches or overlaps is one; at its ends words count only if they end in the first text too
    joined = []
    for r in repeats:
        low, high = r["begin"] + (not r["whole_left"]), r["end"] - (not r["whole_right"])
        last = joined[-1] if joined else None
        if last and r["begin"] <= last["end"]:
            if r["begin"] == last["begin"]:
                last["low"] = min(last["low"], low)
            if r["end"] >= last["end"]:
                last["high"] = max(last["high"], high) if r["end"] == last["end"] else high
                last["end"] = r["end"]
        else:
            joined.append({"begin": r["begin"], "end": r["end"], "low": low, "high": high})
    covered = np.zeros(len(starts), bool)
    for j in joined:
        covered[np.searchsorted(starts, j["low"]) : np.searchsorted(ends, j["high"], "right")] = True
    runs = _runs(np.flatnonzero(covered), np.ones(len(starts), int), run_words) if covered.any() else []
    edges = [(int(starts[a]), int(ends[b - 1])) for a, b in runs]
    if covered.all() and (runs or (joined[0]["begin"], joined[0]["end"]) == (0, len(data))):
        edges = [(0, len(data))]
    kept, spans, ids, done, points = [], [], set(), 0, 0
    for a, b in edges:
        before = data[done:a].decode()
        gone = len(data[a:b].decode())
        kept.append(before)
        points += len(before)
        spans.append({"begin": points, "end": points + gone})
        points += gone
        done = b
        ids.update(r["first_id"] for r in repeats if r["begin"] < b and r["end"] > a and r["first_id"] is not None)
    kept.append(data[done:].decode())
    n_words = sum(b - a for a, b in runs)
    return row["n_chunks"], n_repeated, n_words, spans, sorted(ids), "".join(kept)
