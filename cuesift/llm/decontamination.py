"""Benchmark decontamination by a prefix-filtered set join over word shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .arrays import ALNUM, LOWER, flat, joined_hashes, row_key, slices, span_hashes, words

# Words in a window of an item, and in a shingle of a window.
WINDOW = 10
SHINGLE = 5

# Bits of the filter that is sent to every task: 2 MB, however large the benchmark.
FILTER_BITS = 24

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def item_windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """``item_id string, window string, length int``: every run of ``size`` item words.

    An item of fewer words, but not none, is one window.
    """
    text = F.translate(F.coalesce("text", F.lit("")), _UPPER, _LOWER)
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"),
        F.regexp_extract_all(text, F.lit(WORD), 0).alias("words"),
    ).where(F.size("words") > 0)
    places = F.sequence(F.lit(1), F.greatest(F.size("words") - size + 1, F.lit(1)))
    rows = items.select("item_id", "words", F.explode(places).alias("at"))
    return rows.select(
        "item_id",
        F.array_join(F.slice("words", F.col("at"), size), " ").alias("window"),
        F.least(F.size("words"), F.lit(size)).alias("length"),
    ).distinct()


def window_shingles(windows: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``window, length, shingle, place, width``: the shingles of every distinct window."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, length in zip(batch.column("window").to_pylist(), batch.column("length").to_pylist()):
                data, bounds = flat(pa.array([text]))
                starts, ends, _ = words(data, bounds, ALNUM)
                width = min(size, length)
                found = joined_hashes(span_hashes(data, starts, ends), width)
                for place, value in enumerate(found.view(np.int64).tolist()):
                    out.append((text, length, value, place, width))
            names = ["window", "length", "shingle", "place", "width"]
            kinds = [pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int32()]
            columns = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    distinct = windows.select("window", "length").distinct()
    return distinct.mapInArrow(cut, "window string, length int, shingle long, place int, width int")


def shingle_filter(shingles: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A bit for each hash range that holds a value of ``shingle``: 2^bits bits in all."""
    low = 15

    def fill(part: pd.DataFrame) -> pd.DataFrame:
        held = np.zeros(1 << low, np.uint8)
        held[part["bit"].to_numpy() & ((1 << low) - 1)] = 1
        return pd.DataFrame({"part": [int(part["part"].iloc[0])], "held": [np.packbits(held).tobytes()]})

    bit = F.shiftrightunsigned("shingle", 64 - bits)
    placed = shingles.select(bit.alias("bit")).distinct().withColumn("part", F.shiftright("bit", low))
    rows = placed.groupBy("part").applyInPandas(fill, "part long, held binary").collect()
    out = np.zeros((1 << (bits - low), 1 << (low - 3)), np.uint8)
    for row in rows:
        out[row.part] = np.frombuffer(row.held, np.uint8)
    return out.reshape(-1)


class _Finder:
    """Shingles of a slice of documents that pass the filter."""

    def __init__(self, column: pa.Array, held: np.ndarray, widths: list[int]) -> None:
        raw, self.row_bytes = flat(column)
        self.data = LOWER[raw]
        self.starts, self.ends, self.bounds = words(self.data, self.row_bytes, ALNUM)
        hashes = span_hashes(self.data, self.starts, self.ends)
        shift = np.uint64(64 - (len(held) * 8).bit_length() + 1)
        found = []
        for width in widths:
            every = joined_hashes(hashes, width)
            bit = (every >> shift).astype(np.int64)
            passed = np.flatnonzero(held[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8) & 1)
            row = np.searchsorted(self.bounds, passed, "right") - 1
            inside = passed + width <= self.bounds[row + 1]
            found.append((every[passed[inside]], passed[inside], row[inside]))
        self.shingle, self.place, self.row = (
            np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(3)
        )

    def context(self, place: int, row: int, reach: int) -> tuple[int, str]:
        """Words around ``place``, and how many of them stand before it."""
        first = max(int(self.bounds[row]), place - reach)
        last = min(int(self.bounds[row + 1]), place + reach)
        data = self.data
        parts = [data[a:b].tobytes() for a, b in zip(self.starts[first:last], self.ends[first:last])]
        return place - first, b" ".join(parts).decode()


def shingle_counts(docs: DataFrame, held: np.ndarray, widths: list[int]) -> DataFrame:
    """``shingle, n``: how often shingles that pass the filter occur in all documents."""
    sent = docs.sparkSession.sparkContext.broadcast(held)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                values, n = np.unique(
                    _Finder(part.column("text"), sent.value, widths).shingle.astype(np.uint64),
                    return_counts=True,
                )
                yield pa.RecordBatch.from_arrays(
                    [pa.array(values.view(np.int64)), pa.array(n.astype(np.int64))], names=["shingle", "n"]
                )

    found = docs.select("text").mapInArrow(count, "shingle long, n long")
    return found.groupBy("shingle").agg(F.sum("n").alias("n"))


def document_postings(docs: DataFrame, held: np.ndarray, widths: list[int], reach: int) -> DataFrame:
    """``key, doc_id, n_words, postings``: every document and its shingles that pass the filter."""
    sent = docs.sparkSession.sparkContext.broadcast(held)
    posting = pa.struct(
        [("shingle", pa.int64()), ("at", pa.int64()), ("before", pa.int32()), ("context", pa.string())]
    )

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = _Finder(part.column("text"), sent.value, widths)
                postings = [[] for _ in range(part.num_rows)]
                shingles = found.shingle.astype(np.uint64).view(np.int64).tolist()
                for value, place, row in zip(shingles, found.place.tolist(), found.row.tolist()):
                    before, context = found.context(place, row, reach)
                    at = place - int(found.bounds[row])
                    postings[row].append({"shingle": value, "at": at, "before": before, "context": context})
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("key"),
                        part.column("doc_id"),
                        pa.array(np.diff(found.bounds).astype(np.int64)),
                        pa.array(postings, pa.list_(posting)),
                    ],
                    names=["key", "doc_id", "n_words", "postings"],
                )

    schema = (
        "key binary, doc_id long, n_words long, "
        "postings array<struct<shingle: long, at: long, before: int, context: string>>"
    )
    rows = docs.select(row_key().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(post, schema)


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE
) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items, key`` of every document.

    A window of ten item words occurs in a document exactly when all its
    five-word shingles stand there in their places. Shingles of windows are
    ordered by how rare they are in all documents; the rarest one of a window is
    the only one that must be found first (a contained set needs a prefix of
    one), and windows whose rarest shingle occurs nowhere are done. Tasks keep
    the document shingles that pass a filter of fixed size, with the words
    around them. Those rows meet the windows by shingle; places that would begin
    before the document or end after it are left out, and the words themselves
    are compared. Nothing but the filter is sent around, so the benchmark may
    be of any size.

    Null or wordless texts have no words and no hits. Null item ids count as the
    id "". Items that share an id are one item; repeated document rows each get
    their result. An empty benchmark hits nothing; empty documents give no rows.
    Only ``doc_id, text`` and ``item_id, text`` are read.
    """
    windows = stored(item_windows(benchmark, window), "windows")
    pieces = stored(window_shingles(windows, shingle), "window-shingles")
    # at most `shingle` different widths
    widths = sorted(row.width for row in pieces.select("width").distinct().collect())
    counts = shingle_counts(docs, shingle_filter(pieces.select("shingle")), widths)
    prefixes = stored(
        pieces.join(counts, "shingle")
        .groupBy("window", "length")
        .agg(F.min(F.struct("n", "shingle", "place")).alias("rarest"), F.count(F.lit(1)).alias("found"))
        # a window that occurs has all its shingles in the documents
        .where(F.col("found") == F.col("length") - F.least(F.lit(shingle), "length") + 1)
        .select("window", "length", "rarest.shingle", "rarest.place"),
        "prefixes",
    )
    wanted = shingle_filter(prefixes.select("shingle"))
    posted = stored(
        document_postings(docs, wanted, widths, window).withColumn("row", F.monotonically_increasing_id()),
        "postings",
    )
    places = posted.where(F.size("postings") > 0).select("row", "n_words", F.inline("postings"))
    first = F.col("before") - F.col("place")
    begin = F.col("at") - F.col("place")
    hits = (
        places.join(prefixes, "shingle")
        .where((begin >= 0) & (begin + F.col("length") <= F.col("n_words")))
        .where(F.array_join(F.slice(F.split("context", " "), first + 1, F.col("length")), " ") == F.col("window"))
        .select("row", "window", begin.alias("begin"), (begin + F.col("length")).alias("end"))
    )
    hits = stored(hits, "hits")
    # words covered by any of the windows, met in order of their begin
    spans = F.array_sort(F.collect_set(F.struct("begin", "end")))
    covered = F.aggregate(
        spans,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto")),
        lambda done, span: F.struct(
            (done.n + F.greatest(span.end - F.greatest(span.begin, done.upto), F.lit(0))).alias("n"),
            F.greatest(done.upto, span.end).alias("upto"),
        ),
        lambda done: done.n,
    )
    hit_words = hits.groupBy("row").agg(covered.alias("n_hit"))
    items = (
        hits.select("row", "window")
        .distinct()
        .join(windows.select("window", "item_id"), "window")
        .groupBy("row")
        .agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    )
    none = F.array().cast("array<string>")
    return (
        posted.select("row", "key", "doc_id", "n_words")
        .join(hit_words, "row", "left")
        .join(items, "row", "left")
        .select(
            "doc_id",
            "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.size(F.coalesce("items", none)).cast("long").alias("n_items"),
            F.sha2(F.array_join(F.coalesce("items", none), ","), 256).alias("items_sha256"),
            (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
            F.coalesce("items", none).alias("items"),
            "key",
        )
    )


def uncontaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` in which no window of an item occurs, as they are."""
    bad = contamination(docs, benchmark, **options).where("contaminated")
    keyed = docs.withColumn("__key", row_key())
    # written, so that Spark knows how few they are when it plans the join
    bad = stored(bad.select(F.col("key").alias("__key")).distinct(), "contaminated")
    return keyed.join(bad, "__key", "left_anti").drop("__key")
