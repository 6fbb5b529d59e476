"""Token ids of documents, written as packed files and read back."""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_folder
from .arrays import flat, kept_by_worker, slices, span_hashes
from .packing import pack, unpack

END_ID = 0

# Ids packed into one piece; a document is never split over two.
PIECE_IDS = 1 << 20

PIECES = "shard int, piece int, doc_ids array<long>, n_tokens array<int>, n_ids long, ids binary"

# Distinct parts of text whose ids a worker remembers.
_REMEMBERED = 1 << 21

# White space beyond ASCII's; texts with it are given to the tokenizer whole.
_OTHER_SPACE = "[\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"

# Kinds of bytes: white space, ASCII letter, digit, apostrophe, other ASCII, not ASCII.
_SPACE, _LETTER, _DIGIT, _QUOTE, _SIGN, _HIGH = range(6)
_KIND = np.full(256, _SIGN, np.uint8)
_KIND[0x80:] = _HIGH
_KIND[[0x20, 9, 10, 11, 12, 13]] = _SPACE
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = _LETTER
_KIND[0x30:0x3A] = _DIGIT
_KIND[0x27] = _QUOTE

# Neighbouring kinds between which a byte-level vocabulary never merges.
_CUT = np.zeros((6, 6), bool)
_CUT[_LETTER, [_DIGIT, _QUOTE, _SIGN]] = True
_CUT[_DIGIT, [_LETTER, _QUOTE, _SIGN]] = True
_CUT[_SIGN, [_LETTER, _DIGIT]] = True


def part_starts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where the parts of each row begin; the ids of a row are those of its parts.

    A run of white space less its last character is a part, unless it ends the
    row; a last space belongs to the word after it, another character of white
    space is by itself. Inside a word, letters, digits and signs are parted.
    """
    kind = _KIND[data]
    start = np.zeros(len(data) + 1, bool)
    start[1:-1] = _CUT[kind[:-1], kind[1:]]
    space = kind == _SPACE
    start[1:-1] |= space[1:] & ~space[:-1]
    after_space = space[:-1] & ~space[1:]
    start[1:-1] |= after_space & (data[:-1] != 0x20)
    start[:-2] |= after_space
    # across two rows nothing belongs together
    ends = bounds[1:-1][(bounds[1:-1] > 0) & (bounds[1:-1] < len(data))]
    inner = np.unique(ends)
    run = inner - 1
    tail = inner[space[run] & ~space[inner]] - 1
    # a space that ends a row is part of the run before it
    lone = (tail == 0) | ~space[tail - 1] | np.isin(tail, bounds)
    start[tail[~lone]] = False
    start[inner] = True
    start[0] = True
    return np.flatnonzero(start[:-1])


class Encoder:
    """Ids of whole texts by a byte-level vocabulary file.

    Words recur, so each distinct part is given to the tokenizer once and its
    ids are looked up by its hash after that; the memory is emptied when full.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        kind = json.loads(self.model.to_str())["pre_tokenizer"] or {}
        self.parted = kind.get("type") == "ByteLevel" and kind.get("use_regex") and not kind["add_prefix_space"]
        self._forget()

    def _forget(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.starts = np.zeros(0, np.int64)
        self.sizes = np.zeros(0, np.int64)
        self.ids = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, hashes: np.ndarray, parts: list[str]) -> None:
        found = self._encode(parts)
        sizes = np.array([len(x) for x in found])
        total = int(sizes.sum())
        while self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + total] = [x for ids in found for x in ids]
        at = np.searchsorted(self.hashes, hashes)
        self.hashes = np.insert(self.hashes, at, hashes)
        self.starts = np.insert(self.starts, at, self.used + np.cumsum(sizes) - sizes)
        self.sizes = np.insert(self.sizes, at, sizes)
        self.used += total

    def rows(self, column: pa.Array) -> list[np.ndarray]:
        """The ids of every text of a column of about a megabyte."""
        if not self.parted:
            return [np.array(x, np.uint32) for x in self._encode([text or "" for text in column.to_pylist()])]
        whole = pc.fill_null(pc.match_substring_regex(column, _OTHER_SPACE), False)
        odd = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
        data, bounds = flat(column)
        if not len(data):
            return [np.zeros(0, np.uint32)] * len(column)
        begins = part_starts(data, bounds)
        ends = np.append(begins[1:], len(data))
        hashes, first, which = np.unique(
            span_hashes(data, begins, ends), return_index=True, return_inverse=True
        )
        for _ in range(2):
            at = np.searchsorted(self.hashes, hashes)
            known = at < len(self.hashes)
            known[known] = self.hashes[at[known]] == hashes[known]
            if known.all():
                break
            if len(self.hashes) + len(hashes) > _REMEMBERED:
                self._forget()
                known[:] = False
            text = data.tobytes()
            new = [text[begins[i] : ends[i]].decode() for i in first[~known]]
            self._learn(hashes[~known], new)
        sizes = self.sizes[at][which]
        upto = np.cumsum(sizes)
        ids = self.ids[np.repeat(self.starts[at][which] - upto + sizes, sizes) + np.arange(upto[-1])]
        cuts = np.append(0, upto)[np.searchsorted(begins, bounds)]
        out = [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
        for row in odd:
            out[row] = np.array(self._encode([column[int(row)].as_py()])[0], np.uint32)
        return out


def write_tokens(
    docs: DataFrame,
    folder: str,
    tokenizer: str,
    end_id: int = END_ID,
    piece_ids: int = PIECE_IDS,
) -> None:
    """Tokenize ``doc_id, text`` and write the ids below ``folder`` in ascending id order.

    Documents are range-partitioned by id; shard k holds the ids before those of
    shard k+1 and is written by one task, piece after piece. A file row is one
    piece: the documents in it, how many ids each has (its end id included), and
    the packed ids. The files go through Spark's writer, so they can lie in any
    store, and a task that is run again replaces its own output.

    ``tokenizer`` is the path of a vocabulary file that every executor can read.
    Null text is empty and has just the end id. Strings of special tokens inside
    a text are ordinary text. A null id sorts first; documents that share an id
    follow each other, ordered by a hash of their text. An empty table writes a
    folder without rows.
    """
    if not os.path.isabs(tokenizer):
        raise ValueError("name the vocabulary file by its whole path")
    tie = F.xxhash64(F.coalesce("text", F.lit("")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", tie.alias("__tie"))
    ordered = (
        rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), "__tie")
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "__tie")
        .select("doc_id", "text")
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept_by_worker(f"encoder {tokenizer}", lambda: Encoder(tokenizer))
        shard, piece = TaskContext.get().partitionId(), 0
        ids, parts = [], []

        def flush() -> pa.RecordBatch:
            nonlocal piece
            sizes = [len(p) for p in parts]
            columns = [
                pa.array([shard], pa.int32()),
                pa.array([piece], pa.int32()),
                pa.array([list(ids)], pa.list_(pa.int64())),
                pa.array([sizes], pa.list_(pa.int32())),
                pa.array([sum(sizes)], pa.int64()),
                pa.array([pack(np.concatenate(parts))], pa.binary()),
            ]
            piece += 1
            ids.clear()
            parts.clear()
            return pa.RecordBatch.from_arrays(
                columns, names=["shard", "piece", "doc_ids", "n_tokens", "n_ids", "ids"]
            )

        held = 0
        for batch in batches:
            for part in slices(batch, "text"):
                doc_ids = part.column("doc_id").to_pylist()
                for doc_id, tokens in zip(doc_ids, encoder.rows(part.column("text"))):
                    if held and held + len(tokens) + 1 > piece_ids:
                        yield flush()
                        held = 0
                    ids.append(doc_id)
                    parts.append(np.append(tokens, np.uint32(end_id)))
                    held += len(parts[-1])
        if parts:
            yield flush()

    ordered.mapInArrow(encode, PIECES).write.option("compression", "none").parquet(folder)


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document in the files: ``doc_id, start, n_tokens, ids_crc32, ids``.

    ``start`` counts the ids of all documents before it: shards begin where the
    earlier shards end (one row per shard), pieces follow each other within
    their shard, documents within their piece.
    """
    pieces = spark.read.schema(PIECES).parquet(folder)
    sizes = pieces.select("shard", "piece", "n_ids")
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("__ids"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shard_starts = shards.select("shard", F.coalesce(F.sum("__ids").over(earlier), F.lit(0)).alias("__base"))
    within = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.join(shard_starts, "shard").select(
        "shard",
        "piece",
        (F.col("__base") + F.coalesce(F.sum("n_ids").over(within), F.lit(0))).alias("__start"),
    )

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                n_tokens = np.array(batch.column("n_tokens")[row].values, np.int64)
                ends = np.cumsum(n_tokens)
                ids = unpack(batch.column("ids")[row].as_py()).astype("<u4")
                parts = np.split(ids, ends[:-1])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([batch.column("shard")[row].as_py()] * len(parts), pa.int32()),
                        pa.array([batch.column("piece")[row].as_py()] * len(parts), pa.int32()),
                        batch.column("doc_ids")[row].values,
                        pa.array(ends - n_tokens, pa.int64()),
                        pa.array(n_tokens, pa.int64()),
                        pa.array([zlib.crc32(part.tobytes()) for part in parts], pa.int64()),
                        pa.ListArray.from_arrays(
                            pa.array(np.append(0, ends), pa.int32()), pa.array(ids.astype(np.int32))
                        ),
                    ],
                    names=["shard", "piece", "doc_id", "before", "n_tokens", "ids_crc32", "ids"],
                )

    documents = pieces.select("shard", "piece", "doc_ids", "n_tokens", "ids").mapInArrow(
        decode,
        "shard int, piece int, doc_id long, before long, n_tokens long, ids_crc32 long, ids array<int>",
    )
    return documents.join(starts, ["shard", "piece"]).select(
        "doc_id", (F.col("__start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", "ids"
    )


def token_files(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write the token files of ``docs`` and return what reading them gives."""
    spark = docs.sparkSession
    folder = folder or scratch_folder(spark, "tokens")
    write_tokens(docs, folder, tokenizer, end_id)
    return read_tokens(spark, folder)
