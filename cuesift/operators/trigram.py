"""The trigram index: which segments hold which three-character runs, and where.

Segments are dealt into blocks of some thousand. A row of the index is one gram
of one block: the block's segments that hold it, each with its positions. So a
common gram is spread over all blocks, and everything a phrase needs to be
found in a block comes together in a few rows. Stored rows lie in folders by
gram bucket, sorted by gram: a search reads the grams it asks for and nothing
else, and changes of the index keep that layout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.query import GRAM_LENGTH
from ..session import cut_lineage, fits_broadcast, salted_join, stored
from ..sources.changes import read_stamps
from .ids import BITMAPS
from .terms import Terms

BLOCKS = (
    "gram string, block int, "
    "entries array<struct<segment_id:bigint,asset_id:bigint,n_grams:int,positions:array<int>>>"
)
# Segments of a block; with segments of 2,000 characters some 8 million grams.
BLOCK_SEGMENTS = 4096
# Characters of the blocks that one task makes and sorts; each becomes some 70 bytes of rows in memory.
_TASK_CHARS = 1 << 22
# Grams pushed into the scan of a stored index as literals.
_PUSHED_GRAMS = 4096
# Where an index that is made on the way keeps the texts dealt to its blocks.
_DEALT = "_dealt_texts"
# Bits of a character, and of a position inside a segment.
_CHAR, _PLACE = 21, 32


def gram_count(text: Column) -> Column:
    """Length of a text in trigrams."""
    return F.greatest(F.length(text) - (GRAM_LENGTH - 1), F.lit(0))


def _block_grams(key: tuple, rows: pa.Table) -> pa.Table:
    """The grams of one block's ``segment_id, asset_id, n_grams, low``, in order.

    Three characters of 21 bits make a number; a stable sort of these numbers
    keeps segments and positions in order under each gram.
    """
    texts = rows.column("low").combine_chunks().fill_null("")
    sizes = pc.utf8_length(texts).to_numpy().astype(np.int64)
    chars = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), "<u4").astype(np.int64)
    segment = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(chars)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = np.flatnonzero(place <= sizes[segment] - GRAM_LENGTH)
    code = (chars[at] << 2 * _CHAR) | (chars[np.minimum(at + 1, len(chars) - 1)] << _CHAR)
    code |= chars[np.minimum(at + 2, len(chars) - 1)]
    order = np.argsort(code, kind="stable")
    code, segment, place = code[order], segment[at][order], place[at][order]
    new_gram = np.append(True, code[1:] != code[:-1])[: len(code)]
    new_entry = new_gram | np.append(True, segment[1:] != segment[:-1])[: len(code)]
    entry = np.flatnonzero(new_entry)
    gram = np.flatnonzero(new_gram)
    ends = lambda starts, n: pa.array(np.append(starts, n).astype(np.int32))
    positions = pa.ListArray.from_arrays(ends(entry, len(code)), pa.array(place.astype(np.int32)))
    held = rows.select(["segment_id", "asset_id", "n_grams"]).take(pa.array(segment[entry])).combine_chunks()
    fields = [held.column(c).combine_chunks() for c in held.column_names]
    entries = pa.StructArray.from_arrays([*fields, positions], [*held.column_names, "positions"])
    spelled = np.stack([code[gram] >> 2 * _CHAR, code[gram] >> _CHAR, code[gram]], axis=1) & ((1 << _CHAR) - 1)
    spelled = spelled.astype("<u4").tobytes().decode("utf-32-le")
    grams = [spelled[i : i + GRAM_LENGTH] for i in range(0, len(spelled), GRAM_LENGTH)]
    in_gram = ends(np.searchsorted(entry, gram), len(entry))
    columns = [pa.array(grams, pa.string()), pa.array(np.full(len(gram), key[0].as_py(), np.int32))]
    return pa.table([*columns, pa.ListArray.from_arrays(in_gram, entries)], ["gram", "block", "entries"])


def gram_blocks(segments: DataFrame, per_block: int = BLOCK_SEGMENTS) -> DataFrame:
    """The index of ``segments``: ``gram, block, entries``.

    Only the texts are shuffled, to their blocks, evenly by segment id. The tasks
    are as many as the characters ask for, so that each can sort what it makes.
    """
    size = segments.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars")).first()
    blocks = max(-(-size.n // per_block), 1)
    cores = segments.sparkSession.sparkContext.defaultParallelism
    tasks = max(min(blocks, cores), -(-(size.chars or 0) // _TASK_CHARS))
    rows = segments.select(
        F.pmod(F.xxhash64("segment_id"), F.lit(blocks)).cast("int").alias("block"),
        "segment_id",
        "asset_id",
        gram_count(F.col("text")).alias("n_grams"),
        F.lower("text").alias("low"),
    )
    dealt = rows.repartition(tasks, "block")
    blocks = dealt.groupBy("block").applyInArrow(_block_grams, BLOCKS)
    # a search of blocks that are not stored goes on in the tasks that make them; what is derived
    # from this table is a table without the mark
    vars(blocks)[_DEALT] = dealt
    return blocks


def trigram_postings(blocks: DataFrame) -> DataFrame:
    """One row per gram of a segment: ``gram, segment_id, asset_id, n_grams, positions``."""
    rest = [c for c in blocks.columns if c not in ("gram", "block", "entries")]
    return blocks.select(*rest, "gram", F.inline("entries"))


def gram_frequencies(postings: DataFrame) -> DataFrame:
    """``gram, segment_id, tf``: occurrences of each gram in each segment."""
    return postings.select("gram", "segment_id", F.size("positions").cast("long").alias("tf"))


def segment_stats(segments: DataFrame) -> DataFrame:
    """``segment_id, asset_id, n_grams`` of every segment, short ones included."""
    return segments.select("segment_id", "asset_id", gram_count(F.col("text")).alias("n_grams"))


def _gram_bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("gram"), F.lit(buckets)).cast("int")


def write_blocks(blocks: DataFrame, path: str, buckets: int = 64) -> None:
    """Store index rows by gram bucket, sorted by gram.

    A task writes the blocks it holds, so a very common gram lies in as many
    files as there are tasks, and no posting is shuffled.
    """
    (
        blocks.withColumn("gram_bucket", _gram_bucket(buckets))
        .sortWithinPartitions("gram_bucket", "gram")
        .write.mode("overwrite")
        .option("compression", "zstd")
        .partitionBy("gram_bucket")
        .parquet(path)
    )


def _holding(stored: DataFrame, terms: Terms | None, buckets: int) -> DataFrame:
    """The stored rows that ``terms`` need: their buckets as folders, their grams as literals."""
    if terms is not None and terms.few:
        wanted = sorted({gram for row in terms.rows for gram, _ in cover_of(row.folded)})
        if len(wanted) <= _PUSHED_GRAMS:
            named = stored.sparkSession.createDataFrame([(gram,) for gram in wanted], "gram string")
            named = named.select(_gram_bucket(buckets).alias("bucket")).distinct()
            held = sorted(row.bucket for row in named.collect())
            stored = stored.where(F.col("gram_bucket").isin(held) & F.col("gram").isin(wanted))
    return stored.drop("gram_bucket")


def _marked_bits(marks: DataFrame) -> DataFrame:
    """``stamp, range, bits``: the assets of ``marks(asset_id, stamp)`` as bitmaps of 32,768 ids."""
    spots = marks.select("stamp", F.shiftright("asset_id", 15).alias("range"), (F.col("asset_id").bitwiseAND(32767)).alias("spot"))
    return spots.groupBy("stamp", "range").agg(F.bitmap_construct_agg("spot").alias("bits"))


def _keep_live(marked: list[Row]):
    """A task's function that cuts index rows of all writes down to the entries that count.

    An entry counts in the write that marked its asset last, or in the build if
    none did.
    """
    found: dict[int | None, dict[int, np.ndarray]] = {None: {}}
    for row in marked:
        bits = np.frombuffer(row.bits, np.uint8)
        found.setdefault(row.stamp, {})[row.range] = bits
        found[None][row.range] = found[None].get(row.range, 0) | bits
    tables = {stamp: (np.array(sorted(of), np.int64), np.stack([of[r] for r in sorted(of)])) for stamp, of in found.items() if of}

    def held(stamp: int | None, assets: np.ndarray) -> np.ndarray:
        if stamp not in tables:
            return np.zeros(len(assets), bool)
        ranges, bits = tables[stamp]
        at = np.minimum(np.searchsorted(ranges, assets >> 15), len(ranges) - 1)
        spot = assets & 32767
        return (ranges[at] == assets >> 15) & ((bits[at, spot >> 3] >> (spot & 7)) & 1 == 1)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("entries")
            entries, sizes = lists.flatten(), pc.list_value_length(lists).to_numpy()
            ids = entries.field("asset_id")
            known, assets = ids.is_valid().to_numpy(False), ids.fill_null(0).to_numpy()
            of = np.repeat(batch.column("stamp").to_numpy(), sizes)
            live = np.zeros(len(of), bool)
            for stamp in np.unique(of):
                here = np.flatnonzero(of == stamp)
                one = held(int(stamp), assets[here]) & known[here]
                live[here] = one if stamp else ~(held(None, assets[here]) & known[here])
            ends = np.append(0, np.cumsum(live))[np.append(0, np.cumsum(sizes))]
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), entries.filter(pa.array(live)))
            rows = pa.RecordBatch.from_arrays([batch.column("gram"), batch.column("block"), lists, batch.column("stamp")], ["gram", "block", "entries", "stamp"])
            yield rows.filter(pa.array(np.diff(ends) > 0))

    return keep


class GramIndex:
    """A stored index that follows its segments, in one layout for every write.

    ``blocks/stamp=n/gram_bucket=b`` holds what write ``n`` brought, sorted by
    gram; ``marks/stamp=n`` names the assets that write replaced. Write 0 builds
    the index, later ones have larger stamps. A posting counts if its write is
    the last that marks its asset, or the build where none does. That is asked
    of the hits of a search, which are few, never of the postings: a search
    reads the grams it needs from every write and meets the marks afterwards.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, per_block: int = BLOCK_SEGMENTS):
        self.spark, self.path, self.buckets, self.per_block = spark, path.rstrip("/"), buckets, per_block

    def _write(self, blocks: DataFrame, stamp: int) -> None:
        write_blocks(blocks, f"{self.path}/blocks/stamp={stamp}", self.buckets)

    def build(self, segments: DataFrame) -> None:
        """Index all segments."""
        self._write(gram_blocks(segments, self.per_block), 0)

    def update(self, segments: DataFrame, touched: DataFrame, stamp: int) -> None:
        """Bring the assets in ``touched(asset_id)`` to ``segments``.

        ``segments`` holds all segments these assets have now; an asset without
        any leaves the index. Only the touched assets' postings are written, and
        they count from the moment the marks are there: a write that breaks off
        changes no search, and repeating it replaces what it left.
        """
        if stamp < 1:
            raise ValueError("stamp 0 is the build; updates begin at 1")
        self._write(gram_blocks(segments, self.per_block), stamp)
        touched.select("asset_id").distinct().write.mode("overwrite").parquet(f"{self.path}/marks/stamp={stamp}")

    def blocks(self, terms: Terms | None = None) -> DataFrame:
        """Rows of all writes with their ``stamp``, those of replaced assets too."""
        stored = read_stamps(self.spark, f"{self.path}/blocks", f"{BLOCKS}, gram_bucket int")
        return _holding(stored, terms, self.buckets)

    def current(self, rows: DataFrame) -> DataFrame:
        """Of rows with ``asset_id`` and ``stamp``, those that count now."""
        marks = read_stamps(self.spark, f"{self.path}/marks", "asset_id long")
        newest = marks.groupBy("asset_id").agg(F.max("stamp").alias("__newest"))
        met = rows.join(newest, "asset_id", "left")
        return met.where(F.col("stamp") == F.coalesce("__newest", F.lit(0))).drop("__newest")

    def hits(self, terms: Terms) -> DataFrame:
        """``phrase_hits`` of the current texts."""
        return self.current(phrase_hits(self.blocks(terms), terms, "stamp")).drop("stamp")

    def read(self) -> DataFrame:
        """All current postings, one row per gram of a segment."""
        return self.current(trigram_postings(self.blocks())).drop("stamp")

    def compacted(self, path: str) -> GramIndex:
        """The current postings as the build of a new index, in the same buckets.

        Rows keep the blocks they were written in, less the segments that were
        replaced; only blocks that became small are merged and shuffled.
        """
        out = GramIndex(self.spark, path, self.buckets, self.per_block)
        rows = self._live()
        held = rows.select("stamp", "block", F.explode("entries.segment_id").alias("segment_id"))
        sizes = held.groupBy("stamp", "block").agg(F.approx_count_distinct("segment_id").alias("n"))
        # one row per block: neighbours share a number while their segments fit one block
        order = Window.orderBy("stamp", "block")
        before = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1))
        small = F.col("n") <= self.per_block // 2
        sizes = stored(sizes, "block-sizes")
        packed = F.coalesce(F.floor(before / self.per_block), F.lit(0)).cast("int")
        merged = sizes.where(small).select("stamp", "block", packed.alias("to"))
        merged = merged.withColumn("alone", F.count(F.lit(1)).over(Window.partitionBy("to")) == 1)
        kept = sizes.where(~small).select("stamp", "block", F.row_number().over(order).alias("to"))
        # even numbers for merged blocks, odd ones for those that stay
        to = kept.select("stamp", "block", (F.col("to") * 2 + 1).cast("int").alias("to"), F.lit(True).alias("alone"))
        to = stored(to.unionByName(merged.withColumn("to", F.col("to") * 2)), "new-blocks")
        met = rows.join(F.broadcast(to), ["stamp", "block"])
        alone = met.where("alone").select("gram", F.col("to").alias("block"), "entries")
        several = met.where(~F.col("alone")).groupBy("gram", F.col("to").alias("block"))
        several = several.agg(F.flatten(F.collect_list("entries")).alias("entries"))
        out._write(alone.unionByName(several.select("gram", "block", "entries")), 0)
        return out

    def _live(self) -> DataFrame:
        """The index rows of all writes with those entries that count now; rows without any are left out.

        The marked assets are bits looked up where the rows are read. If their
        ranges are too many to be sent to every task, the postings are joined
        with the marks instead.
        """
        marks = read_stamps(self.spark, f"{self.path}/marks", "asset_id long")
        newest = marks.where("asset_id IS NOT NULL").groupBy("asset_id").agg(F.max("stamp").alias("stamp"))
        ranges = cut_lineage(_marked_bits(newest))
        if not fits_broadcast(ranges, BITMAPS):
            entry = F.struct("segment_id", "asset_id", "n_grams", "positions")
            grouped = self.current(trigram_postings(self.blocks(), "block")).groupBy("stamp", "block", "gram")
            return grouped.agg(F.collect_list(entry).alias("entries")).select("gram", "block", "entries", "stamp")
        return self.blocks().mapInArrow(_keep_live(ranges.collect()), f"{BLOCKS}, stamp long")


def cover_of(folded: str) -> list[tuple[str, int]]:
    """Grams that together spell a term, with their offsets; none for short terms."""
    last = len(folded) - GRAM_LENGTH
    offsets = sorted({*range(0, last + 1, GRAM_LENGTH), last}) if last >= 0 else []
    return [(folded[at : at + GRAM_LENGTH], at) for at in offsets]


def term_covers(terms: Terms) -> DataFrame:
    """``folded, n_cover, offset, gram``: the cover of each distinct term."""
    last = F.length("folded") - GRAM_LENGTH
    offsets = F.array_distinct(
        F.concat(F.sequence(F.lit(0), last, F.lit(GRAM_LENGTH)), F.array(last))
    )
    long_enough = terms.distinct().where(F.length("folded") >= GRAM_LENGTH)
    rows = long_enough.withColumn("__offsets", offsets)
    return rows.select(
        "folded", F.size("__offsets").alias("n_cover"), F.explode("__offsets").alias("offset")
    ).withColumn("gram", F.substring(F.col("folded"), F.col("offset") + 1, F.lit(GRAM_LENGTH)))


# What a search ships of the entries of a row, each as one flat array.
_SHIPPED = ["segment_id", "asset_id", "n_grams", "tf", "positions"]


def _shipped() -> list[Column]:
    places = F.col("entries.positions")
    flat = [F.col(f"entries.{name}").alias(name) for name in _SHIPPED[:3]]
    return [*flat, F.transform(places, F.size).alias("tf"), F.flatten(places).alias("positions")]


HITS = "folded string, segment_id long, asset_id long, n_grams int, tf long"


def _shipped_entries(rows: pa.Table) -> tuple[dict[str, pa.Array], np.ndarray]:
    """The entries of rows ``gram`` and ``_SHIPPED`` one after the other, and how many each row has."""
    held = {name: rows.column(name).combine_chunks().flatten() for name in _SHIPPED}
    return held, pc.list_value_length(rows.column("tf").combine_chunks()).to_numpy()


def _block_entries(rows: pa.Table) -> tuple[dict[str, pa.Array], np.ndarray]:
    """The same from rows of ``BLOCKS``."""
    lists = rows.column("entries").combine_chunks()
    entries = lists.flatten()
    held = {name: entries.field(name) for name in _SHIPPED if name != "tf"}
    held |= {"tf": pc.list_value_length(held["positions"]), "positions": held["positions"].flatten()}
    return held, pc.list_value_length(lists).to_numpy()


def _matches(
    grams: list[str], held: dict[str, pa.Array], in_gram: np.ndarray, covers: dict[str, list[tuple[str, int]]]
) -> pa.Table:
    """Every term's occurrences in one block, from the block's entries of the grams asked for.

    A place is a segment's number and a position in one integer. The rarest gram
    of a term proposes starts; each other gram keeps those it stands right after.
    """
    names, first, where = np.unique(
        held["segment_id"].to_numpy(False), return_index=True, return_inverse=True
    )
    sizes = held["tf"].to_numpy().astype(np.int64)
    places = (np.repeat(where, sizes) << _PLACE) | held["positions"].to_numpy().astype(np.int64)
    last = np.append(0, np.cumsum(sizes))[np.append(0, np.cumsum(in_gram))]
    lists = {gram: np.sort(places[a:b]) for gram, a, b in zip(grams, last[:-1], last[1:])}
    found = []
    for folded, cover in covers.items():
        asked = sorted(((lists.get(gram), offset) for gram, offset in cover), key=lambda c: -1 if c[0] is None else len(c[0]))
        if not asked or asked[0][0] is None:
            continue
        spots, offset = asked[0]
        starts = spots[(spots & ((1 << _PLACE) - 1)) >= offset] - offset
        for spots, offset in asked[1:]:
            near = np.searchsorted(spots, starts + offset)
            starts = starts[spots[np.minimum(near, len(spots) - 1)] == starts + offset]
        at, tf = np.unique(starts >> _PLACE, return_counts=True)
        if len(at):
            found.append((folded, at, tf))
    at = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.int64)
    tf = np.concatenate([f[2] for f in found]) if found else np.zeros(0, np.int64)
    term = np.repeat(np.arange(len(found)), np.array([len(f[1]) for f in found], np.int64))
    folded = pa.array([f[0] for f in found], pa.string()).take(pa.array(term))
    take = pa.array(first[at])
    columns = [held[c].take(take) for c in ("segment_id", "asset_id", "n_grams")]
    return pa.table([folded, *columns, pa.array(tf.astype(np.int64))], [c.split()[0] for c in HITS.split(", ")])


def phrase_hits(blocks: DataFrame, terms: Terms, *version: str) -> DataFrame:
    """``folded, segment_id, asset_id, n_grams, tf`` of every whole-term match.

    The index is read once, and the rows of a block meet in one task, which
    finds all terms in them. No text is read. Blocks that ``gram_blocks`` is only
    about to make are searched in the tasks that make them, so no posting leaves
    its task. Terms too many to be sent to the tasks meet the postings by joins
    instead. ``version`` names columns that tell rows of one block apart and are kept.
    """
    if not terms.few:
        return _joined_hits(trigram_postings(blocks), terms, *version)
    covers = {row.folded: cover_of(row.folded) for row in terms.rows}
    wanted = sorted({gram for cover in covers.values() for gram, _ in cover})
    dealt = vars(blocks).get(_DEALT)
    if dealt is not None:

        def make_and_match(key: tuple, rows: pa.Table) -> pa.Table:
            made = _block_grams(key, rows)
            made = made.filter(pc.is_in(made.column("gram"), value_set=pa.array(wanted, pa.string())))
            return _matches(made.column("gram").to_pylist(), *_block_entries(made), covers)

        return dealt.groupBy("block").applyInArrow(make_and_match, HITS)
    named = F.broadcast(blocks.sparkSession.createDataFrame([(g,) for g in wanted], "gram string"))
    types = {f.name: f.dataType.simpleString() for f in blocks.schema.fields}

    def match(key: tuple, rows: pa.Table) -> pa.Table:
        found = _matches(rows.column("gram").to_pylist(), *_shipped_entries(rows), covers)
        for name, value in zip(version, key[1:]):
            found = found.append_column(name, pa.array([value.as_py()] * len(found), value.type))
        return found

    schema = ", ".join([HITS, *(f"{v} {types[v]}" for v in version)])
    asked = blocks.select("block", *version, "gram", "entries").join(named, "gram", "left_semi")
    asked = asked.select("block", *version, "gram", *_shipped())
    return asked.groupBy("block", *version).applyInArrow(match, schema)


def _joined_hits(postings: DataFrame, terms: Terms, *version: str) -> DataFrame:
    """The same rows by joins: the places that all grams of a term agree on."""
    met = salted_join(postings, term_covers(terms), ["gram"], "inner", F.col("segment_id"))
    starts = F.transform("positions", lambda at: at - F.col("offset"))
    met = met.select(*version, "folded", "segment_id", "asset_id", "n_grams", "n_cover", starts.alias("starts"))
    grouped = (
        met.groupBy("folded", "segment_id", *version)
        .agg(
            F.first("asset_id").alias("asset_id"),
            F.first("n_grams").alias("n_grams"),
            F.first("n_cover").alias("n_cover"),
            F.collect_list("starts").alias("starts"),
        )
        .where(F.size("starts") == F.col("n_cover"))
    )
    # the places all grams agree on, at most as many as the shortest list has
    agreed = F.aggregate(F.slice("starts", 2, F.size("starts")), F.get("starts", F.lit(0)), F.array_intersect)
    hit = ["folded", "segment_id", "asset_id", "n_grams", *version]
    return grouped.select(*hit, F.size(agreed).cast("long").alias("tf")).where("tf > 0")


def scan_hits(matched: DataFrame) -> DataFrame:
    """The same rows as ``phrase_hits`` from texts already paired with terms."""
    quoted = F.concat(
        F.lit(r"(?=\Q"), F.replace(F.col("folded"), F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E)")
    )
    return matched.select(
        "folded",
        "segment_id",
        "asset_id",
        gram_count(F.col("text")).alias("n_grams"),
        F.regexp_count(F.lower(F.col("text")), quoted).alias("tf"),
    )
