"""MinHash near-duplicates by an inverted join of signature coordinates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ids import IdSet
from ..session import stored
from .arrays import LOWER, NOT_SPACE, flat, mix, row_key, shingles, slices, span_hashes, words
from .components import components

SHINGLE = 4

# Coordinates of a signature, and how many must agree before two sets are
# compared. Two sets at 80 % agree in 51 of 64 on average and in fewer than 36
# less than once in 300,000 pairs.
COORDINATES = 64
MATCHES = 36

# Lists of at most so many classes are compared pair by pair, longer ones in blocks.
SHORT_LIST = 32
BLOCK_CLASSES = 256
BLOCK_SHINGLES = 1 << 17

# Bits of the hash under which keys are held as a bitmap: 2 MB in all.
KEY_BITS = 24

# Text bytes that a task makes shingles of at once.
SLICE = 1 << 18


def _spot(key: str) -> Column:
    return F.shiftrightunsigned(F.xxhash64(key), 64 - KEY_BITS)


def _spots(keys: DataFrame) -> IdSet:
    """The hashes of ``keys(key)``: other keys may share one, so what meets them is looked at again."""
    return IdSet(keys.select(_spot("key").alias("__spot")), "__spot")


def _row_sets(column: pa.Array, size: int) -> list[np.ndarray]:
    """The distinct shingles of every text, sorted."""
    raw, row_bytes = flat(column)
    data = LOWER[raw]
    starts, ends, bounds = words(data, row_bytes, NOT_SPACE)
    found, cuts = shingles(span_hashes(data, starts, ends), bounds, size)
    out = []
    for a, b in zip(cuts[:-1], cuts[1:]):
        part = np.sort(found[a:b])
        out.append(part[np.append(True, part[1:] != part[:-1])] if len(part) else part)
    return out


def signatures(docs: DataFrame, size: int = SHINGLE, coordinates: int = COORDINATES) -> DataFrame:
    """``key, doc_id, n_shingles, set_a, set_b, signature`` of every document.

    ``set_a, set_b`` are 128 bits of the whole set, equal for equal sets.
    """
    factors = mix(np.arange(1, coordinates + 1, dtype=np.uint64)) | np.uint64(1)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                sets = _row_sets(part.column("text"), size)
                counts = np.array([len(s) for s in sets])
                filled = counts > 0
                every = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
                begins = (np.cumsum(counts) - counts)[filled]
                digest = np.zeros((2, len(sets)), np.uint64)
                marks = np.zeros((len(sets), coordinates), np.uint32)
                if len(begins):
                    for i, salt in enumerate((0x5851F42D4C957F2D, 0x14057B7EF767814F)):
                        digest[i, filled] = np.add.reduceat(mix(every ^ np.uint64(salt)), begins)
                    for i, factor in enumerate(factors):
                        low = np.minimum.reduceat(every * factor, begins)
                        marks[filled, i] = low >> np.uint64(32)
                ends = np.arange(0, marks.size + 1, coordinates, dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("key"),
                        part.column("doc_id"),
                        pa.array(counts.astype(np.int64)),
                        pa.array(digest[0].view(np.int64)),
                        pa.array(digest[1].view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(marks.reshape(-1).view(np.int32))),
                    ],
                    names=["key", "doc_id", "n_shingles", "set_a", "set_b", "signature"],
                )

    rows = docs.select(row_key().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(
        sign,
        "key binary, doc_id long, n_shingles long, set_a long, set_b long, signature array<int>",
    )


def shingle_sets(docs: DataFrame, wanted: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``class, shingles`` for ``wanted(key, class)``, from the whole texts.

    Texts that no class asks for are left out where they are read, so only
    those of classes that can agree with another are shuffled.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                sets = [s.view(np.int64) for s in _row_sets(part.column("text"), size)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("class"), pa.array(sets, pa.list_(pa.int64()))], names=["class", "shingles"]
                )

    texts = docs.select(row_key().alias("key"), "text").withColumn("__spot", _spot("key"))
    texts = _spots(wanted).present_in(texts).drop("__spot").join(wanted, "key").dropDuplicates(["class"])
    return texts.select("class", "text").mapInArrow(cut, "class long, shingles array<long>")


def live_postings(classes: DataFrame, matches: int = MATCHES) -> DataFrame:
    """``class, tokens, prefix`` of the classes that can agree with another.

    A token is a coordinate and its value. Tokens of one class only can match
    nothing; a class with fewer than ``matches`` others is left out. ``tokens``
    are ordered from rare to common. Two classes that share ``matches`` tokens
    share one among their first ``n - matches + 1``, the ``prefix``: the common
    tokens after it are skipped.
    """
    token = F.shiftleft(F.col("at").cast("long"), 32).bitwiseOR(
        F.col("value").cast("long").bitwiseAND(F.lit(0xFFFFFFFF))
    )
    posted = classes.select("class", F.posexplode("signature").alias("at", "value")).select(
        "class", token.alias("token")
    )
    lists = posted.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    live = posted.join(lists, "token").groupBy("class").agg(
        F.array_sort(F.collect_list(F.struct("n", "token"))).alias("tokens")
    )
    return live.where(F.size("tokens") >= matches).select(
        "class",
        F.col("tokens.token").alias("tokens"),
        F.slice("tokens.token", 1, F.size("tokens") - matches + 1).alias("prefix"),
    )


def _near(a: str, b: str, percent: int) -> Column:
    shared = F.size(F.array_intersect(a, b))
    return shared * 100 >= (F.size(a) + F.size(b) - shared) * percent


def _confirmed(pairs: DataFrame, tokens: DataFrame, sets: DataFrame, matches: int, percent: int) -> DataFrame:
    """The pairs ``a, b`` that agree in enough coordinates and whose full sets are near."""
    left, right = (tokens.select(F.col("class").alias(s), F.col("tokens").alias(f"tokens_{s}")) for s in "ab")
    agreed = (
        pairs.join(left, "a")
        .join(right, "b")
        .where(F.size(F.array_intersect("tokens_a", "tokens_b")) >= matches)
        .select("a", "b")
    )
    left, right = (sets.select(F.col("class").alias(s), F.col("shingles").alias(f"set_{s}")) for s in "ab")
    # few are left; written, so that their sets are fetched by a step of its own
    agreed = stored(agreed, "agreed-pairs")
    return agreed.join(left, "a").join(right, "b").where(_near("set_a", "set_b", percent)).select("a", "b")


def star_links(tokens: DataFrame, sets: DataFrame, matches: int, percent: int) -> DataFrame:
    """Links of classes to the first class of a token list they are in.

    Of the first classes of all its lists, a class is compared with the two that
    it collides with most.
    """
    postings = tokens.select("class", F.explode("prefix").alias("token"))
    firsts = postings.groupBy("token").agg(F.min("class").alias("first"), F.count(F.lit(1)).alias("n"))
    met = postings.join(firsts.where("n > 1"), "token").where(F.col("class") != F.col("first"))
    collisions = met.groupBy("class", "first").agg(F.count(F.lit(1)).alias("n"))
    best = Window.partitionBy("class").orderBy(F.desc("n"), "first")
    pairs = (
        collisions.withColumn("place", F.row_number().over(best))
        .where("place <= 2")
        .select(F.col("class").alias("a"), F.col("first").alias("b"))
    )
    return _confirmed(pairs, tokens, sets, matches, percent)


def _block_links(rows: pd.DataFrame, percent: int) -> list[tuple[int, int]]:
    """Links between the ``left`` and ``right`` classes of a block that join components."""
    rows = rows.drop_duplicates(["class", "side"])
    sides = [rows[rows["side"] == s].reset_index(drop=True) for s in (0, 1)]
    if not len(sides[0]) or not len(sides[1]):
        return []
    sizes = [side["shingles"].map(len).to_numpy() for side in sides]
    flat_sets = [np.concatenate(side["shingles"].to_list()) for side in sides]
    common = np.intersect1d(flat_sets[0], flat_sets[1])
    shared = np.zeros((len(sides[0]), len(sides[1])), np.float32)
    cells = []
    for values, size in zip(flat_sets, sizes):
        row = np.repeat(np.arange(len(size)), size)
        at = np.searchsorted(common, values)
        inside = at < len(common)
        inside[inside] = common[at[inside]] == values[inside]
        order = np.argsort(at[inside], kind="stable")
        cells.append((row[inside][order], at[inside][order]))
    step = 4096
    for begin in range(0, len(common), step):
        parts = []
        for (row, at), size in zip(cells, sizes):
            lo, hi = np.searchsorted(at, [begin, begin + step])
            held = np.zeros((len(size), step), np.float32)
            held[row[lo:hi], at[lo:hi] - begin] = 1
            parts.append(held)
        shared += parts[0] @ parts[1].T
    near = shared * 100 >= (sizes[0][:, None] + sizes[1][None, :] - shared) * percent
    left_comp, right_comp = (side["component"].to_numpy() for side in sides)
    near &= left_comp[:, None] != right_comp[None, :]
    links, parent = [], {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, j in zip(*np.nonzero(near)):
        a, b = root(left_comp[i]), root(right_comp[j])
        if a != b:
            parent[max(a, b)] = min(a, b)
            links.append((int(sides[0]["class"][i]), int(sides[1]["class"][j])))
    return links


def residual_links(
    tokens: DataFrame, sets: DataFrame, found: DataFrame, matches: int, percent: int
) -> DataFrame:
    """Links between classes of one token list that are not in one component yet.

    In every list the classes outside its largest component are compared with
    all classes of other components: pair by pair in short lists. In long lists
    the outsiders of all lists with the same largest component form one pool,
    which is compared block by block with that component and with itself. So no
    pair that shares a prefix token goes uncompared unless it is joined already.
    """
    postings = (
        tokens.select("class", F.explode("prefix").alias("token"))
        .join(found, "class", "left")
        .withColumn("component", F.coalesce("component", "class"))
    )
    shares = postings.groupBy("token", "component").agg(F.count(F.lit(1)).alias("n"))
    lists = (
        shares.groupBy("token")
        .agg(
            F.sum("n").alias("size"),
            F.count(F.lit(1)).alias("parts"),
            F.max(F.struct("n", "component"))["component"].alias("largest"),
        )
        .where("parts > 1")
        .drop("parts")
    )
    open_ = stored(postings.join(lists, "token"), "open-lists")
    outside = F.col("component") != F.col("largest")
    short = open_.where(F.col("size") <= SHORT_LIST)
    a = short.where(outside).select("token", F.col("class").alias("a"), F.col("component").alias("of_a"))
    b = short.select("token", F.col("class").alias("b"), F.col("component").alias("of_b"), (~outside).alias("in_b"))
    pairs = (
        a.join(b, "token")
        .where((F.col("of_a") != F.col("of_b")) & (F.col("in_b") | (F.col("a") < F.col("b"))))
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )
    by_pair = stored(_confirmed(pairs, tokens, sets, matches, percent), "pair-links")

    long = (
        open_.where(F.col("size") > SHORT_LIST)
        .select("largest", "class", "component", outside.alias("outside"))
        .distinct()
        .join(sets.select("class", F.size("shingles").alias("n")), "class")
    )
    room = lambda chosen: F.greatest(
        F.ceil(F.sum(chosen.cast("int")) / BLOCK_CLASSES),
        F.ceil(F.sum(F.when(chosen, F.col("n")).otherwise(0)) / BLOCK_SHINGLES),
        F.lit(1),
    ).cast("int")
    blocks = long.groupBy("largest").agg(
        room(F.col("outside")).alias("left_blocks"), room(F.lit(True)).alias("right_blocks")
    )
    placed = long.join(blocks, "largest")
    share = lambda of: F.pmod(F.xxhash64("class"), F.col(of)).cast("int")
    each = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    ids = ["largest", "class", "component"]
    left = placed.where("outside").select(
        *ids, F.lit(0).alias("side"), share("left_blocks").alias("left"), each("right_blocks").alias("right")
    )
    right = placed.select(
        *ids, F.lit(1).alias("side"), each("left_blocks").alias("left"), share("right_blocks").alias("right")
    )
    # dealt out without the sets first, which then meet only the rows that need them
    rows = stored(left.unionByName(right), "blocks").join(sets, "class")

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_block_links(part, percent), columns=["a", "b"], dtype="int64")

    by_block = rows.groupBy("largest", "left", "right").applyInPandas(compare, "a long, b long")
    return by_pair.unionByName(by_block)


def near_duplicates(
    docs: DataFrame,
    size: int = SHINGLE,
    percent: int = 80,
    coordinates: int = COORDINATES,
    matches: int = MATCHES,
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept, key, stays`` of every document.

    Documents with equal shingle sets are one class, so copies cost one row.
    Every class posts itself under the values of its signature's coordinates;
    see ``live_postings`` for what is posted and what is skipped. Classes that
    meet are linked when enough coordinates agree and their full sets, cut again
    from the whole texts, are near: first with the heads of their lists, then
    wherever a list still spans components. ``component_id`` is the smallest id
    reachable over links.

    Null or wordless texts have no shingles and are linked with nothing. A null
    id is never the smallest unless its component has no other. Repeated rows
    share a result; ``stays`` is true for one row key of each component and for
    every document without shingles. An empty table gives no rows. Only
    ``doc_id`` and ``text`` are read.
    """
    signed = stored(signatures(docs, size, coordinates), "signatures")
    worded = signed.where("n_shingles > 0")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")
    groups = worded.groupBy("set_a", "set_b").agg(F.min(order).alias("first"))
    # the class is named by one of its rows; row numbers are fixed once written
    groups = stored(
        groups.select("set_a", "set_b", "first.doc_id", "first.key").withColumn(
            "class", F.monotonically_increasing_id()
        ),
        "classes",
    )
    heads = groups.select("key", "class", "set_a", "set_b")
    classes = worded.select("key", "set_a", "set_b", "signature").join(heads, ["key", "set_a", "set_b"])
    tokens = stored(
        live_postings(classes.dropDuplicates(["class"]).select("class", "signature"), matches), "postings"
    )
    wanted = heads.join(tokens.select("class"), "class", "left_semi").select("key", "class")
    sets = stored(shingle_sets(docs, wanted, size), "shingle-sets")
    stars = stored(star_links(tokens, sets, matches, percent), "stars")
    found = stored(
        components(stars).select(F.col("node").alias("class"), "component"), "star-components"
    )
    rest = residual_links(tokens, sets, found, matches, percent)
    joined = components(stars.unionByName(stored(rest, "residual-links")))
    named = (
        groups.join(joined.select(F.col("node").alias("class"), "component"), "class", "left")
        .withColumn("component", F.coalesce("component", "class"))
    )
    named = stored(named, "named-classes")
    # written, so that both sides of the join are dealt out anew and Spark can split a large component
    smallest = stored(named.groupBy("component").agg(F.min(order).alias("first")), "component-heads")
    labels = named.join(smallest, "component").select(
        "set_a", "set_b", F.col("first.doc_id").alias("component_id"), F.col("first.key").alias("first_key")
    )
    empty = F.col("n_shingles") == 0
    same = signed.select("key", "doc_id", "n_shingles", "set_a", "set_b").where(~empty).join(labels, ["set_a", "set_b"])
    none = signed.where(empty).select(
        "key", "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.col("key").alias("first_key")
    )
    return same.drop("set_a", "set_b").unionByName(none).select(
        "doc_id",
        "n_shingles",
        "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
        "key",
        (F.col("key") == F.col("first_key")).alias("stays"),
    )


def without_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """One document of each component, and every document without words.

    Rows that stay and are not repeated stay where they are read; only the
    others are shuffled.
    """
    result = stored(near_duplicates(docs, **options).select("key", "stays"), "verdicts")
    alone = (F.count(F.lit(1)) == 1) & F.max("stays")
    doubtful = result.groupBy("key").agg(alone.alias("alone")).where(~F.col("alone"))
    spots = _spots(doubtful)
    names = docs.columns
    keyed = docs.withColumn("__key", row_key()).withColumn("__spot", _spot("__key"))
    stay = result.where("stays").select(F.col("key").alias("__key")).distinct()
    kept = spots.present_in(keyed).join(stay, "__key", "left_semi").dropDuplicates(["__key"])
    columns = [F.col(f"`{c}`") for c in names]
    return spots.absent_from(keyed).select(*columns).unionByName(kept.select(*columns))
