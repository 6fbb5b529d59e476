"""Tag candidates from corpus statistics, without a dictionary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bind import bind
from ..session import cut_lineage, salted_join

# Thresholds of the statistics.
MIN_FREQUENCY = 3
MIN_LENGTH, MAX_LENGTH = 2, 4
FRAGMENT_TOLERANCE = 0.8
DEFAULT_CANDIDATES = 12

# Characters a word may consist of.
HAN = r"\u4e00-\u9fff\u3400-\u4dbf"
LETTERS = r"\p{L}"

# Frequent function words that make useless tags.
STOPWORDS = [
    "我们", "你们", "他们", "她们", "它们", "这个", "那个", "这里", "那里", "这样",
    "那样", "什么", "怎么", "为什么", "因为", "所以", "但是", "可是", "如果", "就是",
    "还是", "或者", "已经", "可以", "应该", "可能", "没有", "不是", "不能", "不会",
    "一个", "一种", "一些", "这些", "那些", "自己", "大家", "现在", "时候", "地方",
    "东西", "事情", "问题", "感觉", "知道", "觉得", "看到", "听到", "出来", "起来",
    "过去", "过来", "下来", "一下", "一直", "而且", "然后", "于是", "虽然", "不过",
    "其实", "真的", "好像", "一定", "非常", "特别", "有点", "一点", "很多", "多少",
    "这么", "那么", "怎样", "如何", "以及", "还有", "的话", "的人", "的事", "的时候",
    "那种", "这种", "只是", "就是", "而是", "不能",
]

# Code point of the line feed that stands for any character outside a word.
_OUTSIDE = 10

# Bits that stand for the words of an asset; a fuller set lets more through.
MARKS = 4096

# Characters whose words one task counts; each gives up to three rows of some 100 bytes.
_TASK_CHARS = 1 << 20

# Candidates per asset examined in one round of the greedy choice.
_ROUND = 256


def _windows(framed: Column, size: int) -> Column:
    """Every word of ``size`` characters with the character on either side.

    In ``framed`` every character outside the class is a line feed, and so are
    both ends.
    """
    found = F.regexp_extract_all(
        framed, F.lit(rf"(?s)(?=(.[^\n]{{{size}}}.))."), F.lit(1)
    )
    return F.transform(
        found,
        lambda w, i: F.struct(w.alias("w"), i.alias("at"), F.lit(size).alias("size")),
    )


def _framed(segments: DataFrame, chars: str) -> DataFrame:
    plain = F.regexp_replace("text", rf"[^{chars}]", "\n")
    return segments.select("asset_id", "ordinal", F.concat(F.lit("\n"), plain, F.lit("\n")).alias("framed"))


def _by_asset(framed: DataFrame, chars: int) -> DataFrame:
    """The texts of an asset in one task: its words are counted there and never shuffled."""
    cores = framed.sparkSession.sparkContext.defaultParallelism
    return framed.repartition(max(cores, -(-chars // _TASK_CHARS)), "asset_id")


def _characters(segments: DataFrame) -> int:
    return segments.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]


def _counted(framed: DataFrame, found: Column) -> DataFrame:
    """The statistics of the words at the places ``found``."""
    rows = framed.select("asset_id", "ordinal", F.inline(found))

    def neighbour(char: Column) -> Column:
        return F.nullif(F.ascii(char), F.lit(_OUTSIDE))

    words = rows.select(
        "asset_id",
        F.substring(F.col("w"), F.lit(2), F.col("size")).alias("word"),
        neighbour(F.col("w")).alias("before"),
        neighbour(F.substring("w", -1, 1)).alias("after"),
        # ordinal and match number in one sortable number
        (F.shiftleft(F.col("ordinal").cast("long"), 24) + F.col("at")).alias("seen"),
    )
    return words.groupBy("asset_id", "word").agg(
        F.count(F.lit(1)).alias("frequency"),
        F.coalesce(F.min("before") != F.max("before"), F.lit(False)).alias("left_varied"),
        F.coalesce(F.min("after") != F.max("after"), F.lit(False)).alias("right_varied"),
        F.min("seen").alias("first_seen"),
    )


def ngram_stats(segments: DataFrame, chars: str = HAN) -> DataFrame:
    """``asset_id, word, frequency, left_varied, right_varied, first_seen`` of every word.

    A side is varied when it shows two different characters, that is when the
    smallest and the largest differ: plain minimum and maximum. Only the texts
    are shuffled, to the task of their asset. Neighbours are kept as code points, which hash aggregation can
    update in place. ``first_seen`` orders words of one length by appearance.
    """
    framed = _by_asset(_framed(segments, chars), _characters(segments))
    sizes = range(MIN_LENGTH, MAX_LENGTH + 1)
    return _counted(framed, F.concat(*[_windows(F.col("framed"), size) for size in sizes]))


def _mark(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(MARKS)).cast("int")


def _marks(words: DataFrame) -> DataFrame:
    """``asset_id, marks``: one bit for each word of an asset, in an array of 64-bit numbers."""
    rows = words.select("asset_id", _mark(F.col("word")).alias("h"))
    slots = rows.groupBy("asset_id", F.expr("h div 64").alias("slot")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(h % 64 AS int))")).alias("bits")
    )
    found = slots.groupBy("asset_id").agg(F.map_from_entries(F.collect_list(F.struct("slot", "bits"))).alias("m"))
    places = F.sequence(F.lit(0).cast("long"), F.lit(MARKS // 64 - 1).cast("long"))
    return found.select(
        "asset_id", F.transform(places, lambda i: F.coalesce(F.element_at("m", i), F.lit(0).cast("long"))).alias("marks")
    )


def longer_words(framed: DataFrame, shorter: DataFrame, size: int) -> tuple[DataFrame, Column]:
    """Texts, and in them the places of words of ``size`` whose two shorter parts are both in ``shorter``.

    A word is never more frequent in its asset than its parts, so all others need
    no counting. The parts are looked up in bits that travel with the asset; a bit
    that two words share only lets more through.
    """
    rows = framed.join(cut_lineage(_marks(shorter)), "asset_id")

    def held(word: Column) -> Column:
        mark = _mark(word)
        return F.getbit(F.get("marks", F.shiftright(mark, 6)), mark.bitwiseAND(F.lit(63))) == 1

    part = lambda w, at: F.substring(w["w"], at, size - 1)
    return rows, F.filter(_windows(F.col("framed"), size), lambda w: held(part(w, 2)) & held(part(w, 3)))


def frequent_words(segments: DataFrame, chars: str = HAN, minimum: int = MIN_FREQUENCY) -> DataFrame:
    """The rows of ``ngram_stats`` with at least ``minimum`` occurrences; the others stay in their tasks."""
    return cut_lineage(ngram_stats(segments, chars).where(F.col("frequency") >= minimum))


def eligible_words(stats: DataFrame) -> DataFrame:
    """Words frequent and varied enough that are no stopword and no repetition.

    The tests of the word itself stay behind the counts: on their own they
    would be moved below the grouping and run on every occurrence.
    """
    counted = (F.col("frequency") >= MIN_FREQUENCY) & F.col("left_varied") & F.col("right_varied")
    useful = ~F.col("word").isin(STOPWORDS) & ~F.col("word").rlike(r"(?s)\A(.)\1+\z")
    return stats.where(F.when(counted, useful).otherwise(F.lit(False))).select(
        "asset_id", "word", "frequency", "first_seen"
    )


def drop_fragments(words: DataFrame) -> DataFrame:
    """Remove words whose frequency a longer word around them explains.

    Each longer word lists its few shorter parts, so the test is a grouping by
    word instead of a comparison of all pairs of an asset.
    """
    parts = [
        (start, size)
        for size in range(MIN_LENGTH, MAX_LENGTH)
        for start in range(1, MAX_LENGTH - size + 2)
    ]
    pieces = F.array_distinct(
        F.array_compact(
            F.array(
                *[
                    F.when(
                        (F.length("word") > size) & (F.length("word") >= start + size - 1),
                        F.substring("word", start, size),
                    )
                    for start, size in parts
                ]
            )
        )
    )
    none = F.lit(None).cast("long")

    def entry(word: Column, frequency: Column, first_seen: Column, longer: Column) -> Column:
        return F.struct(
            word.alias("word"),
            frequency.alias("frequency"),
            first_seen.alias("first_seen"),
            longer.alias("longer"),
        )

    itself = entry(F.col("word"), F.col("frequency"), F.col("first_seen"), none)
    around = F.transform(pieces, lambda piece: entry(piece, none, none, F.col("frequency")))
    # a word and its parts leave the same row, so the statistics are read once
    grouped = (
        words.select("asset_id", F.inline(F.concat(F.array(itself), around)))
        .groupBy("asset_id", "word")
        .agg(
            F.max("frequency").alias("frequency"),
            F.max("first_seen").alias("first_seen"),
            F.max("longer").alias("longer"),
        )
    )
    explained = F.col("longer") >= F.col("frequency") * FRAGMENT_TOLERANCE
    return grouped.where(
        F.col("frequency").isNotNull() & ~F.coalesce(explained, F.lit(False))
    ).drop("longer")


_PICK = "struct<word:string,frequency:bigint>"


def _conflicts(picked: Column, word: Column) -> Column:
    return F.exists(
        picked, lambda p: F.contains(p["word"], word) | F.contains(word, p["word"])
    )


def _pick(picked: Column, ordered: Column, limit: int) -> Column:
    """Extend ``picked`` with words neither containing nor contained in it."""

    def step(done: Column, item: Column) -> Column:
        full = F.size(done) >= limit
        skip = full | _conflicts(done, item["word"])
        pick = F.struct(item["word"].alias("word"), item["frequency"].alias("frequency"))
        return F.when(skip, done).otherwise(F.concat(done, F.array(pick)))

    return bind(ordered, lambda items: F.aggregate(items, picked, step))


def pick_keywords(words: DataFrame, limit: int = DEFAULT_CANDIDATES, window: int = _ROUND) -> DataFrame:
    """``asset_id, position, word, frequency``: the greedy choice per asset.

    Each round looks at the best ``window`` words of an asset, cut down before
    the shuffle. An asset that still lacks words and has more of them goes into
    another round without those already decided; every round adds at least one
    word, so there are at most ``limit`` rounds and usually one.
    """
    order = Window.partitionBy("asset_id").orderBy(
        F.desc("frequency"), F.desc(F.length("word")), "first_seen"
    )
    words = cut_lineage(words)
    totals = words.groupBy("asset_id").agg(F.count(F.lit(1)).alias("left"))
    picked: DataFrame | None = None
    finished: list[DataFrame] = []
    pool = words
    while True:
        ranked = pool.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= window)
        batch = ranked.groupBy("asset_id").agg(
            F.array_sort(F.collect_list(F.struct("rn", "word", "frequency"))).alias("items")
        )
        if picked is None:
            start = F.array().cast(f"array<{_PICK}>")
            stage = batch.join(totals, "asset_id").withColumn("picked", start)
        else:
            stage = picked.join(batch.join(totals, "asset_id"), "asset_id")
        stage = stage.select(
            "asset_id", "left", _pick(F.col("picked"), F.col("items"), limit).alias("picked")
        )
        more = (F.size("picked") < limit) & (F.col("left") > window)
        if picked is None and totals.where(F.col("left") > window).isEmpty():
            finished.append(stage.select("asset_id", "picked"))
            break
        stage = cut_lineage(stage)
        finished.append(stage.where(~more).select("asset_id", "picked"))
        open_assets = stage.where(more).select("asset_id", "picked")
        if open_assets.isEmpty():
            break
        rest = salted_join(pool, open_assets, ["asset_id"], "inner", F.col("word"))
        pool = cut_lineage(
            rest.where(~_conflicts(F.col("picked"), F.col("word"))).drop("picked")
        )
        totals = pool.groupBy("asset_id").agg(F.count(F.lit(1)).alias("left"))
        # an asset whose last words all conflicted is done as it stands
        finished.append(open_assets.join(totals, "asset_id", "left_anti"))
        picked = open_assets
    result = finished[0]
    for part in finished[1:]:
        result = result.unionByName(part)
    return result.select("asset_id", F.posexplode("picked").alias("position", "pick")).select(
        "asset_id", "position", "pick.word", "pick.frequency"
    )


def suggest_keywords(
    segments: DataFrame,
    asset_tags: DataFrame,
    tags: DataFrame,
    limit: int = DEFAULT_CANDIDATES,
    chars: str = HAN,
) -> DataFrame:
    """Candidates for every asset, without names it already carries as tags.

    Names are excluded after the choice, by spelling, so fewer may remain.
    """
    words = drop_fragments(eligible_words(frequent_words(segments, chars)))
    chosen = pick_keywords(words, limit)
    named = salted_join(
        asset_tags.select("asset_id", "tag_id"),
        tags.select("tag_id", F.col("name").alias("word")),
        ["tag_id"],
        "inner",
        F.col("asset_id"),
    ).select("asset_id", "word")
    return chosen.join(named, ["asset_id", "word"], "left_anti")
