"""Mixing sources to target weights by capped water-filling and seeded sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

# A source is taken this many times at most.
MAX_EPOCHS = 3

# Equal parts of the hash range in which a source's words are counted first;
# only the part that holds the cut is then sorted.
_PARTS = 4096

WORD = r"[^\x20\x09-\x0D]+"


def ranked(names: DataFrame, column: str, name: str) -> DataFrame:
    """Add ``name``: the 0-based place of each distinct value, nulls last.

    Values are range-partitioned and numbered inside their partition, after the
    ones of the partitions before; no task sees all of them.
    """
    order = [F.col(column).isNull(), F.col(column)]
    placed = stored(
        names.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranks"
    )
    sizes = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__size"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition
    starts = sizes.select("__part", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__start"))
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return (
        placed.withColumn(name, within)
        .join(starts, "__part")
        .withColumn(name, (F.col(name) + F.col("__start")).cast("long"))
        .drop("__part", "__start")
    )


def water_fill(sources: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Add ``target`` to ``source, weight, source_size``.

    The whole size is shared by weight. Sources above ``max_epochs`` times their
    size are clamped there and the rest is shared again among the others, until
    none is above. Every round clamps at least one source or ends, reads one
    aggregate row, and leaves the sources on the executors. Weights are positive
    whole numbers; shares are quotients of whole numbers, so they do not depend
    on the order of addition.
    """
    cap = F.col("source_size") * max_epochs
    state = sources.withColumn("__clamped", F.lit(False))
    total, cut = None, None
    while True:
        open_ = ~F.col("__clamped")
        row = state.agg(
            F.coalesce(F.sum("source_size"), F.lit(0)).alias("total"),
            F.coalesce(F.sum(F.when(F.col("__clamped"), cap)), F.lit(0)).alias("given"),
            F.coalesce(F.sum(F.when(open_, F.col("weight"))), F.lit(0)).alias("weights"),
        ).first()
        left, weights = row.total - row.given, row.weights
        share = F.col("weight") * F.lit(left)
        if not weights:
            break
        over = ~F.col("__clamped") & (share > cap * weights)
        clamped = state.where(over).count()
        if not clamped:
            break
        state = state.withColumn("__clamped", F.col("__clamped") | over)
    even = share.cast("double") / F.lit(max(weights, 1)).cast("double")
    return state.select(
        "source",
        "weight",
        "source_size",
        F.when(F.col("__clamped"), cap.cast("double")).otherwise(even).alias("target"),
    )


def _source_key(source):
    """A join key that also matches null: the flag and the name."""
    return F.concat(F.when(source.isNull(), F.lit("0")).otherwise(F.lit("1")), F.coalesce(source, F.lit("")))


def sized(docs: DataFrame, seed: int) -> DataFrame:
    """``docs`` with ``__size`` in words, ``__key`` of the source and a seeded ``__draw``."""
    return docs.select(
        "*",
        F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("__size"),
        _source_key(F.col("source")).alias("__key"),
        F.xxhash64(F.lit(seed), "doc_id", F.coalesce("text", F.lit(""))).alias("__draw"),
    )


def source_plan(
    docs: DataFrame, weights: DataFrame | None = None, seed: int = 0, max_epochs: int = MAX_EPOCHS
) -> DataFrame:
    """What the mix takes of each source.

    ``source, weight, source_size, target`` and: ``whole`` repetitions of every
    document, one more of the documents with a draw below ``cut``, and ``rest``
    words of those at ``cut`` itself, so that the words taken are the target
    rounded to a whole number. ``weights(source, weight)`` names each source
    once; without it sources weigh 1, 2, 3 repeating in code point order, null
    last.
    """
    slim = stored(
        sized(docs, seed).select("source", "__key", "__size", "__draw"), "mix-sizes"
    )
    sources = slim.groupBy("__key").agg(
        F.max("source").alias("source"), F.sum("__size").alias("source_size")
    )
    if weights is None:
        with_weight = ranked(sources, "source", "__rank").withColumn("weight", F.col("__rank") % 3 + 1)
    else:
        given = weights.select(_source_key(F.col("source")).alias("__key"), "weight")
        with_weight = sources.join(given, "__key")
    targets = stored(
        water_fill(with_weight, max_epochs), "mix-targets"
    ).withColumn("__key", _source_key(F.col("source")))
    taken = F.round("target").cast("long")
    plan = targets.select(
        "*",
        taken.alias("__taken"),
        F.coalesce(F.try_divide(taken - F.pmod(taken, "source_size"), "source_size"), F.lit(0))
        .cast("long").alias("whole"),
    ).withColumn("__extra", F.col("__taken") - F.col("whole") * F.col("source_size"))
    # the part of the hash range in which the extra words run out
    part = F.shiftrightunsigned("__draw", 64 - (_PARTS.bit_length() - 1))
    parts = slim.groupBy("__key", part.alias("__part")).agg(F.sum("__size").alias("__words"))
    run = Window.partitionBy("__key").orderBy("__part")
    cut_part = (
        parts.withColumn("__upto", F.sum("__words").over(run.rowsBetween(Window.unboundedPreceding, 0)))
        .join(plan.select("__key", "__extra"), "__key")
        .where((F.col("__upto") > F.col("__extra")) & (F.col("__upto") - F.col("__words") <= F.col("__extra")))
        .select("__key", "__part", "__extra", (F.col("__upto") - F.col("__words")).alias("__before"))
    )
    # equal draws (repeated rows) count as one
    draws = (
        slim.withColumn("__part", part)
        .join(cut_part, ["__key", "__part"])
        .groupBy("__key", "__draw", "__extra", "__before")
        .agg(F.sum("__size").alias("__words"), F.count(F.lit(1)).alias("__rows"))
    )
    order = Window.partitionBy("__key").orderBy(_unsigned("__draw"))
    upto = F.col("__before") + F.sum("__words").over(order.rowsBetween(Window.unboundedPreceding, 0))
    cut = (
        draws.withColumn("__upto", upto)
        .where((F.col("__upto") > F.col("__extra")) & (F.col("__upto") - F.col("__words") <= F.col("__extra")))
        .select(
            "__key",
            F.col("__draw").alias("cut"),
            F.floor((F.col("__extra") - F.col("__upto") + F.col("__words")) / F.col("__rows")).alias("rest"),
        )
    )
    # stored, so that Spark knows its size when it plans the join to the documents
    return stored(
        plan.join(cut, "__key", "left").select(
            "__key", "source", "weight", "source_size", "target", "whole",
            F.when(F.col("__extra") > 0, F.col("cut")).alias("cut"),
            F.when(F.col("__extra") > 0, F.col("rest")).otherwise(0).alias("rest"),
        ),
        "mix-plan",
    )


def _unsigned(column: str):
    """Order of a 64-bit draw as an unsigned number."""
    return F.col(column).bitwiseXOR(F.lit(-(1 << 63)))


def mix(
    docs: DataFrame, weights: DataFrame | None = None, seed: int = 0, max_epochs: int = MAX_EPOCHS
) -> DataFrame:
    """``docs`` plus ``mix_size, mix_source_size, mix_target, mix_taken, mix_copies, mix_rest``.

    ``mix_copies`` whole repetitions and the first ``mix_rest`` words of the
    document make ``mix_taken`` words. Texts are not shuffled: only sizes and
    draws are, and each document then meets the one row of its source.

    Null text has size 0; null source is a source of its own, last in order.
    Documents without words take none. Documents that agree in id and text are
    drawn together. Empty table: no rows. Columns of ``docs`` keep their names
    unless they begin with ``mix_`` or two underscores.
    """
    plan = source_plan(docs, weights, seed, max_epochs).drop("source", "weight")
    plan = plan.withColumnsRenamed(
        {"source_size": "mix_source_size", "target": "mix_target", "whole": "__whole", "cut": "__cut", "rest": "__rest"}
    )
    below = F.col("__cut").isNotNull() & (_unsigned("__draw") < _unsigned("__cut"))
    at = F.coalesce(F.col("__draw") == F.col("__cut"), F.lit(False))
    rows = sized(docs, seed).join(plan, "__key")
    copies = F.col("__whole") + below.cast("int")
    rest = F.when(at, F.least("__rest", "__size")).otherwise(0).cast("long")
    return rows.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.col("__size").alias("mix_size"),
        "mix_source_size",
        "mix_target",
        (copies * F.col("__size") + rest).alias("mix_taken"),
        copies.cast("long").alias("mix_copies"),
        rest.alias("mix_rest"),
    )


def repeated(mixed: DataFrame) -> DataFrame:
    """The documents of a mix: every whole repetition, and the words of the last one."""
    docs = [F.col(f"`{c}`") for c in mixed.columns if not c.startswith("mix_")]
    words = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), 0)
    head = F.array_join(F.slice(words, 1, F.col("mix_rest").cast("int")), "")
    full = F.when(F.col("mix_copies") > 0, F.array_repeat("text", F.col("mix_copies").cast("int"))).otherwise(
        F.array().cast("array<string>")
    )
    part = F.when(F.col("mix_rest") > 0, F.array(head)).otherwise(F.array().cast("array<string>"))
    texts = mixed.select(*docs, F.explode(F.concat(full, part)).alias("__text"))
    return texts.withColumn("text", F.col("__text")).drop("__text")
