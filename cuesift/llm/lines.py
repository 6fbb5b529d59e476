"""Line dedup by a log-template tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .arrays import row_key

# Leading tokens that choose a branch below the token count.
DEPTH = 3
# Documents in which a template must stand to be recurring.
MIN_DOCUMENTS = 10
# Share of a line's tokens that its template must keep; variable fields are not kept.
SIMILARITY = 0.8

VARIABLE = "<*>"
_SPACE = r"\x20\x09\x0b\x0c"
# A whole token with a digit; begun at its first character only, so that long tokens cost no more.
_NUMBERED = rf"(?<![^{_SPACE}])(?=[^{_SPACE}0-9]*[0-9])[^{_SPACE}]+"


def split_lines(text: Column) -> Column:
    """The lines of a text; they end with CR LF, LF or CR."""
    # one character needs no pattern; texts with CR are few
    return F.split(F.when(F.contains(text, F.lit("\r")), F.regexp_replace(text, "\r\n?", "\n")).otherwise(text), "\n")


def masked_line(line: Column) -> Column:
    """The tokens of a line with one space between them, those with a digit as a variable field."""
    masked = F.when(line.rlike("[0-9]"), F.regexp_replace(line, _NUMBERED, VARIABLE)).otherwise(line)
    # most lines have single spaces already and are not written again
    uneven = F.contains(line, F.lit("  "))
    for space in "\t\x0b\x0c":
        uneven |= F.contains(line, F.lit(space))
    return F.trim(F.when(uneven, F.regexp_replace(masked, f"[{_SPACE}]+", " ")).otherwise(masked))


def document_lines(docs: DataFrame) -> DataFrame:
    """``key, at, line, branch, masked``: the lines of every document that have tokens.

    A document's rows that agree in id and text are one. ``line`` is 128 bits of
    the masked line and ``branch`` 128 bits of its token count and leading tokens.
    """
    texts = docs.select(row_key().alias("key"), split_lines(F.coalesce("text", F.lit(""))).alias("all"))
    # every text has a line; the plain form would split it once more to ask whether it has
    lines = texts.select("key", F.posexplode_outer("all").alias("at", "line"))
    # asked of the line itself: a filter of masked lines would mask each of them twice
    lines = lines.where(F.col("line").rlike(f"[^{_SPACE}]"))
    lines = lines.select("key", "at", masked_line(F.col("line")).alias("masked"))
    count = F.length("masked") - F.length(F.replace("masked", F.lit(" "), F.lit(""))) + 1
    lead = F.substring_index("masked", " ", DEPTH)
    return lines.select(
        "key",
        "at",
        F.unhex(F.md5("masked")).alias("line"),
        F.unhex(F.md5(F.concat_ws(" ", count.cast("string"), lead))).alias("branch"),
        "masked",
    )


def placed_lines(docs: DataFrame) -> DataFrame:
    """``place, key, at, line, branch`` of all lines, written once; no later step masks them again."""
    rows = document_lines(docs).drop("masked")
    return stored(rows.withColumn("place", F.monotonically_increasing_id()), "placed-lines")


def _masked(docs: DataFrame, wanted: DataFrame, places: DataFrame) -> DataFrame:
    """``line, masked`` of the lines ``wanted(line, place)``, each read at one place of the texts."""
    at = places.select("place", "key", "at").join(wanted.select("line", "place"), "place")
    read = at.groupBy("key").agg(F.collect_list(F.struct("at", "line")).alias("read"))
    texts = docs.select(row_key().alias("key"), "text").join(read, "key")
    # split before the lines are listed, so once a text
    every = texts.select(split_lines(F.col("text")).alias("every"), "read").select("every", F.explode("read").alias("r"))
    rows = every.select("r.line", masked_line(F.get("every", F.col("r.at"))).alias("masked"))
    # repeated rows of a document give their lines again
    return rows.groupBy("line").agg(F.min("masked").alias("masked"))


def _widespread(members: DataFrame, by: list[str], pairs: DataFrame, least: int) -> DataFrame:
    """The groups ``by`` of ``members(by, line, documents)`` that stand in ``least`` different documents.

    The lines' numbers of documents bound the group's from both sides. Where
    their sum is enough and no line is enough by itself, documents are counted
    one by one; every line there has fewer than ``least``.
    """
    bounds = members.groupBy(*by).agg(F.sum("documents").alias("n"), F.max("documents").alias("top"))
    bounds = stored(bounds.where(F.col("n") >= least), "bounds")
    open_ = bounds.where(F.col("top") < least).select(*by)
    seen = members.join(open_, by, "left_semi").select(*by, "line").join(pairs, "line").select(*by, "key").distinct()
    counted = seen.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return bounds.where(F.col("top") >= least).select(*by).unionByName(counted.select(*by))


def recurring_lines(
    docs: DataFrame, places: DataFrame, min_documents: int = MIN_DOCUMENTS, similarity: float = SIMILARITY
) -> DataFrame:
    """``line, template`` of the masked lines that belong to a recurring template.

    Branches with too few documents are left at once, before any text is read.
    In the others a token is kept where enough different documents of the branch
    have it at that place, and is a variable field elsewhere; lines that come to
    the same kept tokens share a template. A line joins its template only if
    enough of its tokens are kept, and the template recurs only if its lines
    stand in enough different documents. A line in a third of all documents is
    one row with its number of documents.
    """
    pairs = places.groupBy("branch", "line", "key").agg(F.min("place").alias("place"))
    counted = pairs.groupBy("branch", "line").agg(F.count(F.lit(1)).alias("documents"), F.min("place").alias("place"))
    counted = stored(counted, "distinct-lines")
    full = counted.groupBy("branch").agg(F.sum("documents").alias("n")).where(F.col("n") >= min_documents)
    wanted = stored(counted.join(full.select("branch"), "branch", "left_semi"), "open-lines")
    open_ = stored(wanted.drop("place").join(_masked(docs, wanted, places), "line"), "open-texts")
    rare = wanted.where(F.col("documents") < min_documents).select("line")
    pairs = places.select("line", "key").join(rare, "line", "left_semi").distinct()
    tokens = open_.select("branch", "line", "documents", F.posexplode(F.split("masked", " ")).alias("at", "token"))
    words = tokens.where(F.col("token") != VARIABLE)
    place = ["branch", "at", "token"]
    support = stored(_widespread(words, place, pairs, min_documents).withColumn("fixed", F.lit(1)), "kept-tokens")
    kept = (
        tokens.join(support, place, "left")
        .select(
            "branch",
            "line",
            "documents",
            "at",
            F.when(F.col("fixed") == 1, F.col("token")).otherwise(VARIABLE).alias("field"),
            F.coalesce("fixed", F.lit(0)).alias("fixed"),
        )
        .groupBy("branch", "line", "documents")
        .agg(
            F.array_join(F.array_sort(F.collect_list(F.struct("at", "field")))["field"], " ").alias("template"),
            F.avg("fixed").alias("share"),
        )
        .where(F.col("share") >= similarity)
    )
    kept = stored(kept, "kept-lines")
    templates = stored(_widespread(kept, ["branch", "template"], pairs, min_documents), "templates")
    return kept.join(templates, ["branch", "template"]).select("line", "template")


def line_dedup(
    docs: DataFrame, min_documents: int = MIN_DOCUMENTS, similarity: float = SIMILARITY
) -> DataFrame:
    """``doc_id, n_lines, n_dropped, text`` of every document, recurring lines dropped.

    Lines are parsed by a tree of fixed depth: token count, then leading tokens
    with numbers masked; below a branch, fields that vary are masked as well. All
    lines of a template that stands in at least ``min_documents`` different
    documents go, in every document. Masked fields do not count as kept, so lines
    of numbers stay, and so do lines that are alike in one document only. Lines
    without tokens stay.

    Null text is empty, has one line and stays null. Repeated rows count as one
    document and get equal results. Ids may be null. An empty table gives no
    rows. Only ``doc_id`` and ``text`` are read.
    """
    places = placed_lines(docs)
    recurring = stored(recurring_lines(docs, places, min_documents, similarity).select("line"), "recurring-lines")
    dropped = (
        places.select("key", "at", "line")
        .join(recurring, "line", "left_semi")
        .groupBy("key")
        .agg(F.collect_set("at").alias("gone"))
    )
    rows = docs.select(row_key().alias("key"), "doc_id", "text").join(dropped, "key", "left")
    gone = F.coalesce("gone", F.array().cast("array<int>"))
    rows = rows.select("doc_id", "text", gone.alias("gone"), split_lines(F.col("text")).alias("every"))
    stay = F.filter("every", lambda _, at: ~F.array_contains("gone", at))
    return rows.select(
        "doc_id",
        F.coalesce(F.size("every"), F.lit(1)).cast("long").alias("n_lines"),
        F.size("gone").cast("long").alias("n_dropped"),
        F.when(F.size("gone") > 0, F.array_join(stay, "\n")).otherwise(F.col("text")).alias("text"),
    )
