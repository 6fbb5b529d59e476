"""Context snippets and highlights for a matching segment.

Computed inside one row, and only for the rows of a result page.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bind import bind
from .text import char_fold, utf16_length

CONTEXT_BEFORE = 24
SNIPPET_LENGTH = 96
MIN_LEADING = 6

_RANGES = "array<struct<start:int,end:int>>"


def term_ranges(text: Column, terms: Column) -> Column:
    """Every occurrence of every term, overlaps included, as code-point ranges."""

    def of_needle(folded: Column, needle: Column) -> Column:
        size = F.length(needle)
        # every occurrence starts inside one of those found without overlaps
        apart = F.length(folded) - F.length(F.replace(folded, needle, F.lit("")))

        def step(starts: Column, _: Column) -> Column:
            last = F.coalesce(F.get(starts, F.size(starts) - 1), F.lit(0))
            return bind(
                F.position(needle, folded, last + 1),
                lambda at: F.when(at > 0, F.concat(starts, F.array(at))).otherwise(starts),
            )

        none = F.array().cast("array<int>")
        # most texts lack most terms and are passed over at once
        found = F.when(
            (size > 0) & F.contains(folded, needle), F.aggregate(F.sequence(F.lit(1), apart), none, step)
        ).otherwise(none)
        return F.transform(
            found, lambda i: F.struct((i - 1).alias("start"), (i - 1 + size).alias("end"))
        )

    needles = F.transform(terms, char_fold)
    return bind(
        char_fold(text),
        lambda folded: F.flatten(F.transform(needles, lambda needle: of_needle(folded, needle))),
    )


def merge_ranges(ranges: Column) -> Column:
    """Sorted ranges with overlapping and touching ones joined."""

    def step(done: Column, item: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        touches = (F.size(done) > 0) & (item["start"] <= last["end"])
        joined = F.struct(
            last["start"].alias("start"), F.greatest(last["end"], item["end"]).alias("end")
        )
        head = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(touches, F.concat(head, F.array(joined))).otherwise(
            F.concat(done, F.array(item))
        )

    return F.aggregate(F.array_sort(ranges).cast(_RANGES), F.array().cast(_RANGES), step)


def snippet_window(text: Column, matches: Column) -> Column:
    """``struct(start, end)`` of the window around the first match."""
    size = F.length(text)
    first = F.get(matches, 0)
    near = F.greatest(F.lit(0), first["start"] - CONTEXT_BEFORE)
    start = F.when(
        first["start"] - near < MIN_LEADING, F.greatest(F.lit(0), first["start"] - MIN_LEADING)
    ).otherwise(near)
    end = F.least(size, F.greatest(F.least(size, start + SNIPPET_LENGTH), first["end"]))
    return F.struct(
        F.when(F.size(matches) > 0, start).otherwise(F.lit(0)).alias("start"),
        F.when(F.size(matches) > 0, end).otherwise(F.least(size, F.lit(SNIPPET_LENGTH))).alias("end"),
    )


def build_snippet(text: Column, matches: Column, window: Column, terms: Column) -> Column:
    """Snippet text, highlights in UTF-16 units, truncation flags, matched terms."""
    start, end = window["start"], window["end"]

    def part(lo: Column, hi: Column) -> Column:
        return F.substring(text, lo + 1, hi - lo)

    inside = F.filter(matches, lambda m: (m["start"] >= start) & (m["end"] <= end))
    highlights = F.transform(
        inside,
        lambda m: F.struct(
            utf16_length(part(start, m["start"])).alias("start"),
            utf16_length(part(start, m["end"])).alias("end"),
        ),
    )
    lowered = F.transform(terms, F.lower)
    hit_texts = F.array_distinct(F.transform(matches, lambda m: part(m["start"], m["end"])))
    return F.struct(
        part(start, end).alias("snippet"),
        highlights.alias("highlights"),
        ((F.size(matches) > 0) & (start > 0)).alias("truncated_head"),
        (end < F.length(text)).alias("truncated_tail"),
        F.filter(hit_texts, lambda t: F.array_contains(lowered, F.lower(t))).alias("matched_terms"),
    )


def with_snippet(df, text: str, terms: str):
    """Add ``snippet, highlights, truncated_head, truncated_tail, snippet_terms``."""
    staged = (
        df.withColumn("__matches", merge_ranges(term_ranges(F.col(text), F.col(terms))))
        .withColumn("__window", snippet_window(F.col(text), F.col("__matches")))
        .withColumn(
            "__built",
            build_snippet(F.col(text), F.col("__matches"), F.col("__window"), F.col(terms)),
        )
    )
    return staged.select(
        *df.columns,
        F.col("__built.snippet").alias("snippet"),
        F.col("__built.highlights").alias("highlights"),
        F.col("__built.truncated_head").alias("truncated_head"),
        F.col("__built.truncated_tail").alias("truncated_tail"),
        F.col("__built.matched_terms").alias("snippet_terms"),
    )


def highlight_pieces(snippet: Column, highlights: Column) -> Column:
    """Cut a snippet into ``array<struct<text,hit>>`` for rendering.

    Ranges count UTF-16 units, so the cuts are made on the UTF-16 bytes.
    """

    def pieces(data: Column, merged: Column) -> Column:
        def piece(lo: Column, hi: Column, hit: bool) -> Column:
            part = F.decode(F.substring(data, lo * 2 + 1, (hi - lo) * 2), "UTF-16BE")
            return F.struct(part.alias("text"), F.lit(hit).alias("hit"))

        def end_before(i: Column) -> Column:
            return F.coalesce(F.get(merged, i - 1)["end"], F.lit(0))

        pairs = F.transform(
            merged,
            lambda m, i: F.array(
                piece(end_before(i), m["start"], False), piece(m["start"], m["end"], True)
            ),
        )
        tail = piece(end_before(F.size(merged)), F.shiftright(F.octet_length(data), 1), False)
        return F.filter(F.concat(F.flatten(pairs), F.array(tail)), lambda p: p["text"] != "")

    cut = bind(
        merge_ranges(highlights),
        lambda merged: bind(F.encode(snippet, "UTF-16BE"), lambda data: pieces(data, merged)),
    )
    whole = F.array(F.struct(snippet.alias("text"), F.lit(False).alias("hit")))
    return F.when(F.size(highlights) == 0, whole).otherwise(cut)
