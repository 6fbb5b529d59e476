"""Keyword queries: splitting, validation, de-duplication and routing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE, pieces, trim_space

MAX_QUERY_LENGTH = 200
GRAM_LENGTH = 3

QUERY_EMPTY = "SEARCH_QUERY_EMPTY"
QUERY_TOO_LONG = "SEARCH_QUERY_TOO_LONG"

WARN_SHORT_TERMS = "SHORT_TERM_LIKE_FALLBACK"
WARN_NO_LONG_TERMS = "NO_FTS_TERMS"

_SEPARATORS = rf"[{SPACE}\u200b-\u200d]+"


def split_terms(raw: Column) -> Column:
    """Non-empty words of a query."""
    return F.filter(pieces(raw, _SEPARATORS), lambda word: word != "")


def distinct_terms(raw: Column) -> Column:
    """Words of a query, the first spelling of each kept, ignoring case."""
    words = split_terms(trim_space(raw))
    keys = F.transform(words, F.lower)
    return F.filter(words, lambda word, i: F.array_position(keys, F.lower(word)) == i + 1)


def query_error(raw: Column) -> Column:
    """Reason code for a query that must not run, else null."""
    trimmed = trim_space(raw)
    return (
        F.when(trimmed.isNull() | (trimmed == ""), F.lit(QUERY_EMPTY))
        .when(F.length(trimmed) > MAX_QUERY_LENGTH, F.lit(QUERY_TOO_LONG))
        .when(F.size(split_terms(trimmed)) == 0, F.lit(QUERY_EMPTY))
    )


def term_path(term: Column) -> Column:
    """``fts`` for terms long enough for the gram index, else ``like``."""
    return F.when(F.length(term) >= GRAM_LENGTH, F.lit("fts")).otherwise(F.lit("like"))


def query_warnings(terms: Column) -> Column:
    """Warnings for short terms, from an array of terms."""
    short = F.filter(terms, lambda term: F.length(term) < GRAM_LENGTH)
    entries = F.array(
        F.when(
            F.size(short) > 0,
            F.struct(F.lit(WARN_SHORT_TERMS).alias("code"), short.alias("terms")),
        ),
        F.when(
            F.size(short) == F.size(terms),
            F.struct(F.lit(WARN_NO_LONG_TERMS).alias("code"), short.alias("terms")),
        ),
    )
    return F.filter(entries, lambda entry: entry.isNotNull())
