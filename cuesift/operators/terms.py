"""A table of queries to a table of terms."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..functions.query import distinct_terms, query_error, query_warnings, term_path
from ..functions.text import ascii_fold
from ..session import BROADCAST_ROWS, salted_join

# Up to this many distinct terms are written into a scan as literals.
LITERAL_TERMS = 64

_TERM_ROW = (
    "query_id long, position int, term string, length int, path string, lowered string, plain string"
)


def normalize_queries(queries: DataFrame) -> DataFrame:
    """``query_id, error_code, terms, warnings`` for ``queries(query_id, query)``.

    A query is at most 200 code points, so its terms stay in the row.
    """
    error = query_error(F.col("query"))
    staged = queries.select(
        "query_id", error.alias("error_code"), distinct_terms(F.col("query")).alias("terms")
    )
    return staged.select(
        "query_id",
        "error_code",
        F.when(F.col("error_code").isNull(), F.col("terms")).alias("terms"),
        F.when(F.col("error_code").isNull(), query_warnings(F.col("terms"))).alias("warnings"),
    )


def query_terms(normalized: DataFrame) -> DataFrame:
    """One row per term: ``query_id, position, term, length, path``."""
    rows = normalized.select("query_id", F.posexplode("terms").alias("position", "term"))
    return rows.select(
        "query_id",
        "position",
        "term",
        F.length("term").alias("length"),
        term_path(F.col("term")).alias("path"),
    )


@dataclass(frozen=True)
class Terms:
    """Terms to look for, and their rows on the driver where these are few.

    ``table`` has ``query_id, term, folded``. ``rows`` holds the same rows, at
    most ``BROADCAST_ROWS`` of them and each under 200 characters; it is None
    for a larger table, which is then joined by shuffling.
    """

    table: DataFrame
    rows: list[Row] | None

    @property
    def few(self) -> bool:
        return self.rows is not None

    def literals(self, limit: int = LITERAL_TERMS) -> list[str] | None:
        """The distinct folded terms, if there are at most ``limit``."""
        if self.rows is None:
            return None
        distinct = sorted({row.folded for row in self.rows})
        return distinct if len(distinct) <= limit else None

    def distinct(self) -> DataFrame:
        """``folded``, each once."""
        return self.table.select("folded").distinct()

    def asked_by(self, pairs: DataFrame, spread_by: str) -> DataFrame:
        """Return text-term pairs to the queries that asked for the term."""
        if self.few:
            return pairs.join(F.broadcast(self.table), "folded")
        return salted_join(pairs, self.table, ["folded"], "inner", F.col(spread_by))


@dataclass(frozen=True)
class QueryTerms:
    """All terms of a set of queries, to be viewed by recall path."""

    table: DataFrame
    rows: list[Row] | None

    def _view(self, fold: str, path: str | None) -> Terms:
        table = self.table if path is None else self.table.where(F.col("path") == path)
        table = table.select("query_id", "term", F.col(fold).alias("folded"))
        if self.rows is None:
            return Terms(table, None)
        kept = [r for r in self.rows if path is None or r.path == path]
        return Terms(table, [Row(query_id=r.query_id, term=r.term, folded=r[fold]) for r in kept])

    def of_labels(self) -> Terms:
        """Every term, for names and tags."""
        return self._view("lowered", None)

    def long(self) -> Terms:
        """Terms the gram index can hold."""
        return self._view("lowered", "fts")

    def short(self) -> Terms:
        """Terms of one or two characters."""
        return self._view("plain", "like")


def load_terms(normalized: DataFrame, few: int = BROADCAST_ROWS) -> QueryTerms:
    """Evaluate the terms of ``normalized`` queries, reading at most ``few + 1`` rows.

    A small set continues as a plain table of values, so no later step has to
    split the queries again or check their number.
    """
    table = query_terms(normalized).select(
        F.col("query_id").cast("long").alias("query_id"),
        "position",
        "term",
        "length",
        "path",
        F.lower("term").alias("lowered"),
        ascii_fold(F.col("term")).alias("plain"),
    )
    rows = table.limit(few + 1).collect()
    if len(rows) > few:
        return QueryTerms(table, None)
    return QueryTerms(table.sparkSession.createDataFrame(rows, _TERM_ROW), rows)
