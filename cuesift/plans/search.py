"""Keyword search over a catalogue, for one query or a table of queries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.snippet import with_snippet
from ..functions.text import ascii_fold
from ..operators.bm25 import score_hits
from ..operators.bounded import first_results, page_counts
from ..operators.catalogue import asset_summaries
from ..operators.counting import count_matches
from ..operators.matching import match_terms
from ..operators.ranking import (
    SEGMENTS_PER_ASSET,
    counted_candidates,
    label_matches,
    next_page,
    page_limit,
    rank_candidates,
    result_page,
    result_totals,
    top_segments,
)
from ..operators.recall import (
    asked_ranks,
    asked_segments,
    filter_assets,
    like_pairs,
    merge_recalls,
    merge_segments,
    recall_names,
    recall_tags,
    scored_hits,
    term_hits,
)
from ..operators.terms import QueryTerms, load_terms, normalize_queries
from ..operators.trigram import GramIndex, segment_stats
from ..session import BROADCAST_ROWS, cut_lineage, fits_broadcast


@dataclass(frozen=True)
class Catalogue:
    """The tables a search reads; the index, stored or made on the way, is optional."""

    assets: DataFrame
    segments: DataFrame
    tags: DataFrame
    asset_tags: DataFrame
    postings: DataFrame | GramIndex | None = None
    stats: DataFrame | None = None


@dataclass(frozen=True)
class SearchResult:
    """``candidates`` hold every matching asset; pages and snippets derive from them."""

    queries: DataFrame
    terms: QueryTerms
    candidates: DataFrame
    segment_hits: DataFrame


def one_query(spark: SparkSession, query: str) -> DataFrame:
    return spark.createDataFrame([(0, query)], "query_id long, query string")


def search(
    catalogue: Catalogue,
    queries: DataFrame,
    kind: str | None = None,
    extract_status: str | None = None,
    directory_id: int | None = None,
    count_body_terms: bool = False,
) -> SearchResult:
    """Recall, merge and rank ``queries(query_id, query)``.

    Long terms use the index when the catalogue has one and a scan otherwise;
    short terms scan, as no trigram can hold them.
    """
    normalized = normalize_queries(queries)
    terms = load_terms(normalized)
    assets, keep = _filtered(catalogue, kind, extract_status, directory_id)
    long, short = terms.long(), terms.short()
    scored = keep(scored_hits(catalogue.segments, long, catalogue.postings, catalogue.stats))
    pairs = keep(like_pairs(catalogue.segments, short))
    ranked, like = asked_ranks(scored, long), asked_segments(pairs, short)
    names = recall_names(assets, terms)
    tags = recall_tags(catalogue.tags, catalogue.asset_tags, assets, terms)
    if terms.rows is not None and not count_body_terms:
        candidates = counted_candidates(count_matches(scored, pairs, label_matches(names, tags), terms))
    else:
        body = _body_terms(catalogue, terms, keep) if count_body_terms else None
        candidates = rank_candidates(names, tags, merge_recalls(ranked, like), body)
    return SearchResult(
        queries=normalized,
        terms=terms,
        candidates=candidates,
        segment_hits=merge_segments(ranked, like),
    )


def _filtered(catalogue: Catalogue, kind: str | None, extract_status: str | None, directory_id: int | None):
    """The assets a search is about, and a function that keeps their hits."""
    assets = filter_assets(catalogue.assets, kind, extract_status, directory_id)
    unfiltered = kind is None and extract_status is None and directory_id is None

    def keep(hits: DataFrame) -> DataFrame:
        if unfiltered:
            return hits
        return hits.join(assets.select("asset_id"), "asset_id", "left_semi")

    return assets, keep


def search_top(
    catalogue: Catalogue,
    queries: DataFrame,
    limit: int | None = None,
    offset: int = 0,
    kind: str | None = None,
    extract_status: str | None = None,
    directory_id: int | None = None,
    digits: int | None = None,
) -> DataFrame:
    """The page ``result_page`` cuts from ``search``, without ranking all candidates.

    Hits that cannot bring their asset onto the page are dropped before they are
    summed, see ``operators.bounded``. ``digits`` rounds ranks for the order.
    """
    terms = load_terms(normalize_queries(queries))
    assets, keep = _filtered(catalogue, kind, extract_status, directory_id)
    first = max(offset, 0) + page_limit(limit)
    long = terms.long()
    stats = segment_stats(catalogue.segments) if catalogue.stats is None else catalogue.stats
    hits = term_hits(catalogue.segments, long, catalogue.postings)
    scored = cut_lineage(keep(score_hits(hits, stats, long)).select("folded", "asset_id", "segment_id", "score"))
    like_counts = cut_lineage(_like_counts(keep(like_pairs(catalogue.segments, terms.short())), terms))
    names = recall_names(assets, terms)
    tags = recall_tags(catalogue.tags, catalogue.asset_tags, assets, terms)
    nothing = queries.sparkSession.createDataFrame(
        [], "query_id long, asset_id long, segment_hits long, best_rank double"
    )
    labels = cut_lineage(rank_candidates(names, tags, nothing).drop("segment_hits", "best_rank"))
    found = first_results(labels, scored, like_counts, long, first, digits)
    page = cut_lineage(result_page(found, limit, offset))
    return page_counts(page, scored, like_counts, long)


def _like_counts(pairs: DataFrame, terms: QueryTerms) -> DataFrame:
    """``query_id, asset_id, n_like``: the segments of an asset found by short terms."""
    if terms.rows is None:
        like = asked_segments(pairs, terms.short())
        return like.groupBy("query_id", "asset_id").agg(F.count(F.lit(1)).alias("n_like"))
    # few terms are returned to their queries in the task of the asset
    nothing = pairs.withColumn("score", F.lit(None).cast("double")).limit(0)
    unlabelled = pairs.sparkSession.createDataFrame([], "query_id long, asset_id long")
    counted = count_matches(nothing, pairs, unlabelled, terms)
    return counted.select("query_id", "asset_id", F.col("segment_hits").alias("n_like"))


def search_after(
    catalogue: Catalogue, result: SearchResult, last: DataFrame, limit: int | None = None
) -> DataFrame:
    """The page of results that follows the rows ``last``, with asset summaries."""
    page = next_page(result.candidates, last, limit)
    summaries = asset_summaries(
        catalogue.assets, catalogue.tags, catalogue.asset_tags, page.select("asset_id").distinct()
    )
    return page.join(summaries, "asset_id")


def _body_terms(catalogue: Catalogue, terms: QueryTerms, keep) -> DataFrame:
    """``query_id, asset_id, term`` of the terms found in the text."""
    long, short = terms.long(), terms.short()
    hits = term_hits(catalogue.segments, long, catalogue.postings).select("folded", "asset_id")
    texts = catalogue.segments.select("segment_id", "asset_id", "text")
    pairs = match_terms(texts, "text", "segment_id", short, ascii_fold).select("folded", "asset_id")
    both = long.asked_by(hits.distinct(), "asset_id").unionByName(
        short.asked_by(pairs.distinct(), "asset_id")
    )
    return keep(both.select("query_id", "asset_id", "term").distinct())


def search_page(
    catalogue: Catalogue, result: SearchResult, limit: int | None = None, offset: int = 0
) -> DataFrame:
    """A page of results with asset summaries, joined after the page is cut."""
    page = result_page(result.candidates, limit, offset)
    summaries = asset_summaries(
        catalogue.assets, catalogue.tags, catalogue.asset_tags, page.select("asset_id").distinct()
    )
    return page.join(summaries, "asset_id")


def search_totals(result: SearchResult) -> DataFrame:
    return result_totals(result.candidates)


def page_snippets(
    catalogue: Catalogue,
    result: SearchResult,
    limit: int | None = None,
    offset: int = 0,
    per_asset: int = SEGMENTS_PER_ASSET,
) -> DataFrame:
    """Snippets and highlights of the segments of a result page.

    A segment found through the index shows all terms of its query, one found
    only by short terms shows those.
    """
    page = result_page(result.candidates, limit, offset).select("query_id", "asset_id")
    # a page holds at most page_limit assets of each query
    if fits_broadcast(result.queries, BROADCAST_ROWS // page_limit(limit)):
        page = F.broadcast(page)
    chosen = result.segment_hits.join(page, ["query_id", "asset_id"], "left_semi")
    best = top_segments(chosen, per_asset)
    terms = result.queries.select(
        "query_id",
        F.col("terms"),
        F.filter("terms", lambda t: F.length(t) < 3).alias("__short"),
    )
    texts = catalogue.segments.select(
        "segment_id", "source", "ordinal", "start_ms", "end_ms", "text"
    )
    rows = (
        best.join(texts, "segment_id")
        .join(terms, "query_id")
        .withColumn("__shown", F.when(F.col("rank").isNull(), F.col("__short")).otherwise(F.col("terms")))
    )
    return with_snippet(rows, "text", "__shown").drop("text", "terms", "__short", "__shown")
