"""The recall paths of a search: file names, tags and segment text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import ascii_fold, contains_literal
from ..session import salted_join, stored
from .bm25 import score_hits
from .matching import count_terms, match_terms
from .terms import QueryTerms, Terms
from .trigram import GramIndex, gram_count, phrase_hits, scan_hits, segment_stats


def filter_assets(
    assets: DataFrame,
    kind: str | None = None,
    extract_status: str | None = None,
    directory_id: int | None = None,
) -> DataFrame:
    """The asset filter every recall path shares."""
    wanted = {"kind": kind, "extract_status": extract_status, "directory_id": directory_id}
    for column, value in wanted.items():
        if value is not None:
            assets = assets.where(F.col(column) == value)
    return assets


def _label_hits(labels: DataFrame, text: str, key: str, terms: Terms) -> DataFrame:
    """``query_id, <key>, matched_text, term`` for short texts such as names.

    A text is recalled when some term matches under ASCII folding; it then
    counts every term that matches under full case folding.
    """
    pairs = match_terms(labels.select(key, text), text, key, terms, F.lower)
    hits = terms.asked_by(pairs, key).withColumn(
        "__plain", contains_literal(F.col(text), F.col("term"))
    )
    return (
        hits.groupBy("query_id", key, F.col(text).alias("matched_text"))
        .agg(F.collect_set("term").alias("terms"), F.max("__plain").alias("__plain"))
        .where("__plain")
        .select("query_id", key, "matched_text", F.explode("terms").alias("term"))
    )


def recall_names(assets: DataFrame, terms: QueryTerms) -> DataFrame:
    """``query_id, asset_id, matched_text, term`` from file names."""
    return _label_hits(assets, "file_name", "asset_id", terms.of_labels())


def recall_tags(
    tags: DataFrame, asset_tags: DataFrame, assets: DataFrame, terms: QueryTerms
) -> DataFrame:
    """``query_id, asset_id, matched_text, term`` from the tags of assets.

    Names are matched once per tag; a tag on a third of all assets is joined
    in salted shares.
    """
    hits = _label_hits(tags, "name", "tag_id", terms.of_labels())
    links = asset_tags.select("asset_id", "tag_id").join(
        assets.select("asset_id"), "asset_id", "left_semi"
    )
    joined = salted_join(links, hits, ["tag_id"], "inner", F.col("asset_id"))
    return joined.select("query_id", "asset_id", "matched_text", "term").distinct()


def term_hits(
    segments: DataFrame, terms: Terms, postings: DataFrame | GramIndex | None = None
) -> DataFrame:
    """Whole-term matches of long terms, through the index where there is one.

    Scoring reads the matches twice, for the weights and for the scores. They
    are written out in between, so the text or the index is read once.
    """
    if isinstance(postings, GramIndex):
        return stored(postings.hits(terms), "hits")
    if postings is not None:
        return stored(phrase_hits(postings, terms), "hits")
    if terms.few and terms.literals() is None:
        texts = segments.select("segment_id", "asset_id", gram_count(F.col("text")).alias("n_grams"), "text")
        found = count_terms(texts, "text", terms, F.lower, ["segment_id", "asset_id", "n_grams"])
        return stored(found.select("folded", "segment_id", "asset_id", "n_grams", "tf"), "hits")
    texts = segments.select("segment_id", "asset_id", "text")
    return stored(scan_hits(match_terms(texts, "text", "segment_id", terms, F.lower)), "hits")


def _by_asset(hits: DataFrame, terms: Terms) -> DataFrame:
    """Hits gathered by asset while they are few.

    Returned to the queries they are many times more; grouping those by query
    and segment, and by query and asset, then needs no further shuffle.
    """
    return hits.repartition("asset_id") if terms.few else hits


def scored_hits(
    segments: DataFrame,
    wanted: Terms,
    postings: DataFrame | GramIndex | None = None,
    stats: DataFrame | None = None,
) -> DataFrame:
    """``folded, asset_id, segment_id, score`` of the hits of long terms."""
    hits = term_hits(segments, wanted, postings)
    stats = segment_stats(segments) if stats is None else stats
    return score_hits(hits, stats, wanted).select("folded", "asset_id", "segment_id", "score")


def asked_ranks(scored: DataFrame, wanted: Terms) -> DataFrame:
    """``query_id, asset_id, segment_id, rank`` of hits returned to their queries."""
    asked = wanted.asked_by(_by_asset(scored, wanted), "segment_id")
    return asked.groupBy("query_id", "asset_id", "segment_id").agg(F.sum("score").alias("rank"))


def recall_ranked(
    segments: DataFrame,
    terms: QueryTerms,
    postings: DataFrame | GramIndex | None = None,
    stats: DataFrame | None = None,
) -> DataFrame:
    """``query_id, asset_id, segment_id, rank`` for terms of three or more characters."""
    wanted = terms.long()
    return asked_ranks(scored_hits(segments, wanted, postings, stats), wanted)


def like_pairs(segments: DataFrame, wanted: Terms) -> DataFrame:
    """``folded, asset_id, segment_id`` of the segments that hold short terms."""
    texts = segments.select("segment_id", "asset_id", "text")
    return match_terms(texts, "text", "segment_id", wanted, ascii_fold, keep=["segment_id", "asset_id"])


def asked_segments(pairs: DataFrame, wanted: Terms) -> DataFrame:
    """``query_id, asset_id, segment_id`` of pairs returned to their queries."""
    asked = wanted.asked_by(_by_asset(pairs, wanted), "segment_id")
    return asked.select("query_id", "asset_id", "segment_id").distinct()


def recall_like(segments: DataFrame, terms: QueryTerms) -> DataFrame:
    """``query_id, asset_id, segment_id`` for terms of one or two characters."""
    wanted = terms.short()
    return asked_segments(like_pairs(segments, wanted), wanted)


def hit_counts(hits: DataFrame) -> DataFrame:
    """Matching segments per asset, exact however many there are."""
    return hits.groupBy("query_id", "asset_id").agg(F.count(F.lit(1)).alias("n_hits"))


def merge_recalls(ranked: DataFrame, like: DataFrame) -> DataFrame:
    """Per asset: the larger of the two counts and the best rank.

    The larger count, not the sum, so that a segment found on both paths is not
    counted twice.
    """
    nothing = F.lit(None).cast("long")
    first = ranked.groupBy("query_id", "asset_id").agg(
        F.count(F.lit(1)).alias("n_ranked"), F.min("rank").alias("best_rank")
    )
    second = like.groupBy("query_id", "asset_id").agg(F.count(F.lit(1)).alias("n_like"))
    both = first.withColumn("n_like", nothing).unionByName(
        second.withColumn("n_ranked", nothing).withColumn("best_rank", F.lit(None).cast("double"))
    )
    return both.groupBy("query_id", "asset_id").agg(
        F.greatest(F.max("n_ranked"), F.max("n_like")).alias("segment_hits"),
        F.min("best_rank").alias("best_rank"),
    )


def merge_segments(ranked: DataFrame, like: DataFrame) -> DataFrame:
    """Each matching segment once; a null rank means only the short path found it."""
    both = ranked.unionByName(like.withColumn("rank", F.lit(None).cast("double")))
    return both.groupBy("query_id", "asset_id", "segment_id").agg(F.min("rank").alias("rank"))
