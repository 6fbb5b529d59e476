"""Search operators."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from cuesift.functions.snippet import highlight_pieces, with_snippet
from cuesift.functions.text import contains_literal
from cuesift.operators import quality
from cuesift.operators.bm25 import score_hits
from cuesift.operators.matching import match_terms
from cuesift.operators.ranking import last_rows, next_page, result_page, top_segments
from cuesift.operators.recall import (
    hit_counts,
    merge_recalls,
    merge_segments,
    recall_like,
    recall_names,
    recall_ranked,
    recall_tags,
    term_hits,
)
from cuesift.operators.terms import load_terms, normalize_queries, query_terms
from cuesift.operators.trigram import GramIndex, gram_blocks, segment_stats
from cuesift.plans.search import one_query, page_snippets, search, search_page, search_top, search_totals
from cuesift.session import cut_lineage, scratch_folder

from . import adapters as a

QUERIES = {}
ORACLES = {}


def check(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


# the flagship query: long and short terms, hits in names, tags and text
FLAGSHIP = "src1_EN  the entre en ch"

_FLAGSHIP_TERMS = """
terms AS (
  SELECT CAST(0 AS BIGINT) AS query_id, term, lower(term) AS folded
  FROM (VALUES ('src1_EN'), ('the'), ('entre'), ('en'), ('ch')) t(term))
"""

# common table expressions over ``terms``: every recall path of a search
_RECALL = """
long_terms AS (SELECT * FROM terms WHERE length(term) >= 3),
short_terms AS (SELECT * FROM terms WHERE length(term) < 3),
seg_low AS (SELECT *, lower(text) AS low, CAST(greatest(length(text) - 2, 0) AS INTEGER) AS n_grams FROM segments),
totals AS (SELECT count(*)::DOUBLE AS n_all, avg(n_grams) AS mean FROM seg_low),
phrase AS (
  SELECT t.folded, s.segment_id, s.asset_id, s.n_grams,
         -- a term that cannot overlap itself is counted by splitting
         CASE WHEN t.plain THEN len(string_split(s.low, t.folded)) - 1
              ELSE len(list_filter(generate_series(1, length(s.low) - length(t.folded) + 1),
                       lambda p: substr(s.low, p, length(t.folded)) = t.folded)) END AS tf
  FROM (SELECT DISTINCT folded, len(list_filter(generate_series(1, length(folded) - 1),
                                    lambda n: left(folded, n) = right(folded, n))) = 0 AS plain
        FROM long_terms) t JOIN seg_low s ON contains(s.low, t.folded)),
weights AS (
  SELECT folded, greatest(ln((n_all - n + 0.5) / (n + 0.5)), 1e-6) AS idf
  FROM (SELECT folded, count(*) AS n FROM phrase GROUP BY folded), totals),
scored AS (
  SELECT p.*, -w.idf * (p.tf * 2.2) / (p.tf + 1.2 * (0.25 + 0.75 * p.n_grams / totals.mean)) AS score
  FROM phrase p JOIN weights w USING (folded), totals),
ranked AS (
  SELECT t.query_id, s.asset_id, s.segment_id, sum(s.score) AS rank
  FROM scored s JOIN long_terms t USING (folded) GROUP BY ALL),
short_hits AS (
  SELECT DISTINCT t.query_id, s.asset_id, s.segment_id
  FROM short_terms t JOIN seg_low s
    ON contains(translate(s.text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                translate(t.term, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))),
body AS (
  SELECT coalesce(r.query_id, s.query_id) AS query_id, coalesce(r.asset_id, s.asset_id) AS asset_id,
         greatest(coalesce(n_ranked, 0), coalesce(n_short, 0)) AS segment_hits, best_rank
  FROM (SELECT query_id, asset_id, count(*) AS n_ranked, min(rank) AS best_rank FROM ranked GROUP BY ALL) r
  FULL JOIN (SELECT query_id, asset_id, count(*) AS n_short FROM short_hits GROUP BY ALL) s
    ON r.query_id = s.query_id AND r.asset_id = s.asset_id)
"""

_LABELS = """
name_hits AS (
  SELECT t.query_id, a.asset_id, a.file_name AS matched_text, t.term
  FROM assets a JOIN terms t ON contains(lower(a.file_name), t.folded)),
tag_hits AS (
  SELECT DISTINCT t.query_id, l.asset_id, g.name AS matched_text, t.term
  FROM tags g JOIN terms t ON contains(lower(g.name), t.folded) JOIN asset_tags l USING (tag_id)),
labels_all AS (
  SELECT query_id, asset_id, count(DISTINCT term) AS n_terms,
         string_agg(DISTINCT term, ',' ORDER BY term) AS matched_terms,
         bool_or(lower(matched_text) = lower(term)) AS exact,
         bool_or(source = 'file_name') AS by_name, bool_or(source = 'tag') AS by_tag,
         string_agg(DISTINCT matched_text, ',' ORDER BY matched_text) FILTER (WHERE source = 'file_name') AS names,
         string_agg(DISTINCT matched_text, ',' ORDER BY matched_text) FILTER (WHERE source = 'tag') AS tag_names
  FROM (SELECT *, 'file_name' AS source FROM name_hits UNION ALL SELECT *, 'tag' FROM tag_hits)
  GROUP BY ALL),
candidates AS (
  SELECT coalesce(l.query_id, b.query_id) AS query_id, coalesce(l.asset_id, b.asset_id) AS asset_id,
         CASE WHEN l.exact THEN 0 WHEN l.query_id IS NOT NULL THEN 1 ELSE 2 END AS tier,
         CAST(coalesce(n_terms, 0) AS INTEGER) AS n_terms, coalesce(matched_terms, '') AS matched_terms,
         0.0 - round(-best_rank, 6) AS best_rank, coalesce(segment_hits, 0) AS segment_hits,
         concat_ws(',', CASE WHEN by_name THEN 'file_name' END, CASE WHEN by_tag THEN 'tag' END,
                        CASE WHEN b.query_id IS NOT NULL THEN 'segment' END) AS matched_in,
         coalesce(names, '') AS matched_names, coalesce(tag_names, '') AS matched_tags
  FROM labels_all l FULL JOIN body b ON l.query_id = b.query_id AND l.asset_id = b.asset_id)
"""

_FLAGSHIP_ALL = f"WITH {a.SEGMENTS_SQL}, {a.ASSETS_SQL}, {a.TAGS_SQL}, {_FLAGSHIP_TERMS}, {_RECALL}, {_LABELS}"
_BATCH_ALL = f"WITH {a.SEGMENTS_SQL}, {a.ASSETS_SQL}, {a.TAGS_SQL}, {a.QUERIES_SQL}, {_RECALL}, {_LABELS}"
_FLAGSHIP_BODY = f"WITH {a.SEGMENTS_SQL}, {_FLAGSHIP_TERMS}, {_RECALL}"
_BATCH_BODY = f"WITH {a.SEGMENTS_SQL}, {a.QUERIES_SQL}, {_RECALL}"


def _terms(spark):
    return load_terms(normalize_queries(one_query(spark, FLAGSHIP)))


def _batch_terms(spark, sf_dir):
    return _asked_terms(a.queries(spark, sf_dir))


def _asked_terms(asked):
    return load_terms(normalize_queries(asked))


def _spark(found):
    return found.assets.sparkSession


def _postings(found):
    """The catalogue's index, or one made on the way."""
    return gram_blocks(found.segments) if found.postings is None else found.postings


def _six(column):
    """Six decimals; subtracting from zero avoids a negative zero."""
    return F.lit(0.0) - F.round(-F.col(column), 6)


def _flat(candidates):
    return candidates.select(
        "query_id",
        "asset_id",
        "tier",
        "n_terms",
        F.array_join("matched_terms", ",").alias("matched_terms"),
        _six("best_rank").alias("best_rank"),
        "segment_hits",
        F.array_join("matched_in", ",").alias("matched_in"),
        F.array_join("matched_names", ",").alias("matched_names"),
        F.array_join("matched_tags", ",").alias("matched_tags"),
    )


@check(
    "normalize_queries",
    rf"""
    WITH asked AS (SELECT conv_id * 100 + turn AS query_id, {a.trim_sql('text')} AS query FROM conversations),
    words AS (
      SELECT query_id, unnest(w) AS term, generate_subscripts(w, 1) AS at_word
      FROM (SELECT query_id, list_filter(string_split_regex(query, '{a.WS}+'), lambda x: x <> '') AS w
            FROM asked WHERE length(query) <= 200)),
    first_seen AS (SELECT *, row_number() OVER (PARTITION BY query_id, lower(term) ORDER BY at_word) AS n FROM words)
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY at_word) - 1 AS INTEGER) AS position, term,
           CASE WHEN length(term) >= 3 THEN 'fts' ELSE 'like' END AS path, NULL AS error_code
    FROM first_seen WHERE n = 1
    UNION ALL
    SELECT query_id, NULL, NULL, NULL, 'SEARCH_QUERY_TOO_LONG' FROM asked WHERE length(query) > 200
    """,
)
def normalize_queries_query(spark, sf_dir):
    """Every turn of every conversation, used whole as a query."""
    asked = a.table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("query_id"), F.col("text").alias("query")
    )
    normalized = normalize_queries(asked)
    good = query_terms(normalized).select("query_id", "position", "term", "path")
    bad = normalized.where(F.col("error_code").isNotNull()).select("query_id", "error_code")
    return good.unionByName(bad, allowMissingColumns=True)


@check(
    "query_warnings",
    rf"""
    WITH asked AS (SELECT conv_id * 100 + turn AS query_id, {a.trim_sql('text')} AS query FROM conversations),
    words AS (
      SELECT DISTINCT query_id, lower(unnest(list_filter(string_split_regex(query, '{a.WS}+'), lambda x: x <> ''))) AS term
      FROM asked WHERE length(query) <= 200),
    counted AS (SELECT query_id, count(*) AS n_all, count(*) FILTER (WHERE length(term) < 3) AS n_short FROM words GROUP BY 1)
    SELECT query_id, 'SHORT_TERM_LIKE_FALLBACK' AS code, n_short AS n_terms FROM counted WHERE n_short > 0
    UNION ALL SELECT query_id, 'NO_FTS_TERMS', n_short FROM counted WHERE n_short = n_all
    """,
)
def query_warnings_query(spark, sf_dir):
    asked = a.table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("query_id"), F.col("text").alias("query")
    )
    warned = normalize_queries(asked).select("query_id", F.explode("warnings").alias("w"))
    return warned.select("query_id", "w.code", F.size("w.terms").cast("long").alias("n_terms"))


@check(
    "like_literal",
    f"WITH {a.ASSETS_SQL} SELECT asset_id, file_name FROM assets WHERE contains(file_name, 'c1_e') OR contains(file_name, '%')",
)
def like_literal(spark, sf_dir):
    name = F.col("file_name")
    found = a.assets(spark, sf_dir).where(contains_literal(name, "C1_e") | contains_literal(name, "%"))
    return found.select("asset_id", "file_name")


@check(
    "recall_names",
    f"WITH {a.ASSETS_SQL}, {_FLAGSHIP_TERMS} SELECT query_id, asset_id, file_name AS matched_text, term "
    "FROM assets JOIN terms ON contains(lower(file_name), folded)",
)
@a.served("recall_names")
def recall_names_query(found, asked):
    return recall_names(found.assets, _terms(_spark(found)))


@check(
    "recall_tags",
    f"WITH {a.TAGS_SQL}, {_FLAGSHIP_TERMS} SELECT DISTINCT query_id, asset_id, name AS matched_text, term "
    "FROM tags JOIN terms ON contains(lower(name), folded) JOIN asset_tags USING (tag_id)",
)
@a.served("recall_tags")
def recall_tags_query(found, asked):
    return recall_tags(found.tags, found.asset_tags, found.assets, _terms(_spark(found)))


@check(
    "segment_hit_counts",
    f"{_FLAGSHIP_BODY} SELECT query_id, asset_id, count(*) AS n_hits FROM ranked GROUP BY ALL",
)
def segment_hit_counts(spark, sf_dir):
    return hit_counts(recall_ranked(a.segments(spark, sf_dir), _terms(spark)))


@check(
    "recall_segments_scan",
    f"{_FLAGSHIP_BODY} SELECT query_id, asset_id, segment_id FROM short_hits",
)
@a.served("recall_segments_scan")
def recall_segments_scan(found, asked):
    return recall_like(found.segments, _terms(_spark(found)))


@check(
    "recall_segments_indexed",
    f"{_BATCH_BODY} SELECT folded, segment_id, asset_id, n_grams, tf::BIGINT AS tf FROM phrase",
)
@a.served("recall_segments_indexed")
def recall_segments_indexed(found, asked):
    return term_hits(found.segments, _asked_terms(asked).long(), _postings(found))


# every tenth asset is turned into upper case and its words reversed, every tenth deleted
_CHANGED_SQL = f"""
WITH {a.SEGMENTS_SQL},
now AS (SELECT asset_id, segment_id, CASE asset_id % 10 WHEN 3 THEN upper(reverse(text)) ELSE text END AS text
        FROM segments WHERE asset_id % 10 <> 7)
SELECT term AS folded, segment_id, asset_id, len(regexp_extract_all(lower(text), term)) AS tf
FROM now, (VALUES ('tion'), ('thing'), ('eht'), ('zzzz')) t(term) WHERE contains(lower(text), term)
"""


@check("index_after_update", _CHANGED_SQL)
def index_after_update(spark, sf_dir):
    """A stored index after texts changed and assets went, searched as it is."""
    segments = a.segments(spark, sf_dir)
    index = _changed_index(spark, segments)
    return index.hits(_changed_terms(spark)).select("folded", "segment_id", "asset_id", "tf")


def _changed_index(spark, segments):
    index = GramIndex(spark, scratch_folder(spark, "index"), buckets=16)
    every = segments.select("asset_id").distinct()
    index.build(segments)
    touched = every.where(F.col("asset_id") % 10 == 3)
    changed = segments.join(touched, "asset_id", "left_semi").withColumn("text", F.upper(F.reverse("text")))
    index.update(changed, touched, 1)
    index.update(segments.limit(0), every.where(F.col("asset_id") % 10 == 7), 2)
    return index


def _changed_terms(spark):
    return load_terms(normalize_queries(one_query(spark, "tion THING eht zzzz"))).long()


@check("index_compacted", _CHANGED_SQL)
def index_compacted(spark, sf_dir):
    """The same index after its changes were merged, searched through a catalogue."""
    index = _changed_index(spark, a.segments(spark, sf_dir))
    merged = index.compacted(scratch_folder(spark, "index"))
    return term_hits(a.segments(spark, sf_dir), _changed_terms(spark), merged).select(
        "folded", "segment_id", "asset_id", "tf"
    )


@check(
    "recall_segments_matched",
    f"{_BATCH_BODY} SELECT folded, segment_id, asset_id, n_grams, tf::BIGINT AS tf FROM phrase",
)
@a.served("recall_segments_matched")
def recall_segments_matched(found, asked):
    """The same rows without an index."""
    hits = term_hits(found.segments, _asked_terms(asked).long())
    return hits.withColumn("tf", F.col("tf").cast("long"))


@check(
    "bm25_segments",
    f"{_BATCH_BODY} SELECT folded, segment_id, 0.0 - round(-score, 6) AS score FROM scored",
)
@a.served("bm25_segments")
def bm25_segments(found, asked):
    wanted = _asked_terms(asked).long()
    scored = score_hits(term_hits(found.segments, wanted), segment_stats(found.segments), wanted)
    return scored.select("folded", "segment_id", _six("score").alias("score"))


@check(
    "top_segments_per_asset",
    f"""{_FLAGSHIP_BODY}
    SELECT asset_id, segment_id, n, 0.0 - round(-rank, 6) AS rank FROM (
      SELECT *, CAST(row_number() OVER (PARTITION BY asset_id ORDER BY round(rank, 9), segment_id) AS INTEGER) AS n FROM ranked)
    WHERE n <= 3""",
)
@a.served("top_segments_per_asset")
def top_segments_per_asset(found, asked):
    hits = recall_ranked(found.segments, _terms(_spark(found)))
    best = top_segments(hits.withColumn("rank", F.round("rank", 9)), 3)
    return best.select("asset_id", "segment_id", "n", _six("rank").alias("rank"))


@check(
    "merge_recalls",
    f"{_FLAGSHIP_BODY} SELECT query_id, asset_id, segment_hits, 0.0 - round(-best_rank, 6) AS best_rank FROM body",
)
def merge_recalls_query(spark, sf_dir):
    segments = a.segments(spark, sf_dir)
    terms = _terms(spark)
    merged = merge_recalls(recall_ranked(segments, terms), recall_like(segments, terms))
    return merged.withColumn("best_rank", _six("best_rank"))


@check(
    "merge_segments",
    f"""{_FLAGSHIP_BODY}
    SELECT query_id, asset_id, segment_id, 0.0 - round(-min(rank), 6) AS rank
    FROM (SELECT * FROM ranked UNION ALL SELECT *, NULL FROM short_hits) GROUP BY ALL""",
)
def merge_segments_query(spark, sf_dir):
    segments = a.segments(spark, sf_dir)
    terms = _terms(spark)
    merged = merge_segments(recall_ranked(segments, terms), recall_like(segments, terms))
    return merged.withColumn("rank", _six("rank"))


@check("search_ranked", f"{_FLAGSHIP_ALL} SELECT * FROM candidates")
@a.served("search_ranked")
def search_ranked(found, asked):
    """Every matching asset of the flagship query with all it is ranked by."""
    result = search(found, one_query(_spark(found), FLAGSHIP))
    return _flat(result.candidates)


@check(
    "search_page",
    f"""{_FLAGSHIP_ALL}
    SELECT c.asset_id, c.tier, c.n_terms, c.best_rank, a.file_name, a.kind, t.tags
    FROM candidates c JOIN assets a USING (asset_id)
    JOIN (SELECT asset_id, string_agg(name, ',' ORDER BY name) AS tags FROM tag_links GROUP BY 1) t USING (asset_id)
    ORDER BY tier, n_terms DESC, best_rank NULLS LAST, asset_id LIMIT 30 OFFSET 30""",
)
def search_page_query(spark, sf_dir):
    found = a.catalogue(spark, sf_dir)
    result = search(found, one_query(spark, FLAGSHIP))
    # ranks are rounded first: the last digits of a sum depend on its order
    rounded = result.candidates.withColumn("best_rank", _six("best_rank"))
    page = search_page(found, replace(result, candidates=rounded), offset=30)
    return page.select(
        "asset_id",
        "tier",
        "n_terms",
        "best_rank",
        "file_name",
        "kind",
        F.array_join(F.transform("tags", lambda t: t["name"]), ",").alias("tags"),
    )


@check(
    "search_filtered",
    f"{_FLAGSHIP_ALL} SELECT c.* FROM candidates c JOIN assets a USING (asset_id) WHERE a.kind = 'video' AND a.extract_status = 'done'",
)
def search_filtered(spark, sf_dir):
    result = search(
        a.catalogue(spark, sf_dir), one_query(spark, FLAGSHIP), kind="video", extract_status="done"
    )
    return _flat(result.candidates)


@check("search_batch", f"{_BATCH_ALL} SELECT * FROM candidates")
@a.served("search_batch")
def search_batch(found, asked):
    """A table of queries against the whole corpus, through the index."""
    return _flat(search(replace(found, postings=_postings(found)), asked).candidates)


@check("search_batch_scan", f"{_BATCH_ALL} SELECT * FROM candidates")
@a.served("search_batch_scan")
def search_batch_scan(found, asked):
    """The same without an index."""
    return _flat(search(replace(found, postings=None), asked).candidates)


@check(
    "search_batch_top",
    f"""{_BATCH_ALL}
    SELECT query_id, asset_id, position, tier FROM (
      SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY tier, n_terms DESC, best_rank NULLS LAST, asset_id) AS INTEGER) AS position
      FROM candidates) WHERE position <= 30""",
)
@a.served("search_batch_top")
def search_batch_top(found, asked):
    """The first page of every query; hits that cannot reach it are never summed."""
    page = search_top(found, asked, digits=6)
    return page.select("query_id", "asset_id", "position", "tier")


@check(
    "search_top_filtered",
    f"""{_FLAGSHIP_ALL}
    SELECT asset_id, tier, n_terms, matched_in, matched_names, matched_tags, segment_hits, best_rank, position FROM (
      SELECT c.*, CAST(row_number() OVER (ORDER BY tier, n_terms DESC, best_rank NULLS LAST, c.asset_id) AS INTEGER) AS position
      FROM candidates c JOIN assets a USING (asset_id) WHERE a.kind = 'video') WHERE position BETWEEN 11 AND 31""",
)
def search_top_filtered(spark, sf_dir):
    """A later page of one query over part of the assets, with all it is ranked by."""
    page = search_top(a.catalogue(spark, sf_dir), one_query(spark, FLAGSHIP), 21, 10, kind="video", digits=6)
    return page.select(
        "asset_id",
        "tier",
        "n_terms",
        F.array_join("matched_in", ",").alias("matched_in"),
        F.array_join("matched_names", ",").alias("matched_names"),
        F.array_join("matched_tags", ",").alias("matched_tags"),
        "segment_hits",
        "best_rank",
        "position",
    )


@check(
    "search_pages_walked",
    f"""{_BATCH_ALL}
    SELECT query_id, asset_id, position, tier FROM (
      SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY tier, n_terms DESC, best_rank NULLS LAST, asset_id) AS INTEGER) AS position
      FROM candidates) WHERE position BETWEEN 91 AND 120""",
)
@a.served("search_pages_walked")
def search_pages_walked(found, asked):
    """The fourth page of every query, each page starting after the last row of the one before."""
    candidates = search(found, asked).candidates.withColumn("best_rank", _six("best_rank"))
    candidates = cut_lineage(candidates.select("query_id", "asset_id", "tier", "n_terms", "best_rank"))
    page = result_page(candidates)
    for _ in range(3):
        page = next_page(candidates, cut_lineage(last_rows(page)))
    return page.select("query_id", "asset_id", "position", "tier")


@check("search_totals", f"{_BATCH_ALL} SELECT query_id, count(*) AS total FROM candidates GROUP BY 1")
def search_totals_query(spark, sf_dir):
    return search_totals(search(a.catalogue(spark, sf_dir), a.queries(spark, sf_dir)))


# snippets of rows ``text, shown``: places of terms, joined where they touch, the window around the first
_SNIPPETS = """
places AS (
  SELECT *, list_sort(flatten(list_transform(shown, lambda t: list_transform(
      list_filter(generate_series(1, length(text) - length(t) + 1), lambda p: substr(lower(text), p, length(t)) = lower(t)),
      lambda p: {'s': p - 1, 'e': p - 1 + length(t)})))) AS r
  FROM shown_rows),
joined_places AS (
  SELECT *, CASE WHEN len(r) = 0 THEN [] ELSE list_reduce(list_transform(r, lambda x: [x]),
      lambda acc, x: CASE WHEN acc[len(acc)].e >= x[1].s
        THEN list_concat(acc[1:len(acc) - 1], [{'s': acc[len(acc)].s, 'e': greatest(acc[len(acc)].e, x[1].e)}])
        ELSE list_concat(acc, x) END) END AS m FROM places),
near_first AS (SELECT *, greatest(0, m[1].s - 24) AS near FROM joined_places),
begun AS (
  SELECT *, CASE WHEN len(m) = 0 THEN 0 WHEN m[1].s - near < 6 THEN greatest(0, m[1].s - 6) ELSE near END AS st FROM near_first),
windowed AS (
  SELECT *, CASE WHEN len(m) = 0 THEN least(length(text), 96)
                 ELSE least(length(text), greatest(least(length(text), st + 96), m[1].e)) END AS en FROM begun),
snippets AS (
  SELECT *, substr(text, st + 1, en - st) AS snippet,
         list_transform(list_filter(m, lambda x: x.s >= st AND x.e <= en), lambda x: {'s': x.s - st, 'e': x.e - st}) AS h,
         len(m) > 0 AND st > 0 AS truncated_head, en < length(text) AS truncated_tail FROM windowed)
"""


@check(
    "search_snippets",
    f"""{_FLAGSHIP_ALL},
    page AS (SELECT asset_id FROM candidates ORDER BY tier, n_terms DESC, best_rank NULLS LAST, asset_id LIMIT 30),
    best AS (
      SELECT query_id, asset_id, segment_id, rank, row_number() OVER (PARTITION BY asset_id ORDER BY rank NULLS LAST, segment_id) AS n
      FROM (SELECT query_id, asset_id, segment_id, round(min(rank), 9) AS rank
            FROM (SELECT * FROM ranked UNION ALL SELECT *, NULL FROM short_hits) GROUP BY ALL) JOIN page USING (asset_id)),
    shown_rows AS (
      SELECT b.*, s.text, CASE WHEN rank IS NULL THEN ['en', 'ch'] ELSE ['src1_EN', 'the', 'entre', 'en', 'ch'] END AS shown
      FROM best b JOIN segments s USING (segment_id) WHERE n <= 3),
    {_SNIPPETS}
    SELECT query_id, asset_id, segment_id, CAST(n AS INTEGER) AS n, snippet, truncated_head, truncated_tail,
           '[' || array_to_string(list_transform(h, lambda x: '{{"start":' || x.s || ',"end":' || x.e || '}}'), ',') || ']' AS highlights
    FROM snippets""",
)
def search_snippets(spark, sf_dir):
    """Snippets of the first page; ranks are rounded, as the last digits of a sum depend on its order."""
    found = a.catalogue(spark, sf_dir)
    result = search(found, one_query(spark, FLAGSHIP))
    result = replace(
        result,
        candidates=result.candidates.withColumn("best_rank", _six("best_rank")),
        segment_hits=result.segment_hits.withColumn("rank", F.round("rank", 9)),
    )
    rows = page_snippets(found, result, per_asset=3)
    return rows.select(
        "query_id",
        "asset_id",
        "segment_id",
        "n",
        "snippet",
        F.to_json("highlights").alias("highlights"),
        "truncated_head",
        "truncated_tail",
    )


@check(
    "snippet_pieces",
    f"""WITH {a.SEGMENTS_SQL},
    shown_rows AS (SELECT segment_id, text, ['entre', 'tion', 'the', 'Ent'] AS shown FROM segments),
    {_SNIPPETS}
    SELECT segment_id, array_to_string(list_transform(h, lambda x, i:
             substr(snippet, CASE WHEN i = 1 THEN 0 ELSE h[i - 1].e END + 1, x.s - CASE WHEN i = 1 THEN 0 ELSE h[i - 1].e END)
             || '[' || substr(snippet, x.s + 1, x.e - x.s) || ']'), '')
           || substr(snippet, CASE WHEN len(h) = 0 THEN 0 ELSE h[len(h)].e END + 1) AS pieces
    FROM snippets""",
)
def snippet_pieces(spark, sf_dir):
    """The snippet of every segment for four overlapping terms, cut into pieces for display."""
    terms = F.array(*[F.lit(t) for t in ("entre", "tion", "the", "Ent")])
    rows = with_snippet(a.segments(spark, sf_dir).select("segment_id", "text", terms.alias("shown")), "text", "shown")
    pieces = F.transform(
        highlight_pieces(F.col("snippet"), F.col("highlights")),
        lambda p: F.when(p["hit"], F.concat(F.lit("["), p["text"], F.lit("]"))).otherwise(p["text"]),
    )
    return rows.select("segment_id", F.array_join(pieces, "").alias("pieces"))


@check(
    "first_segments",
    f"""WITH {a.SEGMENTS_SQL}
    SELECT asset_id, segment_id, CAST(row_number() OVER (PARTITION BY asset_id ORDER BY ordinal) AS INTEGER) AS n FROM segments
    QUALIFY n <= 5""",
)
def first_segments(spark, sf_dir):
    """Segments without a rank come in reading order: the first five of every asset."""
    every = a.segments(spark, sf_dir).select(
        F.lit(0).alias("query_id"), "asset_id", "segment_id", F.lit(None).cast("double").alias("rank")
    )
    return top_segments(every, 5).select("asset_id", "segment_id", "n")


@check(
    "recall_eval",
    rf"""WITH {a.SEGMENTS_SQL}, {a.QUERIES_SQL},
    wanted AS (SELECT DISTINCT folded FROM terms),
    truth AS (SELECT folded, segment_id FROM wanted JOIN segments ON contains(lower(text), folded)),
    tokens AS (
      SELECT DISTINCT segment_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS token FROM segments),
    by_word AS (SELECT folded, segment_id FROM wanted JOIN tokens ON token = folded),
    bigrams AS (
      SELECT DISTINCT segment_id, substr(lower(text), p, 2) AS token
      FROM (SELECT segment_id, text, unnest(generate_series(1, length(text) - 1)) AS p FROM segments)),
    asked AS (
      SELECT DISTINCT folded, substr(folded, p, 2) AS token
      FROM (SELECT folded, unnest(generate_series(1, length(folded) - 1)) AS p FROM wanted)),
    by_bigram AS (
      SELECT folded, segment_id FROM (SELECT *, count(*) OVER (PARTITION BY folded) AS needed FROM asked) JOIN bigrams USING (token)
      GROUP BY folded, segment_id, needed HAVING count(*) = needed),
    methods AS (SELECT 'index' AS method, * FROM truth WHERE length(folded) >= 3 UNION ALL SELECT 'word', * FROM by_word UNION ALL SELECT 'bigram', * FROM by_bigram)
    SELECT m.method, w.folded, coalesce(e.expected, 0) AS expected, coalesce(r.returned, 0) AS returned, coalesce(h.hit, 0) AS hit,
           round(CASE WHEN e.expected IS NULL THEN 1.0 ELSE coalesce(h.hit, 0) / e.expected END, 6)::DOUBLE AS recall
    FROM wanted w CROSS JOIN (VALUES ('index'), ('word'), ('bigram')) m(method)
    LEFT JOIN (SELECT folded, count(*) AS expected FROM truth GROUP BY 1) e ON e.folded = w.folded
    LEFT JOIN (SELECT method, folded, count(*) AS returned FROM methods GROUP BY ALL) r ON r.folded = w.folded AND r.method = m.method
    LEFT JOIN (SELECT method, folded, count(*) AS hit FROM methods JOIN truth USING (folded, segment_id) GROUP BY ALL) h
      ON h.folded = w.folded AND h.method = m.method""",
)
def recall_eval_query(spark, sf_dir):
    """How much of the substring truth each way of cutting text finds."""
    segments = a.segments(spark, sf_dir)
    wanted = _batch_terms(spark, sf_dir).of_labels()
    truth = match_terms(segments.select("segment_id", "text"), "text", "segment_id", wanted, F.lower)
    distinct = wanted.distinct()
    methods = {
        "index": term_hits(segments, wanted, gram_blocks(segments)),
        "word": quality.token_hits(segments, distinct, quality.words),
        "bigram": quality.token_hits(segments, distinct, quality.runs_of(2)),
    }
    return quality.recall_eval(truth, methods, distinct).withColumn("recall", F.round("recall", 6))
