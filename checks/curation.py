"""Keywords, tags, statuses, results and quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuesift.functions.formats import engine_label, minute_stamp
from cuesift.functions.tagnames import tag_key
from cuesift.operators import quality, tagging
from cuesift.operators.catalogue import tags_by_asset
from cuesift.operators.keywords import (
    LETTERS,
    drop_fragments,
    eligible_words,
    frequent_words,
    ngram_stats,
    suggest_keywords,
)
from cuesift.operators.results import current_results, last_failures, mark_current, save_results
from cuesift.operators.status import active_conflicts, derive_status, status_drift, sync_status
from cuesift.operators.transform import prompt_gate, prompts, text_parts, transform_texts

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


_NGRAMS = rf"""
places AS (
  SELECT asset_id, ordinal, text, unnest(generate_series(1, length(text))) AS p FROM segments),
ngrams AS (
  SELECT asset_id, substr(text, p, size) AS word, ordinal::BIGINT * 16777216 + p AS seen,
         CASE WHEN p > 1 AND regexp_matches(substr(text, p - 1, 1), '\p{{L}}') THEN substr(text, p - 1, 1) END AS before,
         CASE WHEN regexp_matches(substr(text, p + size, 1), '\p{{L}}') THEN substr(text, p + size, 1) END AS after
  FROM (SELECT *, unnest([2, 3, 4]) AS size FROM places) WHERE regexp_full_match(substr(text, p, size), '\p{{L}}+') AND length(substr(text, p, size)) = size),
stats AS (
  SELECT asset_id, word, count(*) AS frequency, count(DISTINCT before) >= 2 AS left_varied,
         count(DISTINCT after) >= 2 AS right_varied, min(seen) AS first_seen
  FROM ngrams GROUP BY ALL),
eligible AS (
  SELECT asset_id, word, frequency, first_seen FROM stats
  WHERE frequency >= 3 AND left_varied AND right_varied AND word <> repeat(substr(word, 1, 1), length(word))),
pieces AS (
  SELECT DISTINCT asset_id, word AS longer, frequency, substr(word, p, size) AS word
  FROM (SELECT *, unnest(generate_series(1, length(word))) AS p FROM eligible), (VALUES (2), (3)) s(size)
  WHERE size < length(word) AND p + size - 1 <= length(word)),
whole AS (
  SELECT e.* FROM eligible e WHERE NOT EXISTS (
    SELECT 1 FROM pieces p WHERE p.asset_id = e.asset_id AND p.word = e.word AND p.frequency >= e.frequency * 0.8))
"""
_WORDS = f"WITH {a.SEGMENTS_SQL}, {_NGRAMS}"


@check(
    "ngram_stats",
    f"{_WORDS} SELECT asset_id, word, frequency, left_varied, right_varied FROM stats",
)
def ngram_stats_query(spark, sf_dir):
    """Every word of every asset, with its neighbours judged."""
    return ngram_stats(a.segments(spark, sf_dir), LETTERS).drop("first_seen")


@check("keyword_fragments_removed", f"{_WORDS} SELECT asset_id, word, frequency FROM whole")
def keyword_fragments_removed(spark, sf_dir):
    words = eligible_words(frequent_words(a.segments(spark, sf_dir), LETTERS))
    return drop_fragments(words).drop("first_seen")


@check(
    "suggest_keywords",
    f"""WITH {a.SEGMENTS_SQL}, {a.TAGS_SQL}, {_NGRAMS},
    lists AS (SELECT asset_id, list({{'w': word, 'f': frequency}} ORDER BY frequency DESC, length(word) DESC, first_seen) AS l FROM whole GROUP BY 1),
    picked AS (
      SELECT asset_id, list_reduce(
        list_transform(l, lambda x: [x]),
        lambda acc, x: CASE WHEN len(acc) >= 12 OR len(list_filter(acc, lambda y: contains(y.w, x[1].w) OR contains(x[1].w, y.w))) > 0
                            THEN acc ELSE list_concat(acc, x) END) AS l FROM lists),
    flat AS (SELECT asset_id, unnest(l) AS k, generate_subscripts(l, 1) - 1 AS position FROM picked)
    SELECT asset_id, CAST(position AS INTEGER) AS position, k.w AS word, k.f AS frequency FROM flat
    WHERE NOT EXISTS (SELECT 1 FROM tag_links t WHERE t.asset_id = flat.asset_id AND t.name = flat.k.w)""",
)
def suggest_keywords_query(spark, sf_dir):
    return suggest_keywords(
        a.segments(spark, sf_dir), a.asset_tags(spark, sf_dir), a.tags(spark, sf_dir), chars=LETTERS
    )


@check("tag_usage", f"WITH {a.TAGS_SQL} SELECT t.tag_id, name, count(asset_id) AS usage_count FROM tags t LEFT JOIN asset_tags USING (tag_id) GROUP BY ALL")
def tag_usage(spark, sf_dir):
    used = tagging.tag_usage(a.tags(spark, sf_dir), a.asset_tags(spark, sf_dir))
    return used.select("tag_id", "name", "usage_count")


@check("orphan_tags", f"WITH {a.TAGS_SQL} SELECT tag_id, name FROM tags WHERE tag_id NOT IN (SELECT tag_id FROM asset_tags)")
def orphan_tags(spark, sf_dir):
    return tagging.orphan_tags(a.tags(spark, sf_dir), a.asset_tags(spark, sf_dir)).select("tag_id", "name")


@check("prune_orphan_tags", f"WITH {a.TAGS_SQL} SELECT tag_id, name FROM tags WHERE tag_id IN (SELECT tag_id FROM asset_tags)")
def prune_orphan_tags(spark, sf_dir):
    return tagging.prune_orphan_tags(a.tags(spark, sf_dir), a.asset_tags(spark, sf_dir)).select("tag_id", "name")


@check(
    "asset_tags_grouped",
    f"WITH {a.TAGS_SQL} SELECT asset_id, string_agg(name || '#' || tag_id, ',' ORDER BY name) AS tags FROM asset_tags JOIN tags USING (tag_id) GROUP BY 1",
)
def asset_tags_grouped(spark, sf_dir):
    grouped = tags_by_asset(a.asset_tags(spark, sf_dir), a.tags(spark, sf_dir))
    text = F.transform("tags", lambda t: F.concat_ws("#", t["name"], t["tag_id"].cast("string")))
    return grouped.select("asset_id", F.array_join(text, ",").alias("tags"))


@check(
    "unlink_tags",
    f"""WITH {a.TAGS_SQL} SELECT asset_id, tag_id FROM asset_tags
    WHERE NOT (asset_id IN (SELECT doc_id FROM labels) AND tag_id IN (SELECT tag_id FROM tags WHERE name IN ('en', 'toxic 1')))""",
)
def unlink_tags(spark, sf_dir):
    labelled = a.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("asset_id"))
    removals = labelled.select(
        "asset_id", F.explode(F.array(a.text_id(F.lit("en")), a.text_id(F.lit("toxic 1")))).alias("tag_id")
    )
    return tagging.unlink_tags(a.asset_tags(spark, sf_dir), removals)


# requested names: part names in spellings that share a key
_ASKED_SQL = f"""
asked AS (
  SELECT p_partkey AS request_id, CAST(p_size AS BIGINT) AS asset_id, p_type AS color,
         CASE WHEN p_type = 'ECONOMY' THEN ' ' || upper(p_name) || '  '
              WHEN p_type = 'SMALL' THEN replace(p_name, ' ', '   ')
              WHEN p_type = 'LARGE' THEN '   ' WHEN p_type = 'MEDIUM' THEN repeat(p_name, 9) ELSE p_name END AS name
  FROM part),
shown AS (
  SELECT *, CASE WHEN length(d) BETWEEN 1 AND 50 THEN d END AS display, lower(d) AS k
  FROM (SELECT *, {a.trim_sql(f"regexp_replace(name, '{a.WS}+', ' ', 'g')")} AS d FROM asked))
"""


def _asked(spark, sf_dir):
    kind = F.col("p_type")
    name = (
        F.when(kind == "ECONOMY", F.concat(F.lit(" "), F.upper("p_name"), F.lit("  ")))
        .when(kind == "SMALL", F.replace("p_name", F.lit(" "), F.lit("   ")))
        .when(kind == "LARGE", F.lit("   "))
        .when(kind == "MEDIUM", F.repeat("p_name", 9))
        .otherwise(F.col("p_name"))
    )
    return a.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("request_id"),
        F.col("p_size").cast("long").alias("asset_id"),
        name.alias("name"),
        kind.alias("color"),
        F.lit("manual").alias("source"),
        F.lit(0).cast("long").alias("created_at"),
    )


@check(
    "tag_dictionary",
    f"""WITH {_ASKED_SQL}
    SELECT k AS name_key, arg_min(display, request_id) AS name, arg_min(color, request_id) AS color
    FROM shown WHERE display IS NOT NULL GROUP BY 1""",
)
def tag_dictionary(spark, sf_dir):
    return tagging.tag_dictionary(_asked(spark, sf_dir)).drop("created_at")


_WIDE = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
# the same letters in their wide forms
_WIDER = "".join(chr(ord(c) + 0xFEE0) for c in _WIDE)


@check(
    "tag_keys_normalised",
    f"""SELECT p_partkey, lower({a.trim_sql(f"regexp_replace(p_name || ' fi', '{a.WS}+', ' ', 'g')")}) AS tag_key FROM part""",
)
def tag_keys_normalised(spark, sf_dir):
    """Names in wide letters, with a ligature, share the key of their plain spelling."""
    wide = F.concat(F.translate("p_name", _WIDE, _WIDER), F.lit("\u3000\ufb01"))
    return a.table(spark, sf_dir, "part").select("p_partkey", tag_key(wide).alias("tag_key"))


@check(
    "engine_labels",
    """SELECT event_id, 'parser-' || (user_id % 3) || '+' || event_type AS label FROM events""",
)
def engine_labels(spark, sf_dir):
    base = F.concat(F.lit("parser-"), (F.col("user_id") % 3).cast("string"))
    return a.table(spark, sf_dir, "events").select("event_id", engine_label(base, F.col("event_type")).alias("label"))


@check(
    "minute_stamps",
    """SELECT event_id, CASE WHEN event_type = 'error' THEN '—' ELSE strftime(make_timestamp(user_id * 86399000000 + event_id * 1000000), '%Y-%m-%d %H:%M') END AS stamp
    FROM events""",
)
def minute_stamps(spark, sf_dir):
    """Times as shown to people, in the zone of the session; the test tables' is UTC."""
    ms = F.col("user_id") * 86_399_000 + F.col("event_id") * 1000
    ms = F.when(F.col("event_type") != "error", ms)
    return a.table(spark, sf_dir, "events").select("event_id", minute_stamp(ms).alias("stamp"))


# tags that exist beforehand, and links that do
_BEFORE_SQL = """
old_tags AS (SELECT n_nationkey AS tag_id, name, name AS name_key, 'old' AS color
  FROM nation JOIN (SELECT p_name AS name, row_number() OVER (ORDER BY p_name) - 1 AS n FROM (SELECT DISTINCT p_name FROM part)) ON n = n_nationkey),
old_links AS (SELECT DISTINCT CAST(p_size AS BIGINT) AS asset_id, tag_id FROM part JOIN old_tags ON p_name = name WHERE p_brand < 'Brand#15'),
known_assets AS (SELECT DISTINCT CAST(p_size AS BIGINT) AS asset_id FROM part WHERE p_size < 45),
valid AS (SELECT s.*, coalesce(o.tag_id, -1) AS old_tag FROM shown s JOIN known_assets USING (asset_id) LEFT JOIN old_tags o ON o.name_key = s.k WHERE display IS NOT NULL),
verdicts AS (
  SELECT v.*, l.asset_id IS NOT NULL OR request_id <> min(request_id) OVER (PARTITION BY v.asset_id, k) AS already,
         old_tag = -1 AND request_id = min(request_id) OVER (PARTITION BY k) AS created
  FROM valid v LEFT JOIN old_links l ON l.asset_id = v.asset_id AND l.tag_id = v.old_tag)
"""


def _before(spark, sf_dir):
    from pyspark.sql import Window

    part = a.table(spark, sf_dir, "part")
    names = part.select(F.col("p_name").alias("name")).distinct()
    # the number of distinct part names is fixed, whatever the size of the table
    numbered = names.withColumn("n", F.row_number().over(Window.orderBy("name")) - 1)
    nation = a.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("tag_id"))
    tags = numbered.join(nation, F.col("n") == F.col("tag_id")).select(
        "tag_id", "name", F.col("name").alias("name_key"), F.lit("old").alias("color")
    )
    links = (
        part.where("p_brand < 'Brand#15'")
        .join(tags, F.col("p_name") == F.col("name"))
        .select(F.col("p_size").cast("long").alias("asset_id"), "tag_id")
        .distinct()
    )
    assets = part.where("p_size < 45").select(F.col("p_size").cast("long").alias("asset_id")).distinct()
    return assets, tags, links


@check(
    "link_tags",
    f"""WITH {_ASKED_SQL}, {_BEFORE_SQL}
    SELECT s.request_id, CASE WHEN s.display IS NULL THEN 'TAG_NAME_INVALID' WHEN s.asset_id NOT IN (SELECT asset_id FROM known_assets) THEN 'ASSET_NOT_FOUND' END AS error_code,
           v.already AS already_linked, v.created AS tag_created
    FROM shown s LEFT JOIN verdicts v USING (request_id)""",
)
def link_tags(spark, sf_dir):
    outcome = tagging.link_tags(*_before(spark, sf_dir), _asked(spark, sf_dir))
    return outcome.requests.select("request_id", "error_code", "already_linked", "tag_created")


@check(
    "link_tags_added",
    f"""WITH {_ASKED_SQL}, {_BEFORE_SQL}
    SELECT 'tag' AS kind, k AS name, arg_min(color, request_id) AS color, NULL AS asset_id FROM valid WHERE old_tag = -1 GROUP BY k
    UNION ALL
    SELECT 'link', k, NULL, asset_id FROM verdicts GROUP BY k, asset_id HAVING NOT bool_and(already)""",
)
def link_tags_added(spark, sf_dir):
    """Rows the two tables gain."""
    assets, tags, links = _before(spark, sf_dir)
    outcome = tagging.link_tags(assets, tags, links, _asked(spark, sf_dir))
    keys = outcome.new_tags.select("tag_id", "name_key").unionByName(tags.select("tag_id", "name_key"))
    added = outcome.new_links.join(keys, "tag_id").select(
        F.lit("link").alias("kind"), F.col("name_key").alias("name"), F.lit(None).cast("string").alias("color"), "asset_id"
    )
    return outcome.new_tags.select(
        F.lit("tag").alias("kind"), F.col("name_key").alias("name"), "color", F.lit(None).cast("long").alias("asset_id")
    ).unionByName(added)


@check(
    "archive_buckets",
    f"""WITH {_ASKED_SQL}, {_BEFORE_SQL},
    batch AS (SELECT * FROM shown WHERE display IS NULL
              UNION ALL SELECT * FROM shown WHERE display IS NOT NULL
              QUALIFY row_number() OVER (PARTITION BY asset_id, display ORDER BY request_id) = 1),
    judged AS (
      SELECT b.request_id, CASE WHEN display IS NULL THEN 'invalid' WHEN b.asset_id NOT IN (SELECT asset_id FROM known_assets) THEN 'missing' END AS bad,
             b.asset_id, b.k, o.tag_id
      FROM batch b LEFT JOIN old_tags o ON o.name_key = b.k)
    SELECT j.request_id, coalesce(bad, CASE WHEN l.asset_id IS NOT NULL
        OR j.request_id <> min(j.request_id) OVER (PARTITION BY j.asset_id, j.k, bad IS NULL) THEN 'already' ELSE 'linked' END) AS bucket
    FROM judged j LEFT JOIN old_links l ON l.asset_id = j.asset_id AND l.tag_id = j.tag_id""",
)
def archive_buckets(spark, sf_dir):
    batch = _asked(spark, sf_dir).drop("color", "source")
    outcome = tagging.archive_keywords(*_before(spark, sf_dir), batch)
    return outcome.requests.select("request_id", "bucket")


_TEXTS_SQL = """
sizes AS (SELECT asset_id, sum(length(text)) + count(*) - 1 AS input_chars FROM segments GROUP BY 1),
texts AS (SELECT asset_id, string_agg(text, chr(10) ORDER BY ordinal) AS text FROM segments GROUP BY 1)
"""


@check(
    "asset_full_text",
    f"""WITH {a.SEGMENTS_SQL} SELECT asset_id, CAST(ordinal // 500 AS BIGINT) AS part, string_agg(text, chr(10) ORDER BY ordinal) AS text
    FROM segments GROUP BY ALL""",
)
def asset_full_text(spark, sf_dir):
    return text_parts(a.segments(spark, sf_dir))


def _wanted(spark, sf_dir):
    # parts beyond the documents stand for assets that do not exist
    return a.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("asset_id"))


@check(
    "prompt_gate",
    f"""WITH {a.SEGMENTS_SQL}, {a.ASSETS_SQL}, {_TEXTS_SQL}
    SELECT p_partkey AS asset_id, coalesce(input_chars, 0)::BIGINT AS input_chars,
           CASE WHEN file_name IS NULL THEN 'ASSET_NOT_FOUND' WHEN input_chars IS NULL THEN 'EXTRACTION_NO_CONTENT'
                WHEN input_chars > 120000 THEN 'POLISH_INPUT_TOO_LARGE' END AS gate_reason
    FROM part LEFT JOIN assets ON asset_id = p_partkey LEFT JOIN sizes USING (asset_id)""",
)
def prompt_gate_query(spark, sf_dir):
    gate = prompt_gate(a.assets(spark, sf_dir), a.segments(spark, sf_dir), _wanted(spark, sf_dir))
    return gate.select("asset_id", "input_chars", "gate_reason")


_PROMPTS_SQL = f"""
prompts AS (
  SELECT asset_id, '素材：' || file_name || chr(10) || chr(10) || '以下是这个素材里提取出的文字：' || chr(10) || chr(10) || text AS prompt
  FROM assets JOIN texts USING (asset_id) JOIN sizes USING (asset_id) JOIN part ON p_partkey = asset_id WHERE input_chars <= 120000)
"""


@check("prompt_batch", f"WITH {a.SEGMENTS_SQL}, {a.ASSETS_SQL}, {_TEXTS_SQL}, {_PROMPTS_SQL} SELECT asset_id, prompt FROM prompts")
def prompt_batch(spark, sf_dir):
    ready = prompts(a.assets(spark, sf_dir), a.segments(spark, sf_dir), _wanted(spark, sf_dir))
    return ready.select("asset_id", "prompt")


@check(
    "transform_texts",
    f"""WITH {a.SEGMENTS_SQL}, {a.ASSETS_SQL}, {_TEXTS_SQL}, {_PROMPTS_SQL}
    SELECT asset_id, CASE WHEN bad IS NULL THEN length(prompt)::VARCHAR ELSE '' END AS body,
           CASE WHEN bad IS NULL THEN 'succeeded' ELSE 'failed' END AS status, bad AS error_code,
           CASE WHEN bad IS NULL THEN length(prompt) END AS input_tokens
    FROM (SELECT *, CASE WHEN length(prompt) > 20000 THEN 'POLISH_INPUT_TOO_LARGE' WHEN contains(prompt, '_es_') OR contains(prompt, '_de_') THEN 'CREDENTIALS_UPSTREAM' END AS bad FROM prompts)""",
)
def transform_texts_query(spark, sf_dir):
    def shorten(prompt: str) -> dict:
        """A stand-in for a text service: counts, refuses, overflows and fails."""
        size = len(prompt)
        if size > 20_000:
            return {"body": prompt, "stop_reason": "max_tokens"}
        if "_es_" in prompt:
            return {"body": "", "stop_reason": "refusal"}
        if "_de_" in prompt:
            raise TimeoutError("no answer")
        return {"body": f" {size} ", "input_tokens": size, "output_tokens": 1}

    ready = prompts(a.assets(spark, sf_dir), a.segments(spark, sf_dir), _wanted(spark, sf_dir))
    done = transform_texts(ready, shorten, model="stand-in")
    return done.select("asset_id", "body", "status", "error_code", "input_tokens")


@check(
    "current_result",
    f"""WITH {a.RESULTS_SQL} SELECT asset_id, result_id, body, model FROM results WHERE status = 'succeeded'
    QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY result_id DESC) = 1""",
)
def current_result(spark, sf_dir):
    return current_results(a.results(spark, sf_dir)).select("asset_id", "result_id", "body", "model")


@check(
    "result_history",
    f"""WITH {a.RESULTS_SQL} SELECT result_id, asset_id, status = 'succeeded' AND result_id = max(result_id) FILTER (WHERE status = 'succeeded') OVER (PARTITION BY asset_id) AS is_current
    FROM results""",
)
def result_history(spark, sf_dir):
    return mark_current(a.results(spark, sf_dir)).select("result_id", "asset_id", "is_current")


@check(
    "save_results",
    f"""WITH {a.RESULTS_SQL},
    kept AS (
      SELECT result_id, asset_id, body, status, created_at FROM results WHERE created_at < 2
      UNION ALL SELECT 1000000000 + asset_id, asset_id, body, status, 99 FROM results WHERE created_at = 2)
    SELECT asset_id, body, created_at::BIGINT AS created_at,
           status = 'succeeded' AND result_id = max(result_id) FILTER (WHERE status = 'succeeded') OVER (PARTITION BY asset_id) AS is_current
    FROM kept""",
)
def save_results_query(spark, sf_dir):
    results = a.results(spark, sf_dir)
    history = results.where(F.col("created_at") < 2)
    new = results.where(F.col("created_at") == 2).drop("result_id", "created_at")
    saved = history.unionByName(save_results(history, new, 99))
    return mark_current(saved).select("asset_id", "body", "created_at", "is_current")


@check(
    "last_failure",
    f"""WITH {a.RESULTS_SQL} SELECT asset_id, coalesce(error_code, 'UNKNOWN') AS error_code, error_message, created_at FROM results WHERE status = 'failed'
    QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY result_id DESC) = 1""",
)
def last_failure(spark, sf_dir):
    return last_failures(a.results(spark, sf_dir))


_STATUS_SQL = f"""{a.JOBS_SQL},
people AS (
  SELECT c_custkey AS asset_id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'running' WHEN c_mktsegment = 'MACHINERY' THEN 'pending' ELSE 'done' END AS extract_status,
         c_nationkey AS extracted_at FROM customer),
derived AS (
  SELECT p.*, CASE WHEN a.s = 'running' THEN 'running' WHEN a.s IS NOT NULL THEN 'pending' WHEN r.s IS NULL THEN 'none'
                   WHEN r.s = 'succeeded' THEN 'done' ELSE 'failed' END AS derived_status
  FROM people p
  LEFT JOIN (SELECT target_id, arg_max(status, job_id) AS s FROM jobs WHERE type = 'extract' AND status IN ('queued', 'running') GROUP BY 1) a ON a.target_id = p.asset_id
  LEFT JOIN (SELECT asset_id, arg_max(status, run_id) AS s FROM runs GROUP BY 1) r ON r.asset_id = p.asset_id)
"""


def _people(spark, sf_dir):
    segment = F.col("c_mktsegment")
    return a.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("asset_id"),
        F.when(segment == "BUILDING", "running").when(segment == "MACHINERY", "pending").otherwise("done").alias("extract_status"),
        F.col("c_nationkey").cast("long").alias("extracted_at"),
    )


@check("derive_status", f"WITH {_STATUS_SQL} SELECT asset_id, derived_status FROM derived")
def derive_status_query(spark, sf_dir):
    derived = derive_status(_people(spark, sf_dir), a.jobs(spark, sf_dir), a.runs(spark, sf_dir))
    return derived.select("asset_id", "derived_status")


@check(
    "status_drift",
    f"WITH {_STATUS_SQL} SELECT asset_id, extract_status, derived_status FROM derived WHERE extract_status IN ('pending', 'running') AND extract_status <> derived_status",
)
def status_drift_query(spark, sf_dir):
    drift = status_drift(_people(spark, sf_dir), a.jobs(spark, sf_dir), a.runs(spark, sf_dir))
    return drift.select("asset_id", "extract_status", "derived_status")


@check(
    "sync_status",
    f"WITH {_STATUS_SQL} SELECT asset_id, derived_status AS extract_status, CAST(CASE WHEN derived_status = 'done' THEN 77 ELSE extracted_at END AS BIGINT) AS extracted_at FROM derived",
)
def sync_status_query(spark, sf_dir):
    return sync_status(_people(spark, sf_dir), a.jobs(spark, sf_dir), a.runs(spark, sf_dir), 77)


@check(
    "active_conflicts",
    f"""WITH {a.JOBS_SQL} SELECT job_id, type, target_id, first_job_id FROM (
      SELECT *, min(job_id) OVER (PARTITION BY type, target_id) AS first_job_id FROM jobs WHERE status IN ('queued', 'running'))
    WHERE job_id <> first_job_id""",
)
def active_conflicts_query(spark, sf_dir):
    return active_conflicts(a.jobs(spark, sf_dir)).select("job_id", "type", "target_id", "first_job_id")


@check(
    "integrity_report",
    """
    SELECT 'lineitem_order' AS check_name, (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders))::BIGINT AS violations
    UNION ALL SELECT 'label_document', (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents))
    UNION ALL SELECT 'event_customer', (SELECT count(*) FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING'))
    UNION ALL SELECT 'part_name', (SELECT count(*) FROM (SELECT p_name FROM part GROUP BY 1 HAVING count(*) > 1))
    UNION ALL SELECT 'lineitem_key', (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1))
    UNION ALL SELECT 'order_status', (SELECT count(*) FROM orders WHERE o_orderstatus NOT IN ('F', 'O'))
    """,
)
def integrity_report(spark, sf_dir):
    t = lambda name: a.table(spark, sf_dir, name)
    some = t("customer").where("c_mktsegment <> 'BUILDING'")
    return quality.integrity_report(
        [
            quality.missing_parents("lineitem_order", t("lineitem"), "l_orderkey", t("orders"), "o_orderkey"),
            quality.missing_parents("label_document", t("labels"), "doc_id", t("documents"), "doc_id"),
            quality.missing_parents("event_customer", t("events"), "user_id", some, "c_custkey"),
            quality.repeated_keys("part_name", t("part"), ["p_name"]),
            quality.repeated_keys("lineitem_key", t("lineitem"), ["l_orderkey", "l_linenumber"]),
            quality.unexpected_values("order_status", t("orders"), "o_orderstatus", ["F", "O"]),
        ]
    )
