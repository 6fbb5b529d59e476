"""The registered query of every operator, and its SQL where SQL can express it."""

from __future__ import annotations

import os
from functools import lru_cache

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import codes, decontamination, exact, grid_join, lines, mixing, near_dedup, personal, prefix_trie, quality
from . import substrings, tokens, toxicity


@lru_cache(maxsize=256)
def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    return os.path.abspath(public_tokenizers.path("byte_bpe_50k.json"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents"))


OP8_SQL = """
WITH rows AS (
  SELECT doc_id, length(coalesce(text, '')) AS size,
         regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS bare
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY bare ORDER BY size DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY bare) AS group_size,
       first_value(doc_id) OVER (PARTITION BY bare ORDER BY size DESC, doc_id) = doc_id AS kept,
       sha256(bare) AS text_sha256
FROM rows
"""


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select(
        "doc_id",
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        F.col("mix_taken").alias("taken"),
    )


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = tokens.token_files(table(spark, sf_dir, "documents"), vocabulary())
    return read.select("doc_id", "start", "n_tokens", "ids_crc32")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    ).drop("items", "key")


_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1_SQL = f"""
WITH item_words AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, regexp_extract_all({_LOWERED}, '{_WORD}') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i:i + 9], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item_words WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM windows),
doc_words AS (SELECT doc_id, regexp_extract_all({_LOWERED}, '{_WORD}') AS w FROM documents),
places AS (
  SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS win
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM doc_words, sizes WHERE len(w) >= size)),
hits AS (SELECT doc_id, i, size, item_id FROM places JOIN windows USING (size, win)),
covered AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit
  FROM (SELECT DISTINCT doc_id, unnest(range(i, i + size)) AS place FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def toxicity_machine(spark: SparkSession, sf_dir: str) -> toxicity.Machine | None:
    """Fitted on the labels outside the held-out third."""
    labels = table(spark, sf_dir, "labels").where(toxicity.fold(F.col("doc_id"), 3) != 1)
    return toxicity.train(table(spark, sf_dir, "documents"), labels)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rated = toxicity.toxicity(docs, toxicity_machine(spark, sf_dir))
    held_out = toxicity.fold(F.col("doc_id"), 3) == 1
    return rated.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


OP4_SQL = r"""
WITH RECURSIVE doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM doc_words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * shared.n >= 80 * (x.n + y.n - shared.n)),
two_way AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM two_way UNION SELECT reach.a, two_way.b FROM reach JOIN two_way ON reach.b = two_way.a),
least AS (SELECT a AS doc_id, min(b) AS b FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(b, d.doc_id)) AS component_id,
       d.doc_id <= coalesce(b, d.doc_id) AS kept
FROM doc_words d LEFT JOIN sizes USING (doc_id) LEFT JOIN least USING (doc_id)
"""


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.personal_data(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_dedup(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH texts AS (
  SELECT doc_id, text, string_split_regex(coalesce(text, ''), '\r\n|\r|\n') AS ls FROM documents),
all_lines AS (
  SELECT doc_id, line, place,
         list_transform(list_filter(string_split_regex(line, '[\x20\x09\x0b\x0c]+'), lambda t: t <> ''),
                        lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) AS tokens
  FROM (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS place FROM texts)),
held AS (SELECT DISTINCT doc_id, tokens, len(tokens) AS n, tokens[1:3] AS lead FROM all_lines WHERE len(tokens) > 0),
support AS (
  SELECT n, lead, place, token, count(DISTINCT doc_id) AS seen
  FROM (SELECT *, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS place FROM held) GROUP BY ALL),
fields AS (
  SELECT tokens, n, lead, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS place
  FROM (SELECT DISTINCT tokens, n, lead FROM held)),
kept AS (
  SELECT tokens, n, lead,
         list(CASE WHEN seen >= 10 THEN token ELSE '<*>' END ORDER BY place) AS template,
         avg(CASE WHEN seen >= 10 AND token <> '<*>' THEN 1 ELSE 0 END) AS share
  FROM fields JOIN support USING (n, lead, place, token) GROUP BY tokens, n, lead),
templates AS (
  SELECT n, lead, template FROM kept JOIN held USING (tokens, n, lead) WHERE share >= 0.8
  GROUP BY ALL HAVING count(DISTINCT doc_id) >= 10),
gone AS (SELECT tokens FROM kept JOIN templates USING (n, lead, template) WHERE share >= 0.8),
judged AS (
  SELECT l.*, g.tokens IS NOT NULL AS dropped FROM all_lines l LEFT JOIN gone g ON l.tokens = g.tokens),
joined AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
         coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT dropped), '') AS rest
  FROM judged GROUP BY doc_id)
SELECT doc_id, n_lines, n_dropped, CASE WHEN n_dropped > 0 THEN rest ELSE text END AS text
FROM texts JOIN joined USING (doc_id)
"""


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.substring_dedup(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = toxicity.fold(F.col("doc_id"), 5)
    classifier = quality.train(docs, table(spark, sf_dir, "labels").where(fold != 0))
    rated = quality.quality(docs, classifier)
    return rated.select("doc_id", (fold == 0).alias("held_out"), "score", "predicted")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.vector_codes(table(spark, sf_dir, "embeddings"))


_ROUND = """
near{r} AS MATERIALIZED (
  SELECT pos, part, n, arg_min(e, (d, e)) AS e, min(d) AS d
  FROM (SELECT p.pos, p.part, p.n, b.e,
               list_sum(list_transform(list_zip(p.part, b.entry), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
        FROM parts p JOIN book{r} b USING (pos))
  GROUP BY pos, part, n)"""

_MOVE = """
means{r} AS (
  SELECT pos, e, list(m ORDER BY place) AS entry
  FROM (SELECT pos, e, place, ((sum(n * x) - (sum(n * x) % sum(n) + sum(n)) % sum(n)) // sum(n))::BIGINT AS m
        FROM (SELECT pos, e, n, unnest(part) AS x, generate_subscripts(part, 1) AS place FROM near{r})
        GROUP BY pos, e, place)
  GROUP BY pos, e),
book{s} AS MATERIALIZED (
  SELECT b.pos, b.e, coalesce(m.entry, b.entry) AS entry FROM book{r} b LEFT JOIN means{r} m USING (pos, e))"""

OP11_SQL = (
    """
WITH whole AS (
  SELECT row_number() OVER () AS id, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
sized AS (
  SELECT * FROM whole WHERE len(v) = (
    SELECT len(v) FROM whole WHERE len(v) > 0 AND len(v) % 8 = 0 ORDER BY vec_id NULLS LAST, v LIMIT 1)),
cut AS MATERIALIZED (
  SELECT id, pos, v[pos * (len(v) // 8) + 1:(pos + 1) * (len(v) // 8)] AS part
  FROM sized, (SELECT unnest(range(8)) AS pos)),
parts AS MATERIALIZED (SELECT pos, part, count(*) AS n FROM cut GROUP BY ALL),
first AS (SELECT id, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS e FROM sized),
book0 AS MATERIALIZED (SELECT pos, e, part AS entry FROM first JOIN cut USING (id) WHERE e < 16),"""
    + ",".join(_ROUND.format(r=r) + "," + _MOVE.format(r=r, s=r + 1) for r in range(6))
    + ","
    + _ROUND.format(r=6)
    + """,
coded AS (
  SELECT id, string_agg(lpad(to_hex(e), 2, '0'), '' ORDER BY pos) AS code, sum(d)::BIGINT AS error
  FROM cut JOIN near6 USING (pos, part) GROUP BY id)
SELECT vec_id, lower(code) AS code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(entry, ','), ',' ORDER BY pos, e)) FROM book6) AS codebooks_sha256
FROM sized JOIN coded USING (id)
"""
)


def op12_vector_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid_join.vector_duplicates(table(spark, sf_dir, "embeddings"))


OP12_SQL = """
WITH RECURSIVE whole AS (
  SELECT row_number() OVER () AS id, vec_id, embedding::DOUBLE[] AS v,
         embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
         AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS fit
  FROM embeddings),
links AS MATERIALIZED (
  SELECT a.id AS a, b.id AS b, b.vec_id FROM whole a JOIN whole b ON a.id <> b.id AND len(a.v) = len(b.v)
  WHERE a.fit AND b.fit AND list_cosine_similarity(a.v, b.v) >= 0.9),
reach(a, b) AS (
  SELECT id, id FROM whole UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT a AS id, min(vec_id) AS component_id FROM reach JOIN whole ON whole.id = b GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = whole.id) AS n_links, component_id,
       vec_id IS NOT DISTINCT FROM component_id AS kept
FROM whole JOIN least USING (id)
"""


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


OP13_SQL = """
WITH turns AS MATERIALIZED (
  SELECT conv_id, digest, size, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS place
  FROM (SELECT conv_id, turn, strlen(coalesce(text, '')) AS size,
               md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest
        FROM conversations WHERE conv_id IS NOT NULL)),
convs AS MATERIALIZED (
  SELECT conv_id, conv_id - conv_id % 5 AS base,
         xor(list_reduce([4294967295] || list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ord(s)::BIGINT),
           lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0],
             lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)), 4294967295) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM turns)),
rebuilt AS (
  SELECT conv_id, digest, size, row_number() OVER (PARTITION BY conv_id ORDER BY own, place) AS d
  FROM (SELECT c.conv_id, digest, size, 0 AS own, place FROM convs c JOIN turns t ON t.conv_id = base AND place <= h
        UNION ALL
        SELECT c.conv_id, digest, size, 1 AS own, place FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND place > h)),
prefixes AS MATERIALIZED (
  SELECT conv_id, d, size, string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY d) AS k FROM rebuilt
  UNION ALL SELECT conv_id, 0, 0, '' FROM convs),
lengths AS (SELECT conv_id, max(d) AS d FROM prefixes GROUP BY conv_id),
ends AS (
  SELECT k, string_agg(conv_id, ',' ORDER BY conv_id) AS ids FROM prefixes JOIN lengths USING (conv_id, d) GROUP BY k),
nodes AS MATERIALIZED (
  SELECT d, k, min(conv_id) AS conv_id, count(*) AS n, (count(*) - 1) * max(size) AS saved FROM prefixes GROUP BY d, k),
parents AS MATERIALIZED (
  SELECT n.k, p.k AS parent FROM nodes n JOIN prefixes p ON p.conv_id = n.conv_id AND p.d = n.d - 1),
children AS (SELECT parent AS k, count(*) AS n_children FROM parents GROUP BY parent),
subtrees AS (
  SELECT p.k, sum(n.saved) AS saved, count(*) FILTER (WHERE n_children IS NULL) AS leaves
  FROM nodes n LEFT JOIN children c USING (k) JOIN prefixes p ON p.conv_id = n.conv_id AND p.d <= n.d
  GROUP BY p.k)
SELECT n.conv_id, n.d::BIGINT AS depth, up.conv_id AS parent_conv_id, n.n AS n_convs,
       coalesce(n_children, 0) AS n_children, s.leaves AS n_leaves, s.saved::BIGINT AS saved_tokens,
       sha256(coalesce(ids, '')) AS ends_sha256
FROM nodes n JOIN subtrees s USING (k) LEFT JOIN children USING (k) LEFT JOIN ends USING (k)
     LEFT JOIN parents p USING (k) LEFT JOIN nodes up ON up.k = p.parent
"""


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_toxicity": op2_toxicity,
    "op3_mixing": op3_mixing,
    "op4_near_dedup": op4_near_dedup,
    "op5_token_files": op5_token_files,
    "op6_personal_data": op6_personal_data,
    "op7_line_dedup": op7_line_dedup,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_quality": op10_quality,
    "op11_vector_codes": op11_vector_codes,
    "op12_vector_duplicates": op12_vector_duplicates,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLES = {
    "op1_decontamination": OP1_SQL,
    "op4_near_dedup": OP4_SQL,
    "op7_line_dedup": OP7_SQL,
    "op8_exact_dedup": OP8_SQL,
    "op11_vector_codes": OP11_SQL,
    "op12_vector_duplicates": OP12_SQL,
    "op13_prefix_trie": OP13_SQL,
}


def queries() -> dict:
    return dict(QUERIES)


def oracles() -> dict:
    return dict(ORACLES)
