"""Sources and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuesift.functions import formats
from cuesift.functions.decode import decode_text
from cuesift.functions.media import media_info
from cuesift.functions.paths import extension, file_kind, file_name, path_key
from cuesift.functions.redact import redact_text, redact_value
from cuesift.functions.formats import convert_script
from cuesift.operators.trigram import gram_blocks, trigram_postings
from cuesift.session import allow_text_decoding, deal
from cuesift.sources.text import segment_texts
from cuesift.sources.transcripts import segment_transcripts

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


@check(
    "classify_kind",
    """
    SELECT page_id, ext,
           CASE ext WHEN '.txt' THEN 'text' WHEN '.mp4' THEN 'video' WHEN '.flac' THEN 'audio' END AS kind
    FROM (SELECT page_id, CASE WHEN url LIKE '%/en/%' THEN '.txt' WHEN url LIKE '%/fr/%' THEN '.mp4'
                               WHEN url LIKE '%/es/%' THEN '.flac' ELSE '.pdf' END AS ext FROM pages)
    """,
)
def classify_kind(spark, sf_dir):
    url = F.col("url")
    suffix = (
        F.when(F.contains(url, F.lit("/en/")), ".TXT")
        .when(F.contains(url, F.lit("/fr/")), ".Mp4")
        .when(F.contains(url, F.lit("/es/")), ".flac")
        .otherwise(".PDF")
    )
    pages = a.table(spark, sf_dir, "pages").select("page_id", F.concat(url, F.lit("x"), suffix).alias("path"))
    ext = extension(F.col("path"))
    return pages.select("page_id", ext.alias("ext"), file_kind(ext).alias("kind"))


@check(
    "kind_totals",
    """
    SELECT coalesce(CASE WHEN url LIKE '%/en/%' THEN 'text' WHEN url LIKE '%/fr/%' THEN 'video'
                         WHEN url LIKE '%/es/%' THEN 'audio' END, 'unsupported') AS kind, count(*) AS files
    FROM pages GROUP BY 1
    """,
)
def kind_totals(spark, sf_dir):
    kinds = classify_kind(spark, sf_dir)
    return kinds.groupBy(F.coalesce("kind", F.lit("unsupported")).alias("kind")).agg(
        F.count(F.lit(1)).alias("files")
    )


@check(
    "path_keys",
    r"""
    SELECT page_id,
           '/media/' || regexp_replace(regexp_replace(replace(url, '://', '/'), '/+$', ''), '/[^/]*$', '/x') AS path_key,
           lower('c:\media\' || replace(regexp_replace(regexp_replace(replace(url, '://', '/'), '/+$', ''), '/[^/]*$', '/x'), '/', '\')) AS drive_key,
           'x' AS file_name
    FROM pages
    """,
)
def path_keys(spark, sf_dir):
    messy = F.concat(F.lit("/media//"), F.replace("url", F.lit("://"), F.lit("/./")), F.lit("/../x/"))
    # a URL that ends in a separator has an empty last segment, which '..' skips
    drive = F.concat(F.lit("C:"), messy)
    pages = a.table(spark, sf_dir, "pages")
    return pages.select(
        "page_id",
        path_key(messy).alias("path_key"),
        path_key(drive, case_insensitive=True).alias("drive_key"),
        file_name(messy).alias("file_name"),
    )


@check("segment_documents", f"WITH {a.SEGMENTS_SQL} SELECT asset_id, segment_id, ordinal, text FROM segments")
def segment_documents(spark, sf_dir):
    return a.segments(spark, sf_dir).select("asset_id", "segment_id", "ordinal", "text")


def _clock(ms, comma=","):
    return F.format_string(
        f"%02d:%02d:%02d{comma}%03d",
        F.floor(ms / 3_600_000).cast("long"),
        F.pmod(F.floor(ms / 60_000).cast("long"), F.lit(60)),
        F.pmod(F.floor(ms / 1_000).cast("long"), F.lit(60)),
        F.pmod(ms, F.lit(1000)),
    )


@check(
    "srt_round_trip",
    """
    SELECT event_id AS asset_id, 0 AS ordinal, event_type || ' happened' AS text,
           event_id * 37 AS start_ms, event_id * 37 + 1500 AS end_ms FROM events
    UNION ALL
    SELECT event_id, 1, 'user ' || user_id || ' & co', event_id * 37 + 2000, event_id * 37 + 2500 FROM events
    """,
)
def srt_round_trip(spark, sf_dir):
    """Each event becomes a two-cue file with markup, a missing blank line and an aside."""
    start = F.col("event_id") * 37
    content = F.concat_ws(
        "\r\n",
        F.lit("WEBVTT"),
        F.lit("1"),
        F.concat(_clock(start), F.lit(" --> "), _clock(start + 1500)),
        F.concat(F.lit("{\\an8}"), F.col("event_type"), F.col("props")),
        F.lit("<i>happened</i>"),
        F.lit("2"),
        F.concat(_clock(start + 2000, "."), F.lit("  -->  "), _clock(start + 2500)),
        F.concat(F.lit("user "), F.col("user_id").cast("string"), F.lit(" &amp; co")),
        F.lit(""),
        F.lit("NOTE not spoken"),
        F.lit("nor this"),
    )
    files = deal(a.table(spark, sf_dir, "events"), "event_id").select(
        F.col("event_id").alias("asset_id"), F.lit(".SRT").alias("ext"), content.alias("content")
    )
    return segment_texts(files).select("asset_id", "ordinal", "text", "start_ms", "end_ms")


@check(
    "ass_round_trip",
    """
    SELECT o_orderkey AS asset_id, 0 AS ordinal, o_orderpriority || ', <' || o_orderstatus || '>, ok' AS text,
           o_orderkey * 10 AS start_ms, o_orderkey * 10 + 500 AS end_ms FROM orders
    """,
)
def ass_round_trip(spark, sf_dir):
    """Each order becomes a file with a reordered Format line and commas in its text."""
    key = F.col("o_orderkey")

    def stamp(centis):
        seconds = F.floor(centis / 100).cast("long")
        return F.format_string(
            "%d:%02d:%02d.%02d",
            F.floor(seconds / 3600).cast("long"),
            F.pmod(F.floor(seconds / 60).cast("long"), F.lit(60)),
            F.pmod(seconds, F.lit(60)),
            F.pmod(centis, F.lit(100)),
        )

    content = F.concat_ws(
        "\n",
        F.lit("[Script Info]"),
        F.lit("Dialogue: 0,not,here"),
        F.lit("[Events]"),
        F.lit("Format: End, Start, Style, Text"),
        F.concat(
            F.lit("Dialogue: "), stamp(key + 50), F.lit(","), stamp(key), F.lit(",Default,{\\pos(1,2)}"),
            F.col("o_orderpriority"), F.lit(", <"), F.col("o_orderstatus"), F.lit(">,\\Nok"),
        ),
        F.lit("Dialogue: 0:00:00.00,0:00:00.00,Default,{\\p1}m 0 0 l 9 9{\\p0}"),
    )
    files = deal(a.table(spark, sf_dir, "orders"), "o_orderkey").select(
        key.alias("asset_id"), F.lit(".ass").alias("ext"), content.alias("content")
    )
    return segment_texts(files).select("asset_id", "ordinal", "text", "start_ms", "end_ms")


@check(
    "transcript_segments",
    f"""
    SELECT conv_id * 100 + turn AS asset_id, 0 AS ordinal, {a.trim_sql('text')} AS text,
           turn * 2500 AS start_ms, turn * 2500 + 1250 AS end_ms FROM conversations
    UNION ALL
    SELECT conv_id * 100 + turn, 1, role, turn * 1000, NULL FROM conversations
    """,
)
def transcript_segments(spark, sf_dir):
    turn = F.col("turn")

    def chunk(text, start, end):
        return F.struct(text.alias("text"), F.array(start, end).alias("timestamp"))

    none = F.lit(None).cast("double")
    output = F.to_json(
        F.struct(
            F.lit("unused").alias("text"),
            F.array(
                chunk(F.concat(F.lit(" "), F.col("text"), F.lit("\u3000")), turn * 2.5, turn * 2.5 + 1.25),
                chunk(F.lit("  "), none, none),
                chunk(F.col("role"), turn.cast("double"), none),
            ).alias("chunks"),
        )
    )
    files = a.spread_table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 100 + turn).alias("asset_id"), output.alias("output")
    )
    return segment_transcripts(files).select("asset_id", "ordinal", "text", "start_ms", "end_ms")


@check(
    "media_probe",
    """
    SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) * 1000 + 250 AS duration_ms,
           l_returnflag <> 'N' AS has_audio, l_linestatus = 'O' AS has_video
    FROM lineitem
    """,
)
def media_probe(spark, sf_dir):
    log = F.concat_ws(
        "\n",
        F.lit("Input #0, mov"),
        F.format_string(
            "  Duration: 00:%02d:%02d.25, start: 0.000000, bitrate: 46 kb/s",
            F.floor(F.col("l_quantity") / 60).cast("int"),
            F.pmod(F.col("l_quantity").cast("int"), F.lit(60)),
        ),
        F.when(F.col("l_linestatus") == "O", "  Stream #0:0[0x1](und): Video: h264 (High), 320x240"),
        F.when(F.col("l_returnflag") != "N", "  Stream #0:1(und): Audio: aac (LC), 44100 Hz"),
        F.lit("  Stream #0:2: Subtitle: mov_text"),
    )
    info = media_info(log)
    return a.spread_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", info.alias("i")).select(
        "l_orderkey", "l_linenumber", "i.duration_ms", "i.has_audio", "i.has_video"
    )


@check("decode_round_trip", "SELECT doc_id, text FROM documents")
def decode_round_trip(spark, sf_dir):
    """Documents written in four encodings by language, then sniffed back."""
    allow_text_decoding(spark)
    text = F.col("text")
    content = (
        F.when(F.col("lang") == "en", F.encode(text, "UTF-8"))
        .when(F.col("lang") == "fr", F.concat(F.unhex(F.lit("EFBBBF")), F.encode(text, "UTF-8")))
        .when(F.col("lang") == "de", F.concat(F.unhex(F.lit("FFFE")), F.encode(text, "UTF-16LE")))
        .otherwise(F.concat(F.unhex(F.lit("FEFF")), F.encode(text, "UTF-16BE")))
    )
    docs = a.documents(spark, sf_dir).select("doc_id", content.alias("content"))
    return docs.select("doc_id", decode_text(F.col("content")).alias("text"))


@check(
    "trigram_index",
    f"""
    WITH {a.SEGMENTS_SQL},
    occurrences AS (
      SELECT segment_id, substr(lower(text), p, 3) AS gram, p - 1 AS spot
      FROM (SELECT segment_id, text, unnest(generate_series(1, length(text) - 2)) AS p
            FROM segments WHERE length(text) >= 3)),
    postings AS (SELECT gram, segment_id, count(*) AS tf, sum(spot) AS s FROM occurrences GROUP BY ALL)
    SELECT gram, count(*) AS segments, sum(tf)::BIGINT AS occurrences, sum(s)::BIGINT AS position_sum,
           max(tf)::BIGINT AS max_tf, min(segment_id) AS first_segment
    FROM postings GROUP BY gram
    """,
)
def trigram_index(spark, sf_dir):
    """The whole index, summed per gram to compare it."""
    postings = trigram_postings(gram_blocks(a.segments(spark, sf_dir)))
    spots = F.aggregate("positions", F.lit(0).cast("long"), lambda total, at: total + at)
    per_segment = postings.select("gram", "segment_id", F.size("positions").cast("long").alias("tf"), spots.alias("spots"))
    return per_segment.groupBy("gram").agg(
        F.count(F.lit(1)).alias("segments"),
        F.sum("tf").alias("occurrences"),
        F.sum("spots").alias("position_sum"),
        F.max("tf").alias("max_tf"),
        F.min("segment_id").alias("first_segment"),
    )


@check(
    "segment_lengths",
    f"""
    WITH {a.SEGMENTS_SQL}
    SELECT segment_id, asset_id, CAST(greatest(length(text) - 2, 0) AS INTEGER) AS n_grams FROM segments
    """,
)
def segment_lengths(spark, sf_dir):
    from cuesift.operators.trigram import segment_stats

    return segment_stats(a.segments(spark, sf_dir))


@check(
    "redact_documents",
    r"""
    SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
      replace(replace(text, 'token', 'api_key'), '@', ' sk-ant-'),
      'sk-ant-[A-Za-z0-9_-]{8,}', 'sk-ant-***', 'g'),
      'sk-[A-Za-z0-9_-]{16,}', 'sk-***', 'g'),
      'Bearer\s+[A-Za-z0-9._~+/=-]{16,}', 'Bearer ***', 'gi'),
      'x-api-key["''\s:]*[A-Za-z0-9._~+/=-]{16,}', 'x-api-key: ***', 'gi'),
      'api[_-]?key["''\s:=]+[A-Za-z0-9._~+/=-]{16,}', 'api_key=***', 'gi') AS text
    FROM documents
    """,
)
def redact_documents(spark, sf_dir):
    """The corpus calls its secrets tokens; renamed, they match the patterns."""
    renamed = F.replace(F.replace("text", F.lit("token"), F.lit("api_key")), F.lit("@"), F.lit(" sk-ant-"))
    return a.documents(spark, sf_dir).select("doc_id", redact_text(renamed).alias("text"))


@check(
    "redact_nested",
    """
    SELECT conv_id, turn, 'Bearer ***' AS header, 'sk-***' AS first_item, role AS second_item FROM conversations
    """,
)
def redact_nested(spark, sf_dir):
    secret = F.rpad(F.regexp_replace("text", r"[^A-Za-z0-9]", ""), 24, "k")
    value = F.struct(
        F.concat(F.lit("bearer "), secret).alias("header"),
        F.array(F.concat(F.lit("sk-"), secret), F.col("role")).alias("items"),
    )
    rows = a.spread_table(spark, sf_dir, "conversations").select("conv_id", "turn", value.alias("v"))
    kind = T._parse_datatype_string("header string, items array<string>")
    return rows.select("conv_id", "turn", redact_value(F.col("v"), kind).alias("v")).select(
        "conv_id", "turn", "v.header", F.get("v.items", 0).alias("first_item"), F.get("v.items", 1).alias("second_item")
    )


@check(
    "format_timestamps",
    """
    SELECT event_id, (total // 60) || ':' || lpad(CAST(total % 60 AS VARCHAR), 2, '0') AS short,
           CASE WHEN total >= 3600 THEN (total // 3600) || ':' ELSE '' END
             || lpad(CAST((total % 3600) // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(total % 60 AS VARCHAR), 2, '0') AS long
    FROM (SELECT event_id, (event_id * 777 + 500) // 1000 AS total FROM events)
    """,
)
def format_timestamps(spark, sf_dir):
    ms = F.col("event_id") * 777
    return a.spread_table(spark, sf_dir, "events").select(
        "event_id", formats.clock_short(ms).alias("short"), formats.clock_long(ms).alias("long")
    )


@check(
    "format_sizes",
    """
    SELECT o_orderkey, CASE
      WHEN b < 1024 THEN b || ' B'
      WHEN b < 1048576 THEN CASE WHEN b / 1024.0 >= 10 THEN CAST(CAST(floor(b / 1024.0 + 0.5) AS BIGINT) AS VARCHAR) ELSE printf('%.1f', b / 1024.0) END || ' KB'
      WHEN b < 1073741824 THEN CASE WHEN b / 1048576.0 >= 10 THEN CAST(CAST(floor(b / 1048576.0 + 0.5) AS BIGINT) AS VARCHAR) ELSE printf('%.1f', b / 1048576.0) END || ' MB'
      ELSE CASE WHEN b / 1073741824.0 >= 10 THEN CAST(CAST(floor(b / 1073741824.0 + 0.5) AS BIGINT) AS VARCHAR) ELSE printf('%.1f', b / 1073741824.0) END || ' GB' END AS size
    FROM (SELECT o_orderkey, o_orderkey * o_orderkey * 977 AS b FROM orders)
    """,
)
def format_sizes(spark, sf_dir):
    key = F.col("o_orderkey")
    return a.spread_table(spark, sf_dir, "orders").select("o_orderkey", formats.byte_size(key * key * 977).alias("size"))


@check(
    "convert_script",
    "SELECT doc_id, translate(text, 'éèêçñ', 'eeecn') AS text FROM documents",
)
def convert_script_query(spark, sf_dir):
    table = {"é": "e", "è": "e", "ê": "e", "ç": "c", "ñ": "n"}
    return a.documents(spark, sf_dir).select("doc_id", convert_script(F.col("text"), table).alias("text"))
