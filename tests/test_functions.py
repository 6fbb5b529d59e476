"""Scalar rules: queries, snippets, paths, tags, formats, redaction."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuesift.functions import formats
from cuesift.functions.paths import extension, extraction_plan, file_kind, file_name, fingerprint, path_key
from cuesift.functions.redact import redact_text, redact_value
from cuesift.functions.snippet import highlight_pieces, merge_ranges, with_snippet
from cuesift.functions.tagnames import tag_display, tag_key
from cuesift.functions.text import char_fold, trim_space, utf16_length
from cuesift.operators.terms import normalize_queries, query_terms


def values(spark, items, expression, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(expression(F.col("v"))).collect()]


def test_queries(spark):
    asked = [
        (0, "  探店　火锅店\u200bmp4 MP4 "),
        (1, "   "),
        (2, "x" * 201),
        (3, "\u200b"),
        (4, "😀😀"),
        (5, "x" * 200),
    ]
    normalized = normalize_queries(spark.createDataFrame(asked, "query_id long, query string"))
    terms = {}
    for r in query_terms(normalized).orderBy("query_id", "position").collect():
        terms.setdefault(r.query_id, []).append((r.term, r.length, r.path))
    assert terms[0] == [("探店", 2, "like"), ("火锅店", 3, "fts"), ("mp4", 3, "fts")]
    assert terms[4] == [("😀😀", 2, "like")]
    rows = {r.query_id: r for r in normalized.collect()}
    assert [rows[i].error_code for i in range(6)] == [
        None, "SEARCH_QUERY_EMPTY", "SEARCH_QUERY_TOO_LONG", "SEARCH_QUERY_EMPTY", None, None,
    ]
    assert [w.code for w in rows[0].warnings] == ["SHORT_TERM_LIKE_FALLBACK"]
    assert [w.code for w in rows[4].warnings] == ["SHORT_TERM_LIKE_FALLBACK", "NO_FTS_TERMS"]
    assert rows[5].warnings == []


def test_trim_and_lengths(spark):
    assert values(spark, ["\u3000 a b\ufeff\n", "", "\x0b"], trim_space) == ["a b", "", ""]
    assert values(spark, ["a😀", "汉"], utf16_length) == [3, 1]
    assert values(spark, ["ΣΑΣ", "İx"], lambda c: F.length(char_fold(c))) == [3, 2]
    assert values(spark, ["ΣΑΣ"], char_fold) == ["σασ"]


def fold(char):
    return char.lower() if len(char.lower()) == 1 else char


def plain_matches(text, terms):
    folded = [fold(c) for c in text]
    found = sorted(
        (i, i + len(t)) for t in terms for i in range(len(text) - len(t) + 1)
        if t and folded[i : i + len(t)] == [fold(c) for c in t]
    )
    merged = []
    for start, end in found:
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    return merged


def units(text):
    return len(text.encode("utf-16-be")) // 2


def plain_snippet(text, terms):
    merged = plain_matches(text, terms)
    if not merged:
        return text[:96], [], False, len(text) > 96
    first = merged[0]
    start = max(0, first[0] - 24)
    end = max(min(len(text), start + 96), min(len(text), first[1]))
    marks = [(units(text[start:a]), units(text[start:b])) for a, b in merged if a >= start and b <= end]
    return text[start:end], marks, start > 0, end < len(text)


alphabet = st.sampled_from("aAbBéÉ探店火锅😀 ΣİxX")


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(
        st.tuples(
            st.text(alphabet, max_size=160), st.lists(st.text(alphabet, min_size=1, max_size=4), min_size=1, max_size=3)
        ),
        min_size=1,
        max_size=30,
    )
)
def test_snippets_against_brute_force(spark, cases):
    rows = [(i, text, terms) for i, (text, terms) in enumerate(cases)]
    frame = spark.createDataFrame(rows, "i int, text string, terms array<string>")
    for r in with_snippet(frame, "text", "terms").collect():
        got = (r.snippet, [(h.start, h.end) for h in r.highlights], r.truncated_head, r.truncated_tail)
        assert got == plain_snippet(r.text, r.terms)


def test_a_term_longer_than_the_window_is_shown_whole(spark):
    frame = spark.createDataFrame([("y" * 30 + "x" * 120 + "z", ["x" * 120])], "text string, terms array<string>")
    row = with_snippet(frame, "text", "terms").first()
    assert row.snippet == "y" * 24 + "x" * 120 and row.truncated_head and row.truncated_tail


def test_pieces(spark):
    cases = [
        ("🎬探店火锅店", [(2, 4), (3, 5)], [("🎬", False), ("探店火", True), ("锅店", False)]),
        ("abc", [], [("abc", False)]),
        ("abc", [(0, 3)], [("abc", True)]),
        ("abcd", [(2, 3), (0, 1)], [("a", True), ("b", False), ("c", True), ("d", False)]),
    ]
    frame = spark.createDataFrame([(s, h) for s, h, _ in cases], "s string, h array<struct<start:int,end:int>>")
    got = [r[0] for r in frame.select(highlight_pieces(F.col("s"), F.col("h"))).collect()]
    assert [[tuple(p) for p in row] for row in got] == [want for _, _, want in cases]


def test_merge_ranges_joins_touching(spark):
    frame = spark.createDataFrame([([(4, 6), (0, 2), (2, 4), (8, 9)],)], "h array<struct<start:int,end:int>>")
    assert [tuple(p) for p in frame.select(merge_ranges(F.col("h"))).first()[0]] == [(0, 6), (8, 9)]


@pytest.mark.parametrize("windows, cases", [
    (False, {"/a/b/": "/a/b", "/a/./b//c/../d": "/a/b/d", "/": "/", "..": "..", "../a/..": "..", "a/..": ".",
             "/..": "/", " /A ": "/A", "": "", "C:\\": "C:\\", "./x": "x", "/a/b": "/a/b"}),
    (True, {"D:\\素材库\\美食": "d:\\素材库\\美食", "D:\\素材库\\美食\\": "d:\\素材库\\美食", "d:/素材库/美食": "d:\\素材库\\美食",
            "D:\\素材库\\.\\美食": "d:\\素材库\\美食", "C:\\": "c:\\", "C:\\a\\..": "c:\\", "": ""}),
])
def test_path_keys(spark, windows, cases):
    assert values(spark, list(cases), lambda c: path_key(c, windows)) == list(cases.values())


def test_names_extensions_and_kinds(spark):
    paths = ["/a/访谈.第三期.MP4", "C:\\x\\.gitignore", "noext", "/a/b/", "a.", ".a.b"]
    assert values(spark, paths, file_name) == ["访谈.第三期.MP4", ".gitignore", "noext", "b", "a.", ".a.b"]
    assert values(spark, paths, extension) == [".mp4", "", "", "", ".", ".b"]
    kinds = [".mp4", ".wma", ".tif", ".csv", ".exe", ""]
    assert values(spark, kinds, file_kind) == ["video", "audio", "image", "text", None, None]
    plans = spark.createDataFrame([("video", ".mp4"), ("text", ".SRT"), ("image", ".png"), (None, "")], "kind string, ext string")
    got = [r[0] for r in plans.select(extraction_plan(F.col("kind"), F.col("ext"))).collect()]
    assert got == ["transcribe", "import", "unsupported", "unsupported"]
    stamp = spark.createDataFrame([(12, 1700000000123.9)], "s long, m double")
    assert stamp.select(fingerprint(F.col("s"), F.col("m"))).first()[0] == "12:1700000000123"


def test_tag_names(spark):
    raw = ["  美  食 ", "ＭＰ４", "mp4", "", "\u3000", "x" * 51, "😀" * 50, "ﬁn\u00a0Ａ"]
    assert values(spark, raw, tag_display) == ["美 食", "ＭＰ４", "mp4", None, None, None, "😀" * 50, "ﬁn Ａ"]
    assert values(spark, raw, tag_key) == ["美 食", "mp4", "mp4", "", "", "x" * 51, "😀" * 50, "fin a"]


def test_formats(spark):
    ms = [None, 0, 499, 500, 59_500, 3_600_000, 4_000_499]
    assert values(spark, ms, formats.clock_short, "long") == [None, "0:00", "0:00", "0:01", "1:00", "60:00", "66:40"]
    assert values(spark, ms, formats.clock_long, "long") == ["", "00:00", "00:00", "00:01", "01:00", "1:00:00", "1:06:40"]
    sizes = [0, 1023, 1024, 1536, 10_239, 10_240, 1_048_575, 5 * 1024**3, 3 * 1024**5]
    assert values(spark, sizes, formats.byte_size, "long") == [
        "0 B", "1023 B", "1.0 KB", "1.5 KB", "10.0 KB", "10 KB", "1024 KB", "5.0 GB", "3072 TB",
    ]
    assert values(spark, [None, 0], formats.minute_stamp, "long") == ["—", "1970-01-01 00:00"]
    label = spark.range(1).select(formats.engine_label("p-1", "traditional")).first()[0]
    assert label == "p-1+traditional"


def test_script_conversion_is_by_character(spark):
    table = {"體": "体", "開": "开"}
    assert values(spark, ["軟體開", "软体开"], lambda c: formats.convert_script(c, table)) == ["軟体开", "软体开"]
    with pytest.raises(ValueError):
        formats.convert_script(F.col("v"), {"ab": "c"})


def test_redaction(spark):
    cases = {
        "sk-ant-api03-abcdefgh x": "sk-ant-*** x",
        "sk-abcdefghijklmnop": "sk-***",
        "sk-short": "sk-short",
        "bearer abcdefghijklmnop.q": "Bearer ***",
        "X-API-Key: abcdefghijklmnopq": "x-api-key: ***",
        'apikey="abcdefghijklmnopq"': 'api_key=***"',
        "普通文案": "普通文案",
    }
    assert values(spark, list(cases), redact_text) == list(cases.values())


def test_nested_redaction(spark):
    deep = "a struct<b:struct<c:struct<d:struct<e:struct<f:struct<g:string>>>>>>, n int, l array<string>, m map<string,string>"
    secret = "sk-abcdefghijklmnop"
    schema = T._parse_datatype_string(f"v struct<{deep.replace(' ', ':').replace(',:', ',')}>")
    row = (((((((secret,),),),),),), 3, [secret, None], {"k": secret})
    kind = schema["v"].dataType
    got = spark.createDataFrame([(row,)], schema).select(redact_value(F.col("v"), kind).alias("v")).first().v
    assert got.n == 3 and got.l == ["sk-***", None] and got.m == {"k": "sk-***"}
    assert got.a.b.c.d.e.f.g == "[层级过深已截断]"


def test_term_ranges_look_only_where_terms_stand(spark):
    """Overlaps and odd needles included; no step for every character of a text."""
    from cuesift.functions.snippet import term_ranges

    rows = spark.createDataFrame([("aaaaa b",), ("ΣaΣ",), ("",), (None,), ("none",)], "t string")
    found = rows.select("t", term_ranges(F.col("t"), F.array(*[F.lit(x) for x in ("AA", "σ", "", "aaaaaaaaaaaa")])).alias("r"))
    got = {r.t: [(x.start, x.end) for x in r.r] for r in found.collect()}
    assert got == {"aaaaa b": [(0, 2), (1, 3), (2, 4), (3, 5)], "ΣaΣ": [(0, 1), (2, 3)], "": [], None: [], "none": []}
    plan = found._jdf.queryExecution().analyzed().toString()
    assert "filter(" not in plan and "substring(" not in plan
