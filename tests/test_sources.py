"""Text, subtitle and transcript parsing on small files."""

import json

import pytest
from pyspark.sql import functions as F

from cuesift.functions.decode import decode_text
from cuesift.functions.media import media_info
from cuesift.sources.files import classify_files, list_files, read_texts
from cuesift.sources.text import segment_texts
from cuesift.sources.transcripts import segment_transcripts


def parse(spark, ext, content):
    files = spark.createDataFrame([(1, ext, content)], "asset_id long, ext string, content string")
    rows = segment_texts(files).orderBy("ordinal").collect()
    assert [r.ordinal for r in rows] == list(range(len(rows)))
    return [(r.text, r.start_ms, r.end_ms) for r in rows]


def texts(spark, ext, content):
    return [row[0] for row in parse(spark, ext, content)]


def test_srt_basic(spark):
    assert parse(spark, ".srt", "1\n00:00:01,000 --> 00:00:04,000\n清晨的河边有雾\n\n") == [("清晨的河边有雾", 1000, 4000)]


def test_srt_without_blank_line_drops_the_stray_index(spark):
    content = "1\n00:00:01,000 --> 00:00:02,000\nfirst\n2\n00:00:03,000 --> 00:00:04,000\nsecond\n"
    assert texts(spark, ".srt", content) == ["first", "second"]


def test_a_cue_of_one_number_is_kept(spark):
    assert texts(spark, ".srt", "1\n00:00:01,000 --> 00:00:02,000\n42\n") == ["42"]


@pytest.mark.parametrize(
    "lines, joined",
    [
        ("山路很长\n慢慢走", "山路很长慢慢走"),
        ("north\nwind", "north wind"),
        ("松树\npine", "松树 pine"),
        ("下雨了，\n回家", "下雨了，回家"),
        ("바다\n빛", "바다빛"),
    ],
)
def test_display_lines(spark, lines, joined):
    assert texts(spark, ".srt", f"1\n00:00:01,000 --> 00:00:02,000\n{lines}\n") == [joined]


def test_short_fractions_are_left_aligned(spark):
    assert parse(spark, ".srt", "0:00:01,5 --> 0:00:02,25\nx\n") == [("x", 1500, 2250)]


def test_vtt_header_notes_ids_and_markup(spark):
    content = (
        "WEBVTT\n\nNOTE 00:00:09.000 --> 00:00:10.000\nnot text\n\nintro\n"
        "00:00:01.000 --> 00:00:02.000 align:start\n<v Ann>salt &amp; <i>pepper</i> &amp;lt;</v>\n"
    )
    assert parse(spark, ".vtt", content) == [("salt & pepper &lt;", 1000, 2000)]


def test_note_line_closes_a_cue(spark):
    content = "00:00:01.000 --> 00:00:02.000\nkept\nNOTE lost\nlost too\n\n00:00:03.000 --> 00:00:04.000\nNOTED kept\n"
    assert texts(spark, ".vtt", content) == ["kept", "NOTED kept"]


def test_short_vtt_times_are_not_recognised(spark):
    assert texts(spark, ".vtt", "WEBVTT\n\n00:01.000 --> 00:02.000\nx\n") == []


ASS = (
    "[Script Info]\nDialogue: no\n[V4+ Styles]\nFormat: Name, Fontname\n[Events]\n"
    "Format: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text\n"
)


@pytest.mark.parametrize(
    "text, cleaned",
    [
        ("一月,二月,三月", "一月,二月,三月"),
        ("{\\an2}{\\k35}白{\\k10}桦林", "白桦林"),
        ("灯塔\\N亮了", "灯塔亮了"),
        ("cold\\nsnow", "cold snow"),
        ("a\\hb", "a b"),
        ("风<渐强>来 &amp;", "风<渐强>来 &amp;"),
        ("{\\p1}m 7 9 l 31 12{\\p0}河", "河"),
    ],
)
def test_ass_text(spark, text, cleaned):
    content = ASS + f"Dialogue: 0,0:00:01.50,0:00:02.05,Default,,0,0,0,,{text}\n"
    assert parse(spark, ".ass", content) == [(cleaned, 1500, 2050)]


def test_ass_format_decides_the_columns_and_sections_are_respected(spark):
    content = (
        "[Events]\nFormat: Start, End, Text\nDialogue: 0:00:01.00,0:00:02.00,one, two\n"
        "[Fonts]\nDialogue: 0:00:03.00,0:00:04.00,no\n"
        "[events]\nDialogue: 0:00:05.00,0:00:06.00,three\n"
        "Format: Text, Start\nDialogue: four,0:00:07.00,0:00:08.00\n"
    )
    assert [r[:2] for r in parse(spark, ".SSA", content)] == [
        ("one, two", 1000),
        ("three", 5000),
        ("four,0:00:07.00,0:00:08.00", 7000),
    ]


def test_ass_without_times_keeps_the_text(spark):
    content = ASS + "Dialogue: 0,bad,,Default,,0,0,0,,text\n"
    assert parse(spark, ".ass", content) == [("text", None, None)]


def test_unknown_extension_gives_no_rows(spark):
    assert parse(spark, ".xyz", "text") == []


def test_plain_text_lines(spark):
    assert parse(spark, ".TXT", "  a\r\n\r\nb\rc\u3000\n\ufeffd\n") == [(c, None, None) for c in "abcd"]
    assert texts(spark, ".json", '{"text": "今天"}') == ['{"text": "今天"}']


def split_line(line):
    """The rule spelled out: cut 2000-character windows after a late blank."""
    out, start = [], 0
    while start < len(line):
        end = min(start + 2000, len(line))
        if end < len(line):
            for i in range(end, max(start + 1, end - 400), -1):
                if line[i - 1].isspace():
                    end = i
                    break
        if line[start:end].strip():
            out.append(line[start:end].strip())
        start = end
    return out


@pytest.mark.parametrize("step", [7, 333, 1599, 1601, 1999, 2000, 2001, 5000])
def test_long_lines(spark, step):
    line = " ".join(["汉😀"[i % 2] * step for i in range(9000 // step + 2)]).strip()
    assert texts(spark, ".txt", line) == split_line(line)


@pytest.mark.parametrize(
    "data, text",
    [
        ("今天".encode(), "今天"),
        (b"\xef\xbb\xbf" + "今天".encode(), "今天"),
        (b"\xff\xfe" + "今天".encode("utf-16-le"), "今天"),
        (b"\xfe\xff" + "今天".encode("utf-16-be"), "今天"),
        (b"\xbd\xf1\xcc\xec", "今天"),
        ("坏\ufffd".encode(), "坏\ufffd"),
        (b"", ""),
    ],
)
def test_encodings(spark, data, text):
    frame = spark.createDataFrame([(bytearray(data),)], "content binary")
    assert frame.select(decode_text(F.col("content"))).first()[0] == text


@pytest.mark.parametrize(
    "output, expected",
    [
        ({"text": "x", "chunks": [{"text": " 你好 ", "timestamp": [0, 1.5]}]}, [("你好", 0, 1500)]),
        ({"chunks": [{"text": " ", "timestamp": [0, 1]}, {"text": "a", "timestamp": [None, None]}]}, [("a", None, None)]),
        ({"chunks": [{"text": "a"}, 5, None, {"text": 7}]}, [("a", None, None)]),
        ({"chunks": [{"text": "a", "timestamp": ["1", 2.0004]}]}, [("a", None, 2000)]),
        ({"text": " 全文 ", "chunks": []}, [("全文", None, None)]),
        ({"text": "", "chunks": None}, []),
        ([1], []),
        (None, []),
    ],
)
def test_transcripts(spark, output, expected):
    frame = spark.createDataFrame([(1, json.dumps(output))], "asset_id long, output string")
    rows = segment_transcripts(frame).orderBy("ordinal").collect()
    assert [(r.text, r.start_ms, r.end_ms) for r in rows] == expected


def test_malformed_transcript_gives_no_rows(spark):
    frame = spark.createDataFrame([(1, "{broken")], "asset_id long, output string")
    assert segment_transcripts(frame).count() == 0


def test_media_probe(spark):
    log = (
        "  Duration: 00:00:02.00, start: 0.000000\n"
        "  Stream #0:0[0x1](und): Video: h264 (High), 320x240\n  Stream #0:1(und): Audio: aac\n"
    )
    rows = spark.createDataFrame([(log,), ("nothing",), ("  Duration: N/A\n  Stream #0:0: Audio: mp3",)], "log string")
    got = [tuple(r.i) for r in rows.select(media_info(F.col("log")).alias("i")).collect()]
    assert got == [(2000, True, True), (None, False, False), (None, True, False)]


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.srt").write_bytes("1\n00:00:01,000 --> 00:00:02,000\n今天\n".encode("gbk"))
    (tmp_path / "sub" / "b.TXT").write_text("one\ntwo\n")
    (tmp_path / "sub" / "c.exe").write_text("x")
    listed = classify_files(list_files(spark, str(tmp_path)))
    assert {(r.file_name, r.ext, r.kind, r.size_bytes) for r in listed.collect()} == {
        ("a.srt", ".srt", "text", (tmp_path / "a.srt").stat().st_size),
        ("b.TXT", ".txt", "text", 8),
        ("c.exe", ".exe", None, 1),
    }
    contents = read_texts(spark, str(tmp_path)).withColumn("asset_id", F.length("path").cast("long"))
    assert sorted(r.text for r in segment_texts(contents).collect()) == ["one", "two", "今天"]


def test_files_above_a_limit_are_reported_not_lost(spark, tmp_path):
    (tmp_path / "a.txt").write_text("short")
    (tmp_path / "b.txt").write_text("x" * 900)
    got = {r.path.rsplit("/", 1)[1]: (r.content, r.error) for r in read_texts(spark, str(tmp_path), max_bytes=100).collect()}
    assert got == {"a.txt": ("short", None), "b.txt": (None, "FILE_TOO_LARGE")}


@pytest.mark.parametrize("sign", ["\ufdd0", "\ufdd1", "\x00", "\ufffe"])
def test_no_character_cuts_a_cue(spark, sign):
    assert texts(spark, ".srt", f"1\n00:00:01,000 --> 00:00:02,000\nab{sign}cd\n") == [f"ab{sign}cd"]


def test_listing_reads_no_file_contents(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x")
    plan = list_files(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan
