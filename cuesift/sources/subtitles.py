"""Subtitle files to timed cues, one file per row.

A file is cut into cue blocks by regular expressions instead of a window over
its lines: all work stays in the row, in one pass, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.bind import bind
from ..functions.media import clock_ms
from ..functions.text import SPACE, collapse_space, lines_of, pieces, trim_space

# Whitespace that may stand inside a line: everything but the line feed.
_BLANK = rf"[{SPACE}&&[^\n]]"

_TIME = (
    rf"(\d{{1,3}}):(\d{{2}}):(\d{{2}})[,.](\d{{1,3}}){_BLANK}*-->{_BLANK}*"
    r"(\d{1,3}):(\d{2}):(\d{2})[,.](\d{1,3})"
)
_ASIDE = rf"{_BLANK}*(?:NOTE|STYLE|REGION)(?![A-Za-z0-9_])"
_CUE_START = rf"(?md)^(?!{_ASIDE})(?=.*{_TIME})"
_CUE_CLOSE = rf"(?s)\n(?={_BLANK}*+(?:\n|\z)|{_ASIDE}).*"

_SECTION_START = rf"(?md)^(?={_BLANK}*\[.+\]{_BLANK}*$)"
_SECTION_NAME = rf"(?d)\A{_BLANK}*\[(.+)\]{_BLANK}*(?:\n|\z)"
_FORMAT_HEAD = rf"(?i){_BLANK}*Format{_BLANK}*:{_BLANK}*"
_FORMAT_START = rf"(?md)^(?={_FORMAT_HEAD}[^{SPACE}])"
_DIALOGUE_HEAD = rf"(?i)\ADialogue[{SPACE}]*:[{SPACE}]*"
_EVENT_TIME = r"(\d+):(\d{2}):(\d{2})[.,](\d{1,2})"

# Scripts written without spaces between words, and markup.
_UNSPACED = (
    r"[\u3000-\u303f\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
    r"\uac00-\ud7af\uff00-\uff60\uff65-\uff9f]"
)
_DRAWING = r"(?s)\{\\p[1-9]\d*\}.*?(?=\{\\p0\}|\z)"
_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " ")]


def clean_cue(raw: Column, html: bool) -> Column:
    """Readable text of a cue: markup removed, display lines joined.

    Lines join without a space only where both sides are written without
    spaces, so a word broken for display stays one word.
    """
    text = F.regexp_replace(raw, _DRAWING, "")
    text = F.regexp_replace(text, r"\{[^}]*\}", "")
    text = F.regexp_replace(text, r"\\h", " ")
    if html:
        text = F.regexp_replace(text, r"<[^>]*>", "")
        for entity, char in _ENTITIES:
            text = F.replace(text, F.lit(entity), F.lit(char))
        # last, so that an escaped entity is not decoded twice
        text = F.replace(text, F.lit("&amp;"), F.lit("&"))
    text = F.replace(F.replace(text, F.lit(r"\N"), F.lit("\n")), F.lit(r"\n"), F.lit("\n"))
    parts = F.transform(lines_of(text), trim_space)
    joined = F.array_join(F.filter(parts, lambda part: part != ""), "\n")
    joined = F.regexp_replace(joined, rf"(?<={_UNSPACED})\n(?={_UNSPACED})", "")
    return collapse_space(joined)


def _unix_lines(content: Column) -> Column:
    return F.replace(content, F.lit("\r\n"), F.lit("\n"))


def timed_cues(content: Column) -> Column:
    """Cues of SRT and VTT text; each starts at a line that holds a time range.

    A cue ends at the next time line, a blank line, or a NOTE, STYLE or REGION
    line. A trailing index line left by a missing blank line is dropped.
    """
    blocks = F.filter(
        pieces(_unix_lines(content), _CUE_START),
        lambda block: block.rlike(rf"(?d)\A(?!{_ASIDE}).*{_TIME}"),
    )

    def cue(block: Column) -> Column:
        range_text = F.regexp_replace(F.regexp_extract(block, _TIME, 0), r"[^0-9]+", " ")
        return bind(F.split(range_text, " "), lambda part: timed(block, [part[i] for i in range(8)]))

    def timed(block: Column, stamp: list[Column]) -> Column:
        lines = F.regexp_replace(F.regexp_replace(block, r"(?d)\A.*", ""), _CUE_CLOSE, "")
        lines = F.regexp_replace(lines, rf"(?<=[^\n])\n{_BLANK}*+\d++{_BLANK}*+\z", "")
        return F.struct(
            clean_cue(lines, html=True).alias("text"),
            clock_ms(*stamp[:4]).alias("start_ms"),
            clock_ms(*stamp[4:]).alias("end_ms"),
        )

    return F.filter(F.transform(blocks, cue), lambda item: item["text"] != "")


def _event_ms(field: Column) -> Column:
    part = [F.regexp_extract(field, _EVENT_TIME, i) for i in range(1, 5)]
    whole = clock_ms(part[0].try_cast("long"), part[1], part[2], F.lit("0"))
    return F.when(part[0] != "", whole + F.rpad(part[3], 2, "0").cast("long") * 10)


def event_cues(content: Column) -> Column:
    """Cues of ASS and SSA text, from the dialogue lines of its Events section.

    The Format line names the columns and stays in force until the next one;
    the text column takes the rest of the line, commas included.
    """
    sections = pieces(_unix_lines(content), _SECTION_START)
    events = F.filter(
        sections,
        lambda s: F.lower(trim_space(F.regexp_extract(s, _SECTION_NAME, 1))) == "events",
    )
    body = F.array_join(
        F.transform(events, lambda s: F.regexp_replace(s, r"(?d)\A.*\n?", "")), ""
    )

    def columns(block: Column) -> Column:
        head = F.regexp_extract(block, rf"\A{_FORMAT_HEAD}([^\n]*)", 1)
        return F.transform(F.split(head, ","), lambda name: F.lower(trim_space(name)))

    def next_layout(layouts: Column, block: Column) -> Column:
        last, names = F.element_at(layouts, -1), columns(block)
        moved = [
            F.when(F.array_position(names, key) > 0, F.array_position(names, key).cast("int") - 1)
            .otherwise(last[key])
            .alias(key)
            for key in ("text", "start", "end")
        ]
        return F.concat(layouts, F.array(F.struct(*moved)))

    # column positions of the standard layout, until a Format line says more
    standard = F.struct(F.lit(9).alias("text"), F.lit(1).alias("start"), F.lit(2).alias("end"))
    start = F.array(standard).cast("array<struct<text:int,start:int,end:int>>")

    def dialogue(fields: Column, layout: Column) -> Column:
        said = F.array_join(F.slice(fields, layout["text"] + 1, F.size(fields)), ",")
        return F.struct(
            clean_cue(said, html=False).alias("text"),
            _event_ms(F.get(fields, layout["start"])).alias("start_ms"),
            _event_ms(F.get(fields, layout["end"])).alias("end_ms"),
        )

    def block_cues(block: Column, layout: Column) -> Column:
        lines = F.filter(
            F.transform(F.split(block, "\n"), trim_space),
            lambda line: line.rlike(_DIALOGUE_HEAD + r"[^\r\u2028\u2029]*\z"),
        )
        fields = F.transform(
            lines, lambda line: F.split(F.regexp_replace(line, _DIALOGUE_HEAD, ""), ",")
        )
        return F.transform(fields, lambda values: dialogue(values, layout))

    def all_cues(blocks: Column, layouts: Column) -> Column:
        return F.flatten(
            F.transform(
                blocks,
                lambda block, i: bind(F.get(layouts, i + 1), lambda lay: block_cues(block, lay)),
            )
        )

    cues = bind(
        pieces(body, _FORMAT_START),
        lambda blocks: bind(
            F.aggregate(blocks, start, next_layout), lambda layouts: all_cues(blocks, layouts)
        ),
    )
    return F.filter(cues, lambda item: item["text"] != "")
