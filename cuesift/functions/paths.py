"""Path keys, file names, extensions, fingerprints and file kinds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bind import bind
from .text import trim_space

# Extensions the catalogue accepts, by kind of file.
VIDEO_EXTENSIONS = [".mp4", ".mov", ".mkv", ".avi", ".webm", ".flv", ".wmv", ".m4v"]
AUDIO_EXTENSIONS = [".mp3", ".wav", ".flac", ".aac", ".m4a", ".ogg", ".wma"]
IMAGE_EXTENSIONS = [".jpg", ".jpeg", ".png", ".gif", ".bmp", ".webp", ".tiff", ".tif"]
TIMED_CUE_EXTENSIONS = [".srt", ".vtt"]
EVENT_CUE_EXTENSIONS = [".ass", ".ssa"]
PLAIN_TEXT_EXTENSIONS = [".txt", ".md", ".markdown", ".json", ".csv"]
SUBTITLE_EXTENSIONS = TIMED_CUE_EXTENSIONS + EVENT_CUE_EXTENSIONS
TEXT_EXTENSIONS = PLAIN_TEXT_EXTENSIONS + SUBTITLE_EXTENSIONS


def _resolve_dots(parts: Column, absolute: Column) -> Column:
    """Drop empty and ``.`` segments and let ``..`` remove its parent."""

    def step(done: Column, part: Column) -> Column:
        depth = F.size(done)
        parent = F.get(done, depth - 1)
        can_pop = (depth > 0) & (parent != "..")
        return (
            F.when((part == "") | (part == "."), done)
            .when((part == "..") & can_pop, F.slice(done, 1, F.greatest(depth - 1, F.lit(0))))
            .when((part == "..") & absolute, done)
            .otherwise(F.concat(done, F.array(part)))
        )

    return F.aggregate(parts, F.array().cast("array<string>"), step)


def _is_drive_root(path: Column) -> Column:
    return path.rlike(r"\A[a-zA-Z]:\\?\z")


def _strip_tail(path: Column) -> Column:
    """Remove trailing separators unless they are the root itself."""
    return F.when(
        (F.length(path) > 1) & ~_is_drive_root(path), F.regexp_replace(path, r"[\\/]+\z", "")
    ).otherwise(path)


def path_key(path: Column, case_insensitive: bool = False) -> Column:
    """Comparable key of a path that need not exist.

    ``case_insensitive`` selects the rules of a drive-letter file system:
    either separator, drive and share prefixes, lower-cased.
    """
    if case_insensitive:
        return bind(F.translate(trim_space(path), "/", "\\"), _drive_key)
    return bind(trim_space(path), _plain_key)


def _plain_key(trimmed: Column) -> Column:
    absolute = F.startswith(trimmed, F.lit("/"))
    body = F.array_join(_resolve_dots(F.split(trimmed, "/"), absolute), "/")
    full = F.when(absolute, F.concat(F.lit("/"), body)).otherwise(
        F.when(body == "", F.lit(".")).otherwise(body)
    )
    # most paths are already in normal form, and one look tells
    settled = ~trimmed.rlike(r"//|(?:\A|/)\.{1,2}(?:/|\z)|[\\/]\z")
    return F.when((trimmed == "") | settled, trimmed).otherwise(bind(full, _strip_tail))


def _drive_key(slashed: Column) -> Column:
    share = F.regexp_extract(slashed, r"\A(\\\\[^\\]+\\+[^\\]+)", 1)
    drive = F.regexp_extract(slashed, r"\A([a-zA-Z]:)", 1)
    device = F.when(share != "", share).otherwise(drive)
    rest = F.substring(slashed, F.length(device) + 1, F.length(slashed))
    absolute = (share != "") | F.startswith(rest, F.lit("\\"))
    body = F.array_join(_resolve_dots(F.split(rest, r"\\"), absolute), "\\")
    tail = F.when((body == "") & ~absolute, F.lit(".")).otherwise(body)
    full = F.concat(device, F.when(absolute, F.lit("\\")).otherwise(F.lit("")), tail)
    return F.when(slashed == "", slashed).otherwise(F.lower(bind(full, _strip_tail)))


def file_name(path: Column) -> Column:
    """Last path segment; both separators count."""
    return F.regexp_extract(F.regexp_replace(path, r"[\\/]+\z", ""), r"([^\\/]*)\z", 1)


def extension(path: Column) -> Column:
    """Lower-cased extension with its dot; a leading dot alone is none."""
    return F.lower(F.regexp_extract(file_name(path), r"(?s)\A.+(\.[^.]*)\z", 1))


def fingerprint(size_bytes: Column, mtime_ms: Column) -> Column:
    """Change marker ``size:mtime`` with whole milliseconds."""
    return F.concat_ws(
        ":", size_bytes.cast("long").cast("string"), F.floor(mtime_ms).cast("long").cast("string")
    )


def file_kind(ext: Column) -> Column:
    """Kind of file for an extension; null means unsupported."""
    return (
        F.when(ext.isin(VIDEO_EXTENSIONS), F.lit("video"))
        .when(ext.isin(AUDIO_EXTENSIONS), F.lit("audio"))
        .when(ext.isin(IMAGE_EXTENSIONS), F.lit("image"))
        .when(ext.isin(TEXT_EXTENSIONS), F.lit("text"))
    )


def extraction_plan(kind: Column, ext: Column) -> Column:
    """How a file's text is obtained: import, transcribe or unsupported."""
    return (
        F.when(F.lower(ext).isin(TEXT_EXTENSIONS), F.lit("import"))
        .when(kind.isin("video", "audio"), F.lit("transcribe"))
        .otherwise(F.lit("unsupported"))
    )
