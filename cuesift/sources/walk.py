"""Walking folders: every directory is listed by a task, one round for each level."""

from __future__ import annotations

import os
import stat
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread, stored

# What one entry of a directory is.
FILE, DIRECTORY, ERROR = "file", "directory", "error"

ENTRIES = "directory_id long, path string, entry string, size_bytes long, mtime_ms double, error string"

# Entries of a large directory sent on at once.
_BATCH = 10_000

Lister = Callable[[str], Iterator[tuple]]


def reason_of(error: BaseException) -> str:
    return error.strerror if isinstance(error, OSError) and error.strerror else str(error)


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The store a path or address belongs to, and the path inside it."""
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def list_entries(path: str) -> Iterator[tuple]:
    """``path, entry, size_bytes, mtime_ms, error`` of what a directory holds, hidden names too.

    Links are passed over, so a walk never runs in circles, and so is anything
    that is neither a file nor a directory.
    """
    store, inside = file_system(path)
    if not isinstance(store, fs.LocalFileSystem):
        for found in store.get_file_info(fs.FileSelector(inside)):
            whole = f"{path.rstrip('/')}/{found.base_name}"
            if found.type == fs.FileType.Directory:
                yield whole, DIRECTORY, None, None, None
            elif found.type == fs.FileType.File:
                yield whole, FILE, found.size, found.mtime_ns / 1e6 if found.mtime_ns else 0.0, None
        return
    with os.scandir(inside) as entries:
        for found in entries:
            if found.is_symlink():
                continue
            try:
                facts = found.stat(follow_symlinks=False)
            except OSError as error:  # gone since it was listed
                yield found.path, ERROR, None, None, reason_of(error)
                continue
            if stat.S_ISDIR(facts.st_mode):
                yield found.path, DIRECTORY, None, None, None
            elif stat.S_ISREG(facts.st_mode):
                yield found.path, FILE, facts.st_size, facts.st_mtime_ns / 1e6, None


@dataclass(frozen=True)
class Walk:
    """``listing`` has files and errors, ``scans`` one row per root, ``unread`` the directories that
    could not be listed."""

    listing: DataFrame
    scans: DataFrame
    unread: DataFrame


def walk(roots: DataFrame, list_one: Lister = list_entries) -> Walk:
    """Everything below ``roots(directory_id, path)``.

    The directories of one level are a table; tasks list them and their
    subdirectories are the next table. A directory that cannot be listed, or a
    file that cannot be looked at, is a row with the reason and stops nothing.
    """
    columns = [c.split()[0] for c in ENTRIES.split(", ")]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.float64(), pa.string()]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            cells = zip(*rows) if rows else [[] for _ in types]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cells, types)], columns)

        for part in batches:
            for number, path in zip(part.column("directory_id").to_pylist(), part.column("path").to_pylist()):
                rows = []
                try:
                    for entry in list_one(path):
                        rows.append((number, *entry))
                        if len(rows) == _BATCH:
                            yield batch(rows)
                            rows = []
                except (OSError, pa.ArrowInvalid) as error:
                    rows.append((number, path, "unread", None, None, reason_of(error)))
                yield batch(rows)

    frontier, levels = roots.select(F.col("directory_id").cast("long"), "path"), []
    while True:
        listed = stored(spread(frontier, "path").mapInArrow(look, ENTRIES), "walk")
        levels.append(listed.where(F.col("entry") != DIRECTORY))
        frontier = listed.where(F.col("entry") == DIRECTORY).select("directory_id", "path")
        if frontier.isEmpty():
            break
    found = reduce(DataFrame.unionByName, levels)
    unread = found.where("entry = 'unread'").select("directory_id", "path")
    missed = roots.join(unread, ["directory_id", "path"], "left_semi").select("directory_id", F.lit(True).alias("__missed"))
    scans = roots.join(missed, "directory_id", "left").select("directory_id", F.col("__missed").isNull().alias("completed"))
    return Walk(found.select("directory_id", "path", "size_bytes", "mtime_ms", "error"), scans, unread)
