"""The open JSON that jobs carry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def open_json(text: Column) -> Column:
    """A JSON text as a variant; null where it is absent or no JSON.

    A damaged result must not keep the rest of its job from being read.
    """
    return F.try_parse_json(text)


def json_field(value: Column, path: str, kind: str) -> Column:
    """A field of ``open_json`` in a given type; null where it is absent or of another type."""
    return F.try_variant_get(value, path, kind)


def read_jobs(jobs):
    """Jobs with ``payload`` and ``result`` as variants instead of texts."""
    opened = {c: open_json(F.col(c)) for c in ("payload", "result") if c in jobs.columns}
    return jobs.withColumns(opened)
