"""All registered queries."""

from __future__ import annotations

from . import curation, folders, library, searches, streams, texts

MODULES = [texts, searches, library, curation, folders, streams]


def queries() -> dict:
    return {name: function for module in MODULES for name, function in module.QUERIES.items()}


def oracles() -> dict:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
