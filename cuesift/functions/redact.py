"""Masking of strings that look like credentials."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import SPACE

# Pattern and mask, applied in this order.
SECRET_PATTERNS = [
    (r"sk-ant-[A-Za-z0-9_-]{8,}", "sk-ant-***"),
    (r"sk-[A-Za-z0-9_-]{16,}", "sk-***"),
    (rf"(?i)Bearer[{SPACE}]+[A-Za-z0-9._~+/=-]{{16,}}", "Bearer ***"),
    (rf"(?i)x-api-key[\"'{SPACE}:]*[A-Za-z0-9._~+/=-]{{16,}}", "x-api-key: ***"),
    (rf"(?i)api[_-]?key[\"'{SPACE}:=]+[A-Za-z0-9._~+/=-]{{16,}}", "api_key=***"),
]

# Nesting limit and the text that replaces deeper values.
MAX_DEPTH = 6
TOO_DEEP = "[层级过深已截断]"


def redact_text(col: Column) -> Column:
    """Mask every secret in a string."""
    for pattern, mask in SECRET_PATTERNS:
        col = F.regexp_replace(col, pattern, mask)
    return col


def redact_value(col: Column, data_type: T.DataType, depth: int = 0) -> Column:
    """Mask secrets in every string inside a nested value, by its type.

    Strings below the nesting limit become the marker. Numbers and other values
    hold no secrets and stay at any depth.
    """
    if isinstance(data_type, T.StringType):
        return F.when(col.isNotNull(), F.lit(TOO_DEEP)) if depth > MAX_DEPTH else redact_text(col)
    if isinstance(data_type, T.ArrayType):
        return F.transform(col, lambda item: redact_value(item, data_type.elementType, depth + 1))
    if isinstance(data_type, T.MapType):
        return F.transform_values(
            col, lambda _key, item: redact_value(item, data_type.valueType, depth + 1)
        )
    if isinstance(data_type, T.StructType):
        fields = [
            redact_value(col[f.name], f.dataType, depth + 1).alias(f.name) for f in data_type.fields
        ]
        return F.when(col.isNotNull(), F.struct(*fields))
    return col
