"""Name a value inside a column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once.

    A lambda that mentions an outer expression computes it for every element;
    bound this way it is a lambda variable and costs nothing to repeat.
    """
    return F.get(F.transform(F.array(value), body), 0)
