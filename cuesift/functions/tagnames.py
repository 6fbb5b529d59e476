"""Tag display names and their de-duplication keys."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import collapse_space

MAX_TAG_LENGTH = 50
TAG_INVALID = "TAG_NAME_INVALID"


def tag_display(raw: Column) -> Column:
    """Name as shown, or null when it is empty or longer than 50 code points."""
    name = collapse_space(raw)
    return F.when((name != "") & (F.length(name) <= MAX_TAG_LENGTH), name)


def _nfkc(name: Column) -> Column:
    # nested, so that it travels to the workers by value
    def normalize(names: pd.Series) -> pd.Series:
        return names.map(lambda s: unicodedata.normalize("NFKC", s), na_action="ignore")

    return F.pandas_udf(normalize, T.StringType())(name)


def tag_key(name: Column) -> Column:
    """Key under which spellings of one tag agree: NFKC, one-space, lower case.

    Plain ASCII is already normalised; only other names reach Python.
    """
    plain = name.rlike(r"\A[\x20-\x7e]*\z")
    normal = F.coalesce(F.when(plain, name), _nfkc(F.when(~plain, name)))
    return F.lower(collapse_space(normal))
