"""The few functions Spark has no expression for, as Arrow batch functions."""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode compatibility composition."""
    return text.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s))


@F.pandas_udf(T.DoubleType())
def sequence_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Matching-block ratio of two normalised texts; zero when either is empty.  Not symmetric."""
    return pd.Series(
        [SequenceMatcher(None, a, b).ratio() if a and b else 0.0 for a, b in zip(left, right, strict=True)], dtype="float64"
    )


@F.pandas_udf(T.StringType())
def decode_gbk(data: pd.Series) -> pd.Series:
    return data.map(lambda b: None if b is None else bytes(b).decode("gbk", errors="replace"))
