"""Shared handling of vector columns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: str) -> Column:
    """True for vectors that are not null, not empty, not zero and hold finite numbers only."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    v = F.col(vector)
    return F.coalesce(~F.exists(v, bad) & F.exists(v, lambda x: x != 0), F.lit(False))


def finite(vector: str) -> Column:
    """True for vectors that are not null, not empty and hold finite numbers only."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(~F.exists(vector, bad) & (F.size(vector) > 0), F.lit(False))


def stack(lists) -> np.ndarray:
    """Rows of equal length as a double matrix."""
    return np.array([np.asarray(x, np.float64) for x in lists], np.float64)


def component_type(df: DataFrame, vector: str) -> str:
    return "float32" if df.schema[vector].dataType.elementType.typeName() == "float" else "float64"
