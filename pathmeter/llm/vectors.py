"""Checks and packing of embedding columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(embedding: str = "embedding") -> Column:
    """Neither null nor empty, and no component null, NaN or infinite."""
    e = F.col(embedding)
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return e.isNotNull() & (F.size(e) > 0) & ~F.coalesce(bad, F.lit(True))


def matrix(column: pd.Series, dtype: type = np.float64) -> np.ndarray:
    """Rows of a list column as one array; shorter vectors end in zeros."""
    rows = [np.asarray(x, dtype) for x in column]
    width = max((len(r) for r in rows), default=0)
    if all(len(r) == width for r in rows):
        return np.stack(rows) if rows else np.zeros((0, 0), dtype)
    out = np.zeros((len(rows), width), dtype)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out
