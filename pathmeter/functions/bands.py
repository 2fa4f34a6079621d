"""Colour bands of the panels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pathmeter import params as P


def band(panel: str, value: Column | str) -> Column:
    """Colour of the highest band whose lower bound the value reaches."""
    value = F.col(value) if isinstance(value, str) else value
    bounds = [(low, colour) for name, low, colour in P.BANDS if name == panel]
    base = next(colour for low, colour in bounds if low is None)
    steps = sorted(((low, c) for low, c in bounds if low is not None), reverse=True)
    (low, colour), *rest = steps
    out = F.when(value >= low, F.lit(colour))
    for low, colour in rest:
        out = out.when(value >= low, F.lit(colour))
    return out.otherwise(F.lit(base))
