"""Moments that never divide by zero: under ANSI rules the built-in correlation of flat values raises an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def corr(x: Column | str, y: Column | str, window=None) -> Column:
    """Pearson correlation over rows with both values, as an aggregate or over a window; none where either is flat."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    over = (lambda c: c) if window is None else (lambda c: c.over(window))
    return F.try_divide(over(F.covar_pop(a, b)), over(F.stddev_pop(a)) * over(F.stddev_pop(b)))
