"""Rounding and exact statistics."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def python_round(c: Column, digits: int = 2) -> Column:
    """Half-even on the binary value, as Python rounds; for small report tables only, as it leaves the JVM."""

    @F.pandas_udf("double")
    def rounded(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if pd.isna(v) else round(float(v), digits))

    return rounded(c.cast("double"))


def exact_mean(total: Column, n: Column) -> Column:
    """Mean of integers from exact sums; null for none."""
    return F.when(n > 0, total.cast("double") / n)


def exact_std(total: Column, squares: Column, n: Column) -> Column:
    """Sample standard deviation of integers from exact sums; null for fewer than two."""
    return F.when(n > 1, F.sqrt((n * squares - total * total).cast("double") / (n * (n - 1)).cast("double")))


def binarize(x: Column, threshold: float = 1.5) -> Column:
    """1 where the base-2 logarithm is above the threshold; null where x isn't positive."""
    return F.when(x > 0, (F.log2(x) > threshold).cast("int"))
