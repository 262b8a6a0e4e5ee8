"""Windows and guarded expressions that all panel operators share.

NULL is the only missing marker: results that are NaN or infinite become NULL.
All time windows partition by symbol and all cross-sections by date, so a chain of
features costs one shuffle by symbol and one by date.
"""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def sym():
    return Window.partitionBy("symbol").orderBy("date")


def day(*more: str):
    return Window.partitionBy("date", *more)


def rolling(n: int):
    return sym().rowsBetween(-(n - 1), 0)


def prior(n: int):
    return sym().rowsBetween(-n, -1)


def finite(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def full(agg: Column, counted: Column, n: int, window) -> Column:
    """agg over the window, only where all n rows are there and not missing."""
    return F.when(F.count(counted).over(window) == n, agg.over(window))


def ratio(a: Column, b: Column) -> Column:
    """a / b, missing where b is zero or missing."""
    return F.when(b != 0, a / b)


def positive_log(x: Column) -> Column:
    return F.when(x > 0, F.ln(x))


def clip(x: Column, low: Column, high: Column) -> Column:
    """least and greatest skip NULL, so a missing x must stay missing."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, low), high))


def strict_number(column: str) -> Column:
    """A column as numbers: NULL and NaN are missing, what is infinite or no number is an error."""
    x = F.expr(f"try_cast(`{column}` AS double)")
    bad = (F.col(column).isNotNull() & x.isNull()) | (F.abs(x) == float("inf"))
    return F.when(bad, F.raise_error(F.lit(f"invalid number in {column}")).cast("double")).otherwise(F.when(~F.isnan(x), x))


def tidy(x: Column, digits: int = 6) -> Column:
    """Rounded for comparison; adding zero turns -0.0 into 0.0."""
    return F.round(x, digits) + F.lit(0.0)


def add(df, **columns: Column):
    """df with new columns; to overwrite one is an error."""
    clash = [c for c in columns if c in df.columns]
    if clash:
        raise ValueError(f"columns exist already: {clash}")
    return df.withColumns(columns)
