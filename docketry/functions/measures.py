"""Precision, recall and F1 expressions with the zero rules used throughout."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def ratio(a: Column, b: Column) -> Column:
    """``a / b``, 0 when ``b`` is 0."""
    return F.when(b > 0, a.cast("double") / b.cast("double")).otherwise(F.lit(0.0))


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, (F.lit(2.0) * p * r) / (p + r)).otherwise(F.lit(0.0))


def rounded(value: Column, digits: int = 6) -> Column:
    """Rounded for reports; adding zero turns a negative zero into zero."""
    return F.round(value, digits) + F.lit(0.0)
