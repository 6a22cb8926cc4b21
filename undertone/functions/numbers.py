"""Numeric parsing and scaling expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Decimal numbers; the parsers of Java and SQL engines accept different extras.
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def number(col: Column) -> Column:
    """A text that is a finite decimal number as a double, anything else null."""
    text = F.trim(col)
    value = F.when(text.rlike(NUMBER), text.try_cast("double"))
    return F.when(F.abs(value) <= 1.7976931348623157e308, value)


def clean(col: Column) -> Column:
    """NaN as null: aggregates of frames skip both."""
    return F.nanvl(col, F.lit(None).cast("double"))


def zscale(value: Column, mean: Column, std: Column) -> Column:
    """Standard score; a missing or zero spread gives 0."""
    return F.when(std.isNull() | (std <= 1e-12), F.lit(0.0)).otherwise((value - mean) / std)
