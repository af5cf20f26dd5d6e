"""Formats of the report, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def thousands(x: Column, digits: int = 0) -> Column:
    return F.format_number(x, digits)


def left(x: Column, width: int) -> Column:
    """x, padded to the right; never cut."""
    return F.when(F.length(x) >= width, x).otherwise(F.rpad(x, width, " "))


def right(x: Column, width: int) -> Column:
    return F.when(F.length(x) >= width, x).otherwise(F.lpad(x, width, " "))


def listed(order: Column, text: Column, separator: str = ", ") -> Column:
    """Texts of a group, joined in order. For groups of a few rows, such as the folds of a model."""
    return F.concat_ws(separator, F.transform(F.array_sort(F.collect_list(F.struct(order.alias("k"), text.alias("t")))), lambda x: x["t"]))
