"""Regression metrics as aggregate columns, in the order mae, rmse, rmsle, r2.

Both sides are cast to double. A group in which a truth or a prediction is NULL has NULL metrics, so that missing
values are never skipped in silence; NaN gives NaN. R² is NULL where the truth is constant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAMES = ("mae", "rmse", "rmsle", "r2")


def _double(x: Column | str) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("double")


def _whole(y: Column, p: Column, value: Column) -> Column:
    """value, or NULL where a group has a row without truth or prediction."""
    return F.when(F.count_if(y.isNull() | p.isNull()) == 0, value)


def clip0(x: Column) -> Column:
    """x, at least 0. greatest() alone would turn NULL into 0."""
    return F.when(x.isNotNull(), F.greatest(x, F.lit(0.0)))


def log1p(x: Column) -> Column:
    """log(1 + x) with minus infinity at -1 and NaN below, where Spark's has NULL."""
    return F.when(x < -1, F.lit(float("nan"))).when(x == -1, F.lit(float("-inf"))).otherwise(F.log1p(x))


def mae(y: Column | str, p: Column | str) -> Column:
    y, p = _double(y), _double(p)
    return _whole(y, p, F.avg(F.abs(y - p)))


def rmse(y: Column | str, p: Column | str) -> Column:
    y, p = _double(y), _double(p)
    return _whole(y, p, F.sqrt(F.avg((y - p) * (y - p))))


def rmsle(y: Column | str, p: Column | str) -> Column:
    """Predictions, but not truths, are raised to 0 first."""
    y, p = _double(y), _double(p)
    d = log1p(clip0(p)) - log1p(y)
    return _whole(y, p, F.sqrt(F.avg(d * d)))


def r2(y: Column | str, p: Column | str) -> Column:
    """1 - residual / total sum of squares, around the mean of the rows evaluated; negative for bad predictions."""
    y, p = _double(y), _double(p)
    total = F.var_pop(y) * F.count(y)
    return _whole(y, p, 1 - F.sum((y - p) * (y - p)) / F.nullif(total, F.lit(0.0)))


def metric_columns(y: Column | str, p: Column | str) -> list[Column]:
    return [f(y, p).alias(name) for name, f in zip(NAMES, (mae, rmse, rmsle, r2), strict=True)]


def compute_metrics(df: DataFrame, y: str, p: str, by: list[str] | None = None) -> DataFrame:
    """All four metrics in one aggregation, one row a group."""
    return df.groupBy(*(by or [])).agg(*metric_columns(y, p))


def improvement_pct(model: Column, base: Column) -> Column:
    """By how many percent a model's error is below a baseline's; NULL for a baseline of 0."""
    return 100 * (1 - F.try_divide(model, base))
