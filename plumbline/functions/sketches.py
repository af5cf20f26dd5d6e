"""Approximate distinct counts and quantiles: sketches by day that are stored and merged later.

Sketches are filled in each task before the shuffle, so that of a hot day one sketch a task moves, not its rows. A sketch is of bounded size (some 16 kB for distinct values, some 20 kB
for numbers), however many rows it has seen. Merging is associative: weeks, months or other groups come from the stored days without reading rows again, and a day that is sketched anew replaces itself only.

NULLs are counted as rows, but are in no sketch; NaN is in none of numbers. A group without numbers has NULL quantiles, one without values 0 distinct ones. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Registers of a distinct sketch (two to this power) and size of a quantile sketch.
DISTINCT_BITS, QUANTILE_SIZE = 14, 800
#: What estimates keep to: share of the distinct count (3.7 standard errors), and of the rows by which a quantile's place is off (1.8 times its bound at 99 %).
DISTINCT_ERROR, RANK_ERROR = 0.03, 0.01
COLUMNS = ("n_rows", "distinct_sketch", "number_sketch")


def sketched(df: DataFrame, by: list[str], distinct: str, number: str) -> DataFrame:
    """by, n_rows, distinct_sketch of one column (integers, text or binary), number_sketch of another: one row a group."""
    if set(by) & set(COLUMNS):
        raise ValueError(f"groups can't be named {COLUMNS}")
    return df.groupBy(*by).agg(
        F.count("*").alias("n_rows"), F.hll_sketch_agg(distinct, DISTINCT_BITS).alias("distinct_sketch"), F.kll_sketch_agg_double(F.col(number).cast("double"), QUANTILE_SIZE).alias("number_sketch")
    )


def store(sketches: DataFrame, path: str, day: str) -> None:
    """Writes sketches by day. Days that path has already are replaced, others are left alone."""
    sketches.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def merged(sketches: DataFrame, by: list[str | Column]) -> DataFrame:
    """Sketches of coarser groups."""
    return sketches.groupBy(*by).agg(F.sum("n_rows").alias("n_rows"), F.hll_union_agg("distinct_sketch").alias("distinct_sketch"), F.kll_merge_agg_double("number_sketch").alias("number_sketch"))


def estimates(sketches: DataFrame, at: list[float]) -> DataFrame:
    """What sketches say: their groups, n_rows, n_distinct, and quantiles (array, one for each of `at`)."""
    some = F.kll_sketch_get_n_double("number_sketch") > 0
    found = F.when(some, F.kll_sketch_get_quantile_double("number_sketch", F.array(*[F.lit(float(q)) for q in at])))
    return sketches.withColumn("n_distinct", F.hll_sketch_estimate("distinct_sketch")).withColumn("quantiles", found).drop("distinct_sketch", "number_sketch")


def off_by(below: Column, upto: Column, n: Column, q: float) -> Column:
    """By what share of the rows a number's place is off q: `below` of n rows are smaller, `upto` not larger."""
    return F.greatest(F.lit(0.0), below / n - q, q - upto / n)
