"""Preprocessing fitted on training folds only: medians, modes and categories for every fold at once.

A value's count in the training rows of fold i is its count in all folds but i. So each table is counted once, by column, value and fold
(partial counts on the map side, hence no hot key), and only counts, never rows, are repeated for the folds.

Medians are exact (the midpoint of two for an even number) and need no group in memory: counts are bucketed between
approximate quantiles, a cumulative sum over the buckets finds the one that holds a median, and only its values are ranked.
NULL and NaN are missing. A column without any value in a training fold has no statistic there; its values stay NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.split import FOLDS

#: Edges between buckets of a numeric column.
EDGES = 256
#: Categories that a column may have as one-hot columns; more is an error, as the width would grow with the data.
MAX_CATEGORIES = 10_000


def value_counts(df: DataFrame, columns: list[str], to: str) -> DataFrame:
    """column, value, pli, n of the non-missing values of dev rows; values cast to double or string."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast(to).alias("value")) for c in columns])
    long = df.where("pli IS NOT NULL").select("pli", F.inline(pairs)).where("value IS NOT NULL")
    if to == "double":
        long = long.where(~F.isnan("value"))
    return long.groupBy("column", "value", "pli").agg(F.count("*").alias("n"))


def for_training(counts: DataFrame, keys: list[str], folds: int = FOLDS) -> DataFrame:
    """keys, pli, n: counts of each fold's training rows, from keys, pli, n of the folds themselves. Keys that occur in fold i alone are not in i's."""
    by = counts.groupBy(*keys).agg(F.sum("n").alias("all"), *[F.coalesce(F.sum(F.when(F.col("pli") == i, F.col("n"))), F.lit(0)).alias(f"n{i}") for i in range(1, folds + 1)])
    each = F.array(*[F.struct(F.lit(i).alias("pli"), (F.col("all") - F.col(f"n{i}")).alias("n")) for i in range(1, folds + 1)])
    return by.select(*keys, F.inline(each)).where("n > 0")


def training_medians(df: DataFrame, columns: list[str], folds: int = FOLDS) -> DataFrame:
    """column, pli, number."""
    spark = df.sparkSession
    if not columns:
        return spark.createDataFrame([], "column string, pli int, number double")
    counts = value_counts(df, columns, "double")
    steps = [i / EDGES for i in range(1, EDGES)]
    row = df.where("pli IS NOT NULL").agg(*[F.percentile_approx(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")), steps, 10 * EDGES).alias(c) for c in columns]).first()
    edges = {c: sorted(set(row[c] or [])) for c in columns}  # EDGES numbers a column

    bucket: Column = F.lit(0)
    for c in columns:
        if edges[c]:
            inside = F.size(F.filter(F.array(*[F.lit(e) for e in edges[c]]), lambda e: e < F.col("value")))
            bucket = F.when(F.col("column") == c, inside).otherwise(bucket)
    counts = counts.withColumn("bucket", bucket)
    at = ["column", "pli"]
    sums = for_training(counts.groupBy("column", "bucket", "pli").agg(F.sum("n").alias("n")), ["column", "bucket"], folds)
    in_order = Window.partitionBy(*at).orderBy("bucket")
    sums = sums.withColumn("upto", F.sum("n").over(in_order)).withColumn("total", F.sum("n").over(Window.partitionBy(*at)))
    ranks = F.array_distinct(F.array(F.floor((F.col("total") + 1) / 2), F.floor(F.col("total") / 2) + 1))
    wanted = sums.withColumn("rank", F.explode(ranks)).where((F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("n")))
    wanted = wanted.select(*at, "bucket", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"))  # at most two rows a column and fold
    near = counts.join(F.broadcast(wanted.select("column", "bucket").distinct()), ["column", "bucket"], "left_semi")
    near = for_training(near, ["column", "bucket", "value"], folds)
    walk = Window.partitionBy("column", "bucket", "pli").orderBy("value")
    near = near.withColumn("upto", F.sum("n").over(walk))
    found = near.join(F.broadcast(wanted), ["column", "bucket", "pli"]).where((F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("n")))
    return found.groupBy(*at).agg(F.avg("value").alias("number"))


def medians(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """The exact median of each column over all rows; a column without values has none. With all rows in the first of two folds, they are what trains the second."""
    return {r.column: r.number for r in training_medians(df.withColumn("pli", F.lit(1)), columns, 2).where("pli = 2").collect()}


def require_few_categories(df: DataFrame, columns: list[str]) -> None:
    """An error where a column has more than MAX_CATEGORIES categories, counted within one percent."""
    if columns:
        n = df.agg(*[F.approx_count_distinct(F.col(c).cast("string"), 0.01).alias(c) for c in columns]).first().asDict()
        wide = {c: k for c, k in n.items() if k > 1.02 * MAX_CATEGORIES}
        if wide:
            raise ValueError(f"categories, over {MAX_CATEGORIES}: {wide}")


def training_modes(df: DataFrame, columns: list[str], folds: int = FOLDS) -> DataFrame:
    """column, pli, text: the most frequent value, the smallest of equals."""
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, pli int, text string")
    counts = for_training(value_counts(df, columns, "string"), ["column", "value"], folds)
    return counts.groupBy("column", "pli").agg(F.min(F.struct((-F.col("n")).alias("n"), "value"))["value"].alias("text"))


def training_categories(df: DataFrame, columns: list[str], folds: int = FOLDS) -> DataFrame:
    """column, value, pli, n: categories of each fold's training rows."""
    return for_training(value_counts(df, columns, "string"), ["column", "value"], folds)


def statistics_by_fold(df: DataFrame, numeric: list[str], categorical: list[str], folds: int = FOLDS) -> dict[int, dict[str, float | str]]:
    """{fold: {column: median or mode}}: a few values a column and fold."""
    out: dict[int, dict[str, float | str]] = {i: {} for i in range(1, folds + 1)}
    for r in training_medians(df, numeric, folds).collect():
        out[r.pli][r.column] = r.number
    for r in training_modes(df, categorical, folds).collect():
        out[r.pli][r.column] = r.text
    return out


def impute(df: DataFrame, numeric: list[str], categorical: list[str], known: dict[int, dict[str, float | str]], fold: int | None = None) -> DataFrame:
    """df with missing values filled by statistics of the training rows: of `fold`, or of each row's own fold. Numeric columns become double."""

    def filler(c: str, kind: str) -> Column:
        if fold is not None:
            return F.lit(known[fold].get(c)).cast(kind)
        out = F.lit(None).cast(kind)
        for i, values in known.items():
            out = F.when(F.col("pli") == i, F.lit(values.get(c)).cast(kind)).otherwise(out)
        return out

    filled = {c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), filler(c, "double")) for c in numeric}
    filled |= {c: F.coalesce(F.col(c).cast("string"), filler(c, "string")) for c in categorical}
    return df.withColumns(filled) if filled else df


def one_hot_long(df: DataFrame, key: str, column: str, folds: int = FOLDS) -> DataFrame:
    """key, pli, feature, for the one 1 that each validation row has in the block of `column`; a value that its training rows lack, or NULL, gives no row (a block of zeros)."""
    categories = training_categories(df, [column], folds).select("pli", F.col("value").alias("_value"))
    rows = df.where("pli IS NOT NULL").select(key, "pli", F.col(column).cast("string").alias("_value"))
    return rows.join(categories, ["pli", "_value"]).select(key, "pli", F.concat_ws("_", F.lit(column), "_value").alias("feature"))


def one_hot_columns(df: DataFrame, column: str, categories: list[str]) -> DataFrame:
    """df plus one 0/1 column a category, in order. Unknown and NULL give zeros."""
    if len(categories) > MAX_CATEGORIES:
        raise ValueError(f"{column} has {len(categories)} categories, over {MAX_CATEGORIES}")
    return df.withColumns({f"{column}_{v}": F.coalesce((F.col(column).cast("string") == v).cast("int"), F.lit(0)) for v in sorted(categories)})


def encoder_stages(numeric: list[str], categorical: list[str], output: str = "features") -> list:
    """Stages of an ML pipeline: alphabetic indices, one-hot blocks without a dropped category, one vector with numeric columns first.

    The labels of each column come to the driver: see require_few_categories.
    """
    from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler

    stages = []
    if categorical:
        index, hot = [f"_{c}_index" for c in categorical], [f"_{c}_hot" for c in categorical]
        stages.append(StringIndexer(inputCols=categorical, outputCols=index, stringOrderType="alphabetAsc", handleInvalid="keep"))
        stages.append(OneHotEncoder(inputCols=index, outputCols=hot, dropLast=True))
    else:
        hot = []
    return [*stages, VectorAssembler(inputCols=[*numeric, *hot], outputCol=output)]
