"""The metrics as SQL functions.

Two kinds, as an SQL function's body can't aggregate: of a row (abs_error, squared_error, squared_log_error, unpaired), and of a group, which make the metric of the averages. Catalyst puts their bodies in place of the calls, so averages are summed
in part before the shuffle and no row leaves the JVM:

    SELECT brand, mae(avg(abs_error(y, p)), count_if(unpaired(y, p))) AS mae,
      r2(sum(squared_error(y, p)), var_pop(y) * count(y), count_if(unpaired(y, p))) AS r2 FROM guesses GROUP BY brand

NULLs, NaN and constant truths are treated as in plumbline.functions.metrics.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

FUNCTIONS = {
    "abs_error(y DOUBLE, p DOUBLE) RETURNS DOUBLE": "abs(y - p)",
    "squared_error(y DOUBLE, p DOUBLE) RETURNS DOUBLE": "(y - p) * (y - p)",
    "log_1p(x DOUBLE) RETURNS DOUBLE": "CASE WHEN x < -1 THEN double('NaN') WHEN x = -1 THEN double('-Infinity') ELSE log1p(x) END",
    "squared_log_error(y DOUBLE, p DOUBLE) RETURNS DOUBLE": "power(log_1p(CASE WHEN p IS NOT NULL THEN greatest(p, 0D) END) - log_1p(y), 2)",
    "unpaired(y DOUBLE, p DOUBLE) RETURNS BOOLEAN": "y IS NULL OR p IS NULL",
    "mae(mean_abs_error DOUBLE, n_unpaired BIGINT) RETURNS DOUBLE": "CASE WHEN n_unpaired = 0 THEN mean_abs_error END",
    "rmse(mean_squared_error DOUBLE, n_unpaired BIGINT) RETURNS DOUBLE": "CASE WHEN n_unpaired = 0 THEN sqrt(mean_squared_error) END",
    "rmsle(mean_squared_log_error DOUBLE, n_unpaired BIGINT) RETURNS DOUBLE": "CASE WHEN n_unpaired = 0 THEN sqrt(mean_squared_log_error) END",
    "r2(squared_errors DOUBLE, squares_around_mean DOUBLE, n_unpaired BIGINT) RETURNS DOUBLE": "CASE WHEN n_unpaired = 0 THEN 1 - squared_errors / nullif(squares_around_mean, 0D) END",
}


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session. Called again, it replaces them."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
