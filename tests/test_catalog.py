"""The SQL functions against the aggregate columns, NULLs, NaN and constant truths included."""

import math

from plumbline.functions import catalog
from plumbline.functions import metrics as M

NAN = float("nan")
ROWS = [("a", 1.0, 2.0), ("a", 5.0, -3.0), ("a", 2.5, 2.5), ("null", 1.0, None), ("null", 2.0, 2.0), ("const", 3.0, 4.0), ("const", 3.0, 1.0), ("nan", NAN, 1.0), ("nan", 2.0, 1.0), ("low", -1.0, 2.0), ("low", 3.0, 2.0), ("lower", -2.0, 2.0), ("lower", 3.0, 2.0)]
MEANS = {"mae": "avg(abs_error(y, p))", "rmse": "avg(squared_error(y, p))", "rmsle": "avg(squared_log_error(y, p))", "r2": "sum(squared_error(y, p)), var_pop(y) * count(y)"}


def test_functions(spark):
    catalog.register(spark)
    catalog.register(spark)
    df = spark.createDataFrame(ROWS, "k string, y double, p double")
    told = ", ".join(f"{name}({mean}, count_if(unpaired(y, p))) AS {name}" for name, mean in MEANS.items())
    got = spark.sql(f"SELECT k, {told} FROM {{t}} GROUP BY k", t=df)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "partial_avg" in plan
    assert "Python" not in plan
    want = {r.k: r for r in M.compute_metrics(df, "y", "p", ["k"]).collect()}
    assert len(want) == got.count()
    for r in got.collect():
        for name in M.NAMES:
            a, b = r[name], want[r.k][name]
            assert (a is None and b is None) or (a is not None and b is not None and (math.isclose(a, b, rel_tol=1e-12) or (math.isnan(a) and math.isnan(b)))), (r.k, name, a, b)
    assert spark.sql("SELECT mae(avg(abs_error(y, p)), count_if(unpaired(y, p))) AS m FROM {t}", t=df.where("false")).first().m is None
