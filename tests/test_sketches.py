"""Sketches by day against exact figures: merged weeks, a hot day, a day sketched anew, no values."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.functions import sketches

SCHEMA = "day string, user long, value double"


def close(rows, told, q):
    users, values = {u for _, u, _ in rows if u is not None}, sorted(v for *_, v in rows if v is not None and v == v)
    assert abs(told.n_distinct - len(users)) <= sketches.DISTINCT_ERROR * len(users)
    for at, got in zip(q, told.quantiles, strict=True):
        below, upto = sum(v < got for v in values) / len(values), sum(v <= got for v in values) / len(values)
        assert max(0.0, below - at, at - upto) <= sketches.RANK_ERROR


def test_days_merge(spark, tmp_path):
    r = random.Random(5)
    rows = [("d1" if r.random() < 0.9 else r.choice(["d2", "d3", None]), r.choice([None, r.randrange(30_000)]), r.choice([None, float("nan"), r.gauss(0, 1), float(round(r.gauss(0, 1)))])) for _ in range(60_000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(8)
    path, q = str(tmp_path / "days"), [0.0, 0.1, 0.5, 0.99, 1.0]
    days = sketches.sketched(df, ["day"], "user", "value")
    assert "partial_hll_sketch_agg" in days._jdf.queryExecution().executedPlan().toString()
    sketches.store(days, path, "day")
    stored = spark.read.parquet(path)
    every = sketches.estimates(sketches.merged(stored, []), q).first()
    assert every.n_rows == len(rows)
    close(rows, every, q)
    for told in sketches.estimates(stored, q).collect():
        own = [x for x in rows if x[0] == told.day]
        assert told.n_rows == len(own)
        close(own, told, q)
    anew = [("d2", 1, 5.0), ("d2", 2, 7.0)]
    sketches.store(sketches.sketched(spark.createDataFrame(anew, SCHEMA), ["day"], "user", "value"), path, "day")
    told = {x.day: x for x in sketches.estimates(spark.read.parquet(path), [0.0, 1.0]).collect()}
    assert (told["d2"].n_rows, told["d2"].n_distinct, told["d2"].quantiles) == (2, 2, [5.0, 7.0])
    assert told["d1"].n_rows == sum(x[0] == "d1" for x in rows)


def test_no_values(spark):
    df = spark.createDataFrame([("d1", None, None), ("d1", None, float("nan"))], SCHEMA)
    told = sketches.estimates(sketches.merged(sketches.sketched(df, ["day"], "user", "value"), ["day"]), [0.5]).first()
    assert (told.n_rows, told.n_distinct, told.quantiles) == (2, 0, None)
    assert sketches.estimates(sketches.sketched(df.where("false"), ["day"], "user", "value"), [0.5]).count() == 0
    with pytest.raises(ValueError, match="n_rows"):
        sketches.sketched(df.withColumn("n_rows", F.lit(1)), ["n_rows"], "user", "value")
