"""What experiments do once, and by as many tasks as there are cores, however many models and folds there are."""

import pytest
from pyspark.sql import functions as F

from plumbline.operators import boosting, split
from plumbline.operators.columns import Dataset
from plumbline.plans import experiment as X
from plumbline.plans import models
from plumbline.plans.models import Dummy, GroupMean
from plumbline.sources.tables import from_records


@pytest.mark.parametrize("few", [1_000, 50])
def test_rows_are_read_once_for_all_models_and_folds(spark, monkeypatch, few):
    """One task, or a task for each core: the target of a dev row is computed once, that of the holdout never."""
    monkeypatch.setattr(split, "ROWS", few, raising=False)
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def watched(x):
        seen.add(1)
        return float(x)

    df = spark.range(200).select(F.col("id").alias("k"), (F.col("id") % 3).cast("string").alias("g"), watched(F.col("id") % 7).alias("y"))
    data = Dataset(df, "k", "y")
    rows = X.cross_validate(X.folded(data), data, {"Mean": Dummy(), "Group": GroupMean("g")}).collect()
    assert [(r.modele, r.pli) for r in rows] == [(m, i) for m in ("Mean", "Group") for i in range(1, 6)]
    assert seen.value == 160
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == 0


def test_dealt(spark, monkeypatch):
    monkeypatch.setattr(split, "ROWS", 50)
    df = spark.range(0, 200, 1, 1)
    out = split.dealt(df, "id", 200)
    assert out.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and sorted(r.id for r in out.collect()) == list(range(200))
    assert split.dealt(df, "id", 50).rdd.getNumPartitions() == 1
    monkeypatch.setattr(split, "MOST", 20)
    assert split.dealt(df, "id", 200).rdd.getNumPartitions() == 10


def test_trees_are_grown_by_all_cores(spark, monkeypatch):
    """Rows of one partition, more than one pack has: each core has a share. Sums added on the driver or by tasks give the same trees, and those of one task with all rows."""
    tasks, fit = [], boosting.fit_folds
    monkeypatch.setattr(models, "fit_folds", lambda dev, *a, **b: tasks.append(dev.rdd.getNumPartitions()) or fit(dev, *a, **b))
    k = F.col("id")
    df = spark.range(0, 200, 1, 1).select(k.alias("k"), F.when(k % 7 > 0, (k % 9).cast("double")).alias("x"), F.when(k % 5 > 0, (k % 4).cast("string")).alias("g"), (k % 9 + k % 4).cast("double").alias("y"))
    data, found = Dataset(df, "k", "y"), []
    trees = {"Trees": models.BoostedTrees(boosting.Settings(rounds=2, depth=2, rate=0.5), features=["x", "g"])}
    for rows, most in ((50, 32_000_000), (50, 0), (1_000, 0)):
        for module in (split, models, boosting):
            monkeypatch.setattr(module, "ROWS", rows, raising=False)
        monkeypatch.setattr(boosting, "SUMS", most, raising=False)
        found.append([r.mae for r in X.cross_validate(X.folded(data), data, trees).collect()])
    assert tasks == [*[spark.sparkContext.defaultParallelism] * 2, 1]
    assert found[0] == pytest.approx(found[2], rel=1e-9) and found[1] == pytest.approx(found[2], rel=1e-9)
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == 0


def _watched(spark, value):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def watched(x):
        seen.add(1)
        return value(x)

    return seen, watched


def test_keys_are_read_once_for_all_borders_and_hashed_by_all_cores(spark, monkeypatch):
    """Rows of one partition, more than one task may have, and borders that take several rounds of counting."""
    tasks, statistics = [], split.order_statistics
    monkeypatch.setattr(split, "ROWS", 50)
    monkeypatch.setattr(split, "FEW", 1)
    monkeypatch.setattr(split, "order_statistics", lambda orders, ranks: tasks.append(orders.rdd.getNumPartitions()) or statistics(orders, ranks))
    seen, watched = _watched(spark, lambda x: x)
    rows = split.with_folds(spark.range(0, 200, 1, 1).select(watched("id").alias("k")), "k")
    assert tasks == [spark.sparkContext.defaultParallelism] and seen.value == 200
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("md5(") == 1
    assert sorted((r.pli or 0, r["count"]) for r in rows.groupBy("pli").count().collect()) == [(0, 40), *((i, 32) for i in range(1, 6))]
    assert rows.columns == ["k", "is_hold", "pli"] and spark.sparkContext._jsc.getPersistentRDDs().size() == 0


def test_columns_that_no_model_reads_are_not_kept(spark):
    seen, watched = _watched(spark, lambda x: x)
    k = F.col("id")
    data = Dataset(spark.range(200).select(k.alias("k"), (k % 3).cast("string").alias("g"), watched("id").alias("unread"), (k % 7).cast("double").alias("y")), "k", "y")
    X.cross_validate(X.folded(data), data, {"Mean": Dummy(), "Group": GroupMean("g")}).collect()
    assert seen.value == 0
    trees = models.BoostedTrees(boosting.Settings(rounds=1, depth=1), features=["unread"])
    X.cross_validate(X.folded(data), data, {"Mean": Dummy(), "Trees": trees}).collect()  # a model that doesn't say what it reads has all
    assert seen.value == 160


def test_a_group_may_be_a_field_or_named_in_capitals(spark):
    k = F.col("id")
    data = Dataset(spark.range(200).select(k.alias("k"), F.struct((k % 3).alias("g")).alias("s"), (k % 3).alias("g"), (k % 7).cast("double").alias("y")), "k", "y")
    by = {name: {r.pli: r.mae for r in X.cross_validate(X.folded(data), data, {"Group": GroupMean(name)}).collect()} for name in ("g", "G", "s.g")}
    assert len(by["g"]) == 5 and by["g"] == pytest.approx(by["G"]) and by["g"] == pytest.approx(by["s.g"])


def test_rows_are_not_shuffled_to_the_means_of_few_groups(spark):
    """The rows are larger than what is broadcast, the means of their groups are not."""
    k, limit = F.col("id"), "spark.sql.autoBroadcastJoinThreshold"
    data = Dataset(spark.range(20_000).select(k.alias("k"), F.when(k % 4 > 0, (k % 4).cast("string")).alias("g"), (k % 7).cast("double").alias("y")), "k", "y")
    dev, before = X.folded(data).where("NOT is_hold").persist(), spark.conf.get(limit)
    spark.conf.set(limit, "50k")
    try:
        train = dev.select("k", "g", "pli", "y").collect()
        predicted = GroupMean("g").predictions(dev, data)
        plan = predicted.rows._jdf.queryExecution().executedPlan().toString()
        rows = {r.k: r for r in predicted.rows.collect()}
        predicted.release()
    finally:
        spark.conf.set(limit, before)
        dev.unpersist()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan and plan.count("BroadcastHashJoin") == 2
    of = {}
    for r in train:
        of.setdefault((r.g, r.pli), []).append(r.y)
    for r in train:
        others = [(sum(ys), len(ys)) for (g, i), ys in of.items() if g == r.g and i != r.pli]
        assert rows[r.k].prediction == pytest.approx(sum(s for s, _ in others) / sum(n for _, n in others)) and rows[r.k].y == r.y
    assert len(rows) == len(train) == 16_000 and spark.sparkContext._jsc.getPersistentRDDs().size() == 0


def test_a_table_of_records_is_read_without_tasks(spark):
    made = from_records(spark, [{"a": "x", "b": 1, "c": None}, {"a": None, "b": None, "c": 2.5}], "a string, b int, c double")
    assert [tuple(r) for r in made.collect()] == [("x", 1, None), (None, None, 2.5)]
    assert made.schema.simpleString() == "struct<a:string,b:int,c:double>" and "LocalTableScan" in made._jdf.queryExecution().executedPlan().toString()
    assert from_records(spark, [], "a string, b int").collect() == []
