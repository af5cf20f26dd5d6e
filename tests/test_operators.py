"""Metrics on known vectors, splits, imputation, CSV, and a whole experiment."""

import math
from dataclasses import dataclass

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import metrics as M
from plumbline.operators import columns, prep, split
from plumbline.operators.boosting import Settings
from plumbline.operators.columns import Dataset
from plumbline.plans import experiment
from plumbline.plans.models import BoostedTrees, Dummy
from plumbline.sources import tables


def measured(spark, y, p):
    rows = [tuple(None if v is None else float(v) for v in r) for r in zip(y, p, strict=True)]
    return M.compute_metrics(spark.createDataFrame(rows, "y double, p double"), "y", "p").first()


def test_known_metrics(spark):
    assert measured(spark, [100, 200, 300], [110, 190, 300]).mae == pytest.approx(20 / 3, abs=1e-9)
    assert measured(spark, [0, 0], [3, 4]).rmse == pytest.approx(12.5**0.5, abs=1e-9)
    assert measured(spark, [0, 0], [3, 4]).r2 is None
    perfect = measured(spark, [1, 2, 3], [1, 2, 3])
    assert (perfect.mae, perfect.r2) == (0, 1) and tuple(perfect.asDict()) == M.NAMES
    clipped = measured(spark, [1, 2, 3], [-5, 2, 2.5])
    assert tuple(clipped) == pytest.approx((2.1666667, 3.4761089, 0.4075470, -17.125), abs=1e-6)
    missing = measured(spark, [1.0, 2.0], [1.0, None])
    assert all(missing[m] is None for m in M.NAMES)
    assert math.isinf(measured(spark, [-1.0, 2.0], [1.0, 2.0]).rmsle) and math.isnan(measured(spark, [-3.0, 2.0], [1.0, 2.0]).rmsle)


@pytest.mark.parametrize("n", [0, 1, 4, 7, 1003])
def test_split_sizes(spark, n):
    df = spark.range(n).withColumnRenamed("id", "k")
    rows = split.with_folds(df, "k").collect()
    hold, dev = [r for r in rows if r.is_hold], [r for r in rows if not r.is_hold]
    assert len(hold) == math.ceil(0.2 * n) and all(r.pli is None for r in hold)
    assert [sum(r.pli == i for r in dev) for i in range(1, 6)] == [len(dev) // 5 + (i <= len(dev) % 5) for i in range(1, 6)]


def test_split_refines_crowded_digits(spark, monkeypatch):
    monkeypatch.setattr(split, "FEW", 2)
    monkeypatch.setattr(split, "DIGITS", 1)
    test_split_sizes(spark, 1003)


def test_repeated_and_null_keys_stay_together(spark):
    df = spark.createDataFrame([(1, 0.0)] * 9 + [(None, 1.0)] * 5 + [(i, 2.0) for i in range(2, 40)], "k long, y double")
    sides = split.with_folds(df, "k").groupBy("k").agg(F.count_distinct(F.struct("is_hold", F.coalesce("pli", F.lit(0)))).alias("n"))
    assert sides.where("n > 1").isEmpty()


def test_compat_holdout():
    # The first and last recorded holdout ids, their number, and their sums, plain and by place.
    first, last = [892, 1105, 413, 522, 1036, 614, 218, 1160, 649, 887, 576, 1252], [1361, 802, 651, 722]
    n, total, by_place = 292, 212541, 31864496
    # End of the fixed values.
    ids = split.compat_holdout(1460).tolist()
    assert (len(ids), sum(ids), sum(i * k for k, i in enumerate(ids, 1))) == (n, total, by_place)
    assert ids[:12] == first and ids[-4:] == last


def test_recorded_summary(spark):
    """The recorded means from the recorded fold scores."""
    # Recorded fold scores and their means.
    scores = {
        "Dummy": [
            (59576.84202675744, 80423.48734912589, 0.41261890146912705, -0.0006384941115065157, 0.07), (58663.60914365197, 76575.0080208489, 0.4077192484359457, -0.0017788629741464224, 0.03),
            (56690.29093687658, 82224.43005984665, 0.4138783114005585, -0.003855245142650565, 0.03), (53296.4267287875, 73940.98368050758, 0.3826827132752775, -0.0017002096359504115, 0.03),
            (53363.992550090654, 72636.63317324512, 0.37243312611117335, -0.00014234814879321434, 0.03),
        ],
        "XGBoost": [
            (15489.565504807691, 25377.57098437644, 0.13014058817920307, 0.9003650961459166, 1.89), (16044.418402777777, 33074.33676900039, 0.13187014885674084, 0.8131125878157258, 0.32),
            (17464.847756410258, 33466.58674783346, 0.15561225299948167, 0.8337000223674486, 0.29), (15111.658161212446, 22486.28364088852, 0.1119310677917976, 0.9073591170053332, 0.29),
            (14011.885193133046, 21273.421161972685, 0.10627029388145529, 0.9142122887216361, 0.32),
        ],
    }
    means = {"Dummy": (56318.232277232826, 77160.10845671482, 0.3978664601384164, -0.0016230320026094259, 0.038), "XGBoost": (15624.475003668244, 27135.6398608143, 0.12716487034173568, 0.8737498224112121, 0.622)}
    # End of the fixed values.
    records = [{"modele": m, "pli": i, **dict(zip([*M.NAMES, "temps_s"], row, strict=True))} for m, rows in scores.items() for i, row in enumerate(rows, 1)]
    detail = tables.from_records(spark, records, experiment.DETAIL)
    got = experiment.summary(detail).collect()
    assert [r.modele for r in got] == list(means)
    assert all(tuple(r)[1:] == pytest.approx(means[r.modele], rel=1e-12) for r in got)
    assert experiment.improvement(detail, "XGBoost", "Dummy").first()[0] == pytest.approx(72.26, abs=0.005)


def test_medians_and_modes_are_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(i, int(rng.integers(1, 6)), None if i % 11 == 0 else float(rng.choice([1.0, 1.0, 7.5, rng.normal() * 50])), None if i % 7 == 0 else str(rng.integers(0, 4)), None) for i in range(1500)]
    df = spark.createDataFrame(rows, "k long, pli int, x double, c string, empty double")
    got = prep.statistics_by_fold(df, ["x", "empty"], ["c"])
    for i in range(1, 6):
        xs = [r[2] for r in rows if r[1] != i and r[2] is not None]
        cs = [r[3] for r in rows if r[1] != i and r[3] is not None]
        assert got[i] == {"x": pytest.approx(float(np.median(xs)), abs=0), "c": min(set(cs), key=lambda v: (-cs.count(v), v))}


def test_one_hot_unknown_and_width(spark):
    df = spark.createDataFrame([(1, "a"), (2, "z"), (3, "c"), (4, None)], "k long, c string")
    got = prep.one_hot_columns(df, "c", ["b", "a", "c"])
    assert got.columns == ["k", "c", "c_a", "c_b", "c_c"] and [tuple(r)[2:] for r in got.orderBy("k").collect()] == [(1, 0, 0), (0, 0, 0), (0, 0, 1), (0, 0, 0)]
    with pytest.raises(KeyError):
        columns.drop(df, ["no"])


def test_csv(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('i,x,b,s\n1,None,true,NA\n,"",false,3\n4,2.5,,x\n')
    df = tables.read_csv(spark, str(path))
    assert df.dtypes == [("i", "bigint"), ("x", "double"), ("b", "boolean"), ("s", "string")]
    assert [tuple(r) for r in df.collect()] == [(1, None, True, None), (None, None, False, "3"), (4, 2.5, None, "x")]
    assert [tuple(r) for r in tables.read_csv(spark, str(path), "s int, i string").collect()] == [(None, "1"), (3, None), (None, "4")]


def test_experiment_writes_its_tables(spark, tmp_path):
    df = spark.range(200).select(F.col("id").alias("k"), (F.col("id") % 7).cast("double").alias("y"))
    detail, means = experiment.run(Dataset(df, "k", "y"), str(tmp_path), {"Dummy": Dummy()})
    assert detail.columns == ["modele", "pli", "mae", "rmse", "rmsle", "r2", "temps_s"] and detail.count() == 5
    assert means.columns == ["modele", "mae", "rmse", "rmsle", "r2", "temps_s"]
    assert tables.read_csv(spark, str(tmp_path / "holdout_ids")).count() == 40
    scored = {r.row_id for r in tables.read_csv(spark, str(tmp_path / "holdout_ids")).collect()}
    assert scored.isdisjoint({r.k for r in experiment.folded(Dataset(df, "k", "y")).where("pli IS NOT NULL").collect()})


@dataclass
class Watched:
    """A model that keeps the validation rows that it was asked for."""

    model: object
    folds: dict

    def predictions(self, folded, data):
        out = self.model.predictions(folded, data)
        self.folds |= {r.k: r.pli for r in out.rows.select("k", "pli").collect()}
        return out


def test_two_models_in_one_experiment(spark, tmp_path):
    """Boosted trees beat the mean; both have the same folds, in the order given, and times of their own; the holdout stays closed."""
    df = tables.parquet(spark, "/root/testdata/sf0.001", "part").select(F.col("p_partkey").alias("k"), "p_brand", "p_type", "p_size", F.col("p_retailprice").alias("y"))
    gaps = df.withColumns({"p_size": F.when(F.col("k") % 7 != 0, F.col("p_size")), "p_brand": F.when(F.col("k") % 11 != 0, F.col("p_brand"))})
    trees = BoostedTrees(Settings(rounds=12, depth=3, rate=0.3))
    one, two = Watched(trees, {}), Watched(Dummy(), {})
    detail, means = experiment.run(Dataset(gaps, "k", "y"), str(tmp_path), {"Trees": one, "Mean": two})
    rows = detail.collect()
    assert [(r.modele, r.pli) for r in rows] == [(m, i) for m in ("Trees", "Mean") for i in range(1, 6)]
    assert one.folds == two.folds and len(one.folds) == 160
    hold = {r.row_id for r in tables.read_csv(spark, str(tmp_path / "holdout_ids")).collect()}
    assert hold.isdisjoint(one.folds) and len(hold) == 40
    mae = {r.modele: r.mae for r in means.collect()}
    assert mae["Trees"] < 0.5 * mae["Mean"]
    assert all(r.temps_s > 0 and round(r.temps_s, 2) == r.temps_s for r in rows)
    assert experiment.wide(detail, "mae", ["Mean", "Trees"]).columns == ["pli", "MAE_mean", "MAE_trees"]


def test_aligned_arrays(spark):
    df = tables.from_arrays(spark, {"pli": [1, 2], "MAE_a": [0.5, 0.25]}, "pli int, MAE_a double")
    assert [tuple(r) for r in df.collect()] == [(1, 0.5), (2, 0.25)]
    with pytest.raises(ValueError):
        tables.from_arrays(spark, {"pli": [1, 2], "MAE_a": [0.5]}, "pli int, MAE_a double")


def test_too_many_categories(spark, monkeypatch):
    df = spark.range(50).select(F.col("id").cast("string").alias("c"), F.lit("x").alias("d"))
    prep.require_few_categories(df, ["c", "d"])
    monkeypatch.setattr(prep, "MAX_CATEGORIES", 20)
    with pytest.raises(ValueError, match="'c'"):
        prep.require_few_categories(df, ["c", "d"])
    prep.require_few_categories(df, ["d"])


def test_description(spark):
    df = spark.createDataFrame([(1, 1.5), (2, 2.5), (3, 9.9), (4, 4.4), (5, None)], "k long, y double")
    assert experiment.describe(Dataset(df, "k", "y")) == {"n_rows": 5, "n_columns": 2, "n_features": 1, "median_y": 3, "min_y": 1, "max_y": 9}
    assert experiment.describe(Dataset(df.limit(0), "k", "y"))["median_y"] is None


def test_csv_with_line_ends(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('a,b\n1,"x\ny"\n')
    assert [tuple(r) for r in tables.read_csv(spark, str(path), multi_line=True).collect()] == [(1, "x\ny")]


def test_broken_values_are_counted(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n1,x\nNA,2\n1.5,\ntwo,3\n")
    path, schema = str(tmp_path / "t.csv"), "a bigint, b bigint"
    assert sorted(map(tuple, tables.broken_values(spark, path, schema).collect())) == [("a", 2, "1.5"), ("b", 1, "x")]
    assert [tuple(r) for r in tables.read_csv(spark, path, schema).collect()] == [(1, None), (None, 2), (None, None), (None, 3)]
    assert tables.broken_values(spark, path, "a string, b string").isEmpty()
    (tmp_path / "e.csv").write_text("a,b\n")
    assert tables.broken_values(spark, str(tmp_path / "e.csv"), schema).isEmpty()
