"""Boosted trees of all folds against trees grown in plain numpy on imputed, one-hot encoded matrices; packs of many tasks; edge rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.operators import boosting as B
from plumbline.operators.columns import Dataset
from plumbline.plans import experiment as X

SCHEMA = "id long, size double, weight double, colour string, y double"


def table(spark, n=240, seed=1):
    rng = np.random.default_rng(seed)
    size, weight, colour = rng.integers(0, 9, n).astype(float), rng.integers(0, 5, n) / 2, rng.choice(["red", "blue", "green", "rare"], n, p=[0.4, 0.3, 0.28, 0.02])
    y = 3 * size + 10 * (colour == "red") - size * weight + rng.normal(0, 0.5, n)
    rows = [(i, None if i % 11 == 0 else float(size[i]), float("nan") if i % 13 == 0 else float(weight[i]), None if i % 7 == 0 else str(colour[i]), float(y[i])) for i in range(n)]
    return Dataset(spark.createDataFrame(rows, SCHEMA), "id", "y")


def plain(df, features, s):
    """Predictions of each row by its fold's model."""
    out = pd.Series(np.nan, index=df.index)
    for fold in sorted(df["pli"].unique()):
        train, columns = df[df["pli"] != fold], []
        for c in features:
            if c == "colour":
                counts = train[c].value_counts()
                mode = min(counts[counts == counts.max()].index)
                known = sorted(df[c].dropna().unique())
                columns += [(df[c].fillna(mode) == v).to_numpy(dtype=float) for v in known]
            else:
                columns.append(df[c].fillna(train[c].median()).to_numpy(dtype=float))
        x, own, y = np.array(columns), (df["pli"] != fold).to_numpy(), df["y"].to_numpy()
        one_hot = len(columns) - len(features) + 1 if "colour" in features else 0
        p = np.full(len(df), y[own].mean())

        def grow(rows, depth, g, x=x, own=own, one_hot=one_hot):
            """Value of every row of `rows` (a mask), from the training rows in it."""
            t = rows & own
            total, best = (g[t].sum(), t.sum()), None
            for k, column in enumerate(x):
                hot = k >= len(x) - one_hot
                for v in [1.0] if hot else np.unique(column[own])[:-1]:
                    holds = column == 1 if hot else column <= v
                    gl, hl = g[t & holds].sum(), (t & holds).sum()
                    gr, hr = total[0] - gl, total[1] - hl
                    if hl < 1 or hr < 1:
                        continue
                    gain = gl**2 / (hl + s.l2) + gr**2 / (hr + s.l2) - total[0] ** 2 / (total[1] + s.l2)
                    if gain > 1e-6 and (best is None or gain > best[0] * (1 + 1e-10)):
                        best = (gain, holds)
            if depth == 0 or best is None:
                return np.where(rows, -s.rate * total[0] / (total[1] + s.l2), 0)
            return grow(rows & best[1], depth - 1, g) + grow(rows & ~best[1], depth - 1, g)

        for _ in range(s.rounds):
            p = p + grow(np.ones(len(df), dtype=bool), s.depth, p - y)
        out[df["pli"] == fold] = p[(df["pli"] == fold).to_numpy()]
    return out


def run(data, dev, s, features):
    enc, forests, seconds = B.fit_folds(dev, data, s, features=features)
    assert set(seconds) == set(forests)
    return {r.id: r.prediction for r in B.predicted(dev, data, enc, forests, ["id"]).collect()}, forests


@pytest.mark.parametrize("parts", [1, 3])
def test_against_plain_trees(spark, parts):
    """One task with all rows, and three whose sums meet."""
    data, features = table(spark), ["size", "weight", "colour"]
    dev = X.folded(data).where("pli IS NOT NULL").repartition(parts, "id").persist()
    s = B.Settings(rounds=5, depth=3, rate=0.4, row_share=1.0, column_share=1.0)
    got, forests = run(data, dev, s, features)
    df = dev.toPandas().sort_values("id").reset_index(drop=True)
    want = plain(df, features, s)
    assert [got[i] for i in df["id"]] == pytest.approx(list(want), rel=1e-9)
    assert all(len(f.trees) == 5 for f in forests.values())
    dev.unpersist()


def test_samples_do_not_depend_on_tasks(spark, monkeypatch):
    """Rows and columns are drawn alike in one task and in four, over a checkpoint."""
    monkeypatch.setattr(B, "CUT", 3)
    data, features = table(spark), ["size", "weight", "colour"]
    s = B.Settings(rounds=8, depth=3, rate=0.3, row_share=0.7, column_share=0.6)
    dev = X.folded(data).where("pli IS NOT NULL").persist()
    one, _ = run(data, dev.coalesce(1), s, features)
    many, _ = run(data, dev.repartition(4, "id"), s, features)
    assert one == pytest.approx(many, rel=1e-9)
    other, _ = run(data, dev.coalesce(1), B.Settings(rounds=8, depth=3, rate=0.3, row_share=0.7, column_share=0.6, seed=7), features)
    assert other != one
    dev.unpersist()


def test_shares():
    keys = np.random.default_rng(3).integers(0, 2**63, 50_000).astype(np.uint64)
    a, b = B.drawn_rows(keys, 0.8, 42, 1, 0), B.drawn_rows(keys, 0.8, 42, 1, 1)
    assert abs(a.mean() - 0.8) < 0.01 and abs((a & b).mean() - 0.64) < 0.01
    starts, text = np.array([0, 10, 14]), np.array([False, True])
    drawn = B.drawn_columns(starts, text, 0.5, 42, 1, 0)
    assert drawn[:10].all() or not drawn[:10].any()
    assert drawn[10:].sum() + drawn[0] == 2


def test_edges(spark):
    """A constant column, a text column without values, a fold whose category no other has, and no rows."""
    rows = [(i, 1.0, float(i), None, float(i % 5)) for i in range(50)]
    data = Dataset(spark.createDataFrame(rows, SCHEMA), "id", "y")
    dev = X.folded(data).where("pli IS NOT NULL").withColumn("colour", F.when(F.col("pli") == 2, "own"))
    got, _ = run(data, dev.coalesce(1), B.Settings(rounds=3, depth=2), ["size", "weight", "colour"])
    assert len(got) == 40 and all(0 <= v <= 4 for v in got.values())
    none, forests = run(data, dev.limit(0), B.Settings(rounds=3), ["size", "weight", "colour"])
    assert none == {} and forests == {}
    with pytest.raises(ValueError, match="missing"):
        B.fit_folds(dev.withColumn("y", F.lit(None).cast("double")), data, B.Settings(rounds=1))


def test_nothing_stays_persisted(spark):
    from plumbline.plans.queries import QUERIES

    held = lambda: spark.sparkContext._jsc.getPersistentRDDs().size()
    before = held()
    for name in ("cv_stumps", "cv_pipeline", "features_assembled"):
        assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
        assert held() == before, name
