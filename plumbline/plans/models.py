"""The models of an experiment: a constant mean, and gradient-boosted trees; and how a pipeline of stages is cross-validated."""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.ml import Estimator, Model, Pipeline
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators import prep
from plumbline.operators.boosting import Settings, fit_folds, predicted
from plumbline.operators.columns import Dataset, categorical_columns, numeric_columns
from plumbline.operators.split import FOLDS, ROWS, train_rows, valid_rows


def mean_of_sums() -> Column:
    """The mean of sums `s` of `n` values; NULL where there are none."""
    return F.sum("s") / F.nullif(F.sum("n"), F.lit(0))


@dataclass
class Predictions:
    """rows: pli, key, y, prediction. seconds: those of fit and predict, by fold. held: what is persisted meanwhile."""

    rows: DataFrame
    seconds: dict[int, float]
    held: list[DataFrame] = field(default_factory=list)

    def release(self) -> None:
        for df in self.held:
            df.unpersist()


def target_sums(folded: DataFrame, target: str, *by: Column | str) -> DataFrame:
    """s, n: the dev rows' targets added and counted by fold, and by what else is named."""
    y = F.col(target).cast("double")
    return folded.where("pli IS NOT NULL").groupBy(*by, "pli").agg(F.sum(y).alias("s"), F.count(y).alias("n"))


def kept(sums: DataFrame) -> DataFrame:
    """sums, persisted by a task for each core: a kept table has all partitions of its shuffle, however few rows these have."""
    return sums.coalesce(sums.sparkSession.sparkContext.defaultParallelism).persist()


def means_of_others(sums: DataFrame, *by: str, folds: int = FOLDS) -> DataFrame:
    """mean: by fold (and by what else the sums are), the mean target of all other folds."""
    others = F.filter(F.sequence(F.lit(1), F.lit(folds)), lambda i: i != F.col("pli"))
    return sums.select(*by, F.explode(others).alias("pli"), "s", "n").groupBy(*by, "pli").agg(mean_of_sums().alias("mean"))


def dummy_predictions(folded: DataFrame, key: str, target: str, folds: int = FOLDS) -> DataFrame:
    """The mean target of all other folds, for each dev row: one aggregate of the folds and a map over the rows."""
    means = means_of_others(target_sums(folded, target), folds=folds).withColumnRenamed("mean", "prediction")
    dev = folded.where("pli IS NOT NULL").select("pli", F.col(key), F.col(target).cast("double").alias("y"))
    return dev.join(F.broadcast(means), "pli")  # one row a fold


@dataclass
class Dummy:
    """Predicts the mean of the training rows."""

    def reads(self) -> list[str]:
        return []

    def predictions(self, folded: DataFrame, data: Dataset) -> Predictions:
        """Each fold's time is that of a fit and a prediction of its own; the rows come from one plan for all folds."""
        y, seconds = F.col(data.target).cast("double"), {}
        for fold in range(1, FOLDS + 1):
            start = time.perf_counter()
            mean = train_rows(folded, fold).agg(F.avg(y)).first()[0]
            valid_rows(folded, fold).select(data.key, F.lit(mean).cast("double")).write.format("noop").mode("overwrite").save()
            seconds[fold] = round(time.perf_counter() - start, 2)
        return Predictions(dummy_predictions(folded, data.key, data.target), seconds)


@dataclass
class GroupMean:
    """Predicts the mean of the training rows of the row's group (a column's value, NULL among them), or of all training rows where these have none of it."""

    column: str

    def reads(self) -> list[str]:
        return [self.column]

    def predictions(self, folded: DataFrame, data: Dataset) -> Predictions:
        """Sums by group are kept before rows are joined to them: their size is known then, so that a few groups are sent to all tasks and rows stay where they are."""
        seconds, group = {}, F.col(self.column).alias("_group")
        for fold in range(1, FOLDS + 1):
            start = time.perf_counter()
            sums = kept(target_sums(train_rows(folded, fold).withColumn("pli", F.lit(fold)), data.target, group))
            mean = sums.agg(mean_of_sums()).first()[0]
            valid = valid_rows(folded, fold)
            means = sums.select("_group", (F.col("s") / F.nullif(F.col("n"), F.lit(0))).alias("mean"))
            valid.join(means, valid[self.column].eqNullSafe(F.col("_group")), "left").select(data.key, F.coalesce("mean", F.lit(mean))).write.format("noop").mode("overwrite").save()
            seconds[fold] = round(time.perf_counter() - start, 2)
            sums.unpersist()
        sums = kept(target_sums(folded, data.target, group))
        sums.count()
        return Predictions(group_predictions(folded, data.key, data.target, self.column, sums), seconds, [sums])


def group_predictions(folded: DataFrame, key: str, target: str, column: str, sums: DataFrame, folds: int = FOLDS) -> DataFrame:
    """GroupMean's predictions for each dev row, from the target's sums by `_group` and fold."""
    total = sums.groupBy("pli").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    overall = means_of_others(total, folds=folds).withColumnRenamed("mean", "prediction")
    means = means_of_others(sums, "_group", folds=folds).withColumnRenamed("pli", "_fold")
    dev = folded.where("pli IS NOT NULL").select("pli", F.col(key), F.col(target).cast("double").alias("y"), F.col(column).alias("_own"))
    joined = dev.join(F.broadcast(overall), "pli").join(means, F.col("_own").eqNullSafe(F.col("_group")) & (F.col("pli") == F.col("_fold")), "left")
    return joined.select("pli", key, "y", F.coalesce("mean", "prediction").alias("prediction"))


class MeanRegressor(Estimator):
    """The constant mean as the last stage of a pipeline: predicts the mean of a label column, whatever the features."""

    def __init__(self, label: str, prediction: str = "prediction"):
        super().__init__()
        self.label, self.prediction = label, prediction

    def _fit(self, dataset: DataFrame) -> MeanModel:
        return MeanModel(dataset.agg(F.avg(self.label)).first()[0], self.prediction)


class MeanModel(Model):
    def __init__(self, mean: float | None, prediction: str):
        super().__init__()
        self.mean, self.prediction = mean, prediction

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn(self.prediction, F.lit(self.mean).cast("double"))


def cross_fitted(folded: DataFrame, data: Dataset, last: Callable[[], Estimator], parallel: int = FOLDS) -> tuple[list[DataFrame], dict[int, float]]:
    """A pipeline for each fold: imputed columns, encoders, and the stage that last() makes (label `_y`), fitted on the training rows and applied to the validation rows, folds side by side.

    Returns the validation rows of each fold with all that the pipeline adds, and seconds of fit and predict. Nothing stays persisted. All statistics are of
    training rows. A text column of more than prep.MAX_CATEGORIES categories is an error, as the vectors' width would grow with the data.
    """
    numeric, categorical = numeric_columns(data.df, data.features), categorical_columns(data.df, data.features)
    named = folded.where("pli IS NOT NULL").withColumn("_y", F.col(data.target).cast("double"))
    held = named.select("*").persist()
    dev = held.coalesce(max(1, -(-held.count() // ROWS)))
    prep.require_few_categories(dev, categorical)
    known = prep.statistics_by_fold(dev, numeric, categorical)

    def one(fold: int) -> tuple[DataFrame, float]:
        have = known[fold]
        num, cat = [c for c in numeric if c in have], [c for c in categorical if c in have]  # columns without any value go
        train, valid = (prep.impute(rows, num, cat, known, fold) for rows in (train_rows(dev, fold), valid_rows(dev, fold)))
        start = time.perf_counter()
        model = Pipeline(stages=[*prep.encoder_stages(num, cat), last()]).fit(train)
        model.transform(valid).write.format("noop").mode("overwrite").save()  # transform alone computes nothing
        return model.transform(prep.impute(valid_rows(named, fold), num, cat, known, fold)), round(time.perf_counter() - start, 2)

    try:
        with ThreadPoolExecutor(parallel) as pool:
            results = list(pool.map(one, range(1, FOLDS + 1)))
    finally:
        held.unpersist()
    return [rows for rows, _ in results], {i: s for i, (_, s) in enumerate(results, 1)}


@dataclass
class BoostedTrees:
    """Second-order boosted trees, all folds grown together (operators/boosting.py). seconds: each fold's own work in tasks; what folds share, such as starting jobs, is in none."""

    settings: Settings = field(default_factory=Settings)
    #: Columns to learn from: all but the target, unless named.
    features: list[str] | None = None

    def predictions(self, folded: DataFrame, data: Dataset) -> Predictions:
        dev = folded.where("pli IS NOT NULL")
        held = [] if folded.is_cached else [dev.persist()]
        # a level of a tree is a job over all rows: one task where they are few, else those that the rows are dealt to
        few = dev.coalesce(1) if dev.count() <= ROWS else dev
        enc, forests, seconds = fit_folds(few, data, self.settings, features=self.features)
        named = dev.withColumn("y", F.col(data.target).cast("double"))
        return Predictions(predicted(named, data, enc, forests, ["pli", data.key, "y"]), {i: round(s, 2) for i, s in seconds.items()}, held)


def default_models() -> dict[str, Callable]:
    """Models by name; results follow this order."""
    return {"Dummy": Dummy(), "GBT": BoostedTrees()}
