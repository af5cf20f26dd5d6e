"""Cross-validated experiments: holdout kept closed, the same folds for every model, four metrics a fold, a summary and a report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import formats
from plumbline.functions.metrics import NAMES, compute_metrics, improvement_pct
from plumbline.operators import prep, split
from plumbline.operators.columns import Dataset, categorical_columns, numeric_columns
from plumbline.plans.models import default_models
from plumbline.sources.tables import from_records, write_csv

DETAIL = "modele string, pli int, mae double, rmse double, rmsle double, r2 double, temps_s double"


def folded(data: Dataset, seed: int = split.SEED) -> DataFrame:
    return split.with_folds(data.df, data.key, seed=seed)


def read_by(rows: DataFrame, data: Dataset, models: dict) -> DataFrame:
    """rows without the columns that no model reads; with all, where a model doesn't say what it reads."""
    reads = [model.reads() if hasattr(model, "reads") else None for model in models.values()]
    if None in reads:
        return rows
    kept = {c.strip("`").lower() for c in (data.key, data.target, "is_hold", "pli", *(c for columns in reads for c in columns))}
    kept |= {c.split(".")[0] for c in kept}  # a field's column
    return rows.drop(*[c for c in rows.columns if c.lower() not in kept])


def cross_validate(rows: DataFrame, data: Dataset, models: dict) -> DataFrame:
    """DETAIL: a row for each model and fold, in that order. Only dev rows are read: the holdout has no fold. They are read and given their folds once, and kept, with the columns that models read, while these are fitted."""
    records = []
    dev = split.dealt(read_by(rows, data, models).where("NOT is_hold"), data.key, rows.count()).persist()
    try:
        for name, model in models.items():
            predicted = model.predictions(dev, data)
            found = {r.pli: r for r in compute_metrics(predicted.rows, "y", "prediction", ["pli"]).collect()}  # one row a fold
            predicted.release()
            records += [{"modele": name, "pli": i, "temps_s": predicted.seconds[i], **{m: r[m] for m in NAMES}} for i, r in sorted(found.items())]
    finally:
        dev.unpersist()
    return from_records(rows.sparkSession, records, DETAIL)


def summary(detail: DataFrame) -> DataFrame:
    """The unweighted mean over folds of every numeric column but the fold, by model."""
    columns = [c for c in numeric_columns(detail) if c != "pli"]
    return detail.where("modele IS NOT NULL").groupBy("modele").agg(*[F.avg(c).alias(c) for c in columns]).orderBy("modele")


def wide(detail: DataFrame, metric: str, models: list[str]) -> DataFrame:
    """One row a fold, one column a model."""
    names = [f"{metric.upper()}_{m.lower()}" for m in models]
    rows = detail.groupBy("pli").pivot("modele", models).agg(F.first(metric))
    return rows.select("pli", *[F.col(f"`{m}`").alias(n) for m, n in zip(models, names, strict=True)]).orderBy("pli")


def improvement(detail: DataFrame, model: str, base: str, metric: str = "mae") -> DataFrame:
    of = lambda name: F.avg(F.when(F.col("modele") == name, F.col(metric)))
    return detail.agg(improvement_pct(of(model), of(base)).alias("improvement_pct"))


def report(detail: DataFrame) -> DataFrame:
    """modele, line: mean error and R², then each fold's error."""
    rows = detail.groupBy("modele").agg(*[F.avg(c).alias(c) for c in NAMES], formats.listed(F.col("pli"), formats.thousands(F.col("mae"))).alias("each"))
    line = F.concat(
        formats.left(F.col("modele"), 10), F.lit(" MAE "), formats.right(formats.thousands(F.col("mae")), 10), F.lit(" RMSE "), formats.right(formats.thousands(F.col("rmse")), 10),
        F.lit(" RMSLE "), formats.thousands(F.col("rmsle"), 3), F.lit(" R2 "), formats.thousands(F.col("r2"), 3), F.lit(" | "), F.col("each"),
    )
    return rows.select("modele", line.alias("line"))


def shape(data: Dataset) -> DataFrame:
    """One row: rows, columns, features."""
    return data.df.agg(F.count("*").alias("n_rows"), F.lit(len(data.df.columns)).cast("long").alias("n_columns"), F.lit(len(data.features)).cast("long").alias("n_features"))


def extent(data: Dataset) -> DataFrame:
    """One row: the target's smallest and largest value, cut to whole numbers."""
    return data.df.agg(F.min(data.target).cast("long").alias("min_y"), F.max(data.target).cast("long").alias("max_y"))


def middle(data: Dataset) -> DataFrame:
    """One row: the target's exact median, cut to a whole number. It is found by counts between approximate quantiles, not by one aggregate of all values."""
    found = prep.medians(data.df, [data.target]).get(data.target)
    return from_records(data.df.sparkSession, [{"median_y": None if found is None else int(found)}], "median_y long")


def describe(data: Dataset) -> dict[str, int | None]:
    """What an experiment says of its table: shape, median and extent."""
    return {k: v for row in (shape(data), middle(data), extent(data)) for k, v in row.first().asDict().items()}


def run(data: Dataset, out_dir: str, models: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """The whole experiment: writes holdout_ids, cv_scores and metrics as CSV under out_dir, prints the report, returns (detail, summary)."""
    models = default_models() if models is None else models
    rows = folded(data)
    write_csv(split.holdout_ids(data.df, data.key), f"{out_dir}/holdout_ids", single_file=False)  # a share of all rows
    print(", ".join(f"{name} {value}" for name, value in describe(data).items()))
    print(f"{len(numeric_columns(data.df, data.features))} numeric and {len(categorical_columns(data.df, data.features))} categorical columns")
    detail = cross_validate(rows, data, models)
    write_csv(detail, f"{out_dir}/cv_scores")
    means = summary(detail)
    write_csv(means, f"{out_dir}/metrics")
    for r in report(detail).orderBy("modele").collect():
        print(r.line)
    return detail, means
