"""The queries of this engine's own operators and the same in SQL. Doubles are rounded to 6 digits, as engines add in different orders."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import catalog, sketches
from plumbline.functions import metrics as M
from plumbline.operators import columns as C
from plumbline.operators import ordered, prep
from plumbline.operators import split as S
from plumbline.operators.boosting import Settings
from plumbline.plans import experiment as X
from plumbline.plans.models import BoostedTrees, Dummy, GroupMean, MeanRegressor, cross_fitted, dummy_predictions
from plumbline.sources import semistructured
from plumbline.sources import tables as T
from plumbline.sources.shared import shared_dir
from plumbline.streaming import sessions

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def folds_sql(table: str, key: str) -> str:
    """CTEs r (all rows, rk, n) and dev (with pli)."""
    return f"""r AS (SELECT *, row_number() OVER (ORDER BY md5('42-' || CAST({key} AS VARCHAR)), {key}) AS rk, count(*) OVER () AS n FROM {table}),
dev AS (SELECT *, CAST(ntile(5) OVER (ORDER BY rk) AS INTEGER) AS pli FROM r WHERE rk > ceil(0.2::DOUBLE * n))"""


PART = folds_sql("part", "p_partkey")
GAPS = """gaps AS (SELECT p_partkey, p_name, p_type, p_retailprice, CASE WHEN p_partkey % 7 <> 0 THEN p_size END AS p_size,
  CASE WHEN p_partkey % 400 = 7 THEN 'RARE' || CAST(p_partkey AS VARCHAR) WHEN p_partkey % 11 <> 0 THEN p_brand END AS p_brand FROM part),
""" + folds_sql("gaps", "p_partkey")
DUMMY = f"{PART}, pred AS (SELECT v.pli, v.p_partkey, v.p_retailprice AS y, m.p FROM dev v JOIN (SELECT i.pli, avg(d.p_retailprice) AS p FROM (SELECT DISTINCT pli FROM dev) i JOIN dev d ON d.pli <> i.pli GROUP BY i.pli) m ON v.pli = m.pli)"
METRICS = "avg(abs(y - p)) AS mae, sqrt(avg((y - p) ** 2)) AS rmse, sqrt(avg((ln(1 + greatest(p, 0)) - ln(1 + y)) ** 2)) AS rmsle, 1 - sum((y - p) ** 2) / nullif(var_pop(y) * count(y), 0) AS r2"
ROUNDED = "round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(rmsle, 6) AS rmsle, round(r2, 6) AS r2"
#: Fold scores of two models: the mean of the training rows, and that of the training rows of a part's brand.
LONG = f"""{DUMMY},
own AS (SELECT i.pli, p_brand, avg(d.p_retailprice) AS b FROM (SELECT DISTINCT pli FROM dev) i JOIN dev d ON d.pli <> i.pli GROUP BY i.pli, p_brand),
by_brand AS (SELECT v.pli, v.p_retailprice AS y, coalesce(own.b, m.p) AS p FROM dev v JOIN (SELECT DISTINCT pli, p FROM pred) m ON v.pli = m.pli LEFT JOIN own ON v.pli = own.pli AND v.p_brand IS NOT DISTINCT FROM own.p_brand),
s AS (SELECT 'Dummy' AS modele, pli, {METRICS} FROM pred GROUP BY pli UNION ALL SELECT 'Brand', pli, {METRICS} FROM by_brand GROUP BY pli)"""
#: Order price against a guess from the status: predictions to measure, some below 0.
GUESS = "SELECT o_orderpriority, o_totalprice AS y, CAST((o_custkey % 1000) * 300 - 5000 AS DOUBLE) AS p FROM orders"


# --- sources, sinks, columns


@query("SELECT l_orderkey, l_partkey, l_quantity, l_returnflag FROM lineitem")
def src_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.parquet(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_returnflag")


@query("SELECT p_partkey, p_name, p_brand, p_type, CAST(p_size AS BIGINT) AS p_size, p_retailprice FROM part")
def sink_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part written as CSV to the shared folder and read back with inferred types."""
    path = f"{shared_dir(spark)}/plumbline-csv/{uuid.uuid4().hex}"
    T.write_csv(T.parquet(spark, sf_dir, "part"), path, single_file=False)
    return T.read_csv(spark, path)


@query("""SELECT 'l_partkey' AS "column", count(*) AS n, min(l_returnflag || CAST(l_partkey AS VARCHAR)) AS example FROM lineitem WHERE l_linenumber = 3""")
def src_broken_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part numbers with a letter before them, in a CSV file whose schema says they are numbers."""
    path = f"{shared_dir(spark)}/plumbline-csv/{uuid.uuid4().hex}"
    number = F.col("l_partkey").cast("string")
    text = F.when(F.col("l_linenumber") == 3, F.concat("l_returnflag", number)).otherwise(number)
    T.write_csv(T.parquet(spark, sf_dir, "lineitem").select("l_orderkey", text.alias("l_partkey")), path, single_file=False)
    return T.broken_values(spark, path, "l_orderkey bigint, l_partkey bigint")


@query("SELECT p_retailprice FROM part")
def proj_target(spark, sf_dir):
    data = T.part(spark, sf_dir)
    return data.df.select(data.target)


@query("SELECT p_partkey, p_name, p_brand, p_type, p_size FROM part")
def proj_drop_target(spark, sf_dir):
    data = T.part(spark, sf_dir)
    return C.drop(data.df, [data.target])


@query("SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice AS y FROM part")
def proj_xy(spark, sf_dir):
    df = T.part(spark, sf_dir).df
    features, target = C.features_and_target(df, "p_retailprice")
    return df.select(*features, F.col(target).alias("y"))


#: Names and types of part's columns, from the catalog.
CATALOG = "(SELECT column_name AS name, column_type IN ('TINYINT', 'SMALLINT', 'INTEGER', 'BIGINT', 'FLOAT', 'DOUBLE') OR starts_with(column_type, 'DECIMAL') AS numeric FROM (DESCRIBE part))"


@query(f"SELECT name FROM {CATALOG} WHERE numeric")
def num_cols(spark, sf_dir):
    return spark.createDataFrame([(c,) for c in C.numeric_columns(T.part(spark, sf_dir).df)], "name string")


@query(f"SELECT name FROM {CATALOG} WHERE NOT numeric")
def cat_cols(spark, sf_dir):
    return spark.createDataFrame([(c,) for c in C.categorical_columns(T.part(spark, sf_dir).df)], "name string")


@query(f"SELECT v.name, c.name IS NOT NULL AS present FROM (VALUES ('p_size'), ('p_brand'), ('p_colour')) v(name) LEFT JOIN {CATALOG} c ON v.name = c.name")
def has_cols(spark, sf_dir):
    found = C.has_columns(T.part(spark, sf_dir).df, ["p_size", "p_brand", "p_colour"])
    return spark.createDataFrame(list(found.items()), "name string, present boolean")


@query(f"SELECT v.name, description, c.name IS NOT NULL AS present FROM (VALUES ('p_size', 'size in units'), ('p_type', 'material and finish'), ('p_colour', 'colour of the surface')) v(name, description) LEFT JOIN {CATALOG} c ON v.name = c.name")
def column_report(spark, sf_dir):
    """Documented columns, with what they mean and whether the table has them."""
    return C.presence(T.part(spark, sf_dir).df, {"p_size": "size in units", "p_type": "material and finish", "p_colour": "colour of the surface"})


# --- split and folds


@query(f"WITH {PART} SELECT p_partkey, p_brand, p_retailprice FROM r WHERE rk <= ceil(0.2::DOUBLE * n)")
def split_holdout(spark, sf_dir):
    data = T.part(spark, sf_dir)
    return S.make_split(data.df, data.key)[1].select("p_partkey", "p_brand", "p_retailprice")


@query(f"WITH {PART} SELECT p_partkey, p_brand, p_retailprice FROM dev")
def split_dev(spark, sf_dir):
    data = T.part(spark, sf_dir)
    return S.make_split(data.df, data.key)[0].select("p_partkey", "p_brand", "p_retailprice")


@query(f"WITH {folds_sql('orders', 'o_orderkey')} SELECT count(*) FILTER (rk > ceil(0.2::DOUBLE * n)) AS n_dev, count(*) FILTER (rk <= ceil(0.2::DOUBLE * n)) AS n_hold, count(*) AS n_all FROM r")
def split_counts(spark, sf_dir):
    data = T.orders(spark, sf_dir)
    return X.folded(data).agg(F.count_if(~F.col("is_hold")).alias("n_dev"), F.count_if("is_hold").alias("n_hold"), F.count("*").alias("n_all"))


@query(f"WITH {PART} SELECT p_partkey AS row_id FROM r WHERE rk <= ceil(0.2::DOUBLE * n) ORDER BY rk")
def holdout_ids(spark, sf_dir):
    data = T.part(spark, sf_dir)
    return S.holdout_ids(data.df, data.key)


@query(f"""WITH {PART}, hold AS (SELECT p_partkey FROM r WHERE rk <= ceil(0.2::DOUBLE * n))
SELECT (SELECT count(*) FROM dev) AS n_dev, (SELECT count(*) FROM hold) AS n_hold, (SELECT count(*) FROM dev SEMI JOIN hold USING (p_partkey)) AS n_common""")
def split_disjoint(spark, sf_dir):
    """Rows on each side, and keys of one side that are on the other too."""
    data = T.part(spark, sf_dir)
    dev, hold = S.make_split(data.df, data.key)
    sides = dev.select(data.key, F.lit(1).alias("dev"), F.lit(0).alias("hold")).unionByName(hold.select(data.key, F.lit(0).alias("dev"), F.lit(1).alias("hold")))
    keys = sides.groupBy(data.key).agg(F.sum("dev").alias("dev"), F.sum("hold").alias("hold"))
    return keys.agg(F.sum("dev").alias("n_dev"), F.sum("hold").alias("n_hold"), F.sum(F.when(F.col("hold") > 0, F.col("dev")).otherwise(0)).alias("n_common"))


@query(f"""WITH {PART}, a AS (SELECT p_partkey FROM r WHERE rk <= ceil(0.2::DOUBLE * n)),
q AS (SELECT *, row_number() OVER (ORDER BY md5('42-' || CAST(p_partkey AS VARCHAR)), p_partkey) AS k, count(*) OVER () AS m FROM (SELECT * FROM part ORDER BY p_brand, p_name)),
b AS (SELECT p_partkey FROM q WHERE k <= ceil(0.2::DOUBLE * m))
SELECT (SELECT count(*) FROM a) AS n_first, (SELECT count(*) FROM b) AS n_second, (SELECT count(*) FROM a SEMI JOIN b USING (p_partkey)) AS n_both""")
def split_reproducible(spark, sf_dir):
    """Sizes of the holdouts of the table and of the table dealt otherwise, and of what they share."""
    data = T.part(spark, sf_dir)
    a, b = (S.make_split(df, data.key)[1].select(data.key) for df in (data.df, data.df.repartition(7, "p_brand")))
    both = a.select(data.key, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(b.select(data.key, F.lit(0).alias("a"), F.lit(1).alias("b")))
    keys = both.groupBy(data.key).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    return keys.agg(F.sum("a").alias("n_first"), F.sum("b").alias("n_second"), F.sum(F.least("a", "b")).alias("n_both"))


@query(f"WITH {folds_sql('orders', 'o_orderkey')} SELECT o_orderkey, pli FROM dev")
def kfold_assign(spark, sf_dir):
    return X.folded(T.orders(spark, sf_dir)).where("pli IS NOT NULL").select("o_orderkey", "pli")


@query(f"WITH {folds_sql('orders', 'o_orderkey')} SELECT pli, count(*) AS n FROM dev GROUP BY pli")
def kfold_sizes(spark, sf_dir):
    return X.folded(T.orders(spark, sf_dir)).where("pli IS NOT NULL").groupBy("pli").agg(F.count("*").alias("n"))


@query(f"WITH {PART} SELECT i.pli, count(*) FILTER (dev.pli <> i.pli) AS n_train, count(*) FILTER (dev.pli = i.pli) AS n_valid, sum(p_partkey) FILTER (dev.pli <> i.pli)::BIGINT AS train_keys FROM (SELECT DISTINCT pli FROM dev) i, dev GROUP BY i.pli")
def cv_train_valid(spark, sf_dir):
    rows = X.folded(T.part(spark, sf_dir))
    own = rows.where("pli IS NOT NULL").groupBy("pli").agg(F.count("*").alias("n"), F.sum("p_partkey").alias("k"))
    pairs = own.select(F.explode(F.sequence(F.lit(1), F.lit(S.FOLDS))).alias("i"), "pli", "n", "k")
    other = F.col("pli") != F.col("i")
    return pairs.groupBy(F.col("i").alias("pli")).agg(F.sum(F.when(other, F.col("n"))).alias("n_train"), F.sum(F.when(~other, F.col("n"))).alias("n_valid"), F.sum(F.when(other, F.col("k"))).alias("train_keys"))


# --- preprocessing


IMPUTED = f"""WITH {GAPS},
med AS (SELECT i.pli, median(CAST(p_size AS DOUBLE)) AS m FROM (SELECT DISTINCT pli FROM dev) i JOIN dev d ON d.pli <> i.pli GROUP BY i.pli),
cnt AS (SELECT i.pli, p_brand, count(*) AS c FROM (SELECT DISTINCT pli FROM dev) i JOIN dev d ON d.pli <> i.pli WHERE p_brand IS NOT NULL GROUP BY ALL),
top AS (SELECT pli, p_brand AS b FROM (SELECT *, row_number() OVER (PARTITION BY pli ORDER BY c DESC, p_brand) AS k FROM cnt) WHERE k = 1)"""


def _imputed(spark, sf_dir, numeric, categorical):
    rows = X.folded(T.part_with_gaps(spark, sf_dir)).where("pli IS NOT NULL")
    return prep.impute(rows, numeric, categorical, prep.statistics_by_fold(rows, numeric, categorical))


@query(f"{IMPUTED} SELECT p_partkey, dev.pli, coalesce(CAST(p_size AS DOUBLE), m) AS p_size FROM dev JOIN med ON dev.pli = med.pli")
def impute_median(spark, sf_dir):
    return _imputed(spark, sf_dir, ["p_size"], []).select("p_partkey", "pli", "p_size")


@query(f"{IMPUTED} SELECT p_partkey, dev.pli, coalesce(p_brand, b) AS p_brand FROM dev JOIN top ON dev.pli = top.pli")
def impute_mode(spark, sf_dir):
    return _imputed(spark, sf_dir, [], ["p_brand"]).select("p_partkey", "pli", "p_brand")


@query(f"""{IMPUTED} SELECT pli, 'p_size' AS "column", m AS number, CAST(NULL AS VARCHAR) AS text FROM med UNION ALL SELECT pli, 'p_brand', NULL, b FROM top""")
def leakage_safe_stats(spark, sf_dir):
    rows = X.folded(T.part_with_gaps(spark, sf_dir))
    return prep.training_medians(rows, ["p_size"]).select("pli", "column", "number", F.lit(None).cast("string").alias("text")).unionByName(prep.training_modes(rows, ["p_brand"]).select("pli", "column", F.lit(None).cast("double").alias("number"), "text"))


@query(f"""WITH {GAPS}, cats AS (SELECT DISTINCT i.pli, p_brand FROM (SELECT DISTINCT pli FROM dev) i JOIN dev d ON d.pli <> i.pli)
SELECT p_partkey, pli, 'p_brand_' || p_brand AS feature FROM dev JOIN cats USING (pli, p_brand)""")
def onehot(spark, sf_dir):
    data = T.part_with_gaps(spark, sf_dir)
    return prep.one_hot_long(X.folded(data), data.key, "p_brand")


@query(f"""WITH {GAPS}, cats AS (SELECT DISTINCT i.pli, p_brand FROM (SELECT DISTINCT pli FROM dev) i JOIN dev d ON d.pli <> i.pli)
SELECT p_partkey, pli, p_brand FROM dev ANTI JOIN cats USING (pli, p_brand)""")
def onehot_unknown(spark, sf_dir):
    """Validation rows whose block is all zeros."""
    data = T.part_with_gaps(spark, sf_dir)
    rows = X.folded(data).where("pli IS NOT NULL")
    known = prep.one_hot_long(rows, data.key, "p_brand").select(data.key)
    return rows.join(known, data.key, "left_anti").select("p_partkey", "pli", "p_brand")


FEATURES = f"""{IMPUTED},
filled AS (SELECT p_partkey, dev.pli, p_retailprice, coalesce(CAST(p_size AS DOUBLE), m) AS p_size, p_name, p_type, p_brand AS raw, coalesce(p_brand, b) AS p_brand FROM dev JOIN med USING (pli) JOIN top USING (pli)),
cats AS (SELECT DISTINCT i.pli, c, v FROM (SELECT DISTINCT pli FROM dev) i JOIN (UNPIVOT (SELECT pli AS own, p_name, p_brand, p_type FROM dev) ON p_name, p_brand, p_type INTO NAME c VALUE v) d ON d.own <> i.pli),
width AS (SELECT pli, count(*) + 2 AS width FROM cats GROUP BY pli),
ones AS (SELECT p_partkey, f.pli, count(*) AS k FROM (UNPIVOT filled ON p_name, p_brand, p_type INTO NAME c VALUE v) f JOIN cats USING (pli, c, v) GROUP BY ALL)"""


def _fitted_by_mean(spark, sf_dir) -> list[DataFrame]:
    """Validation rows of each fold with the vector and the prediction that the fold's pipeline gives them."""
    data = T.part_with_gaps(spark, sf_dir)
    return cross_fitted(X.folded(data), data, lambda: MeanRegressor("_y"))[0]


@query(f"{FEATURES} SELECT p_partkey, pli, width, CAST(p_partkey + p_size + k AS DOUBLE) AS total FROM filled JOIN ones USING (p_partkey, pli) JOIN width USING (pli)")
def features_assembled(spark, sf_dir):
    """Width and sum of each validation row's vector: numeric columns first, then the one-hot blocks."""
    parts = []
    for rows in _fitted_by_mean(spark, sf_dir):
        v = F.unwrap_udt("features")  # of sparse vectors only what is stored is summed
        width = F.coalesce(v["size"], F.size(v["values"])).cast("long")
        parts.append(rows.select("p_partkey", "pli", width.alias("width"), F.aggregate(v["values"], F.lit(0.0), lambda x, y: x + y).alias("total")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(f"""{FEATURES}, pred AS (SELECT f.pli, p_retailprice AS y, (SELECT avg(p_retailprice) FROM dev d WHERE d.pli <> f.pli) AS p FROM filled f)
SELECT pred.pli, width.width, count(*) AS n_valid, round(avg(abs(y - p)), 6) AS mae FROM pred JOIN width ON pred.pli = width.pli GROUP BY ALL""")
def cv_pipeline(spark, sf_dir):
    """Imputation, encoding and the constant model as one pipeline, fitted on each fold's training rows and applied to its validation rows. The width is that of the vectors it gives."""
    out = None
    for rows in _fitted_by_mean(spark, sf_dir):
        width = rows.schema["features"].metadata["ml_attr"]["num_attrs"]
        own = rows.groupBy("pli").agg(F.lit(width).cast("long").alias("width"), F.count("features").alias("n_valid"), M.mae("_y", "prediction").alias("mae"))
        out = own if out is None else out.unionByName(own)
    return rounded(out)


# --- models


@query(f"WITH {DUMMY} SELECT pli, {ROUNDED} FROM (SELECT pli, {METRICS} FROM pred GROUP BY pli)")
def cv_dummy(spark, sf_dir):
    data = T.part(spark, sf_dir)
    return rounded(M.compute_metrics(dummy_predictions(X.folded(data), data.key, data.target), "y", "prediction", ["pli"]))


@query(f"WITH {DUMMY} SELECT pli, round(avg(abs(y - p)), 6) AS mae FROM pred GROUP BY pli")
def cv_mae(spark, sf_dir):
    return cv_dummy(spark, sf_dir).select("pli", "mae")


@query(f"WITH {DUMMY} SELECT round(avg(mae), 6) AS mae FROM (SELECT pli, avg(abs(y - p)) AS mae FROM pred GROUP BY pli)")
def cv_mae_mean(spark, sf_dir):
    data = T.part(spark, sf_dir)
    scores = M.compute_metrics(dummy_predictions(X.folded(data), data.key, data.target), "y", "prediction", ["pli"])
    return rounded(scores.agg(F.avg("mae").alias("mae")))


@query()
def cv_gbt(spark, sf_dir):
    """Metrics by fold of 400 boosted trees, as an experiment fits them. No SQL: see cv_stumps."""
    data = T.part(spark, sf_dir)
    return X.cross_validate(X.folded(data), data, {"GBT": BoostedTrees()}).drop("modele", "temps_s")


def _stump_sql(k: int) -> str:
    """CTEs of a round of stumps, from predictions p{k} of all rows for all folds to p{k + 1}: sums of each split, the best one of each fold, and the leaves."""
    left = "CASE WHEN b.kind = 0 THEN p_size <= b.size ELSE p_brand = b.brand END"
    return f"""
s{k} AS (
  SELECT fold, 0 AS kind, p_size AS size, NULL AS brand, sum(sum(p{k} - y)) OVER (PARTITION BY fold ORDER BY p_size) AS gl, sum(count(*)) OVER (PARTITION BY fold ORDER BY p_size) AS hl FROM t{k} WHERE pli <> fold GROUP BY fold, p_size
  UNION ALL SELECT fold, 1, NULL, p_brand, sum(p{k} - y), count(*) FROM t{k} WHERE pli <> fold GROUP BY fold, p_brand),
a{k} AS (SELECT fold, sum(p{k} - y) AS g, count(*) AS h FROM t{k} WHERE pli <> fold GROUP BY fold),
b{k} AS (
  SELECT *, gl ** 2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) AS gain FROM s{k} JOIN a{k} USING (fold) WHERE hl >= 1 AND h - hl >= 1
  QUALIFY row_number() OVER (PARTITION BY fold ORDER BY gain DESC, kind, size, brand) = 1),
t{k + 1} AS (SELECT t{k}.* EXCLUDE p{k}, p{k} - 0.5::DOUBLE * CASE WHEN {left} THEN gl / (hl + 1) ELSE (g - gl) / (h - hl + 1) END AS p{k + 1} FROM t{k} JOIN b{k} b USING (fold))"""


@query(f"""WITH {PART},
t0 AS (SELECT i.pli AS fold, d.pli, p_size, p_brand, p_retailprice AS y, avg(p_retailprice) FILTER (d.pli <> i.pli) OVER (PARTITION BY i.pli) AS p0 FROM (SELECT DISTINCT pli FROM dev) i, dev d),{_stump_sql(0)},{_stump_sql(1)}
SELECT pli, {ROUNDED} FROM (SELECT pli, {METRICS} FROM (SELECT pli, y, p2 AS p FROM t2 WHERE pli = fold) GROUP BY pli)""")
def cv_stumps(spark, sf_dir):
    """Metrics by fold of two boosted trees of one split each: few enough for SQL to state the same learning."""
    data = T.part(spark, sf_dir)
    stumps = BoostedTrees(Settings(rounds=2, depth=1, rate=0.5, row_share=1.0, column_share=1.0), features=["p_size", "p_brand"])
    return rounded(X.cross_validate(X.folded(data), data, {"Stumps": stumps}).drop("modele", "temps_s"))


# --- metrics


def _guess(spark, sf_dir):
    p = ((F.col("o_custkey") % 1000) * 300 - 5000).cast("double")
    return T.parquet(spark, sf_dir, "orders").select("o_orderpriority", F.col("o_totalprice").alias("y"), p.alias("p"))


def _one_metric(name: str) -> None:
    def run(spark, sf_dir):
        return rounded(_guess(spark, sf_dir).agg(getattr(M, name)("y", "p").alias(name)))

    run.__name__ = f"metric_{name}"
    query(f"SELECT round({name}, 6) AS {name} FROM (SELECT {METRICS} FROM ({GUESS}))")(run)


for _name in M.NAMES:
    _one_metric(_name)


@query(f"SELECT o_orderpriority, {ROUNDED} FROM (SELECT o_orderpriority, {METRICS} FROM ({GUESS}) GROUP BY o_orderpriority)")
def metrics_all(spark, sf_dir):
    return rounded(M.compute_metrics(_guess(spark, sf_dir), "y", "p", ["o_orderpriority"]))


# --- result tables: two models compared on the same folds


def _long(spark, sf_dir):
    """Scores without the times, which no SQL can state."""
    data = T.part(spark, sf_dir)
    return X.cross_validate(X.folded(data), data, {"Dummy": Dummy(), "Brand": GroupMean("p_brand")})


@query(f"WITH {LONG} SELECT modele, pli, {ROUNDED} FROM s")
def cv_long(spark, sf_dir):
    return rounded(_long(spark, sf_dir).drop("temps_s"))


@query(f"WITH {LONG} SELECT pli, round(max(mae) FILTER (modele = 'Dummy'), 6) AS MAE_dummy, round(max(mae) FILTER (modele = 'Brand'), 6) AS MAE_brand FROM s GROUP BY pli")
def cv_wide(spark, sf_dir):
    return rounded(X.wide(_long(spark, sf_dir), "mae", ["Dummy", "Brand"]))


@query(f"WITH {LONG} SELECT modele, {ROUNDED} FROM (SELECT modele, avg(mae) AS mae, avg(rmse) AS rmse, avg(rmsle) AS rmsle, avg(r2) AS r2 FROM s GROUP BY modele)")
def metrics_summary(spark, sf_dir):
    return rounded(X.summary(_long(spark, sf_dir)).drop("temps_s"))


@query(f"WITH {LONG} SELECT round(100 * (1 - avg(mae) FILTER (modele = 'Brand') / avg(mae) FILTER (modele = 'Dummy')), 6) AS improvement_pct FROM s")
def improvement_pct(spark, sf_dir):
    return rounded(X.improvement(_long(spark, sf_dir), "Brand", "Dummy"))


@query(f"""WITH {LONG} SELECT modele, format('{{:<10}} MAE {{:>10}} RMSE {{:>10}} RMSLE {{:.3f}} R2 {{:.3f}} | ', modele, format('{{:,}}', round(avg(mae))::BIGINT), format('{{:,}}', round(avg(rmse))::BIGINT), avg(rmsle), avg(r2))
  || string_agg(format('{{:,}}', round(mae)::BIGINT), ', ' ORDER BY pli) AS line FROM s GROUP BY modele""")
def fmt_report(spark, sf_dir):
    return X.report(_long(spark, sf_dir))


@query("SELECT count(*) AS n FROM lineitem")
def agg_count(spark, sf_dir):
    return T.parquet(spark, sf_dir, "lineitem").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n_rows, 6::BIGINT AS n_columns, 5::BIGINT AS n_features FROM part")
def agg_shape(spark, sf_dir):
    return X.shape(T.part(spark, sf_dir))


@query("SELECT CAST(trunc(median(o_totalprice)) AS BIGINT) AS median_y FROM orders")
def agg_median(spark, sf_dir):
    return X.middle(T.orders(spark, sf_dir))


@query("SELECT CAST(trunc(min(o_totalprice)) AS BIGINT) AS min_y, CAST(trunc(max(o_totalprice)) AS BIGINT) AS max_y FROM orders")
def agg_min_max(spark, sf_dir):
    return X.extent(T.orders(spark, sf_dir))


@query("""SELECT source, lang, count(*) AS n, sum(n_chars)::BIGINT AS n_chars, count(quality) AS n_labelled, round(avg(quality), 6) AS quality
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source, lang""")
def src_labelled_documents(spark, sf_dir):
    df = T.labelled_documents(spark, sf_dir).df
    return df.groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"), F.count("quality").alias("n_labelled"), F.round(F.avg("quality"), 6).alias("quality"))


# --- joins by order, ranks, cubes


@query("""WITH e AS (SELECT * FROM events WHERE event_type = 'error')
SELECT l.event_id, l.user_id, coalesce(e.event_id, -1) AS error_id, e.value AS error_value FROM events l ASOF LEFT JOIN e ON l.user_id = e.user_id AND l.ts >= e.ts""")
def asof_last_error(spark, sf_dir):
    """Every event with the last error that its user had seen by then, -1 for none."""
    events = T.parquet(spark, sf_dir, "events")
    errors = events.where("event_type = 'error'").select("user_id", "ts", F.col("event_id").alias("id"), "value")
    return ordered.asof_join(events.select("event_id", "user_id", "ts"), errors, ["user_id"], "ts", "ts", ["id", "value"], prefix="error_").select("event_id", "user_id", F.coalesce("error_id", F.lit(-1)).alias("error_id"), "error_value")


@query("""WITH e AS (SELECT event_id, user_id, ts AS a, ts + CASE WHEN value > 10 THEN INTERVAL 24 HOUR ELSE INTERVAL 1 HOUR END AS b FROM events WHERE event_type = 'error')
SELECT p.event_id, p.user_id, p.event_type, e.event_id AS error_id FROM events p JOIN e ON p.user_id = e.user_id AND p.ts >= e.a AND p.ts < e.b""")
def interval_after_error(spark, sf_dir):
    """What users did in the hour after an error, in the day after one of a value above 10."""
    events = T.parquet(spark, sf_dir, "events")
    end = F.when(F.col("value") > 10, F.expr("ts + INTERVAL 24 HOURS")).otherwise(F.expr("ts + INTERVAL 1 HOUR"))
    errors = events.where("event_type = 'error'").select("user_id", F.col("event_id").alias("id"), F.col("ts").alias("a"), end.alias("b"))
    return ordered.interval_join(events.select("event_id", "user_id", "event_type", "ts"), errors, ["user_id"], "ts", "a", "b", ["id"], prefix="error_").drop("ts")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
  row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS row_number FROM lineitem""")
def lineitem_numbers(spark, sf_dir):
    """All line items numbered from the dearest on."""
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    rows = T.parquet(spark, sf_dir, "lineitem").select(*order, "l_extendedprice")
    return ordered.with_row_number(rows, [F.col("l_extendedprice").desc(), *order])


@query("SELECT o_custkey, o_orderkey, o_totalprice, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS place FROM orders QUALIFY place <= 3")
def top_orders(spark, sf_dir):
    """The three dearest orders of each customer."""
    rows = T.parquet(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return ordered.top_rows(rows, ["o_custkey"], [F.col("o_totalprice").desc(), "o_orderkey"], 3)


@query("""SELECT l_returnflag, l_linestatus, coalesce(CAST(year(l_shipdate) AS INTEGER), 0) AS shipped, grouping(l_returnflag, l_linestatus, year(l_shipdate))::BIGINT AS level, count(*) AS n, round(sum(l_quantity), 6) AS quantity, round(avg(l_discount), 6) AS discount
FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus, year(l_shipdate)) HAVING count(*) >= 1000""")
def cube_lineitem(spark, sf_dir):
    """Sums over every subset of three groupings, of groups of 1,000 rows or more; the year 0 stands for all. One scan: rows are expanded by grouping and summed before the shuffle."""
    rows = T.parquet(spark, sf_dir, "lineitem").withColumn("shipped", F.year("l_shipdate"))
    sums = rows.cube("l_returnflag", "l_linestatus", "shipped").agg(
        F.grouping_id().alias("level"), F.count("*").alias("n"), F.round(F.sum("l_quantity"), 6).alias("quantity"), F.round(F.avg("l_discount"), 6).alias("discount")
    )
    return sums.where("n >= 1000").withColumn("shipped", F.coalesce("shipped", F.lit(0)))


# --- sketches, streams, semi-structured columns, functions of SQL


@query("""SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, event_type, count(*) AS n, count(DISTINCT user_id) AS users, true AS users_close, true AS quartiles_close FROM events GROUP BY ALL""")
def sketch_weeks(spark, sf_dir):
    """Users and quartiles of values by week from sketches stored by day, each held against the exact figures: whether both are as close as the sketches promise. n is the sketches', users the exact count."""
    week = F.date_format(F.date_trunc("week", "day"), "yyyy-MM-dd").alias("week")
    events = T.parquet(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    path, at = f"{shared_dir(spark)}/plumbline-sketches/{uuid.uuid4().hex}", [0.25, 0.5, 0.75]
    sketches.store(sketches.sketched(events, ["day", "event_type"], "user_id", "value"), path, "day")
    told = sketches.estimates(sketches.merged(spark.read.parquet(path), [week, "event_type"]), at)
    rows = events.select(week, "event_type", "user_id", "value")
    both = rows.join(told.withColumnsRenamed({"week": "w", "event_type": "e"}), F.col("week").eqNullSafe(F.col("w")) & F.col("event_type").eqNullSafe(F.col("e")))
    places = [c for i in range(3) for c in (F.count_if(F.col("value") < F.col("quantiles")[i]).alias(f"below{i}"), F.count_if(F.col("value") <= F.col("quantiles")[i]).alias(f"upto{i}"))]
    exact = both.groupBy("week", "event_type").agg(F.max("n_rows").alias("n"), F.max("n_distinct").alias("told"), F.count_distinct("user_id").alias("users"), F.count("value").alias("numbers"), *places)
    off = F.greatest(*[sketches.off_by(F.col(f"below{i}"), F.col(f"upto{i}"), F.col("numbers"), q) for i, q in enumerate(at)])
    near = F.abs(F.col("told") - F.col("users")) <= sketches.DISTINCT_ERROR * F.col("users")
    return exact.select("week", "event_type", "n", "users", near.alias("users_close"), (off <= sketches.RANK_ERROR).alias("quartiles_close"))


@query("""WITH e AS (SELECT user_id, epoch_us(ts) AS t, value FROM events WHERE ts IS NOT NULL),
g AS (SELECT *, coalesce(t - lag(t) OVER (PARTITION BY user_id ORDER BY t) > 21600000000, true) AS opens FROM e),
s AS (SELECT *, count(*) FILTER (opens) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(t) AS opened_us, max(t) + 21600000000 AS closes_us, count(*) AS n, round(sum(value), 6) AS value FROM s GROUP BY user_id, k
HAVING max(t) + 21600000000 <= (SELECT max(t) // 1000 * 1000 FROM e) - 86400000000""")
def stream_sessions(spark, sf_dir):
    """Sessions of users with pauses of up to six hours, from a stream of events: those closed a day before the latest event."""
    path = f"{shared_dir(spark)}/plumbline-streams/{uuid.uuid4().hex}"
    events = sessions.source(spark, f"{sf_dir}/{{events.parquet}}")  # a pattern, as the table may be one file
    rows = events.select("user_id", F.timestamp_micros(ordered.position(events, "ts")).alias("ts"), "value")
    closed = sessions.sessions(rows, ["user_id"], "ts", "6 hours", "1 day", [F.sum("value").alias("value")])
    sessions.write_closed(closed, f"{path}/sessions", f"{path}/checkpoint")
    done = spark.read.schema(closed.schema).parquet(f"{path}/sessions")
    return done.select("user_id", F.unix_micros("opened").alias("opened_us"), F.unix_micros("closes").alias("closes_us"), "n", F.round("value", 6).alias("value"))


@query("""WITH e AS (SELECT event_id, CASE event_id % 10 WHEN 3 THEN left(props, length(props) - 1) WHEN 5 THEN '[' || props || ']' WHEN 7 THEN '{"level": "' || event_type || '"}' ELSE props END AS props FROM events),
v AS (SELECT *, coalesce(json_valid(props) AND json_type(CASE WHEN json_valid(props) THEN props END) = 'OBJECT', false) AS good FROM e)
SELECT event_id, coalesce(CAST(CASE WHEN good THEN json_extract_string(props, '$.k') END AS BIGINT), -1) AS k, CASE WHEN good THEN json_extract_string(props, '$.level') END AS level, CASE WHEN NOT good THEN props END AS bad FROM v""")
def json_props(spark, sf_dir):
    """The fields of events' JSON, some of it broken, some with another field, by the schema found in it, -1 for no number; and the text of bad records."""
    part = F.col("event_id") % 10
    cut = F.expr("left(props, length(props) - 1)")
    damaged = F.when(part == 3, cut).when(part == 5, F.concat(F.lit("["), "props", F.lit("]"))).when(part == 7, F.concat(F.lit('{"level": "'), "event_type", F.lit('"}'))).otherwise(F.col("props"))
    rows = T.parquet(spark, sf_dir, "events").select("event_id", damaged.alias("props"))
    return semistructured.parsed(rows, "props").select("event_id", F.coalesce("props_fields.k", F.lit(-1)).alias("k"), "props_fields.level", F.col("props_bad").alias("bad"))


@query(f"SELECT o_orderpriority, {ROUNDED} FROM (SELECT o_orderpriority, {METRICS} FROM ({GUESS}) GROUP BY o_orderpriority)")
def metrics_sql(spark, sf_dir):
    """metrics_all by the functions that SQL can call."""
    catalog.register(spark)
    means = {"mae": "avg(abs_error(y, p))", "rmse": "avg(squared_error(y, p))", "rmsle": "avg(squared_log_error(y, p))", "r2": "sum(squared_error(y, p)), var_pop(y) * count(y)"}
    told = ", ".join(f"{name}({mean}, count_if(unpaired(y, p))) AS {name}" for name, mean in means.items())
    return rounded(spark.sql(f"SELECT o_orderpriority, {told} FROM {{guesses}} GROUP BY o_orderpriority", guesses=_guess(spark, sf_dir)))
