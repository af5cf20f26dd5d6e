"""CSV and Parquet sources, literal tables, and the tables that experiments run on."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators.columns import Dataset

# Texts that stand for a missing value in CSV files.
MISSING = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
# End of the fixed values.


def _clean_csv(spark: SparkSession, path: str, multi_line: bool) -> DataFrame:
    """All columns as text, MISSING ones NULL."""
    raw = spark.read.csv(path, header=True, inferSchema=False, multiLine=multi_line, escape='"', nullValue="", emptyValue="")
    return raw.select(*[F.when(~F.col(f"`{c}`").isin(MISSING), F.col(f"`{c}`")).alias(c) for c in raw.columns])


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, multi_line: bool = False) -> DataFrame:
    """A CSV file or folder with a header. MISSING texts become NULL in every column.

    Without a schema, types are inferred as bigint, double, boolean or string, in that order, in one pass over all rows. With one, a
    value that is not of its type becomes NULL; broken_values counts these. With multi_line, quoted line ends belong to their value, and a file is read by one task; without, files are split.
    """
    clean = _clean_csv(spark, path, multi_line)
    if schema is not None:
        fields = (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields
        return clean.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in fields])
    kinds = ["bigint", "double", "boolean"]
    tests = [F.count_if(F.col(f"`{c}`").isNotNull() & F.col(f"`{c}`").try_cast(k).isNull()).alias(f"{i}_{k}") for i, c in enumerate(clean.columns) for k in kinds]
    bad = clean.agg(*tests).first()
    types = [next((k for k in kinds if not bad[f"{i}_{k}"]), "string") for i in range(len(clean.columns))]
    return clean.select(*[F.col(f"`{c}`").try_cast(k).alias(c) for c, k in zip(clean.columns, types, strict=True)])


def broken_values(spark: SparkSession, path: str, schema: T.StructType | str, multi_line: bool = False) -> DataFrame:
    """column, n, example (the least): values that read_csv makes NULL as they are not of their type in the schema. Missing values are none of them; columns without any have no row. One pass, one row to merge a task."""
    fields = (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields
    clean = _clean_csv(spark, path, multi_line)
    broken = {f.name: F.when(F.col(f"`{f.name}`").isNotNull() & F.col(f"`{f.name}`").try_cast(f.dataType).isNull(), F.col(f"`{f.name}`")) for f in fields}
    found = clean.agg(*[F.struct(F.lit(c).alias("column"), F.count(v).alias("n"), F.min(v).alias("example")).alias(f"c{i}") for i, (c, v) in enumerate(broken.items())])
    return found.select(F.inline(F.array(*found.columns))).where("n > 0")


def write_csv(df: DataFrame, path: str, single_file: bool = True, header: list[str] | None = None) -> None:
    """CSV with a header and without row numbers, replacing what is there. single_file is for results of a few rows."""
    named = df.toDF(*header) if header else df
    (named.coalesce(1) if single_file else named).write.mode("overwrite").csv(path, header=True)


def from_records(spark: SparkSession, records: list[dict], schema: str) -> DataFrame:
    """A table from dictionaries, columns in the schema's order. It is a local one: no Python worker is started to read it."""
    names = T.StructType.fromDDL(schema).fieldNames()
    return spark.createDataFrame(pa.table({n: [r[n] for r in records] for n in names}), schema)


def from_arrays(spark: SparkSession, arrays: dict[str, list], schema: str) -> DataFrame:
    """A table from arrays of equal length."""
    names = T.StructType.fromDDL(schema).fieldNames()
    return spark.createDataFrame(list(zip(*(arrays[n] for n in names), strict=True)), schema)


def parquet(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part(spark: SparkSession, sf_dir: str) -> Dataset:
    return Dataset(parquet(spark, sf_dir, "part"), "p_partkey", "p_retailprice")


def orders(spark: SparkSession, sf_dir: str) -> Dataset:
    """Without the date, which is neither a quantity nor a category."""
    return Dataset(parquet(spark, sf_dir, "orders").drop("o_orderdate"), "o_orderkey", "o_totalprice")


def labelled_documents(spark: SparkSession, sf_dir: str) -> Dataset:
    """Document lengths with labels, which most documents lack."""
    docs = parquet(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return Dataset(docs.join(parquet(spark, sf_dir, "labels"), "doc_id", "left"), "doc_id", "n_chars")


def part_with_gaps(spark: SparkSession, sf_dir: str) -> Dataset:
    """part with missing sizes and brands and with brands that occur once."""
    rows = parquet(spark, sf_dir, "part")
    size = F.when(F.col("p_partkey") % 7 != 0, F.col("p_size"))
    brand = F.when(F.col("p_partkey") % 400 == 7, F.concat(F.lit("RARE"), F.col("p_partkey").cast("string"))).when(F.col("p_partkey") % 11 != 0, F.col("p_brand"))
    return Dataset(rows.withColumns({"p_size": size, "p_brand": brand}), "p_partkey", "p_retailprice")
