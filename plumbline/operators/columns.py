"""Column selection by name, type and role."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T


@dataclass(frozen=True)
class Dataset:
    """A table with the name of its unique key and of its target. The target is the only column that is no feature."""

    df: DataFrame
    key: str
    target: str

    def __post_init__(self):
        require(self.df, [self.key, self.target])

    @property
    def features(self) -> list[str]:
        return [c for c in self.df.columns if c != self.target]


def require(df: DataFrame, names: list[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise KeyError(f"no such columns: {missing}")


def has_columns(df: DataFrame, names: list[str]) -> dict[str, bool]:
    return {n: n in df.columns for n in names}


def presence(df: DataFrame, descriptions: dict[str, str]) -> DataFrame:
    """name, description, present, in the order given: which of some documented columns a table has."""
    found = has_columns(df, list(descriptions))
    return df.sparkSession.createDataFrame([(n, text, found[n]) for n, text in descriptions.items()], "name string, description string, present boolean")


def drop(df: DataFrame, names: list[str]) -> DataFrame:
    """df without some columns. Spark's own drop ignores unknown names; here they are an error."""
    require(df, names)
    return df.drop(*names)


def numeric_columns(df: DataFrame, names: list[str] | None = None) -> list[str]:
    wanted = set(df.columns if names is None else names)
    return [f.name for f in df.schema if f.name in wanted and isinstance(f.dataType, T.NumericType)]


def categorical_columns(df: DataFrame, names: list[str] | None = None) -> list[str]:
    """Every column that is not numeric."""
    numeric = set(numeric_columns(df))
    return [c for c in (df.columns if names is None else names) if c not in numeric]


def features_and_target(df: DataFrame, target: str) -> tuple[list[str], str]:
    """The names of both parts; the rows stay together in one table, so that they cannot lose their alignment."""
    require(df, [target])
    return [c for c in df.columns if c != target], target
