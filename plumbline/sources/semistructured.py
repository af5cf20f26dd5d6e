"""Text columns that hold JSON objects: a schema found from all rows, typed columns, and the records that don't parse.

A record is bad if it is no JSON, no object, or names a field twice; its text is kept beside the NULLs it gives, so nothing is lost in silence. A NULL is neither good nor bad. Fields that a record lacks are NULL,
further fields are left out when a schema is given. A field whose type differs between rows is a variant, one that is NULL in all rows is text. A table without a good record has an empty schema.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _object(column: str) -> Column:
    """The text as a variant, NULL if it isn't an object."""
    value = F.try_parse_json(F.col(f"`{column}`"))
    return F.when(F.try_variant_get(value, "$", "map<string,variant>").isNotNull(), value)


def found_schema(df: DataFrame, column: str) -> str | None:
    """The fields of all rows' objects and their types, as the DDL of a struct; None if there are no fields. One pass, a schema a task to merge."""
    told = df.agg(F.schema_of_variant_agg(_object(column)).alias("s")).first().s
    if told in ("VOID", "OBJECT<>"):
        return None
    as_struct = {"OBJECT<>": "STRING", "OBJECT<": "STRUCT<", "VOID": "STRING"}
    return re.sub(r"`(?:[^`]|``)*`|\bOBJECT<>|\bOBJECT<|\bVOID\b(?!:)", lambda m: as_struct.get(m[0], m[0]), told)


def parsed(df: DataFrame, column: str, schema: str | None = None, prefix: str | None = None) -> DataFrame:
    """df with {prefix}fields, a struct of the schema (without one, of the schema found in df), and {prefix}bad, the text of a bad record. Values that are not of the schema's type are NULL. prefix: the column's name and _, unless given."""
    prefix = f"{column}_" if prefix is None else prefix
    clash = {f"{prefix}fields", f"{prefix}bad"} & set(df.columns)
    if clash:
        raise ValueError(f"columns exist already: {sorted(clash)}")
    schema = schema or found_schema(df, column)
    value, text = _object(column), F.col(f"`{column}`")
    fields = F.try_variant_get(value, "$", schema) if schema else F.when(value.isNotNull(), F.struct())
    return df.withColumns({f"{prefix}fields": fields, f"{prefix}bad": F.when(value.isNull(), text)})
