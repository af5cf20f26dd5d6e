"""Runs a query and its SQL on the same tables and compares the rows."""

import math
from pathlib import Path

import duckdb


def rows_of(frame):
    frame = frame[sorted(frame.columns)]
    clean = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else round(float(v), 5) + 0.0 if isinstance(v, float) else v.item() if hasattr(v, "item") else v
    return list(frame.columns), sorted((tuple(clean(v) for v in r) for r in frame.astype(object).itertuples(index=False, name=None)), key=repr)


def compare(spark, sf_dir, query, sql):
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    got, want = rows_of(query(spark, sf_dir).toPandas()), rows_of(con.execute(sql).df())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]
