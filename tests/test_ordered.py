"""As-of and interval joins, numbers over a whole table and top rows against plain Python, with hot keys cut."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from plumbline.operators import ordered
from plumbline.plans.queries import QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture
def small_parts(monkeypatch):
    monkeypatch.setattr(ordered, "MAX_PARTS", 16)


def stream(seed, n, keys=4, times=60):
    """Rows of (key, time, value): a hot key, NULLs, repeated times and rows."""
    r = random.Random(seed)
    rows = [(r.choice([None, *range(keys), *[0] * keys]), r.choice([None, *range(times)]), r.choice([None, r.randrange(5)])) for _ in range(n)]
    return rows + rows[: n // 10]


def plain_asof(left, right, strict, forward, tolerance):
    out = []
    for k, t, v in left:
        sign = -1 if forward else 1
        found = [(sign * u, w is not None, w or 0, (u, w)) for j, u, w in right if None not in (k, t, j, u) and j == k and (sign * u < sign * t or (u == t and not strict))]
        best = max(found)[3] if found else None
        if best and tolerance is not None and abs(t - best[0]) > tolerance:
            best = None
        out.append((k, t, v, *(best or (None, None))))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("strict", "forward", "tolerance"), [(False, False, None), (True, False, None), (False, True, 3), (True, True, None), (False, False, 0)])
@pytest.mark.parametrize("rows", [5, 1_000_000])
def test_asof(spark, small_parts, rows, strict, forward, tolerance):
    left, right = stream(1, 150), stream(2, 60)
    schema = "row int, t int, found int"  # names as the operator's own
    a, b = spark.createDataFrame(left, schema).repartition(3), spark.createDataFrame(right, schema).repartition(3)
    got = ordered.asof_join(a, b, ["row"], "t", "t", ["t", "found"], strict=strict, forward=forward, tolerance=tolerance, rows=rows)
    assert got.columns == ["row", "t", "found", "right_t", "right_found"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_asof(left, right, strict, forward, tolerance)


def test_asof_cuts_a_hot_key(spark, small_parts):
    rows = spark.createDataFrame([(1, t) for t in range(900)] + [(k, 5) for k in range(2, 102)], "k int, t int")
    cuts = ordered._cuts(rows, 10)
    assert [r.k for r in cuts.collect()] == [1] and len(cuts.first().cuts) > 10
    assert ordered._with_part(rows, cuts).where("k = 1").groupBy("part").count().agg(F.max("count")).first()[0] < 2 * 1000 / 16 + 10
    got = ordered.asof_join(rows, rows.where("k = 1 AND t = 7"), ["k"], "t", "t", rows=10)
    assert got.where("right_t = 7").count() == 893 and got.count() == 1000


def test_asof_without_keys_types_and_empty_tables(spark):
    day = lambda n: date(2024, 1, 1) + timedelta(n)
    a, b = spark.createDataFrame([(day(3),), (day(1),), (None,)], "d date"), spark.createDataFrame([(day(2), "x")], "d date, v string")
    got = ordered.asof_join(a, b, [], "d", "d", ["v"])
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(day(3), "x"), (day(1), None), (None, None)], key=repr)
    assert ordered.asof_join(a.limit(0), b, [], "d", "d").count() == 0
    assert [r.right_v for r in ordered.asof_join(a, b.limit(0), [], "d", "d").collect()] == [None] * 3
    nan = spark.createDataFrame([(float("nan"),), (1.5,)], "x double")
    assert sorted(str(r.right_x) for r in ordered.asof_join(nan, nan, [], "x", "x").collect()) == ["1.5", "None"]
    with pytest.raises(ValueError, match="both sides"):
        ordered.asof_join(a, b, [], "d", "d", prefix="")
    with pytest.raises(TypeError):
        ordered.asof_join(a, nan, [], "d", "x")


@pytest.mark.parametrize("closed", [False, True])
@pytest.mark.parametrize("rows", [20, 1_000_000])
def test_intervals(spark, small_parts, rows, closed):
    r = random.Random(3)
    points = [(r.choice([None, 0, 0, 1]), r.choice([None, 7.0, 7.0, r.uniform(-50, 50), float("nan")]), i % 40) for i in range(200)]
    ends = lambda: r.choice([None, 7.0, r.uniform(-50, 50), float("-inf"), float("inf"), float("nan")])
    intervals = [(r.choice([None, 0, 1]), ends(), ends(), i % 9) for i in range(80)]
    intervals += [(0, a, a + 10.0**-k, k) for k in range(8) for a in (7.0, -3.0)] + [(0, 7.0, 7.0, -1)]
    inside = lambda x, a, b: a <= x <= b if closed else a <= x < b
    want = [(k, x, i, a, b, j) for k, x, i in points for m, a, b, j in intervals if None not in (k, x, m, a, b) and k == m and inside(x, a, b)]
    p, q = spark.createDataFrame(points, "k int, x double, bin int"), spark.createDataFrame(intervals, "k int, a double, b double, bin int")
    got = ordered.interval_join(p, q, ["k"], "x", "a", "b", ["a", "b", "bin"], closed=closed, rows=rows)
    assert got.columns == ["k", "x", "bin", "right_a", "right_b", "right_bin"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr) and len(want) > 500


def test_intervals_of_time_without_keys(spark):
    at = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    p = spark.createDataFrame([(at(m),) for m in range(0, 1000, 7)], "ts timestamp")
    q = spark.createDataFrame([(at(a), at(a + n)) for a in range(0, 900, 13) for n in (0, 1, 64, 700)], "a timestamp, b timestamp")
    got = ordered.interval_join(p, q, [], "ts", "a", "b")
    assert got.count() == sum(a <= m < a + n for m in range(0, 1000, 7) for a in range(0, 900, 13) for n in (0, 1, 64, 700))
    assert ordered.interval_join(p, q.limit(0), [], "ts", "a", "b").count() == 0 == ordered.interval_join(p.limit(0), q, [], "ts", "a", "b").count()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark):
    inside = plan(QUERIES["interval_after_error"](spark, SF))
    assert "NestedLoop" not in inside and "Cartesian" not in inside
    first = plan(QUERIES["top_orders"](spark, SF))
    assert first.index("Final") < first.index("Exchange") < first.index("Partial")
    assert first.count("WindowGroupLimit") == 2


def test_row_numbers(spark):
    r = random.Random(4)
    rows = [(r.choice([None, 1, 1, 2]), r.random()) for _ in range(500)] + [(1, 0.5)] * 500
    df = spark.createDataFrame(rows, "a int, row double").repartition(5)
    got = ordered.with_row_number(df, [F.col("a").desc(), "row"], "n").orderBy("n").collect()
    assert [x.n for x in got] == list(range(1, 1001))
    assert [(x.a, x.row) for x in got] == sorted(rows, key=lambda v: (-(v[0] or 0), v[1]))
    ties = ordered.with_row_number(df.select("a"), ["a"])
    assert [x.a for x in ties.orderBy("row_number").collect()] == sorted((a for a, _ in rows), key=lambda a: a or 0)
    assert ordered.with_row_number(df.limit(0), ["a"]).count() == 0
    assert "Window" not in plan(ordered.with_row_number(df, ["a"]))


def test_top_rows(spark):
    df = spark.createDataFrame([(k, v) for k in (None, 1, 2) for v in range(k or 5)], "k int, v int")
    assert sorted(map(tuple, ordered.top_rows(df, ["k"], [F.col("v").desc()], 2).collect()), key=repr) == sorted([(None, 4, 1), (None, 3, 2), (1, 0, 1), (2, 1, 1), (2, 0, 2)], key=repr)
