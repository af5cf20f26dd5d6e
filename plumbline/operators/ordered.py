"""Joins by order and ranks: as-of join, interval join, numbers over a whole table, top rows of each group.

Positions are timestamps, dates or numbers. Keys are compared as SQL does: a NULL key or position matches nothing, nor does NaN. Columns of the
right side get a prefix; on either side they may be named like anything here, as rows travel as one struct. Empty tables give empty results.

No key is one task's alone. A key or bin with more rows than max(ROWS, n / MAX_PARTS) is hot; there are fewer than MAX_PARTS such keys, which
bounds what is collected and broadcast of them. Hot keys of an as-of join are cut by position, hot bins of an interval join are dealt by hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.sources.shared import checkpoints_to_shared_dir

ROWS, MAX_PARTS = 1_000_000, 1_000
EPOCH = "1970-01-01 00:00:00"
#: Bits of monotonically_increasing_id that number the rows of a partition.
ROW_BITS = 33
#: Exponents of the widths of bins, and the largest position that has a bin of its own.
LEVELS, FAR = (-20, 1023), 1e300


def position(df: DataFrame, name: str) -> Column:
    """A column as a number: microseconds of timestamps, days of dates, numbers as they are and NULL for NaN."""
    kind, c = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c)
    if isinstance(kind, T.TimestampNTZType):  # by way of an interval, as a cast to a timestamp would ask for a time zone
        since = (c - F.lit(EPOCH).cast("timestamp_ntz")).cast("interval second")
        return (since.cast("decimal(20,6)") * 1_000_000).cast("bigint")
    if isinstance(kind, T.DateType):
        return F.unix_date(c)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c), c.cast("double"))
    if isinstance(kind, T.NumericType):
        return c
    raise TypeError(f"{name} is {kind.simpleString()}: positions are timestamps, dates or numbers")


def _row(columns: list[str], prefix: str = "") -> Column:
    return F.struct(*[F.col(f"`{c}`").alias(prefix + c) for c in columns])


def _key(by: list[str]) -> Column:
    """One value of all keys, NULL where one of them is."""
    if not by:
        return F.lit(0)
    known = F.lit(True)
    for c in by:
        known = known & F.col(f"`{c}`").isNotNull()
    return F.when(known, F.struct(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(by)]))


def _clash(left: list[str], right: list[str]) -> None:
    if both := set(left) & set(right):
        raise ValueError(f"columns of both sides: {sorted(both)}; choose another prefix")


def _size_of_a_part(n: int, rows: int) -> int:
    return max(rows, -(-n // MAX_PARTS))


def _cuts(rows: DataFrame, most: int) -> DataFrame | None:
    """k, cuts: positions t at which the hot keys among the rows' (k, t) are cut into parts, none of more than about twice the size of a key that isn't hot, but for equal positions. None without hot keys."""
    n = rows.count()
    if n <= most:
        return None
    size = _size_of_a_part(n, most)
    hot = rows.groupBy("k").count().where(F.col("count") > size).collect()  # fewer than MAX_PARTS
    if not hot:
        return None
    keys = rows.sparkSession.createDataFrame([(r.k,) for r in hot], T.StructType([rows.schema["k"]]))
    steps = [i / MAX_PARTS for i in range(1, MAX_PARTS)]
    found = rows.join(F.broadcast(keys), "k", "left_semi").groupBy("k").agg(F.percentile_approx("t", steps, 4 * MAX_PARTS).alias("q")).collect()
    parts = {r.k: -(-r["count"] // size) for r in hot}
    cuts = [(r.k, sorted({r.q[j * MAX_PARTS // parts[r.k] - 1] for j in range(1, parts[r.k])})) for r in found]
    return rows.sparkSession.createDataFrame(cuts, T.StructType([rows.schema["k"], T.StructField("cuts", T.ArrayType(rows.schema["t"].dataType))]))


def _with_part(rows: DataFrame, cuts: DataFrame | None) -> DataFrame:
    """Adds part (how many of its key's cuts are at or below t) and hot."""
    if cuts is None:
        return rows.withColumns({"part": F.lit(0), "hot": F.lit(False)})
    halves = F.array(*[F.lit(1 << i) for i in range(MAX_PARTS.bit_length() - 1, -1, -1)])
    part = F.aggregate(halves, F.lit(0), lambda i, step: F.when(F.get("cuts", i + step - 1) <= F.col("t"), i + step).otherwise(i))
    return rows.join(F.broadcast(cuts), "k", "left").withColumns({"part": part, "hot": F.col("cuts").isNotNull()}).drop("cuts")


def _floor(x: Column) -> Column:
    """floor as a double: widths far below a position give more than a bigint holds."""
    return F.when(F.abs(x) < 2.0**62, F.floor(x).cast("double")).otherwise(x)


def asof_join(
    left: DataFrame,
    right: DataFrame,
    by: list[str],
    left_time: str,
    right_time: str,
    columns: list[str] | None = None,
    prefix: str = "right_",
    strict: bool = False,
    forward: bool = False,
    tolerance: float | None = None,
    rows: int = ROWS,
) -> DataFrame:
    """Every left row with the last right row of its keys that is not later (forward: the first not earlier), or NULLs where none is.

    strict leaves out right rows of the very same time. Beyond tolerance (microseconds, days or numbers, as the times are) a row counts as none.
    Of right rows of one key and time, the greatest by `columns` in order counts; those columns must be orderable.

    Both sides are one stream, ordered by key and time, in which each left row takes the last right one before it: one shuffle, and memory for
    one row. A hot key's stream is cut by time; the last right row before each piece joins it as its first.
    """
    columns = right.columns if columns is None else columns
    _clash(left.columns, [prefix + c for c in columns])
    if dict(left.dtypes)[left_time] != dict(right.dtypes)[right_time]:
        raise TypeError(f"{left_time} and {right_time} are of different types")
    sign = -1 if forward else 1
    lefts = left.select(_key(by).alias("k"), (position(left, left_time) * sign).alias("t"), _row(left.columns).alias("row"))
    found = right.select(_key(by).alias("k"), (position(right, right_time) * sign).alias("t"), _row(columns, prefix).alias("c")).where("k IS NOT NULL AND t IS NOT NULL")
    found = found.select("k", "t", F.struct("t", "c").alias("found"))
    none = F.lit(None).cast(found.schema["found"].dataType)
    matchable = lefts.where("k IS NOT NULL AND t IS NOT NULL")
    alone = lefts.where("k IS NULL OR t IS NULL").select("row", none.alias("found"))

    cuts = _cuts(matchable.select("k", "t").unionByName(found.select("k", "t")), rows)
    matchable, found = _with_part(matchable, cuts), _with_part(found, cuts)
    parts = ["k", "part"]
    no_row = F.lit(None).cast(lefts.schema["row"].dataType).alias("row")
    stream = matchable.select(*parts, "t", F.lit(1).alias("side"), "row", none.alias("found"))
    side = F.lit(2 if strict else 0).alias("side")
    stream = stream.unionByName(found.select(*parts, "t", side, no_row, "found"))
    if cuts is not None:
        pieces = matchable.where("hot").select(*parts, F.lit(True).alias("asked"), none.alias("found"))
        pieces = pieces.unionByName(found.where("hot").select(*parts, F.lit(False).alias("asked"), "found")).groupBy(*parts).agg(F.max("asked").alias("asked"), F.max("found").alias("found"))
        before = Window.partitionBy("k").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # MAX_PARTS rows a key
        brought = pieces.withColumn("found", F.last("found", True).over(before)).where("asked AND found IS NOT NULL")
        stream = stream.unionByName(brought.select(*parts, F.col("found.t").alias("t"), side, no_row, "found"))
    upto = Window.partitionBy(*parts).orderBy("t", "side", "found").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = stream.withColumn("found", F.last("found", True).over(upto)).where("row IS NOT NULL")
    if tolerance is not None:
        joined = joined.withColumn("found", F.when(F.col("t") - F.col("found.t") <= tolerance, F.col("found")))
    return joined.select("row", "found").unionByName(alone).select("row.*", "found.c.*")


def interval_join(
    points: DataFrame, intervals: DataFrame, by: list[str], point: str, start: str, end: str, columns: list[str] | None = None, prefix: str = "right_", closed: bool = False, rows: int = ROWS
) -> DataFrame:
    """Pairs of a point and an interval of its keys with start <= point < end (closed: <= end). An interval that ends before it starts has none.

    An interval lies in at most three bins, as wide as the power of two above its length; a point lies in one bin of each width that an interval
    has, so a pair meets once, in a hash or merge join on key, width and bin, and no point is compared that is farther away than that
    width. Points repeat once a width in use. A hot bin's points are dealt by hash to parts, each of which has the bin's intervals.
    """
    columns = intervals.columns if columns is None else columns
    _clash(points.columns, [prefix + c for c in columns])
    p = points.select(_key(by).alias("k"), position(points, point).alias("t"), _row(points.columns).alias("row")).where("k IS NOT NULL AND t IS NOT NULL")
    i = intervals.select(_key(by).alias("k"), position(intervals, start).alias("a"), position(intervals, end).alias("b"), _row(columns, prefix).alias("found"))
    i = i.where("k IS NOT NULL AND " + ("a <= b" if closed else "a < b"))

    near = lambda x: F.greatest(F.lit(-FAR), F.least(F.lit(FAR), F.col(x).cast("double")))
    bin_of = lambda x: _floor(near(x) / F.pow(F.lit(2.0), F.col("level")))
    length = near("b") - near("a")
    level = F.when(length > 0, F.greatest(F.lit(LEVELS[0]), F.least(F.lit(LEVELS[1]), (F.floor(F.log2(length)) + 1).cast("int")))).otherwise(F.lit(LEVELS[0]))
    i = i.withColumn("level", level)
    levels = sorted(r.level for r in i.select("level").distinct().collect())  # numbers between LEVELS
    first, last = bin_of("a"), bin_of("b")
    i = i.withColumn("bin", F.explode(F.array_distinct(F.array(first, F.least(first + 1, last), last))))
    p = p.withColumn("level", F.explode(F.array(*[F.lit(x) for x in levels]).cast("array<int>"))).withColumn("bin", bin_of("t"))

    at, n = ["k", "level", "bin"], points.count() * len(levels)
    hot = None
    if n > rows:
        size = _size_of_a_part(n, rows)
        crowded = p.groupBy(*at).count().where(F.col("count") > size).select(*at, F.ceil(F.col("count") / size).cast("int").alias("parts")).collect()  # fewer than MAX_PARTS
        if crowded:
            hot = points.sparkSession.createDataFrame(crowded, T.StructType([p.schema[c] for c in at] + [T.StructField("parts", T.IntegerType())]))
    if hot is None:
        p, i = p.withColumn("part", F.lit(0)), i.withColumn("part", F.lit(0))
    else:
        # equal points go by a seeded number, which decides no result
        p = p.join(F.broadcast(hot), at, "left").withColumn("part", F.when(F.col("parts").isNotNull(), F.floor(F.rand(1) * F.col("parts")).cast("int")).otherwise(0)).drop("parts")
        i = i.join(F.broadcast(hot), at, "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    inside = (F.col("t") >= F.col("a")) & ((F.col("t") <= F.col("b")) if closed else (F.col("t") < F.col("b")))
    return p.join(i, [*at, "part"]).where(inside).select("row.*", "found.*")


def with_row_number(df: DataFrame, order: list[Column | str], name: str = "row_number") -> DataFrame:
    """df plus its rows' numbers from 1 in an order over the whole table; rows equal in it follow the hash of all they hold.

    Rows are dealt by ranges of the order and sorted there, and what precedes a range is the sum of the earlier ones' counts: one shuffle, no window. Rows of one
    place in the order are dealt too. The sorted rows are checkpointed, so counts and numbers are of the same ranges though a lost
    executor has them made again; counts, one a partition, are all that reaches the driver.
    """
    spark = df.sparkSession
    checkpoints_to_shared_dir(spark)
    hashed = [F.col(f"`{f.name}`") for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    sorts = [*order, F.xxhash64(*hashed)]
    rows = df.repartitionByRange(*sorts, F.rand(1)).sortWithinPartitions(*sorts)  # the random number deals rows that are the same in all
    rows = rows.select(_row(df.columns).alias("row"), F.monotonically_increasing_id().alias("id")).checkpoint()
    partition, place = F.shiftright("id", ROW_BITS), F.col("id").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    counts = sorted((r.at, r.n) for r in rows.groupBy(partition.alias("at")).agg(F.count("*").alias("n")).collect())
    upto, before = 0, []
    for at, n in counts:
        before.append((at, upto))
        upto += n
    before = F.broadcast(spark.createDataFrame(before, "at long, before long"))
    return rows.select("row", partition.alias("at"), place.alias("place")).join(before, "at").select("row.*", (F.col("before") + F.col("place") + 1).alias(name))


def top_rows(df: DataFrame, by: list[str], order: list[Column | str], k: int, name: str = "place") -> DataFrame:
    """The first k rows of each group and their places from 1. Ties in the order are broken arbitrarily: give an order without.

    Each task keeps k rows a group before the shuffle (the plan's partial WindowGroupLimit), so a group of any size sends k rows a task.
    """
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= k)
