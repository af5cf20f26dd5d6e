"""Mixing sources to target weights by capped water-filling.

Each source asks for its weight's share of the wanted words. A source stops at `max_epochs` times its
own size; what it leaves goes to the others by weight, until none is above. In closed form: with the
sources in order of cap / weight, (wanted - caps below) / (weights left) rises up to the first source that it does not
fill, where it is the water level, and falls from there on.

A source's target / size = whole + fraction. Every document is taken `whole` times; for the fraction,
documents are taken once more in a seeded order (MD5 of seed and id, then a hash of the text) until the next would pass the
source's target. So a source's plan is one row: its target, `whole`, and the last place in the order that is taken once more. That place is found without sorting
a source: sizes are summed by the first digits of the order, then, where the target falls, by more digits, until few rows are left to be walked. The documents
are read once for their sizes; taking them is a map with the plan, which is broadcast up to MAX_SOURCES sources and joined beyond.

Null and word-less texts have size 0. A null source is a source of its own, last in order. Rows with equal id and source are told apart by
their text; of rows that are the same in all three, where the fraction ends among them, as many are taken as fit. Rows without an id are ordered by their text. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import WORD, written

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MAX_EPOCHS = 2.0
SEED = 42
#: Hex digits of the order by which sizes are summed at a time (4096 buckets a source), and in all.
DIGITS, ALL_DIGITS = 3, 48
#: Rows of a source that are walked one by one.
WALK = 20_000
MAX_SOURCES = 10_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, share: float, max_epochs: float) -> DataFrame:
    """source, source_size, weight -> with target. One row a source: the table of sources is small beside the documents."""
    cap = max_epochs * F.col("source_size")
    ordered = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    full = sources.withColumn("cap", cap)
    up_to = full.select(
        "*",
        (F.sum("cap").over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("cap")).alias("below"),
        F.sum("weight").over(ordered.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("left"),
        (F.sum("source_size").over(Window.partitionBy()) * share).alias("wanted"),
    )
    level = up_to.withColumn("level", (F.col("wanted") - F.col("below")) / F.col("left"))
    return level.withColumn("water", F.max("level").over(Window.partitionBy())).select(
        "source", "source_size", F.least("cap", F.col("water") * F.col("weight")).alias("target")
    )


def order(doc_id: Column, text: Column, seed: int) -> Column:
    """Place of a row in the seeded order: 48 hexadecimal digits."""
    digest = F.lpad(F.lower(F.hex(F.xxhash64(text))), 16, "0")
    named = F.concat_ws("-", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), digest), F.lit(""))
    return F.concat(F.md5(named.cast("binary")), digest)


def _joined(rows: DataFrame, by_source: DataFrame) -> DataFrame:
    """rows with the columns of their source's row, of which there is at most one."""
    few = by_source.limit(MAX_SOURCES + 1).count() <= MAX_SOURCES
    named = by_source.withColumnRenamed("source", "of")
    return rows.join(F.broadcast(named) if few else named, F.col("source").eqNullSafe(F.col("of"))).drop("of")


def _last(rows: DataFrame, rest: DataFrame) -> DataFrame:
    """source, last, tie, fit: the last place in the order up to which the sizes of a source stay within its `rest`. A place is in if it is not above `last`, which may be a prefix; of the rows at `tie`, the next place, `fit` are in."""
    rows = rows.select("source", "place", "size")
    open_, found, base = rows, [], rest.select("source", "rest")
    for digits in range(DIGITS, ALL_DIGITS + 1, DIGITS):
        sums = open_.groupBy("source", F.substring("place", 1, digits).alias("prefix")).agg(F.sum("size").alias("n"), F.count("*").alias("rows"))
        upto = F.sum("n").over(Window.partitionBy("source").orderBy("prefix"))
        at = _joined(sums.withColumn("upto", upto), base).where(F.col("upto") > F.col("rest"))
        # the first bucket above: what is left for it, and how many rows it has
        cut = at.groupBy("source").agg(F.min_by(F.struct("prefix", (F.col("rest") - F.col("upto") + F.col("n")).alias("rest"), "rows"), "prefix").alias("c")).select("source", "c.*")
        cut = written(cut)
        last = digits >= ALL_DIGITS
        found.append(cut.where(F.lit(last) | (F.col("rows") <= WALK)))
        base = cut.where(~F.lit(last) & (F.col("rows") > WALK))
        if base.isEmpty():
            break
        open_ = _joined(open_, base.select("source", "prefix")).where(F.col("place").startswith(F.col("prefix"))).drop("prefix")
        base = base.select("source", "rest")
    cuts = found[0]
    for more in found[1:]:
        cuts = cuts.unionByName(more)
    walked = _joined(rows, cuts.select("source", "prefix", "rest")).where(F.col("place").startswith(F.col("prefix")))
    # equal rows share a place: they are one row here, and of those in which the cut falls some may fit
    walked = walked.groupBy("source", "prefix", "rest", "place").agg(F.sum("size").alias("n"), F.min("size").alias("each"))
    walked = walked.withColumn("upto", F.sum("n").over(Window.partitionBy("source").orderBy("place")))
    fits = F.floor(F.try_divide(F.col("rest") - F.col("upto") + F.col("n"), F.col("each")))
    over = F.col("upto") > F.col("rest")
    inside = walked.groupBy("source", "prefix").agg(F.max(F.when(~over, F.col("place"))).alias("last"), F.min(F.when(over, F.struct(F.col("place").alias("tie"), fits.alias("fit")))).alias("cut"))
    # a source that never passes its rest has no cut: all of it is in
    return inside.select("source", F.coalesce("last", "prefix").alias("last"), "cut.tie", "cut.fit")


def plan(rows: DataFrame, weights, share: float, max_epochs: float) -> DataFrame:
    """rows (source, size, place) -> one row a source: source, source_size, target, whole, last, tie, fit."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    sources = water_fill(sizes.withColumn("weight", weight), share, max_epochs)
    sources = sources.withColumn("whole", F.coalesce(F.floor(F.try_divide("target", F.col("source_size").cast("double"))), F.lit(0)).cast("long"))
    sources = written(sources.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")))
    last = _last(rows, sources).withColumnRenamed("source", "of")
    return written(sources.join(last, F.col("source").eqNullSafe(F.col("of")), "left").select("source", "source_size", "target", "whole", F.coalesce("last", F.lit("g")).alias("last"), "tie", F.coalesce("fit", F.lit(0)).cast("long").alias("fit")))


def _times(rows: DataFrame, planned: DataFrame, max_epochs: float) -> DataFrame:
    """rows (source, place and others) with the columns of their source's plan and `times`."""
    at = _joined(rows, planned)
    tied = (F.col("fit") > 0) & (F.col("place") == F.col("tie"))
    inside = F.col("place") <= F.col("last")
    if planned.where("fit > 0").isEmpty():
        at = at.withColumn("inside", inside)
    else:  # equal rows are numbered where they lie: by the part of the table they are read in, then within it
        lying = written(at.where(tied).withColumn("no", F.monotonically_increasing_id())).withColumn("part", F.shiftright("no", 33))
        parts = lying.groupBy("source", "part").agg(F.count("*").alias("rows"))
        before = (F.sum("rows").over(Window.partitionBy("source").orderBy("part")) - F.col("rows")).alias("before")  # a row a task and source
        parts = parts.select(F.col("source").alias("of"), F.col("part").alias("of_part"), before)
        lying = lying.withColumn("k", F.row_number().over(Window.partitionBy("source", "part").orderBy("no")))
        lying = lying.join(parts, F.col("source").eqNullSafe(F.col("of")) & (F.col("part") == F.col("of_part"))).withColumn("inside", F.col("k") + F.col("before") <= F.col("fit"))
        at = at.where(~F.coalesce(tied, F.lit(False))).withColumn("inside", inside).unionByName(lying.select(*at.columns, "inside"))
    return at.withColumn("times", F.col("whole") + F.when(F.col("whole") < max_epochs, F.col("inside").cast("long")).otherwise(0))


def _sized(docs: DataFrame, seed: int) -> DataFrame:
    return written(docs.select(docs["doc_id"].alias("doc_id"), docs["source"].alias("source"), n_words(docs["text"]).alias("size"), order(docs["doc_id"], docs["text"], seed).alias("place")))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, times (repetitions), taken (words)."""
    rows = _sized(docs, seed)
    at = _times(rows, plan(rows, weights, share, max_epochs), max_epochs)
    return at.select("doc_id", "source", "size", "source_size", "target", "times", (F.col("times") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """The rows of docs, each as often as the mixture takes it, all columns."""
    planned = plan(_sized(docs, seed), weights, share, max_epochs).select("source", "whole", "last", "tie", "fit")
    rows = docs.select(F.struct(*docs.columns).alias("row"), docs["source"].alias("source"), order(docs["doc_id"], docs["text"], seed).alias("place"))
    at = _times(rows, planned, max_epochs).select("row", F.col("times").cast("int").alias("times")).where("times > 0")
    return at.select("row", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("k")).select("row.*")


def op2_mixing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('42-' || coalesce(CAST(doc_id AS VARCHAR), '') || '-') AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
l AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - (sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING) - cap))
            / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w),
p AS (
  SELECT source, source_size, least(cap, max(level) OVER () * weight) AS target FROM l),
q AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size) END AS whole FROM p),
r AS (
  SELECT doc_id, size, source_size, target, whole,
         sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) <= target - whole * source_size AS extra
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, round(target, 6) AS target,
       CAST(size * (whole + CASE WHEN extra AND whole < 2 THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r
"""
