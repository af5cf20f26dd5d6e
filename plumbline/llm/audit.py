"""Audit of how filters interact, by Walsh-Hadamard sums.

A document is the mask of the filters that it fails. A part's counts of all masks follow from 32 sums: for each set S of filters, the documents
whose mask has an even number of filters in S, minus the others. These signed sums are one aggregate over the documents (by part and label), their inverse, the same sums divided by 32, is exact in whole
numbers, and whatever an order of the filters does is a sum over the 32 cells. A filter's Shapley value, its removals over all 120 orders, has a closed form: of a document's k failing filters each comes first in 120 / k orders.

Texts are read once: a row goes on as its part, its mask of the four filters that need no other row, and its text's SHA-256. A text's rows are summed by part, label, mask and id
before texts meet, so a text that many documents share is a few rows; a row fails E if its id is above its text's smallest.

Null texts are empty (fail A only, and E). A null source is the part '', together with an empty one. A row without an id is nobody's smaller id and never fails E. Rows of one id and text are no copies of each other:
no id is smaller. A document with several rows of labels is good or toxic if any of them says so; rows without labels are neither. An empty table has no part and gives no row. Other columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import WORD, table

FILTERS = "ABCDE"
CELLS = 2 ** len(FILTERS)
ORDERS = ["".join(p) for p in permutations(FILTERS)]


def fails(text: Column) -> dict[str, Column]:
    """Which of the filters A to D a text fails."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n = F.size(words)
    return {
        "A": n < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * n,
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 2 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def bit(name: str) -> int:
    return 1 << FILTERS.index(name)


def labelled(labels: DataFrame) -> DataFrame:
    """doc_id, good, toxic: one row an id."""
    return labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))


def masked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, good, toxic, mask, n: counts of rows by all five filters, several rows a mask."""
    rows = docs.select(docs["doc_id"].alias("doc_id"), F.coalesce(docs["source"], F.lit("")).alias("part"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    mask = sum((F.when(failed, bit(name)).otherwise(0) for name, failed in fails(F.col("text")).items()), F.lit(0))
    rows = rows.select("doc_id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), mask.alias("mask"))
    sides = [F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]
    rows = rows.join(labelled(labels), "doc_id", "left").select("doc_id", "part", "digest", "mask", *sides)
    cell = ["digest", "part", "good", "toxic", "mask"]
    by_id = rows.groupBy("doc_id", *cell).agg(F.count("*").alias("n"))
    # of each cell of a text: its rows, its smallest id and that id's rows
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    of_text = by_id.groupBy(*cell).agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("no_id"), first.alias("first"))
    smallest = of_text.groupBy("digest").agg(F.min("first.doc_id").alias("smallest"))
    own = of_text.join(smallest, "digest")
    whole = F.col("no_id") + F.when(F.col("first.doc_id") == F.col("smallest"), F.col("first.n")).otherwise(0)
    both = F.array(F.struct(F.col("mask"), whole.alias("n")), F.struct((F.col("mask") + bit("E")).alias("mask"), (F.col("n") - whole).alias("n")))
    return own.select("part", "good", "toxic", F.inline(both)).where("n > 0")


def signed(mask: Column, chosen: int) -> Column:
    """1 where an even number of the chosen bits is set in mask, else -1."""
    return 1 - 2 * (F.bit_count(mask.bitwiseAND(F.lit(chosen))) % 2)


def parity_sums(rows: DataFrame) -> DataFrame:
    """part, good, toxic, w (32 signed sums, in the order of S): one aggregate."""
    sums = [F.sum(F.col("n") * signed(F.col("mask"), s)).alias(f"w{s}") for s in range(CELLS)]
    return rows.groupBy("part", "good", "toxic").agg(*sums).select("part", "good", "toxic", F.array(*[f"w{s}" for s in range(CELLS)]).alias("w"))


def inverted(w: Column) -> Column:
    """32 counts, in the order of masks, from 32 signed sums: each is a signed sum of these, divided by 32 without a rest."""
    every = F.sequence(F.lit(0), F.lit(CELLS - 1))
    sign = lambda m, s: 1 - 2 * (F.bit_count(m.bitwiseAND(s)) % 2)
    total = lambda m: F.aggregate(F.transform(w, lambda x, s: x * sign(m, s)), F.lit(0).cast("long"), lambda a, x: a + x)
    return F.transform(every, lambda m: F.shiftright(total(m), len(FILTERS)))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    cells = parity_sums(masked(docs, labels)).withColumn("c", inverted(F.col("w")))
    only = lambda flag: F.transform("c", lambda x: F.when(F.col(flag), x).otherwise(F.lit(0).cast("long")))
    long = cells.select("part", F.posexplode(F.arrays_zip(F.col("c").alias("n"), only("good").alias("good"), only("toxic").alias("toxic"))).alias("mask", "v"))
    sums = long.groupBy("part", "mask").agg(*[F.sum(f"v.{x}").alias(x) for x in ("n", "good", "toxic")])
    parts = sums.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 32 a part

    steps = [(order, k + 1, sum(bit(x) for x in order[:k]), bit(order[k])) for order in ORDERS for k in range(len(FILTERS))]
    grid = F.from_json(F.lit("[" + ",".join(f'{{"o":"{o}","s":{s},"b":{b},"f":{f}}}' for o, s, b, f in steps) + "]"), "array<struct<o:string,s:int,b:int,f:int>>")
    at = parts.select("part", "cells", F.inline(grid).alias("filter_order", "step", "before", "own"))
    before, own = F.col("before"), F.col("own")

    def total(of: str, *, without: Column | None = None, failing: Column | None = None, when=None) -> Column:
        """Sum over the cells that fail nothing of `without`, something of `failing`, and for which when(mask) holds."""

        def value(x: Column) -> Column:
            held = F.lit(True)
            if without is not None:
                held = held & (x["mask"].bitwiseAND(without) == 0)
            if failing is not None:
                held = held & (x["mask"].bitwiseAND(failing) != 0)
            if when is not None:
                held = held & when(x["mask"])
            return F.when(held, x[of]).otherwise(F.lit(0).cast("long"))

        return F.aggregate("cells", F.lit(0).cast("long"), lambda a, x: a + value(x))

    shares = F.aggregate("cells", F.lit(0).cast("long"), lambda a, x: a + F.when(x["mask"].bitwiseAND(own) != 0, x["n"] * (F.lit(len(ORDERS)) / F.bit_count(x["mask"])).cast("long")).otherwise(F.lit(0).cast("long")))
    return at.select(
        "part", "filter_order", "step",
        total("n", without=before.bitwiseOR(own)).alias("kept"),
        total("n", without=before, failing=own).alias("removed"),
        total("n", failing=own, when=lambda m: m.bitwiseAND(before) != 0).alias("redundant"),
        total("n", when=lambda m: m == own).alias("unique_fails"),
        total("good", without=before, failing=own).alias("good_lost"),
        total("toxic", without=before, failing=own).alias("toxic_lost"),
        shares.alias("shapley"),
    )


def op13_audit(spark, sf_dir):
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP13_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS smallest FROM d),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, {
    'A': len(words) < 200, 'B': 100 * len(list_distinct(words)) < 50 * len(words),
    'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text),
    'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(doc_id > smallest, false)} AS x
  FROM w LEFT JOIN l USING (doc_id)),
m AS (
  SELECT part, (CASE WHEN x.A THEN 'A' ELSE '' END) || (CASE WHEN x.B THEN 'B' ELSE '' END) || (CASE WHEN x.C THEN 'C' ELSE '' END) || (CASE WHEN x.D THEN 'D' ELSE '' END) || (CASE WHEN x.E THEN 'E' ELSE '' END) AS failing,
         count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM f GROUP BY ALL),
o AS (
  SELECT '' AS o UNION ALL SELECT o || v.x FROM o, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v(x) WHERE length(o) < 5 AND NOT contains(o, v.x)),
s AS (SELECT o AS filter_order, CAST(k AS INTEGER) AS step, o[1:k - 1] AS before, o[k] AS own FROM o, range(1, 6) r(k) WHERE length(o) = 5),
t AS (
  SELECT part, filter_order, step, n, good, toxic, length(failing) AS k, contains(failing, own) AS fails, failing = own AS alone,
         length(translate(failing, before, '')) < length(failing) AS gone
  FROM m, s)
SELECT part, filter_order, step, CAST(coalesce(sum(n) FILTER (NOT gone AND NOT fails), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (NOT gone AND fails), 0) AS BIGINT) AS removed,
       CAST(coalesce(sum(n) FILTER (gone AND fails), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (alone), 0) AS BIGINT) AS unique_fails,
       CAST(coalesce(sum(good) FILTER (NOT gone AND fails), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(toxic) FILTER (NOT gone AND fails), 0) AS BIGINT) AS toxic_lost,
       CAST(coalesce(sum(n * (120 // greatest(k, 1))) FILTER (fails), 0) AS BIGINT) AS shapley
FROM t GROUP BY part, filter_order, step
"""
