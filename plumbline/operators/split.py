"""Exact-size holdout and folds as columns.

Rows are ordered by the MD5 of seed and key. The first ceil(share * n) of them are the holdout; the rest is cut into k folds whose sizes
differ by one at most, larger ones first. The assignment depends on seed and keys only: not on partitions, row order or other columns.

Nothing is sorted as a whole. The rows where holdout and folds end are found by counting, over keys that are read once and dealt to all cores: hashes are counted by their first
hex digits, then, only below the digits in which a border falls, by more digits, until few rows are left there. The k borders, all that
reaches the driver besides at most 4096 counts a border and round, become literals, and assigning rows is a map without a shuffle.

Keys should be unique; rows with equal keys always land on the same side. A NULL key counts as an empty text. An empty table has neither holdout nor folds.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline import SEED

HOLDOUT, FOLDS = 0.2, 5
DIGITS = 3
#: Rows that one task may have before they are dealt to all cores, and rows of a task at most.
ROWS, MOST = 100_000, 5_000_000
#: Rows below a border's digits that are ranked directly.
FEW = 100_000


def order_of(key: str, seed: int = SEED) -> Column:
    """What rows are ordered by: hex MD5, then the key's text."""
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    return F.concat_ws("-", F.md5(F.concat_ws("-", F.lit(str(seed)), text).cast("binary")), text)


def holdout_size(n: int, share: float = HOLDOUT) -> int:
    return math.ceil(share * n)


def fold_ends(n: int, folds: int = FOLDS) -> list[int]:
    """Rank of the last row of each fold."""
    small, larger = divmod(n, folds)
    return [small * (i + 1) + min(i + 1, larger) for i in range(folds)]


def order_statistics(orders: DataFrame, ranks: list[int]) -> dict[int, str]:
    """Values of the column `o` (hex digits first) at some ranks, from 1."""
    open_ = {r: ("", r) for r in ranks}  # rank -> digits known, rank among the rows with these digits
    n_digits = 0
    while open_ and n_digits < 32:
        n_digits += DIGITS
        rows = orders
        if n_digits > DIGITS:
            rows = rows.where(F.substring("o", 1, n_digits - DIGITS).isin(sorted({p for p, _ in open_.values()})))
        counts = rows.groupBy(F.substring("o", 1, n_digits).alias("p")).count().collect()
        most = 0
        for rank, (prefix, left) in list(open_.items()):
            for p, n in sorted((r.p, r["count"]) for r in counts if r.p.startswith(prefix)):
                if left <= n:
                    open_[rank], most = (p, left), max(most, n)
                    break
                left -= n
            else:
                raise ValueError(f"no row of rank {rank}")
        if most <= FEW:
            break
    if not open_:
        return {}
    p = F.substring("o", 1, n_digits)
    near = orders.where(p.isin(sorted({x for x, _ in open_.values()}))).select("o", p.alias("p"))
    ranked = near.withColumn("k", F.row_number().over(Window.partitionBy("p").orderBy("o")))
    wanted = F.create_map(*[F.lit(x) for x in _grouped(open_)]) if open_ else None
    found = {(r.p, r.k): r.o for r in ranked.where(F.array_contains(wanted[F.col("p")], F.col("k"))).collect()}
    return {rank: found[place] for rank, place in open_.items()}


def _grouped(places: dict[int, tuple[str, int]]) -> list:
    by: dict[str, list[int]] = {}
    for prefix, k in places.values():
        by.setdefault(prefix, []).append(k)
    return [x for prefix, ks in by.items() for x in (prefix, sorted(set(ks)))]


def with_folds(df: DataFrame, key: str, share: float = HOLDOUT, folds: int = FOLDS, seed: int = SEED) -> DataFrame:
    """df plus is_hold boolean and pli int (the fold from 1; NULL in the holdout)."""
    n = df.count()
    hold = holdout_size(n, share)
    ends = [hold, *(hold + e for e in fold_ends(n - hold, folds))]
    keys = dealt(df.select(key), key, n).persist()
    try:
        borders = order_statistics(keys.select(order_of(key, seed).alias("o")), sorted({e for e in ends if e > 0}))
    finally:
        keys.unpersist()
    o = F.col("_order")  # a column of its own, so that a row is hashed once for all borders
    is_hold = o <= F.lit(borders[hold]) if hold else F.lit(False)
    fold = F.lit(1)
    for e in ends[1:-1]:
        fold = fold + ((o > F.lit(borders[e])) if e else F.lit(True)).cast("int")
    ordered = df.withColumn("_order", order_of(key, seed)).withColumn("is_hold", is_hold)
    return ordered.withColumn("pli", F.when(~F.col("is_hold"), fold).cast("int")).drop("_order")


def make_split(df: DataFrame, key: str, share: float = HOLDOUT, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(dev, hold): disjoint, complete, reproducible."""
    rows = with_folds(df, key, share, 1, seed)
    return rows.where("NOT is_hold").drop("is_hold", "pli"), rows.where("is_hold").drop("is_hold", "pli")


def holdout_ids(df: DataFrame, key: str, share: float = HOLDOUT, seed: int = SEED) -> DataFrame:
    """row_id of the holdout, in the order of the split."""
    _, hold = make_split(df, key, share, seed)
    return hold.orderBy(order_of(key, seed)).select(F.col(key).alias("row_id"))


def dealt(df: DataFrame, key: str, n: int) -> DataFrame:
    """df, of at most n rows, dealt by key to a task for each core, or to more of MOST rows each; up to ROWS rows to one task. A small compressed file is read by few tasks, whatever its rows cost."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.coalesce(1) if n <= ROWS else df.repartition(max(cores, -(-n // MOST)), key)


def train_rows(df: DataFrame, fold: int) -> DataFrame:
    return df.where((F.col("pli") != fold) & ~F.col("is_hold"))


def valid_rows(df: DataFrame, fold: int) -> DataFrame:
    return df.where(F.col("pli") == fold)


def disjoint(a: DataFrame, b: DataFrame, key: str) -> bool:
    return a.join(b.select(key), key, "left_semi").isEmpty()


def compat_holdout(n: int, share: float = HOLDOUT, seed: int = SEED) -> np.ndarray:
    """Row positions that a seeded numpy permutation puts in the holdout, in order: for golden tests on small tables only."""
    return np.random.RandomState(seed).permutation(n)[: holdout_size(n, share)]
