"""Gradient-boosted regression trees of second order, grown for all folds of a cross-validation at once.

Each round adds a tree to every fold's model. A tree grows level by level; a level is one job over the rows, whatever the number of folds: each task sums gradients and hessians by fold, node, column and bin (numpy's bincount),
the sums of all tasks are added, on the driver where they are small (SUMS; they don't grow with the rows) and by tasks else, and give each fold's best split of every node. A split's gain is G²/(H + l2) of both sides minus that of the node; a leaf is -G/(H + l2), times the rate. The loss
is squared error, so a row's gradient is prediction - truth and its hessian 1.

A numeric column is cut at quantiles of each fold's training rows (at all its values if they are few); its missing values count as the training rows' median. A category is a
column of its own, 1 where the text column has it, so a split on it sets one value against all others; it needs no more room than the text column's code. A missing text counts as the training rows' mode.
Each tree sees a share of the rows, by a hash of the row's key, and a share of the columns, both drawn by seed, fold and round: neither depends on partitions.

Rows are kept as packed arrays, up to ROWS a pack, with the predictions of all folds and the rows drawn for the next tree, persisted with spilling; bins are numbers of a byte or two, and one array is all folds' where they see a column alike. Every round makes the next state from the last; every CUT rounds it is checkpointed in the shared folder, so that a lost
executor costs a few rounds at most. Where all rows are one pack, there are no other tasks' sums to be added, and each fold's trees are grown by the same steps in a task of its own, without a job for each level. Sums of a level take folds x nodes x bins numbers in a task; bins are at most 256 a numeric column, and text columns are bounded (prep.MAX_CATEGORIES).
"""

from __future__ import annotations

import pickle
import time
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline import SEED
from plumbline.operators import prep
from plumbline.operators.columns import Dataset, categorical_columns, numeric_columns
from plumbline.operators.split import FOLDS, ROWS, order_of
from plumbline.sources.shared import checkpoints_to_shared_dir

#: Rounds between checkpoints.
CUT = 25
#: Bytes of a level's sums, of all tasks, that may come to the driver to be added; more are added by tasks.
SUMS = 32_000_000
#: A split must gain more than this.
LEAST_GAIN = 1e-6
#: Gains that differ by less, relatively, are equal: sums of many tasks are added in any order.
TIE = 1e-10


@dataclass(frozen=True)
class Settings:
    rounds: int = 400
    depth: int = 4
    rate: float = 0.05
    row_share: float = 0.8
    column_share: float = 0.8
    l2: float = 1.0
    least_hessian: float = 1.0
    bins: int = 256
    seed: int = SEED


@dataclass
class Encoding:
    """How each fold sees the columns. edges[fold][numeric column]: a value's bin is the number of edges at or below it. fill[fold]: bin or code of a missing value, by column. codes: of categories, by text column."""

    numeric: list[str]
    text: list[str]
    edges: dict[int, list[np.ndarray]]
    fill: dict[int, np.ndarray]
    codes: list[dict[str, int]]
    starts: np.ndarray  # first bin of each column, and the end
    is_text: np.ndarray

    def bins(self, rows: pd.DataFrame, folds: Iterable[int]) -> dict[int, list[np.ndarray]]:
        """By fold, the bins of each column, counted from the column's first. Folds that see a column alike share its array."""
        out: dict[int, list[np.ndarray]] = {i: [] for i in folds}
        for k, name in enumerate([*self.numeric, *self.text]):
            kind = np.min_scalar_type(int(self.starts[k + 1] - self.starts[k]))
            if self.is_text[k]:
                codes = rows[name].map(self.codes[k - len(self.numeric)]).to_numpy(dtype=np.float64, na_value=np.nan)
                missing = np.isnan(codes)
            else:
                x = rows[name].to_numpy(dtype=np.float64, na_value=np.nan)
                missing = np.isnan(x)
            shared: list[tuple[np.ndarray | None, int, np.ndarray]] = []
            for i, columns in out.items():
                edges, fill = None if self.is_text[k] else self.edges[i][k], int(self.fill[i][k]) if missing.any() else -1
                own = next((a for e, f, a in shared if f == fill and (edges is None or np.array_equal(e, edges))), None)
                if own is None:
                    own = np.where(missing, fill, codes if edges is None else np.searchsorted(edges, x, side="right")).astype(kind)
                    shared.append((edges, fill, own))
                columns.append(own)
        return out


@dataclass
class Tree:
    """A complete tree by levels: the children of node i are 2i + 1 (the split holds) and 2i + 2. column -1 ends a branch. A split holds for bins up to `cut` of a numeric column, for the bin `cut` of a text column."""

    column: np.ndarray
    cut: np.ndarray
    value: np.ndarray


@dataclass
class Forest:
    """A fold's model: base value and trees."""

    base: float
    trees: list[Tree] = field(default_factory=list)


def empty_tree(depth: int) -> Tree:
    n = 2 ** (depth + 1) - 1
    return Tree(np.full(n, -1), np.zeros(n, dtype=np.int64), np.zeros(n))


def descended(tree: Tree, bins: list[np.ndarray], enc: Encoding, rows: np.ndarray, levels: int) -> tuple[list[tuple[int, np.ndarray]], list[tuple[int, np.ndarray]]]:
    """The nodes that rows (positions) have come to after some levels, each with its rows in their order: those of the last level, and the leaves above it."""
    at, above = [(0, rows)], []
    for _ in range(levels):
        below = []
        for node, own in at:
            column = int(tree.column[node])
            if column < 0:
                above.append((node, own))
                continue
            x, cut = bins[column][own], int(tree.cut[node] - enc.starts[column])
            holds = x == cut if enc.is_text[column] else x <= cut
            below += [(2 * node + 1, own[holds]), (2 * node + 2, own[~holds])]
        at = below
    return at, above


def add_values(tree: Tree, bins: list[np.ndarray], enc: Encoding, to: np.ndarray) -> None:
    """Adds the value of each row's leaf to the row's number."""
    for nodes in descended(tree, bins, enc, np.arange(len(to)), (len(tree.value) + 1).bit_length() - 2):
        for node, own in nodes:
            to[own] += tree.value[node]


def _mixed(x: np.ndarray) -> np.ndarray:
    """64 well-mixed bits of 64: multiply and shift, twice."""
    for k in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(k)
    return x ^ (x >> np.uint64(29))


def drawn_rows(keys: np.ndarray, share: float, seed: int, fold: int, turn: int) -> np.ndarray:
    if share >= 1:
        return np.ones(len(keys), dtype=bool)
    salt = _mixed(np.array([seed * 1_000_003 + fold * 100_003 + turn], dtype=np.uint64))
    return _mixed(keys ^ salt) < np.uint64(int(share * 2**64))


def drawn_columns(starts: np.ndarray, is_text: np.ndarray, share: float, seed: int, fold: int, turn: int) -> np.ndarray:
    """Which bins belong to a drawn column; each category is a column."""
    owner = np.zeros(starts[-1], dtype=np.int64)
    n = 0
    for k, text in enumerate(is_text):
        width = starts[k + 1] - starts[k]
        owner[starts[k] : starts[k + 1]] = np.arange(n, n + width) if text else n
        n += width if text else 1
    if share >= 1 or not n:
        return np.ones(starts[-1], dtype=bool)
    taken = np.random.default_rng([seed, fold, turn]).permutation(n)[: max(1, int(n * share))]
    return np.isin(owner, taken)


def best_splits(sums: np.ndarray, starts: np.ndarray, is_text: np.ndarray, allowed: np.ndarray, s: Settings) -> list[tuple | None]:
    """Of each node: (column, bin, gain, (G, H) of the side where the split holds, (G, H) of the other), or None. sums: nodes x bins x (G, H). Of equal gains the first bin's."""
    out = []
    whole = sums[:, starts[0] : starts[1]].sum(axis=1)  # every column has each row once
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.empty_like(sums)
        for k, text in enumerate(is_text):
            part = slice(starts[k], starts[k + 1])
            left[:, part] = sums[:, part] if text else np.cumsum(sums[:, part], axis=1)
        right = whole[:, None] - left
        score = lambda x: x[..., 0] ** 2 / (x[..., 1] + s.l2)
        gain = score(left) + score(right) - score(whole)[:, None]
    fits = (left[..., 1] >= s.least_hessian) & (right[..., 1] >= s.least_hessian) & (left[..., 1] > 0) & (right[..., 1] > 0)
    gain = np.where(fits & allowed[None], gain, -np.inf)
    for node, row in enumerate(gain):
        most = row.max()
        k = int((row >= most - TIE * max(1.0, abs(most))).argmax()) if most > LEAST_GAIN else 0
        if most > LEAST_GAIN:
            out.append((int(np.searchsorted(starts, k, side="right")) - 1, k, float(row[k]), tuple(left[node, k]), tuple(right[node, k])))
        else:
            out.append(None)
    return out


def encoding(dev: DataFrame, data: Dataset, bins: int, folds: int, features: list[str] | None = None) -> Encoding:
    """Quantiles, medians and modes of each fold's training rows, and the categories of text columns."""
    features = data.features if features is None else features
    numeric, text = numeric_columns(data.df, features), categorical_columns(data.df, features)
    prep.require_few_categories(dev, text)
    known = prep.statistics_by_fold(dev, numeric, text, folds)
    steps = [i / bins for i in range(bins)]
    value = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    wanted = [F.percentile_approx(F.when(F.col("pli") != i, value(c)), steps, 10 * bins).alias(f"{i}_{k}") for i in range(1, folds + 1) for k, c in enumerate(numeric)]
    found = dev.agg(*wanted).first() if wanted else {}
    # missing values are the median, which is a value like the others
    values = lambda i, k, c: np.unique(np.array([*(found[f"{i}_{k}"] or []), *([known[i][c]] if c in known[i] else [])], dtype=np.float64))
    edges = {i: [values(i, k, c)[1:] for k, c in enumerate(numeric)] for i in range(1, folds + 1)}
    codes = []
    for c in text:  # at most MAX_CATEGORIES
        codes.append({r.v: k for k, r in enumerate(dev.select(F.col(c).cast("string").alias("v")).where("v IS NOT NULL").distinct().orderBy("v").collect())})
    width = [*(max([0, *(len(edges[i][k]) for i in edges)]) + 1 for k in range(len(numeric))), *(len(c) + 1 for c in codes)]  # a text column's last bin: no category at all
    fill = {}
    for i in range(1, folds + 1):
        own = [int(np.searchsorted(edges[i][k], known[i].get(c, np.nan), side="right")) if c in known[i] else 0 for k, c in enumerate(numeric)]
        fill[i] = np.array([*own, *(codes[k].get(known[i].get(c), len(codes[k])) for k, c in enumerate(text))], dtype=np.int64)
    return Encoding(numeric, text, edges, fill, codes, np.concatenate([[0], np.cumsum(width)]).astype(np.int64), np.array([False] * len(numeric) + [True] * len(text)))


def packed(dev: DataFrame, data: Dataset, enc: Encoding, folds: int) -> RDD:
    """Packs of rows: key hashes, folds, truths, bins by fold, predictions by fold (0 so far)."""
    shared = dev.sparkSession.sparkContext.broadcast(enc)
    columns = [*(F.col(c).cast("double").alias(c) for c in enc.numeric), *(F.col(c).cast("string").alias(c) for c in enc.text)]
    rows = dev.select(F.xxhash64(order_of(data.key)).alias("_hash"), "pli", F.col(data.target).cast("double").alias("_y"), *columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0

        def pack() -> pd.DataFrame:
            df = pd.concat(held, ignore_index=True)
            y = df["_y"].to_numpy()
            p = {i: np.zeros(len(y)) for i in range(1, folds + 1)}
            state = {"key": df["_hash"].to_numpy().astype(np.uint64), "pli": df["pli"].to_numpy().astype(np.int32), "y": y, "bins": shared.value.bins(df, p), "p": p}
            return pd.DataFrame({"pack": [pickle.dumps(state, protocol=5)]})

        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= ROWS:
                yield pack()
                held, n = [], 0
        if n:
            yield pack()

    return rows.mapInPandas(run, "pack binary").rdd.map(lambda r: pickle.loads(r.pack))


def draw(state: dict, folds: Iterable[int], turn: int, s: Settings) -> None:
    """Puts into the state which rows each fold's next tree learns from, a bit a row: drawn once a tree, not once a level."""
    state["drawn"] = {i: np.packbits((state["pli"] != i) & drawn_rows(state["key"], s.row_share, s.seed, i, turn)) for i in folds}


def _level(states: Iterator[dict], forests: dict[int, Tree], level: int, enc: Encoding, s: Settings) -> Iterator[tuple[int, tuple[np.ndarray, float]]]:
    """(fold, (sums of the level's nodes x bins, seconds)) of a task's packs."""
    total, n_bins, width = {}, int(enc.starts[-1]), 2**level
    seconds = dict.fromkeys(forests, 0.0)
    for state in states:
        for i, tree in forests.items():
            began = time.perf_counter()
            bins, y = state["bins"][i], state["y"]
            if i not in total:
                total[i] = np.zeros((width, n_bins, 2))
            gradient = state["p"][i] - y
            used = np.flatnonzero(np.unpackbits(state["drawn"][i], count=len(y)))
            for node, own in descended(tree, bins, enc, used, level)[0]:  # others have come to their leaf above
                sums, g = total[i][node - (width - 1)], gradient[own]
                for k, column in enumerate(bins):
                    x, part = column[own].astype(np.intp), sums[enc.starts[k] : enc.starts[k + 1]]
                    part[:, 0] += np.bincount(x, weights=g, minlength=len(part))
                    part[:, 1] += np.bincount(x, minlength=len(part))
            seconds[i] += time.perf_counter() - began
    for i, sums in total.items():
        yield i, (sums, seconds[i])


def extended(tree: Tree, level: int, total: np.ndarray, allowed: np.ndarray, enc: Encoding, s: Settings) -> bool:
    """Splits the nodes of a level, as its sums say; whether any was split."""
    first, some = 2**level - 1, False
    if level == 0:
        g, h = total[0, : enc.starts[1]].sum(axis=0)
        tree.value[0] = -s.rate * g / (h + s.l2) if h else 0.0
    for node, split in enumerate(best_splits(total, enc.starts, enc.is_text, allowed, s), first):
        if split is not None:
            some = True
            tree.column[node], tree.cut[node] = split[:2]
            for child, (g, h) in zip((2 * node + 1, 2 * node + 2), split[3:], strict=True):
                tree.value[child] = -s.rate * g / (h + s.l2)
    return some


def grown_alone(fold: int, state: dict, base: float, enc: Encoding, s: Settings) -> tuple[Forest, float]:
    """A fold's model and the seconds it took, where one pack has all rows."""
    began, forest = time.perf_counter(), Forest(base)
    state["p"][fold][:] = base
    for turn in range(s.rounds):
        tree = empty_tree(s.depth)
        draw(state, [fold], turn, s)
        allowed = drawn_columns(enc.starts, enc.is_text, s.column_share, s.seed, fold, turn)
        for level in range(s.depth):
            found = dict(_level(iter([state]), {fold: tree}, level, enc, s))
            if not extended(tree, level, found[fold][0], allowed, enc, s):
                break
        add_values(tree, state["bins"][fold], enc, state["p"][fold])
        forest.trees.append(tree)
    return forest, time.perf_counter() - began


def fit_folds(dev: DataFrame, data: Dataset, s: Settings, folds: int = FOLDS, features: list[str] | None = None) -> tuple[Encoding, dict[int, Forest], dict[int, float]]:
    """The model of each fold, trained on the dev rows of all others; seconds of each fold's own work in tasks. dev has pli. A fold without training rows has no model."""
    spark = dev.sparkSession
    checkpoints_to_shared_dir(spark)
    enc = encoding(dev, data, s.bins, folds, features)
    y = F.col(data.target).cast("double")
    found = dev.groupBy("pli").agg(F.sum(y).alias("s"), F.count(y).alias("n"), F.count_if(y.isNull() | F.isnan(y)).alias("missing")).collect()  # a row a fold
    if any(r.missing for r in found):
        raise ValueError(f"{data.target} has missing values")
    sums = {r.pli: (r.s, r.n) for r in found}
    others = {i: [v for k, v in sums.items() if k != i] for i in range(1, folds + 1)}
    forests = {i: Forest(sum(a for a, _ in v) / sum(n for _, n in v)) for i, v in others.items() if v}
    shared, base = spark.sparkContext.broadcast(enc), {i: f.base for i, f in forests.items()}

    def start(state: dict) -> dict:
        for i, b in base.items():
            state["p"][i][:] = b
        draw(state, base, 0, s)
        return state

    state = packed(dev, data, enc, folds).map(start).persist(StorageLevel.MEMORY_AND_DISK)
    tasks, seconds = state.getNumPartitions(), dict.fromkeys(forests, 0.0)
    if not len(enc.is_text) or not forests:
        return enc, forests, seconds
    if state.count() == 1:
        own = state.flatMap(lambda x: [(i, x | {"bins": {i: x["bins"][i]}}) for i in base]).partitionBy(len(base), lambda i: i)
        for i, (forest, took) in own.map(lambda x: (x[0], grown_alone(*x, base[x[0]], shared.value, s))).collect():
            forests[i], seconds[i] = forest, took
        state.unpersist()
        return enc, forests, seconds
    stale: list[RDD] = []
    for turn in range(s.rounds):
        trees = {i: empty_tree(s.depth) for i in forests}
        allowed = {i: drawn_columns(enc.starts, enc.is_text, s.column_share, s.seed, i, turn) for i in forests}
        for level in range(s.depth):

            def level_sums(states, trees=trees, level=level):
                return _level(states, trees, level, shared.value, s)

            def grown(found, trees=trees, allowed=allowed, level=level):
                i, (total, took) = found
                began = time.perf_counter()
                some = extended(trees[i], level, total, allowed[i], shared.value, s)
                return i, trees[i], some, took + time.perf_counter() - began

            each, add = state.mapPartitions(level_sums), lambda a, b: (a[0] + b[0], a[1] + b[1])
            if tasks * len(trees) * 2**level * int(enc.starts[-1]) * 16 <= SUMS:  # no second stage to wait for
                parts: dict[int, tuple[np.ndarray, float]] = {}
                for i, part in each.collect():
                    parts[i] = add(parts[i], part) if i in parts else part
                splits = map(grown, parts.items())
            else:
                splits = each.reduceByKey(add, min(tasks, folds)).map(grown).collect()
            going = False
            for i, tree, some, took in splits:  # a tree a fold
                trees[i], going = tree, going or some
                seconds[i] += took
            while stale:  # this job has made the state that follows them
                stale.pop().unpersist()
            if not going:
                break
        for i, tree in trees.items():
            forests[i].trees.append(tree)

        def added(old: dict, trees=trees, turn=turn) -> dict:
            for i, tree in trees.items():
                add_values(tree, old["bins"][i], shared.value, old["p"][i])
            draw(old, trees, turn + 1, s)
            return old

        stale.append(state)
        state = state.map(added).persist(StorageLevel.MEMORY_AND_DISK)
        if turn % CUT == CUT - 1:
            state.checkpoint()
            state.count()
    for rdd in (*stale, state):
        rdd.unpersist()
    return enc, forests, seconds


def predicted(rows: DataFrame, data: Dataset, enc: Encoding, forests: dict[int, Forest], keep: list[str]) -> DataFrame:
    """keep and prediction: of each row by the model of its own fold; null without a model."""
    shared = rows.sparkSession.sparkContext.broadcast((enc, forests))
    columns = [*(F.col(c).cast("double").alias(f"_x{k}") for k, c in enumerate(enc.numeric)), *(F.col(c).cast("string").alias(f"_t{k}") for k, c in enumerate(enc.text))]
    narrow = rows.select(*keep, F.col("pli").alias("_fold"), *columns)
    names = {f"_x{k}": c for k, c in enumerate(enc.numeric)} | {f"_t{k}": c for k, c in enumerate(enc.text)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, forests = shared.value
        for batch in batches:
            out = np.full(len(batch), np.nan)
            inputs = batch[list(names)].rename(columns=names)
            for fold, forest in forests.items():
                own = (batch["_fold"] == fold).to_numpy()
                if own.any():
                    bins = enc.bins(inputs[own], [fold])[fold]
                    total = np.full(own.sum(), forest.base)
                    for tree in forest.trees:
                        add_values(tree, bins, enc, total)
                    out[own] = total
            yield batch[keep].assign(prediction=out)

    schema = rows.select(*keep).schema.add("prediction", "double")
    return narrow.mapInPandas(run, schema).withColumn("prediction", F.nanvl("prediction", F.lit(None).cast("double")))
