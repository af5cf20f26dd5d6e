"""Near-duplicate vectors by randomised-rotation binary codes.

Only vectors of one label and length are compared. Equal vectors are one class, and only classes go on. A class's unit vector y is turned by a random rotation (one a length, seeded); its code is the sign of each
coordinate, scaled to the unit vector c, and stored with the code is the factor f = <c, y>. For another vector x, <c, x> / f is an unbiased estimate of <y, x>, and as c = f y + sqrt(1 - f^2) e with a unit vector e
at right angles to y, a cosine of t or more puts <c, x> at f t - sqrt(1 - f^2) sqrt(1 - t^2) or above: the bound holds for certain, not with a confidence only. x itself is held in four bits a
coordinate, with the length of its rounding error, which the bound gets on top. Estimates are bit counts of code and bit planes, as Spark expressions. A pair whose estimates, both ways, may be of t goes to the exact cosine in double precision, no other.

Which pairs are estimated: those that share a cell. A cell is, in one of several tables, which coordinates of FACTORS further rotations are largest, and their signs. There are as many tables as
leave a pair of just the wanted cosine without a common cell with a chance below MISS (closer pairs far less); this is the only thing left to chance.

Cells of at most FULL classes pass on the classes that have a partner there by the estimate, each once. Those of larger cells all pass, dealt into blocks; pairs of blocks are compared, and no task gets a whole cell. Exact cosines are
products of matrices within a cell or pair of blocks; a pair of several cells counts in the first table where it meets. No pair is ever a row: a cell gives each of its classes the number of vectors linked to it and one link of a tree.

Vectors that are null, empty, zero or hold null or non-finite components, and vectors without a label, are linked with nothing. Rows of one id are rows of their own: n_links counts all other linked rows. A
component is named by its smallest id, by null if no row has one; `kept` compares ids only. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import table, written
from plumbline.llm.neardup import components

COSINE = 0.98
MISS = 1e-6
#: Rotations whose largest coordinates make a cell, and the classes of a label beyond which there is one more.
FACTORS, MANY = 2, 4_000_000
#: Classes of a cell that one task compares.
FULL = 2048
BITS = 4
SEED = 42
#: Room for rounding in double precision, far below what a bound decides.
SLACK = 1e-6


@lru_cache(maxsize=64)
def rotations(dim: int, n: int) -> np.ndarray:
    """n random rotations of a length."""
    rng = np.random.default_rng([SEED, dim])
    q, r = np.linalg.qr(rng.standard_normal((n, dim, dim)))
    return q * np.sign(np.diagonal(r, axis1=1, axis2=2))[:, None, :]


def _top(y: np.ndarray) -> np.ndarray:
    """Which coordinate (last axis) is largest, and its sign."""
    at = np.abs(y).argmax(axis=-1)
    return 2 * at + (np.take_along_axis(y, at[..., None], -1)[..., 0] < 0)


@lru_cache(maxsize=64)
def n_tables(dim: int, factors: int, cosine: float = COSINE, miss: float = MISS) -> int:
    """Tables that leave a pair of a cosine without a common cell with a chance below `miss`, by the share of 40,000 random pairs whose largest coordinates agree, less four standard errors."""
    rng = np.random.default_rng([SEED, dim, 1])
    x = rng.standard_normal((40_000, dim))
    x /= np.linalg.norm(x, axis=1)[:, None]
    if dim == 1:
        return 1
    e = rng.standard_normal(x.shape)
    e -= (e * x).sum(axis=1)[:, None] * x
    e /= np.linalg.norm(e, axis=1)[:, None]
    p = (_top(x) == _top(cosine * x + math.sqrt(1 - cosine**2) * e)).mean()
    p = min(p - 4 * math.sqrt(p * (1 - p) / len(x)), 1 - 1e-9) ** factors
    return math.ceil(math.log(miss) / math.log(1 - p))


def usable(vector: Column) -> Column:
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(vector, good) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _digests(rows: DataFrame) -> DataFrame:
    """rows (vec_id, label, vector) with a digest of the vector, null where it is linked with nothing."""

    @F.pandas_udf("binary")
    def digest(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda v: None if v is None else hashlib.blake2b(np.asarray(v, dtype=np.float64).tobytes(), digest_size=16).digest())

    linked = F.col("label").isNotNull() & usable(F.col("vector"))
    return rows.withColumn("vector", F.when(linked, F.col("vector"))).withColumn("digest", digest("vector"))


def encoded(classes: DataFrame, words: int, factors: int, cosine: float = COSINE) -> DataFrame:
    """c, label, n, unit (the vector of length 1), cells (one a table), and of the code: f, lo, step, err, and in 64-bit words c0.. and planes p0_0..; words: of the longest vectors."""
    names = [f"c{w}" for w in range(words)] + [f"p{b}_{w}" for b in range(BITS) for w in range(words)]
    schema = "c long, label long, n long, dim int, unit array<double>, cells array<long>, f double, lo double, step double, err double, " + ", ".join(f"{x} long" for x in names)

    def packed(bits: np.ndarray) -> np.ndarray:
        """Rows of 0 and 1 as 64-bit words."""
        room = np.zeros((len(bits), 64 * words), dtype=bool)
        room[:, : bits.shape[1]] = bits
        return np.packbits(room, axis=1).view(">i8").astype(np.int64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            dims = batch["vector"].map(len)
            for dim, own in batch.groupby(dims):
                x = np.array([np.asarray(v, dtype=np.float64) for v in own["vector"]])
                x /= np.abs(x).max(axis=1)[:, None]  # squares neither overflow nor vanish
                x /= np.linalg.norm(x, axis=1)[:, None]
                tables = n_tables(dim, factors, cosine)
                turn = rotations(dim, 1 + tables * factors)
                y = x @ turn[0]
                bits = y >= 0
                f = np.abs(y).sum(axis=1) / math.sqrt(dim)
                lo = y.min(axis=1)
                step = np.maximum(y.max(axis=1) - lo, 1e-300) / (2**BITS - 1)
                level = np.clip(np.rint((y - lo[:, None]) / step[:, None]), 0, 2**BITS - 1).astype(np.int64)
                err = np.linalg.norm(lo[:, None] + step[:, None] * level - y, axis=1)
                key = np.zeros((len(x), tables), dtype=np.int64)
                for t in range(tables):
                    for k in range(factors):
                        key[:, t] = key[:, t] * 2 * dim + _top(x @ turn[1 + t * factors + k])
                out = {"c": own["c"].to_numpy(), "label": own["label"].to_numpy(), "n": own["n"].to_numpy(), "dim": np.full(len(x), dim, dtype=np.int32), "unit": list(x), "cells": list(key), "f": f, "lo": lo, "step": step, "err": err}
                for name, planes in [("c", bits), *[(f"p{b}_", (level >> b) & 1) for b in range(BITS)]]:
                    out |= {f"{name}{w}": column for w, column in enumerate(packed(planes).T)}
                yield pd.DataFrame(out)

    return classes.mapInPandas(run, schema)


def estimate(code: str, other: str, words: int, dim: Column) -> Column:
    """<c, x>: of the code of the row named `code` and the four-bit coordinates of the row named `other`."""
    of = lambda row, name: F.col(f"{row}.{name}")
    ones = sum((F.bit_count(of(code, f"c{w}")) for w in range(words)), F.lit(0))
    levels = sum((2**b * F.bit_count(of(other, f"p{b}_{w}")) for b in range(BITS) for w in range(words)), F.lit(0))
    common = sum((2**b * F.bit_count(of(code, f"c{w}").bitwiseAND(of(other, f"p{b}_{w}"))) for b in range(BITS) for w in range(words)), F.lit(0))
    return (of(other, "lo") * (2 * ones - dim) + of(other, "step") * (2 * common - levels)) / F.sqrt(dim.cast("double"))


def possible(code: str, other: str, words: int, cosine: float = COSINE) -> Column:
    """Whether the estimate of the cosine, <c, x> / f, is within its bound of `cosine`."""
    f = F.col(f"{code}.f")
    bound = F.sqrt(F.greatest(1 - f * f, F.lit(0.0))) * math.sqrt(1 - cosine**2) + F.col(f"{other}.err")
    return estimate(code, other, words, F.col(f"{code}.dim")) / f >= cosine - bound / f - SLACK


def linked(pairs: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """c, links, to: of the classes of one cell, or of two blocks of a cell, the vectors linked with each here and in no earlier table, and the first class of those it is connected with."""
    pairs = pairs.sort_values("c").drop_duplicates("c")
    n, slot, a, b = len(pairs), int(pairs["slot"].iloc[0]), int(pairs["a"].iloc[0]), int(pairs["b"].iloc[0])
    c, weight, block = pairs["c"].to_numpy(), pairs["n"].to_numpy(), pairs["block"].to_numpy()
    kind = pd.factorize(pd.MultiIndex.from_frame(pairs[["label", "dim"]]))[0]
    room = max(map(len, pairs["unit"]))
    unit = np.array([np.pad(np.asarray(v), (0, room - len(v))) for v in pairs["unit"]])
    cells = np.array([np.asarray(k)[:slot] for k in pairs["cells"]]).reshape(n, -1)
    links, tree, seen = np.zeros(n, dtype=np.int64), np.empty((n, n), dtype=bool), np.zeros(n, dtype=bool)
    for at in range(0, n, 256):
        rows = slice(at, min(at + 256, n))
        hit = (unit[rows] @ unit.T >= cosine) & (kind[rows, None] == kind[None, :])
        if a != b:
            hit &= block[rows, None] != block[None, :]
        hit[np.arange(hit.shape[0]), np.arange(rows.start, rows.stop)] = False
        tree[rows] = hit
        for t in range(slot):
            hit = hit & (cells[rows, t][:, None] != cells[None, :, t])
        links[rows] = hit @ weight
    first = np.arange(n)
    for k in range(n):
        if not seen[k]:
            found, new = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
            new[k] = True
            while new.any():
                found |= new
                new = tree[new].any(axis=0) & ~found
            seen |= found
            first[found] = k
    some = tree.any(axis=1)
    return pd.DataFrame({"c": c[some], "links": links[some], "to": c[first[some]]})


def near_vectors(rows: DataFrame, cosine: float = COSINE) -> DataFrame:
    """One row per row of rows (vec_id, embedding, label): vec_id, n_links, component_id, kept."""
    keyed = written(_digests(rows.select(rows["vec_id"].cast("long").alias("vec_id"), rows["label"].cast("long").alias("label"), rows["embedding"].cast("array<double>").alias("vector"))))
    same = keyed.where("digest IS NOT NULL").groupBy("label", "digest").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"), F.first("vector").alias("vector"))
    classes = written(same.withColumn("c", F.monotonically_increasing_id()))
    size = classes.agg(F.coalesce(F.max(F.size("vector")), F.lit(1)).alias("dim")).first()
    many = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    words, factors = -(-size.dim // 64), FACTORS + (many > MANY)
    codes = written(encoded(classes.select("c", "label", "n", "vector"), words, factors, cosine))

    light = [c for c in codes.columns if c not in ("unit", "cells", "label", "n")]
    cell = F.xxhash64("label", "dim", "slot", "key").alias("cell")
    entries = codes.select(*light, "label", F.posexplode("cells").alias("slot", "key")).select(cell, "slot", *light)
    sizes = written(entries.groupBy("cell").agg(F.count("*").alias("size")).where("size > 1"))
    # cells of one task: a class passes if the estimates leave it a partner
    few = entries.join(sizes.where(F.col("size") <= FULL).select("cell"), "cell", "left_semi")
    may = possible("x", "y", words, cosine) & possible("y", "x", words, cosine)
    passed = few.alias("x").join(few.alias("y"), (F.col("x.cell") == F.col("y.cell")) & (F.col("x.c") != F.col("y.c")) & may, "left_semi")
    zero = F.lit(0).cast("long")
    seats = passed.select("cell", "slot", "c", zero.alias("block"), zero.alias("a"), zero.alias("b"))
    # larger cells: blocks, each with itself and each other
    blocks = F.ceil(F.col("size") / FULL) * 2
    dealt = entries.select("cell", "slot", "c").join(sizes.where(F.col("size") > FULL), "cell").withColumn("block", F.pmod(F.xxhash64("c"), blocks)).withColumn("other", F.explode(F.sequence(zero, blocks - 1)))
    seats = seats.unionByName(dealt.select("cell", "slot", "c", "block", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b")))
    seats = written(seats)
    full = seats.join(codes.select("c", "label", "n", "dim", "unit", "cells"), "c")
    found = written(full.groupBy("cell", "slot", "a", "b").applyInPandas(lambda pairs: linked(pairs, cosine), "c long, links long, to long"))

    links = found.groupBy("c").agg(F.sum("links").alias("links"))
    labels = components(found.select(F.col("c").alias("u"), F.col("to").alias("v")))
    of = classes.select("c", "label", "digest", "n", "least").join(links, "c", "left").join(labels.select(F.col("node").alias("c"), F.col("label").alias("root")), "c", "left").withColumn("root", F.coalesce("root", "c"))
    names = of.groupBy("root").agg(F.min("least").alias("component_id"))
    of = of.join(names, "root").select("label", "digest", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    out = keyed.select("vec_id", "label", "digest").join(of, ["label", "digest"], "left")
    name = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), name.alias("component_id"), F.col("vec_id").eqNullSafe(name).alias("kept"))


def op12_vectors(spark, sf_dir):
    return near_vectors(table(spark, sf_dir, "embeddings"))


OP12_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
u AS (
  SELECT vec_id, label, x, sqrt(list_dot_product(x, x)) AS norm FROM v
  WHERE label IS NOT NULL AND len([y FOR y IN x IF y IS NULL OR NOT isfinite(y)]) = 0 AND len([y FOR y IN x IF y <> 0]) > 0),
l AS (SELECT a.vec_id AS i, b.vec_id AS j FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_dot_product(a.x, b.x) / (a.norm * b.norm) >= 0.98),
r AS (SELECT vec_id AS i, vec_id AS j FROM embeddings UNION SELECT r.i, l.j FROM r JOIN l ON r.j = l.i),
c AS (SELECT i, min(j) AS component_id FROM r GROUP BY i),
n AS (SELECT i, count(*) AS n FROM l GROUP BY i)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c ON e.vec_id = c.i LEFT JOIN n ON e.vec_id = n.i
"""
