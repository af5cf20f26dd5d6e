"""Linked vectors against all cosines, on groups of near copies; bounds that hold; larger cells in blocks; edge rows."""

import math

import numpy as np
import pytest

from plumbline.llm import vectors
from tests.oracle import compare

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>, label int, n int, cell string, slot int"


def plain(rows):
    """[(vec_id, n_links, component_id, kept)] in order of rows."""
    n = len(rows)
    good = [v is not None and lab is not None and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v, lab in rows]
    unit = [np.asarray(v, dtype=np.float64) / np.linalg.norm(np.asarray(v, dtype=np.float64)) if g else None for (_, v, _), g in zip(rows, good, strict=True)]
    near = [[j for j in range(n) if j != i and good[i] and good[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.98] for i in range(n)]
    out = []
    for i in range(n):
        found, new = {i}, [i]
        while new:
            for j in near[new.pop()]:
                if j not in found:
                    found.add(j)
                    new.append(j)
        name = min((rows[j][0] for j in found if rows[j][0] is not None), default=None)
        out.append((rows[i][0], len(near[i]), name, rows[i][0] == name))
    return out


def rows_of(seed, dim=64, groups=12, most=40):
    rng = np.random.default_rng(seed)
    vs = []
    for _ in range(groups):
        centre = rng.standard_normal(dim)
        noise = rng.choice([0.005, 0.09, 0.11, 0.14])
        for _ in range(rng.integers(1, most)):
            vs.append(centre / np.linalg.norm(centre) + noise * rng.standard_normal(dim) / math.sqrt(dim))
    vs += list(rng.standard_normal((60, dim)))
    rows = [(int(k), [float(np.float32(x)) for x in v], int(k) % 2 if k % 7 == 0 else 0) for k, v in zip(rng.permutation(len(vs)), vs, strict=True)]
    return rows + [(1000 + k, rows[k][1], rows[k][2]) for k in range(12)]


def sort(rows):
    return sorted(rows, key=repr)


def run(spark, rows, **more):
    frame = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)
    return sort((r.vec_id, r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(frame, **more).collect())


def test_groups(spark):
    rows = rows_of(3)
    want = plain(rows)
    assert run(spark, rows) == sort(want)
    assert sum(r[1] for r in want) > 1000 and 1 < len({r[2] for r in want}) < len(rows)


def test_blocks(spark, monkeypatch):
    """Cells of more than four classes are cut into blocks; three rotations a cell."""
    monkeypatch.setattr(vectors, "FULL", 4)
    monkeypatch.setattr(vectors, "MANY", 3)
    rows = rows_of(4, groups=5, most=30)
    assert run(spark, rows) == sort(plain(rows))


def test_edges(spark):
    one = [1.0, 2.0, 3.0]
    rows = [
        (1, one, 5), (2, one, 5), (2, one, 5), (None, one, 5), (3, [2.0, 4.0, 6.0], 5), (4, one, None), (5, None, 5), (6, [0.0, 0.0, 0.0], 5), (7, [1.0, None, 3.0], 5), (8, [1.0, float("nan"), 3.0], 5),
        (9, [float("inf"), 1.0, 1.0], 5), (10, [], 5), (11, [1.0, 2.0, 3.0, 0.0], 5), (12, one, 6), (13, [-1.0, -2.0, -3.0], 5), (None, [9.0, 0.0, 0.0], 7), (None, [9.0], 5), (14, [3.0], 5), (15, [-3.0], 5), (16, [1e-30, 2e-30, 3e-30], 5),
    ]
    assert run(spark, rows) == sort(plain(rows))
    assert run(spark, []) == []


@pytest.mark.parametrize("dim", [2, 8, 64, 100])
def test_bounds(spark, dim):
    """Pairs of the wanted cosine and above always pass the estimate; of random pairs of some length few do."""
    rng = np.random.default_rng(dim)
    x = rng.standard_normal((400, dim))
    x /= np.linalg.norm(x, axis=1)[:, None]
    e = rng.standard_normal(x.shape)
    e -= (e * x).sum(axis=1)[:, None] * x
    e /= np.linalg.norm(e, axis=1)[:, None]
    near = 0.98001 * x + math.sqrt(1 - 0.98001**2) * e
    frame = spark.createDataFrame([(k, 0, 1, [float(a) for a in v]) for k, v in enumerate([*x, *near])], "c long, label long, n long, vector array<double>")
    words = -(-dim // 64)
    codes = vectors.encoded(frame, words, 1).cache()
    pairs = codes.alias("x").join(codes.alias("y"), (vectors.F.col("y.c") == (vectors.F.col("x.c") + 400)))
    both = vectors.possible("x", "y", words) & vectors.possible("y", "x", words)
    assert pairs.where(both).count() == 400
    others = codes.alias("x").join(codes.alias("y"), vectors.F.col("y.c") == (vectors.F.col("x.c") * 7 + 1) % 400).where("x.c < 400")
    if dim >= 64:
        assert others.where(both).count() <= 2
    u = {r.c: np.array(r.unit) for r in codes.select("c", "unit").collect()}
    rows = pairs.select(vectors.F.col("x.c").alias("a"), vectors.F.col("y.c").alias("b"), (vectors.estimate("x", "y", words, vectors.F.col("x.dim")) / vectors.F.col("x.f")).alias("e")).collect()
    if dim >= 64:
        assert abs(np.mean([r.e - u[r.a] @ u[r.b] for r in rows])) < 0.01
    codes.unpersist()


def test_sql(spark):
    compare(spark, SF, vectors.op12_vectors, vectors.OP12_SQL)
