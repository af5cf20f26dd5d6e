"""The classifier: a brute-force tree walk, held-out accuracy, edge rows."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from plumbline.llm import quality

SF = "/root/testdata/sf0.01"


def walk(forest, row):
    total = forest.base
    for feature, threshold, leaf in zip(forest.feature, forest.threshold, forest.leaf, strict=True):
        node = 0
        while node < len(feature):
            node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
        total += leaf[node - len(feature)]
    return 1 / (1 + np.exp(-total))


def test_flat_traversal_matches_a_plain_walk():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 5)).round(1)
    y = ((x[:, 0] > 0.2) ^ (x[:, 3] < -0.5)).astype(float)
    forest = quality.fit(x, y, trees=40, depth=3)
    got = forest.score(x)
    assert np.allclose(got, [walk(forest, r) for r in x])
    assert ((got >= 0.5) == (y == 1)).mean() > 0.97


def test_without_labels_every_score_is_a_half():
    assert quality.fit(np.zeros((0, 3)), np.zeros(0)).score(np.ones((2, 3))).tolist() == [0.5, 0.5]


def test_held_out_accuracy(spark):
    got = quality.op3_quality(spark, SF)
    assert got.count() == 1000
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = got.join(labels, "doc_id").where("held_out").select("doc_id", "predicted", "quality").collect()
    assert len(rows) > 40
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.95


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 0.0), (2, "", 0.0), (2, "", 0.0), (None, "ab " * 50_000, None), (4, "Good text.\nMore.", 1.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(4, 1, 0), (4, None, 0), (9, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = quality.score(docs, quality.fit_on(docs, labels)).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert quality.score(docs.limit(0), quality.fit_on(docs, labels.limit(0))).count() == 0
    assert quality.good_documents(docs, labels).columns == docs.columns
    assert quality.score(docs, quality.fit_on(docs, labels.limit(0))).where(F.col("score") == 0.5).count() == 5


def grown(rows, y, g, h, depth):
    """A tree by exhaustive search over the same candidate cuts: (feature, cut, left, right) or a leaf's value."""
    best = None
    if depth:
        for f, edges in enumerate(CUTS):
            for cut in edges:
                left = [i for i in rows if X[i][f] <= cut]
                right = [i for i in rows if X[i][f] > cut]
                hl, hr = sum(h[i] for i in left), sum(h[i] for i in right)
                if hl < quality.MIN_HESSIAN or hr < quality.MIN_HESSIAN:
                    continue
                gl, gr = sum(g[i] for i in left), sum(g[i] for i in right)
                gain = gl**2 / (hl + quality.L2) + gr**2 / (hr + quality.L2) - (gl + gr) ** 2 / (hl + hr + quality.L2)
                if gain > (best[0] if best else 1e-9) + 1e-12:
                    best = (gain, f, cut, left, right)
    if best is None:
        return -quality.RATE * sum(g[i] for i in rows) / (sum(h[i] for i in rows) + quality.L2)
    return best[1], best[2], grown(best[3], y, g, h, depth - 1), grown(best[4], y, g, h, depth - 1)


def said(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


RNG = np.random.default_rng(2)
X = RNG.normal(size=(160, 3)).round(2)
CUTS = [np.unique(np.quantile(c, np.linspace(0, 1, quality.BINS + 1)[1:-1])) for c in X.T]


def test_fit_matches_exhaustive_growing():
    """Histograms find the trees that trying every cut on every row finds."""
    y = ((X[:, 0] + 0.3 * RNG.normal(size=160) > 0) ^ (X[:, 2] > 1)).astype(float)
    forest = quality.fit(X, y, trees=3, depth=2)
    margin = np.full(len(y), forest.base)
    assert np.isclose(forest.base, np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    for _ in range(3):
        p = 1 / (1 + np.exp(-margin))
        tree = grown(range(len(y)), y, p - y, p * (1 - p), 2)
        margin += [said(tree, row) for row in X]
    assert np.allclose(forest.score(X), 1 / (1 + np.exp(-margin)))


def test_query_is_the_forest_on_whole_texts(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    forest = quality.fit_on(docs, labels)
    got = {r.doc_id: r for r in quality.op3_quality(spark, SF).collect()}
    for r in docs.collect():
        want = walk(forest, quality.statistics(r.text or ""))
        assert np.isclose(got[r.doc_id].score, want) and got[r.doc_id].predicted == (want >= 0.3)
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_several_texts_under_one_id(spark):
    """The text that teaches is the same in every run; no helper column clashes."""
    docs = spark.createDataFrame([(i % 5, f"Text {i}. " * (i % 3 + 1), i, 0.5, 1) for i in range(60)], "doc_id long, text string, _text int, score double, predicted int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(5)], "doc_id long, quality int")
    one, two = (quality.fit_on(d, labels) for d in (docs, docs.repartition(5)))
    assert one.leaf.tolist() == two.leaf.tolist() and one.base == two.base
    assert quality.good_documents(docs, labels).columns == docs.columns
