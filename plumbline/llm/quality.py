"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of each whole text (character classes, words, lines, repetition) are binned by quantiles; trees of
fixed depth are grown level by level from histograms of logistic gradients and hessians. The trees
are flattened into arrays of features, thresholds and leaves, which numpy walks for a whole batch at a time.

The classifier is fitted on at most `max_rows` labelled rows, those of the smallest hashes of doc_id; their
statistics (a few MB, bounded by max_rows) come to the driver, and the flat trees (bounded by their
number and depth) go to the tasks. Scoring is one map over all rows, without a shuffle.

Null and empty texts have statistics too (all zero) and get a score. Null labels are ignored; a document labelled more than
once counts by the mean of its labels. Without labels every score is 0.5. Repeated rows are
scored alike; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import held_out

MAX_ROWS = 20_000
TREES, DEPTH, RATE, BINS, L2, MIN_HESSIAN = 80, 4, 0.15, 64, 1.0, 2.0
THRESHOLD = 0.3

#: Byte classes whose shares are statistics.
CLASSES = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b".,", b"#$%&*", b"|", b"!", b"<>{}()[]/\\=;:_@\"'-", bytes(range(128, 256)))
_CLASS = np.full(256, len(CLASSES), dtype=np.int64)
for _k, _c in enumerate(CLASSES):
    _CLASS[list(_c)] = _k
N_STATS = len(CLASSES) + 14


def statistics(text: str) -> list[float]:
    """N_STATS numbers of one whole text; all zero for an empty one."""
    data = text.encode()
    if not data:
        return [0.0] * N_STATS
    counts = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    shares = np.bincount(_CLASS, weights=counts, minlength=len(CLASSES) + 1)[:-1] / len(data)
    used = counts[counts > 0] / len(data)
    words = data.split()
    n = max(1, len(words))
    seen = Counter(words)
    lines = [x for x in data.split(b"\n") if x]
    kinds = Counter(lines)
    m = max(1, len(lines))
    return [
        *shares.tolist(),
        float(np.log1p(len(data))),
        float(-(used * np.log2(used)).sum()),
        sum(map(len, words)) / n,
        len(seen) / n,
        max(seen.values(), default=0) / n,
        sum(map(bytes.__eq__, words, words[1:])) / n,
        len(set(zip(words, words[1:], strict=False))) / n,
        sum(map(bytes.isupper, words)) / n,
        sum(c for w, c in seen.items() if not (w[-1:].isalnum() or w[-1] > 127 or w[-1:] in b".,")) / n,
        max(map(len, words), default=0) / n,
        float(np.log1p(len(lines))),
        len(data) / m,
        sum(c for c in kinds.values() if c > 1) / m,
        sum(c for x, c in kinds.items() if x[-1:] not in b".!?") / m,
    ]


@dataclass
class Forest:
    """Complete binary trees, flat: the children of node i are 2i+1 and 2i+2."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray  # a row goes right if its value is above
    leaf: np.ndarray  # trees x leaves

    def score(self, x: np.ndarray) -> np.ndarray:
        rows, total = np.arange(len(x)), np.full(len(x), self.base)
        depth = self.leaf.shape[1].bit_length() - 1 if self.leaf.size else 0
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - (len(leaf) - 1)]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Forest:
    """Rows of statistics and labels 0/1 -> trees. Without rows, a forest that says 0.5."""
    inner, leaves = (1 << depth) - 1, 1 << depth
    out = Forest(0.0, np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves)))
    if not len(x):
        return out
    mean = (y.sum() + 0.5) / (len(y) + 1)
    out.base = float(np.log(mean / (1 - mean)))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)])
    margin = np.full(len(y), out.base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), dtype=np.int64)  # within its level
        for level in range(depth):
            n, first = 1 << level, (1 << level) - 1
            best, feature, cut = np.full(n, 1e-9), np.zeros(n, np.int64), np.full(n, BINS)
            for f, b in enumerate(binned):
                gs, hs = (np.bincount(node * BINS + b, weights=w, minlength=n * BINS).reshape(n, BINS).cumsum(1) for w in (g, h))
                gl, hl = gs[:, :-1], hs[:, :-1]
                gr, hr = gs[:, -1:] - gl, hs[:, -1:] - hl
                gain = gl**2 / (hl + L2) + gr**2 / (hr + L2) - gs[:, -1:] ** 2 / (hs[:, -1:] + L2)
                gain[(hl < MIN_HESSIAN) | (hr < MIN_HESSIAN)] = 0
                k = gain.argmax(1)
                top = gain[np.arange(n), k]
                better = top > best
                best, feature, cut = np.where(better, top, best), np.where(better, f, feature), np.where(better, k, cut)
            out.feature[t, first : first + n] = feature
            out.threshold[t, first : first + n] = [edges[f][c] if c < len(edges[f]) else np.inf for f, c in zip(feature, cut, strict=True)]
            node = 2 * node + (binned[feature[node], np.arange(len(y))] > cut[node])
        gs, hs = (np.bincount(node, weights=w, minlength=leaves) for w in (g, h))
        out.leaf[t] = -RATE * gs / (hs + L2)
        margin += out.leaf[t][node]
    return out


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [statistics(x.as_py()) for x in batch.column("_text")]
        keep = [c for c in batch.schema.names if c != "_text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(found, pa.list_(pa.float64()))], names=[*keep, "stats"])


def fit_on(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Forest:
    """Fit on labelled documents outside the held-out fold."""
    known = labels.where(labels["quality"].isNotNull() & labels["doc_id"].isNotNull() & ~held_out(labels["doc_id"], 5, 0))
    known = known.groupBy(known["doc_id"].alias("doc_id")).agg((F.avg("quality") >= 0.5).cast("double").alias("y"))
    ids = docs.select(docs["doc_id"].alias("doc_id")).distinct()
    sample = known.join(ids, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    texts = docs.select(docs["doc_id"].alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("_text"))
    rows = texts.join(F.broadcast(sample), "doc_id")  # at most max_rows ids
    out = T.StructType([rows.schema["doc_id"], rows.schema["y"], T.StructField("stats", T.ArrayType(T.DoubleType()))])
    # a document that has several rows counts once, by the one whose statistics come first
    found = rows.select("doc_id", "y", "_text").mapInArrow(_statistics, out).groupBy("doc_id", "y").agg(F.min("stats").alias("stats")).orderBy("doc_id").collect()
    return fit(np.array([r.stats for r in found]), np.array([r.y for r in found]))


def score(docs: DataFrame, forest: Forest, keep: list[str] | None = None) -> DataFrame:
    """keep (doc_id unless given) plus score double, predicted int."""
    return _scored(docs, forest, ["doc_id"] if keep is None else keep).select("kept.*", "score", "predicted")


def _scored(docs: DataFrame, forest: Forest, keep: list[str]) -> DataFrame:
    """kept (a struct, so that no name of docs can clash), score, predicted."""
    rows = docs.select(F.struct(*[docs[c] for c in keep]).alias("kept"), F.coalesce(docs["text"], F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t.as_py()) for t in batch.column("text")]).reshape(-1, N_STATS)
            s = forest.score(x)
            yield pa.RecordBatch.from_arrays([batch.column("kept"), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=["kept", "score", "predicted"])

    return rows.mapInArrow(run, rows.drop("text").schema.add("score", "double").add("predicted", "integer"))


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier accepts, all columns."""
    return _scored(docs, fit_on(docs, labels), docs.columns).where("predicted = 1").select("kept.*")


def op3_quality(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score(docs, fit_on(docs, labels)).select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted")
