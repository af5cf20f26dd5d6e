"""Language identification with a byte convolutional network.

Bytes of the lower-cased text are embedded, filters of several widths slide over windows of fixed
length, each filter's maximum in a window feeds a softmax over the languages. The network is trained
in numpy (Adam) on windows of labelled documents. For application embedding and filters fold into
tables: the value of a filter of width w at a place is a sum of table rows, one for each pair of bytes.
All windows of a text are scored and their log-probabilities averaged by length.

Training takes at most `per_language` documents of each of at most `max_languages` languages (the most frequent ones), those of the smallest hashes of id and text, and up to four windows from
each: a bounded sample (a few MB) on the driver. Rows are drawn where they are read, windows are cut there, and equal rows count once: no text is
shuffled, and no id, null or repeated, can enlarge the sample. The tables have a fixed size and go to the tasks by broadcast. Applying is one map over all rows, without a shuffle.

A null text, an empty one, or one without a letter is `und` with score 0. Null languages teach nothing; without
any labelled text all is `und`. Repeated rows are predicted alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import held_out

WINDOW, WIDTHS, FILTERS, EMBED = 256, (2, 3, 4), 16, 8
PER_LANGUAGE, MAX_LANGUAGES, WINDOWS_EACH, EPOCHS, BATCH, RATE, SEED = 800, 200, 4, 4, 64, 0.01, 7
UNKNOWN = "und"
#: A class that also holds number signs such as fractions, which are no letters.
_LETTER_OR_NUMBER = re.compile(r"[^\W\d_]")
#: Windows convolved at once.
BLOCK = 256


@dataclass
class Network:
    languages: list[str]
    embed: np.ndarray  # 256 x EMBED
    filters: list[np.ndarray]  # a width x EMBED x FILTERS each
    bias: np.ndarray  # all filters
    weights: np.ndarray  # all filters x languages
    offset: np.ndarray


def windows(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A text's windows, zero-padded, and their lengths."""
    n = max(1, -(-len(data) // WINDOW))
    out = np.zeros(n * WINDOW, dtype=np.uint8)
    out[: len(data)] = np.frombuffer(data, dtype=np.uint8)
    lengths = np.full(n, WINDOW)
    lengths[-1] = len(data) - (n - 1) * WINDOW
    return out.reshape(n, WINDOW), lengths


def log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


def loss_and_gradients(values: list[np.ndarray], rows: np.ndarray, truth: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """values: embedding, a filter bank for each width, bias, weights, offset. The mean cross-entropy of a batch and its gradient for each of values."""
    embed, *filters, bias, weights, offset = values
    e, n = embed[rows], len(rows)
    pooled, at = [], []
    for w, f in zip(WIDTHS, filters, strict=True):
        conv = sum(e[:, j : WINDOW - w + 1 + j] @ f[j] for j in range(w))
        place = conv.argmax(1)
        at.append(place)
        pooled.append(np.take_along_axis(conv, place[:, None], 1)[:, 0])
    before = np.concatenate(pooled, 1) + bias
    hidden = np.maximum(before, 0)
    logs = log_softmax(hidden @ weights + offset)
    loss = -float(logs[np.arange(n), truth].mean())
    p = np.exp(logs)
    p[np.arange(n), truth] -= 1
    p /= n
    down = (p @ weights.T) * (before > 0)
    grads = [np.zeros_like(embed), *(np.zeros_like(f) for f in filters), down.sum(0), hidden.T @ p, p.sum(0)]
    for i, (w, f) in enumerate(zip(WIDTHS, filters, strict=True)):
        d = down[:, i * FILTERS : (i + 1) * FILTERS]
        for j in range(w):  # only the place of each maximum passes a gradient
            read = np.take_along_axis(rows, at[i] + j, 1)
            grads[1 + i][j] = np.einsum("nfe,nf->ef", embed[read], d)
            np.add.at(grads[0], read, d[..., None] * f[j].T)
    return loss, grads


def initial(rng: np.random.Generator, k: int) -> list[np.ndarray]:
    total = FILTERS * len(WIDTHS)
    return [rng.normal(0, 0.3, (256, EMBED)), *(rng.normal(0, (w * EMBED) ** -0.5, (w, EMBED, FILTERS)) for w in WIDTHS), np.zeros(total), rng.normal(0, total**-0.5, (total, k)), np.zeros(k)]


def train(x: np.ndarray, y: np.ndarray, languages: list[str]) -> Network:
    """Windows (rows of bytes) and the index of each one's language -> network."""
    rng = np.random.default_rng(SEED)
    values = [v.astype(np.float32) for v in initial(rng, len(languages))]
    first, second, step = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for start in range(0, len(order), BATCH):
            batch = order[start : start + BATCH]
            _, grads = loss_and_gradients(values, x[batch], y[batch])
            step += 1
            for v, g, a, b in zip(values, grads, first, second, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                v -= RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    embed, *filters, bias, weights, offset = values
    return Network(languages, embed, filters, bias, weights, offset)


class Folded:
    """A network whose embedding and filters are tables over pairs of bytes."""

    def __init__(self, net: Network):
        self.net, self.tables = net, []
        for f in net.filters:
            single = [net.embed @ f[j] for j in range(len(f))]
            pairs = [(single[j][:, None] + single[j + 1][None]).reshape(65536, -1) for j in range(0, len(f) - 1, 2)]
            self.tables.append((pairs, single[-1] if len(f) % 2 else None))

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        """Rows of WINDOW bytes -> log-probabilities of the languages."""
        out = []
        for start in range(0, len(x), BLOCK):
            rows = x[start : start + BLOCK].astype(np.int32)
            pair = rows[:, :-1] << 8 | rows[:, 1:]
            pooled = []
            for w, (pairs, last) in zip(WIDTHS, self.tables, strict=True):
                n = WINDOW - w + 1
                conv = pairs[0][pair[:, :n]]
                for j, table in enumerate(pairs[1:], 1):
                    conv += table[pair[:, 2 * j : 2 * j + n]]
                if last is not None:
                    conv += last[rows[:, w - 1 : w - 1 + n]]
                pooled.append(conv.max(1))
            hidden = np.maximum(np.concatenate(pooled, 1) + self.net.bias, 0)
            out.append(log_softmax(hidden @ self.net.weights + self.net.offset))
        return np.concatenate(out)


def has_letter(text: str) -> bool:
    """Whether a text has a character of the Unicode category L."""
    return any(x.group().isalpha() for x in _LETTER_OR_NUMBER.finditer(text))


def predict(net: Folded, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and probability of each text; the windows of all texts are convolved together."""
    found = [t is not None and has_letter(t) and bool(net.net.languages) for t in texts]
    names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    parts = [windows(t.lower().encode()) for t, ok in zip(texts, found, strict=True) if ok]
    if not parts:
        return names, scores
    logs = net.log_probabilities(np.concatenate([w for w, _ in parts]))
    at = np.cumsum([0, *(len(n) for _, n in parts)])[:-1]
    lengths = np.concatenate([n for _, n in parts])
    mean = np.add.reduceat(logs * lengths[:, None], at) / np.add.reduceat(lengths, at)[:, None]
    p = np.exp(log_softmax(mean))
    for i, row in zip(np.flatnonzero(found), p, strict=True):
        names[i], scores[i] = net.net.languages[int(row.argmax())], min(1.0, float(row.max()))
    return names, scores


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE, max_languages: int = MAX_LANGUAGES) -> DataFrame:
    """lang, rank, windows: of labelled documents outside the held-out fold, at most per_language of each language."""
    rows = docs.select(docs["doc_id"].alias("doc_id"), docs["lang"].cast("string").alias("lang"), docs["text"].alias("text"))
    rows = rows.where("lang IS NOT NULL AND text IS NOT NULL").where(~held_out(rows["doc_id"], 5, 0))
    rows = rows.select("lang", "text", F.xxhash64("doc_id", "text").alias("rank"))
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("rank").alias("n"), F.count("*").alias("rows")).orderBy(F.desc("rows"), "lang").limit(max_languages)
    # a hash below per_language / n keeps about that many; half as many again are drawn, then cut to the smallest hashes
    share = F.col("rank").bitwiseAND(F.lit((1 << 53) - 1)) / float(1 << 53)
    chosen = rows.join(F.broadcast(counts), "lang").where(share * F.col("n") <= 1.5 * per_language + 20).select("lang", "rank", "text")  # max_languages rows

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, parts = [], []
            for i, text in enumerate(batch.column("text")):
                if (text := text.as_py()) and has_letter(text):
                    w, _ = windows(text.lower().encode())
                    spread = np.unique(np.linspace(0, len(w) - 1, WINDOWS_EACH).round().astype(int))
                    keep.append(i)
                    parts.append(w[spread].tobytes())
            taken = batch.select(["lang", "rank"]).take(pa.array(keep, pa.int32()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(parts, pa.binary())], names=["lang", "rank", "windows"])

    found = chosen.mapInArrow(cut, "lang string, rank long, windows binary").groupBy("lang", "rank").agg(F.min("windows").alias("windows"))
    order = Window.partitionBy("lang").orderBy(F.col("rank").bitwiseAND(F.lit((1 << 53) - 1)), "rank")  # about 1.5 per_language rows each
    return found.withColumn("k", F.row_number().over(order)).where(F.col("k") <= per_language).drop("k")


def fit_on(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Network:
    """Fit on the sample."""
    found = sorted(sample(docs, per_language).collect())
    languages = sorted({r.lang for r in found})
    if not found:
        return train(np.zeros((0, WINDOW), np.uint8), np.zeros(0, np.int64), [])
    x = [np.frombuffer(r.windows, dtype=np.uint8).reshape(-1, WINDOW) for r in found]
    return train(np.concatenate(x), np.repeat([languages.index(r.lang) for r in found], [len(w) for w in x]), languages)


def identify(docs: DataFrame, net: Network, keep: list[str] | None = None) -> DataFrame:
    """keep (doc_id unless given) plus lang_pred string, score double."""
    keep = ["doc_id"] if keep is None else keep
    shared = docs.sparkSession.sparkContext.broadcast(net)
    rows = docs.select(F.struct(*[docs[c] for c in keep]).alias("kept"), docs["text"].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folded = Folded(shared.value)
        for whole in batches:
            for start in range(0, whole.num_rows, 200):
                batch = whole.slice(start, 200)
                names, scores = predict(folded, batch.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column("kept"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["kept", "lang_pred", "score"])

    return rows.mapInArrow(run, rows.drop("text").schema.add("lang_pred", "string").add("score", "double")).select("kept.*", "lang_pred", "score")


def op10_language(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, fit_on(docs)).select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "lang_pred", "score")
