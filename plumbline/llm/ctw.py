"""Language-model scoring by context-tree weighting over bytes.

Every byte is eight binary decisions. For each decision there is a tree over the preceding bytes, 0 to DEPTH
of them; a node holds Krichevsky-Trofimov counts, and a context's probability mixes the estimates of
all depths by their weights: P_w = 1/2 P_kt + 1/2 prod P_w(children). A text is its words (ASCII letters in
lower case), each closed by a space, then one end byte; contexts reach back over the space before a word to the last REACH
bytes of the word before, so that only a word's first bytes depend on the word before. A context never seen in training says what
the longest seen one says.

How it runs. One map over the texts, in chunks of some megabytes, gives for each chunk its distinct words
with training counts, its distinct grams (context and byte) with training counts, both cut into parts by a hash and packed, and the sparse
table of its documents over its words and over the places where they stand. Counts go up a tree: FAN chunks are merged into one node, FAN nodes into one of the next
level, part by part, until FAN nodes at most are left; there each part of the words is counted in one group, and each part of the
grams grows and reads its trees in one group (by the two nearest context bytes). Answers come down the same tree. So a group holds one part of FAN nodes, whatever the number
of chunks. The two top levels of the context trees, at most 65,536 nodes whatever the input, meet on the driver. A chunk's answers are summed for each of its
documents. Texts are never shuffled, and nothing that grows with the input is collected or broadcast.

Null texts are empty; an empty text is its end. A null id is never held out. Repeated rows are scored one by one and train as often
as they occur. An empty table gives an empty result; without training documents every count is 0. Other columns are ignored.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import held_out, written

DEPTH = 5
#: Bytes of the word before that a context may reach.
REACH = 3
END = b"\n"
#: Bytes of text in a chunk.
CHUNK = 7 << 20
#: Nodes of the tree of counts that are merged into one.
FAN = 128
#: Strings spelled at a time.
BLOCK = 50_000
WORDS, GRAMS, TABLE = 0, 1, 2


def tokens(text: str) -> list[bytes]:
    """bytes.lower and bytes.split know ASCII only, as the definition of a word does."""
    return [*text.encode().lower().split(), END]


def grams(found: list[bytes], before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(context, byte) pairs, as integers, of some strings from `before` on, and the number of each string's pairs."""
    lengths = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    pad = b"\0" * DEPTH
    data = np.frombuffer(pad + pad.join(found), dtype=np.uint8).astype(np.int64)
    sizes = lengths - before
    starts = np.cumsum(lengths + DEPTH) - lengths + before
    at = np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
    out = data[at]
    for j in range(1, DEPTH + 1):
        out |= data[at - j] << (8 * j)
    return out, sizes


class _Index(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = at = len(self)
        return at


class Spelling:
    """Which bytes of some words depend on the word before: the head, the first DEPTH - 1 with the closing space. The
    rest, the tail, is the same behind every word. A place is a pair of the bytes before and a head."""

    def __init__(self, words: list[bytes]):
        heads, ends = _Index(), _Index({b"": 0})
        self.head = np.fromiter((heads[w if w == END else (w + b" ")[: DEPTH - 1]] for w in words), np.int64, len(words))
        self.end = np.fromiter((ends[w[-REACH:]] for w in words), np.int64, len(words))
        self.heads, self.ends = list(heads), list(ends)
        self.words = words
        self.long = np.flatnonzero(np.fromiter((len(w) >= DEPTH - 1 for w in words), bool, len(words)))

    def tails(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Word numbers, pairs, and the number of each word's pairs, a block at a time."""
        for i in range(0, len(self.long), BLOCK):
            at = self.long[i : i + BLOCK]
            yield at, *grams([b" " + self.words[k] + b" " for k in at.tolist()], np.full(len(at), DEPTH))

    def places(self, end: np.ndarray, head: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for i in range(0, len(end), BLOCK):
            e, h = ([names[k] for k in x[i : i + BLOCK].tolist()] for names, x in ((self.ends, end), (self.heads, head)))
            yield np.arange(i, i + len(e)), *grams([x + b" " + y for x, y in zip(e, h, strict=True)], np.fromiter(map(len, e), np.int64, len(e)) + 1)


def pack(*arrays: np.ndarray, tail: bytes = b"") -> bytes:
    """Integer arrays below 2**63, byte plane by byte plane, and some bytes, compressed."""
    out = [np.array([len(arrays), *map(len, arrays)], dtype=np.int64).tobytes()]
    for x in arrays:
        out.append(np.ascontiguousarray(x.astype(np.int64).view(np.uint8).reshape(-1, 8).T).tobytes())
    return zstandard.compress(b"".join([*out, tail]), 3)


def unpack(data: bytes) -> tuple[list[np.ndarray], bytes]:
    raw = zstandard.decompress(data)
    sizes = np.frombuffer(raw, np.int64, 1 + int(np.frombuffer(raw, np.int64, 1)[0]))[1:].tolist()
    at, out = 8 * (1 + len(sizes)), []
    for n in sizes:
        planes = np.frombuffer(raw, np.uint8, 8 * n, at).reshape(8, n)
        out.append(np.ascontiguousarray(planes.T).view(np.int64).reshape(n))
        at += 8 * n
    return out, raw[at:]


def _sparse(docs: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries of each document, their columns as steps (signed, so folded to even and odd), and their counts."""
    n = int(docs[-1]) + 1
    cells, counts = np.unique(docs << 32 | at, return_counts=True)
    steps = np.diff(cells & 0xFFFFFFFF, prepend=0)
    return np.bincount(cells >> 32, minlength=n), np.where(steps < 0, -2 * steps - 1, 2 * steps), counts


def _unfold(steps: np.ndarray) -> np.ndarray:
    return np.where(steps & 1, -(steps + 1) // 2, steps // 2).cumsum()


def _by_part(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each part that occurs and the numbers of its members, in order."""
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.diff(part[order])) + 1
    for at in np.split(order, cuts):
        if len(at):
            yield int(part[at[0]]), at


def word_parts(words: list[bytes], parts: int) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) % parts for w in words), np.int64, len(words))


def gram_parts(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((keys >> 8) & 0xFFFF) * 40_503 % 65_521 % parts


class Chunk:
    """Documents gathered until they are enough for one chunk."""

    def __init__(self):
        self.size, self.index, self.docs, self.at = 0, _Index(), [], []

    def add(self, doc_id: int | None, held: bool, text: str) -> None:
        found = tokens(text)
        self.docs.append((0 if doc_id is None else doc_id, doc_id is None, held, len(found), sum(map(len, found)) + len(found) - 1))
        self.at.append(np.fromiter(map(self.index.__getitem__, found), dtype=np.int32, count=len(found)))
        self.size += len(text) + 64

    def rows(self, parts: int) -> Iterator[tuple[int, int, int, bytes]]:
        """(chunk, kind, part, packed)."""
        name = int.from_bytes(os.urandom(8), "little") >> 1
        docs, at = np.array(self.docs, dtype=np.int64), np.concatenate(self.at).astype(np.int64)
        of = np.repeat(np.arange(len(docs)), docs[:, 3])
        words = list(self.index)
        spelling = Spelling(words)
        before = np.concatenate([[0], spelling.end[at[:-1]]])
        before[np.cumsum(docs[:, 3]) - docs[:, 3]] = 0
        places, place = np.unique(before << 32 | spelling.head[at], return_inverse=True)
        trained = (docs[:, 2] == 0)[of].astype(np.float64)
        train = np.bincount(at, weights=trained, minlength=len(words)).astype(np.int64)
        n_words, word_at, word_n = _sparse(of, at)
        n_places, place_at, place_n = _sparse(of, place)
        end, head = places >> 32, places & 0xFFFFFFFF
        ids = docs[:, 0].view(np.uint64).view(np.int64)
        yield name, TABLE, 0, pack(ids, *docs[:, 1:].T, n_words, n_places, word_at, word_n - 1, place_at, place_n - 1, end, head, tail=b"\t".join(words))
        for part, own in _by_part(word_parts(words, parts)):
            yield name, WORDS, part, pack(train[own], tail=b"\t".join([words[k] for k in own.tolist()]))
        placed = np.bincount(place, weights=trained, minlength=len(places)).astype(np.int64)
        blocks = [(k, np.repeat(train[i], m)) for i, k, m in spelling.tails()] + [(k, np.repeat(placed[i], m)) for i, k, m in spelling.places(end, head)]
        keys, counts = summed(np.concatenate([k for k, _ in blocks]), np.concatenate([c for _, c in blocks]))
        for part, own in _by_part(gram_parts(keys, parts)):
            yield name, GRAMS, part, pack(np.diff(keys[own], prepend=0), counts[own])


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of each one's counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


SCHEMA = "chunk long, kind int, part int, data binary"
#: Of the tree: what a node asks for in a part, and the answers.
NODE, ANSWER = "node long, part int, data binary", "node long, part int, data binary, answer binary"


def _batch(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["chunk", "kind", "part", "data"])


def _chunks(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    chunk = Chunk()
    for batch in batches:
        for doc_id, held, text in zip(*(batch.column(c) for c in ("doc_id", "held_out", "text")), strict=True):
            chunk.add(doc_id.as_py(), held.as_py(), text.as_py())
            if chunk.size >= CHUNK:
                yield _batch(list(chunk.rows(parts)))
                chunk = Chunk()
    if chunk.docs:
        yield _batch(list(chunk.rows(parts)))


class Words:
    """Words and their counts, packed; answers are counts over all chunks."""

    @staticmethod
    def merged(rows: list[bytes]) -> bytes:
        total = Counter()
        for data in rows:
            (counts,), words = unpack(data)
            for w, c in zip(words.split(b"\t"), counts.tolist(), strict=True):
                total[w] += c
        return pack(np.fromiter(total.values(), np.int64, len(total)), tail=b"\t".join(total))

    @staticmethod
    def spread(data: bytes, answer: bytes, asked: list[bytes]) -> list[bytes]:
        """The answers to the words of data -> those to each one's of asked, which are among them."""
        known = dict(zip(unpack(data)[1].split(b"\t"), unpack(answer)[0][0].tolist(), strict=True))
        return [pack(np.fromiter(map(known.__getitem__, words), np.int64, len(words))) for words in (unpack(d)[1].split(b"\t") for d in asked)]


class Grams:
    """Distinct grams in order, as steps, and their counts, packed; answers are log10 probabilities."""

    @staticmethod
    def read(data: bytes) -> tuple[np.ndarray, np.ndarray]:
        (steps, counts), _ = unpack(data)
        return steps.cumsum(), counts

    @staticmethod
    def summed(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        asked = [Grams.read(d) for d in rows]
        return summed(np.concatenate([k for k, _ in asked]), np.concatenate([c for _, c in asked]))

    @staticmethod
    def merged(rows: list[bytes]) -> bytes:
        keys, counts = Grams.summed(rows)
        return pack(np.diff(keys, prepend=0), counts)

    @staticmethod
    def spread(data: bytes, answer: bytes, asked: list[bytes]) -> list[bytes]:
        keys, logs = Grams.read(data)[0], np.frombuffer(zstandard.decompress(answer), np.float32)
        return [zstandard.compress(logs[np.searchsorted(keys, Grams.read(d)[0])].tobytes(), 1) for d in asked]


def _bytes(table: pa.Table, column: str = "data") -> list[bytes]:
    return [d.as_py() for d in table[column]]


class Tree:
    """What chunks ask for (node, part, data), merged level by level."""

    def __init__(self, asked: DataFrame, kind: type, n: int):
        """n: number of chunks."""
        self.kind, self.levels = kind, [asked]

        def merge(table: pa.Table) -> pa.Table:
            return pa.table({"node": table["up"][:1], "part": table["part"][:1], "data": pa.array([kind.merged(_bytes(table))], pa.binary())})

        while n > FAN:
            n = -(-n // FAN)
            up = self.levels[-1].withColumn("up", F.pmod("node", F.lit(n)))
            self.levels[-1] = up
            self.levels.append(written(up.groupBy("up", "part").applyInArrow(merge, NODE)))

    @property
    def top(self) -> DataFrame:
        return self.levels[-1]

    def answered(self, top: DataFrame) -> DataFrame:
        """Answers to the top nodes (node, part, data, answer) -> node, part, answer for every chunk."""
        kind = self.kind

        def down(above: pa.Table, asked: pa.Table) -> pa.Table:
            found = kind.spread(_bytes(above)[0], _bytes(above, "answer")[0], _bytes(asked))
            return pa.table({"node": asked["node"], "part": asked["part"], "data": asked["data"], "answer": pa.array(found, pa.binary())})

        for level in reversed(self.levels[:-1]):
            top = top.groupBy("node", "part").cogroup(level.groupBy("up", "part")).applyInArrow(down, ANSWER)
        return top.select("node", "part", "answer")


def _answer_words(table: pa.Table) -> pa.Table:
    """Each top node's words with their counts; n and v: this part's share of all tokens and distinct words."""
    rows = _bytes(table)
    data = Words.merged(rows)
    counts = unpack(data)[0][0]
    first = np.arange(len(rows)) == 0
    found = Words.spread(data, pack(counts), rows)
    return pa.table({"node": table["node"], "part": table["part"], "data": table["data"], "answer": pa.array(found, pa.binary()), "n": first * counts.sum(), "v": first * (counts > 0).sum()})


def log_gamma(x: np.ndarray) -> np.ndarray:
    """For x >= 1/2: Stirling's series at x + 8, and the recurrence down."""
    y = x + 8
    series = (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    down = np.ones_like(y)
    for i in range(8):
        down = down * (x + i)
    return series - np.log(down)


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a sequence with a zeros and b ones."""
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1.0) - np.log(np.pi)


def log_mix(kt: np.ndarray, children: np.ndarray) -> np.ndarray:
    return np.logaddexp(kt, children) - np.log(2)


class Trees:
    """The trees below some contexts, from grams and counts: level d has the nodes with d context bytes."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, top: int):
        x = keys & 255
        bits = np.arange(8)[:, None]
        prefix = (1 << bits) | (x >> (8 - bits))
        self.bit = (x >> (7 - bits)) & 1
        node = ((keys >> 8) << 8) | prefix
        self.at, self.zeros, self.ones, self.log_p, self.log_kt, self.keys = {}, {}, {}, {}, {}, {}
        n = np.broadcast_to(counts, node.shape)
        level, inverse = np.unique(node, return_inverse=True)
        inverse = inverse.reshape(node.shape)
        for d in range(DEPTH, top - 1, -1):
            if d == DEPTH:
                zeros = np.bincount(inverse.ravel(), weights=(n * (1 - self.bit)).ravel(), minlength=len(level))
                ones = np.bincount(inverse.ravel(), weights=(n * self.bit).ravel(), minlength=len(level))
                self.at[d], kt = inverse, log_kt(zeros, ones)
                p = kt
            else:
                up = ((level >> 8) & ((1 << (8 * d)) - 1)) << 8 | (level & 255)
                level, inverse = np.unique(up, return_inverse=True)
                zeros, ones, children = (np.bincount(inverse, weights=w, minlength=len(level)) for w in (zeros, ones, p))
                self.at[d], kt = inverse, log_kt(zeros, ones)  # from each node of the level below
                p = log_mix(kt, children)
            self.keys[d], self.zeros[d], self.ones[d], self.log_p[d], self.log_kt[d] = level, zeros, ones, p, kt

    def weight(self, d: int) -> np.ndarray:
        return np.ones(len(self.keys[d])) if d == DEPTH else np.exp(self.log_kt[d] - np.log(2) - self.log_p[d])


def step(zeros, ones, weight, done, rest, estimate):
    """One level down: what is said so far, the weight left, and the estimate that holds if nothing deeper was seen."""
    seen = zeros + ones > 0
    estimate = np.where(seen, (ones + 0.5) / (zeros + ones + 1.0), estimate)
    return done + rest * weight * estimate, rest * (1 - weight), estimate


def tops(rows: list[tuple[int, int, float, float, float]]) -> np.ndarray:
    """(c1, prefix, zeros, ones, sum of the children's log P_w) -> (done, rest, estimate) for each c1 and prefix."""
    table = np.zeros((3, 256, 256))
    for c1, prefix, *values in rows:
        table[:, c1, prefix] = values
    zeros, ones, children = table
    kt = log_kt(zeros, ones)
    one = log_mix(kt, children)
    zeros0, ones0 = zeros.sum(0), ones.sum(0)
    kt0 = log_kt(zeros0, ones0)
    root = log_mix(kt0, one.sum(0))
    state = step(zeros0, ones0, np.exp(kt0 - np.log(2) - root), np.zeros(256), np.ones(256), np.full(256, 0.5))
    state = [np.broadcast_to(s, (256, 256)) for s in state]
    return np.stack(step(zeros, ones, np.exp(kt - np.log(2) - one), *state))


def log10_probabilities(keys: np.ndarray, counts: np.ndarray, top: np.ndarray) -> np.ndarray:
    """log10 probability of each gram's byte in its context. keys: all grams of whole context pairs."""
    trees = Trees(keys, counts, 2)
    level = trees.keys[2]
    c1, prefix = (level >> 8) & 255, level & 255
    state = step(trees.zeros[2], trees.ones[2], trees.weight(2), *(t[c1, prefix] for t in top))
    for d in range(3, DEPTH + 1):
        above = trees.at[d - 1]
        state = step(trees.zeros[d], trees.ones[d], trees.weight(d), *(s[above] for s in state))
    one = state[0][trees.at[DEPTH]]
    return np.log10(np.where(trees.bit == 1, one, 1 - one)).sum(0)


def below(keys: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
    """The nodes with two context bytes, for the levels above."""
    trees = Trees(keys, counts, 2)
    level = trees.keys[2]
    return {"c1": (level >> 8) & 255, "prefix": level & 255, "zeros": trees.zeros[2], "ones": trees.ones[2], "log_p": trees.log_p[2]}


def _below(table: pa.Table) -> pa.Table:
    return pa.table(below(*Grams.summed(_bytes(table))))


def _totals(table: pa.Table) -> pa.Table:
    """The table and the answers of one chunk -> one row a document."""
    got: dict[int, list[tuple[int, bytes]]] = {WORDS: [], GRAMS: [], TABLE: []}
    for kind, part, data in zip(*(table[c].to_pylist() for c in ("kind", "part", "data")), strict=True):
        got[kind].append((part, data))
    (ids, null, held, n_tokens, n_bytes, n_words, n_places, word_at, word_n, place_at, place_n, end, head), raw = unpack(got[TABLE][0][1])
    spelling = Spelling(raw.split(b"\t"))
    word_at, place_at, word_n, place_n = _unfold(word_at), _unfold(place_at), word_n + 1, place_n + 1
    parts = int(table["parts"][0].as_py())
    words = dict(_by_part(word_parts(spelling.words, parts)))
    total = np.zeros(len(spelling.words))
    for part, data in got[WORDS]:
        total[words[part]] = unpack(data)[0][0]
    pairs = [(i, k, m) for blocks in (spelling.tails(), spelling.places(end, head)) for i, k, m in blocks]
    keys = summed(np.concatenate([k for _, k, _ in pairs]), np.zeros(sum(len(k) for _, k, _ in pairs)))[0]
    values, grams_of = np.zeros(len(keys)), dict(_by_part(gram_parts(keys, parts)))
    for part, data in got[GRAMS]:
        values[grams_of[part]] = np.frombuffer(zstandard.decompress(data), np.float32)
    n_tails = len(list(range(0, len(spelling.long), BLOCK)))
    tail, front = np.zeros(len(total)), np.zeros(len(end))
    for i, (at, k, m) in enumerate(pairs):
        (tail if i < n_tails else front)[at] = np.add.reduceat(values[np.searchsorted(keys, k)], np.cumsum(m) - m)
    w, p = np.cumsum(n_words) - n_words, np.cumsum(n_places) - n_places
    logs, known, tails = (np.add.reduceat(word_n * v[word_at], w) for v in (np.log10(total + 1), (total > 0).astype(np.int64), tail))
    return pa.table({"doc_id": pa.array(ids, mask=null == 1), "held_out": held == 1, "n_tokens": n_tokens, "n_bytes": n_bytes, "n_known": known, "logs": logs, "score": tails + np.add.reduceat(place_n * front[place_at], p)})


def score(docs: DataFrame, folds: int = 7, fold: int = 2, parts: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10), bits_per_byte (code length over the bytes of words, closing spaces and end): one row per row of docs."""
    doc_id = docs["doc_id"].cast("long")
    rows = docs.select(doc_id.alias("doc_id"), held_out(docs["doc_id"], folds, fold).alias("held_out"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    parts = parts or min(4096, max(64, rows.rdd.getNumPartitions() // 2))
    asked = written(rows.mapInArrow(lambda batches: _chunks(batches, parts), SCHEMA))
    n_chunks = asked.where(F.col("kind") == TABLE).count()
    of = lambda kind: asked.where(F.col("kind") == kind).select(F.col("chunk").alias("node"), "part", "data")

    words = Tree(of(WORDS), Words, n_chunks)
    counted = words.top.groupBy("part").applyInArrow(_answer_words, ANSWER + ", n long, v long")
    counted = written(counted if len(words.levels) > 1 else counted.drop("data"))  # what was asked is for the levels below
    n, v = (x or 0 for x in counted.agg(F.sum("n"), F.sum("v")).first())

    grams_ = Tree(of(GRAMS), Grams, n_chunks)
    nodes = grams_.top.groupBy("part").applyInArrow(_below, "c1 long, prefix long, zeros double, ones double, log_p double")
    top = tops([tuple(r) for r in nodes.groupBy("c1", "prefix").agg(F.sum("zeros"), F.sum("ones"), F.sum("log_p")).collect()])  # at most 256 * 255 rows

    def answer(table: pa.Table) -> pa.Table:
        rows = _bytes(table)
        keys, counts = Grams.summed(rows)
        logs = zstandard.compress(log10_probabilities(keys, counts, top).astype(np.float32).tobytes(), 1)
        found = Grams.spread(pack(np.diff(keys, prepend=0), counts), logs, rows)
        return pa.table({"node": table["node"], "part": table["part"], "data": table["data"], "answer": pa.array(found, pa.binary())})

    of_words, of_grams = words.answered(counted.drop("n", "v")), grams_.answered(grams_.top.groupBy("part").applyInArrow(answer, ANSWER))
    told = lambda df, kind: df.select(F.col("node").alias("chunk"), F.lit(kind).alias("kind"), "part", F.col("answer").alias("data"))
    back = asked.where(F.col("kind") == TABLE).unionByName(told(of_words, WORDS)).unionByName(told(of_grams, GRAMS)).withColumn("parts", F.lit(parts))
    out = back.groupBy("chunk").applyInArrow(_totals, "doc_id long, held_out boolean, n_tokens long, n_bytes long, n_known long, logs double, score double")
    base = F.col("logs") - F.col("n_tokens") * float(np.log10(n + v + 1))
    bits = -F.col("score") * float(np.log2(10)) / F.col("n_bytes")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score", bits.alias("bits_per_byte"))


def op9_ctw(spark, sf_dir):
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
