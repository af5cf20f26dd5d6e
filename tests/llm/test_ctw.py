"""The language model against a plain context-tree weighting, and its counts against plain counting."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from plumbline.llm import ctw

SF = "/root/testdata/sf0.001"


def units(found):
    """Each token behind a space and the last bytes of the token before it."""
    return [x[-ctw.REACH :] + b" " + w for x, w in zip([b"", *found], found, strict=False)]


def plain(train, test):
    """Log10 probabilities of units by recursion over a dictionary of nodes."""
    nodes = {}

    def spelled(unit):
        data = unit if unit.endswith(ctw.END) else unit + b" "
        for i in range(unit.index(b" ") + 1, len(data)):
            past = (b"\0" * ctw.DEPTH + data[:i])[-ctw.DEPTH :]
            for k in range(8):
                yield past, (1 << k) | (data[i] >> (8 - k)), (data[i] >> (7 - k)) & 1

    for word, c in train.items():
        for past, prefix, bit in spelled(word):
            for d in range(ctw.DEPTH + 1):
                nodes.setdefault((past[ctw.DEPTH - d :], prefix), [0, 0])[bit] += c
    children = {}
    for past, prefix in nodes:
        if past:
            children.setdefault((past[1:], prefix), []).append((past, prefix))
    known = {}

    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def log_p(node):
        if node not in known:
            own = kt(*nodes[node])
            known[node] = own if len(node[0]) == ctw.DEPTH else np.logaddexp(own, sum(map(log_p, children[node]))) - math.log(2)
        return known[node]

    def probability(past, prefix, bit):
        done, rest, estimate = 0.0, 1.0, 0.5
        for d in range(ctw.DEPTH + 1):
            node = (past[ctw.DEPTH - d :], prefix)
            if node not in nodes:
                break
            a, b = nodes[node]
            estimate = (b + 0.5) / (a + b + 1)
            w = 1.0 if d == ctw.DEPTH else math.exp(kt(a, b) - math.log(2) - log_p(node))
            done, rest = done + rest * w * estimate, rest * (1 - w)
        one = done + rest * estimate
        return one if bit else 1 - one

    return {w: sum(math.log10(probability(*s)) for s in spelled(w)) for w in test}


def test_log_gamma():
    x = np.array([0.5, 1, 1.5, 7, 1234.5])
    assert np.allclose(ctw.log_gamma(x), [math.lgamma(v) for v in x])


@pytest.mark.parametrize("sf", [SF])
def test_against_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in docs}
    c = Counter(w for i, t in docs if not held[i] for w in ctw.tokens(t))
    n, v = sum(c.values()), len(c)
    trained = Counter(u for i, t in docs if not held[i] for u in units(ctw.tokens(t)))
    logs = plain(trained, {u for _, t in docs for u in units(ctw.tokens(t))})
    got = {r.doc_id: r for r in ctw.op9_ctw(spark, sf).collect()}
    assert len(got) == len(docs)
    for i, text in docs:
        found, r = ctw.tokens(text), got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(found), sum(c[w] > 0 for w in found), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in found), rel_tol=1e-9)
        assert math.isclose(r.score, sum(logs[u] for u in units(found)), rel_tol=1e-7)
        assert math.isclose(r.bits_per_byte, -r.score * math.log2(10) / len(b" ".join(found)))


def test_bytes_of_a_context_sum_to_one():
    keys = np.array([(ord(" ") << 8) | x for x in range(256)])
    counts = np.zeros(256, dtype=np.int64)
    counts[[97, 98, 200]] = [50, 3, 1]
    top = ctw.tops(list(zip(*(x.tolist() for x in ctw.below(keys, counts).values()), strict=True)))
    p = 10 ** ctw.log10_probabilities(keys, counts, top)
    assert math.isclose(p.sum(), 1) and p[97] > 0.8


def test_beats_the_base_on_held_out_texts(spark):
    rows = ctw.op9_ctw(spark, "/root/testdata/sf0.1").where("held_out").selectExpr("sum(score)", "sum(base_score)", "sum(n_tokens)").first()
    assert rows[0] / rows[2] > rows[1] / rows[2] + 0.1


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (3, "A a", None), (3, "A a", None), (None, "word " * 30_000, 1.0)], "doc_id long, text string, score double")
    got = sorted((r.doc_id or 0, r.n_tokens, r.held_out, r.score < 0) for r in ctw.score(docs).collect())
    assert [g[:2] for g in got] == [(0, 30_001), (1, 1), (2, 1), (3, 3), (3, 3)]
    assert all(g[3] for g in got)
    assert ctw.score(docs.limit(0)).count() == 0


def test_a_tree_of_many_chunks(spark, monkeypatch):
    """Small chunks, merged two by two over several levels, give the same as one."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {r.doc_id: tuple(r) for r in ctw.score(docs).collect()}
    monkeypatch.setattr(ctw, "FAN", 2)
    chunks = ctw._chunks

    def small(batches, parts):  # a chunk for each batch of a few rows
        for batch in batches:
            for i in range(0, batch.num_rows, 9):
                yield from chunks([batch.slice(i, 9)], parts)

    monkeypatch.setattr(ctw, "_chunks", small)
    got = {r.doc_id: tuple(r) for r in ctw.score(docs).collect()}
    assert got.keys() == want.keys()
    assert all(g[:5] == w[:5] and all(math.isclose(x, y, rel_tol=1e-6) for x, y in zip(g[5:], w[5:], strict=True)) for g, w in ((got[i], want[i]) for i in want))
