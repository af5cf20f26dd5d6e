"""Winnowing against a plain loop; edits and neighbours; edge rows."""

import hashlib
import random

from pyspark.sql import functions as F

from plumbline.llm import fingerprint as fp

SF = "/root/testdata/sf0.001"


def picked(hashes):
    """Positions that winnowing selects from a list of hashes, by the definition."""
    out = set()
    for i in range(max(1, len(hashes) - fp.WINDOW + 1) if hashes else 0):
        window = list(enumerate(hashes[i : i + fp.WINDOW], i))
        low = min(h for _, h in window)
        out.add(max(p for p, h in window if h == low))
    return out


def test_selection_matches_the_definition(spark):
    """Hashes rolled one character at a time, and windows by the definition."""
    rng = random.Random(5)
    texts = ["", "a", "abcdefg", "abcdefgh", "aaaaaaaaaaaaaaaaaaaaaaaaaaa", "é🙂" * 700] + ["".join(rng.choices("ab \n", k=n)) for n in (14, 15, 16, 510, 526, 527, 1024, 1500, 4000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    letters = spark.createDataFrame([(x,) for x in sorted(set("".join(texts)))], "c string")
    hashed = {r.c: r.h & (1 << 64) - 1 for r in letters.selectExpr("c", "xxhash64(c) AS h").collect()}

    def rolled(t):
        h, out = 0, []
        for i, c in enumerate(t):
            h = h << 1 ^ hashed[c]
            if i >= fp.GRAM:
                h ^= hashed[t[i - fp.GRAM]] << fp.GRAM
            h &= (1 << 64) - 1
            if i >= fp.GRAM - 1:
                out.append(h)
        return out or [h] * bool(t)

    signed = lambda h: (h - (1 << 64) if h >> 63 else h) & ~fp._MASK
    for r in fp.fingerprint(docs).collect():
        h = [signed(x) for x in rolled(texts[r.doc_id])]
        assert [(x.position, x.hash) for x in r.hashes] == sorted((p, h[p]) for p in picked(h)), r.doc_id


def test_buckets(spark):
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 9, 50):
        cuts = sorted(rng.sample(range(-100, 100), n))
        keys = list(range(-105, 105))
        got = spark.createDataFrame([(k,) for k in keys], "k long").select("k", fp._bucket(F.col("k"), cuts).alias("b")).collect()
        assert all(r.b == sum(c <= r.k for c in cuts) for r in got)


def edit(text, following):
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def check(spark, rows, got, near=True):
    order = sorted(rows, key=lambda r: -r[0])
    by = {r.doc_id: r for r in got}
    edits = {i: edit(t, order[(k + 1) % len(order)][1]) for k, (i, t) in enumerate(order)}
    again = {r.doc_id: r for r in fp.edited(spark.createDataFrame([(i, e) for i, e in edits.items()], "doc_id long, text string")).collect()}
    sets = {r.doc_id: {x.hash for x in r.hashes} for r in fp.fingerprint(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    edited = {r.doc_id: {x.hash for x in r.hashes} for r in fp.fingerprint(spark.createDataFrame(list(edits.items()), "doc_id long, text string")).collect()}
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for k, (i, t) in enumerate(order):
        r = by[i]
        assert r.n_chars == len(t)
        assert r.edited_sha256 == hashlib.sha256(edits[i].encode()).hexdigest()
        assert r.edited_fingerprint == again[i].fingerprint
        assert abs(r.near_edited - like(sets[i], edited[i])) < 1e-12
        assert abs(r.near_next - like(sets[i], sets[order[(k + 1) % len(order)][0]])) < 1e-12


def test_whole_table(spark):
    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check(spark, rows, fp.op1_fingerprints(spark, SF).collect())


def test_edges(spark):
    rows = [(5, ""), (9, "x"), (-3, "long text " * 3000), (10**12, "abc"), (6, ""), (7, "abcdefghijklmnopqrstuvwxyz" * 40)]
    docs = spark.createDataFrame([(i, t, "z", 1, "q", 2) for i, t in rows], "doc_id long, text string, fingerprint string, at int, sel string, host int")
    check(spark, rows, fp.edited(docs).collect())
    assert fp.edited(docs.limit(0)).count() == 0
    one = fp.edited(docs.where("doc_id = 7")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    odd = spark.createDataFrame([(1, None), (1, None), (None, "some text here"), (None, None)], "doc_id long, text string")
    assert fp.edited(odd).count() == 4
