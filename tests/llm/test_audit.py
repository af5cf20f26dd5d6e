"""The audit against filters applied one after the other, on small rows; its SQL; edge rows."""

import random
from itertools import permutations

from plumbline.llm import audit
from tests.oracle import compare

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, source string, mask int, n int, part string"


def plain(rows, labels):
    """{(part, order, step): the seven counts} by applying every order to every row."""
    good = {i for i, q, _ in labels if q == 1} - {None}
    toxic = {i for i, _, t in labels if t == 1} - {None}
    docs = []
    for i, text, source in rows:
        t = text or ""
        words = t.encode().split()
        failing = set()
        if len(words) < 200:
            failing.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            failing.add("B")
        if 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t):
            failing.add("C")
        if any(c in "#$%&*|" for c in t):
            failing.add("D")
        if i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows):
            failing.add("E")
        docs.append((source or "", failing, i in good, i in toxic))
    out = {}
    orders = ["".join(p) for p in permutations("ABCDE")]
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in orders:
            left = own
            for k, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                shapley[f] += len(gone)
                failing = sum(f in d[1] for d in own)
                out[part, order, k] = [len(left), len(gone), failing - len(gone), sum(d[1] == {f} for d in own), sum(d[2] for d in gone), sum(d[3] for d in gone)]
        for order in orders:
            for k, f in enumerate(order, 1):
                out[part, order, k].append(shapley[f])
    return out


def test_against_plain(spark):
    rng = random.Random(5)
    texts = [None, "", "One two\x0bthree", "a b c # d", "UPPER lower " * 120, "same " * 300, " ".join(f"w{k}" for k in range(250)), " ".join(f"w{k}" for k in range(250)) + " $", "é ü " * 101, "x|y"]
    rows = [(rng.choice([None, *range(60)]), rng.choice(texts), rng.choice(["a", "b", None, ""])) for _ in range(150)]
    rows += rows[:20]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(40)] + [(3, 1, 1), (None, 1, 1)]
    docs = spark.createDataFrame([(*r, 1, 2, "p") for r in rows], SCHEMA)
    frame = spark.createDataFrame([(*r, 7) for r in labels], "doc_id long, quality int, toxic int, good int")
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in audit.audit(docs, frame).collect()}
    want = plain(rows, labels)
    assert len(got) == 3 * 600
    assert got == want


def test_no_rows(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert audit.audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_inverse(spark):
    rng = random.Random(9)
    rows = [("p", True, False, m, rng.randrange(2**45)) for m in range(32) for _ in range(2)]
    frame = spark.createDataFrame(rows, "part string, good boolean, toxic boolean, mask int, n long")
    got = audit.parity_sums(frame).select(audit.inverted(audit.F.col("w")).alias("c")).first().c
    assert got == [sum(r[4] for r in rows if r[3] == m) for m in range(32)]


def test_sql(spark):
    compare(spark, SF, audit.op13_audit, audit.OP13_SQL)
