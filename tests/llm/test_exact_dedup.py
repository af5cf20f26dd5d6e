"""Exact deduplication against a dictionary: ties, nulls, huge texts, forced collisions, and its SQL."""

import hashlib
import random
from collections import defaultdict

import pytest

from plumbline.llm import exact_dedup as ex
from tests.oracle import compare

SF = "/root/testdata/sf0.01"
TINY = (7, 5)


def plain(rows):
    """(doc_id, keep_id, group_size, text_sha256) of each row, and how many rows of each text stay."""
    groups = defaultdict(list)
    for i, text in rows:
        groups[text or ""].append(i)
    top = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return sorted(repr((i, top[t or ""], len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest())) for i, t in rows)


def check(rows, got):
    assert sorted(repr((r.doc_id, r.keep_id, r.group_size, r.text_sha256)) for r in got) == plain(rows)
    kept = defaultdict(int)
    for r in got:
        kept[r.text_sha256] += r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(kept.values()) == {1}


def test_composed_fingerprints():
    rng = random.Random(1)
    for n in (0, 1, 100, ex.CHUNK, ex.CHUNK + 1, 3 * ex.CHUNK + 17):
        data = rng.randbytes(n)
        h = [0, 0]
        for b in data[:300]:
            h = [(x * base + b + 1) % p for x, base, p in zip(h, ex.BASE, ex.PRIME, strict=True)]
        assert ex.fingerprint(data[:300]) == (*h, len(data[:300]))
        cut = rng.randrange(n + 1)
        assert ex.combine([ex.fingerprint(data[:cut]), ex.fingerprint(data[cut:])]) == ex.fingerprint(data)


def test_sql(spark):
    compare(spark, SF, ex.op5_exact_dedup, ex.OP5_SQL)


@pytest.mark.parametrize("primes", [ex.PRIME, TINY])
def test_ties_nulls_and_collisions(spark, primes):
    """With tiny primes nearly all texts of a length share a fingerprint, and the comparison has to tell them apart."""
    rng = random.Random(4)
    texts = [None, "", "a", "b", "é", "long " * 20_000, "lonh " + "long " * 19_999] + ["".join(rng.choices("ab", k=4)) for _ in range(60)]
    rows = [(rng.choice([None, *range(40)]), rng.choice(texts)) for _ in range(300)] + [(7, "tie"), (7, "tie"), (3, "tie"), (None, "alone"), (None, "pair"), (None, "pair")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, text_sha256 string, h1 int")
    check(rows, ex.exact_dedup(docs, primes).collect())
    left = ex.without_copies(docs)
    assert left.columns == docs.columns and sorted(r.text or "" for r in left.collect()) == sorted({t or "" for _, t in rows})


def test_huge_texts_go_by_chunk(spark):
    big = "".join(random.Random(2).choices("abcdefgh \n", k=ex.HUGE + 12_345))
    rows = [(1, big), (2, big), (3, big[:-1] + "!"), (4, "x" + big[1:]), (5, "small")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check(rows, ex.exact_dedup(docs).collect())
    small = [(1, "abc" * 50_000), (2, "abc" * 50_000), (3, "abd" + "abc" * 49_999), (4, None)]
    check(small, ex.exact_dedup(spark.createDataFrame(small, "doc_id long, text string"), huge_bytes=1000).collect())


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert ex.exact_dedup(docs).count() == 0 and ex.without_copies(docs).count() == 0
