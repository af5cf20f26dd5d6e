"""Water-filling against repeated redistribution; takings near their targets; edge rows."""

import random
from collections import Counter

import pytest

from plumbline.llm import mixing
from tests.oracle import compare

SF = "/root/testdata/sf0.01"


def redistributed(sizes, weights, share, cap):
    """Targets by sharing out what capped sources leave, over and over."""
    wanted, target, open_ = share * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        level = wanted / sum(weights[i] for i in open_)
        full = [i for i in open_ if level * weights[i] > cap * sizes[i] + 1e-9]
        if not full:
            for i in open_:
                target[i] = level * weights[i]
            break
        for i in full:
            target[i] = cap * sizes[i]
            wanted -= target[i]
            open_.discard(i)
    return target


@pytest.mark.parametrize("seed", range(6))
def test_water_fill(spark, seed):
    rng = random.Random(seed)
    sizes = [rng.choice([0, 1, 7, 50, 1000, 5000]) for _ in range(rng.randrange(1, 9))]
    weights = [(3.0, 1.0, 2.0)[i % 3] for i in range(len(sizes))]
    frame = spark.createDataFrame([(f"s{i}", n, w) for i, (n, w) in enumerate(zip(sizes, weights, strict=True))], "source string, source_size long, weight double")
    got = {r.source: r.target for r in mixing.water_fill(frame, 1.5, 2.0).collect()}
    want = redistributed(sizes, weights, 1.5, 2.0)
    assert [got[f"s{i}"] for i in range(len(sizes))] == pytest.approx(want)


def test_whole_table(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    size = {r.doc_id: len((r.text or "").encode().split()) for r in rows}
    sources = sorted({r.source for r in rows})
    sizes = [sum(size[r.doc_id] for r in rows if r.source == s) for s in sources]
    want = dict(zip(sources, redistributed(sizes, [(3.0, 1.0, 2.0)[i % 3] for i in range(len(sources))], 1.5, 2.0), strict=True))
    got = {r.doc_id: r for r in mixing.op2_mixing(spark, SF).collect()}
    taken = dict.fromkeys(sources, 0)
    for r in rows:
        g = got[r.doc_id]
        assert g.size == size[r.doc_id] and g.target == pytest.approx(want[r.source], abs=1e-5)
        assert g.size * 0 <= g.taken <= 2 * g.size
        taken[r.source] += g.taken
    longest = max(size.values())
    assert all(0 <= want[s] - taken[s] < longest for s in sources)
    assert got == {r.doc_id: r for r in mixing.op2_mixing(spark, SF).collect()}


def test_edges(spark):
    rows = [(1, None, "a", 1), (2, "", None, 1), (3, "x y", None, 2), (3, "x y", None, 2), (None, "word " * 9000, "b", None), (5, "only", "c", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size long")
    got = mixing.mix(docs).collect()
    assert sorted((r.doc_id or 0, r.size) for r in got) == [(0, 9000), (1, 0), (2, 0), (3, 2), (3, 2), (5, 1)]
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    assert mixing.mixed(docs).columns == docs.columns
    assert mixing.mix(docs.limit(0)).count() == 0


def test_sql(spark):
    compare(spark, SF, mixing.op2_mixing, mixing.OP2_SQL)


def test_repeated_ids_and_deep_cuts(spark, monkeypatch):
    """Rows of one id in several sources, rows without id, helper columns of the same names, and cuts that need more digits."""
    monkeypatch.setattr(mixing, "WALK", 3)
    monkeypatch.setattr(mixing, "DIGITS", 1)
    rng = random.Random(8)
    names = ["a", "b", None]
    rows = [(rng.choice([None, *range(30)]), "w " * rng.randrange(1, 30) + f"t{k}", rng.choice(names), k) for k in range(400)]
    docs = spark.createDataFrame([(*r, 1, "p", 2) for r in rows], "doc_id long, text string, source string, k int, times int, place string, whole int")
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    got = Counter(r.k for r in out.collect())
    size = {k: len(t.split()) for _, t, _, k in rows}
    of = {k: s for _, _, s, k in rows}
    sizes = [sum(n for k, n in size.items() if of[k] == s) for s in names]
    want = redistributed(sizes, [3.0, 1.0, 2.0], 1.5, 2.0)
    for s, total, target in zip(names, sizes, want, strict=True):
        times = {k: got[k] for k in size if of[k] == s}
        assert set(times.values()) <= {int(target // total), int(target // total) + 1}
        assert 0 <= target - sum(n * size[k] for k, n in times.items()) < max(size.values())
    assert sorted(repr((r.doc_id, r.size, r.times)) for r in mixing.mix(docs).collect()) == sorted(repr((i, size[k], got[k])) for i, _, _, k in rows)
    assert sum(r.taken for r in mixing.mix(docs).collect()) == sum(n * size[k] for k, n in got.items())


@pytest.mark.parametrize("walk", [3, 20_000])
def test_equal_rows(spark, monkeypatch, walk):
    """1,000 equal rows of a source, with an id and without one, beside a source without a name: taken words come within one text of the target, whatever the depth of the cut."""
    monkeypatch.setattr(mixing, "WALK", walk)
    for same in (7, None):
        rows = [(same, "five words in this text", "s")] * 1000 + [(k, "w " * (k % 9 + 1), "t") for k in range(300)] + [(8, "one two", None)] * 400
        docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, source string, no int").repartition(5)
        got = mixing.mix(docs).collect()
        assert len(got) == len(rows)
        for source, longest in (("s", 5), ("t", 9), (None, 2)):
            own = [r for r in got if r.source == source]
            assert 0 <= own[0].target - sum(r.taken for r in own) < longest
            assert all(r.taken <= 2 * r.size for r in own)
        counts = Counter((r.source, r.taken) for r in got if r.source == "s")
        assert len(counts) == 2 and all(n > 0 for n in counts.values())
        again = Counter((r.doc_id, r.source, r.taken) for r in mixing.mix(docs).collect())
        assert again == Counter((r.doc_id, r.source, r.taken) for r in got)
        texts = Counter(r.source for r in mixing.mixed(docs).collect())
        assert {s: sum(r.times for r in got if r.source == s) for s in ("s", "t", None)} == dict(texts)
