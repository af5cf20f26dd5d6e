"""Near-duplicates against exact comparison; long lists; edge rows."""

import random

import pytest

from plumbline.llm import neardup
from tests.llm.brute import near_components

SF = "/root/testdata/sf0.01"


def found(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert found(neardup.op7_neardup(spark, SF)) == near_components(rows, 4, 80)


def test_kept_of_the_query(spark, tmp_path):
    """kept says whether the id is the component's, also where several alike texts share an id; the pipeline's stage still keeps one row a group."""
    words = [f"w{k}" for k in range(60)]
    text, other = " ".join(words), " ".join([*words[:59], "x"])
    rows = [(1, text), (1, other), (2, text), (3, None), (3, "alone here"), (None, "nobody"), (None, text)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in neardup.op7_neardup(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted([(1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True), (3, 3, True), (None, None, True), (None, 1, False)], key=repr)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert neardup.without_near_copies(docs, words=4).count() == 4


@pytest.mark.parametrize("seed", [1, 2])
def test_large_group_of_near_copies_and_a_common_passage(spark, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    base, passage = [word() for _ in range(120)], [word() for _ in range(60)]
    rows = []
    for i in range(80):  # a few words changed: likeness around the threshold
        text = list(base)
        for _ in range(rng.randrange(5)):
            text[rng.randrange(len(text))] = word()
        rows.append((i, " ".join(text)))
    rows += [(100 + i, " ".join([word() for _ in range(rng.randrange(10, 60))] + passage)) for i in range(60)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(neardup.near_duplicates(docs, words=4)) == near_components(rows, 4, 80)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One two"), (5, "one TWO"), (5, "one TWO"), (6, "one two three"), (7, "w " * 50_000), (8, "w w w w w w w")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, class string")
    got = neardup.near_duplicates(docs).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (5, 1, 4), (6, 1, 6), (7, 1, 7), (8, 1, 7)]
    assert neardup.near_duplicates(docs.limit(0)).count() == 0
    assert [r.doc_id for r in neardup.without_near_copies(docs).orderBy("doc_id").collect()] == [1, 2, 3, 4, 6, 7]


def test_large_group_and_passage(spark):
    """Copies too far from each other to be one group, links among them, and texts that share only a passage."""
    import random

    from tests.llm.brute import near_components

    rng = random.Random(5)
    base = [f"w{rng.randrange(900)}" for _ in range(140)]
    rows = [(0, " ".join(base))]
    for i in range(1, 300):
        w = list(base)
        for _ in range(rng.choice([2, 4, 5, 6, 7, 8, 10])):
            w[rng.randrange(len(w))] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(w)))
        if i % 9 == 0:
            for _ in range(rng.choice([2, 3, 4, 5, 6])):
                w[rng.randrange(len(w))] = f"y{rng.randrange(4000)}"
            rows.append((1000 + i, " ".join(w)))
    passage = [f"p{k}" for k in range(70)]
    for i in range(2000, 2100):
        own = [f"z{rng.randrange(10**6)}" for _ in range(rng.choice([20, 40, 60, 100]))]
        rows.append((i, " ".join(own[:10] + passage + own[10:])))
        if i % 5 == 0:
            rows.append((i + 5000, " ".join(own[:3] + ["q"] + own[4:10] + passage + own[10:])))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(frame, words=4).collect()}
    assert got == near_components(rows, 4, 80)


def test_rows_without_ids_and_ids_with_several_texts(spark):
    """Links don't depend on ids: a third of the rows without one, and different texts under one id."""
    rng = random.Random(9)
    base = [f"w{rng.randrange(900)}" for _ in range(140)]
    texts = [" ".join(base)]
    for _ in range(240):
        w = list(base)
        for _ in range(rng.choice([2, 4, 5, 6, 7, 8])):
            w[rng.randrange(len(w))] = f"x{rng.randrange(40)}"
        texts.append(" ".join(w))
    for i in range(60):
        own = [f"z{i}x{k}" for k in range(40)]
        texts += [" ".join(own), " ".join([*own[:39], "end"])]
    rng.shuffle(texts)
    want = near_components(list(enumerate(texts)), 4, 80)
    groups = {}
    for k in range(len(texts)):
        groups.setdefault(want[k][1], []).append(k)
    ids = [None if k % 3 == 0 else k // 4 for k in range(len(texts))]
    name = {k: min((ids[m] for m in ms if ids[m] is not None), default=None) for ms in groups.values() for k in ms}
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    got = sorted(map(repr, map(tuple, neardup.near_duplicates(docs, words=4).collect())))
    assert got == sorted(repr((ids[k], want[k][0], name[k])) for k in range(len(texts)))
    # one row of each group stays: texts are distinct here
    stay = {r.text for r in neardup.without_near_copies(docs, words=4).collect()}
    assert sorted(len(stay & {texts[m] for m in ms}) for ms in groups.values()) == [1] * len(groups)
    assert all(ids[k] == name[k] for k in range(len(texts)) if texts[k] in stay)


def test_components_of_a_sorted_chain(spark, monkeypatch):
    """A path of 1,000 nodes, a star and a tangle need few rounds."""
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(1000)] + [(5000, 2000 + i) for i in range(200)] + [(rng.randrange(9000, 9100), rng.randrange(9000, 9100)) for _ in range(300)]
    tables, write = [], neardup.written
    monkeypatch.setattr(neardup, "written", lambda df: tables.append(1) or write(df))
    got = {r.node: r.label for r in neardup.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = sorted((find(u), find(v)))
        parent[b] = a
    linked = {x for u, v in edges if u != v for x in (u, v)}
    assert got == {x: find(x) for x in linked}
    assert len(tables) < 40


def test_lists_of_lists(spark, monkeypatch):
    """Lists of differences that are long get pivots of their own; the result stays that of all pairs."""
    monkeypatch.setattr(neardup, "FEW", 8)
    monkeypatch.setattr(neardup, "DEEP", 12)
    monkeypatch.setattr(neardup, "COPY", 16)
    rng = random.Random(11)
    base = [f"w{rng.randrange(900)}" for _ in range(120)]
    rows = []
    for family in range(6):
        own = list(base)
        for _ in range(family * 3):
            own[rng.randrange(len(own))] = f"f{family}x{rng.randrange(50)}"
        for _ in range(70):
            w = list(own)
            for _ in range(rng.randrange(8)):
                k = rng.randrange(len(w))
                w[k] = f"x{k % 7}"
            if rng.random() < 0.3:
                del w[: rng.randrange(20)]
            rows.append((len(rows), " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(neardup.near_duplicates(docs, words=4)) == near_components(rows, 4, 80)


@pytest.mark.parametrize("percent", [60, 80, 90])
def test_shared_differences_are_a_lower_bound(percent):
    """For random sets around a pivot: members that are linked, one of them not like the pivot, share at least least_shared differences."""
    rng = random.Random(percent)
    pivot = set(range(60))
    sets = [set(rng.sample(range(60), rng.randrange(30, 61))) | {rng.randrange(60, 90) for _ in range(rng.randrange(25))} for _ in range(250)]
    like = lambda a, b: 100 * len(a & b) >= percent * len(a | b)
    least = [neardup.least_shared(len(s ^ pivot), len(s), len(pivot), percent) for s in sets]
    linked = [(i, j) for i in range(len(sets)) for j in range(len(sets)) if sets[i] != sets[j] and like(sets[i], sets[j]) and not (like(sets[i], pivot) and like(sets[j], pivot))]
    assert linked or percent > 60
    assert all(len((sets[i] ^ pivot) & (sets[j] ^ pivot)) >= max(least[i], least[j]) for i, j in linked)
