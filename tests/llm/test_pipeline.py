"""The pipeline, stage by stage, against plain Python on its own inputs."""

import hashlib
from collections import Counter, defaultdict

import corpus_pipeline
from plumbline.llm import mixing, quality
from plumbline.llm.bpe import Encoder, public_vocabulary
from plumbline.llm.common import written
from tests.llm.brute import near_components

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    outs = []
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF))
        outs.append(docs)
    good, exact, near, mixed, tokens = outs
    assert all(d.columns == COLUMNS for d in outs[:4])

    start = spark.read.parquet(f"{SF}/documents.parquet")
    forest = quality.fit_on(start, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = {r.doc_id: r for r in start.collect()}
    want = {i for i, r in rows.items() if forest.score(__import__("numpy").array([quality.statistics(r.text or "")]))[0] >= quality.THRESHOLD}
    assert {r.doc_id for r in good.collect()} == want

    last = {}
    for r in good.collect():
        last[r.text] = max(last.get(r.text, -1), r.doc_id)
    assert sorted(r.doc_id for r in exact.collect()) == sorted(last.values())

    pairs = [(r.doc_id, r.text) for r in exact.collect()]
    found = near_components(pairs, 5, 80)
    assert sorted(r.doc_id for r in near.collect()) == sorted(i for i, (_, c) in found.items() if i == c)

    times = {r.doc_id: r.times for r in mixing.mix(near).collect()}
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({i: t for i, t in times.items() if t})
    taken, size = defaultdict(int), defaultdict(int)
    for r in mixing.mix(near).collect():
        taken[r.source] += r.taken
        size[r.source] = r.target
    assert all(abs(taken[s] - size[s]) <= max(len(r.text.split()) for r in near.collect()) for s in size)

    with open(public_vocabulary(), encoding="utf-8") as f:
        enc = Encoder(f.read())
    ids = {r.doc_id: (r.n_tokens, list(r.ids), r.decoded_sha256) for r in tokens.collect()}
    assert tokens.count() == mixed.count()
    for r in mixed.collect():
        own = enc.encode(r.text)
        assert ids[r.doc_id] == (len(own), own, hashlib.sha256(enc.decode(own).encode()).hexdigest())


def test_run_is_the_stages(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "source", "n_tokens", "ids", "decoded_sha256"] and out.count() > 0
