"""The encoder against the tokenizers library, token by token."""

import random

import pytest
from tokenizers import Tokenizer

from plumbline.llm.bpe import Encoder, bpe, public_vocabulary


@pytest.fixture(scope="module")
def both():
    path = public_vocabulary()
    with open(path, encoding="utf-8") as f:
        return Encoder(f.read()), Tokenizer.from_file(path)


CASES = [
    "", " ", "Hello  World's don't!!  x", "<|endoftext|> hi<|startoftext|>there<|endoftext|>", "École é 12 3", "á İstanbul ǅ ﬁ ß ẞ",
    "\x00\x85  z \x1c\x1d a", "日本語 ok", "'S 'T 'LL", "ΑΣ ΣΑΣ.", "école", "a" * 3000, "aé" * 500, "🙂🙃 <|endof", "x\t\n\r\x0b\x0cy", "that's it'll'd",
]


def same(both, text):
    own, lib = both
    ids = own.encode(text)
    found = lib.encode(text, add_special_tokens=False).ids
    assert ids == found, text
    assert own.decode(ids) == lib.decode(found, skip_special_tokens=False)


@pytest.mark.parametrize("text", CASES)
def test_cases(both, text):
    same(both, text)


def test_random(both):
    rng = random.Random(7)
    letters = "abcdeéèçñüß ETH'.,!?0123 \n\t|*#日σΣ́"
    for _ in range(300):
        same(both, "".join(rng.choices(letters, k=rng.randrange(80))))


@pytest.mark.parametrize("around", ["a{}b", "e{}\u0301", "a{}\u0323\u0301"])
def test_every_code_point(both, around):
    own, lib = both
    points = [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    bad = []
    for start in range(0, len(points), 50_000):
        part = points[start : start + 50_000]
        texts = [around.format(chr(c)) for c in part]
        found = lib.encode_batch(texts, add_special_tokens=False)
        bad += [hex(c) for c, text, f in zip(part, texts, found, strict=True) if own.encode(text) != f.ids]
    assert not bad


def test_compositions_of_later_versions(both):
    for text in ["\U00011935\U00011930", "\U00011938", "e\u07fd\u0301\u0323", "\u1c89\ua7cb\U00010d50\u0c5cx", "x\u0558y 1\U0001246f2"]:
        same(both, text)


def test_cut_fragments_merge_like_whole_words(both):
    own, _ = both
    word = "".join(own.letters[b] for b in "schließungçñzqxjkééß".encode())
    assert len(own.cut(word)) > 1
    assert [i for f in own.cut(word) for i in own.merge(f)] == list(own.merge(word + "</w>"))


def test_frame(spark, both):
    rows = [(1, None, "a"), (2, "", "b"), (3, "Hello there", "c"), (3, "Hello there", "c"), (None, "x" * 200_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(((r.doc_id or 0), r.n_tokens, tuple(r.ids), r.decoded) for r in bpe(docs).collect())
    assert [g[:2] for g in got][1:] == [(1, 0), (2, 0), (3, 2), (3, 2)]
    assert got[3][3] == "hello</w> there</w>"
    assert bpe(docs.limit(0)).count() == 0
    lib = both[1]
    assert list(got[0][2]) == lib.encode("x" * 200_000, add_special_tokens=False).ids


def test_query_equals_the_library(spark):
    """op4_bpe on every whole text of the table."""
    import hashlib

    import public_tokenizers

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tok.no_truncation()
    tok.no_padding()
    from plumbline.llm.bpe import op4_bpe

    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op4_bpe(spark, sf).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = tok.encode(r.text or "", add_special_tokens=False).ids
        assert got[r.doc_id] == (len(ids), sha(" ".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False)))


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "some words", "t", 1)], "doc_id long, text string, _text string, kept int")
    got = bpe(docs, keep=docs.columns)
    assert got.columns == [*docs.columns, "n_tokens", "ids", "decoded"] and got.first().kept == 1


def test_small_caches_change_nothing(both, monkeypatch):
    from plumbline.llm import bpe as module

    monkeypatch.setattr(module, "CHUNKS", 3)
    monkeypatch.setattr(module, "FRAGMENTS", 2)
    with open(public_vocabulary(), encoding="utf-8") as f:
        small = Encoder(f.read())
    text = " ".join(random.Random(3).choices(["one", "two,", "three", "fourfold", "x-y", "again.", "Zürich"], k=300))
    assert small.encode(text) == both[0].encode(text)
