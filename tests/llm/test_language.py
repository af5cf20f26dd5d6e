"""Language identification: folded tables against a plain convolution, held-out accuracy, edge rows."""

import numpy as np

from plumbline.llm import language

SF = "/root/testdata/sf0.01"


def test_folded_tables_equal_a_plain_convolution():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 256, (70, language.WINDOW)).astype(np.uint8)
    net = language.train(x, np.arange(70) % 3, ["a", "b", "c"])
    got = language.Folded(net).log_probabilities(x)
    for row, logs in zip(x[:5], got, strict=False):
        e = net.embed[row]
        pooled = [max((e[i : i + w] * f[:, :, k]).sum() for i in range(len(row) - w + 1)) for w, f in zip(language.WIDTHS, net.filters, strict=True) for k in range(language.FILTERS)]
        z = np.maximum(np.array(pooled) + net.bias, 0) @ net.weights + net.offset
        assert np.allclose(np.exp(logs), np.exp(z - z.max()) / np.exp(z - z.max()).sum(), atol=1e-4)


def test_windows_cover_the_whole_text():
    for n in (0, 1, 255, 256, 257, 1000):
        w, lengths = language.windows(b"q" * n)
        assert lengths.sum() == n and (w == ord("q")).sum() == n


def test_held_out_accuracy_and_repeat(spark):
    rows = language.op10_language(spark, SF).collect()
    again = {r.doc_id: r.lang_pred for r in language.op10_language(spark, SF).collect()}
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    assert len(rows) == len(truth) and all(again[r.doc_id] == r.lang_pred for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.95


def test_edges(spark):
    docs = spark.createDataFrame(
        [(1, None, "en", 1.0), (2, "", None, 1.0), (3, "12 ++ 3", "en", None), (4, "the end", "en", 2.0), (4, "the end", "en", 2.0), (None, "der " * 60_000, "de", 0.0), (7, "und", None, 0.0)],
        "doc_id long, text string, lang string, score double",
    )
    net = language.fit_on(docs)
    assert set(net.languages) <= {"en", "de"} and net.languages
    got = language.identify(docs, net).collect()
    assert len(got) == 7
    assert [r.lang_pred for r in got if r.doc_id in (1, 2, 3)] == ["und"] * 3
    assert all(0 <= r.score <= 1 for r in got)
    none = language.fit_on(docs.limit(0))
    assert {r.lang_pred for r in language.identify(docs, none).collect()} == {"und"}
    assert language.identify(docs.limit(0), net).count() == 0


def test_number_signs_are_no_letters():
    import unicodedata

    assert not any(language.has_letter(x) for x in ["", "\u00bd \u00b2\u00b3", "\u2460 \u2461", "\u2167", "12_3", "\u0301", "\U0001f642"])
    assert all(language.has_letter(x) for x in ["\u00bd a", "\u00aa", "\u05d0", "\u4e00", "12\u02b0"])
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    assert all(language.has_letter(x) == unicodedata.category(x).startswith("L") for x in points)
    net = language.Folded(language.train(np.zeros((1, language.WINDOW), np.uint8), np.zeros(1, np.int64), ["en"]))
    assert language.predict(net, ["\u00bd \u00b2\u00b3", "\u2167", "a\u00bd"])[0] == ["und", "und", "en"]


def test_gradients_are_those_of_the_loss():
    """Against differences of the loss, parameter by parameter."""
    rng = np.random.default_rng(6)
    x, y = rng.integers(0, 256, (5, language.WINDOW)).astype(np.uint8), np.arange(5) % 3
    values = language.initial(rng, 3)
    _, grads = language.loss_and_gradients(values, x, y)
    for v, g in zip(values, grads, strict=True):
        used = np.flatnonzero(g.ravel())
        for i in rng.choice(used, min(12, len(used)), replace=False):
            keep, diff = v.flat[i], []
            for h in (1e-6, -1e-6):
                v.flat[i] = keep + h
                diff.append(language.loss_and_gradients(values, x, y)[0])
            v.flat[i] = keep
            assert np.isclose((diff[0] - diff[1]) / 2e-6, g.flat[i], rtol=1e-3, atol=1e-7)


def test_sample_is_bounded_for_null_and_repeated_ids(spark):
    """5,000 rows without id, 3,000 of one id, and 4,000 copies of one row: each distinct row counts once, and no language has more than its share."""
    rows = [(None, f"text number {k}", "en") for k in range(5000)] + [(7, f"texte {k}", "fr") for k in range(3000)] + [(8, "immer gleich", "de")] * 4000 + [(9, "nie gleich", "de")]
    rows += [(k, f"rare {k}", f"x{k}") for k in range(100, 130)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language.sample(docs, per_language=50, max_languages=4).collect()
    by = {name: [r for r in got if r.lang == name] for name in {r.lang for r in got}}
    assert {"en", "fr", "de"} <= set(by) and len(by) == 4
    assert len(by["en"]) == len(by["fr"]) == 50 and len(by["de"]) == 2
    assert sorted(map(tuple, got)) == sorted(map(tuple, language.sample(docs.repartition(7), per_language=50, max_languages=4).collect()))


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "some words", "en", 5, "k")], "doc_id long, text string, lang string, windows int, kept string")
    got = language.identify(docs, language.fit_on(docs), docs.columns)
    assert got.columns == [*docs.columns, "lang_pred", "score"] and got.first().kept == "k"
