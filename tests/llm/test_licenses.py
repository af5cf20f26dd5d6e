"""License scans: spellings, copyright lines, entire texts, notices, edge rows."""

import textwrap

from plumbline.llm import licenses
from tests.oracle import compare


def test_entire_texts_and_notices(spark):
    changed = "The MIT Licence\n".replace("The ", "") + "Copyright (c) 2020 Someone\n\n# " + licenses.MIT.upper().replace("NONINFRINGEMENT", "Non-Infringement").replace(",", " ,") + "\n(C) more\n"
    rows = [
        (1, changed, "x"),
        (2, licenses.MIT + " And more.", None),
        (3, "Prose.\n  * Released under the M.I.T. licence", None),
        (4, "Prose.\nreleased under the MIT Licence!\nLicensed under the Apache License, Version 2.0.\nReleased under the MIT License", None),
        (5, None, None),
        (6, "", None),
        (7, "Copyright 2021 A\nAll rights reserved.", None),
        (8, "Licensed under CC BY-NC 4.0.", None),
        (8, "Licensed under CC BY-NC 4.0.", None),
        (8, "Nothing here.", None),
        (None, "word " * 40_000, None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, license_id string")
    got = sorted((((r.doc_id or 0), r.license_id, tuple(r.notices), r.n_notice_lines) for r in licenses.scan(docs).collect()), key=lambda r: (r[0], r[1] is None))
    assert got == [
        (0, None, (), 0), (1, "MIT", (), 0), (2, None, (), 0), (3, None, (), 0), (4, None, ("Apache-2.0", "MIT"), 3), (5, None, (), 0),
        (6, None, (), 0), (7, None, (), 0), (8, "CC-BY-NC-4.0", ("CC-BY-NC-4.0",), 1), (8, "CC-BY-NC-4.0", ("CC-BY-NC-4.0",), 1), (8, None, (), 0),
    ]
    assert licenses.scan(docs.limit(0)).count() == 0


def test_wrapped_texts(spark):
    """A line that a wrap begins with `copyright` is prose, in every known text at every width."""
    head = "Copyright (c) 2020 Someone\nAll rights reserved.\n\n"
    rows, want = [], []
    short = [(name, (licenses.TEXTS / f"{name}.txt").read_text()) for name in ("BSL-1.0", "Unlicense", "Zlib")]
    for license_id, text in [*licenses.KNOWN, *short]:
        for width in range(24, 121):
            want.append(license_id)
            rows.append((len(rows), head + "\n".join(textwrap.fill(part, width) for part in text.split("\n"))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.license_id for r in licenses.scan(docs).collect()}
    assert [got[i] for i in range(len(rows))] == want
    assert "COPYRIGHT HOLDERS BE" in {line[:20] for _, text in rows for line in text.split("\n")}


def test_copyright_lines(spark):
    statements = ["Copyright (c) 2020 A", "copyright 2020", "(c) 2020 A", "© A", "Copyright Jane Doe", "# Copyright: 2021, A", "Copyright The Parser Authors", "Copyright [yyyy] [name]", "(C) more", "All rights reserved."]
    prose = ["copyright notice and this permission notice", "COPYRIGHT HOLDERS BE LIABLE", "copyright license to reproduce", "copyright, patent, trademark", "copyright.", "copyright", "(c) You must retain", "copyrighted works", "copyright the software, and (2)", "(c) the licenses granted"]
    lines = spark.createDataFrame([(k, x) for k, x in enumerate(statements + prose)], "k int, line string")
    got = [r.form for r in lines.select("k", licenses.canonical_line(lines["line"]).alias("form")).orderBy("k").collect()]
    assert [form == "" for form in got] == [True] * len(statements) + [False] * len(prose)


def test_whole_texts_and_titles(spark):
    """Whole texts as the system ships them, and usual titles."""
    head = "Copyright (c) 2020 Someone\n\n"
    named = {path.stem: path.read_text() for path in licenses.TEXTS.glob("*.txt")}
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0", "BSD-3-Clause", "EPL-1.0"} <= set(named)
    bsd = named["BSD-3-Clause"].replace("THE REGENTS AND", "THE COPYRIGHT HOLDERS AND").replace("THE REGENTS OR", "THE COPYRIGHT HOLDER OR").replace("the University", "the copyright holder")
    rows = [*named.items(), ("MIT", "The MIT License (MIT)\n\n" + head + licenses.MIT), ("BSD-3-Clause", "BSD 3-Clause License\n\n" + head + bsd)]
    rows.append(("BSD-2-Clause", "BSD 2-Clause License\n\n" + head + bsd[: bsd.index("3. ")] + bsd[bsd.index("THIS SOFTWARE") :]))
    rows.append(("Apache-2.0", named["Apache-2.0"][: named["Apache-2.0"].index("APPENDIX")]))
    rows += [("Unlicense", "The Unlicense\n\n" + named["Unlicense"] + "\nFor more information, please refer to <http://unlicense.org>\n"), ("Zlib", "zlib License\n\n" + head + named["Zlib"]), ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003\n\n" + named["BSL-1.0"])]
    docs = spark.createDataFrame([(k, text) for k, (_, text) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.license_id for r in licenses.scan(docs).collect()}
    assert [got[k] for k in range(len(rows))] == [name for name, _ in rows]
    assert all(len(text) > 500 for _, text in licenses.known_texts() if text not in {t for _, t in licenses.KNOWN})


def test_sql(spark):
    compare(spark, "/root/testdata/sf0.01", licenses.op8_licenses, licenses.OP8_SQL)


def test_sql_on_planted_texts(spark, tmp_path):
    """Query and SQL agree on entire texts of every known licence, under statements of one and two lines, wrapped, and cut."""
    heads = ["", "Copyright (c) 2020 Someone\n\n", "Copyright (c) 2010-2020 Foo\nand others\n\n", "(C) 2020 The Parser Authors\n  <foo@example.org>\n", "Copyright by Jane Doe,\nwith help from others\n"]
    rows, want = [], []
    for k, (license_id, text) in enumerate(licenses.known_texts()):
        for body in (text, "\n".join(textwrap.fill(part, 60 + k % 30) for part in text.split("\n"))) if len(text) < 5000 else (text,):
            rows.append((len(rows), heads[k % len(heads)] + body))
            want.append(license_id)
    rows += [(len(rows) + k, text) for k, text in enumerate([licenses.MIT[:-9], "and others\n" + licenses.MIT, licenses.MIT + "\nCopyright holders are many", None, ""])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    (tmp_path / "t").mkdir()
    docs.coalesce(1).toPandas().to_parquet(tmp_path / "t" / "documents.parquet")
    compare(spark, str(tmp_path / "t"), licenses.op8_licenses, licenses.OP8_SQL)
    got = {r.doc_id: r.license_id for r in licenses.scan(docs).collect()}
    assert [got[k] for k in range(len(want))] == want and not any(got[k] for k in range(len(want), len(rows)))


def test_known_texts_without_rows_and_beyond_the_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame([(1, licenses.MIT), (2, None)], "doc_id long, text string")
    none = licenses.scan(docs, spark.createDataFrame([], "license_id string, text string"))
    assert [(r.license_id, list(r.notices)) for r in none.collect()] == [(None, [])] * 2
    want = sorted(map(str, licenses.scan(docs).collect()))
    monkeypatch.setattr(licenses, "MAX_KNOWN", 3)
    assert sorted(map(str, licenses.scan(docs).collect())) == want


def test_a_very_common_line(spark):
    docs = spark.createDataFrame([(k % 50, f"{k}\nSPDX-License-Identifier: MIT\n" * 3) for k in range(2000)], "doc_id long, text string")
    assert {(tuple(r.notices), r.n_notice_lines) for r in licenses.scan(docs).collect()} == {(("MIT",), 3)}
