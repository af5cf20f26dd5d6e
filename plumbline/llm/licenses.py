"""License scans by canonical digests, with built-in functions only.

A line's canonical form has lower case, single spaces for all that is no letter or digit, one spelling for
equivalent words, and is empty for a copyright line (see STATEMENT; a wrapped sentence that goes on with `copyright notice` is none); a text's form is those of its lines, joined by spaces, without a
line that goes on with the copyright line above it (see GOES_ON). The SHA-256 of the canonical form is joined with the digests of known
licences: once for the entire text, once for each of its lines (a notice is a line that says which licence applies).

Null and empty texts, and texts that are only copyright lines, have an empty form and match nothing. Matches belong to rows: of rows with equal ids each
has those of its own text. An empty table gives an empty result; other columns are ignored. The known licences are those of known_texts() or a
table given by the caller, which is broadcast only up to MAX_KNOWN rows.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_KNOWN = 10_000

# Public licence texts and notices.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
ZERO_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."
ISC_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
KNOWN = [
    ("MIT", MIT),
    ("MIT", "MIT License\n\n" + MIT),
    ("ISC", ISC_GRANT + "\n\n" + ISC_WARRANTY),
    ("ISC", "ISC License\n\n" + ISC_GRANT + "\n\n" + ISC_WARRANTY),
    ("0BSD", ZERO_GRANT + "\n\n" + ISC_WARRANTY),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "SPDX-License-Identifier: CC-BY-NC-4.0"),
]
SPELLINGS = [
    ("acknowledgement", "acknowledgment"), ("authorisation", "authorization"), ("authorised", "authorized"), ("favour", "favor"), ("fulfil", "fulfill"),
    ("https", "http"), ("licence", "license"), ("licenced", "licensed"), ("merchantibility", "merchantability"), ("non infringement", "noninfringement"),
    ("organisation", "organization"), ("sub license", "sublicense"), ("sublicence", "sublicense"), ("whilst", "while"),
]
TITLES = {
    "MIT": ["The MIT License (MIT)", "The MIT License", "MIT License (MIT)", "Expat License"],
    "ISC": ["ISC License (ISC)", "The ISC License"],
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD", "BSD Zero Clause License (0BSD)"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", 'BSD 2-Clause "Simplified" License', "Simplified BSD License"],
    "BSL-1.0": ["Boost Software License - Version 1.0 - August 17th, 2003", "Boost Software License 1.0"],
    "Unlicense": ["The Unlicense", "Unlicense"],
    "Zlib": ["zlib License", "The zlib License", "The zlib/libpng License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License', "New BSD License"],
}
UNLICENSE_END = "For more information, please refer to <https://unlicense.org/>"
# End of the fixed values.
#: Whole texts as the system's copyright files have them; a file is named by its licence.
TEXTS = Path(__file__).with_name("license_texts")
END_OF_TERMS = "END OF TERMS AND CONDITIONS"


def known_texts() -> list[tuple[str, str]]:
    """(license_id, text): KNOWN, the whole texts of TEXTS with and without what follows their terms, BSD texts, and all of them under their usual titles."""
    found, plain = list(KNOWN), {"MIT": [MIT], "ISC": [ISC_GRANT + "\n\n" + ISC_WARRANTY], "0BSD": [ZERO_GRANT + "\n\n" + ISC_WARRANTY]}
    for path in sorted(TEXTS.glob("*.txt")):
        text = path.read_text(encoding="utf-8")
        found.append((path.stem, text))
        if END_OF_TERMS in text:
            terms = text[: text.index(END_OF_TERMS)]
            found += [(path.stem, terms), (path.stem, terms + END_OF_TERMS)]
    regents = (TEXTS / "BSD-3-Clause.txt").read_text(encoding="utf-8")
    holder = regents.replace("name of the University", "name of the copyright holder").replace("THE REGENTS AND", "THE COPYRIGHT HOLDERS AND").replace("THE REGENTS OR", "THE COPYRIGHT HOLDER OR")
    three = [regents, holder, holder.replace("COPYRIGHT HOLDER OR", "COPYRIGHT OWNER OR")]
    two = [t[: t.index("3. Neither")] + t[t.index("THIS SOFTWARE IS") :] for t in three]
    for name, texts in (("BSD-3-Clause", three), ("BSD-2-Clause", two)):
        plain[name] = [v for t in texts for v in (t, t.replace("\n1. ", "\n* ").replace("\n2. ", "\n* ").replace("\n3. ", "\n* "))]
    for name in ("BSL-1.0", "Unlicense", "Zlib"):
        plain[name] = [(TEXTS / f"{name}.txt").read_text(encoding="utf-8")]
    plain["Unlicense"].append(plain["Unlicense"][0] + "\n" + UNLICENSE_END)
    return found + [(name, f"{title}\n\n{t}") for name, texts in plain.items() for t in texts for title in ["", *TITLES[name]]]



# Words after `copyright` or `(c)` at a line's begin that show a sentence, wrapped there, or an item of a list; any other word is a holder.
PROSE = (
    "a|an|and|any|are|as|at|be|but|claims?|disclaimers?|doctrines?|each|every|except|for|from|have|holders?|if|in|information|infringement|interests?|is|it|laws?|licen[cs]es?|licen[cs]ing|may|must|no|not"
    "|notices?|of|on|or|owners?|owned|ownership|permissions?|protection|related|representations?|resulting|rights?|shall|statements?|status|terms|that|these|they|this|those|to|treat(?:y|ies)|under|used?|when|where|which|will|with|work|you|your"
)
GROUP = "authors?|contributors?|developers?|foundation|group|maintainers?|project|regents|team"
_S, _HEAD, _END = r"[ \t\f\r\x0B]", r"^[^\p{L}\p{N}]*", r"(?:[^\p{L}\p{N}]|$)"
_SIGN, _YEAR = r"(?:\(c\)|©|&copy;)", r"(?:19|20)[0-9][0-9](?:[^0-9]|$)"
_BEFORE_HOLDER = rf"(?:copyright{_S}*:?{_S}+|\(c\){_S}*)"
#: Of a lower-case line, without look-ahead, so that SQL can state the same. A sign, or `copyright` before a year, a sign or `the ... authors`, is always a
#: statement; `copyright` before another word is one unless that word shows a sentence that merely goes on with `copyright`.
STATEMENT = (
    rf"{_HEAD}(?:all rights reserved|©|&copy;|copyright[ \t\f\r\x0B:,\-]*(?:{_SIGN}|{_YEAR})|\(c\)[ \t\f\r\x0B:,\-]*(?:copyright|©|{_YEAR})"
    rf"|{_BEFORE_HOLDER}(?:by{_S}+)?the{_S}+(?:[^ \t\f\r\x0B]+{_S}+){{0,3}}(?:{GROUP}){_END})"
)
WITH_HOLDER = rf"{_HEAD}{_BEFORE_HOLDER}[\p{{L}}\p{{N}}\[<{{]"
SENTENCE = rf"{_HEAD}{_BEFORE_HOLDER}(?:{PROSE}|the){_END}"
#: A line that goes on with the statement above it: `and others`, or an address.
GOES_ON = rf"^{_S}*(?:and|with){_S}|@|://"
WORD = r"[\p{L}\p{N}]"
OTHER = r"[^\p{L}\p{N}]+"


def canonical_line(line: Column) -> Column:
    lower = F.lower(line)
    # two spaces between words and one around all, so that replacements of neighbours don't share a space
    words = F.concat(F.lit(" "), F.trim(F.regexp_replace(lower, OTHER, "  ")), F.lit(" "))
    for old, new in SPELLINGS:
        if " " not in old:
            words = F.replace(words, F.lit(f" {old} "), F.lit(f" {new} "))
    statement = lower.rlike(STATEMENT) | (lower.rlike(WITH_HOLDER) & ~lower.rlike(SENTENCE))
    return F.when(statement, F.lit("")).otherwise(F.trim(F.replace(words, F.lit("  "), F.lit(" "))))


def joined(form: Column) -> Column:
    """Equivalents of two words, which may stand on two lines."""
    padded = F.concat(F.lit(" "), form, F.lit(" "))
    for old, new in SPELLINGS:
        if " " in old:
            padded = F.replace(padded, F.lit(f" {old} "), F.lit(f" {new} "))
    return F.trim(padded)


def line_forms(text: Column) -> Column:
    """Of each line, its form and whether it goes on with the copyright line above it (an empty form of a line with words)."""
    return F.transform(F.split(text, "\n"), lambda x: F.struct(canonical_line(x).alias("form"), F.lower(x).rlike(GOES_ON).alias("on"), x.rlike(WORD).alias("words")))


def text_form(lines: Column) -> Column:
    above = lambda i: F.get(lines, i - 1)
    goes_on = lambda x, i: x["on"] & F.coalesce((above(i)["form"] == "") & above(i)["words"], F.lit(False))
    return joined(F.concat_ws(" ", F.transform(F.filter(lines, lambda x, i: (x["form"] != "") & ~goes_on(x, i)), lambda x: x["form"])))


def digest(form: Column) -> Column:
    return F.when(form != "", F.sha2(form.cast("binary"), 256))


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """One row per row of docs: doc_id, license_id (of the entire text, or null), notices (array), n_notice_lines.

    known: license_id, text. One of several licences with the same canonical form is named: the first in order.
    """
    spark = docs.sparkSession
    known = spark.createDataFrame(known_texts(), "license_id string, text string") if known is None else known
    known = known.select("license_id", digest(text_form(line_forms(F.col("text")))).alias("digest")).where("digest IS NOT NULL").groupBy("digest").agg(F.min("license_id").alias("license_id"))
    if known.limit(MAX_KNOWN + 1).count() <= MAX_KNOWN:
        known = F.broadcast(known)
    row = F.md5(docs["text"].cast("binary"))  # tells texts under one id apart
    rows = docs.select(docs["doc_id"].alias("doc_id"), row.alias("row"), line_forms(docs["text"]).alias("forms"))
    # line -1 is the entire text
    lines = F.transform("forms", lambda x, i: F.struct(i.alias("line"), joined(x["form"]).alias("form")))
    units = F.concat(F.array(F.struct(F.lit(-1).alias("line"), text_form(F.col("forms")).alias("form"))), lines)
    found = rows.select("doc_id", "row", F.explode(units).alias("u")).select("doc_id", "row", "u.line", digest(F.col("u.form")).alias("digest")).join(known, "digest")
    # rows that are the same in id and text have the same matches, and count them once
    found = found.groupBy(F.col("doc_id").alias("at"), F.col("row").alias("of"), "line").agg(F.min("license_id").alias("license_id"))
    per = found.groupBy("at", "of").agg(
        F.min(F.when(F.col("line") < 0, F.col("license_id"))).alias("license_id"),
        F.array_sort(F.collect_set(F.when(F.col("line") >= 0, F.col("license_id")))).alias("notices"),
        F.count_if(F.col("line") >= 0).alias("n_notice_lines"),
    )
    return docs.select(docs["doc_id"].alias("doc_id"), row.alias("row")).join(per, F.col("doc_id").eqNullSafe(F.col("at")) & (F.col("row") == F.col("of")), "left").select(
        "doc_id", "license_id", F.coalesce("notices", F.array().cast("array<string>")).alias("notices"), F.coalesce("n_notice_lines", F.lit(0)).cast("long").alias("n_notice_lines")
    )


def op8_licenses(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan(docs).select("doc_id", "license_id", F.concat_ws(",", "notices").alias("notices"), "n_notice_lines")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql() -> str:
    line = "' ' || trim(regexp_replace(lower(t), " + _quoted(OTHER) + ", '  ', 'g')) || ' '"
    text = "' ' || form || ' '"
    for old, new in SPELLINGS:
        if " " in old:
            text = f"replace({text}, ' {old} ', ' {new} ')"
        else:
            line = f"replace({line}, ' {old} ', ' {new} ')"
    low = "lower(t)"
    statement = f"regexp_matches({low}, {_quoted(STATEMENT)}) OR (regexp_matches({low}, {_quoted(WITH_HOLDER)}) AND NOT regexp_matches({low}, {_quoted(SENTENCE)}))"
    line = f"CASE WHEN {statement} THEN '' ELSE trim(replace({line}, '  ', ' ')) END"

    def forms(table: str, key: str) -> str:
        """key, i, form of each line, and whether the text's form has it."""
        return f"""
  SELECT {key}, i, form, form <> '' AND NOT (regexp_matches({low}, {_quoted(GOES_ON)}) AND coalesce(lag(form) OVER above = '' AND regexp_matches(lag(t) OVER above, {_quoted(WORD)}), false)) AS counts
  FROM (SELECT *, {line} AS form FROM (SELECT {key}, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM {table}))
  WINDOW above AS (PARTITION BY {key} ORDER BY i)"""

    values = ", ".join(f"({i}, {_quoted(n)}, {_quoted(t)})" for i, (n, t) in enumerate(known_texts()))
    return f"""
WITH given AS (SELECT k, license_id, t AS text FROM (VALUES {values}) AS v(k, license_id, t)),
known AS (
  SELECT form, min(license_id) AS license_id FROM (
    SELECT license_id, trim({text}) AS form FROM (SELECT k, string_agg(form, ' ' ORDER BY i) FILTER (counts) AS form FROM ({forms("given", "k")}) GROUP BY k) JOIN given USING (k)) GROUP BY form),
lines AS ({forms("documents", "doc_id")}),
units AS (
  SELECT doc_id, false AS entire, form FROM lines
  UNION ALL SELECT doc_id, true, string_agg(form, ' ' ORDER BY i) FILTER (counts) FROM lines GROUP BY doc_id),
found AS (SELECT doc_id, entire, license_id FROM (SELECT doc_id, entire, trim({text}) AS form FROM units) JOIN known USING (form) WHERE form <> '')
SELECT d.doc_id, min(license_id) FILTER (entire) AS license_id,
       coalesce(string_agg(DISTINCT license_id, ',' ORDER BY license_id) FILTER (NOT entire), '') AS notices,
       count(*) FILTER (NOT entire) AS n_notice_lines
FROM documents d LEFT JOIN found f ON d.doc_id = f.doc_id GROUP BY d.doc_id
"""


OP8_SQL = _sql()
