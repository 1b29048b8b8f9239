"""Licence scan by canonical digests: whole texts, and notice lines, are looked up among the digests of known licences.

A text is canonical when A-Z are lower-cased, lines that name a copyright's holder or year are gone, equivalent spellings are one, and punctuation and white
space are single blanks; its SHA-256 is hash-joined with the known digests. The known table is small and checked: beyond
``MOST`` rows it is joined without a broadcast. Lines that speak of a licence are looked up in the same way among notices.

The known texts are those of ``TEXTS`` and of the files in ``licence_texts``, whole and up to the end of their terms, with and
without usual titles. It is no full licence list: texts of other licences have no license_id.

Edge cases: null text counts as empty; an empty canonical text matches nothing; a null id is kept; repeated rows each return; an
empty table returns no rows; other columns are ignored.
"""

from __future__ import annotations

from importlib import resources

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hosts import LOWER, UPPER

MOST = 10_000
# Equivalent spellings (left becomes right), known licence texts and notices.
EQUIVALENT = [
    ("licence", "license"), ("sub license", "sublicense"), ("organisation", "organization"), ("favour", "favor"), ("authorisation", "authorization"),
    ("copyright owner", "copyright holder"), ("non commercial", "noncommercial"), ("whilst", "while"), ("wilful", "willful"), ("acknowledgement", "acknowledgment"),
]
#: Lines that the SQL twin drops; it also drops lines of a licence that happen to begin so, which ``HELD`` keeps.
COPYRIGHT = r"(^|\n)[ \t*#/;-]*(copyright|\(c\)|©)[^\n]*"
#: Words after "copyright" in the prose of licences; any other word is a holder.
PROSE = (
    "act acts all and any are as at be claim claims disclaimer doctrines for from has holder holders if in infringement information interest interests is law laws"
    " licence license licenses may not notice notices of on or other owner owners ownership permission permissions protection resulting rights shall statement"
    " statements that the this to treaty under which will with work works"
).split()
_YEAR = r"(?:19|20)[0-9]{2}"
HELD = (
    rf"(^|\n)[ \t*#/;-]*(?:copyright[ \t:]*(?:\(c\)|©|{_YEAR}|<|\[yyyy\])|copyright[ \t:]+(?!(?:{'|'.join(PROSE)})\b)[^\x00-`{{-\x7f]"
    rf"|copyright[ \t:]+the[ \t][^\n]*\b(?:authors|contributors|developers|foundation|project|team)\b|\(c\)[ \t]*(?:copyright|{_YEAR})|©)[^\n]*"
)
DROPPED = "[\\x00-/:-@\\[-`{-\\x7f“”‘’–—©]+"

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
TEXTS = [
    ("MIT", MIT), ("MIT", "MIT License\n" + MIT), ("MIT", "The MIT License (MIT)\n" + MIT),
    ("ISC", ISC), ("ISC", "ISC License\n" + ISC), ("0BSD", ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies", "")),
    ("Zlib", ZLIB), ("Zlib", "zlib License\n" + ZLIB),
]
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"), ("MIT", "Released under the MIT License"), ("MIT", "Licensed under the MIT License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"), ("CC-BY-4.0", "Licensed under CC BY 4.0"), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3"), ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("ISC", "Licensed under the ISC License"), ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0"),
]


def canonical(text: Column) -> Column:
    out = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), HELD, "\n")
    out = F.concat(F.lit(" "), F.regexp_replace(out, DROPPED, " "), F.lit(" "))
    for a, b in EQUIVALENT:
        out = F.replace(out, F.lit(f" {a}"), F.lit(f" {b}"))
    return F.trim(out)


#: Titles above the texts of files, whose own texts begin without one.
TITLES = {"BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License"], "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", "New BSD License"]}
TERMS = "END OF TERMS AND CONDITIONS"


def filed() -> list[tuple[str, str]]:
    """Licence and text of the files in ``licence_texts``; the licence is the file's name."""
    out = []
    for f in sorted(resources.files(__package__).joinpath("licence_texts").iterdir(), key=lambda f: f.name):
        name, text = f.name.removesuffix(".txt").removesuffix(".regents"), f.read_text("utf-8")
        texts = [text, text[: text.index(TERMS)], text[: text.index(TERMS)] + TERMS] if TERMS in text else [text]
        if name in TITLES:
            texts += [x + "All rights reserved.\n" + text for x in ("", *(t + "\n" for t in TITLES[name]))] + [f"{t}\n{text}" for t in TITLES[name]]
        out += [(name, x) for x in texts]
    return out


def known_table(spark, rows: list[tuple[str, str]] | None = None, column: str = "license_id") -> DataFrame:
    """digest and licence of known texts."""
    rows = [*TEXTS, *filed()] if rows is None else rows
    df = spark.createDataFrame(list(rows), f"{column} string, text string")
    return df.select(F.sha2(canonical(F.col("text")), 256).alias("digest"), column).dropDuplicates(["digest"])


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """doc_id, digest of the canonical text, license_id of an equal known text, notice_id of the first licence notice line."""
    spark = docs.sparkSession
    known = known_table(spark) if known is None else known
    if known.limit(MOST + 1).count() <= MOST:
        known = F.broadcast(known)
    pairs = F.array(*(F.struct(canonical(F.lit(t)).alias("t"), F.lit(n).alias("n")) for n, t in NOTICES))
    lines = F.filter(F.split("text", "\n"), lambda x: F.translate(x, UPPER, LOWER).rlike("licen[cs]e"))
    said = F.flatten(F.transform(lines, lambda x: F.transform(F.filter(pairs, lambda p: p["t"] == canonical(x)), lambda p: p["n"])))
    out = docs.select("doc_id", F.sha2(canonical(F.col("text")), 256).alias("digest"), F.get(said, F.lit(0)).alias("notice_id"))
    return out.join(known, "digest", "left").select("doc_id", "digest", "license_id", "notice_id")


def oracle(rows: list[tuple[str, str]] = TEXTS) -> str:
    """DuckDB twin of ``scan`` with the built-in table."""
    lit = lambda s: "'" + s.replace("'", "''") + "'"

    def canon(x: str) -> str:
        out = f"regexp_replace(translate(coalesce({x}, ''), '{UPPER}', '{LOWER}'), {lit(COPYRIGHT)}, chr(10), 'g')"
        out = f"(' ' || regexp_replace({out}, {lit(DROPPED)}, ' ', 'g') || ' ')"
        for a, b in EQUIVALENT:
            out = f"replace({out}, ' {a}', ' {b}')"
        return f"trim({out})"

    values = ", ".join(f"({lit(n)}, {lit(t)})" for n, t in rows)
    notices = ", ".join(f"({i}, {lit(n)}, {lit(t)})" for i, (n, t) in enumerate(NOTICES))
    return f"""
WITH known AS (SELECT DISTINCT sha256({canon('t')}) AS digest, n AS license_id FROM (VALUES {values}) v(n, t)),
notices AS (SELECT {canon('t')} AS t, n FROM (VALUES {notices}) v(i, n, t)),
d AS (SELECT doc_id, row_number() OVER () AS r, text, sha256({canon('text')}) AS digest FROM documents),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ln FROM d),
said AS (SELECT r, arg_min(n, ln) AS notice_id FROM (SELECT r, ln, {canon('line')} AS t FROM lines WHERE regexp_matches(translate(line, '{UPPER}', '{LOWER}'), 'licen[cs]e')) x JOIN notices USING (t) GROUP BY r)
SELECT doc_id, digest, license_id, notice_id FROM d LEFT JOIN known USING (digest) LEFT JOIN said USING (r)"""
