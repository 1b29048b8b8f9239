"""Documents with awkward rows, and plain definitions to hold results against."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def words(text):
    return WORD.findall(text or "")


def docs(spark, rows, parts=3):
    """doc_id, text, lang, source, n_chars and columns with names that operators use inside."""
    full = [(i, t, "en", "src0", len(t or ""), "x", 1) for i, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, sid string, n long").repartition(parts)


AWKWARD = [(1, None), (2, ""), (3, " \n\t"), (None, "a b c"), (4, "one"), (4, "one"), (5, "x y " * 30_000), (6, "é ß İ 中 \u2003 z")]
