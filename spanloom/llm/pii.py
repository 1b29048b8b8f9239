"""Personal data by weak supervision: labelers vote on candidate spans, EM estimates their reliabilities, a span classifier decides.

Exact base patterns (e-mail, IPv4, payment card, international phone) always stand. Further candidates (secrets, account and
social security numbers, national phone numbers, spelled-out e-mail addresses, IPv6 addresses) get votes of a pattern, a gazetteer, a context and a shape
labeler: +1 personal, -1 not, 0 none. All candidates of the corpus are counted by kind, votes and shape features; these
counts (a table bounded by the codes, at most ``MOST_CODES`` rows) give the labelers' reliabilities by EM and train the
logistic span classifier on the EM posteriors. Every document is then searched again with the fitted classifier.

Edge cases: null text counts as empty; a null id is kept; repeated rows are each searched; an empty table fits nothing and
returns nothing; every scan is linear in the text's length; other columns are kept by ``redact`` and ignored by ``find``.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import slices

#: Kinds in output order; the first four are the base.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret", "id")
# Words that stand beside personal data, and words that name secrets.
CONTEXT = {
    "email": ("mail", "contact", "write", "correo", "courriel", "schreib"),
    "ip": ("ip", "server", "host", "address", "adresse"),
    "phone": ("tel", "phone", "call", "fax", "mobile", "anruf", "telefon", "móvil"),
    "secret": ("password", "passwd", "pwd", "token", "secret", "apikey", "api_key", "credential", "contraseña", "passwort"),
    "id": ("iban", "account", "konto", "cuenta", "compte", "ssn", "social security"),
}
GAZETTEER = {
    "email": ("com", "org", "net", "edu", "gov", "de", "fr", "es", "io", "uk", "eu"),
    "secret": ("password", "passwd", "pwd", "passphrase", "passwort", "contraseña", "token", "secret", "api_key", "apikey", "access_key", "private_key", "auth_key", "credential", "credentials"),
}
# Lengths of account numbers by country.
IBAN = {"AT": 20, "BE": 16, "CH": 21, "CZ": 24, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "IE": 22, "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "SE": 24}
LABELERS = 4
FEATURES = 5
MOST_CODES = len(KINDS) * 3**LABELERS * 2**FEATURES

_EMAIL_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9]){15,}+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_SECRET = re.compile(r"(?<![A-Za-z0-9_])([A-Za-z_]{2,}+)\x20?[=:]\x20?(\"?)([A-Za-z0-9+/_.-]{8,}+)")
_LOCAL_PHONE = re.compile(r"(?<![0-9+(-])(?:\([0-9]{3}\)\x20|[0-9]{3}[\x20.-])[0-9]{3}[.-][0-9]{4}(?![0-9-])")
_SPELLED = re.compile(r"(?<![A-Za-z0-9._-])([A-Za-z0-9._-]{2,}+)\x20?[\[(]at[\])]\x20?([A-Za-z0-9-]{2,}+(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z]{2,}+)++)")
_IPV6 = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}(?![0-9A-Za-z:])")
# Secrets that show by their form (cloud and repository keys, signed web tokens).
_TOKEN = re.compile(r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+)(?![A-Za-z0-9])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")


def iban(text: str, at: int) -> int:
    """End of the account number (single blanks allowed) that begins at a place of ``text``; 0 if its length or check digits are wrong."""
    want, own = IBAN.get(text[at : at + 2], 0), ""
    for i in range(at, min(len(text), at + 2 * want)):
        c = text[i]
        if c.isascii() and (c.isdigit() or c.isupper()):
            own += c
        elif c != " " or text[i - 1] == " ":
            return 0
        if len(own) == want:
            ends = i + 1 == len(text) or not (text[i + 1].isascii() and text[i + 1].isalnum())
            return (i + 1) * (ends and int("".join(str(int(x, 36)) for x in own[4:] + own[:4])) % 97 == 1)
    return 0


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        total += x if i % 2 == 0 else (2 * x if x < 5 else 2 * x - 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            end = m.end()
        else:
            end = max(end, at + 1)  # no later match can begin in this run
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind index, start, end) of the base patterns, leftmost and non-overlapping per kind, failing matches dropped."""
    out = [(0, a, z) for a, z in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    if "." in text:
        out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(int(p[-9:]) <= 255 and not p[:-9].strip("0") for p in m.groups())]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_DIGIT.findall(m[0])) <= 15]
    return out


def _entropy(s: str) -> float:
    return -sum(p * math.log2(p) for p in (s.count(c) / len(s) for c in set(s)))


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(kind index, start, end, code) of spans beyond the base; the code packs votes and shape features."""
    found: list[tuple[int, int, int, str, bool, str]] = []  # kind, start, end, value, strict pattern, name before it
    if "=" in text or ":" in text:
        for m in _SECRET.finditer(text):
            named = m[1].lower().endswith(GAZETTEER["secret"])
            if named or (_DIGIT.search(m[3]) and len(m[3]) >= 16):
                found.append((4, m.start(3), m.end(3), m[3], bool(re.fullmatch(r"[0-9a-fA-F]{16,}", m[3])), m[1].lower()))
        found += [(1, m.start(), m.end(), m[0], True, "") for m in _IPV6.finditer(text)]
    if _DIGIT.search(text) and ("-" in text or "." in text):
        found += [(3, m.start(), m.end(), m[0], True, "") for m in _LOCAL_PHONE.finditer(text)]
    if "[at]" in text or "(at)" in text:
        found += [(0, m.start(), m.end(), m[0], True, m[2].lower()) for m in _SPELLED.finditer(text)]
    if "AKIA" in text or "gh" in text or "xox" in text or "eyJ" in text:
        found += [(4, m.start(), m.end(), m[0], True, "token") for m in _TOKEN.finditer(text)]
    if _DIGIT.search(text):
        found += [(5, m.start(), z, text[m.start() : z], True, "") for m in _IBAN.finditer(text) if (z := iban(text, m.start()))]
        if "-" in text:
            found += [(5, m.start(), m.end(), m[0], False, "") for m in _SSN.finditer(text)]
    out, last = [], -1
    taken = sorted((a, z) for _, a, z in base)
    reach = list(itertools.accumulate((z for _, z in taken), max))  # ascending: spans before the first reach over a place end before it

    def beside(a: int, z: int) -> Iterator[tuple[int, int]]:
        """Base spans that overlap [a, z); candidates don't overlap, so all of them together take linear time."""
        i = bisect.bisect_right(reach, a)
        while i < len(taken) and taken[i][0] < z:
            if taken[i][1] > a:
                yield taken[i]
            i += 1

    for kind, a, z, value, strict, name in sorted(found, key=lambda x: (x[1], -x[2])):
        # a secret may hold digits that look like a card or an address; other overlaps are the base's
        if a < last or any(not (kind == 4 and a <= x and y <= z and z - a > 2 * (y - x)) for x, y in beside(a, z)):
            continue
        last = z
        near = (text[max(0, a - 40) : a] + " " + text[z : z + 20]).lower()
        digits = sum(c.isdigit() for c in value)
        e = _entropy(value)
        votes = (
            1 if strict else 0,
            (1 if name.endswith(GAZETTEER[KINDS[kind]]) else -1) if KINDS[kind] in GAZETTEER else 0,
            1 if any(w in near for w in CONTEXT.get(KINDS[kind], ())) else -1,
            (1 if e >= 3 and digits >= 3 else -1) if kind == 4 else (1 if digits in (0, 10) else 0),
        )
        shape = (len(value) >= 16, digits * 3 >= len(value), e >= 3.2, " " in value, value == value.lower())
        code = sum((v + 1) * 3**i for i, v in enumerate(votes)) + 3**LABELERS * sum(b << i for i, b in enumerate(shape))
        out.append((kind, a, z, code))
    return out


def unpack(code: int) -> tuple[list[int], list[int]]:
    """Votes and shape features of a code."""
    votes = [code // 3**i % 3 - 1 for i in range(LABELERS)]
    shape = code // 3**LABELERS
    return votes, [shape >> i & 1 for i in range(FEATURES)]


def em(votes: np.ndarray, weight: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of each vote pattern and the labelers' rates P(vote | class), by EM from a majority start."""
    q = 1 / (1 + np.exp(-votes.sum(1) - 0.5))
    rates = np.zeros((2, votes.shape[1], 3))
    for _ in range(rounds):
        for c, w in ((1, weight * q), (0, weight * (1 - q))):
            for j in range(votes.shape[1]):
                # the prior count says: labelers are more often right than wrong
                n = np.array([w[votes[:, j] == v].sum() for v in (-1, 0, 1)]) + ([2, 4, 6] if c else [6, 4, 2])
                rates[c, j] = n / n.sum()
        prior = ((weight * q).sum() + 1) / (weight.sum() + 2)
        score = np.full(len(votes), math.log(prior / (1 - prior)))
        for j in range(votes.shape[1]):
            score += np.log(rates[1, j, votes[:, j] + 1] / rates[0, j, votes[:, j] + 1])
        q = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
    return q, rates


def _row(kind: int, code: int) -> list[float]:
    votes, shape = unpack(code)
    return [1.0, *votes, *shape, *(float(kind == k) for k in range(len(KINDS)))]


def fit(counts: list[tuple[int, int, int]]) -> np.ndarray:
    """Weights of the span classifier from (kind, code, count) over all candidates of the corpus."""
    width = 1 + LABELERS + FEATURES + len(KINDS)
    if not counts:
        return np.zeros(width)
    x = np.array([_row(k, c) for k, c, _ in counts])
    n = np.array([c for *_, c in counts], float)
    q = np.zeros(len(counts))
    for kind in range(len(KINDS)):
        own = np.array([k == kind for k, *_ in counts])
        if own.any():
            q[own] = em(x[own, 1 : 1 + LABELERS].astype(int), n[own])[0]
    w, scale = np.zeros(width), n / n.sum()
    for _ in range(60):  # Newton steps of ridge logistic regression
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (scale * (p - q)) + 1e-3 * w
        hess = (x.T * (scale * p * (1 - p))) @ x + 1e-3 * np.eye(width)
        w -= np.linalg.solve(hess, grad)
    return w


def learn(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Fit the classifier on all candidates of ``docs``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], int] = {}
        for b in slices(batches, text):
            for t in b.column(b.schema.get_field_index(text)).to_pylist():
                for kind, _, _, code in candidates(t, base_spans(t)):
                    total[kind, code] = total.get((kind, code), 0) + 1
        keys = list(total)
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.int32()), pa.array([c for _, c in keys], pa.int32()), pa.array(list(total.values()), pa.int64())], names=["kind", "code", "n"])

    rows = docs.select(text).mapInArrow(count, "kind int, code int, n long").groupBy("kind", "code").agg(F.sum("n").alias("n")).collect()  # at most MOST_CODES rows
    return fit(sorted((r.kind, r.code, r.n) for r in rows))


def all_spans(text: str, weights: np.ndarray) -> tuple[list, list]:
    """Base spans and all spans, (kind index, start, end) by kind and start."""
    base = sorted(base_spans(text))
    more = [(k, a, z) for k, a, z, code in candidates(text, base) if np.dot(_row(k, code), weights) > 0]
    return base, sorted([*base, *more])


def _said(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{z}" for k, a, z in spans)


def find(docs: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """Per row of ``docs`` (``doc_id``, ``text``): base counts, SHA-256 of the base spans, all spans, and n_spans, the number of all."""
    weights = learn(docs) if weights is None else weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = []
            for t in b.column(1).to_pylist():
                base, spans = all_spans(t, weights)
                kinds = [k for k, *_ in base]
                rows.append((*(kinds.count(k) for k in range(4)), hashlib.sha256(_said(base).encode()).hexdigest(), _said(spans), len(spans)))
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, pa.int64()) for c in cols[:4]), *(pa.array(c, pa.string()) for c in cols[4:6]), pa.array(cols[6], pa.int64())],
                names=["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "n_spans"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")


def redact(docs: DataFrame, weights: np.ndarray | None = None, text: str = "text") -> DataFrame:
    """``docs`` with each found span replaced by its kind in brackets; overlapping spans are replaced together."""
    weights = learn(docs, text) if weights is None else weights

    def cleaned(t: str) -> str:
        _, spans = all_spans(t, weights)
        if not spans:
            return t
        out, at = [], 0
        for kind, a, z in sorted(spans, key=lambda s: (s[1], -s[2])):
            if a >= at:
                out += [t[at:a], f"[{KINDS[kind].upper()}]"]
            at = max(at, z)
        return "".join([*out, t[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text):
            i = b.schema.get_field_index(text)
            yield b.set_column(i, b.schema.field(i), pa.array([cleaned(t) for t in b.column(i).to_pylist()], b.column(i).type))

    return docs.mapInArrow(run, docs.schema)
