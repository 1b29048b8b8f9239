"""Rules, hosts, PII, licences, decontamination and the classifier."""

import hashlib
import math
import random
import re
import textwrap
import time
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from spanloom.llm import cotrain, decontam, hosts, licences, pii, rules
from tests.llm.util import AWKWARD, docs, words


def test_measures(spark):
    rng = random.Random(1)
    parts = ["a", "bb", "a bb cc", "\n", " ", "\n\n", "%%#", "é😀", "\x0b", "dup line here\n", "|"]
    rows = [(i, "".join(rng.choices(parts, k=rng.randint(0, 30)))) for i in range(300)] + AWKWARD
    got = {(r.doc_id, r.text): r for r in rules.measure(docs(spark, rows)).withColumn("base", rules.base_failed()).collect()}
    for d, t in rows:
        s, w = t or "", words(t)
        lines = [x for x in s.split("\n") if words(x)]
        tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        n = Counter(tri)
        rep = len({i + k for i, x in enumerate(tri) if n[x] > 1 for k in range(3)})
        r = got[d, t]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in s)), (d, t)
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), rep)
        assert r.base == (len(w) < 50 or 100 * rep > 50 * len(w))


def test_binomial_cdf(spark):
    cases = [(k, n) for n in (1, 10, 800, 20_000) for k in (0, 1, 5, 100) if k <= n]
    df = spark.createDataFrame(cases, "k long, n long").select("k", "n", rules.binomial_cdf(F.col("k"), F.col("n"), 0.01).alias("p"))
    for r in df.collect():
        exact = sum(math.exp(math.lgamma(r.n + 1) - math.lgamma(i + 1) - math.lgamma(r.n - i + 1) + i * math.log(0.01) + (r.n - i) * math.log(0.99)) for i in range(r.k + 1))
        assert abs(r.p - exact) < 1e-9 * max(1, exact) + 1e-12


def test_certified_cutoffs(spark):
    text = lambda i, junk: " ".join(f"w{i}x{j}" + ("%%%" if junk else "") for j in range(60))
    rows = [(i, text(i, i % 5 == 0)) for i in range(10, 3010)] + AWKWARD
    m = rules.measure(docs(spark, rows)).drop("text").cache()
    labels = spark.createDataFrame([(i, i % 5 != 0) for i in range(10, 3010)], "doc_id long, good boolean")
    cut = rules.certify(m, labels)
    kept = {r.doc_id: r.kept for r in rules.verdict(m, cut).collect()}
    assert all(kept[i] == (i % 5 != 0) for i in range(10, 3010))
    few = rules.certify(m, labels.where("doc_id < 110"))
    assert few.count() == 0  # too few labels certify nothing
    assert rules.verdict(m, few).where("kept").count() == 3000 + sum(len(words(t)) >= 50 and d != 5 for d, t in AWKWARD)
    assert rules.certify(m, labels.where("false")).count() == 0


def test_cutoffs_against_brute_force(spark):
    rng = random.Random(8)
    share = lambda good: rng.choice([0, 0, 0, 0, 0, 0, 0, 0, 0, 3] if good else [0, 3, 7, 15, 25])
    rows, labels = [], []
    for i in range(3000):
        good, lang = i % 4 != 0, ["en", "de", None][i % 3]
        n = share(good)
        rows.append((i, " ".join(f"w{i}x{j}" for j in range(60 - n)) + " %%%%%%" * n, lang))
        labels.append((i, good))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = rules.measure(df).cache()
    options = {"alpha": 0.5, "delta": 0.2, "penalty": 0.5}
    got = {(r.stratum, r.statistic): r.cutoff for r in rules.certify(m, spark.createDataFrame(labels, "doc_id long, good boolean"), **options).collect()}
    cdf = lambda k, n, p: sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
    held = m.where(~rules.base_failed()).select("doc_id", "lang", *(v.alias(s) for s, v in rules.statistics().items())).collect()
    good, want = dict(labels), {}
    for lang in ("en", "de", None):
        own = [r for r in held if r.lang == lang]
        n = sum(good[r.doc_id] for r in own)
        for s, (sign, cuts) in rules.GRID.items():
            best = None
            for cut in cuts:
                k = sum(good[r.doc_id] and r[s] * sign > cut * sign for r in own)
                bad = sum(not good[r.doc_id] and r[s] * sign > cut * sign for r in own)
                if cdf(k, n, 0.1) > 0.2 / (3 * len(rules.GRID)):
                    break
                if bad - 0.5 * k > 0 and (best is None or bad - 0.5 * k > best[0]):
                    best = (bad - 0.5 * k, cut)
            if best:
                want["" if lang is None else f"={lang}", s] = best[1]
    assert got == want and want


def test_measures_replace_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b", "en", 9, True)], "doc_id long, text string, lang string, n_words long, kept boolean")
    out = rules.verdict(rules.measure(df), rules.certify(rules.measure(df), spark.createDataFrame([], "doc_id long, good boolean"))).head()
    assert (out.n_words, out.kept) == (2, False)


def test_urls(spark):
    urls = ["http://A.B.example.NET/en/x?q#f", "x://example.com/de/1", "net", None, "a://net", "a://net/", "http://q.org/fr/", "http://notnet/", "h://b.example.com?x=/de/", "y://ÄB.org/fr/9#"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    out = {r.page_id: r for r in hosts.judge(pages, spark.createDataFrame([], "page_id long, bad int"), [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]).collect()}
    assert (out[0].host, out[0].path, out[0].rule, out[0].verdict) == ("a.b.example.net", "/en/x", "example.net/en/", "allow")
    assert [out[i].rule for i in range(1, 10)] == ["example.com/de/", None, None, None, "net/", "org/fr/", None, None, "org/fr/"]
    assert [(out[i].host, out[i].path) for i in (2, 3, 4, 8, 9)] == [("", ""), ("", ""), ("net", ""), ("b.example.com", ""), ("ÄB.org".replace("B", "b"), "/fr/9")]
    many = [("block", "net", "/"), ("allow", "example.net", "/en/")] + [("block", f"h{i}.com", "/") for i in range(80)]
    joined = {r.page_id: r.rule for r in hosts.judge(pages, spark.createDataFrame([], "page_id long, bad int"), many).collect()}
    assert joined[0] == "example.net/en/" and joined[5] == "net/" and joined[4] is None


def test_reputation(spark):
    pages = spark.createDataFrame([(i, f"http://{'bad' if i % 2 else 'good'}.site{i % 3}.com/{i}") for i in range(600)] + [(900, "http://new.site1.com/"), (901, "http://bad.site1.com/z")], "page_id long, url string")
    outcome = spark.createDataFrame([(i, i % 2) for i in range(600)], "page_id long, bad int")
    v = {r.page_id: r for r in hosts.judge(pages, outcome, []).collect()}
    assert v[901].verdict == "block" and v[900].verdict == "allow" and all(v[i].verdict == ("block" if i % 2 else "allow") for i in range(600))
    assert 0.2 < v[900].rate < 0.8 and hosts.judge(pages.where("false"), outcome, []).count() == 0


def test_reputation_against_brute_force(spark):
    rng = random.Random(6)
    counts = [(f"h{i}.d{i % 17}.{'com' if i % 3 else 'org'}", n := rng.randint(0, 40), rng.randint(0, n) if i % 5 else n // 8) for i in range(200)] + [("", 3, 1), ("net", 2, 2)]
    got = {r.host: r for r in hosts.reputation(spark.createDataFrame(counts, "host string, n long, bad long")).collect()}
    up = lambda h: ".".join(h.split(".")[-2:])
    tld = lambda h: h.split(".")[-1]

    def total(rows, key):
        out = {}
        for k, n, b in rows:
            a = out.setdefault(key(k), [0, 0])
            a[0], a[1] = a[0] + n, a[1] + b
        return [(k, *v) for k, v in out.items()]

    def strength(rows, key):
        rows = [r for r in rows if r[1]]
        m = {k: b / n for k, n, b in total(rows, key)}
        s = sum(n * (b / n - m[key(k)]) ** 2 for k, n, b in rows)
        v, w = (sum(f(n) * m[key(k)] * (1 - m[key(k)]) for k, n, b in rows) for f in (float, lambda n: 1.0))
        rho = min(max((s - w) / (v - w) if v > w else 0.0, 0.001), 0.5)
        return (1 - rho) / rho

    d, s = total(counts, up), total(total(counts, up), tld)
    mean, k = (sum(x[2] for x in s) + 1) / (sum(x[1] for x in s) + 2), strength(s, lambda _: 0)
    by_s = {t: (b + mean * k) / (n + k) for t, n, b in s}
    k = strength(d, tld)
    by_d = {t: (b + by_s[tld(t)] * k) / (n + k) for t, n, b in d}
    k = strength(counts, up)
    for h, n, b in counts:
        x, y = b + by_d[up(h)] * k, n - b + (1 - by_d[up(h)]) * k
        rate = x / (x + y)
        assert abs(got[h].rate - rate) < 1e-9 and abs(got[h].lower - max(0, rate - 2 * math.sqrt(rate * (1 - rate) / (x + y + 1)))) < 1e-9


EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(t):
    out = [(0, m.start(), m.end()) for m in EMAIL.finditer(t)]
    out += [(1, m.start(), m.end()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(t):
        d = re.sub("[ -]", "", m[0])
        if 16 <= len(d) <= 19 and sum(sum(divmod(int(x) * (1 + i % 2), 10)) for i, x in enumerate(d[::-1])) % 10 == 0:
            out.append((2, m.start(), m.end()))
    out += [(3, m.start(), m.end()) for m in PHONE.finditer(t) if 8 <= len(re.findall("[0-9]", m[0])) <= 15]
    return sorted(out)


def test_pii_base():
    rng = random.Random(3)
    parts = ["a", "@", "@", ".", ".", "-", "+", "%", " ", "(", "2", "25", "255", "0", "999", "é", "x.co", "4111111111111111", "5500-0000-0000-0004", "\n", "00", "٣"]
    for _ in range(20_000):
        t = "".join(rng.choices(parts, k=rng.randint(0, 16)))
        assert sorted(pii.base_spans(t)) == plain_spans(t), t


def test_pii_has_no_caps():
    weights = pii.fit([])
    value = hashlib.sha256(b"x").hexdigest() * 80
    text = f"a {'long' * 30}_token = {value} z"
    assert [text[a:z] for k, a, z, _ in pii.candidates(text, []) if k == 4] == [value]
    spelled = f"{'n' * 300} [at] {'m' * 300}.example.com"
    assert [spelled[a:z] for k, a, z, _ in pii.candidates(spelled, []) if k == 0] == [spelled]
    numbers = " ".join(f"10.0.{i % 250}.7 555-123-{i % 10000:04} +1 202 555 01{i % 100:02}x" for i in range(30_000))
    began = time.process_time()
    base, spans = pii.all_spans(numbers, weights)
    assert len(base) >= 60_000 and time.process_time() - began < 30


def test_account_numbers():
    text = "IBAN DE89 3704 0044 0532 0130 00 AND GB82WEST12345698765432, not DE89 3704 0044 0532 0130 01; ssn 123-45-6789 000-12-3456"
    found = [text[a:z] for k, a, z, _ in pii.candidates(text, []) if k == 5]
    assert found == ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "123-45-6789"]


def test_pii(spark):
    rows = [(i, f'mail bob{i}@mail.example.com or +1 (555) 010-{1000 + i}, server 10.0.0.{i % 256} token = "{hashlib.sha1(str(i).encode()).hexdigest()}" end') for i in range(10, 70)]
    rows += [(100 + i, f"plain words {i} and key = some-long-plain-name here") for i in range(60)] + AWKWARD
    df = docs(spark, rows)
    w = pii.learn(df)
    out = {r.doc_id: r for r in pii.find(df, w).collect()}
    for d, t in rows[:60]:
        base = plain_spans(t)
        said = ",".join(f"{pii.KINDS[k]}:{a}:{z}" for k, a, z in base)
        assert out[d].base_sha256 == hashlib.sha256(said.encode()).hexdigest() and out[d].spans.startswith(said) and "secret:" in out[d].spans
        assert (out[d].n_email, out[d].n_ip, out[d].n_phone) == (1, 1, 1)
    assert all(out[100 + i].spans == "" for i in range(60)) and out[1].spans == ""
    clean = {r.doc_id: r.text for r in pii.redact(df, w).collect()}
    assert clean[17] == 'mail [EMAIL] or [PHONE], server [IP] token = "[SECRET]" end' and clean[101] == dict(rows)[101]
    assert pii.redact(df, w).columns == df.columns and pii.find(df.where("false")).count() == 0


def test_pii_long_secrets(spark):
    value = lambda i, n: "".join(hashlib.sha256(f"{i} {k}".encode()).hexdigest() for k in range(n // 64 + 1))[:n]
    sizes = [40, 200, 201, 900, 5000]
    rows = [(i, f"text before token = {value(i, sizes[i % 5])} and after") for i in range(10, 70)] + [(100 + i, f"plain words {i} and key = some-long-plain-name here") for i in range(60)]
    df = docs(spark, rows)
    w = pii.learn(df)
    spans = {r.doc_id: r.spans for r in pii.find(df, w).collect()}
    assert all(spans[i].endswith(f"secret:20:{20 + sizes[i % 5]}") for i in range(10, 70)) and not any(spans[100 + i] for i in range(60))
    assert {r.text for r in pii.redact(df.where("doc_id < 100"), w).collect()} == {"text before token = [SECRET] and after"}


def test_licences(spark):
    mit = "MIT LICENSE\n\nCopyright (c) 2020 Someone\n\n" + licences.MIT.replace("sublicense", "sub-license").replace('"Software"', "“Software”").upper()
    rows = [(10, mit), (11, mit + " x"), (12, "text\nreleased under the MIT licence.\nmore"), *AWKWARD]
    out = {r.doc_id: r for r in licences.scan(docs(spark, rows)).collect()}
    assert (out[10].license_id, out[11].license_id, out[12].notice_id) == ("MIT", None, "MIT")
    assert all(out[d].license_id is None for d in (1, 2, 3, 5))


def test_licences_wrapped(spark):
    """Every known text, wrapped at any width, under any copyright line."""
    held = ["Copyright (c) 2020 Someone", "Copyright 2019-2021 A. Body", "(c) 2021 Some Body", "© Anyone", "Copyright Some Body Inc.", "# Copyright The Thing Authors", ""]
    rows, want = [], []
    for name, text in [("MIT", licences.MIT), ("ISC", licences.ISC), *((n, t) for n, t in licences.filed() if len(t) < 12_000)]:
        paragraphs = re.split(r"\n\s*\n", text)
        for width in (0, *range(20, 101, 4)):
            wrap = lambda p: p if width == 0 or re.search(r"(?i)copyright (\(c\)|\[)", p) else textwrap.fill(" ".join(p.split()), width, break_long_words=False, break_on_hyphens=False)  # noqa: B023, E731
            rows.append((1000 + len(rows), held[len(rows) % len(held)] + "\n\n" + "\n\n".join(map(wrap, paragraphs))))
            want.append(name)
    got = {r.doc_id: r.license_id for r in licences.scan(docs(spark, rows)).collect()}
    wrong = [(w, t) for (d, t), w in zip(rows, want, strict=True) if got[d] != w]
    assert not wrong, (len(wrong), wrong[0])
    assert {"Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-3.0", "MPL-2.0", "Unlicense"} <= {n for n, _ in licences.filed()}


def test_decontamination(spark):
    rng = random.Random(5)
    say = lambda n: " ".join(rng.choice(["tree", "river", "stone", "walks", "under", "quickly", "seven", "bird", "above", "green", "light", "old"]) for _ in range(n))
    item = "A train leaves Paris with 120 tons of coal and reaches Lyon after 35 hours when 120 tons of coal are gone by then"
    other = item.replace("120", "77").replace("35", "9").replace("Paris", "Berlin")
    broken = item.replace("120 tons", "77 tons", 1).replace("35", "9")
    bench = spark.createDataFrame([(1, item), (2, "short question text here"), (3, None), (1, item)], "item_id long, text string")
    rows = [(20, f"{say(30)} {item} {say(9)}"), (21, f"{say(5)}\n{other}\n{say(5)}"), (22, say(60)), (23, f"{say(8)} {broken} {say(8)}"), (24, "x short question text here y"), *AWKWARD]
    df = docs(spark, rows)
    found = {(r.doc_id, r.item_id) for r in decontam.contaminated(df, bench).collect()}
    assert found == {(20, 1), (21, 1), (24, 2)}
    left = decontam.clean(df, bench)
    assert left.columns == df.columns and left.count() == len(rows) - 3
    assert decontam.contaminated(df, bench.where("false")).count() == 0 and decontam.contaminated(df.where("false"), bench).count() == 0


def test_decontamination_with_one_conflict(spark):
    plain = "the old bridge over the quiet river was built by workers who came from the villages around it and stayed until the last stone was laid"
    item = f"about 120 tons {plain} with 120 tons of iron"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(20, "before it " + item.replace("120", "77", 1) + " after it"), (21, "before it " + item.replace("120", "77") + " after it")]
    found = {r.doc_id: (r.n_matched, r.n_windows) for r in decontam.contaminated(docs(spark, rows), bench).collect()}
    n = len(words(item)) - decontam.WINDOW + 1
    held = sum("120" in words(item)[i : i + decontam.WINDOW] for i in range(n))
    assert found == {20: (n - held, n), 21: (n, n)}


def test_decontamination_of_placeholders(spark):
    sums, table = "What is 48 + 17 * 3 - 9 ?", "Rome 12 km Oslo 30 km Bern 7 km Kiev 9 km Riga 15 km"
    bench = spark.createDataFrame([(1, sums), (2, table), (3, "plain words of a question that has no number in it")], "item_id long, text string")
    rows = [(20, f"some words first. {sums} and more"), (21, f"Here it says {table} and so on"), (22, "some words. What is 48 + 18 * 3 - 9 ?"), (23, "the Rome 1 km Oslo 2 km Bern 3 km Kiev 4 km Riga 5 km"), *AWKWARD]
    found = {(r.doc_id, r.item_id, r.n_matched, r.n_windows) for r in decontam.contaminated(docs(spark, rows), bench).collect()}
    assert found == {(20, 1, 1, 1), (21, 2, 8, 8)}


def test_classifier(spark):
    rng = random.Random(6)
    good = lambda: " ".join(rng.choice(["calm", "field", "house", "bread", "music"]) + str(rng.randint(0, 30)) for _ in range(60))
    bad = lambda: " ".join(rng.choice(["CALM!!", "buy%%%", "idiot", "house3"]) for _ in range(60))
    rows = [(i, bad() if i % 4 == 0 else good()) for i in range(10, 810)]
    df = docs(spark, rows + AWKWARD)
    labels = spark.createDataFrame([(i, i % 4 != 0) for i in range(10, 410)], "doc_id long, good boolean")
    out = {r.doc_id: r for r in cotrain.score(df, labels, labelled=300).collect()}
    held = [out[i].keep == (i % 4 != 0) for i in range(410, 810)]
    assert np.mean(held) > 0.97 and len(cotrain.score(df, labels).collect()) == len(rows) + len(AWKWARD)
    none = cotrain.score(df, labels.where("false")).collect()
    assert {r.score for r in none} == {0.5} and all(r.keep for r in none)


def plain_template(text):
    """(template word, value) of each word, as the module's docstring says."""
    ws, out = re.split(r"[\x20\x09-\x0D]+", text or ""), []
    core = lambda w: "".join(c for c in w if c not in decontam.PUNCTUATION)
    for i, w in enumerate(ws):
        c, before = core(w), ws[i - 1] if i else ""
        if not c:
            continue
        low = c.lower()
        if "0" <= c[0] <= "9":
            out.append(("<n>", low))
        elif low in decontam.UNITS and "0" <= core(before)[:1] <= "9":
            out.append(("<u>", low))
        elif c[0] != c[0].lower() and c[1:2] == c[1:2].lower() and i and before[-1:] not in (".", "!", "?", ":", '"'):
            out.append(("<p>", low))
        else:
            out.append((low, ""))
    return out


def plain_windows(text, size):
    """(position, ordinary, key, values) of the windows of a text; those of mostly placeholders have all their words as key."""
    w = plain_template(text)
    for i in range(len(w) - size + 1):
        part = w[i : i + size]
        ordinary = 2 * sum(v == "" for _, v in part) >= size
        yield i, ordinary, tuple(t for t, _ in part) if ordinary else tuple(v or t for t, v in part), [v for _, v in part], part


def test_decontamination_against_brute_force(spark):
    rng = random.Random(14)
    vocabulary = ["the", "of", "train", "leaves", "at", "with", "how", "many", "is", "a", "Paris", "Anna", "Bob", "12", "7", "3.5", "km", "hours", "costs", "buys", "apples", "and", "then", "each"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, say(rng.choice([3, 8, 12, 20, 30]))) for i in range(30)] + [(90, None), (91, "12 + 7 = 3"), (92, "")]
    swap = {"Anna": "Carla", "12": "45", "km": "miles"}
    rows = []
    for i in range(150):
        w = (rng.choice(items)[1] or "").split(" ")
        if i % 3 == 1:  # other values, the same for each mention
            w = [swap.get(x, x) for x in w]
        if i % 3 == 2:  # some words are others
            w = [rng.choice(vocabulary) if rng.random() < 0.08 else x for x in w]
        rows.append((i, f"{say(rng.randint(0, 10))} {' '.join(w)} {say(rng.randint(0, 10))}"))
    rows += [(500 + i, say(40)) for i in range(30)] + AWKWARD[:4]
    want = set()
    for d, text in rows:
        for item, said in items:
            total = len(plain_template(said))
            size = min(8, total)
            if not size:
                continue
            mine = list(plain_windows(said, size))
            n_plain = len({i for i, ordinary, *_ in mine if ordinary})
            lines = {}
            theirs = list(plain_windows(text, size))
            exactly = {i: tuple(v or t for t, v in part) for i, _, _, _, part in theirs}
            for i, ordinary, key, values, _ in mine:
                for j, other, theirs_key, theirs_values, _ in theirs:
                    if (ordinary and other and key == theirs_key) or (not ordinary and key == exactly[j]):
                        lines.setdefault(j - i, []).append((i, ordinary, values, theirs_values))
            matched, plain = set(), set()
            for hits in lines.values():
                maps = {}
                for _, ordinary, values, theirs_values in hits:
                    for a, b in zip(values, theirs_values, strict=True):
                        if ordinary and a:
                            maps.setdefault(a, set()).add(b)
                clash = {a for a, bs in maps.items() if len(bs) > 1}
                for i, ordinary, values, _ in hits:
                    if not ordinary or not clash & set(values):
                        matched.add(i)
                        plain |= {i} if ordinary else set()
            if matched and (len(matched) >= 0.5 * len(mine) or (n_plain and len(plain) >= 0.5 * n_plain) or len(matched) >= 13):
                want.add((d, item, len(matched)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.n_matched) for r in decontam.contaminated(docs(spark, rows), bench).collect()}
    assert got == want and len({d for d, *_ in want}) > 90
