"""Jaccard join, components and passages against brute force."""

import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanloom.llm import jaccard_join, passages
from spanloom.llm.components import components
from spanloom.llm.jaccard_join import classes_of, groups_of, shingle_components
from spanloom.llm.rtree import CountTree, needed
from spanloom.llm.words import hash_values, shingle_sets, split_words, word_hashes
from tests.llm.util import AWKWARD, docs, low, words


def shingles(text, k):
    w = words(low(text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def groups(sets, num, den):
    posts, both, up = defaultdict(list), Counter(), list(range(len(sets)))
    for i, s in enumerate(sets):
        for x in s:
            posts[x].append(i)
    for p in posts.values():
        both.update(itertools.combinations(p, 2))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for (a, b), n in both.items():
        if den * n >= num * (len(sets[a]) + len(sets[b]) - n):
            up[find(b)] = find(a)
    out = defaultdict(list)
    for i in range(len(sets)):
        out[find(i)].append(i)
    return list(out.values())


def corpus(seed, n):
    rng = random.Random(seed)
    base = [[f"w{rng.randint(0, 300)}" for _ in range(rng.choice([5, 9, 20, 60, 150]))] for _ in range(25)]
    out = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            j = rng.randrange(len(w))
            w[j : j + rng.choice([0, 1])] = [f"w{rng.randint(0, 300)}"]
        out.append((100 + i, " ".join(w)))
    return out


@pytest.mark.parametrize("tile", [4000, 6])
def test_jaccard_join(spark, tile):
    rows = [*corpus(tile, 300), *AWKWARD]
    sets = [shingles(t, 4) for _, t in rows]
    want = []
    for g in groups(sets, 85, 100):
        first = min((rows[i][0] for i in g if rows[i][0] is not None), default=None)
        want += [(rows[i][0], len(sets[i]), first) for i in g]
    got = shingle_components(docs(spark, rows), 4, 85, 100, tile).select("doc_id", "n", "component_id").collect()
    key = lambda r: tuple((v is not None, v or 0) for v in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_groups_leave_room():
    for num, den in ((85, 100), (8, 10)):
        for n in [*range(1, 400), 1000, 12345]:
            for m in {n, n + 1, n * den // num}:
                if n * den >= num * m:
                    cls = classes_of(n, num, den)[-1]
                    count, spare = groups_of(cls, num, den)
                    assert cls in classes_of(m, num, den)
                    assert count - spare > n + m - 2 * needed(np.array([n + m]), num, den)[0]


def test_rtree_bound():
    rng = np.random.default_rng(1)
    base = rng.poisson(3, (30, 20))
    pts = np.maximum(0, base[rng.integers(30, size=700)] + rng.integers(-1, 2, (700, 20))).astype(np.uint16)
    n = pts.sum(1, dtype=np.int64)
    got = {tuple(sorted((int(i), int(j)))): int(b) for a, z, w in CountTree(pts, n).pairs(85, 100) for i, j, b in zip(a, z, w)}
    for i in range(0, 700, 7):
        bound = np.minimum(pts[i], pts).sum(1, dtype=np.int64)
        for j in np.flatnonzero(bound >= needed(n[i] + n, 85, 100)):
            if j != i:
                assert got[tuple(sorted((i, int(j))))] == bound[j]


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(40)]
    up = {}
    find = lambda x: x if up.setdefault(x, x) == x else find(up[x])
    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            up[b] = a
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in {v for e in edges if e[0] != e[1] for v in e}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_a_long_chain(spark):
    count = {}
    chain = spark.range(5000).selectExpr("id as a", "id + 1 as b")
    got = components(chain, counter=count).agg({"component": "max", "node": "count"}).head()
    assert (got["max(component)"], got["count(node)"]) == (0, 5001)
    assert count["rounds"] <= 2 and count["jumps"] <= 16


def test_many_rows_without_an_id(spark):
    rng = random.Random(5)
    rows = [(None, " ".join(f"n{rng.randint(0, 10**6)}" for _ in range(12))) for _ in range(1000)]
    rows += [(None, t + " tail") for _, t in rows[:500]]  # linked with the first half: 9 of 10 shingles
    rows += [(7, t) for _, t in rows[1000:1500]] + [(8, "one of its own and no other has it")]
    got = shingle_components(docs(spark, rows), 4, 85, 100)
    out = [(r.doc_id, r.component_id) for r in got.collect()]
    assert len(out) == len(rows)
    assert Counter(out) == {(None, 7): 1000, (None, None): 500, (7, 7): 500, (8, 8): 1}


def test_empty_table(spark):
    none = docs(spark, AWKWARD).where("false")
    assert shingle_components(none, 4, 85, 100).count() == 0
    assert passages.repeated(none).count() == 0


def test_passages(spark):
    rng = random.Random(4)
    say = lambda n: " ".join(f"w{rng.randint(0, 5000)}" for _ in range(n))
    shared = [say(60) for _ in range(8)]
    rows = []
    for i in range(120):
        lines = [say(rng.randint(3, 40)) for _ in range(4)]
        p = rng.choice(shared).split()
        if rng.random() < 0.5:
            p[rng.randrange(60)] = "changed"
        lines.insert(rng.randrange(5), " ".join(p))
        rows.append((i, "\n".join(lines)))
    rows += [(900, None), (901, ""), (902, shared[0] + "\n" + shared[0]), (902, shared[1])]
    spans = [(d, n, p) for d, t in rows for n, p in enumerate((t or "").split("\n")) if len(words(p)) >= 10]
    want = set()
    for g in groups([shingles(p, 5) for *_, p in spans], 8, 10):
        if len(g) > 1:
            first = min(spans[i][:2] for i in g)
            want |= {(*spans[i][:2], first[0], len(g), spans[i][:2] == first) for i in g}
    df = docs(spark, rows)
    got = passages.repeated(df).collect()
    assert {(r.doc_id, r.line, r.component_id, r.occurrences, r.keep) for r in got} == want
    texts = dict(rows[:-1])
    assert all(texts[r.doc_id][r.start : r.start + r.length] == texts[r.doc_id].split("\n")[r.line] for r in got if r.doc_id < 900)
    left = passages.removed(df).where("doc_id < 900")
    assert left.columns == df.columns and sum(len(words(r.text)) for r in left.collect()) < sum(len(words(t)) for d, t in rows if d < 900)


def test_passages_inside_lines(spark):
    rng = random.Random(9)
    say = lambda n: [f"v{rng.randint(0, 50_000)}é" for _ in range(n)]
    rows, at = [], {}
    for p in range(6):
        shared = say(51)
        for j in range(4):
            w = say(rng.randint(20, 90)) + shared + say(rng.randint(20, 90))
            first = w.index(shared[0])
            # one line, lines of under ten words, and lines of any length
            every = [10**9, 7, rng.randint(3, 60)][j % 3]
            text = "".join(x + ("\n" if (k + 1) % every == 0 else "  " if k % 9 == 0 else " ") for k, x in enumerate(w))
            at[10 * p + j] = (len(words(text[: text.index(shared[0])])), first, text)
            rows.append((10 * p + j, text))
    rows += [(500 + i, " ".join(say(150))) for i in range(20)]
    df = docs(spark, rows + AWKWARD)
    got = [r for r in passages.repeated(df).collect() if r.doc_id is not None and r.doc_id >= 0 and r.doc_id not in (5,)]
    assert {r.doc_id for r in got} == set(at)
    for r in got:
        _, first, text = at[r.doc_id]
        assert r.component_id // 10 == r.doc_id // 10 and r.keep == (r.doc_id == r.component_id)
        piece, ahead = text[r.start : r.start + r.length], text[: r.start]
        assert len(words(piece)) == passages.PIECE and first <= len(words(ahead)) and len(words(ahead + piece)) <= first + 51
        assert r.line == ahead.count("\n")
    assert {r.doc_id for r in got if r.occurrences == 4 and r.component_id % 10 == 0} == set(at)
    left = {r.doc_id: r.text for r in passages.removed(df.where("doc_id >= 10 or doc_id = 0")).collect()}
    texts = dict(rows)
    assert all(left[d] == texts[d] if d % 10 == 0 or d >= 500 else len(words(left[d])) <= len(words(texts[d])) - passages.PIECE for d in left)


def test_passages_against_all_runs(spark):
    rng = random.Random(12)
    say = lambda n: [f"p{rng.randint(0, 10**6)}" for _ in range(n)]
    rows, runs = [], [say(n) for n in (40, 49, 50, 51, 52, 70, 130)]
    for i in range(60):
        w = say(rng.randint(0, 60)) + runs[i % 7] + say(rng.randint(0, 60))
        rows.append((i, "".join(x + rng.choice([" ", " ", " ", " ", "\n"]) for x in w)))
    twice = say(80)
    rows += [(100, " ".join(twice + say(5) + twice)), (101, rows[0][1]), (102, rows[3][1]), (103, " ".join(say(50))), (104, None)]
    rows += [(105, rows[-2][1]), (200, " ".join(say(60))), (200, " ".join(say(70)))]
    every = defaultdict(set)
    for d, t in rows:
        w = words(low(t or ""))
        for i in range(len(w) - 50):
            every[tuple(w[i : i + 51])].add(d)
    want = {d for ds in every.values() if len(ds) > 1 for d in ds}
    got = {r.doc_id for r in passages.repeated(docs(spark, rows), least=51).collect()}
    assert got == want and {i for i in range(60) if i % 7 >= 3} <= want and not want & {100, 103, 105, 200}


def test_removed_keeps_other_columns(spark):
    rng = random.Random(13)
    say = lambda n: " ".join(f"c{rng.randint(0, 10**6)}" for _ in range(n))
    shared = say(60)
    df = docs(spark, [(1, shared), (2, f"{say(9)}\n{shared}"), (None, shared), (3, say(20))])
    df = df.selectExpr("*", "1 as doc", "2 as key", "3 as lines", "4 as cuts", "5 as _lines", "6 as _doc")
    left = passages.removed(df)
    assert left.columns == df.columns
    texts = {r.doc_id: r.text for r in left.collect()}
    assert texts[None] == shared and texts[1] == "" and len(words(texts[2])) == 9 and len(words(texts[3])) == 20


def test_pieces_meet_in_every_run():
    rng = random.Random(10)
    for _ in range(300):
        run = [f"r{rng.randint(0, 9)}" for _ in range(rng.randint(50, 120))]
        texts = [" ".join([f"a{i}" for i in range(rng.randint(0, 60))] + run + [f"b{i}{s}" for i in range(rng.randint(0, 60))]) for s in "xy"]
        offsets, flat = split_words(pa.array(texts))
        took, h = passages.pieces(offsets, hash_values(flat))
        mine = [set(h[(took >= a) & (took < z)].tolist()) for a, z in zip(offsets[:-1], offsets[1:], strict=True)]
        assert mine[0] & mine[1]


def test_keys_are_dealt_in_chunks(spark):
    rng = np.random.default_rng(3)
    key, cg, sid = rng.integers(0, 1 << 63, 5000, np.int64).view(np.uint64) * np.uint64(2), rng.integers(0, 1 << 40, 5000), np.repeat(rng.integers(-(1 << 62), 1 << 62, 50), 100)
    buckets = jaccard_join.buckets_of(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sorted(r.p for r in spark.createDataFrame([(int(b),) for b in buckets], "b long").select(F.pmod(F.hash("b"), F.lit(n)).alias("p")).collect()) == list(range(n))
    dealt = jaccard_join.dealt_chunks(key, cg, sid, buckets)
    back = [list(zip(*(c.to_pylist() for c in b.columns), strict=True)) for b in jaccard_join._undealt([dealt.select(["chunk"])])]
    assert sorted(sum(back, [])) == sorted(zip(key.view(np.int64).tolist(), cg.tolist(), sid.tolist(), strict=True)) and len(back) == n
    where = [{int(k) & (1 << 64) - 1 for k, _, _ in b} for b in back]
    assert not any(a & b for i, a in enumerate(where) for b in where[:i])
    assert sum(len(c) for c in dealt.column(1).to_pylist()) < 18 * 5000  # rows of three numbers take 24 bytes each and more


@pytest.mark.parametrize(("num", "den"), [(85, 100), (8, 10), (1, 2)])
def test_sets_are_dealt_to_their_first_groups_only(num, den):
    rng = random.Random(num)
    texts = [" ".join(f"w{rng.randint(0, 10**6)}" for _ in range(n)) for n in (3, 9, 24, 25, 60, 150, 400, 2000) for _ in range(3)]
    for _ in range(150):
        w = rng.choice(texts).split()
        for _ in range(rng.randint(1, 6)):
            j = rng.randrange(len(w))
            w[j : j + rng.choice([0, 1, 9])] = [f"w{rng.randint(0, 300)}"] * rng.randint(0, 2)
            w = w or ["w"]
        texts.append(" ".join(w))
    offsets, h = shingle_sets(pa.array(texts), 4)
    sets = [h[a:z] for a, z in zip(offsets[:-1], offsets[1:], strict=True)]
    dealt, linked = [], 0
    for t, s in zip(texts, sets, strict=True):
        rows = list(jaccard_join._set_keys(4, num, den)(iter([pa.RecordBatch.from_arrays([pa.array([t])], names=["text"])])))
        own = [dict(zip(key.tolist(), cg.tolist(), strict=True)) for key, cg, _ in rows]
        dealt.append(own[0] if own else {})
        # of any partner, so many shingles can differ
        most = (den - num) * (len(s) + den * len(s) // num) // (den + num)
        assert max(Counter(cg >> jaccard_join.CLASS for cg in dealt[-1].values()).values(), default=0) <= most + 1
    for a, b in itertools.combinations(range(len(sets)), 2):
        x, y = sets[a], sets[b]
        both = len(np.intersect1d(x, y))
        if both == max(len(x), len(y)) or den * both < num * (len(x) + len(y) - both):
            continue
        linked += 1
        cls = int(jaccard_join.class_of(np.array([min(len(x), len(y))]))[0])
        (cx, hx), (cy, hy) = (jaccard_join.sketch(s, cls, num, den) for s in (x, y))
        equal = np.flatnonzero((cx == cy) & (hx == hy))
        first = min(jaccard_join.ranks(cx[equal], equal).tolist())
        common = [cg & (1 << jaccard_join.CLASS) - 1 for key, cg in dealt[a].items() if key in dealt[b] and cg >> jaccard_join.CLASS == cls]
        assert min(common) == first
    assert linked > 100


def test_word_hashes():
    rng = random.Random(1)
    w = list({"".join(rng.choices("ab\x00zé中", k=rng.choice([0, 1, 2, 3, 5, 7, 8, 9, 15, 16, 17, 30, 255, 256, 257, 300, 1000]))) for _ in range(20000)})
    h = word_hashes(pa.array(w))
    assert len(set(h.tolist())) == len(w)
    # whatever stands beside a word
    assert (word_hashes(pa.array(["x"] * 7 + w).slice(7)) == h).all()
    assert all(word_hashes(pa.array([w[i]], t))[0] == h[i] for i in range(300) for t in (pa.string(), pa.large_string()))
    some = rng.sample(range(len(w)), 500)
    assert (word_hashes(pa.array([w[i] for i in some])) == h[some]).all()
    assert len(word_hashes(pa.array([], pa.string()))) == 0
