"""Random small tables against direct definitions, with plain and chunked running windows."""

import random

import pytest

import spanloom as S
from tests.helpers import gen, ivl, rows


def table(rng, n, top=120):
    out = []
    for _ in range(n):
        s = rng.randrange(top)
        out.append((rng.choice("ab"), s, s + rng.choice([1, 2, 5, 9, 30])))
    return out


def covered(t, chrom):
    return {p for k, s, e in t if k == chrom for p in range(s, e)}


@pytest.mark.parametrize("seed", range(3))
def test_set_verbs(spark, seed):
    rng = random.Random(seed)
    xs, ys = table(rng, 25), table(rng, 20)
    x, y = ivl(spark, xs), ivl(spark, ys)
    for m in (0, 1, 4):
        want = sorted((k, s, e, a, b) for k, s, e in xs for j, a, b in ys if j == k and min(e, b) - max(s, a) >= m)
        assert rows(S.bed_intersect(x, y, min_overlap=m, bin_size=8), "chrom", "start.x", "end.x", "start.y", "end.y") == want
    zero = ivl(spark, [*ys, *((k, p, p) for k in "ab" for p in range(0, 120, 9))])  # empty intervals cover nothing
    assert rows(S.bed_subtract(x, zero)) == rows(S.bed_subtract(x, y))
    left = rows(S.bed_subtract(x, y))
    whole = {r[:3] for r in rows(S.bed_subtract(ivl(spark, sorted(set(xs))), y)) if r[:3] in set(xs)}
    assert whole == {(k, s, e) for k, s, e in xs if not covered(ys, k) & set(range(s, e))}
    per = sorted((k, p) for k, s, e in xs for p in range(s, e) if p not in covered(ys, k))
    assert sorted((k, p) for k, s, e in left for p in range(s, e)) == per
    cov = rows(S.bed_coverage(x, y), "chrom", "start", "end", ".ints", ".cov")
    assert cov == sorted((k, s, e, sum(j == k and a < e and s < b for j, a, b in ys), len(covered(ys, k) & set(range(s, e)))) for k, s, e in xs)


@pytest.mark.parametrize("width", [0, 7])
def test_sweeps(spark, width):
    rng = random.Random(width)
    xs = table(rng, 60, 400)
    x, g = ivl(spark, xs), gen(spark, a=600, b=600, c=9)
    merged = rows(S.bed_merge(x, width=width), "chrom", "start", "end")
    assert {(k, p) for k, s, e in merged for p in range(s, e)} == {(k, p) for k in "ab" for p in covered(xs, k)}
    assert all(a[0] != b[0] or a[2] < b[1] for a, b in zip(merged, merged[1:]))
    gaps = rows(S.bed_complement(x, g, width=width))
    assert sum(e - s for _, s, e in gaps) + sum(e - s for _, s, e in merged) == 1209
    for zero in (False, True):
        depth = rows(S.bed_genomecov(x, g, zero_depth=zero, width=width), "chrom", "start", "end", ".depth")
        assert all(d == sum(k == c and a <= s and e <= b for c, a, b in xs) for k, s, e, d in depth)
        assert sum(e - s for _, s, e, _ in depth) == (1209 if zero else sum(e - s for _, s, e in merged))
    ids = rows(S.bed_cluster(x, 2, width=width), "chrom", "start", "end", ".id")
    n, reach, last = 0, None, None
    for k, s, e, i in ids:
        if k != last or reach + 2 < s:
            n, reach = n + 1, e
        last, reach = k, max(reach, e)
        assert i == n
    spaced = rows(S.interval_spacing(ivl(spark, sorted(set(xs))), width=width), "chrom", "start", "end", ".spacing")
    assert [r[3] for r in spaced] == [None if i == 0 or spaced[i - 1][0] != r[0] else r[1] - spaced[i - 1][2] for i, r in enumerate(spaced)]


@pytest.mark.parametrize("width", [0, 11])
def test_nearest(spark, width, monkeypatch):
    import spanloom.operators.joins as J
    from spanloom.plans import nearest

    monkeypatch.setattr(J, "around", lambda x, y, keys: nearest.around(x, y, keys, width))
    rng = random.Random(5 + width)
    xs, ys = sorted(set(table(rng, 30, 300))), table(rng, 12, 300)
    want = []
    for k, s, e in xs:
        mine = [(a, b) for j, a, b in ys if j == k]
        if not mine:
            want.append((k, s, e, None, None, None))
        gaps = [(s - b, a, b, -1) for a, b in mine if b <= s] + [(a - e, a, b, 1) for a, b in mine if a >= e]
        best = min((g[0] for g in gaps), default=0)
        want += [(k, s, e, a, b, (gap + 1) * sign) for gap, a, b, sign in gaps if gap == best and gap > 0]
        want += [(k, s, e, a, b, 0 if min(e, b) > max(s, a) else -1 if b <= s else 1) for a, b in mine if min(e, b) - max(s, a) >= 0]
    key = lambda t: tuple((v is not None, v) for v in t)
    got = rows(S.bed_closest(ivl(spark, xs), ivl(spark, ys)), "chrom", "start.x", "end.x", "start.y", "end.y", ".dist")
    assert got == sorted(want, key=key)
    mid = lambda t: (t[1] + t[2]) // 2
    dist = rows(S.bed_absdist(ivl(spark, xs), ivl(spark, ys), gen(spark, a=600, b=600), width=width), "chrom", "start", "end", ".absdist")
    assert dist == sorted(((*x, min((abs(mid(x) - mid(y)) for y in ys if y[0] == x[0]), default=None)) for x in xs), key=key)


@pytest.mark.parametrize("seed", range(2))
def test_nearest_without_overlap(spark, seed, monkeypatch):
    import spanloom.operators.joins as J

    made = []
    monkeypatch.setattr(J, "overlap_pairs", lambda *a, f=J.overlap_pairs: made.append(f(*a)) or made[-1])
    rng = random.Random(seed)
    empty = [(k, p, p) for k in "ab" for p in range(0, 60, 7)]
    for more in ([], empty):  # with empty rows, which meet others without covering them
        xs, ys = sorted({*table(rng, 40, 60), *more}), [*table(rng, 40, 60), *more]
        want = []
        for k, s, e in xs:
            mine = [(a, b) for j, a, b in ys if j == k]
            best = min((max(s - b, a - e) for a, b in mine if b <= s or a >= e), default=0)
            for a, b in mine:
                if min(e, b) == max(s, a):
                    want.append((k, s, e, a, b, -1 if b <= s else 1))
                elif best > 0 and max(s - b, a - e) == best:
                    want.append((k, s, e, a, b, (best + 1) * (-1 if b <= s else 1)))
        made.clear()
        out = S.bed_closest(ivl(spark, xs), ivl(spark, ys), overlap=False)
        assert rows(out, "chrom", "start.x", "end.x", "start.y", "end.y", ".dist") == sorted(want)
        pairs = [p for df in made for p in rows(df, "start.x", "end.x", "start.y", "end.y")]
        assert all(s == e or a == b for s, e, a, b in pairs)  # overlapping rows aren't paired


def test_nearest_reads_no_frame_to_the_end(spark):
    """Such a frame takes the square of a chromosome's rows."""
    from spanloom.plans.nearest import around

    x = ivl(spark, [("a", 1, 2)])
    plan = around(x, x, ["chrom"], 0)._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition" in plan and "unboundedfollowing" not in plan
