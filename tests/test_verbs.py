"""Literal cases of every verb."""

import pytest
from pyspark.sql import functions as F

import spanloom as S
from spanloom.operators.stats import binomial_cdf, fisher_exact
from tests.helpers import gen, ivl, rows

C = "chr1"


def test_intersect_zero_and_invert(spark):
    x = ivl(spark, [(C, 100, 200), (C, 150, 250), (C, 400, 500)])
    y = ivl(spark, [(C, 175, 200), (C, 175, 225)])
    assert S.bed_intersect(x, y, min_overlap=0).count() == 4
    assert rows(S.bed_intersect(x, y, invert=True)) == [(C, 400, 500)]


def test_intersect_duplicates_and_zero_length(spark):
    x, y = ivl(spark, [(C, 100, 200)] * 5), ivl(spark, [(C, 175, 200)])
    assert S.bed_intersect(x, y).count() == S.bed_intersect(y, x).count() == 5
    x = ivl(spark, [("chr7", 33059403, 33059403)])
    y = ivl(spark, [("chr7", 32599076, 33069221), ("chr7", 33059336, 33060883)])
    assert S.bed_intersect(x, y, min_overlap=0).count() == 2
    assert S.bed_intersect(x, y).count() == 0


def test_intersect_sources_groups_and_errors(spark):
    x = ivl(spark, [(C, 1000, 1500, "+")], "strand string")
    y, z = ivl(spark, [(C, 1000, 1200, "-")], "strand string"), ivl(spark, [(C, 1000, 1200, "+")], "strand string")
    assert rows(S.bed_intersect(x, y, z, by=["strand"]), ".source") == [("2",)]
    assert rows(S.bed_intersect(x, a=y, b=z), ".source") == [("a",), ("b",)]
    assert rows(S.bed_intersect(x, {"p": y, "q": z}), ".source") == [("p",), ("q",)]
    assert rows(S.bed_intersect(x, [y, z]), ".source") == [("1",), ("2",)]
    with pytest.raises(ValueError, match="min_overlap"):
        S.bed_intersect(x, y, min_overlap=-1)
    with pytest.raises(ValueError, match="missing: end"):
        S.bed_intersect(x.drop("end"), y)
    with pytest.raises(ValueError, match="strand"):
        S.bed_intersect(x, y.drop("strand"), by=["strand"])


def test_null_group_keys_match(spark):
    x, y = ivl(spark, [(C, 1, 9, None)], "strand string"), ivl(spark, [(C, 5, 9, None), (C, 5, 9, "+")], "strand string")
    assert rows(S.bed_intersect(x, y, by=["strand"]), ".overlap") == [(4,)]


def test_long_intervals_use_levels(spark):
    x = ivl(spark, [(C, 0, 10**9), (C, 500, 510)] + [(C, i * 1000, i * 1000 + 10) for i in range(50)])
    y = ivl(spark, [(C, -5, 3), (C, 505, 10**8), (C, 10**9 - 1, 10**9 + 5)])
    want = sorted((a, b, c, d) for _, a, b in rows(x) for _, c, d in rows(y) if min(b, d) - max(a, c) >= 1)
    assert rows(S.bed_intersect(x, y, bin_size=16), "start.x", "end.x", "start.y", "end.y") == want


def test_window(spark):
    x = ivl(spark, [(C, 100, 200)])
    y = ivl(spark, [(C, 250, 260), (C, 40, 50), (C, 800, 900)])
    g = gen(spark, chr1=5000)
    assert rows(S.bed_window(x, y, g, both=60), "start.x", "end.x", "start.y") == [(100, 200, 40), (100, 200, 250)]
    assert S.bed_window(x, y, g, left=60).count() == 1
    assert S.bed_window(x, y, g, both=150).count() == 0  # leaves the genome
    assert S.bed_window(x, y, g, both=150, trim=True).count() == 2


def closest(spark, x, y, **kw):
    return rows(S.bed_closest(ivl(spark, x), ivl(spark, y), **kw), "start.y", "end.y", ".dist", ".overlap")


def test_closest(spark):
    assert closest(spark, [(C, 10, 20)], [(C, 9, 10), (C, 19, 20), (C, 20, 21)]) == [(9, 10, -1, 0), (19, 20, 0, 1), (20, 21, 1, 0)]
    assert closest(spark, [(C, 10, 20)], [(C, 8, 9), (C, 21, 22)]) == [(8, 9, -2, 0), (21, 22, 2, 0)]
    assert closest(spark, [(C, 10, 20)], [(C, 8, 9), (C, 9, 10), (C, 20, 21), (C, 21, 22)]) == [(9, 10, -1, 0), (20, 21, 1, 0)]
    # ties upstream share the best end, whatever their starts
    assert closest(spark, [(C, 300, 310)], [(C, 100, 200), (C, 120, 150), (C, 150, 200)]) == [(100, 200, -101, 0), (150, 200, -101, 0)]
    assert closest(spark, [(C, 10, 20)], [("chr2", 1, 2)]) == [(None, None, None, None)]


def test_closest_by_strand(spark):
    x = ivl(spark, [(C, 80, 100, "+")], "strand string")
    y = ivl(spark, [(C, 5, 15, "+"), (C, 20, 60, "-"), (C, 200, 220, "-")], "strand string")
    assert rows(S.bed_closest(x, y, by=["strand"]), "start.y", ".dist") == [(5, -66)]
    assert rows(S.bed_closest(x, S.flip_strands(y), by=["strand"]), "start.y", ".dist") == [(20, -21)]
    none = S.bed_closest(x, y.where("strand = '-'"), by=["strand"], overlap=False)
    assert rows(none, "start.y", ".dist") == [(None, None)] and ".overlap" not in none.columns


def test_coverage(spark):
    x, y = ivl(spark, [(C, 100, 200)]), ivl(spark, [(C, 200, 300)])
    assert rows(S.bed_coverage(x, y, min_overlap=0), ".ints", ".cov", ".len") == [(1, 0, 100)]
    assert rows(S.bed_coverage(x, y), ".ints", ".cov", ".len") == [(0, 0, 100)]
    y = ivl(spark, [(C, 90, 120), (C, 110, 130), (C, 150, 160), (C, 150, 160)])
    assert rows(S.bed_coverage(ivl(spark, [(C, 100, 200)] * 2), y), ".ints", ".cov", ".frac") == [(4, 40, 0.4)] * 2


def test_map(spark):
    x = ivl(spark, [(C, 100, 250), (C, 250, 500), ("chr2", 1, 2)])
    y = ivl(spark, [(C, 100, 250, 10), (C, 150, 250, 20), (C, 140, 250, 30), (C, 150, 250, 40), (C, 250, 300, 10), (C, 260, 300, 20), (C, 270, 300, 20)], "value int")
    out = S.bed_map(x, y, said=S.concat("value"), firsts=S.first("value"), lasts=S.last("value"), once=S.values("value"), uniq=S.values_unique("value"), n=F.count("*"))
    assert rows(out, "said", "firsts", "lasts", "once", "uniq", "n") == [
        (None, None, None, None, None, None), ("10,20,20", 10, 20, "10,20", "10,20", 3), ("10,30,20,40", 10, 40, "10,30,20,40", "10,30,20,40", 4)
    ]
    width = S.bed_map(x, y, w=F.max(F.col("`end.x`") - F.col("`start.x`")))
    assert rows(width, "w") == [(None,), (150,), (250,)]


def test_subtract(spark):
    x = ivl(spark, [(C, 100, 200), (C, 250, 400), (C, 500, 600), (C, 1000, 2000)])
    y = ivl(spark, [(C, 150, 175), (C, 525, 575), (C, 1100, 1200), (C, 1400, 1600)])
    want = [(100, 150), (175, 200), (250, 400), (500, 525), (575, 600), (1000, 1100), (1200, 1400), (1600, 2000)]
    assert rows(S.bed_subtract(x, y), "start", "end") == want
    assert rows(S.bed_subtract(x, y, any=True), "start", "end") == [(250, 400)]
    nested = S.bed_subtract(ivl(spark, [(C, 500, 600)]), ivl(spark, [(C, 510, 580), (C, 550, 575)]))
    assert rows(nested, "start", "end") == [(500, 510), (580, 600)]
    assert rows(S.bed_subtract(ivl(spark, [(C, 10, 20, "a")] * 2, "name string"), ivl(spark, [(C, 12, 13)])), "start", "name") == [(10, "a")] * 2 + [(13, "a")] * 2


def test_merge_and_cluster(spark):
    x = ivl(spark, [(C, 1, 10), (C, 2, 5), (C, 7, 9), (C, 10, 12), (C, 15, 20), ("chr2", 1, 5)])
    assert rows(S.bed_merge(x), "chrom", "start", "end") == [(C, 1, 12), (C, 15, 20), ("chr2", 1, 5)]
    assert rows(S.bed_merge(x, max_dist=3, n=F.count("*")), "start", "end", "n") == [(1, 5, 1), (1, 20, 5)]
    with pytest.raises(ValueError):
        S.bed_merge(x, max_dist=-1)
    a = ivl(spark, [("a", 1, 10), ("a", 20, 50), ("b", 20, 50), ("c", 100, 100)])
    for d, ids in ((0, [1, 2, 3, 4]), (10, [1, 1, 2, 3]), (9, [1, 2, 3, 4])):
        assert [r[-1] for r in rows(S.bed_cluster(a, d), "chrom", "start", ".id")] == ids
    s = ivl(spark, [(C, 1, 5, "+"), (C, 2, 6, "-"), (C, 4, 9, "+")], "strand string")
    assert rows(S.bed_cluster(s, by=["strand"]), "start", ".id") == [(1, 1), (2, 2), (4, 1)]


def test_complement(spark):
    assert rows(S.bed_complement(ivl(spark, [(C, 90, 110)]), gen(spark, chr1=100)), "start", "end") == [(0, 90)]
    assert rows(S.bed_complement(ivl(spark, [(C, 10, 100)]), gen(spark, chr1=100, chr2=100))) == [(C, 0, 10), ("chr2", 0, 100)]
    assert rows(S.bed_complement(ivl(spark, [("chr9", 10, 100)]), gen(spark, chr1=500))) == [(C, 0, 500)]


def test_genomecov(spark):
    x = ivl(spark, [(C, 20, 70), (C, 50, 100), (C, 200, 250), (C, 220, 250)])
    assert rows(S.bed_genomecov(x, gen(spark, chr1=1000)), "start", "end", ".depth") == [(20, 50, 1), (50, 70, 2), (70, 100, 1), (200, 220, 1), (220, 250, 2)]
    out = ivl(spark, [(C, s, s + 1) for s in (0, 0, 0, 1, 999, 1000)])
    assert rows(S.bed_genomecov(out, gen(spark, chr1=1000)), "start", "end", ".depth") == [(0, 1, 3), (1, 2, 1), (999, 1000, 1)]
    y = ivl(spark, [("1", 15, 20), ("1", 17, 22)])
    zero = S.bed_genomecov(y, spark.createDataFrame([("1", 100), ("2", 100), ("3", 100)], "chrom string, size long"), zero_depth=True)
    assert rows(zero) == [("1", 0, 15, 0), ("1", 15, 17, 1), ("1", 17, 20, 2), ("1", 20, 22, 1), ("1", 22, 100, 0), ("2", 0, 100, 0), ("3", 0, 100, 0)]
    both = S.bed_genomecov(ivl(spark, [(C, 1, 2, "+"), ("chr2", 3, 4, "-")], "strand string"), gen(spark, chr1=10, chr2=10), zero_depth=True, by=["strand"])
    assert rows(both.where("`.depth` = 0 and start = 0 and `end` = 10"), "chrom", "strand") == [(C, "-"), ("chr2", "+")]


def test_partition(spark):
    x = ivl(spark, [(C, 0, 10, 1), (C, 5, 15, 2), (C, 15, 20, 3)], "value int")
    assert rows(S.bed_partition(x), "start", "end") == [(0, 5), (5, 10), (10, 15), (15, 20)]
    assert rows(S.bed_partition(x, n=F.count("*"), top=F.max("value")), "start", "n", "top") == [(0, 1, 1), (5, 2, 2), (10, 1, 2), (15, 1, 3)]


def test_makewindows(spark):
    x = ivl(spark, [(C, 100, 200), ("chr2", 300, 350)])
    assert S.bed_makewindows(x, win_size=10).count() == 15
    step = S.bed_makewindows(x, win_size=10, step_size=5)
    assert step.count() == 30 and step.agg(F.min(F.col("end") - F.col("start"))).head()[0] == 5
    assert S.bed_makewindows(x, num_win=10).count() == 20
    assert S.bed_makewindows(x, num_win=150).count() == 0
    last = rows(S.bed_makewindows(ivl(spark, [(C, 11, 44)]), num_win=10), ".win_id", "start", "end")
    assert len(last) == 10 and last[-1] == (10, 38, 44)
    assert rows(S.bed_makewindows(ivl(spark, [(C, 0, 20)]), win_size=10, reverse=True), "start", ".win_id") == [(0, 2), (10, 1)]
    with pytest.raises(ValueError):
        S.bed_makewindows(x)


def test_slop_flank_shift_bound(spark):
    g = gen(spark, chr1=1000)
    minus = ivl(spark, [(C, 300, 320, "-")], "strand string")
    assert rows(S.bed_slop(minus, gen(spark, chr1=5000), left=-60, right=60, strand=True), "start", "end") == [(240, 260)]
    assert rows(S.bed_slop(ivl(spark, [(C, 160, 170), (C, 100, 200)]), g, both=0.1, fraction=True), "start", "end") == [(90, 210), (159, 171)]
    edge = ivl(spark, [(C, 950, 970, "-")], "strand string")
    assert rows(S.bed_slop(edge, g, left=60, right=60, strand=True, trim=True), "start", "end") == [(890, 1000)]
    assert S.bed_slop(edge, g, both=60).count() == 0
    with pytest.raises(ValueError, match="ambiguous"):
        S.bed_slop(edge, g, both=1, left=1)
    f = ivl(spark, [(C, 500, 1000, "+"), (C, 1000, 1500, "-")], "strand string")
    big = gen(spark, chr1=5000)
    assert rows(S.bed_flank(f, big, left=600), "start") == [(400,)]
    assert rows(S.bed_flank(f, big, right=3501), "end") == [(4501,)]
    two = ivl(spark, [(C, 100, 200, "+"), (C, 100, 200, "-")], "strand string")
    assert rows(S.bed_flank(two, g, both=2000, trim=True), "start", "end") == [(0, 100), (0, 100), (200, 1000), (200, 1000)]
    assert rows(S.bed_shift(two, g, size=50, by=["strand"]), "start") == [(50,), (150,)]
    assert rows(S.bed_shift(two, g, fraction=0.255), "start") == [(126,), (126,)]
    many = ivl(spark, [(C, -100, 500), (C, 100, 10**9), (C, 500, 1000)])
    assert rows(S.bound_intervals(many, g), "start", "end") == [(500, 1000)]
    assert rows(S.bound_intervals(many, g, trim=True), "start", "end") == [(0, 500), (100, 1000), (500, 1000)]


def test_sort_spacing_strands(spark):
    x = ivl(spark, [(C, 500, 1000), (C, 1000, 5000), (C, 100, 200), ("chr2", 1, 9)])
    assert [r.start for r in S.bed_sort(x).collect()] == [100, 500, 1000, 1]
    assert [r.start for r in S.bed_sort(x, reverse=True).collect()] == [1000, 500, 100, 1]
    assert [r.start for r in S.bed_sort(x, by_size=True, by_chrom=True, reverse=True).collect()] == [1000, 500, 100, 1]
    y = ivl(spark, [(C, 1, 100), (C, 95, 150), (C, 150, 175)])
    assert rows(S.interval_spacing(y), "start", ".spacing") == [(1, None), (95, -5), (150, 0)]
    s = ivl(spark, [(C, 1, 2, "+"), (C, 2, 3, "-"), (C, 3, 4, ".")], "strand string")
    assert rows(S.flip_strands(s), "start", "strand") == [(1, "-"), (2, "+"), (3, "+")]


def test_features(spark):
    g = spark.createDataFrame(
        [(C, 100, 500, "p", "0", "+", 150, 450, "0", 3, "50,100,100,", "0,100,300,"), (C, 100, 500, "m", "0", "-", 150, 450, "0", 2, "50,100", "0,300")],
        "chrom string, start long, `end` long, name string, score string, strand string, cds_start long, cds_end long, item_rgb string, exon_count int, exon_sizes string, exon_starts string",
    )
    assert rows(S.bed12_to_exons(g), "name", "start", "end", "score") == [("m", 100, 150, 2), ("m", 400, 500, 1), ("p", 100, 150, 1), ("p", 200, 300, 2), ("p", 400, 500, 3)]
    assert rows(S.create_introns(g), "name", "start", "end", "score") == [("m", 150, 400, 1), ("p", 150, 200, 1), ("p", 300, 400, 2)]
    assert rows(S.create_utrs5(g), "name", "start", "end") == [("m", 450, 500), ("p", 100, 150)]
    assert rows(S.create_utrs3(g), "name", "start", "end") == [("m", 100, 150), ("p", 450, 500)]
    assert rows(S.create_tss(g), "name", "start", "end") == [("m", 499, 500), ("p", 100, 101)]
    with pytest.raises(ValueError, match="12"):
        S.bed12_to_exons(g.drop("score"))


def test_statistics(spark):
    x, y = ivl(spark, [(C, 10, 20), (C, 30, 40)]), ivl(spark, [(C, 15, 20)])
    assert rows(S.bed_jaccard(x, y)) == [(5, 25, 0.25, 1)]
    x, y = ivl(spark, [(C, 10, 20), (C, 30, 40), (C, 51, 52)]), ivl(spark, [(C, 15, 25), (C, 51, 52)])
    assert round(S.bed_fisher(x, y, gen(spark, chr1=500)).head()["p.value"], 5) == 0.00385
    x, y = ivl(spark, [(C, 75, 125)]), ivl(spark, [(C, 50, 100), (C, 100, 150)])
    assert rows(S.bed_absdist(x, y, gen(spark, chr1=10000)), ".absdist", ".absdist_scaled") == [(25, 0.005)]
    assert rows(S.bed_absdist(ivl(spark, [("chr9", 1, 2)]), y, gen(spark, chr1=10000)), ".absdist") == [(None,)]
    assert rows(S.bed_reldist(x, y)) == [(0.5, 1, 1, 1.0)]
    assert {r[0] for r in rows(S.bed_reldist(y, y, detail=True), ".reldist")} == {0.0}
    x, y = ivl(spark, [(C, 50, 75), (C, 250, 400), (C, 500, 600)]), ivl(spark, [(C, 100, 200), (C, 200, 800)])
    p = S.bed_projection(x, y, gen(spark, chr1=1000)).head()
    exact = 1 - 0.7**3
    assert abs(p["p.value"] - (1 - exact)) < 1e-12 and p.lower_tail == "FALSE"


def test_distributions():
    from math import comb

    for n, p in ((3, 0.7), (20, 0.1), (200, 0.03)):
        for k in range(n):
            assert abs(binomial_cdf(k, n, p) - sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))) < 1e-10
    found = fisher_exact(3, 1, 1, 3)
    assert abs(found["p.value"] - 0.4857142857) < 1e-9 and abs(found["estimate"] - 6.408309) < 1e-4
    assert abs(found["conf.low"] - 0.2117329) < 1e-5 and abs(found["conf.high"] - 626.2435306) < 1e-4  # where P(X <= 3) is 0.025


def test_exact_test_of_large_tables():
    """Against sums over the whole support, and at sizes where these can't be made."""
    from math import exp, lgamma

    choose = lambda n, k: lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)
    for a, b, c, d in ((40, 60, 30, 900), (0, 50, 60, 3000), (300, 200, 250, 4000), (5, 0, 3, 9)):
        m, n, k = a + c, b + d, a + b
        logs = [choose(m, i) + choose(n, k - i) - choose(m + n, k) for i in range(max(0, k - n), min(k, m) + 1)]
        own = logs[a - max(0, k - n)]
        assert abs(fisher_exact(a, b, c, d)["p.value"] / sum(exp(v) for v in logs if v <= own + 1e-7) - 1) < 1e-6
    big = fisher_exact(50_500_000, 49_500_000, 49_500_000, 50_500_000)
    assert big["p.value"] < 1e-300 or big["p.value"] == 0
    assert abs(big["estimate"] / (50.5 / 49.5) ** 2 - 1) < 1e-3 and big["conf.low"] < big["estimate"] < big["conf.high"]
    assert 0.2 < fisher_exact(50_003_000, 49_997_000, 49_997_000, 50_003_000)["p.value"] < 0.5


def test_random_and_shuffle(spark):
    g = gen(spark, chr1=10000, chr2=5000)
    r = S.bed_random(spark, g, length=100, n=2000, seed=5)
    assert r.where("start >= 0 and `end` <= case chrom when 'chr1' then 10000 else 5000 end and `end` - start = 100").count() == 2000
    assert r.select("chrom").distinct().count() == 2 and rows(r) == rows(S.bed_random(spark, g, length=100, n=2000, seed=5))
    with pytest.raises(ValueError):
        S.bed_random(spark, g, length=5000)
    x = ivl(spark, [(C, i, i + 50, i) for i in range(300)], "name int")
    free = ivl(spark, [(C, 1000, 2000)])
    inside = S.bed_shuffle(x, g, incl=free, excl=ivl(spark, [(C, 1500, 1600)]), seed=3)
    assert inside.where("chrom = 'chr1' and start >= 1000 and `end` <= 2000 and (`end` <= 1500 or start >= 1600) and `end` - start = 50").count() == 300
    assert rows(inside, "name") == rows(x, "name")
    assert S.bed_shuffle(x, g, within=True, seed=1).where("chrom <> 'chr1'").count() == 0
    with pytest.raises(ValueError, match="no intervals"):
        S.bed_shuffle(x, g, incl=free, excl=free)


def test_shuffle_keeps_rows_that_fit_nowhere(spark):
    g = gen(spark, chr1=100, chr2=40)
    x = ivl(spark, [(C, 0, n, n) for n in (0, 10, 40, 60, 61)] + [("chr2", 0, 50, 50), ("chr3", 0, 1, 1)], "name int")
    gap = ivl(spark, [(C, 60, 65)])
    kept = {r.name: (r.chrom, r.start, r.end) for r in S.bed_shuffle(x, g, excl=gap, seed=2, keep_unplaced=True).collect()}
    assert len(kept) == 7 and kept[60] == (C, 0, 60) and kept[61] == (None, None, None) and kept[50][1] <= 10
    kept = {r.name: r.start for r in S.bed_shuffle(x, g, excl=gap, within=True, seed=2, keep_unplaced=True).collect()}
    assert [n for n in sorted(kept) if kept[n] is None] == [1, 50, 61]
    with pytest.raises(Exception, match="no place for an interval of length 61"):
        S.bed_shuffle(x.where("name = 61"), g, excl=gap, seed=2).collect()


def test_shuffle_draws_all_starts_evenly(spark):
    x = ivl(spark, [(C, 0, 3)] * 6000)
    pool = ivl(spark, [(C, 0, 4), (C, 10, 12), ("chr2", 5, 10), ("chr2", 20, 23)])
    drawn = {(r.chrom, r.start): r["count"] for r in S.bed_shuffle(x, gen(spark, chr1=100, chr2=100), incl=pool, seed=4).groupBy("chrom", "start").count().collect()}
    assert sorted(drawn) == [(C, 0), (C, 1), ("chr2", 5), ("chr2", 6), ("chr2", 7), ("chr2", 20)]
    assert all(850 < n < 1150 for n in drawn.values())


def test_schema_checks(spark):
    with pytest.raises(ValueError, match="duplicate"):
        S.check_genome(spark.createDataFrame([("a", 1), ("a", 2)], "chrom string, size long"))
    assert dict(S.check_interval(spark.createDataFrame([("a", 1.0, 2.0)], "chrom string, start double, `end` double")).dtypes)["start"] == "bigint"
    one = spark.createDataFrame([(C, 10, 5, "*")], "seqnames string, start int, width int, strand string")
    assert rows(S.gr_to_bed(one), "start", "end", "strand") == [(9, 14, ".")]


def test_glyph(spark):
    x, y = ivl(spark, [(C, 10, 20), (C, 30, 40)]), ivl(spark, [(C, 15, 35)])
    text = S.bed_glyph(S.bed_merge(x, n=F.count("*")), {"x": x}, label="n")
    assert text.splitlines()[0] == "x" and "result" in text
    assert S.bed_glyph(S.bed_intersect(x, y), svg=True).startswith("<svg")
    with pytest.raises(ValueError, match="more than"):
        S.bed_glyph(x, max_rows=1)
    with pytest.raises(ValueError, match="not found"):
        S.bed_glyph(x, label="nope")
