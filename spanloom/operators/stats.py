"""Interval statistics. Counts are distributed; tests run on a few numbers."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.islands import merged
from ..plans.nearest import side
from ..plans.overlap import overlap_pairs
from ..schema import c, check_genome, check_interval, group_keys, join_on


def _middle(x: DataFrame) -> DataFrame:
    return x.withColumn("__m", F.expr("(`start` + `end`) div 2"))


def bed_absdist(x: DataFrame, y: DataFrame, genome: DataFrame, by: Sequence[str] | None = None, width: int | None = None) -> DataFrame:
    """``x`` with the distance of its midpoint to the nearest y midpoint (``.absdist``) and that over the mean gap (``.absdist_scaled``)."""
    x, y, g = check_interval(x), _middle(check_interval(y)), check_genome(genome)
    keys = group_keys(x, by, y)
    x = _middle(x)
    probes = x.select(*map(c, keys), "__m").distinct()
    up = side(probes, y, keys, c("__m"), c("__m"), ["__m"], "__up", True, True, width)
    both = side(up, y, keys, c("__m"), c("__m"), ["__m", "__up"], "__dn", False, True, width)
    near = both.select(*map(c, keys), "__m", F.least(c("__m") - c("__up"), c("__dn") - c("__m")).alias(".absdist"))
    n = y.groupBy(*map(c, keys)).agg(F.count("*").alias("__n")).join(g.select(F.col("chrom").alias("__g"), F.col("size").alias("__size")), c("chrom") == c("__g")).drop("__g")
    near = join_on(near, n, keys, "left").withColumn(".absdist_scaled", c(".absdist") * (c("__n") / c("__size"))).drop("__n", "__size")
    return join_on(x, near, [*keys, "__m"], "left").drop("__m")


def bed_reldist(x: DataFrame, y: DataFrame, by: Sequence[str] | None = None, detail: bool = False, width: int | None = None) -> DataFrame:
    """Relative distance of x midpoints between their neighbouring y midpoints: its distribution, or with ``detail`` per x row."""
    x, y = _middle(check_interval(x)), _middle(check_interval(y))
    keys = group_keys(x, by, y)
    probes = x.select(*map(c, keys), "__m").distinct()
    up = side(probes, y, keys, c("__m"), c("__m"), ["__m"], "__up", True, False, width).where("__up is not null")
    both = side(up, y, keys, c("__m"), c("__m"), ["__m", "__up"], "__dn", False, True, width).where("__dn is not null")
    dist = F.least(c("__m") - c("__up"), c("__dn") - c("__m")).cast("float")
    # single precision: the quotient is rounded to it before anything else
    rel = (dist.cast("double") / (c("__dn") - c("__up")).cast("float").cast("double")).cast("float").cast("double")
    out = join_on(x, both.select(*map(c, keys), "__m", rel.alias(".reldist")), [*keys, "__m"]).drop("__m")
    if detail:
        return out
    counted = out.groupBy((F.floor(c(".reldist") * 100) / 100).alias(".reldist")).agg(F.count("*").alias(".counts"))
    total = counted.agg(F.sum(c(".counts"))).scalar()  # at most 51 rows
    return counted.withColumn(".total", total).withColumn(".freq", c(".counts") / c(".total"))


def bed_jaccard(x: DataFrame, y: DataFrame, by: Sequence[str] | None = None, bin_size: int | None = None) -> DataFrame:
    """len_i, len_u (summed lengths), jaccard and n (overlapping or touching pairs) of the merged sets; with ``by`` a row per group that pairs."""
    x, y = check_interval(x), check_interval(y)
    keys = group_keys(x, by, y)
    groups = list(by or [])
    x, y = merged(x, keys), merged(y, keys)
    pairs = overlap_pairs(x, y, keys, 0, bin_size)
    named = [c("chrom") if k == "chrom" else c(f"{k}.x").alias(k) for k in groups]
    both = pairs.groupBy(*named).agg(F.sum("`.overlap`").alias("len_i"), F.count("*").alias("n"))
    size = lambda df, name: df.groupBy(*map(c, groups)).agg(F.sum(c("end") - c("start")).alias(name))
    if groups:
        out = join_on(join_on(both, size(x, "__x"), groups, "left"), size(y, "__y"), groups, "left")
    else:
        one = lambda df: df.withColumn("__one", F.lit(1))
        out = one(both).join(one(size(x, "__x")), "__one").join(one(size(y, "__y")), "__one")
    out = out.withColumn("len_i", F.coalesce("len_i", F.lit(0))).withColumn("len_u", c("__x") + c("__y"))
    return out.select(*map(c, groups), "len_i", "len_u", F.when(c("len_u") != c("len_i"), c("len_i") / (c("len_u") - c("len_i"))).alias("jaccard"), "n")


def fisher_counts(x: DataFrame, y: DataFrame, genome: DataFrame, bin_size: int | None = None) -> DataFrame:
    """One row: n_x, n_y, bases_x, bases_y, n_i, genome_size."""
    x, y, g = check_interval(x), check_interval(y), check_genome(genome)
    one = lambda df: df.withColumn("__one", F.lit(1))
    count = lambda df, n: one(df.agg(F.count("*").alias(n)))
    bases = lambda df, n: one(merged(df, ["chrom"]).agg(F.coalesce(F.sum(c("end") - c("start")), F.lit(0)).alias(n)))
    pairs = overlap_pairs(x.select("chrom", "start", "end"), y.select("chrom", "start", "end"), ["chrom"], 0, bin_size)
    out = count(x, "n_x").join(count(y, "n_y"), "__one").join(bases(x, "bases_x"), "__one").join(bases(y, "bases_y"), "__one")
    return out.join(count(pairs, "n_i"), "__one").join(one(g.agg(F.sum("size").alias("genome_size"))), "__one").drop("__one")


def _table_weights(m: int, n: int, k: int, odds: float, hold: int, far: float = 45.0) -> tuple[int, np.ndarray]:
    """First count and probabilities of a 2 x 2 table's first cell (margins m, n and k) at an odds ratio.

    Summed outward from the mode over ``far`` standard deviations, beyond which nothing is left in double precision; ``hold`` is
    included if it lies within as many again. Memory follows the square root of the margins.
    """
    lo, hi = max(0, k - n), min(k, m)
    # the mode solves (m - i)(k - i) odds = i (n - k + i)
    a, b, c = odds - 1, -((m + k) * odds + n - k), m * k * odds
    root = -c / b if abs(a) < 1e-12 else 2 * c / (-b + math.sqrt(max(b * b - 4 * a * c, 0)))
    mode = min(max(round(root), lo), hi)
    curve = 1 / max(mode, 1) + 1 / max(m - mode, 1) + 1 / max(k - mode, 1) + 1 / max(n - k + mode, 1)
    reach = math.ceil(far / math.sqrt(curve)) + 50
    first, last = max(lo, mode - reach), min(hi, mode + reach)
    if abs(hold - mode) <= 2 * reach:
        first, last = min(first, hold), max(last, hold)
    i = np.arange(first, last, dtype=np.float64)
    steps = np.log(m - i) + np.log(k - i) + math.log(odds) - np.log(i + 1) - np.log(n - k + i + 1)
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    w = np.exp(logs - logs.max())
    return first, w / w.sum()


def fisher_exact(a: int, b: int, cc: int, d: int, level: float = 0.95) -> dict[str, float]:
    """Two-sided exact test of a 2 x 2 table: p.value, conditional estimate of the odds ratio and its confidence limits."""
    m, n, k = a + cc, b + d, a + b
    lo, hi = max(0, k - n), min(k, m)

    def at(log_odds: float) -> tuple[np.ndarray, np.ndarray]:
        first, w = _table_weights(m, n, k, math.exp(log_odds), a)
        return first + np.arange(len(w)), w

    mean = lambda o: float((lambda i, w: (i * w).sum())(*at(o)))
    upper = lambda o: float((lambda i, w: w[i >= a].sum())(*at(o)))
    lower = lambda o: float((lambda i, w: w[i <= a].sum())(*at(o)))
    i, base = at(0.0)
    own = base[i == a]
    p = min(1.0, float(base[base <= own[0] * (1 + 1e-7)].sum())) if len(own) else 0.0

    def root(f, target: float, rising: bool) -> float:
        low, high = -60.0, 60.0
        for _ in range(80):
            mid = (low + high) / 2
            if (f(mid) < target) == rising:
                low = mid
            else:
                high = mid
        return math.exp((low + high) / 2)

    alpha = (1 - level) / 2
    estimate = 0.0 if a == lo else math.inf if a == hi else root(mean, a, True)
    return {
        "estimate": estimate, "p.value": p,
        "conf.low": 0.0 if a == lo else root(upper, alpha, True), "conf.high": math.inf if a == hi else root(lower, alpha, False),
    }


def bed_fisher(x: DataFrame, y: DataFrame, genome: DataFrame, bin_size: int | None = None) -> DataFrame:
    """Exact test of the overlap of x and y rows: estimate, p.value, conf.low, conf.high, method, alternative."""
    spark = x.sparkSession
    r = fisher_counts(x, y, genome, bin_size).head()  # one row
    x_only, y_only = max(0, r.n_x - r.n_i), max(0, r.n_y - r.n_i)
    mean = (r.bases_x / r.n_x if r.n_x else 0) + (r.bases_y / r.n_y if r.n_y else 0)
    total = round(max(r.n_i + x_only + y_only, r.genome_size / mean if mean else 0))
    found = fisher_exact(r.n_i, x_only, y_only, total - r.n_i - x_only - y_only)
    row = (*(float(found[k]) for k in ("estimate", "p.value", "conf.low", "conf.high")), "Fisher's Exact Test for Count Data", "two.sided")
    return spark.createDataFrame([row], "estimate double, `p.value` double, `conf.low` double, `conf.high` double, method string, alternative string")


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(Binomial(n, p) <= k), by the continued fraction of the incomplete beta function."""
    if k >= n or p <= 0:
        return 1.0
    if p >= 1:
        return 0.0
    return _beta_inc(n - k, k + 1, 1 - p)


def _beta_inc(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_inc(b, a, 1 - x)
    tiny, f, cc, d = 1e-300, 1.0, 1.0, 0.0
    for i in range(100_000):
        m = i // 2
        t = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + t * d or tiny)
        cc = 1 + t / cc or tiny
        f *= cc * d
        if abs(1 - cc * d) < 1e-14:
            break
    return front * (f - 1) / a


def projection_counts(x: DataFrame, y: DataFrame, genome: DataFrame, bin_size: int | None = None) -> DataFrame:
    """chrom, obs_counts, total_trials, reference_coverage (null without y) and size of the chromosomes that have x rows."""
    x, y, g = check_interval(x), check_interval(y), check_genome(genome)
    middle = F.bround((c("start") + c("end")) / 2).cast("long")
    x = x.select("chrom", middle.alias("start"), (middle + 1).alias("end"))
    y = merged(y, ["chrom"])
    obs = overlap_pairs(x, y, ["chrom"], 0, bin_size).groupBy("chrom").agg(F.count("*").alias("obs_counts"))
    cover = y.groupBy("chrom").agg(F.sum(c("end") - c("start")).alias("reference_coverage"))
    out = x.groupBy("chrom").agg(F.count("*").alias("total_trials")).join(obs, "chrom", "left").join(cover, "chrom", "left").join(g, "chrom")
    return out.select("chrom", F.coalesce("obs_counts", F.lit(0)).alias("obs_counts"), "total_trials", "reference_coverage", "size")


def bed_projection(x: DataFrame, y: DataFrame, genome: DataFrame, by_chrom: bool = False, bin_size: int | None = None) -> DataFrame:
    """Binomial test of x midpoints in y: chrom, p.value, obs_exp_ratio, lower_tail ("TRUE" or "FALSE")."""
    rows = projection_counts(x, y, genome, bin_size).collect()  # a row per chromosome
    if not by_chrom:
        known = all(r.reference_coverage is not None for r in rows)
        cover = sum(r.reference_coverage for r in rows) if known and rows else None
        rows = [("whole_genome", sum(r.obs_counts for r in rows), sum(r.total_trials for r in rows), cover, sum(r["size"] for r in rows))]
    out = []
    for chrom, seen, trials, cover, size in rows:
        if cover is None or not trials:
            out.append((chrom, None, None, None))
            continue
        prob = cover / size
        p = binomial_cdf(seen, trials, prob)
        out.append((chrom, p if p < 0.5 else 1 - p, seen / trials / prob if prob else None, "TRUE" if p < 0.5 else "FALSE"))
    return x.sparkSession.createDataFrame(out, "chrom string, `p.value` double, obs_exp_ratio double, lower_tail string")
