"""Quality rules whose cutoffs are risk-controlled on labelled holdouts; DataFrame functions only.

Base rules reject a text with too few words or mostly repeated word triples. Beyond them, each statistic has a fixed grid of
cutoffs, from lenient to strict. For every stratum (language) and cutoff, labelled good documents that the cutoff would reject
are counted. A document goes if any statistic rejects it, so each statistic may reject ``alpha`` over the number of statistics
of the good documents: together at most ``alpha``, the bound of the verdict. Down a statistic's grid, cutoffs are certified
by exact binomial tests in fixed sequence, which ends at the first that fails; each sequence keeps the level ``delta`` over
the number of strata and statistics (Bonferroni), so that with probability 1 - ``delta`` no stratum's bound is broken. Of a
statistic's certified cutoffs, the one that removes most bad documents net of ``penalty`` times the good ones is used; none, if
that never pays.

Edge cases: null text counts as empty (and fails the base rules); a null language is a stratum of its own; a document with
several labels is good only if all are; repeated rows are each judged; unlabelled or empty tables certify nothing; other columns
stay, but those named like a measure or a result are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import free_name

BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
#: Statistic: direction (+1 rejects above, -1 below) and grid of cutoffs, from lenient to strict.
GRID = {
    "symbol_rate": (1, [0.2, 0.1, 0.05, 0.02]),
    "dup_line_rate": (1, [0.5, 0.3, 0.2, 0.1]),
    "repeat_rate": (1, [0.4, 0.3, 0.2, 0.1]),
    "mean_word": (1, [14.0, 11.0, 9.0]),
    "mean_word_low": (-1, [2.0, 2.5, 3.0]),
}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]


def _repeats(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more."""
    n = F.size(words)
    hashes = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2]))

    def covered(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def count(s: Column) -> Column:
            twice = F.filter(
                F.transform(
                    s,
                    lambda x, i: F.when(
                        ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | ((i + 1 < F.size(s)) & (F.get(s, i + 1)["h"] == x["h"])),
                        x["i"],
                    ),
                ),
                lambda p: p.isNotNull(),
            )
            zero = F.struct(F.lit(0).alias("n"), F.lit(-9).alias("last"))
            return F.aggregate(
                F.array_sort(twice),
                zero,
                lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")),
                lambda a: a["n"],
            )

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(pairs, count))

    return F.when(n < 3, F.lit(0)).otherwise(let(hashes, covered))


#: Columns that ``measure`` makes.
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_text_lines"]


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``MEASURES`` (long) beside its columns; columns of those names are replaced.

    The measures are generated rows of one struct, so that no later filter makes Spark compute them twice.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    long_ = lambda c: c.cast("long")
    words = let(F.array_remove(F.split(t, r"[\x20\x09-\x0D]+"), ""), lambda w: F.struct(long_(F.size(w)).alias("n"), long_(_repeats(w)).alias("r")))
    lines = F.array_remove(F.split(F.regexp_replace(t, r"(?dm)^[\x20\x09\x0B-\x0D]+$", ""), "\n"), "")
    counted = let(lines, lambda x: F.struct(long_(F.size(x)).alias("n"), long_(F.size(x) - F.size(F.array_distinct(x))).alias("d")))
    parts = F.array(F.struct(words.alias("w"), counted.alias("l"), long_(F.length(F.translate(t, BLANKS, ""))).alias("c"), long_(F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).alias("s")))
    named = lambda x: F.struct(*(c.alias(m) for m, c in zip(MEASURES, (x["w.n"], x["c"], x["s"], x["l.d"], x["w.r"], x["l.n"]), strict=True)))
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in MEASURES]
    return docs.select(*kept, F.inline(F.transform(parts, lambda x: named({"w.n": x["w"]["n"], "w.r": x["w"]["r"], "l.n": x["l"]["n"], "l.d": x["l"]["d"], "c": x["c"], "s": x["s"]}))))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def statistics() -> dict[str, Column]:
    rate = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    mean = rate("word_chars", "n_words")
    return {
        "symbol_rate": rate("n_symbols", "word_chars"),
        "dup_line_rate": rate("n_dup_lines", "n_text_lines"),
        "repeat_rate": rate("n_repeat_words", "n_words"),
        "mean_word": mean,
        "mean_word_low": mean,
    }


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k), exactly summed in logs; k is cut to where the sum stops mattering for p."""
    ratio = math.log(p) - math.log1p(-p)
    first = F.struct((n * math.log1p(-p)).cast("double").alias("t"), F.lit(0.0).alias("s"), F.lit(0.0).alias("shift"))
    # s is the sum relative to exp(shift); both follow the largest term so far
    def step(a: Column, i: Column) -> Column:
        t = a["t"] + F.log((n - i + 1) / i) + ratio
        top = F.greatest(a["shift"], t)
        return F.struct(t.alias("t"), (a["s"] * F.exp(a["shift"] - top) + F.exp(t - top)).alias("s"), top.alias("shift"))

    start = F.struct(first["t"].alias("t"), F.lit(1.0).alias("s"), first["t"].alias("shift"))
    return F.when(k >= n, F.lit(1.0)).otherwise(
        F.aggregate(F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<long>")), start, step, lambda a: a["s"] * F.exp(a["shift"]))
    )


def stratum() -> Column:
    return F.coalesce(F.concat(F.lit("="), "lang"), F.lit(""))


def certify(measured: DataFrame, labels: DataFrame, alpha: float = 0.05, delta: float = 0.05, penalty: float = 10.0) -> DataFrame:
    """stratum, statistic, sign, cutoff: the chosen cutoffs; ``measured`` holds the holdout's measures, ``labels`` doc_id and good (boolean)."""
    good = labels.groupBy("doc_id").agg(F.min(F.col("good").cast("int")).alias("_good"))
    held = measured.select("doc_id", "lang", *MEASURES).where(~base_failed()).join(good, "doc_id").where("_good is not null")
    tests = [(s, sign, rank, cut) for s, (sign, cuts) in GRID.items() for rank, cut in enumerate(cuts)]
    stats = statistics()
    hits = [
        F.sum(F.when((stats[s] * sign > cut * sign) & (F.col("_good") == g), 1).otherwise(0)).alias(f"h{i}_{g}")
        for i, (s, sign, _, cut) in enumerate(tests)
        for g in (0, 1)
    ]
    counted = held.groupBy(stratum().alias("stratum")).agg(F.sum("_good").alias("n_good"), *hits)
    rows = F.explode(
        F.array(
            *(
                F.struct(F.lit(s).alias("statistic"), F.lit(sign).alias("sign"), F.lit(rank).alias("rank"), F.lit(cut).alias("cutoff"), F.col(f"h{i}_1").alias("k"), F.col(f"h{i}_0").alias("bad"))
                for i, (s, sign, rank, cut) in enumerate(tests)
            )
        )
    )
    tested = counted.select("stratum", "n_good", F.count("*").over(Window.partitionBy()).alias("strata"), rows.alias("x")).select("stratum", "n_good", "strata", "x.*")
    each, level = alpha / len(GRID), delta / (F.col("strata") * len(GRID))
    # above the mean the tail exceeds one half, so only counts below it need the sum
    passed = F.when(F.col("k") < each * F.col("n_good"), binomial_cdf(F.col("k"), F.col("n_good"), each) <= level).otherwise(F.lit(False))
    upto = Window.partitionBy("stratum", "statistic").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    gain = F.col("bad") - penalty * F.col("k")
    certified = tested.withColumn("passed", passed).withColumn("certified", F.min("passed").over(upto))
    return certified.where("certified").where(gain > 0).groupBy("stratum", "statistic", "sign").agg(F.min_by("cutoff", F.struct(-gain, "rank")).alias("cutoff"))


def verdict(measured: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """``measured`` with base_failed and kept. ``cutoffs`` has a row per stratum and statistic, so its broadcast is bounded by the strata."""
    stats = statistics()
    measured = measured.drop("base_failed", "kept")
    own, which = free_name(measured, "stratum"), free_name(measured, "cutoffs")
    per = cutoffs.groupBy(F.col("stratum").alias(own)).agg(F.struct(*(F.max(F.when(F.col("statistic") == s, F.col("cutoff"))).alias(s) for s in GRID)).alias(which))
    fails = [F.coalesce(stats[s] * sign > F.col(which)[s] * sign, F.lit(False)) for s, (sign, _) in GRID.items()]
    hit = reduce(lambda a, b: a | b, fails)
    joined = measured.join(F.broadcast(per), stratum() == F.col(own), "left")
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~hit).drop(own, which)


def oracle(alpha: float = 0.05, delta: float = 0.05, penalty: float = 10.0) -> str:
    """DuckDB SQL for the measures and the verdict on ``documents``, with the quality of ``labels``."""
    tests = ", ".join(f"('{s}', {sign}, {rank}, {cut})" for s, (sign, cuts) in GRID.items() for rank, cut in enumerate(cuts))
    rate = lambda a, b: f"CASE WHEN {b} > 0 THEN {a} / {b}::DOUBLE ELSE 0.0 END"
    mean = rate("word_chars", "n_words")
    stats = {"symbol_rate": rate("n_symbols", "word_chars"), "dup_line_rate": rate("n_dup_lines", "n_text_lines"), "repeat_rate": rate("n_repeat_words", "n_words"), "mean_word": mean, "mean_word_low": mean}
    values = " UNION ALL ".join(f"SELECT r, doc_id, stratum, base_failed, '{s}' AS statistic, {e} AS v FROM m" for s, e in stats.items())
    p = alpha / len(GRID)
    return rf"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t FROM documents),
    w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, [x for x in string_split(t, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] AS ls FROM d),
    wd AS (SELECT r, unnest(ws) AS a, generate_subscripts(ws, 1) AS i FROM w),
    three AS (SELECT *, lead(a) OVER (PARTITION BY r ORDER BY i) AS b, lead(a, 2) OVER (PARTITION BY r ORDER BY i) AS c FROM wd),
    tri AS (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM three WHERE c IS NOT NULL),
    rep AS (SELECT r, count(DISTINCT i + k) AS n FROM tri, (VALUES (0), (1), (2)) o(k) WHERE n > 1 GROUP BY r),
    m0 AS (SELECT r, doc_id, coalesce('=' || lang, '') AS stratum, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_text_lines
        FROM w LEFT JOIN rep USING (r)),
    m AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m0),
    g AS (SELECT doc_id, min(CASE WHEN quality = 1 THEN 1 WHEN quality IS NOT NULL THEN 0 END) AS good FROM labels GROUP BY 1),
    v AS ({values}),
    tests(statistic, sign, rank, cutoff) AS (VALUES {tests}),
    held AS (SELECT v.*, good FROM v JOIN g USING (doc_id) WHERE NOT base_failed AND good IS NOT NULL),
    counted AS (
        SELECT stratum, statistic, sign, rank, cutoff, sum(good) AS n, count(*) FILTER (WHERE good = 1 AND v * sign > cutoff * sign) AS k, count(*) FILTER (WHERE good = 0 AND v * sign > cutoff * sign) AS bad,
        FROM held JOIN tests USING (statistic) GROUP BY ALL),
    tested AS (SELECT *, CASE WHEN k < {p} * n THEN list_sum([exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({p}) + (n - i) * ln(1 - {p})) for i in range(0, k + 1)])
        <= {delta} / ((SELECT count(DISTINCT stratum) FROM counted) * {len(GRID)}) ELSE false END AS passed FROM counted),
    certified AS (SELECT *, bool_and(passed) OVER (PARTITION BY stratum, statistic ORDER BY rank) AS ok FROM tested),
    chosen AS (SELECT stratum, statistic, sign, arg_min(cutoff, (-(bad - {penalty} * k), rank)) AS cutoff FROM certified WHERE ok AND bad - {penalty} * k > 0 GROUP BY ALL),
    hit AS (SELECT DISTINCT r FROM v JOIN chosen USING (stratum, statistic) WHERE v * sign > cutoff * sign)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND r NOT IN (SELECT r FROM hit) AS kept FROM m"""
