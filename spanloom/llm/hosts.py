"""Empirical-Bayes host reputation for URL filtering; DataFrame functions only.

Labelled page outcomes are counted per host. A host's bad rate has a beta prior whose mean is the posterior mean of its
registered domain, the domain's that of its suffix, the suffix's that of the whole web; each level's prior strength is
estimated from the spread of its children (method of moments of the beta-binomial). A page is blocked when the lower
posterior bound of its host's bad rate is above the limit. Explicit rules go first.

Edge cases: a null url or one without ``://`` has empty host and path and is judged like a host without labels; pages without
labels inherit from domain and suffix; repeated rows are each judged; empty tables give empty results; other columns are ignored.
A hot host is counted by partial aggregation; its verdict is one row, and the join with its pages is one that Spark splits.

``limit`` is what a wrongly dropped good page costs against a wrongly kept bad one: c / (1 + c), so 0.5 if both cost the same.
Where all hosts are about as bad as the whole web, no host's bound goes beyond it and only the rules block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules that are compiled into one expression; more are joined.
COMPILED = 64
URL = r"://([^/?#]*)([^?#]*)"


def parse(url: Column) -> tuple[Column, Column]:
    """Host and path of a url."""
    u = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(u, URL, 1), UPPER, LOWER), F.regexp_extract(u, URL, 2)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule (verdict, host, path) that fits, as struct(rule, verdict); null if none. Of equally long ones that with the longer host, then the last by name and verdict."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]), r[1] + r[2], r[0])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def registered(host: Column) -> tuple[Column, Column]:
    """Registered domain (last two labels) and suffix (last label)."""
    return F.substring_index(host, ".", -2), F.substring_index(host, ".", -1)


def _strength(df: DataFrame, parent: str | None) -> Column:
    """Prior strength of a level, a scalar, from its children's counts (n, bad) around their parents' rates."""
    kids = df.where("n > 0")
    if parent:
        own = kids.groupBy(parent).agg((F.sum("bad") / F.sum("n")).alias("m"))
        kids = kids.join(own, parent)
    else:
        kids = kids.withColumn("m", kids.agg(F.sum("bad") / F.sum("n")).scalar())
    m = F.col("m")
    sums = kids.agg(
        F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - m, 2)).alias("s"),
        F.sum(F.col("n") * m * (1 - m)).alias("v"),
        F.sum(m * (1 - m)).alias("w"),
    )
    # E[s] = sum m(1-m) (1 + (n-1) rho): solve for the intra-class correlation rho
    rho = F.when(F.col("v") > F.col("w"), (F.col("s") - F.col("w")) / (F.col("v") - F.col("w"))).otherwise(F.lit(0.0))
    rho = F.least(F.greatest(F.coalesce(rho, F.lit(0.0)), F.lit(0.001)), F.lit(0.5))
    return sums.select((1 - rho) / rho).scalar()


def reputation(hosts: DataFrame, z: float = 2.0) -> DataFrame:
    """host, rate, lower: posterior mean and lower bound from ``hosts`` (host, n, bad), one row per host."""
    domain, suffix = registered(F.col("host"))
    h = hosts.select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "bad")
    d = h.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    s = d.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    up = s.agg((F.coalesce(F.sum("bad"), F.lit(0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0)) + 2)).scalar()

    def shrunk(counts: DataFrame, mean: Column, parent: str | None) -> DataFrame:
        counts = counts.withColumns({"_k": _strength(counts.select("n", "bad", *([parent] if parent else [])), parent), "_m": mean})
        return counts.withColumns({"a": F.col("bad") + F.col("_m") * F.col("_k"), "b": F.col("n") - F.col("bad") + (1 - F.col("_m")) * F.col("_k")})

    mean = F.col("a") / (F.col("a") + F.col("b"))
    s = shrunk(s, up, None).select("suffix", mean.alias("s_up"))
    d = shrunk(d.join(s, "suffix"), F.col("s_up"), "suffix").select("domain", mean.alias("d_up"))
    h = shrunk(h.join(d, "domain"), F.col("d_up"), "domain")
    spread = F.sqrt(mean * (1 - mean) / (F.col("a") + F.col("b") + 1))
    return h.select("host", mean.alias("rate"), F.greatest(F.lit(0.0), mean - z * spread).alias("lower"))


def judge(
    pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str, str]], limit: float = 0.5, z: float = 2.0
) -> DataFrame:
    """page_id, host, path, rule, verdict, rate and lower of every page.

    ``pages`` has page_id and url, ``outcomes`` page_id and bad (0/1, null is no label); a page with several outcomes counts with the worst.
    """
    host, path = parse(F.col("url"))
    p = pages.select("page_id", host.alias("host"), path.alias("path"))
    worst = outcomes.where("bad is not null").groupBy("page_id").agg(F.max(F.col("bad").cast("long")).alias("bad"))
    counts = p.join(worst, "page_id", "left").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    known = reputation(materialize(counts, "hosts"), z)
    both = p.join(known, "host", "left")
    if len(rules) <= COMPILED:
        both = both.withColumn("_r", rule_of(F.col("host"), F.col("path"), rules))
    else:
        both = _joined_rules(both, rules)
    by_method = F.when(F.coalesce(F.col("lower"), F.lit(0.0)) > limit, "block").otherwise("allow")
    return both.select("page_id", "host", "path", F.col("_r.rule").alias("rule"), F.coalesce(F.col("_r.verdict"), by_method).alias("verdict"), "rate", "lower")


def oracle(rules: list[tuple[str, str, str]], limit: float = 0.5, z: float = 2.0) -> str:
    """DuckDB SQL for ``judge`` on ``pages`` whose outcome is the quality label of the document that ends their url's path."""
    listed = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in rules)

    def strength(kids: str, parent: str) -> str:
        return f"""(SELECT (1 - rho) / rho FROM (SELECT least(greatest(coalesce(CASE WHEN v > w THEN (s - w) / (v - w) ELSE 0 END, 0), 0.001), 0.5) AS rho FROM (
            SELECT sum(n * power(bad / n - m, 2)) AS s, sum(n * m * (1 - m)) AS v, sum(m * (1 - m)) AS w
            FROM {kids} JOIN (SELECT {parent} AS k, sum(bad) / sum(n) AS m FROM {kids} WHERE n > 0 GROUP BY 1) ON k = {parent} WHERE n > 0)))"""

    return f"""
    WITH parsed AS (
        SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
    labelled AS (SELECT doc_id, 1 - quality AS bad FROM labels WHERE quality IS NOT NULL),
    worst AS (SELECT page_id, max(bad) AS bad FROM parsed JOIN labelled ON doc_id = try_cast(nullif(regexp_extract(path, '^/[^/]*/([0-9]+)', 1), '') AS BIGINT) GROUP BY 1),
    h AS (SELECT host, regexp_extract(host, '[^.]*([.][^.]*)?$') AS domain, regexp_extract(host, '[^.]*$') AS suffix, count(bad)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS bad FROM parsed LEFT JOIN worst USING (page_id) GROUP BY ALL),
    d AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY ALL),
    s AS (SELECT suffix, 1 AS web, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY ALL),
    sm AS (SELECT suffix, (bad + m * k) / (n + k) AS up FROM s, (SELECT (coalesce(sum(bad), 0) + 1) / (coalesce(sum(n), 0) + 2) AS m FROM s), (SELECT {strength("s", "web")} AS k)),
    dm AS (SELECT domain, (bad + up * k) / (n + k) AS up FROM d JOIN sm USING (suffix), (SELECT {strength("d", "suffix")} AS k)),
    hm AS (SELECT host, bad + up * k AS a, n - bad + (1 - up) * k AS b FROM h JOIN dm USING (domain), (SELECT {strength("h", "domain")} AS k)),
    low AS (SELECT host, a / (a + b) - {z} * sqrt(a / (a + b) * (1 - a / (a + b)) / (a + b + 1)) AS lower FROM hm),
    rules(verdict, rhost, rpath) AS (VALUES {listed}),
    fits AS (
        SELECT page_id, arg_max(rhost || rpath, (length(rhost || rpath), length(rhost), rhost || rpath, verdict)) AS rule, arg_max(verdict, (length(rhost || rpath), length(rhost), rhost || rpath, verdict)) AS said
        FROM parsed JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY 1)
    SELECT page_id, host, path, rule, coalesce(said, CASE WHEN lower > {limit} THEN 'block' ELSE 'allow' END) AS verdict FROM parsed LEFT JOIN fits USING (page_id) LEFT JOIN low USING (host)"""


def _joined_rules(pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules beyond the compiled number, found by a hash join of each distinct (host, path)'s host suffixes."""
    table = pages.sparkSession.createDataFrame(rules, "verdict string, rhost string, rpath string")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, -i, i), "."))
    fits = (
        pages.select("host", "path").distinct().select("host", "path", F.explode(suffixes).alias("rhost"))
        .join(table, "rhost").where(F.col("path").startswith(F.col("rpath")))
        .groupBy("host", "path")
        .agg(F.max_by(F.struct(F.concat("rhost", "rpath").alias("rule"), "verdict"), F.struct(F.length(F.concat("rhost", "rpath")), F.length("rhost"), F.concat("rhost", "rpath"), "verdict")).alias("_r"))
    )
    return pages.join(fits, ["host", "path"], "left")
