"""Registered queries of the interval verbs over the ``events`` and ``lineitem`` tables, and their DuckDB twins.

``ev`` reads an event as an interval of seconds (start = time since 2024, length from its value), ``li`` an order line as a range of
part positions. Results have snake_case columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

import spanloom as S

from .functions import concat, first, last, values, values_unique
from .operators.stats import fisher_counts, projection_counts
from .schema import c
from .sources.bed import read_bed, read_bedgraph, write_bed, write_bedgraph

EPOCH = "TIMESTAMP_NTZ'2024-01-01 00:00:00'"


_SCHEMAS: dict[str, StructType] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; its schema is looked up in the files once."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def ev(spark: SparkSession, sf_dir: str, *kinds: str) -> DataFrame:
    t = read(spark, sf_dir, "events")
    if kinds:
        t = t.where(F.col("event_type").isin(*kinds))
    t = t.withColumns({"start": F.expr(f"timestampdiff(SECOND, {EPOCH}, ts)"), "chrom": F.concat(F.lit("u"), (F.col("user_id") % 24).cast("string"))})
    length = F.greatest(F.lit(1).cast("long"), F.floor(F.col("value") * 60).cast("long"))
    strand = F.when(F.col("event_type").isin("click", "view"), "+").otherwise("-")
    return t.select("chrom", "start", (F.col("start") + length).alias("end"), F.col("event_id").alias("name"), F.col("value").alias("score"), strand.alias("strand"), F.col("event_type").alias("kind"))


def li(spark: SparkSession, sf_dir: str, flag: str | None = None) -> DataFrame:
    t = read(spark, sf_dir, "lineitem")
    if flag:
        t = t.where(F.col("l_returnflag") == flag)
    start = F.col("l_partkey") * 100
    return t.select(
        F.concat(F.lit("s"), (F.col("l_suppkey") % 25).cast("string")).alias("chrom"), start.alias("start"), (start + F.floor(F.col("l_quantity") * 4).cast("long")).alias("end"),
        F.col("l_orderkey").alias("name"), F.col("l_returnflag").alias("flag"),
    )


def genome(x: DataFrame) -> DataFrame:
    return x.groupBy("chrom").agg((F.max("end") + 1000).alias("size"))


def genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BED12: one gene per order, its distinct lines are the exons."""
    t = read(spark, sf_dir, "lineitem")
    t = t.select("l_orderkey", (F.col("l_partkey") * 100).alias("s"), (F.col("l_partkey") * 100 + F.floor(F.col("l_quantity") * 4).cast("long")).alias("e")).distinct()
    g = t.groupBy("l_orderkey").agg(F.min("s").alias("start"), F.max("e").alias("end"), F.array_sort(F.collect_list(F.struct("s", "e"))).alias("x"))
    text = lambda f: F.array_join(F.transform("x", lambda p: f(p).cast("string")), ",")
    quarter = F.expr("(`end` - `start`) div 4")
    return g.select(
        F.concat(F.lit("g"), (F.col("l_orderkey") % 7).cast("string")).alias("chrom"), "start", "end", F.col("l_orderkey").cast("string").alias("name"), F.lit("0").alias("score"),
        F.when(F.expr("l_orderkey div 10 % 2 = 0"), "+").otherwise("-").alias("strand"), (F.col("start") + quarter).alias("cds_start"), (F.col("end") - quarter).alias("cds_end"),
        F.lit("0").alias("item_rgb"), F.size("x").alias("exon_count"), text(lambda p: p["e"] - p["s"]).alias("exon_sizes"), text(lambda p: p["s"] - F.col("start")).alias("exon_starts"),
    )


def plain(df: DataFrame) -> DataFrame:
    """Columns without dots: ``start.x`` is start_x, ``.overlap`` is overlap."""
    return df.toDF(*(n.strip(".").replace(".", "_") for n in df.columns))


_EV = """ev AS (SELECT 'u' || (user_id % 24) AS chrom, CAST(floor(epoch(ts)) AS BIGINT) - 1704067200 AS s, CAST(floor(epoch(ts)) AS BIGINT) - 1704067200 + greatest(1, CAST(floor(value * 60) AS BIGINT)) AS e,
 event_id AS name, value AS score, CASE WHEN event_type IN ('click', 'view') THEN '+' ELSE '-' END AS strand, event_type AS kind FROM events),
x AS (SELECT * FROM ev WHERE kind = 'click'), y AS (SELECT * FROM ev WHERE kind = 'purchase'), z AS (SELECT * FROM ev WHERE kind = 'error'), o AS (SELECT * FROM ev WHERE kind <> 'click'),
genome AS (SELECT chrom, max(e) + 1000 AS size FROM ev GROUP BY chrom)"""
_LI = """li AS (SELECT 's' || (l_suppkey % 25) AS chrom, l_partkey * 100 AS s, l_partkey * 100 + CAST(floor(l_quantity * 4) AS BIGINT) AS e, l_orderkey AS name, l_returnflag AS flag FROM lineitem),
a AS (SELECT * FROM li WHERE flag = 'A'), r AS (SELECT * FROM li WHERE flag = 'R')"""
_GENES = """lines AS (SELECT DISTINCT l_orderkey AS k, l_partkey * 100 AS s, l_partkey * 100 + CAST(floor(l_quantity * 4) AS BIGINT) AS e FROM lineitem),
gene AS (SELECT 'g' || (k % 7) AS chrom, min(s) AS s, max(e) AS e, CAST(k AS VARCHAR) AS name, '0' AS score, CASE WHEN k // 10 % 2 = 0 THEN '+' ELSE '-' END AS strand,
 min(s) + (max(e) - min(s)) // 4 AS cs, max(e) - (max(e) - min(s)) // 4 AS ce FROM lines GROUP BY k),
exon AS (SELECT 'g' || (k % 7) AS chrom, s, e, CAST(k AS VARCHAR) AS name, CASE WHEN k // 10 % 2 = 0 THEN '+' ELSE '-' END AS strand,
 row_number() OVER (PARTITION BY k ORDER BY s, e) AS i, count(*) OVER (PARTITION BY k) AS n FROM lines)"""
SE = 's AS "start", e AS "end"'


def _islands(t: str, keys: str = "chrom", d: int = 0, out: str = "i") -> str:
    w = f"PARTITION BY {keys} ORDER BY s, e"
    return f"""{out}_p AS (SELECT *, max(e) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM {t}),
{out} AS (SELECT *, sum(CASE WHEN pe IS NULL OR pe + {d} < s THEN 1 ELSE 0 END) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS isl FROM {out}_p)"""


def _merged(t: str, out: str, keys: str = "chrom", d: int = 0) -> str:
    return f"{_islands(t, keys, d, out + '_i')}, {out} AS (SELECT {keys}, min(s) AS s, max(e) AS e FROM {out}_i GROUP BY {keys}, isl)"


def _pairs(m: int = 1, x: str = "x", y: str = "y", on: str = "", cols: str = "") -> str:
    return f"""SELECT x.chrom, x.s AS start_x, x.e AS end_x, x.name AS name_x, y.s AS start_y, y.e AS end_y, y.name AS name_y, least(x.e, y.e) - greatest(x.s, y.s) AS overlap{cols}
FROM {x} x JOIN {y} y ON x.chrom = y.chrom{on} AND least(x.e, y.e) - greatest(x.s, y.s) >= {m}"""


def _closest(on: str = "", keep: bool = True) -> str:
    """Overlaps and touches, nearest separate rows with ties, and rows without a group."""
    extra = ", overlap" if keep else ""
    limit = "" if keep else "WHERE overlap IS NULL OR overlap <= 0"
    return f"""p AS (SELECT x.name AS nx, y.name AS ny, least(x.e, y.e) - greatest(x.s, y.s) AS ov, y.e <= x.s AS up, CASE WHEN y.e <= x.s THEN x.s - y.e WHEN y.s >= x.e THEN y.s - x.e END AS gap
 FROM x JOIN y ON x.chrom = y.chrom{on}),
near AS (SELECT *, rank() OVER (PARTITION BY nx ORDER BY gap) AS k FROM p WHERE gap IS NOT NULL),
found AS (SELECT nx, ny, ov AS overlap, CASE WHEN ov > 0 THEN 0 WHEN up THEN -1 ELSE 1 END AS dist FROM p WHERE ov >= 0
 UNION ALL SELECT nx, ny, 0, CASE WHEN up THEN -(gap + 1) ELSE gap + 1 END FROM near WHERE k = 1 AND gap > 0
 UNION ALL SELECT x.name, NULL, NULL, NULL FROM x WHERE NOT EXISTS (SELECT 1 FROM y WHERE x.chrom = y.chrom{on}))
SELECT nx AS name_x, ny AS name_y, dist{extra} FROM found {limit}"""


def _coverage(m: int = 1, on: str = "") -> str:
    return f"""p AS (SELECT x.name AS k, x.s AS xs, x.e AS xe, y.s AS ys, y.e AS ye, y.name AS yn FROM x JOIN y ON x.chrom = y.chrom{on} AND least(x.e, y.e) - greatest(x.s, y.s) >= {m}),
q AS (SELECT *, max(ye) OVER (PARTITION BY k ORDER BY ys, ye, yn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM p),
t AS (SELECT k, count(*) AS ints, CAST(sum(greatest(0, least(ye, xe) - greatest(ys, xs, coalesce(pe, xs)))) AS BIGINT) AS cov FROM q GROUP BY k)
SELECT x.chrom, x.s AS "start", x.e AS "end", x.name, coalesce(ints, 0) AS ints, coalesce(cov, 0) AS cov, x.e - x.s AS len, round(coalesce(cov, 0) / (x.e - x.s), 6) AS frac FROM x LEFT JOIN t ON x.name = t.k"""


def _map(exprs: str, x: str = "x", y: str = "y", m: int = 1) -> str:
    return f"""p AS (SELECT x.name AS k, y.* FROM {x} x JOIN {y} y ON x.chrom = y.chrom AND least(x.e, y.e) - greatest(x.s, y.s) >= {m}), t AS (SELECT k, {exprs} FROM p GROUP BY k)
SELECT x.chrom, x.s AS "start", x.e AS "end", x.name, t.* EXCLUDE (k) FROM {x} x LEFT JOIN t ON x.name = t.k"""


def _subtract(on: str = "", x: str = "x", y: str = "y") -> str:
    return f"""p AS (SELECT x.name AS k, x.chrom, x.s AS xs, x.e AS xe, y.s AS ys, y.e AS ye, y.name AS yn FROM {x} x JOIN {y} y ON x.chrom = y.chrom{on} AND x.s < y.e AND y.s < x.e),
q AS (SELECT *, greatest(xs, max(ye) OVER (PARTITION BY k ORDER BY ys, ye, yn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS f FROM p),
cut AS (SELECT chrom, k, coalesce(f, xs) AS s, least(ys, xe) AS e FROM q UNION ALL SELECT chrom, k, max(ye), any_value(xe) FROM p GROUP BY chrom, k),
d AS (SELECT chrom, s, e, k AS name FROM cut WHERE s < e UNION ALL SELECT chrom, s, e, name FROM {x} x WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.k = x.name))"""


def _depth(t: str, keys: str = "chrom", where: str = "") -> str:
    return f"""v AS (SELECT {keys}, s AS pos, 1 AS d FROM {t} UNION ALL SELECT {keys}, e, -1 FROM {t}), ve AS (SELECT {keys}, pos, sum(d) AS d FROM v {where} GROUP BY {keys}, pos),
sw AS (SELECT {keys}, pos AS s, CAST(sum(d) OVER (PARTITION BY {keys} ORDER BY pos) AS BIGINT) AS depth, lead(pos) OVER (PARTITION BY {keys} ORDER BY pos) AS e FROM ve)"""


def _bounded(select: str, trim: bool = False) -> str:
    """Rows of a select with s, e inside the genome."""
    if not trim:
        return f"b AS (SELECT t.* FROM ({select}) t JOIN genome g ON t.chrom = g.chrom WHERE s >= 0 AND s < size AND e <= size AND e > 0)"
    return f"""b0 AS (SELECT t.* EXCLUDE (s, e), CASE WHEN s < 0 THEN 0 ELSE least(s, size - 1) END AS s, CASE WHEN e > size THEN size ELSE greatest(1, e) END AS e FROM ({select}) t JOIN genome g ON t.chrom = g.chrom),
b AS (SELECT * FROM b0 WHERE s <> e)"""


Entry = tuple[Callable[[SparkSession, str], DataFrame], str | None]


def _table() -> dict[str, Entry]:
    q: dict[str, Entry] = {}
    x = lambda s, d: ev(s, d, "click")
    y = lambda s, d: ev(s, d, "purchase")
    z = lambda s, d: ev(s, d, "error")
    o = lambda s, d: ev(s, d).where("kind <> 'click'")
    g = lambda s, d: genome(ev(s, d))
    w = ev  # single-table verbs take all events
    three = lambda df: df.select("chrom", "start", "end", "name")
    pair = ["chrom", "start_x", "end_x", "name_x", "start_y", "end_y", "name_y", "overlap"]
    with_ev = lambda tail, mid="": f"WITH {_EV}{', ' if mid else ' '}{mid} {tail}"

    def add(name: str, fn: Callable, sql: str | None) -> None:
        q[name] = (fn, sql)

    # overlap joins
    add("intersect", lambda s, d: plain(S.bed_intersect(x(s, d), y(s, d))).select(pair), with_ev(_pairs()))
    add("intersect_lineitem", lambda s, d: plain(S.bed_intersect(li(s, d, "A"), li(s, d, "R"))).select(pair), f"WITH {_LI} {_pairs(1, 'a', 'r')}")
    add("intersect_touching", lambda s, d: plain(S.bed_intersect(li(s, d, "A"), li(s, d, "R"), min_overlap=0)).select(pair), f"WITH {_LI} {_pairs(0, 'a', 'r')}")
    add("intersect_min_overlap", lambda s, d: plain(S.bed_intersect(x(s, d), o(s, d), min_overlap=600)).select(pair), with_ev(_pairs(600, "x", "o")))
    add("intersect_invert", lambda s, d: S.bed_intersect(x(s, d), y(s, d), invert=True), with_ev(f"SELECT chrom, {SE}, name, score, strand, kind FROM x WHERE NOT EXISTS (SELECT 1 FROM y WHERE x.chrom = y.chrom AND x.s < y.e AND y.s < x.e)"))
    add("intersect_multi_source", lambda s, d: plain(S.bed_intersect(x(s, d), purchase=y(s, d), error=z(s, d))).select(*pair, "source"),
        with_ev(_pairs(1, "x", "o", " AND y.kind IN ('purchase', 'error')", ", y.kind AS source")))
    add("intersect_by_strand", lambda s, d: plain(S.bed_intersect(x(s, d), o(s, d), by=["strand"])).select(pair), with_ev(_pairs(1, "x", "o", " AND x.strand = y.strand")))
    add("intersect_opposite_strand", lambda s, d: plain(S.bed_intersect(x(s, d), S.flip_strands(o(s, d)), by=["strand"])).select(pair), with_ev(_pairs(1, "x", "o", " AND x.strand <> y.strand")))
    for name, kw, lo, hi in (("window_both", {"both": 500}, 500, 500), ("window_left_right", {"left": 100, "right": 900}, 100, 900)):
        add(name, lambda s, d, kw=kw: plain(S.bed_window(x(s, d), y(s, d), g(s, d), **kw)).select(pair),
            with_ev(f"SELECT w.chrom, w.os AS start_x, w.oe AS end_x, w.name AS name_x, y.s AS start_y, y.e AS end_y, y.name AS name_y, least(w.e, y.e) - greatest(w.s, y.s) AS overlap FROM b w JOIN y ON w.chrom = y.chrom AND w.s < y.e AND y.s < w.e",
                    _bounded(f"SELECT chrom, s - {lo} AS s, e + {hi} AS e, s AS os, e AS oe, name FROM x")))
    # nearest
    add("closest", lambda s, d: plain(S.bed_closest(x(s, d), y(s, d))).select("name_x", "name_y", "dist", "overlap"), with_ev("", _closest()))
    add("closest_no_overlap", lambda s, d: plain(S.bed_closest(x(s, d), y(s, d), overlap=False)).select("name_x", "name_y", "dist"), with_ev("", _closest(keep=False)))
    add("closest_by_strand", lambda s, d: plain(S.bed_closest(x(s, d), S.flip_strands(y(s, d)), by=["strand"])).select("name_x", "name_y", "dist", "overlap"), with_ev("", _closest(" AND x.strand <> y.strand")))
    # overlap aggregates
    cover = lambda df: plain(df).select("chrom", "start", "end", "name", "ints", "cov", "len", F.round("frac", 6).alias("frac"))
    add("coverage", lambda s, d: cover(S.bed_coverage(x(s, d), y(s, d))), with_ev("", _coverage()))
    add("coverage_by_strand", lambda s, d: cover(S.bed_coverage(x(s, d), S.flip_strands(y(s, d)), by=["strand"])), with_ev("", _coverage(on=" AND x.strand <> y.strand")))
    add("map_sum_count", lambda s, d: three2(S.bed_map(x(s, d), o(s, d), total=F.round(F.sum("score"), 4), n=F.count("*")), "total", "n"), with_ev("", _map("round(sum(score), 4) AS total, count(*) AS n", "x", "o")))
    add("map_min_max_mean", lambda s, d: three2(S.bed_map(x(s, d), o(s, d), lo=F.min("score"), hi=F.max("score"), mean=F.round(F.avg("score"), 6)), "lo", "hi", "mean"), with_ev("", _map("min(score) AS lo, max(score) AS hi, round(avg(score), 6) AS mean", "x", "o")))
    add("map_concat", lambda s, d: three2(S.bed_map(x(s, d), o(s, d), names=concat("name")), "names"), with_ev("", _map("array_to_string(list(name ORDER BY s, name), ',') AS names", "x", "o")))
    kinds = "list(kind ORDER BY s, kind)"
    add("map_values", lambda s, d: three2(S.bed_map(x(s, d), o(s, d), kinds=values("kind")), "kinds"),
        with_ev("", _map(f"array_to_string(list_transform(list_filter(list_zip({kinds}, list_prepend(NULL, {kinds})), lambda p: p[1] IS NOT NULL AND (p[2] IS NULL OR p[1] <> p[2])), lambda p: p[1]), ',') AS kinds", "x", "o")))
    add("map_values_unique", lambda s, d: three2(S.bed_map(x(s, d), o(s, d), kinds=F.array_join(F.array_sort(F.split(values_unique("kind"), ",")), ",")), "kinds"), with_ev("", _map("array_to_string(list_sort(list_distinct(list(kind))), ',') AS kinds", "x", "o")))
    add("map_first_last", lambda s, d: three2(S.bed_map(x(s, d), o(s, d), first_name=first("name"), last_name=last("name")), "first_name", "last_name"),
        with_ev("", _map("list(name ORDER BY s, name)[1] AS first_name, list(name ORDER BY s, name)[-1] AS last_name", "x", "o")))
    # difference
    add("subtract", lambda s, d: three(S.bed_subtract(x(s, d), o(s, d))), with_ev(f"SELECT chrom, {SE}, name FROM d", _subtract("", "x", "o")))
    add("subtract_by_strand", lambda s, d: three(S.bed_subtract(x(s, d), o(s, d), by=["strand"])), with_ev(f"SELECT chrom, {SE}, name FROM d", _subtract(" AND x.strand = y.strand", "x", "o")))
    add("subtract_any", lambda s, d: S.bed_subtract(x(s, d), y(s, d), any=True), with_ev(f"SELECT chrom, {SE} FROM x WHERE NOT EXISTS (SELECT 1 FROM y WHERE x.chrom = y.chrom AND x.s < y.e AND y.s < x.e)"))
    # islands
    add("merge", lambda s, d: S.bed_merge(ev(s, d)), with_ev(f"SELECT chrom, {SE} FROM m", _merged("ev", "m")))
    add("merge_max_dist", lambda s, d: S.bed_merge(ev(s, d), max_dist=300), with_ev(f"SELECT chrom, {SE} FROM m", _merged("ev", "m", d=300)))
    add("merge_by_strand", lambda s, d: S.bed_merge(ev(s, d), by=["strand"]), with_ev(f"SELECT chrom, {SE}, strand FROM m", _merged("ev", "m", "chrom, strand")))
    add("merge_summary", lambda s, d: S.bed_merge(ev(s, d), n=F.count("*"), top=F.max("score"), names=concat("name")),
        with_ev('SELECT chrom, min(s) AS "start", max(e) AS "end", count(*) AS n, max(score) AS top, array_to_string(list(name ORDER BY s, name), \',\') AS names FROM i GROUP BY chrom, isl', _islands("ev")))
    for name, dist in (("cluster", 0), ("cluster_max_dist", 300)):
        add(name, lambda s, d, k=dist: plain(S.bed_cluster(ev(s, d), k)).select("chrom", "start", "end", "name", "id"), with_ev(f"SELECT chrom, {SE}, name, dense_rank() OVER (ORDER BY chrom, isl) AS id FROM i", _islands("ev", d=dist)))
    add("complement", lambda s, d: S.bed_complement(w(s, d), g(s, d)), with_ev(
        f"""SELECT chrom, {SE} FROM (SELECT chrom, coalesce(lag(e) OVER w, 0) AS s, s AS e FROM m WINDOW w AS (PARTITION BY chrom ORDER BY s) UNION ALL SELECT g.chrom, max(m.e), any_value(size) FROM m JOIN genome g ON m.chrom = g.chrom GROUP BY g.chrom
 UNION ALL SELECT chrom, 0, size FROM genome WHERE chrom NOT IN (SELECT chrom FROM m)) t WHERE s < e""", _merged("ev", "m")))
    add("spacing", lambda s, d: plain(S.interval_spacing(li(s, d).select("chrom", "start", "end").distinct())), f"WITH {_LI}, t AS (SELECT DISTINCT chrom, s, e FROM li) SELECT chrom, {SE}, s - lag(e) OVER (PARTITION BY chrom ORDER BY s, e) AS spacing FROM t")
    # sweeps
    add("genomecov", lambda s, d: plain(S.bed_genomecov(ev(s, d), g(s, d))), with_ev(f"SELECT chrom, {SE}, depth FROM sw WHERE e IS NOT NULL AND depth > 0", _depth("ev")))
    add("genomecov_by_strand", lambda s, d: plain(S.bed_genomecov(ev(s, d), g(s, d), by=["strand"])), with_ev(f"SELECT chrom, {SE}, strand, depth FROM sw WHERE e IS NOT NULL AND depth > 0", _depth("ev", "chrom, strand")))
    add("genomecov_zero_depth", lambda s, d: plain(S.bed_genomecov(w(s, d), g(s, d), zero_depth=True)), with_ev(
        f"""SELECT chrom, {SE}, depth FROM (SELECT chrom, s, e, depth FROM sw WHERE e IS NOT NULL UNION ALL SELECT chrom, 0, min(s), 0 FROM sw GROUP BY chrom UNION ALL SELECT sw.chrom, max(s), any_value(size), 0 FROM sw JOIN genome g ON sw.chrom = g.chrom GROUP BY sw.chrom
 UNION ALL SELECT chrom, 0, size, 0 FROM genome WHERE chrom NOT IN (SELECT chrom FROM sw)) t WHERE s < e""", _depth("ev")))
    add("partition", lambda s, d: S.bed_partition(ev(s, d)), with_ev(f"SELECT chrom, {SE} FROM sw WHERE e IS NOT NULL AND depth > 0", _depth("ev")))
    add("partition_summary", lambda s, d: S.bed_partition(ev(s, d), n=F.count("*"), top=F.max("score")), with_ev(
        'SELECT sw.chrom, sw.s AS "start", sw.e AS "end", count(*) AS n, max(score) AS top FROM sw JOIN ev ON sw.chrom = ev.chrom AND sw.s < ev.e AND ev.s < sw.e WHERE sw.e IS NOT NULL AND depth > 0 GROUP BY ALL', _depth("ev")))
    # transforms
    add("slop_both", lambda s, d: three(S.bed_slop(w(s, d), g(s, d), both=250)), with_ev(f"SELECT chrom, {SE}, name FROM b", _bounded("SELECT chrom, s - 250 AS s, e + 250 AS e, name FROM ev")))
    add("slop_fraction", lambda s, d: three(S.bed_slop(w(s, d), g(s, d), both=0.25, fraction=True)),
        with_ev(f"SELECT chrom, {SE}, name FROM b", _bounded("SELECT chrom, s - CAST(round_even(0.25::DOUBLE * (e - s), 0) AS BIGINT) AS s, e + CAST(round_even(0.25::DOUBLE * (e - s), 0) AS BIGINT) AS e, name FROM ev")))
    add("slop_stranded_trim", lambda s, d: three(S.bed_slop(ev(s, d), g(s, d), left=5000, right=-100, strand=True, trim=True)),
        with_ev('SELECT chrom, least(s, e) AS "start", greatest(s, e) AS "end", name FROM b', _bounded("SELECT chrom, s - CASE WHEN strand = '+' THEN 5000 ELSE -100 END AS s, e + CASE WHEN strand = '+' THEN -100 ELSE 5000 END AS e, name FROM ev", True)))
    flank = "SELECT t.chrom, f.s, f.e, name FROM ({}) t, LATERAL (SELECT t.s - t.l AS s, t.s AS e, t.l AS n UNION ALL SELECT t.e, t.e + t.r, t.r) f WHERE f.n > 0"
    inside = f"SELECT b.chrom, b.{SE.replace(' e AS', ' b.e AS')}, name FROM b JOIN genome g ON b.chrom = g.chrom WHERE b.s >= 0 AND b.e <= size"
    add("flank_both", lambda s, d: three(S.bed_flank(w(s, d), g(s, d), both=600)), with_ev(inside, "b AS (" + flank.format("SELECT *, 600 AS l, 600 AS r FROM ev") + ")"))
    part = lambda p: f"CAST(round({p}::DOUBLE * (e - s)) AS BIGINT)"
    add("flank_fraction_stranded", lambda s, d: three(S.bed_flank(ev(s, d), g(s, d), left=0.5, right=0.1, fraction=True, strand=True)),
        with_ev(inside, "b AS (" + flank.format(f"SELECT *, CASE WHEN strand = '+' THEN {part(0.5)} ELSE {part(0.1)} END AS l, CASE WHEN strand = '+' THEN {part(0.1)} ELSE {part(0.5)} END AS r FROM ev") + ")"))
    add("shift", lambda s, d: three(S.bed_shift(w(s, d), g(s, d), size=-700)), with_ev(f"SELECT chrom, {SE}, name FROM b", _bounded("SELECT chrom, s - 700 AS s, e - 700 AS e, name FROM ev")))
    half = "CAST(round_even(0.3::DOUBLE * (e - s), 0) AS BIGINT)"
    add("shift_fraction", lambda s, d: three(S.bed_shift(w(s, d), g(s, d), fraction=0.3)), with_ev(f"SELECT chrom, {SE}, name FROM b", _bounded(f"SELECT chrom, s + {half} AS s, e + {half} AS e, name FROM ev")))
    sign = "CASE WHEN strand = '-' THEN -900 ELSE 900 END"
    add("shift_stranded", lambda s, d: three(S.bed_shift(ev(s, d), g(s, d), size=900, by=["strand"])), with_ev(f"SELECT chrom, {SE}, name FROM b", _bounded(f"SELECT chrom, s + {sign} AS s, e + {sign} AS e, name FROM ev")))
    far = lambda df: df.withColumns({"start": c("start") - 50_000, "end": c("end") - 20_000})
    add("bound", lambda s, d: three(S.bound_intervals(far(ev(s, d)), g(s, d))), with_ev(f"SELECT chrom, {SE}, name FROM b", _bounded("SELECT chrom, s - 50000 AS s, e - 20000 AS e, name FROM ev")))
    add("bound_trim", lambda s, d: three(S.bound_intervals(far(ev(s, d)), g(s, d), trim=True)), with_ev(f"SELECT chrom, {SE}, name FROM b", _bounded("SELECT chrom, s - 50000 AS s, e - 20000 AS e, name FROM ev", True)))
    wins = lambda df: plain(df).select("chrom", "start", "end", "name", "win_id")
    size_sql = "w1 AS (SELECT chrom, s, e, name, {w} AS win, unnest(range(s, least(e - 1, e - {w} + {b}) + 1, {b})) AS ws FROM ev), w2 AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY ws) AS i, count(*) OVER (PARTITION BY name) AS n FROM w1)"
    tail = 'SELECT chrom, ws AS "start", CASE WHEN i = n THEN e ELSE least(ws + win, e) END AS "end", name, {} AS win_id FROM w2'
    add("makewindows_size", lambda s, d: wins(S.bed_makewindows(w(s, d), win_size=600)), with_ev(tail.format("i"), size_sql.format(w=600, b=600)))
    add("makewindows_step", lambda s, d: wins(S.bed_makewindows(w(s, d), win_size=600, step_size=250, reverse=True)), with_ev(tail.format("n - i + 1"), size_sql.format(w=600, b=250)))
    num_sql = """w0 AS (SELECT *, CAST(round((e - s) / 7) AS BIGINT) AS win FROM ev WHERE e - s >= 7), w1 AS (SELECT chrom, s, e, name, win, unnest(list_slice(range(s, least(e - 1, e) + 1, win), 1, 7)) AS ws FROM w0),
w2 AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY ws) AS i, count(*) OVER (PARTITION BY name) AS n FROM w1)"""
    add("makewindows_num", lambda s, d: wins(S.bed_makewindows(w(s, d), num_win=7)), with_ev(tail.format("i"), num_sql))
    add("flip_strands", lambda s, d: S.flip_strands(ev(s, d)).select("name", "strand"), with_ev("SELECT name, CASE WHEN strand = '+' THEN '-' ELSE '+' END AS strand FROM ev"))
    add("sort_by_size", lambda s, d: S.bed_sort(w(s, d), by_size=True, by_chrom=True).select("chrom", "start", "end", "name"), with_ev(f"SELECT chrom, {SE}, name FROM ev ORDER BY chrom, e - s"))
    add("sort", lambda s, d: S.bed_sort(li(s, d)).select("chrom", "start", "end", "name"), f"WITH {_LI} SELECT chrom, {SE}, name FROM li ORDER BY chrom, s, e")
    # features
    with_genes = lambda tail: f"WITH {_GENES} {tail}"
    add("exons", lambda s, d: S.bed12_to_exons(genes(s, d)), with_genes(f"SELECT chrom, {SE}, name, CASE WHEN strand = '-' THEN n - i + 1 ELSE i END AS score, strand FROM exon"))
    add("introns", lambda s, d: S.create_introns(genes(s, d)), with_genes(
        'SELECT chrom, e AS "start", nx AS "end", name, CASE WHEN strand = \'+\' THEN i ELSE n - i END AS score, strand FROM (SELECT *, lead(s) OVER (PARTITION BY name ORDER BY s, e) AS nx FROM exon) t WHERE e < nx'))
    utr = "SELECT chrom, s AS \"start\", e AS \"end\", name, score, strand FROM (SELECT chrom, CASE WHEN strand = '{p}' THEN s ELSE ce END AS s, CASE WHEN strand = '{p}' THEN cs ELSE e END AS e, name, score, strand FROM gene) t WHERE s < e"
    add("utrs5", lambda s, d: S.create_utrs5(genes(s, d)), with_genes(utr.format(p="+")))
    add("utrs3", lambda s, d: S.create_utrs3(genes(s, d)), with_genes(utr.format(p="-")))
    add("tss", lambda s, d: S.create_tss(genes(s, d)), with_genes("SELECT chrom, CASE WHEN strand = '+' THEN s ELSE e - 1 END AS \"start\", CASE WHEN strand = '+' THEN s + 1 ELSE e END AS \"end\", name, score, strand FROM gene"))
    # statistics
    mids = "xm AS (SELECT *, (s + e) // 2 AS m FROM x), ym AS (SELECT *, (s + e) // 2 AS m FROM y)"
    add("absdist", lambda s, d: plain(S.bed_absdist(x(s, d), y(s, d), g(s, d))).select("name", "absdist", F.round("absdist_scaled", 6).alias("absdist_scaled")), with_ev(
        """SELECT xm.name, min(abs(xm.m - ym.m)) AS absdist, round(min(abs(xm.m - ym.m)) * (count(ym.m) / any_value(size)), 6) AS absdist_scaled FROM xm LEFT JOIN ym ON xm.chrom = ym.chrom LEFT JOIN genome g ON g.chrom = xm.chrom GROUP BY xm.name""", mids))
    rel = f"{mids}, n AS (SELECT xm.name, xm.m, max(CASE WHEN ym.m < xm.m THEN ym.m END) AS l, min(CASE WHEN ym.m >= xm.m THEN ym.m END) AS r FROM xm JOIN ym ON xm.chrom = ym.chrom GROUP BY ALL), rd AS (SELECT name, CAST(CAST(least(m - l, r - m) AS FLOAT) / CAST(r - l AS FLOAT) AS FLOAT)::DOUBLE AS reldist FROM n WHERE l IS NOT NULL AND r IS NOT NULL)"
    add("reldist_detail", lambda s, d: plain(S.bed_reldist(x(s, d), y(s, d), detail=True)).select("name", F.round("reldist", 6).alias("reldist")), with_ev("SELECT name, round(reldist, 6) AS reldist FROM rd", rel))
    add("reldist", lambda s, d: plain(S.bed_reldist(x(s, d), y(s, d))).withColumn("freq", F.round("freq", 6)),
        with_ev("SELECT floor(reldist * 100) / 100 AS reldist, count(*) AS counts, (SELECT count(*) FROM rd) AS total, round(count(*) / (SELECT count(*) FROM rd), 6) AS freq FROM rd GROUP BY 1", rel))
    jac = f"{_merged('x', 'mx')}, {_merged('o', 'mo')}, p AS (SELECT mx.chrom, least(mx.e, mo.e) - greatest(mx.s, mo.s) AS ov FROM mx JOIN mo ON mx.chrom = mo.chrom AND least(mx.e, mo.e) - greatest(mx.s, mo.s) >= 0)"
    total = lambda t, on="": f"(SELECT CAST(sum(e - s) AS BIGINT) FROM {t}{on})"
    add("jaccard", lambda s, d: S.bed_jaccard(x(s, d), o(s, d)).withColumn("jaccard", F.round("jaccard", 6)),
        with_ev(f"SELECT CAST(sum(ov) AS BIGINT) AS len_i, {total('mx')} + {total('mo')} AS len_u, round(sum(ov) / ({total('mx')} + {total('mo')} - sum(ov)), 6) AS jaccard, count(*) AS n FROM p", jac))
    add("jaccard_by_chrom", lambda s, d: S.bed_jaccard(x(s, d), o(s, d), by=["chrom"]).withColumn("jaccard", F.round("jaccard", 6)), with_ev(
        "SELECT chrom, CAST(li AS BIGINT) AS len_i, CAST(u AS BIGINT) AS len_u, round(li / (u - li), 6) AS jaccard, n FROM (SELECT p.chrom, sum(ov) AS li, count(*) AS n, (SELECT sum(e - s) FROM mx WHERE mx.chrom = p.chrom) + (SELECT sum(e - s) FROM mo WHERE mo.chrom = p.chrom) AS u FROM p GROUP BY p.chrom) t", jac))
    add("fisher_counts", lambda s, d: fisher_counts(x(s, d), o(s, d), g(s, d)), with_ev(
        f"SELECT (SELECT count(*) FROM x) AS n_x, (SELECT count(*) FROM o) AS n_y, {total('mx')} AS bases_x, {total('mo')} AS bases_y, (SELECT count(*) FROM x JOIN o ON x.chrom = o.chrom AND least(x.e, o.e) - greatest(x.s, o.s) >= 0) AS n_i, (SELECT CAST(sum(size) AS BIGINT) FROM genome) AS genome_size", f"{_merged('x', 'mx')}, {_merged('o', 'mo')}"))
    add("fisher", lambda s, d: plain(S.bed_fisher(x(s, d), o(s, d), g(s, d))), None)
    add("projection_counts", lambda s, d: projection_counts(x(s, d), o(s, d), g(s, d)), with_ev(
        "SELECT px.chrom, (SELECT count(*) FROM px a JOIN mo ON a.chrom = mo.chrom AND least(a.m + 1, mo.e) - greatest(a.m, mo.s) >= 0 WHERE a.chrom = px.chrom) AS obs_counts, count(*) AS total_trials, (SELECT CAST(sum(e - s) AS BIGINT) FROM mo WHERE mo.chrom = px.chrom) AS reference_coverage, any_value(size) AS size FROM px JOIN genome g ON px.chrom = g.chrom GROUP BY px.chrom",
        f"{_merged('o', 'mo')}, px AS (SELECT chrom, CAST(round_even((s + e) / 2, 0) AS BIGINT) AS m FROM x)"))
    add("projection", lambda s, d: plain(S.bed_projection(x(s, d), o(s, d), g(s, d), by_chrom=True)), None)
    # randomising and files
    add("random", lambda s, d: S.bed_random(s, g(s, d), length=500, n=20_000, seed=7), None)
    add("shuffle", lambda s, d: S.bed_shuffle(x(s, d), g(s, d), excl=y(s, d), seed=7, keep_unplaced=True), None)
    add("bed_roundtrip", _bed_roundtrip, with_ev(f"SELECT chrom, {SE}, CAST(name AS VARCHAR) AS name, CAST(score AS DOUBLE) AS score, strand FROM ev"))
    add("bedgraph_roundtrip", _bedgraph_roundtrip, with_ev(f"SELECT chrom, {SE}, score AS value FROM ev"))
    add("genome_roundtrip", _genome_roundtrip, with_ev("SELECT chrom, size FROM genome"))
    add("bed12_roundtrip", _bed12_roundtrip, with_genes(
        """SELECT g.chrom, g.s AS "start", g.e AS "end", g.name, g.score, g.strand, cs AS cds_start, ce AS cds_end, '0' AS item_rgb, CAST(count(*) AS INTEGER) AS exon_count,
 string_agg(CAST(x.e - x.s AS VARCHAR), ',' ORDER BY x.s, x.e) AS exon_sizes, string_agg(CAST(x.s - g.s AS VARCHAR), ',' ORDER BY x.s, x.e) AS exon_starts FROM gene g JOIN exon x ON g.name = x.name GROUP BY ALL"""))
    peak = f"SELECT chrom, {SE}, CAST(name AS VARCHAR) AS name, CAST(floor(score) AS INTEGER) AS score, strand, score AS signal, -1.0::DOUBLE AS pvalue, 0.5::DOUBLE AS qvalue"
    add("narrowpeak_roundtrip", lambda s, d: _peaks(s, d, S.read_narrowpeak, 10), with_ev(f"{peak}, 7 AS peak FROM ev"))
    add("broadpeak_roundtrip", lambda s, d: _peaks(s, d, S.read_broadpeak, 9), with_ev(f"{peak} FROM ev"))
    add("vcf_roundtrip", _vcf_roundtrip, f"""WITH {_LI} SELECT s AS POS, CAST(name AS VARCHAR) AS ID, repeat('A', 1 + (e - s) % 5) AS REF, flag AS ALT, 'chr' || substr(chrom, 2) AS chrom, s AS "start", s + 1 + (e - s) % 5 AS "end" FROM li""")
    add("flagship", _flagship, with_ev("""SELECT chrom, s AS start_x, e AS end_x, name AS name_x, ny AS name_y, dist FROM cfound JOIN dd USING (id) WHERE abs(dist) < 86400""", _subtract("", "x", "y") + """,
dd AS (SELECT row_number() OVER () AS id, * FROM d),
cp AS (SELECT dd.id, z.name AS ny, least(dd.e, z.e) - greatest(dd.s, z.s) AS ov, z.e <= dd.s AS up, CASE WHEN z.e <= dd.s THEN dd.s - z.e WHEN z.s >= dd.e THEN z.s - dd.e END AS gap FROM dd JOIN z ON dd.chrom = z.chrom),
cnear AS (SELECT *, rank() OVER (PARTITION BY id ORDER BY gap) AS k FROM cp WHERE gap IS NOT NULL),
cfound AS (SELECT id, ny, CASE WHEN ov > 0 THEN 0 WHEN up THEN -1 ELSE 1 END AS dist FROM cp WHERE ov >= 0 UNION ALL SELECT id, ny, CASE WHEN up THEN -(gap + 1) ELSE gap + 1 END FROM cnear WHERE k = 1 AND gap > 0)"""))
    return q


def three2(df: DataFrame, *more: str) -> DataFrame:
    return df.select("chrom", "start", "end", "name", *more)


def _scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one that the session names; on one machine, where none is named, below a temporary one."""
    import tempfile
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        base = tempfile.mkdtemp(prefix="spanloom-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _bed_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _scratch(spark, "bed")
    write_bed(ev(spark, sf_dir), path)
    return read_bed(spark, path, sort=False).withColumn("score", F.col("score").cast("double"))


def _bedgraph_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _scratch(spark, "bedgraph")
    write_bedgraph(ev(spark, sf_dir).withColumn("value", F.col("score")), path)
    return read_bedgraph(spark, path)


def _genome_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _scratch(spark, "genome")
    genome(ev(spark, sf_dir)).select("chrom", "size").write.option("sep", "\t").csv(path)
    return S.read_genome(spark, path)


def _bed12_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _scratch(spark, "bed12")
    write_bed(genes(spark, sf_dir), path)
    return S.read_bed12(spark, path)


def _peaks(spark: SparkSession, sf_dir: str, reader: Callable, fields: int) -> DataFrame:
    """All events as a peak file of so many fields, read again."""
    path = _scratch(spark, "peaks")
    cols = ["chrom", "start", "end", "name", F.floor("score").cast("int"), "strand", "score", F.lit(-1.0), F.lit(0.5), F.lit(7)][:fields]
    ev(spark, sf_dir).select(F.concat_ws("\t", *(F.col(n).cast("string") if isinstance(n, str) else n.cast("string") for n in cols))).write.text(path)
    return reader(spark, path)


def _vcf_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _scratch(spark, "vcf")
    t = li(spark, sf_dir)
    row = F.concat_ws("\t", F.substring("chrom", 2, 9), F.col("start").cast("string"), F.col("name").cast("string"), F.expr("repeat('A', int(1 + (`end` - `start`) % 5))"), "flag")
    head = spark.createDataFrame([("##fileformat=VCFv4.2",), ("#CHROM\tPOS\tID\tREF\tALT",)], "value string")
    head.unionAll(t.select(row.alias("value"))).write.text(path)
    return S.read_vcf(spark, path)


def _flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks outside purchases, their nearest error, within a day."""
    left = S.bed_subtract(ev(spark, sf_dir, "click"), ev(spark, sf_dir, "purchase"))
    near = plain(S.bed_closest(left, ev(spark, sf_dir, "error")))
    return near.where(F.abs("dist") < 86_400).select("chrom", "start_x", "end_x", "name_x", "name_y", "dist")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: fn for k, (fn, _) in _table().items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _table().items() if sql}
