"""Two-table verbs: intersect, window, closest, coverage, map, subtract.

Rows are related by their coordinates and group keys, never by generated row numbers, so results don't depend on the order in
which a recomputed partition delivers its rows. Group keys compare null-safely.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.islands import islands, merged
from ..plans.nearest import around
from ..plans.overlap import overlap_pairs
from ..plans.running import chunk_width, running
from ..schema import c, check_interval, group_keys, join_on
from ..sources.bed import is_bigbed_path, is_bigwig_path
from .transform import bed_slop


def _opened(x: DataFrame, y: DataFrame | str, regions: bool = True) -> DataFrame:
    """``y``, or the entries of the bigWig or bigBed file that it names: with ``regions`` those that overlap ``x``."""
    if not isinstance(y, str):
        return y
    if not (is_bigwig_path(y) or is_bigbed_path(y)):
        raise ValueError(f"neither a table nor a bigWig or bigBed path: {y}")
    from ..sources.bigbinary import read_bigbed, read_bigwig, read_bigwig_regions

    if regions:
        return read_bigwig_regions(x.sparkSession, y, check_interval(x))
    return (read_bigwig if is_bigwig_path(y) else read_bigbed)(x.sparkSession, y)


def _sources(x: DataFrame, ys: tuple, named: dict, regions: bool) -> tuple[DataFrame, bool]:
    """All y tables (or bigWig and bigBed paths) as one, with ``.source`` if there are several."""
    tables: dict[str, DataFrame | str] = {}
    for i, y in enumerate(ys):
        if isinstance(y, dict):
            tables |= y
        elif isinstance(y, (list, tuple)):
            tables |= {str(len(tables) + k + 1): t for k, t in enumerate(y)}
        else:
            tables[str(len(tables) + 1)] = y
    tables |= named
    if not tables:
        raise ValueError("no y table")
    tables = {k: check_interval(_opened(x, t, regions)) for k, t in tables.items()}
    if len(tables) == 1:
        return next(iter(tables.values())), False
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (t.withColumn(".source", F.lit(k)) for k, t in tables.items())), True


def bed_intersect(
    x: DataFrame, *ys: DataFrame | str, by: Sequence[str] | None = None, invert: bool = False, suffix: tuple[str, str] = (".x", ".y"),
    min_overlap: int = 1, bin_size: int | None = None, **named: DataFrame | str,
) -> DataFrame:
    """Pairs of x and y rows that overlap by ``min_overlap`` at least; with ``invert``, the x rows without one.

    A y table may be the path of a bigWig or bigBed file, here and in window, map, coverage and subtract.
    Several y tables (arguments, keywords, lists or dicts) are told apart by ``.source``.
    """
    x = check_interval(x)
    y, several = _sources(x, ys, named, min_overlap > 0)
    keys = group_keys(x, by, y)
    if invert:
        at = [*keys, "start", "end"]
        probes, others = x.select(*map(c, at)).distinct(), y.select(*map(c, at)).distinct()
        hit = overlap_pairs(probes, others, keys, min_overlap, bin_size)
        hit = hit.select("chrom", *(c(f"{k}.x").alias(k) for k in at[1:])).distinct()
        return join_on(x, hit, at, "left_anti")
    out = overlap_pairs(x, y, keys, min_overlap, bin_size, suffix)
    if several:
        own = ".source" + suffix[1]
        out = out.select(*(c(n) for n in out.columns if n != own), c(own).alias(".source"))
    return out


def bed_window(
    x: DataFrame, y: DataFrame | str, genome: DataFrame, by: Sequence[str] | None = None, both: float = 0, left: float = 0, right: float = 0,
    fraction: bool = False, strand: bool = False, trim: bool = False, suffix: tuple[str, str] = (".x", ".y"), min_overlap: int = 1, bin_size: int | None = None,
) -> DataFrame:
    """Pairs of y rows with x rows widened by ``both`` or ``left``/``right``; x keeps its own coordinates, ``.overlap`` is that of the widened."""
    x = check_interval(x).withColumns({"__start": c("start"), "__end": c("end")})
    wide = bed_slop(x, genome, both=both, left=left, right=right, fraction=fraction, strand=strand, trim=trim)
    out = bed_intersect(wide, y, by=by, suffix=suffix, min_overlap=min_overlap, bin_size=bin_size)
    sx = suffix[0]
    out = out.withColumns({"start" + sx: c("__start" + sx), "end" + sx: c("__end" + sx)})
    return out.drop("__start" + sx, "__end" + sx)


def bed_closest(
    x: DataFrame, y: DataFrame, by: Sequence[str] | None = None, overlap: bool = True, suffix: tuple[str, str] = (".x", ".y"), bin_size: int | None = None
) -> DataFrame:
    """Overlapping and touching y rows of each x row, and the nearest separate ones with all ties.

    ``.dist`` is 0 for an overlap, else the distance, negative where y is upstream. x rows whose group y lacks have null y columns.
    Without ``overlap`` the true overlaps and the column ``.overlap`` go.
    """
    x, y = check_interval(x), check_interval(y)
    keys = group_keys(x, by, y)
    sx, sy = suffix
    up = c("end" + sy) <= c("start" + sx)
    if overlap:
        met = overlap_pairs(x, y, keys, 0, bin_size, suffix)
    else:  # rows that touch are found by their edges below; only empty rows meet others without that, inside them
        empty = c("start") == c("end")
        met = overlap_pairs(x.where(empty), y.where(~empty), keys, 0, bin_size, suffix).unionByName(overlap_pairs(x.where(~empty), y.where(empty), keys, 0, bin_size, suffix))
        met = met.where((c("start" + sy) < c("end" + sx)) & (c("start" + sx) < c("end" + sy)))
    met = met.withColumn(".dist", F.when(c(".overlap") > 0, 0).otherwise(F.when(up, -1).otherwise(1)).cast("long"))
    best = around(x, y, keys)
    gu, gd = F.col("start") - F.col("up"), F.col("dn") - F.col("end")
    g = F.least(gu, gd)
    # the nearer side, or both, as rows; every y row stands at both of its edges: one join finds all ties
    sides = F.array(F.when(gu == g, F.struct(F.lit(-1).alias("s"), F.col("up").alias("e"))), F.when(gd == g, F.struct(F.lit(1).alias("s"), F.col("dn").alias("e"))))
    at = [*keys, "start", "end"]
    best = best.where(g > 0 if overlap else g >= 0).select(*(c(k).alias(f"__n_{k}") for k in at), (g + 1).alias("__g"), F.explode(sides).alias("__side")).where("__side is not null")
    best = best.select(*(c(f"__n_{k}") for k in at), "__g", F.col("__side.s").alias("__s"), F.col("__side.e").alias("__e"))
    others = [n for n in y.columns if n != "chrom"]
    edges = F.array(F.struct(F.lit(-1).alias("s"), c("end").alias("e")), F.struct(F.lit(1).alias("s"), c("start").alias("e")))
    y_side = y.withColumn("__edge", F.explode(edges)).select(*(c(k).alias(f"__k_{k}") for k in keys), *(c(n).alias(n + sy) for n in others), F.col("__edge.s").alias("__ys"), F.col("__edge.e").alias("__ye"))
    match = reduce(lambda a, k: a & c(f"__n_{k}").eqNullSafe(c(f"__k_{k}")), keys, (c("__s") == c("__ys")) & (c("__e") == c("__ye")))
    near = best.join(y_side, match)
    if not overlap:  # equal empty rows touch on both sides: once, upstream
        near = near.where((c("__s") < 0) | (c("end" + sy) > c("__n_start")))
    near = near.select(*(c(f"__n_{k}") for k in at), *(c(n + sy) for n in others), (c("__g") * c("__s")).alias(".dist"))
    x_side = x.select(*(c(k).alias(f"__k_{k}") for k in at), "chrom", *(c(n).alias(n + sx) for n in x.columns if n != "chrom"))
    both = reduce(lambda a, k: a & c(f"__k_{k}").eqNullSafe(c(f"__n_{k}")), at[1:], c("__k_chrom").eqNullSafe(c("__n_chrom")))
    near = x_side.join(near, both).withColumn(".overlap", F.lit(0).cast("long")).select(*map(c, met.columns))
    alone = join_on(x, y.select(*map(c, keys)).distinct(), keys, "left_anti").select("chrom", *(c(n).alias(n + sx) for n in x.columns if n != "chrom"))
    out = met.unionByName(near).unionByName(alone, allowMissingColumns=True)
    return out if overlap else out.drop(".overlap")


def bed_map(
    x: DataFrame, y: DataFrame | str, by: Sequence[str] | None = None, min_overlap: int = 1, bin_size: int | None = None, x_columns: Sequence[str] = (), **exprs: Column
) -> DataFrame:
    """``x`` with aggregates of the y rows that overlap it; null where none does.

    Expressions name y columns as they are and x columns (chrom, start, end, keys and ``x_columns``) with ``.x``.
    """
    x = check_interval(x)
    y = check_interval(_opened(x, y, min_overlap > 0))
    keys = group_keys(x, by, y)
    if not exprs:
        raise ValueError("no expression to aggregate the overlapping rows with")
    at = list(dict.fromkeys([*keys, "start", "end", *x_columns]))
    pairs = overlap_pairs(x.select(*map(c, at)).distinct(), y, keys, min_overlap, bin_size, (".x", ""))
    found = pairs.withColumn("chrom.x", c("chrom")).groupBy(*(c("chrom").alias("__k_chrom") if k == "chrom" else c(k + ".x").alias(f"__k_{k}") for k in at))
    found = found.agg(*(e.alias(n) for n, e in exprs.items())).withColumnsRenamed({f"__k_{k}": k for k in at})
    if clash := set(exprs) & set(x.columns):
        raise ValueError(f"columns already in x: {', '.join(sorted(clash))}")
    return join_on(x, found, at, "left")


def bed_coverage(x: DataFrame, y: DataFrame | str, by: Sequence[str] | None = None, min_overlap: int = 1, bin_size: int | None = None) -> DataFrame:
    """``x`` with ``.ints`` (overlapping y rows), ``.cov`` (bases under their union), ``.len`` and ``.frac``."""
    x = check_interval(x)
    y = check_interval(_opened(x, y, min_overlap > 0))
    keys = group_keys(x, by, y)
    at = [*keys, "start", "end"]
    mine = ["chrom", *(k + ".x" for k in at[1:])]
    probes, others = x.select(*map(c, at)).distinct(), y.select(*map(c, at))
    per_x = [c(m).alias(f"__k_{k}") for m, k in zip(mine, at, strict=True)]
    back = [c(f"__k_{k}").alias(k) for k in at]
    pairs = overlap_pairs(probes, others, keys, min_overlap, bin_size)
    if min_overlap <= 1:  # what covers x is what the merged y share with it: two sums, no window over an x interval's rows
        ints = pairs.groupBy(*per_x).agg(F.count("*").alias(".ints")).select(*back, c(".ints"))
        cov = overlap_pairs(probes, merged(others, keys), keys, 1, bin_size).groupBy(*per_x).agg(F.sum(c(".overlap")).alias(".cov")).select(*back, c(".cov"))
        total = join_on(ints, cov, at, "left")
    else:  # which y rows count depends on x: their parts inside one x interval form islands
        clipped = pairs.select(*per_x, F.greatest("`start.x`", "`start.y`").alias("start"), F.least("`end.x`", "`end.y`").alias("end"))
        per = islands(clipped, [f"__k_{k}" for k in at], 0, width=0)
        each = per.groupBy(*(c(f"__k_{k}") for k in at), "__island").agg(F.count("*").alias("n"), (F.max("end") - F.min("start")).alias("cov"))
        total = each.groupBy(*(c(f"__k_{k}").alias(k) for k in at)).agg(F.sum("n").alias(".ints"), F.sum("cov").alias(".cov"))
    out = join_on(x, total, at, "left")
    zero = lambda n: F.coalesce(c(n), F.lit(0).cast("long"))
    out = out.withColumns({".ints": zero(".ints"), ".cov": zero(".cov"), ".len": c("end") - c("start")})
    return out.withColumn(".frac", F.when(c(".len") != 0, c(".cov") / c(".len")))


def bed_subtract(x: DataFrame, y: DataFrame | str, by: Sequence[str] | None = None, any: bool = False, min_overlap: int = 1, bin_size: int | None = None) -> DataFrame:
    """The parts of x rows that no y row (overlapping by ``min_overlap``) covers; with ``any``, the coordinates of x rows without overlap."""
    x = check_interval(x)
    y = check_interval(_opened(x, y, min_overlap > 0))
    keys = group_keys(x, by, y)
    if any:
        return bed_intersect(x, y, by=by, invert=True, min_overlap=min_overlap, bin_size=bin_size).select("chrom", "start", "end")
    at = [*keys, "start", "end"]
    mine = ["chrom", *(k + ".x" for k in at[1:])]
    probes = x.select(*map(c, at)).distinct()
    if min_overlap == 1:  # merged y don't meet: each knows its neighbours, and no window over an x interval's rows is needed
        gone = merged(y.where(c("start") < c("end")).select(*map(c, at)), keys)
        gone = running(gone, keys, ["start"], {"__prev": ("prev", c("end")), "__next": ("next", c("start"))}, chunk_width(gone, keys, "start"))
        cut = pairs = overlap_pairs(probes, gone, keys, 1, bin_size)
        before, after = F.greatest(c("start.x"), c("__prev.y")), c("end.y")
        last = c("__next.y").isNull() | (c("__next.y") >= c("end.x"))
    else:
        pairs = overlap_pairs(probes, y.select(*map(c, at)).distinct(), keys, min_overlap, bin_size)
        w = Window.partitionBy(*map(c, mine)).orderBy("`start.y`", "`end.y`")
        seen = F.greatest(F.max("`end.y`").over(w.rowsBetween(Window.unboundedPreceding, -1)), c("start.x"))
        cut = pairs.withColumns({"__from": seen, "__last": F.lead(F.lit(True)).over(w).isNull()})
        before, after, last = c("__from"), F.greatest("__from", c("end.y")), c("__last")
    pieces = F.array(F.struct(before.alias("s"), F.least("`start.y`", "`end.x`").alias("e")), F.when(last, F.struct(after.alias("s"), c("end.x").alias("e"))))
    cut = cut.select(*(c(m).alias(k) for m, k in zip(mine, at, strict=True)), F.explode(pieces).alias("__p")).where("__p is not null and __p.s < __p.e")
    touched = pairs.select(*(c(m).alias(k) for m, k in zip(mine, at, strict=True))).distinct()
    parts = join_on(x, cut, at).withColumns({"start": F.col("__p.s"), "end": F.col("__p.e")}).select(*map(c, x.columns))
    return join_on(x, touched, at, "left_anti").unionByName(parts)
