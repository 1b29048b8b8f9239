"""Single-table verbs on coordinates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.running import chunk_width, running
from ..schema import c, check_genome, check_interval


def with_size(x: DataFrame, genome: DataFrame, how: str = "inner") -> DataFrame:
    """``x`` with the chromosome's __size. A genome has a row per chromosome; Spark broadcasts it while it is small."""
    g = check_genome(genome, unique=False).select(F.col("chrom").alias("__gchrom"), F.col("size").alias("__size"))
    return x.join(g, c("chrom") == c("__gchrom"), how).drop("__gchrom")


def bound_intervals(x: DataFrame, genome: DataFrame, trim: bool = False) -> DataFrame:
    """Rows inside their chromosomes; with ``trim``, rows are cut to them and empty ones go. Unknown chromosomes go."""
    x = with_size(check_interval(x), genome)
    s, e, size = c("start"), c("end"), c("__size")
    if not trim:
        return x.where((s >= 0) & (s < size) & (e <= size) & (e > 0)).drop("__size")
    x = x.withColumns({"start": F.when(s < 0, F.lit(0)).otherwise(F.least(s, size - 1)), "end": F.when(e > size, size).otherwise(F.greatest(F.lit(1), e))})
    return x.where(s != e).drop("__size")


def _sides(both: float, left: float, right: float) -> tuple[float, float]:
    if both and (left or right):
        raise ValueError("ambiguous side spec for slop: both with left or right")
    return (both, both) if both else (left, right)


def _strand(x: DataFrame, strand: bool) -> Column:
    if strand and "strand" not in x.columns:
        raise ValueError("expected a strand column")
    return (c("strand") == "+") if strand else F.lit(True)


def bed_slop(
    x: DataFrame, genome: DataFrame, both: float = 0, left: float = 0, right: float = 0, fraction: bool = False, strand: bool = False, trim: bool = False
) -> DataFrame:
    """Grow (negative: shrink) rows at both, left or right sides, or by fractions of their length; bounded by the genome."""
    x = check_interval(x)
    if not (both or left or right):
        raise ValueError("specify one of both, left, right")
    swap = bool(strand) and not both
    plus = _strand(x, strand)
    left, right = _sides(both, left, right)
    size = lambda p: F.bround(F.lit(float(p)) * (c("end") - c("start"))).cast("long") if fraction else F.lit(p)
    lo, hi = size(left), size(right)
    low = F.when(plus, lo).otherwise(hi) if swap else lo
    high = F.when(plus, hi).otherwise(lo) if swap else hi
    out = x.withColumns({"start": (c("start") - low).cast("long"), "end": (c("end") + high).cast("long")})
    out = bound_intervals(out, genome, trim)
    return out.withColumns({"start": F.least("start", "end"), "end": F.greatest("start", "end")})


def bed_flank(
    x: DataFrame, genome: DataFrame, both: float = 0, left: float = 0, right: float = 0, fraction: bool = False, strand: bool = False, trim: bool = False
) -> DataFrame:
    """The regions left and right of each row; those that leave the genome go, or are cut with ``trim``."""
    x = check_interval(x)
    if not max(both, left, right) > 0:
        raise ValueError("specify one of both, left, right")
    plus = _strand(x, strand)
    left, right = _sides(both, left, right)
    size = lambda p: F.round(F.lit(float(p)) * (c("end") - c("start"))).cast("long") if fraction else F.lit(int(p)).cast("long")
    x = with_size(x, genome, "left").withColumns(
        {"__size": F.coalesce("__size", F.lit(0)), "__l": F.when(plus, size(left)).otherwise(size(right)), "__r": F.when(plus, size(right)).otherwise(size(left))}
    )
    sides = F.array(
        F.struct((c("start") - c("__l")).alias("s"), c("start").alias("e"), c("__l").alias("n")),
        F.struct(c("end").alias("s"), (c("end") + c("__r")).alias("e"), c("__r").alias("n")),
    )
    names = [n for n in x.columns if not n.startswith("__")]
    out = x.withColumn("__p", F.explode(sides)).where("__p.n > 0")
    s, e = F.col("__p.s"), F.col("__p.e")
    if trim:
        s, e = F.greatest(s, F.lit(0)), F.least(e, c("__size"))
        out = out.where(s < e)
    else:
        out = out.where((s >= 0) & (e <= c("__size")))
    return out.select(*({"start": s.alias("start"), "end": e.alias("end")}.get(n, c(n)) for n in names))


def bed_shift(x: DataFrame, genome: DataFrame, size: int = 0, fraction: float = 0, trim: bool = False, stranded: bool = False, by: Sequence[str] | None = None) -> DataFrame:
    """Move rows by ``size`` or a fraction of their length; with ``stranded`` (or by strand), ``-`` rows move back."""
    x = check_interval(x)
    stranded = stranded or "strand" in (by or [])
    step = F.bround((c("end") - c("start")) * F.lit(float(fraction))).cast("long") if fraction else F.lit(int(size)).cast("long")
    if stranded:
        _strand(x, True)
        step = F.when(c("strand") == "-", -step).otherwise(step)
    x = x.withColumn("__d", step)
    out = x.withColumns({"start": c("start") + c("__d"), "end": c("end") + c("__d")}).drop("__d")
    return bound_intervals(out, genome, trim)


def flip_strands(x: DataFrame) -> DataFrame:
    """``+`` becomes ``-``, everything else ``+``; strand moves last."""
    _strand(x, True)
    rest = [c(n) for n in x.columns if n != "strand"]
    return x.select(*rest, F.when(c("strand") == "+", "-").otherwise("+").alias("strand"))


def bed_makewindows(x: DataFrame, win_size: int = 0, step_size: int = 0, num_win: int = 0, reverse: bool = False) -> DataFrame:
    """Windows of a size (and step), or a number of windows, inside each row; ``.win_id`` counts from 1, or down with ``reverse``."""
    x = check_interval(x)
    if win_size == 0 and num_win == 0:
        raise ValueError("specify either win_size or num_win")
    if win_size < 0 or step_size < 0 or num_win < 0:
        raise ValueError("provide positive values for win_size, step_size and num_win")
    length = c("end") - c("start")
    if num_win:
        x = x.where(length >= num_win).withColumn("__win", F.round(length / num_win).cast("long")).withColumn("__by", c("__win"))
    else:
        x = x.withColumns({"__win": F.lit(int(win_size)).cast("long"), "__by": F.lit(int(step_size or win_size)).cast("long")})
    stop = F.least(c("end") - 1, c("end") - c("__win") + c("__by"))
    starts = F.when(stop >= c("start"), F.sequence(c("start"), stop, c("__by"))).otherwise(F.array().cast("array<bigint>"))
    x = x.withColumn("__starts", F.slice(starts, 1, num_win) if num_win else starts)
    names = [n for n in x.columns if not n.startswith("__")]
    x = x.select(*map(c, names), "__win", F.size("__starts").alias("__n"), F.posexplode("__starts").alias("__i", "__s"))
    last = c("__i") == c("__n") - 1
    end = F.when(last, c("end")).otherwise(F.least(c("__s") + c("__win"), c("end")))
    number = (c("__n") - c("__i")) if reverse else (c("__i") + 1)
    return x.select(*({"start": c("__s").alias("start"), "end": end.alias("end")}.get(n, c(n)) for n in names), number.cast("long").alias(".win_id"))


def interval_spacing(x: DataFrame, width: int | None = None) -> DataFrame:
    """``.spacing``: distance from the end of the row before on the chromosome; null for the first, negative for overlaps."""
    x = check_interval(x)
    width = chunk_width(x, ["chrom"], "start") if width is None else width
    out = running(x, ["chrom"], ["start", "end"], {"__prev": ("prev", c("end"))}, width)
    return out.withColumn(".spacing", c("start") - c("__prev")).drop("__prev")


def bed_sort(x: DataFrame, by_size: bool = False, by_chrom: bool = False, reverse: bool = False) -> DataFrame:
    """Order by chrom, start, end; by size; or by size inside chromosomes. ``reverse`` turns start or size around."""
    x = check_interval(x)
    size = c("end") - c("start")
    turn = lambda e: e.desc_nulls_last() if reverse else e.asc_nulls_last()
    chrom = c("chrom").asc_nulls_last()
    if by_size:
        return x.orderBy(*([chrom] if by_chrom else []), turn(size))
    return x.orderBy(chrom, turn(c("start")), *([] if reverse else [c("end").asc_nulls_last()]))
