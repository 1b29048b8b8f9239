"""Overlap join as an equi-join on bins.

Both sides are exploded into the bins they touch and joined on (chromosome, keys, level, bin); a pair is kept in the later of its
two first bins only, so nothing is deduplicated. The bin is chosen from the lengths in one small job. Long intervals go to coarser
levels (each 8 bins of the one below), so no interval makes more than 9 rows per level; a pair meets at the coarser of its levels.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import c, same

#: Bins of its own level that an interval may touch, as a power of two.
WIDE = 3


def pick_bins(x: DataFrame, y: DataFrame, bin_size: int | None = None) -> tuple[int, int]:
    """Bits of the bin width and the coarsest level, from the median and maximum lengths."""
    length = lambda df: df.select((F.col("end") - F.col("start")).alias("n"), F.lit(df is x).alias("left"))
    rows = length(x).unionAll(length(y)).groupBy("left").agg(F.approx_percentile("n", 0.5, 100).alias("mid"), F.max("n").alias("top")).collect()  # two rows
    mid, top = max([1, *(r.mid or 1 for r in rows)]), max([1, *(r.top or 1 for r in rows)])
    bits = round(math.log2(bin_size)) if bin_size else min(22, max(8, math.ceil(math.log2(2 * mid))))
    return bits, max(0, math.ceil((math.log2(top) - bits - WIDE) / WIDE))


def bin_rows(df: DataFrame, start: str, end: str, bits: int, levels: int, closed: bool, side: str) -> DataFrame:
    """``df`` exploded with __level, __bin and, per side, the own level."""
    s, e = c(start), c(end)
    last = F.greatest(e, s) if closed else F.greatest(e - 1, s)
    shift = F.lit(bits)
    if levels:
        own = F.lit(levels)
        for k in range(levels - 1, -1, -1):
            own = F.when(e - s <= 1 << (bits + WIDE * (k + 1)), k).otherwise(own)
        df = df.withColumn(f"__own_{side}", own).withColumn("__level", F.explode(F.sequence(c(f"__own_{side}"), F.lit(levels))))
        shift = shift + WIDE * c("__level")
    return df.withColumn("__bin", F.explode(F.sequence(down(s, shift), down(last, shift))))


def down(value: Column, shift: Column) -> Column:
    """Floor division by a power of two, also of negative values."""
    return F.call_function("shiftright", value, shift)


def overlap_pairs(
    x: DataFrame, y: DataFrame, keys: Sequence[str] = ("chrom",), min_overlap: int = 1, bin_size: int | None = None,
    suffix: tuple[str, str] = (".x", ".y"), bins: tuple[int, int] | None = None,
) -> DataFrame:
    """chrom, x columns and y columns with their suffixes, ``.overlap``: every pair that overlaps by at least ``min_overlap``.

    With 0, touching and zero-length intervals pair too.
    """
    if min_overlap < 0:
        raise ValueError("min_overlap must not be negative")
    bits, levels = bins or pick_bins(x, y, bin_size)
    sx, sy = suffix
    a = x.select("chrom", *(c(n).alias(n + sx) for n in x.columns if n != "chrom"))
    b = y.select(F.col("chrom").alias("__chrom"), *(c(n).alias(n + sy) for n in y.columns if n != "chrom"))
    if clash := set(a.columns) & set(b.columns):
        raise ValueError(f"suffixes leave equal names: {', '.join(sorted(clash))}")
    closed = min_overlap == 0
    a = bin_rows(a, "start" + sx, "end" + sx, bits, levels, closed, "x")
    b = bin_rows(b, "start" + sy, "end" + sy, bits, levels, closed, "y").withColumnRenamed("__bin", "__ybin")
    if levels:
        b = b.withColumnRenamed("__level", "__ylevel")
    others = [k for k in keys if k != "chrom"]
    cond = (c("__bin") == c("__ybin")) & same(["chrom", *(k + sx for k in others)], ["__chrom", *(k + sy for k in others)])
    over = F.least(c("end" + sx), c("end" + sy)) - F.greatest(c("start" + sx), c("start" + sy))
    shift = F.lit(bits)
    if levels:
        cond &= (c("__level") == c("__ylevel")) & (c("__level") == F.greatest(c("__own_x"), c("__own_y")))
        shift = shift + WIDE * c("__level")
    first = down(F.greatest(c("start" + sx), c("start" + sy)), shift)
    cond &= (over >= min_overlap) & (c("__bin") == first)
    drop = ["__bin", "__ybin", "__chrom", "__level", "__ylevel", "__own_x", "__own_y"]
    return a.join(b, cond).withColumn(".overlap", over).drop(*drop)
