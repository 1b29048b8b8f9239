"""Overlaps of a stream with a static table, and merging of event intervals with a watermark."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.overlap import overlap_pairs
from ..schema import c, check_interval, group_keys


def overlap_stream(x: DataFrame, y: DataFrame, by: Sequence[str] | None = None, min_overlap: int = 1, bin_size: int = 1 << 14, max_length: int = 1 << 20) -> DataFrame:
    """Stateless overlap join of the stream ``x`` with the static ``y``; bins are fixed as a stream's lengths can't be asked for."""
    x, y = check_interval(x), check_interval(y)
    bits = max(0, bin_size - 1).bit_length()
    levels = max(0, -(-(max(1, max_length).bit_length() - bits - 3) // 3))
    return overlap_pairs(x, y, group_keys(x, by, y), min_overlap, bins=(bits, levels))


def merge_stream(x: DataFrame, time: str, gap: str, delay: str, by: Sequence[str] = ("chrom",)) -> DataFrame:
    """Events of a stream merged while they lie within ``gap``, as session windows behind a watermark of ``delay``: keys, start, end, n."""
    sessions = x.withWatermark(time, delay).groupBy(*map(c, by), F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n"))
    return sessions.select(*map(c, by), F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
