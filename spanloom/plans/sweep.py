"""Sweep line: depth between consecutive distinct endpoints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import c
from .running import chunk_width, running


def events(x: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, pos, delta: one row per distinct endpoint (summed before the shuffle)."""
    both = x.select(*map(c, keys), F.explode(F.array(F.struct(c("start").alias("pos"), F.lit(1).alias("d")), F.struct(c("end").alias("pos"), F.lit(-1).alias("d")))).alias("e"))
    return both.groupBy(*map(c, keys), F.col("e.pos").alias("pos")).agg(F.sum("e.d").alias("delta"))


def depth(x: DataFrame, keys: Sequence[str], width: int | None = None) -> DataFrame:
    """keys, pos, depth after pos, next pos (null at a group's last endpoint) from events."""
    width = chunk_width(x, keys, "pos") if width is None else width
    return running(x, keys, ["pos"], {"depth": ("sum", c("delta")), "next": ("next", c("pos"))}, width).drop("delta")
