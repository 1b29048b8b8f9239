"""Gaps and islands: which rows belong to one run of overlapping or near intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import c
from .running import chunk_width, running


def islands(x: DataFrame, keys: Sequence[str], max_dist: int = 0, width: int | None = None) -> DataFrame:
    """``x`` with ``__island``, the start of its island; a row opens one if it starts more than ``max_dist`` after all ends before it."""
    width = chunk_width(x, keys, "start") if width is None else width
    order = ["start", "end"]
    x = running(x, keys, order, {"__prev": ("max_before", c("end"))}, width)
    x = x.withColumn("__opens", F.when(c("__prev").isNull() | (c("__prev") + max_dist < c("start")), c("start")))
    if width:  # rows are sorted anew: of equal rows, the one that opens goes first again
        x, order = x.withColumn("__tie", c("__opens").isNull()), [*order, "__tie"]
    return running(x, keys, order, {"__island": ("last", c("__opens"))}, width).drop("__prev", "__opens", "__tie")


def merged(x: DataFrame, keys: Sequence[str], max_dist: int = 0, width: int | None = None) -> DataFrame:
    """keys, start, end of the islands."""
    with_id = islands(x.select(*map(c, [*keys, "start", "end"])), keys, max_dist, width)
    return with_id.groupBy(*map(c, keys), "__island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("__island")
