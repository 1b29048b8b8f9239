"""Nearest values on either side of probes, by one ordered pass over probes and values together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import c
from .running import chunk_width, running


def side(probes: DataFrame, values: DataFrame, keys: Sequence[str], at: Column, value: Column, keep: Sequence[str], name: str, before: bool, equal: bool = True, width: int | None = None) -> DataFrame:
    """keys, keep and the largest value <= at (``before``) or the smallest >= at; ``equal`` false makes it strict."""
    first = 0 if before == equal else 1  # where values stand among probes of the same position
    p = probes.select(*map(c, keys), at.alias("__pos"), F.lit(1 - first).alias("__kind"), F.lit(None).cast("long").alias("__v"), *map(c, keep), F.lit(True).alias("__probe"))
    v = values.select(*map(c, keys), value.alias("__pos")).distinct()
    v = v.select(*map(c, keys), "__pos", F.lit(first).alias("__kind"), c("__pos").alias("__v"), *(F.lit(None).cast(dict(probes.dtypes)[k]).alias(k) for k in keep), F.lit(False).alias("__probe"))
    both = p.unionByName(v)
    width = chunk_width(both, keys, "__pos") if width is None else width
    found = running(both, keys, ["__pos", "__kind"], {name: ("max" if before else "min_after", c("__v"))}, width)
    return found.where("__probe").select(*map(c, [*keys, *keep, name]))


def around(x: DataFrame, y: DataFrame, keys: Sequence[str], width: int | None = None) -> DataFrame:
    """keys, start, end, up, dn of the distinct x coordinates: the last y end at or before start, the first y start at or after end."""
    probes = x.select(*map(c, [*keys, "start", "end"])).distinct()
    if width is None:  # for both sides: x and y rows together
        width = chunk_width(x.select(*map(c, keys), "start").unionByName(y.select(*map(c, keys), "start")), keys, "start")
    up = side(probes, y, keys, c("start"), c("end"), ["start", "end"], "up", True, True, width)
    return side(up, y, keys, c("end"), c("start"), ["start", "end", "up"], "dn", False, True, width)
