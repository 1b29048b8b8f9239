"""Running values along a coordinate, cut into chunks so that one chromosome is not one task.

A chunk's summary (a row per chunk) is carried over the chunks of its group by a small window and joined to the rows, whose own
window then spans one chunk only. Below ``TARGET`` rows a group the plain window is used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import c, join_on

#: Rows of a group that one window may sort.
TARGET = 4_000_000
PAST, FUTURE = Window.unboundedPreceding, Window.unboundedFollowing


def chunk_width(df: DataFrame, keys: Sequence[str], pos: str, target: int = TARGET) -> int:
    """Width of the chunks, 0 for none, from the largest group's rows and span (one aggregation)."""
    per = df.groupBy(*map(c, keys)).agg(F.count("*").alias("n"), F.min(pos).alias("lo"), F.max(pos).alias("hi"))
    r = per.agg(F.max(F.struct("n", (F.col("hi") - F.col("lo")).alias("span"))).alias("m")).head().m
    if r is None or r.n <= target:
        return 0
    return max(1, (r.span or 0) * target // r.n)


def _parts(kind: str, value: Column, order: list[Column]):
    """Chunk summary, its carry over earlier or later chunks, the value in the chunk, and how they combine.

    Later rows of a chunk are read backwards: Spark goes through all of a frame that ends at the last row anew for each row.
    """
    where = F.struct(*order)
    if kind == "max_before":
        return F.max(value), (F.max, PAST, -1), lambda w, _: F.max(value).over(w.rowsBetween(PAST, -1)), F.greatest
    if kind == "max":
        return F.max(value), (F.max, PAST, -1), lambda w, _: F.max(value).over(w.rowsBetween(PAST, 0)), F.greatest
    if kind == "min_after":
        return F.min(value), (F.min, 1, FUTURE), lambda _, back: F.min(value).over(back.rowsBetween(PAST, 0)), F.least
    if kind == "sum":
        return F.sum(value), (F.sum, PAST, -1), lambda w, _: F.sum(value).over(w.rowsBetween(PAST, 0)), lambda a, b: F.coalesce(a, F.lit(0)) + b
    if kind == "last":
        return (
            F.max_by(value, F.when(value.isNotNull(), where)), (lambda v: F.last(v, True), PAST, -1),
            lambda w, _: F.last(value, True).over(w.rowsBetween(PAST, 0)), lambda a, b: F.coalesce(b, a),
        )
    if kind == "prev":
        return F.max_by(value, where), (lambda v: F.last(v, True), PAST, -1), lambda w, _: F.lag(value).over(w), lambda a, b: F.coalesce(b, a)
    if kind == "next":
        return F.min_by(value, where), (lambda v: F.first(v, True), 1, FUTURE), lambda w, _: F.lead(value).over(w), lambda a, b: F.coalesce(b, a)
    raise ValueError(kind)


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], specs: dict[str, tuple[str, Column]], width: int) -> DataFrame:
    """``df`` with each spec's running value; the first ``order`` column is the coordinate that is cut.

    Kinds: max_before (exclusive), max, min_after (this and later rows), sum, last (non-null), next and prev (the neighbouring row's value).
    """
    by = [c(k) for k in keys]
    at = [c(o) for o in order]
    parts = {n: _parts(kind, value, at) for n, (kind, value) in specs.items()}
    if not width:
        ways = [Window.partitionBy(*by).orderBy(*way) for way in (at, [o.desc() for o in at])]
        return df.withColumns({n: own(*ways) for n, (_, _, own, _) in parts.items()})
    df = df.withColumn("__chunk", F.floor(at[0] / width).cast("long"))
    small = df.groupBy(*by, "__chunk").agg(*(summary.alias(f"__s_{n}") for n, (summary, *_) in parts.items()))
    over = Window.partitionBy(*by).orderBy("__chunk")
    carried = small.select(*by, "__chunk", *(fold(c(f"__s_{n}")).over(over.rowsBetween(a, z)).alias(f"__c_{n}") for n, (_, (fold, a, z), _, _) in parts.items()))
    both = join_on(df, carried, [*keys, "__chunk"])
    ways = [Window.partitionBy(*by, "__chunk").orderBy(*way) for way in (at, [o.desc() for o in at])]
    out = both.withColumns({n: combine(c(f"__c_{n}"), own(*ways)) for n, (_, _, own, combine) in parts.items()})
    return out.drop("__chunk", *(f"__c_{n}" for n in parts))
