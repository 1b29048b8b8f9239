"""Interval and genome tables: required columns, casts and names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INTERVAL = ("chrom", "start", "end")
GENOME = ("chrom", "size")


def c(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col(f"`{name}`")


def check_names(df: DataFrame, required: Sequence[str]) -> None:
    if missing := [n for n in required if n not in df.columns]:
        raise ValueError(f"expected {len(required)} required names, missing: {', '.join(missing)}")


def check_interval(df: DataFrame) -> DataFrame:
    """``df`` with long start and end; an error names missing columns."""
    check_names(df, INTERVAL)
    types = dict(df.dtypes)
    return df.withColumns({n: c(n).cast("long") for n in ("start", "end") if types[n] != "bigint"})


def check_genome(df: DataFrame, unique: bool = True) -> DataFrame:
    """``df`` with long size. With ``unique``, duplicate chromosomes are an error (a small job)."""
    check_names(df, GENOME)
    df = df.withColumn("size", F.col("size").cast("long"))
    if unique and (twice := [r.chrom for r in df.groupBy("chrom").count().where("count > 1").limit(5).collect()]):
        raise ValueError(f"duplicate chroms in genome: {', '.join(map(str, twice))}")
    return df


def from_one_based(df: DataFrame) -> DataFrame:
    """BED6 from 1-based closed ranges (seqnames, start, width or end, optional name, score, strand)."""
    width = F.col("width") if "width" in df.columns else F.col("end") - F.col("start") + 1
    text = lambda n, default: F.coalesce(F.col(n).cast("string"), F.lit(default)) if n in df.columns else F.lit(default)
    return df.select(
        F.col("seqnames").cast("string").alias("chrom"),
        (F.col("start") - 1).cast("long").alias("start"),
        (F.col("start") - 1 + width).cast("long").alias("end"),
        text("name", ".").alias("name"),
        text("score", ".").alias("score"),
        F.when(text("strand", "*") == "*", ".").otherwise(text("strand", "*")).alias("strand"),
    )


gr_to_bed = from_one_based


def same(left: Sequence[str], right: Sequence[str]) -> Column:
    """Null-safe equality of key columns, which hash and sort-merge joins take as keys."""
    out = None
    for a, b in zip(left, right, strict=True):
        one = c(a).eqNullSafe(c(b))
        out = one if out is None else out & one
    return out


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Null-safe join on keys of the same name; the result has the left's keys."""
    renamed = right.select(*(c(k).alias(f"__r_{k}") for k in keys), *(c(n) for n in right.columns if n not in keys))
    out = left.join(renamed, same(keys, [f"__r_{k}" for k in keys]), how)
    return out if how in ("left_anti", "left_semi") else out.drop(*(f"__r_{k}" for k in keys))


def group_keys(x: DataFrame, by: Sequence[str] | None, y: DataFrame | None = None) -> list[str]:
    """chrom and the grouping columns, which must exist on every side."""
    keys = ["chrom", *(k for k in (by or []) if k != "chrom")]
    for df in (x, y):
        if df is not None:
            check_names(df, keys)
    return keys


def reorder_names(df: DataFrame, like: DataFrame) -> DataFrame:
    """Columns in the order of ``like``, others after them."""
    return df.select(*(c(n) for n in like.columns if n in df.columns), *(c(n) for n in df.columns if n not in like.columns))
