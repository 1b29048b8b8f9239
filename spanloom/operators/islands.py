"""merge, cluster, complement, genomecov, partition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.islands import islands, merged
from ..plans.running import chunk_width, running
from ..plans.sweep import depth, events
from ..schema import c, check_genome, check_interval, group_keys, join_on
from .joins import bed_map


def bed_merge(x: DataFrame, max_dist: int = 0, by: Sequence[str] | None = None, width: int | None = None, **exprs: Column) -> DataFrame:
    """Intervals merged where they overlap, touch or lie within ``max_dist``, with aggregates of the rows merged."""
    if max_dist < 0:
        raise ValueError("max_dist must be positive")
    x = check_interval(x)
    keys = group_keys(x, by)
    if not exprs:
        return merged(x, keys, max_dist, width).select("chrom", "start", "end", *map(c, keys[1:]))
    grouped = islands(x, keys, max_dist, width).groupBy(*map(c, keys), "__island")
    out = grouped.agg(F.min("start").alias("__start"), F.max("end").alias("__end"), *(e.alias(n) for n, e in exprs.items()))
    return out.select("chrom", c("__start").alias("start"), c("__end").alias("end"), *map(c, keys[1:]), *map(c, exprs))


def bed_cluster(x: DataFrame, max_dist: int = 0, by: Sequence[str] | None = None, width: int | None = None) -> DataFrame:
    """``x`` with ``.id``, its cluster's number in order of chrom, start and end over all groups."""
    x = check_interval(x)
    keys = group_keys(x, by)
    marked = islands(x, keys, max_dist, width)
    first = marked.groupBy(*map(c, keys), "__island").agg(F.min(F.struct("start", "end")).alias("__first"))
    # clusters are counted per chromosome first, so that no window spans them all
    flat = first.select(*map(c, keys), "__island", F.col("__first.start").alias("__s"), F.col("__first.end").alias("__e"), F.lit(1).alias("__one"))
    numbered = running(flat, ["chrom"], ["__s", "__e", *keys[1:]], {"__no": ("sum", c("__one"))}, chunk_width(flat, ["chrom"], "__s") if width is None else width)
    base = numbered.groupBy("chrom").agg(F.count("*").alias("__k"))
    base = base.withColumn("__base", F.sum("__k").over(Window.orderBy("chrom")) - c("__k")).drop("__k")  # a row per chromosome
    numbered = join_on(numbered, base, ["chrom"])
    ids = numbered.select(*map(c, keys), "__island", (c("__no") + c("__base")).alias(".id"))
    return join_on(marked, ids, [*keys, "__island"]).drop("__island")


def bed_complement(x: DataFrame, genome: DataFrame, width: int | None = None) -> DataFrame:
    """The parts of the genome that no row covers."""
    g = check_genome(genome)
    x = check_interval(x)
    width = chunk_width(x, ["chrom"], "start") if width is None else width
    x = merged(x, ["chrom"], 0, width)
    x = x.join(g.select(F.col("chrom").alias("__g"), F.col("size").alias("__size")), c("chrom") == c("__g")).drop("__g")
    x = running(x, ["chrom"], ["start", "end"], {"__prev": ("max_before", c("end")), "__next": ("next", c("start"))}, width)
    x = x.withColumns({"__prev": F.coalesce("__prev", F.lit(0).cast("long")), "__last": c("__next").isNull()})
    gaps = F.array(F.struct(c("__prev").alias("s"), c("start").alias("e")), F.when(c("__last"), F.struct(c("end").alias("s"), c("__size").alias("e"))))
    inside = x.select("chrom", F.explode(gaps).alias("p")).where("p.s < p.e").select("chrom", F.col("p.s").alias("start"), F.col("p.e").alias("end"))
    whole = g.join(x.select("chrom").distinct(), "chrom", "left_anti").select("chrom", F.lit(0).cast("long").alias("start"), F.col("size").alias("end"))
    return inside.unionByName(whole)


def bed_genomecov(x: DataFrame, genome: DataFrame, zero_depth: bool = False, by: Sequence[str] | None = None, width: int | None = None) -> DataFrame:
    """Depth of rows (``.depth``) between consecutive endpoints; with ``zero_depth``, uncovered parts too."""
    x = check_interval(x)
    keys = group_keys(x, by)
    g = check_genome(genome).select(F.col("chrom").alias("__g"), F.col("size").alias("__size"))
    known = events(x, keys).join(g, c("chrom") == c("__g")).where("pos <= __size").drop("__g")
    swept = depth(known, keys, width)
    names = ["chrom", "start", "end", *keys[1:], ".depth"]
    inner = swept.where("next is not null").select("chrom", F.col("pos").alias("start"), F.col("next").alias("end"), *map(c, keys[1:]), F.col("depth").alias(".depth"))
    if not zero_depth:
        return inner.where(c(".depth") > 0).select(*map(c, names))
    zero = F.lit(0).cast("long")
    ends = known.groupBy(*map(c, keys), "__size").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    edge = F.explode(F.array(F.struct(zero.alias("s"), c("lo").alias("e")), F.struct(c("hi").alias("s"), c("__size").alias("e"))))
    edges = ends.select(*map(c, keys), edge.alias("p")).where("p.s < p.e").select("chrom", F.col("p.s").alias("start"), F.col("p.e").alias("end"), *map(c, keys[1:]), zero.alias(".depth"))
    every = g.select(c("__g").alias("chrom"), "__size")
    if keys[1:]:  # one row per chromosome and group label
        labels = x.select(*map(c, keys[1:])).distinct().withColumn("__one", F.lit(1))
        every = every.withColumn("__one", F.lit(1)).join(labels, "__one").drop("__one")
    absent = join_on(every, ends.select(*map(c, keys)), keys, "left_anti").select("chrom", zero.alias("start"), c("__size").alias("end"), *map(c, keys[1:]), zero.alias(".depth"))
    return inner.unionByName(edges).unionByName(absent).select(*map(c, names))


def bed_partition(x: DataFrame, by: Sequence[str] | None = None, width: int | None = None, **exprs: Column) -> DataFrame:
    """Elemental segments between all endpoints inside overlapping rows, with aggregates of the rows over each."""
    x = check_interval(x)
    keys = group_keys(x, by)
    parts = depth(events(x, keys), keys, width).where("depth > 0 and next is not null")
    parts = parts.select("chrom", F.col("pos").alias("start"), F.col("next").alias("end"), *map(c, keys[1:]))
    return bed_map(parts, x, by=by, **exprs) if exprs else parts
