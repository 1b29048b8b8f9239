"""Random intervals and shuffling. Results follow the seed and the partitioning."""

from __future__ import annotations

import random as _random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..plans.islands import merged
from ..schema import INTERVAL, c, check_genome, check_interval
from .joins import bed_subtract

#: Regions of a shuffle's pool that are sent to the tasks as arrays; larger pools are an error that says so.
POOL = 1_000_000


def _seed(seed: int) -> int:
    return seed or _random.SystemRandom().randrange(1, 2**31)


def bed_random(spark: SparkSession, genome: DataFrame, length: int = 1000, n: int = 1_000_000, seed: int = 0, sort: bool = False) -> DataFrame:
    """``n`` intervals of one length; a chromosome is drawn by its size, a start evenly over those that fit."""
    sizes = sorted((r.chrom, r["size"]) for r in check_genome(genome).select("chrom", "size").collect())  # a row per chromosome
    if any(s <= length for _, s in sizes):
        raise ValueError("`length` must be greater than all chrom sizes")
    seed, total, upto, bounds = _seed(seed), sum(s for _, s in sizes), 0, []
    for _, s in sizes:
        upto += s
        bounds.append(upto / total)
    draw = spark.range(n).select(F.rand(seed).alias("u"), F.rand(seed + 1).alias("v"))
    at = F.least(F.size(F.filter(F.lit(bounds), lambda b: b <= F.col("u"))), F.lit(len(sizes) - 1))
    draw = draw.select(F.get(F.lit([k for k, _ in sizes]), at).alias("chrom"), F.get(F.lit([int(s) for _, s in sizes]), at).cast("long").alias("size"), "v")
    start = F.floor(F.col("v") * (F.col("size") - length + 1)).cast("long")
    out = draw.select("chrom", start.alias("start"), (start + length).alias("end"))
    return out.orderBy("chrom", "start", "end") if sort else out


def bed_shuffle(
    x: DataFrame, genome: DataFrame, incl: DataFrame | None = None, excl: DataFrame | None = None, within: bool = False, seed: int = 0, keep_unplaced: bool = False
) -> DataFrame:
    """``x`` with its rows moved to random places of the same length inside the genome or ``incl``, outside ``excl``.

    Places are drawn evenly over all starts at which the row fits, without retries. A row that fits nowhere is an error; with
    ``keep_unplaced`` it stays, and its chrom, start and end are null.
    """
    import numpy as np

    x, g = check_interval(x), check_genome(genome)
    pool = merged(check_interval(incl), ["chrom"]) if incl is not None else g.select("chrom", F.lit(0).cast("long").alias("start"), F.col("size").alias("end"))
    if excl is not None:
        pool = bed_subtract(pool, merged(check_interval(excl), ["chrom"]), min_overlap=0)
    rows = pool.select("chrom", "start", "end").limit(POOL + 1).collect()  # bounded
    regions = sorted(((r.chrom, r.start, r.end) for r in rows), key=lambda r: (r[0] if within else "", r[1] - r[2], r))  # the longest first
    if not regions:
        raise ValueError("no intervals to sample from")
    if len(regions) > POOL:
        raise ValueError(f"more than {POOL} regions to sample from")
    seed = _seed(seed)
    columns = x.columns
    chroms = sorted({r[0] for r in regions})
    code = {k: i for i, k in enumerate(chroms)}
    of = np.array([code[r[0]] for r in regions], np.int32)
    low, size = (np.array([v(r) for r in regions], np.int64) for v in (lambda r: r[1], lambda r: r[2] - r[1]))
    upto = np.concatenate([[0], np.cumsum(size)])
    edge = np.searchsorted(of, np.arange(len(chroms) + 1)) if within else np.array([0, len(of)])

    def bisect(lo, hi, ok):
        """The first index from ``lo`` to ``hi`` at which ``ok`` holds, ``hi`` if at none."""
        while (open_ := lo < hi).any():
            mid = (lo + hi) // 2
            good = ok(np.minimum(mid, len(size) - 1))
            lo, hi = np.where(open_ & ~good, mid + 1, lo), np.where(open_ & good, mid, hi)
        return lo

    def place(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
        for b in batches:
            chrom, s, e = (b.column(columns.index(n)) for n in ("chrom", "start", "end"))
            length = e.to_numpy(zero_copy_only=False) - s.to_numpy(zero_copy_only=False)
            group = np.array([code.get(k, -1) for k in chrom.to_pylist()], np.int64) if within else np.zeros(len(length), np.int64)
            first = np.where(group < 0, 0, edge[group])
            stop = np.where(group < 0, 0, edge[group + 1])
            # regions that fit come first; k of them hold (sum of sizes) - k * (length - 1) starts, which grows with k
            fit = bisect(first, stop, lambda i: size[i] < length)
            starts = lambda k: upto[k] - upto[first] - (k - first) * (length - 1)
            total = starts(fit)
            none = total <= 0
            if none.any() and not keep_unplaced:
                raise ValueError(f"no place for an interval of length {length[none][0]}")
            r = rng.integers(np.where(none, 1, total))
            i = np.where(none, 0, bisect(first, fit, lambda i: starts(i + 1) > r))
            start = low[i] + r - starts(i)
            for n, values in (("chrom", np.array(chroms, object)[of[i]]), ("start", start), ("end", start + length)):
                at = columns.index(n)
                b = b.set_column(at, b.schema.field(at).with_nullable(True), pa.array(values, b.schema.field(at).type, mask=none))
            yield b

    return x.mapInArrow(place, StructType([StructField(f.name, f.dataType, f.nullable or keep_unplaced and f.name in INTERVAL) for f in x.schema]))
