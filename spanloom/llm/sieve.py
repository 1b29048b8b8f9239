"""Fixed-size filters of 64-bit keys, which spare most texts a shuffle before a join on few keys.

They only save work: rows that they let through are still joined. Their size doesn't follow the data; full, they let all rows
through. ``bitmap`` and ``may_hold`` are DataFrame functions only; ``sieve`` is larger and for Python workers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import U, mix

#: 64-bit words of the filter: one mebibyte.
WORDS = 1 << 17
#: Bits of the map of ``bitmap``.
BITS = 1 << 18


def _word(h: Column) -> Column:
    """Index of the bitmap's word of a hash."""
    return F.shiftright(h, 6).bitwiseAND(BITS // 64 - 1).cast("int")


def _bit(h: Column) -> Column:
    return h.bitwiseAND(63).cast("int")


def bitmap(keys: DataFrame) -> list[int]:
    """Bits of the hashes in the one column of ``keys``; at most ``BITS`` / 64 rows come to the driver."""
    h = F.col(keys.columns[0])
    rows = keys.groupBy(_word(h).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), _bit(h))).alias("b")).collect()
    out = [0] * (BITS // 64)
    for r in rows:
        if r.w is not None:
            out[r.w] = r.b
    return out


def literal(bits: list[int]) -> Column:
    return F.lit(bits).cast("array<bigint>")


def may_hold(bits: Column, h: Column) -> Column:
    """Whether the hash ``h`` may be among those of the bitmap (``literal``)."""
    return F.getbit(F.get(bits, _word(h)), _bit(h)) == 1


def places(ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    h = mix(pc.fill_null(ids.cast(pa.int64()), 0).to_numpy(zero_copy_only=False).view(np.uint64))
    return (h & U(WORDS - 1)).astype(np.int64), U(1) << (h >> U(58))


def sieve(ids: DataFrame) -> np.ndarray:
    """The filter of the one column of ``ids``; at most ``WORDS`` pairs of numbers come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.zeros(WORDS, np.uint64)
        for b in batches:
            at, bit = places(b.column(0))
            np.bitwise_or.at(words, at, bit)
        at = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(words[at].view(np.int64))], names=["w", "bits"])

    out = np.zeros(WORDS, np.uint64)
    got = ids.mapInArrow(run, "w long, bits long").groupBy("w").agg(F.bit_or("bits").alias("bits")).toPandas()
    out[got["w"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return out
