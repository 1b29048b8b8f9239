"""Token ids as ORC: integer run-length encoded stripes in ``doc_id`` order with row indexes and Bloom filters on ``doc_id``.

Documents are range-partitioned by id, so each file covers an id range; stripes are read in parallel, and a lookup by id is
pruned by file, stripe and row-group statistics and then by the Bloom filter.

Edge cases: null or empty text is the end id alone; rows with a null id come first; rows with one id are ordered by text and
each is stored; an empty table gives an empty store; other columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import with_private_text
from .words import encoder, slices

SCHEMA = "doc_id long, part int, local_start long, n_tokens long, ids array<int>"
#: Parts whose first positions are broadcast.
MOST_PARTS = 1_000_000
STRIPE_BYTES, ROW_INDEX = 64 << 20, 2000


def _encode(path: str, end_id: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encode, done = TaskContext.get().partitionId(), encoder(path), 0
        for b in slices(batches, limit=8 << 20):
            offsets, ids = encode.ids(b.column(b.schema.get_field_index("text")))
            n = np.diff(offsets) + 1
            ends = np.concatenate([[0], np.cumsum(n)])
            full = np.empty(ends[-1], np.int32)
            last = np.zeros(len(full), bool)
            last[ends[1:] - 1] = True
            full[last], full[~last] = end_id, ids
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(b.schema.get_field_index("doc_id")),
                    pa.array(np.full(len(n), part, np.int32)),
                    pa.array(done + ends[:-1]),
                    pa.array(n),
                    pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(full)),
                ],
                names=["doc_id", "part", "local_start", "n_tokens", "ids"],
            )
            done += int(ends[-1])

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Tokenise ``docs`` (``doc_id``, ``text``) and write them under ``path`` in ascending id order."""
    ordered = with_private_text(docs, ["doc_id", "text"]).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    (
        ordered.mapInArrow(_encode(tokenizer, end_id), SCHEMA)
        .write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.stripe.size", STRIPE_BYTES)
        .option("orc.row.index.stride", ROW_INDEX)
        .orc(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids of a store."""
    stored = spark.read.schema(SCHEMA).orc(path)
    totals = stored.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row per file
    few = (stored.agg(F.max("part").alias("p")).head().p or 0) < MOST_PARTS  # 16 bytes a part: then the ids needn't be shuffled
    base = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    return stored.join(F.broadcast(base) if few else base, "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The stored rows of a few ids; the predicate is pushed to stripes, row groups and Bloom filters."""
    return spark.read.schema(SCHEMA).orc(path).where(F.col("doc_id").isin(list(doc_ids))).select("doc_id", "n_tokens", "ids")


def digest(tokens: DataFrame) -> DataFrame:
    """Replace ids by their count and the CRC-32 of their little-endian unsigned 32-bit bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(b.schema.get_field_index("ids"))
            offsets, flat = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False).astype("<u4")
            crc = [zlib.crc32(flat[a:z].tobytes()) for a, z in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"]
            )

    return tokens.select("doc_id", "start", "ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
