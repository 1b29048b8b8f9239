"""Bounded-space online packing of tokenised documents into fixed-length sequences.

Each input partition keeps at most ``open_windows`` unfinished sequences. A piece goes to the open window with the least
room that still holds it; when none fits, the fullest is topped up with the piece's head and emitted. What stays open at a
partition's end (at most ``open_windows`` pieces lists, a proven bound) is merged in groups of ``MERGE`` partitions.

Edge cases: null or empty text is one end id; a null id is kept; repeated rows are packed once per row; an empty table gives
an empty result; a text is tokenised as a whole and then cut; other columns of the input are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize, with_private_text
from .words import encoder, slices

#: Partitions whose leftovers one task merges.
MERGE = 64
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary, part long"
ARROW = pa.schema(
    [(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")] + [("ids", pa.binary()), ("part", pa.int64())]
)
#: Merged sequences are numbered apart from those of the partitions.
MERGED_BASE = 1 << 60


class Packer:
    """Open windows of one partition. A piece is (doc_id, start, ids, doc_tokens)."""

    def __init__(self, size: int, open_windows: int, base: int):
        self.size, self.most, self.next = size, open_windows, base
        self.room: list[tuple[int, int]] = []  # (room left, window), ascending
        self.windows: dict[int, list] = {}
        self.done: list[tuple[int, list]] = []
        self.serial = 0

    def _seal(self, pieces: list) -> None:
        self.done.append((self.next, pieces))
        self.next += 1

    def add(self, doc_id, ids: np.ndarray, start: int = 0, total: int | None = None) -> None:
        total = len(ids) if total is None else total
        at = 0
        while len(ids) - at >= self.size:
            self._seal([(doc_id, start + at, ids[at : at + self.size], total)])
            at += self.size
        if at < len(ids):
            self._place(doc_id, start + at, ids[at:], total)

    def _place(self, doc_id, start: int, ids: np.ndarray, total: int) -> None:
        k = bisect.bisect_left(self.room, (len(ids), -1))
        if k == len(self.room):
            if len(self.room) < self.most:
                self.windows[self.serial] = [(doc_id, start, ids, total)]
                bisect.insort(self.room, (self.size - len(ids), self.serial))
                self.serial += 1
                return
            left, w = self.room.pop(0)  # the fullest; topped up, so that it leaves without padding
            self._seal([*self.windows.pop(w), (doc_id, start, ids[:left], total)])
            self._place(doc_id, start + left, ids[left:], total)
            return
        left, w = self.room.pop(k)
        self.windows[w].append((doc_id, start, ids, total))
        if left == len(ids):
            self._seal(self.windows.pop(w))
        else:
            bisect.insort(self.room, (left - len(ids), w))

    def flush(self) -> Iterator[tuple[int, list]]:
        yield from self.done
        self.done = []

    def leftovers(self) -> list:
        return [p for w in self.windows.values() for p in w]


def _batch(done: list[tuple[int, list]], part: int, keep: bool) -> pa.RecordBatch:
    rows = []
    for seq, pieces in done:
        at = 0
        for doc_id, start, ids, total in pieces:
            raw = ids.tobytes()
            rows.append((doc_id, start, len(ids), zlib.crc32(raw), total, seq, at, raw if keep else None, part))
            at += len(ids)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(ARROW), ARROW.types, strict=True)], schema=ARROW)


def _pack_partitions(path: str, size: int, open_windows: int, end_id: int, keep: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        packer, encode = Packer(size, open_windows, part << 32), encoder(path)
        for b in slices(batches):
            offsets, ids = encode.ids(b.column(b.schema.get_field_index("text")))
            for i, doc_id in enumerate(b.column(b.schema.get_field_index("doc_id")).to_pylist()):
                packer.add(doc_id, np.append(ids[offsets[i] : offsets[i + 1]], np.uint32(end_id)))
            yield _batch(list(packer.flush()), part, keep)
        # a leftover has no sequence yet; its ids travel with it
        yield _batch([(-1, [p]) for p in packer.leftovers()], part, True)

    return run


def _merge(size: int, keep: bool) -> Callable:
    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = key[0].as_py()
        packer = Packer(size, 1, MERGED_BASE + (group << 32))
        for b in batches:
            for doc_id, start, raw, total in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens")), strict=True):
                packer.add(doc_id, np.frombuffer(raw, np.uint32), start, total)
            yield _batch(list(packer.flush()), -1, keep)
        # the last pieces are cut at powers of two, which need no padding
        rest, have = packer.leftovers(), []
        todo = sum(len(p[2]) for p in rest)
        while todo:
            step, have = 1 << (todo.bit_length() - 1), []
            todo -= step
            while step:
                doc_id, start, ids, total = rest.pop(0)
                have.append((doc_id, start, ids[:step], total))
                if len(ids) > step:
                    rest.insert(0, (doc_id, start + step, ids[step:], total))
                step -= len(have[-1][2])
            packer._seal(have)
        yield _batch(list(packer.flush()), -1, keep)

    return run


def pack(
    docs: DataFrame, tokenizer: str, size: int = 1024, end_id: int = 0, open_windows: int = 64, keep_ids: bool = True
) -> DataFrame:
    """Pieces of ``docs`` (``doc_id``, ``text``) placed in sequences of at most ``size`` tokens.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, with ``keep_ids``, the piece's ids as
    little-endian unsigned 32-bit ``binary``. A document's ids are the tokenizer's and then ``end_id``.
    """
    if size & (size - 1):
        raise ValueError("size must be a power of two")
    pieces = materialize(
        with_private_text(docs, ["doc_id", "text"]).mapInArrow(_pack_partitions(tokenizer, size, open_windows, end_id, keep_ids), SCHEMA), "pieces"
    )
    open_ = pieces.where("sequence_id < 0").withColumn("grp", F.floor(F.col("part") / MERGE))
    merged = open_.groupBy("grp").applyInArrow(_merge(size, keep_ids), SCHEMA)
    out = pieces.where("sequence_id >= 0").unionByName(merged).drop("part")
    return out if keep_ids else out.drop("ids")
