"""Exact n-gram Jaccard join by count vectors in R-trees.

Words of a text give its set of k-word shingles. Shingles are hashed into groups; a set is the point of its group counts.
Two sets of size x <= y with Jaccard >= t differ in at most d = (x + y)(1 - t)/(1 + t) shingles, hence in at most d groups.
With more than d groups per size class, every linked pair has a group of equal content, so sets are dealt to blocks by
(class, group, content): an exact partition of the join that a frequent shingle cannot make hot, as it takes a whole equal
group. A set's groups are ranked, those of most shingles first, and only its first d + 1 are dealt, by the largest d of its own
size: a linked pair's first equal group is among these on both sides, as at most d groups of either come before it. Groups of
one frequent shingle, in which unlike sets meet, are thus mostly left out. Inside a block an R-tree over the count vectors finds the pairs whose summed coordinate minima reach the needed
overlap; unequal groups of equal count tighten the bound; survivors are verified on the shingle sets.

Nothing expands all pairs of a group: texts of one set are one point; blocks with the same members are one block; a pair is
handled only in the blocks of its first two equal groups by rank; a first round verifies each point's best survivor, and a second round all survivors
between the components found so far. Blocks beyond ``tile`` members are cut into pairs of tiles.

Edge cases: null, empty and wordless texts have an empty set and stay alone; fewer than k words are one shingle; a null id is
kept (and never the smallest of a component unless alone); repeated rows each return; an empty table returns no rows; other
columns are ignored. Sets are identified by 64-bit hashes of their contents, shingles by 64-bit hashes of their words.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .components import components
from .rtree import CountTree, needed
from .sieve import places, sieve
from .storage import Scratch, materialize
from .words import U, mix, release, segments, shingle_sets, slices

#: Ratio of the size classes' bounds.
RATIO = 1.4
#: Blocks of a set that the first round looks into.
FIRST = 4
#: Members of a block that one R-tree takes.
TILE = 4000
#: Rows (key, group, set) that a task gathers before it deals them to buckets.
CHUNKED = 1 << 20
#: A mark is class << CLASS | rank; a group's rank is (MOST - its count, MOST at most) << PLACE | its number.
CLASS, PLACE, MOST = 40, 32, 255


def class_of(n: np.ndarray) -> np.ndarray:
    return np.floor(np.log(np.maximum(n, 1) * (1 + 1e-12)) / math.log(RATIO)).astype(np.int64)


def groups_of(cls: int, num: int, den: int) -> tuple[int, int]:
    """Groups of a class and its spare: so many common empty groups a pair may have besides one of equal content."""
    low, high = math.ceil(RATIO**cls - 1e-9), math.ceil(RATIO ** (cls + 1)) + 1
    differ = (den - num) * (high + high * den // num + 1) // (den + num)
    spare = 1
    for _ in range(4):
        mean = (differ + 1 + spare) * math.exp(-low / (differ + 1 + spare))
        spare = math.ceil(mean + 4 * math.sqrt(mean))
    return differ + 1 + spare, spare


def classes_of(n: int, num: int, den: int) -> range:
    """Classes in which a set of size n meets its partners: its own, and those of its smaller partners."""
    return range(int(class_of(np.array([-(-num * n // den)]))[0]), int(class_of(np.array([n]))[0]) + 1)


def dealt_groups(n: np.ndarray, cls: int, num: int, den: int) -> np.ndarray:
    """How many of its groups sets of sizes ``n`` are dealt to in a class: one more than can differ from a partner there."""
    most = np.where(class_of(n) == cls, den * n // num, np.minimum(n, math.ceil(RATIO ** (cls + 1)) + 1))
    return (den - num) * (n + most) // (den + num) + 1


def ranks(counts: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """Order of groups: those of most shingles first."""
    return (MOST - np.minimum(counts, MOST).astype(np.int64)) << PLACE | groups


def group_index(hashes: np.ndarray, groups: int) -> np.ndarray:
    return ((mix(hashes + U(0x51ED)) >> U(33)) * U(groups) >> U(31)).astype(np.int64)


def set_ids(offsets: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """64-bit identity of each set, 0 for the empty one."""
    sums = np.concatenate([np.zeros(1, U), np.cumsum(mix(hashes + U(0xABCD)), dtype=U)])
    n = np.diff(offsets)
    out = mix(sums[offsets[1:]] - sums[offsets[:-1]] + n.astype(U))
    return np.where(n > 0, out, U(0)).astype(np.int64)


def sketch(h: np.ndarray, cls: int, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts and content hashes of a set's groups."""
    groups, _ = groups_of(cls, num, den)
    g = group_index(h, groups)
    counts = np.bincount(g, minlength=groups)
    content = np.zeros(groups, U)
    np.add.at(content, g, mix(h))
    return counts, content


def packed(counts: np.ndarray) -> bytes:
    """Group counts in two bytes each, or four if one needs it."""
    return counts.astype(np.uint16 if counts.max() < 1 << 16 else np.uint32).tobytes()


def unpacked(rows: list[bytes], groups: int) -> np.ndarray:
    if all(len(r) == 2 * groups for r in rows):
        return np.frombuffer(b"".join(rows), np.uint16).reshape(len(rows), groups)
    return np.stack([np.frombuffer(r, np.uint16 if len(r) == 2 * groups else np.uint32).astype(np.uint32) for r in rows])


def _members(k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            offsets, h = shingle_sets(b.column(1), k)
            cols = [b.column(0), pa.array(np.diff(offsets)), pa.array(set_ids(offsets, h)), b.column(2)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n", "sid", "text_hash"])

    return run


def planes(a: np.ndarray) -> bytes:
    """The first bytes of all numbers, their second bytes and so on: equal bytes stand together."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), 8).T).tobytes()


def unplaned(raw: bytes, n: int, at: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n, at).reshape(8, n).T).view(np.int64).ravel()


def dealt_chunks(key: np.ndarray, cg: np.ndarray, sid: np.ndarray, buckets: np.ndarray) -> pa.RecordBatch:
    """The rows by bucket of their key, one binary each: sets with the lengths of their runs, then keys and groups."""
    part = ((key >> U(32)) * U(len(buckets)) >> U(32)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    key, cg, sid, part = key[order].view(np.int64), cg[order], sid[order], part[order]
    edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
    chunks = []
    for a, z in zip(edges[:-1], edges[1:], strict=True):
        start = np.flatnonzero(np.concatenate([[True], sid[a + 1 : z] != sid[a : z - 1]]))
        head = np.array([z - a, len(start)], np.int64)
        chunks.append(b"".join([head.tobytes(), sid[a:z][start].tobytes(), *(planes(x) for x in (np.diff(np.append(start, z - a)), key[a:z], cg[a:z]))]))
    return pa.RecordBatch.from_arrays([pa.array(buckets[part[edges[:-1]]]), pa.array(chunks, pa.binary())], names=["bucket", "chunk"])


def _undealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for raw in b.column(0):
            raw = raw.as_py()
            n, runs = np.frombuffer(raw, np.int64, 2).tolist()
            sid = np.repeat(np.frombuffer(raw, np.int64, runs, 16), unplaned(raw, runs, 16 + 8 * runs))
            at = 16 + 16 * runs
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (unplaned(raw, n, at), unplaned(raw, n, at + 8 * n), sid)], names=["key", "cg", "sid"])


def buckets_of(spark: SparkSession) -> np.ndarray:
    """A number for each shuffle partition that hashes to it."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = spark.range(0, 40 * n, 1, 1).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("p")).agg(F.min("id").alias("id")).collect()  # a row per partition
    return np.array(sorted(r.id for r in rows), np.int64)


def _keys(k: int, num: int, den: int, buckets: np.ndarray) -> Callable:
    """Chunks (bucket, chunk) of the rows (key, cg, sid): a set's keys of one bucket share its id."""
    made = _set_keys(k, num, den)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for part in made(batches):
            held.append(part)
            rows += len(part[0])
            if rows >= CHUNKED:
                yield dealt_chunks(*map(np.concatenate, zip(*held, strict=True)), buckets)
                held, rows = [], 0
        if held:
            yield dealt_chunks(*map(np.concatenate, zip(*held, strict=True)), buckets)

    return run


def _set_keys(k: int, num: int, den: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        seen: set[int] = set()  # of this task: copies of a set emit once
        for b in slices(batches):
            offsets, h = shingle_sets(b.column(0), k)
            ids, n = set_ids(offsets, h), np.diff(offsets)
            new = []
            for i, s in enumerate(ids.tolist()):
                if n[i] and s not in seen:
                    seen.add(s)
                    new.append(i)
            new = np.array(new, np.int64)
            if not len(new):
                continue
            low, high = class_of(-(-num * n[new] // den)), class_of(n[new])
            out = []
            for cls in range(int(low.min()), int(high.max()) + 1):
                groups, spare = groups_of(cls, num, den)
                if groups == 1 + spare:
                    continue  # no difference is allowed: equal sets are one point already
                own = new[(low <= cls) & (cls <= high)]
                salt = U(cls * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
                for part in (own[i : i + 256] for i in range(0, len(own), 256)):
                    owner, pos = segments(n[part])
                    hh = h[offsets[part][owner] + pos]
                    cell = owner * groups + group_index(hh, groups)
                    order = np.argsort(cell, kind="stable")
                    cell, vals = cell[order], mix(hh[order])
                    start = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
                    content, cell, count = np.add.reduceat(vals, start), cell[start], np.diff(np.append(start, len(cell)))
                    g, who = cell % groups, cell // groups
                    rank, most = ranks(count, g), dealt_groups(n[part], cls, num, den)
                    order = np.lexsort((rank, who))
                    filled = np.bincount(who, minlength=len(part))
                    order = order[segments(filled)[1] < most[who[order]]]
                    g, who, rank = g[order], who[order], rank[order]
                    out.append((mix(content[order] + salt + g.astype(U) * U(0xD1B54A32D192ED03)), cls << CLASS | rank, ids[part][who]))
                    # empty groups come last
                    for i in np.flatnonzero(filled < most):
                        empty = np.setdiff1d(np.arange(groups), cell[cell // groups == i] % groups)[: most[i] - filled[i]]
                        out.append((mix(empty.astype(U) + ~salt), cls << CLASS | ranks(np.zeros(len(empty), np.int64), empty), np.full(len(empty), ids[part[i]])))
            if out:
                yield tuple(map(np.concatenate, zip(*out, strict=True)))

    return run


def whole_runs(batches: Iterator[pa.RecordBatch], column: int = 0, most: int = 1 << 20) -> Iterator[tuple[pa.Table, bool]]:
    """Tables of a sorted stream, cut only between values of ``column``; a run of over ``most`` rows comes in parts, flagged."""
    held: list[pa.RecordBatch] = []
    rows = 0
    partial = None
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(column).to_numpy()
        if partial is not None:  # go on with a run that is passed on in parts
            stop = int(np.searchsorted(k != partial, True)) if (k != partial).any() else len(k)
            if stop:
                yield pa.Table.from_batches([b.slice(0, stop)]), True
            if stop == len(k):
                continue
            b, k, partial = b.slice(stop), k[stop:], None
        first = int(np.searchsorted(k, k[-1])) if (k[1:] >= k[:-1]).all() else int(np.flatnonzero(k != k[-1])[-1] + 1 if (k != k[-1]).any() else 0)
        if held and held[-1].column(column)[-1].as_py() != k[0]:
            yield pa.Table.from_batches(held), False
            held, rows = [], 0
        if first:
            yield pa.Table.from_batches([*held, b.slice(0, first)]), False
            held, rows = [], 0
        held.append(b.slice(first))
        rows += b.num_rows - first
        if rows > most:
            yield pa.Table.from_batches(held), True
            held, rows, partial = [], 0, k[-1]
    if held:
        yield pa.Table.from_batches(held), False
    release()


def _live(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of two sets at least, named by their members and class."""
    for t, part in whole_runs(batches):
        key, cg, sid = (t.column(c).to_numpy() for c in ("key", "cg", "sid"))
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (sid[1:] != sid[:-1])
        key, cg, sid = key[new], cg[new], sid[new]
        if part:
            block = key.view(U)
        else:
            start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.append(start, len(key)))
            name = mix(np.add.reduceat(mix(sid.view(U)), start) + (cg[start] >> CLASS).astype(U))
            block = np.repeat(name, size)
            live = np.repeat(size > 1, size)
            block, cg, sid = block[live], cg[live], sid[live]
        if len(block):
            yield pa.RecordBatch.from_arrays([pa.array(block.view(np.int64)), pa.array(cg), pa.array(sid)], names=["block", "cg", "sid"])


def _sets(k: int, words: np.ndarray, least: int = 1) -> Callable:
    """Sets of the texts whose hash may be wanted (``words``: a sieve); copies of a text count once in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in slices(batches):
            at, bit = places(b.column(1))
            new = []
            for i, h in zip(np.flatnonzero(words[at] & bit).tolist(), b.column(1).filter(pa.array((words[at] & bit) != 0)).to_pylist(), strict=True):
                if h not in seen:
                    seen.add(h)
                    new.append(i)
            for part in (new[i : i + 512] for i in range(0, len(new), 512)):
                offsets, h = shingle_sets(b.column(0).take(pa.array(part)), k, least)
                ids = set_ids(offsets, h)
                raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(part), [None, pa.py_buffer((offsets * 8).astype(np.int64)), pa.py_buffer(h)])
                yield pa.RecordBatch.from_arrays([pa.array(ids), raw.cast(pa.binary())], names=["sid", "hashes"])

    return run


def _sketches(num: int, den: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for sid, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                h = np.frombuffer(raw, U)
                if not len(h):
                    continue
                rows = []
                for cls in classes_of(len(h), num, den):
                    counts, content = sketch(h, cls, num, den)
                    rows.append((sid, cls, len(h), packed(counts), (content >> U(32)).astype(np.uint32).tobytes()))
                c = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["sid", "cls", "n", "counts", "contents"]).append_column("marks", pa.nulls(len(rows), pa.binary()))

    return run


def _search(num: int, den: int, best: bool) -> Callable:
    """Survivors of each block's R-tree: for ``best`` one partner per set, else all between different components."""

    def block_pairs(t: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        at = {c: t.column(c).to_numpy() for c in ("cg", "last", "sid", "n", "comp", "tile", "mine")}
        if at["comp"].min() == at["comp"].max():
            return
        contents = np.frombuffer(b"".join(t.column("contents").to_pylist()), np.uint32).reshape(len(t), -1)
        counts = unpacked(t.column("counts").to_pylist(), contents.shape[1])
        own = t.column("marks").to_pylist()
        marks = np.frombuffer(b"".join(own), np.int64).reshape(len(t), -1) if own[0] is not None else None
        two = at["mine"][0] >> 20 != at["mine"][0] & 0xFFFFF
        first, last = (int(at[c][0]) & (1 << CLASS) - 1 for c in ("cg", "last"))  # the block's marks, the same for all members
        for i, j, bound in CountTree(counts, at["n"]).pairs(num, den):
            ok = at["comp"][i] != at["comp"][j]
            if two:
                ok &= at["tile"][i] != at["tile"][j]
            i, j, bound = i[ok], j[ok], bound[ok]
            for s in range(0, len(i), 2048):
                a, b, bd = i[s : s + 2048], j[s : s + 2048], bound[s : s + 2048]
                same_count, same = counts[a] == counts[b], contents[a] == contents[b]
                bd = bd - (same_count & (counts[a] > 0) & ~same).sum(1)
                ok = bd >= needed(at["n"][a] + at["n"][b], num, den)
                if not best and marks is not None:  # in the pair's first and last common blocks only
                    both = marks[a] == marks[b]
                    ok &= (both.argmax(1) == first) | (both.shape[1] - 1 - both[:, ::-1].argmax(1) == last)
                elif not best:  # in the blocks of its first two equal groups; a chance equality of contents takes the place of one at most
                    a, b, bd, same = a[ok], b[ok], bd[ok], (same & same_count)[ok]
                    rank = np.where(same, ranks(counts[a], np.arange(counts.shape[1])), np.int64(1 << CLASS))
                    one = rank.min(1)
                    rank[rank == one[:, None]] = 1 << CLASS
                    ok = (one == first) | (rank.min(1) == first)
                if ok.any():
                    yield a[ok], b[ok], bd[ok]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole, _ in whole_runs(batches, most=1 << 30):
            key = np.stack([whole.column(c).to_numpy() for c in ("block", "mine")])
            start = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(0)]))
            for a, z in zip(start, np.append(start[1:], len(whole)), strict=True):
                t = whole.slice(a, z - a)
                if len(t) < 2:
                    continue
                sid, n = t.column("sid").to_numpy(), t.column("n").to_numpy()
                for i, j, bound in block_pairs(t):
                    later = (n[i] > n[j]) | ((n[i] == n[j]) & (sid[i] > sid[j]))
                    x, y = np.where(later, sid[i], sid[j]), np.where(later, sid[j], sid[i])
                    like = bound / (n[i] + n[j] - bound)
                    if best:
                        order = np.lexsort((y, -like, x))
                        first = np.concatenate([[True], x[order][1:] != x[order][:-1]])
                        x, y, like = x[order][first], y[order][first], like[order][first]
                    yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.array(like)], names=["a", "b", "like"])

    return run


def _verify(num: int, den: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for x, y, p, q in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                p, q = np.frombuffer(p, U), np.frombuffer(q, U)
                both = len(np.intersect1d(p, q, assume_unique=True))
                if den * both >= num * (len(p) + len(q) - both):
                    rows.append((x, y))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return run


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose hash sets (``sets``: sid, hashes) have den * intersection >= num * union."""
    one = sets.select(F.col("sid").alias("a"), F.col("hashes").alias("ha"))
    two = sets.select(F.col("sid").alias("b"), F.col("hashes").alias("hb"))
    return pairs.select("a", "b").distinct().join(one, "a").join(two, "b").select("a", "b", "ha", "hb").mapInArrow(_verify(num, den), "a long, b long")


def link_sets(s: Scratch, blocks: DataFrame, fetch: Callable[[DataFrame], DataFrame], num: int, den: int, tile: int = TILE, sketches: Callable | None = None) -> DataFrame:
    """a, b: verified links that span the components of all sets.

    ``blocks`` has block, sid, cg and last (class << CLASS | its first and last mark); ``fetch`` gives sid and hashes of a table of sids; it may repeat them and give others.
    ``sketches`` gives each set's points; marks say in which of its blocks a pair meets first and last; where they are null,
    the groups' ranks say where it meets first.
    """
    wanted = blocks.select("sid").distinct()
    made = fetch(wanted).mapInArrow(sketches or _sketches(num, den), "sid long, cls long, n long, counts binary, contents binary, marks binary")
    points = s.table(made.join(wanted, "sid", "left_semi").dropDuplicates(["sid", "cls"]), "points")
    dealt = blocks.select("block", "cg", "last", F.shiftright("cg", CLASS).alias("cls"), "sid")

    def sets_of(pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
        return s.table(fetch(ends).join(ends, "sid", "left_semi").dropDuplicates(["sid"]), "sets")

    def search(labels: DataFrame | None) -> DataFrame:
        if labels is None:
            # the first round looks into each set's FIRST blocks by hash, in one tile each: likely the same for like sets; the second is complete
            order = Window.partitionBy("sid").orderBy(F.xxhash64("block"), "block")
            rows = dealt.withColumn("k", F.row_number().over(order)).where(F.col("k") <= FIRST).drop("k").withColumn("comp", F.col("sid"))
            hot = rows.groupBy("block").agg(F.ceil(F.count("*") / tile).alias("tiles")).where("tiles > 1")
            rows = rows.join(hot, "block", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1).cast("long")))
        else:
            named = labels.select(F.col("node").alias("sid"), "component")
            rows = dealt.join(named, "sid", "left").withColumn("comp", F.coalesce("component", "sid")).drop("component")
            # a block of one component is done
            open_ = rows.groupBy("block").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.ceil(F.count("*") / tile).alias("tiles")).where("x <> y")
            rows = rows.join(open_.select("block", "tiles"), "block")
        rows = rows.withColumn("tile", F.pmod(F.xxhash64("sid"), F.col("tiles")))
        mine = F.transform(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1), lambda k: F.least(k, F.col("tile")) * (1 << 20) + F.greatest(k, F.col("tile")))
        rows = rows.withColumn("mine", F.col("tile") * (1 << 20) + F.col("tile") if labels is None else F.explode(mine)).drop("tiles")
        cell = F.xxhash64("block", "mine").alias("cell")
        rows = rows.join(points, ["sid", "cls"]).select(cell, "block", "mine", "cg", "last", "sid", "n", "tile", "comp", "counts", "contents", "marks")
        found = rows.repartition("cell").sortWithinPartitions("cell", "block", "mine", "sid").mapInArrow(_search(num, den, labels is None), "a long, b long, like double")
        if labels is None:
            return s.table(found.groupBy("a").agg(F.max_by("b", F.struct("like", "b")).alias("b")), "pairs")
        return s.table(found.select("a", "b").distinct(), "pairs")

    pairs = search(None)
    sets = sets_of(pairs)
    first = s.table(verified(pairs, sets, num, den), "links")
    s.drop(pairs, sets)
    pairs = search(components(first, s))
    s.drop(points)
    sets = sets_of(pairs)
    second = s.table(verified(pairs, sets, num, den), "links")
    s.drop(pairs, sets)
    return first.union(second)


def text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id (long), text and text_hash: what tells rows apart even if they share an id or have none."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_hash().alias("text_hash"))


def shingle_components(docs: DataFrame, k: int, num: int, den: int, tile: int = TILE) -> DataFrame:
    """doc_id, n (set size), sid, text_hash (``keyed``) and component_id (smallest doc_id reachable by links) of ``docs`` (``doc_id``, ``text``).

    Two texts link when den * intersection >= num * union of their k-word shingle sets.
    """
    docs = keyed(docs)
    with Scratch(docs.sparkSession) as s:
        members = s.table(docs.mapInArrow(_members(k), "doc_id long, n long, sid long, text_hash long"), "members")
        chunks = docs.select("text").mapInArrow(_keys(k, num, den, buckets_of(docs.sparkSession)), "bucket long, chunk binary")
        keys = chunks.repartition("bucket").select("chunk").mapInArrow(_undealt, "key long, cg long, sid long")
        live = keys.sortWithinPartitions("key", "sid").mapInArrow(_live, "block long, cg long, sid long")
        blocks = s.table(live.groupBy("block", "sid").agg(F.min("cg").alias("cg"), F.max("cg").alias("last")), "blocks")

        def fetch(wanted: DataFrame) -> DataFrame:
            reps = s.table(members.join(wanted, "sid", "left_semi").groupBy("sid").agg(F.min("text_hash").alias("text_hash")), "reps")
            return docs.select("text", "text_hash").mapInArrow(_sets(k, sieve(reps.select("text_hash"))), "sid long, hashes binary")

        labels = components(link_sets(s, blocks, fetch, num, den, tile), s).withColumnRenamed("node", "sid")
        named = members.join(labels, "sid", "left").withColumn("component", F.coalesce("component", "sid"))
        # the smallest document of each set, then of each component: copies are counted before they meet
        smallest = members.where("n > 0").groupBy("sid").agg(F.min("doc_id").alias("doc_id"))
        smallest = smallest.join(labels, "sid", "left").groupBy(F.coalesce("component", "sid").alias("component")).agg(F.min("doc_id").alias("first"))
        out = named.join(smallest, "component", "left")
        first = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.coalesce("first", "doc_id"))
        return materialize(out.select("doc_id", "n", "sid", "text_hash", first.alias("component_id"), "component"), "components")
