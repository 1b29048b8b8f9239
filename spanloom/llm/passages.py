"""Substring deduplication by paragraph MinHash banding and winnowed pieces.

Paragraphs are lines of at least ``least`` words. A paragraph's set of 5-word shingles gives ``BANDS`` bands of ``ROWS`` minima;
at Jaccard 0.8 a pair shares a band with probability 1 - (1 - 0.8^ROWS)^BANDS > 0.9998, at 0.02 with less than 1e-7. Paragraphs that share a band are
bounded by their count vectors, verified by exact Jaccard, and joined into components; of each component the first occurrence
(smallest document, then line) stays.

Passages that are no lines of their own are found by pieces of ``PIECE`` words over the whole text, whatever its lines: of every
``WINDOW`` successive ones the piece with the smallest hash is taken. Any run of ``PIECE + WINDOW - 1`` = 50 equal words has a
piece in common wherever it stands, and pieces that follow each other leave no word out, so a repeated run is covered but for
less than ``WINDOW`` words at either end. A piece that several texts hold is verified: one of the ``RUN`` = 51-word windows
around it must stand in two documents, so that a piece counts only as part of an equal run of over 50 words. Changed passages
are found by what runs on for 51 words, or as paragraphs. Pieces that stand in repeated paragraphs wherever they occur are not
reported again. Only what two documents hold is reported; what repeats inside one document alone is not.

Equal sets are one point, so copies meet only in counts; pairs are found as in ``jaccard_join`` and never expanded per group.
Equal texts are one text: paragraphs and pieces belong to a text's hash and meet documents only at the end.

Edge cases: null and empty texts have no paragraphs; a null id sorts first and is one document; rows that share an id are one
document; an empty table returns no rows; texts of any length are cut into lines as they come; texts under 51 words have no
pieces; other columns are ignored by ``repeated`` and kept by ``removed``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .jaccard_join import TILE, _live, group_index, keyed, link_sets, packed, set_ids, text_hash
from .sieve import places, sieve
from .storage import Scratch, free_name, materialize
from .words import U, mix, segments, shingle_sets, slices, split_words, word_hashes

K, NUM, DEN = 5, 8, 10
BANDS, ROWS = 22, 5
#: Words of a piece, and successive pieces of which one is taken.
PIECE, WINDOW = 26, 25
#: Words of a run that counts.
RUN = 51
#: Groups of the count vectors that bound a colliding pair.
GROUPS = 64
_SEEDS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15))


def paragraphs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Text index, line number, start and length (code points) and value of every line."""
    lists = pc.split_pattern(texts, "\n")
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    owner, line = segments(np.diff(offsets))
    length = pc.utf8_length(flat).to_numpy(zero_copy_only=False).astype(np.int64)
    step = np.cumsum(length + 1) - (length + 1)
    first = np.searchsorted(owner, owner)
    return owner, line, step - step[first], length, flat


def _grams(w: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each word on, of doubled parts."""
    ahead = lambda x, s: np.concatenate([x[s:], np.zeros(min(s, len(x)), U)])
    join = lambda x, y: mix(x * U(0x9E3779B97F4A7C15) + y)
    out, done, part, s = np.full(len(w), U(size)), 0, w, 1
    while s <= size:
        if size & s:
            out, done = join(out, ahead(part, done)), done + s
        part, s = join(part, ahead(part, s)), 2 * s
    return out


def pieces(offsets: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of the pieces that winnowing takes, by word offsets per text and the words' hashes."""
    n = np.diff(offsets)
    m = max(len(w) - PIECE - WINDOW + 2, 0)  # windows
    g = _grams(w, PIECE)
    # the place stands in the low bits: of equal hashes the last is taken
    low = U((1 << 28) - 1)
    best, s = (g & ~low) | (low - np.arange(len(g), dtype=U)), 1
    while 2 * s <= WINDOW:
        best, s = np.minimum(best[:-s], best[s:]), 2 * s
    best = np.minimum(best[:m], best[WINDOW - s : WINDOW - s + m])
    owner, pos = segments(n)
    took = np.unique((low - (best & low))[(pos <= n[owner] - PIECE - WINDOW + 1)[:m]].astype(np.int64))
    return took, g[took]


def word_places(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end (code points of the text) and line number of every word."""
    texts = texts.cast(pa.large_binary())
    own = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[own[0] : own[-1]]
    own = own - own[0]
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    before, after = np.concatenate([[True], blank]), np.concatenate([blank, [True]])
    before[own], after[own] = True, True
    first, end = np.flatnonzero(~blank & before[:-1]), np.flatnonzero(~blank & after[1:]) + 1
    text = own[np.searchsorted(own, first, "right") - 1]
    point = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    line = np.concatenate([[0], np.cumsum(data == 10)])
    return point[first] - point[text], point[end] - point[text], line[first] - line[text]


def bands_of(offsets: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Band hashes (sets x BANDS) of non-empty sets."""
    out = np.empty((len(offsets) - 1, BANDS), U)
    for b in range(BANDS):
        acc = np.full(len(offsets) - 1, U(b + 1))
        for r in range(ROWS):
            low = np.minimum.reduceat(mix(hashes ^ _SEEDS[b * ROWS + r]), offsets[:-1])
            acc = mix(acc * U(0xD1B54A32D192ED03) + low)
        out[:, b] = acc
    return out


def _filled(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keep = np.flatnonzero(np.diff(offsets))
    return keep, np.concatenate([offsets[keep], offsets[-1:]])


def _new(batches: Iterator[pa.RecordBatch], words: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Small batches of (text, text_hash) without the copies that this task has seen, and only of hashes that may be in a sieve."""
    seen: set[int] = set()
    for b in slices(batches):
        ok = np.ones(b.num_rows, bool)
        if words is not None:
            at, bit = places(b.column(1))
            ok = (words[at] & bit) != 0
        new = []
        for i in np.flatnonzero(ok).tolist():
            h = b.column(1)[i].as_py()
            if h not in seen:
                seen.add(h)
                new.append(i)
        if new:
            yield b.take(pa.array(new))


#: What the first pass says: paragraphs with their bands (piece and pos null), and pieces (the others null).
SAID = "text_hash long, line int, start long, length long, sid long, bands array<long>, piece long, pos int"
SAID_TYPES = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int32())


def _said(least: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _new(batches):
            owner, line, start, length, flat = paragraphs(b.column(0))
            words, w = split_words(flat)
            w = word_hashes(w)
            offsets, h = shingle_sets(flat, K, least, (words, w))
            keep, ends = _filled(offsets)
            sid = set_ids(offsets, h)[keep]
            bands = bands_of(ends, h).view(np.int64) if len(keep) else np.zeros((0, BANDS), np.int64)
            words = words[np.searchsorted(owner, np.arange(b.num_rows + 1))]  # of texts instead of lines
            took, piece = pieces(words, w)
            of = np.searchsorted(words, took, "right") - 1
            long_ = np.diff(words)[of] >= RUN
            took, piece, of = took[long_], piece[long_], of[long_]
            n, m = len(keep), len(took)
            hashes = b.column(1)
            cols = [hashes.take(pa.array(np.concatenate([owner[keep], of]))), *(x[keep] for x in (line, start, length)), sid, bands, piece.view(np.int64), took - words[of]]
            filled = [pa.concat_arrays([pa.array(x, t), pa.nulls(m, t)]) for x, t in zip(cols[1:5], SAID_TYPES[1:5], strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([np.arange(n + 1) * BANDS, np.full(m, n * BANDS)]).astype(np.int32)), pa.array(cols[5].ravel()), mask=pa.array(np.arange(n + m) >= n))
            later = [pa.concat_arrays([pa.nulls(n, t), pa.array(x, t)]) for x, t in zip(cols[6:], SAID_TYPES[6:], strict=True)]
            yield pa.RecordBatch.from_arrays([cols[0], *filled, lists, *later], names=[c.split()[0] for c in SAID.split(", ")])

    return run


def _paragraph_sets(least: int, words: np.ndarray) -> Callable:
    """Sets of the paragraphs of texts whose hash may be in the sieve ``words``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _new(batches, words):
            offsets, h = shingle_sets(paragraphs(b.column(0))[4], K, least)
            keep, ends = _filled(offsets)
            raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(keep), [None, pa.py_buffer((ends * 8).astype(np.int64)), pa.py_buffer(h)])
            yield pa.RecordBatch.from_arrays([pa.array(set_ids(offsets, h)[keep]), raw.cast(pa.binary())], names=["sid", "hashes"])

    return run


def _wanted_texts(words: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _new(batches, words):
            yield b.select(["text_hash", "text"])

    return run


#: Pieces of a text by number, with the sets of their first and last lines (0 if a further line with words is between them);
#: and the 51-word windows around them: those that hold the pieces low to high, by hash.
PLACED_BYTES = 1 << 18  # of text at once: a row for every dozen words is made from it
PLACED = "text_hash long, copied boolean, k int, line int, start long, length long, piece long, one long, two long, low int, high int, hashes array<long>"


def _placed(least: int) -> Callable:
    """Of texts with the positions of shared pieces: a row for each of these (of copied texts: each piece), and for each run of windows around shared ones that hold the same pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, limit=PLACED_BYTES):
            owner, _, _, _, flat = paragraphs(b.column(1))
            words, w = split_words(flat)
            w = word_hashes(w)
            sid = set_ids(*shingle_sets(flat, K, least, (words, w)))
            words = words[np.searchsorted(owner, np.arange(b.num_rows + 1))]
            took, piece = pieces(words, w)
            begin, end, on = word_places(b.column(1))
            turns = np.concatenate([[0], np.cumsum(on[1:] != on[:-1])])
            grams = _grams(w, RUN)
            rows: list[tuple] = []
            for i, (text, want, copied) in enumerate(zip(*(b.column(c).to_pylist() for c in (0, 2, 3)), strict=True)):
                a, z = words[i], words[i + 1]
                if z - a < RUN:
                    continue
                own = slice(*np.searchsorted(took, [a, z]))
                shared = np.isin(took[own] - a, want or [])
                at = took[own] if copied else took[own][shared]
                name = piece[own] if copied else piece[own][shared]
                last, row = at + PIECE - 1, np.searchsorted(owner, i)
                near = turns[last] - turns[at] <= 1
                one, two = (np.where(near, sid[row + on[x]], 0) for x in (at, last))
                rows += zip(
                    *([x] * len(at) for x in (text, copied)), range(len(at)), *(x.tolist() for x in (on[at], begin[at], end[last] - begin[at], name.view(np.int64), one, two)), *([None] * len(at) for _ in range(3)),
                    strict=True,
                )
                core = took[own][shared]
                if not len(core):
                    continue
                starts = np.unique((core[:, None] - np.arange(RUN - PIECE + 1)[None, :]).ravel())
                starts = starts[(starts >= a) & (starts <= z - RUN)]
                low, high = np.searchsorted(at, starts), np.searchsorted(at, starts + RUN - PIECE, "right") - 1
                cut = np.flatnonzero(np.concatenate([[True], (low[1:] != low[:-1]) | (high[1:] != high[:-1])]))
                rows += [(text, copied, *[None] * 7, int(low[s]), int(high[s]), grams[starts[s:e]].view(np.int64)) for s, e in zip(cut, np.append(cut[1:], len(starts)), strict=True)]
            types = (pa.int64(), pa.bool_(), pa.int32(), pa.int32(), *[pa.int64()] * 5, pa.int32(), pa.int32(), pa.list_(pa.int64()))
            cols = list(zip(*rows, strict=True)) if rows else [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[c.split()[0] for c in PLACED.split(", ")])

    return run


def _points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for part in (b.slice(i, 512) for i in range(0, b.num_rows, 512)):
            raws = part.column(1).to_pylist()
            ends = np.concatenate([[0], np.cumsum([len(r) // 8 for r in raws])])
            h = np.frombuffer(b"".join(raws), U)
            n = np.diff(ends)
            marks = bands_of(ends, h)
            cell = np.repeat(np.arange(len(n)), n) * GROUPS + group_index(h, GROUPS)
            counts = np.bincount(cell, minlength=len(n) * GROUPS).reshape(-1, GROUPS)
            content = np.zeros(len(n) * GROUPS, U)
            np.add.at(content, cell, mix(h))
            content = (content >> U(32)).astype(np.uint32).reshape(-1, GROUPS)
            binary = lambda rows: pa.array([x.tobytes() for x in rows], pa.binary())
            cols = [part.column(0), pa.array(np.zeros(len(n), np.int64)), pa.array(n.astype(np.int64)), pa.array([packed(x) for x in counts], pa.binary()), binary(content), binary(marks)]
            yield pa.RecordBatch.from_arrays(cols, names=["sid", "cls", "n", "counts", "contents", "marks"])


def repeated(docs: DataFrame, least: int = 10, tile: int = TILE) -> DataFrame:
    """doc_id, line, start, length, component_id, occurrences, keep of every paragraph or piece of ``docs`` (``doc_id``, ``text``) that repeats.

    start and length are code points of the text, line is that of the first word; component_id is the smallest document that holds one
    of the component's paragraphs, or the piece; occurrences counts the component's paragraphs, or the piece's places.
    """
    return _repeated(docs, least, tile).drop("text_hash", "is_piece")


def _paragraph_classes(s: Scratch, texts: DataFrame, said: DataFrame, per_text: DataFrame, least: int, tile: int) -> DataFrame:
    """sid, occurrences and first (doc_id, line, start, length) of the paragraphs that repeat across documents."""
    spans = said.where("piece is null").select("text_hash", "line", "start", "length", "sid").dropDuplicates(["text_hash", "line"])
    keys = said.where("piece is null").select(F.posexplode("bands").alias("band", "key"), "sid")
    live = keys.select("key", F.col("band").cast("long").alias("cg"), "sid").repartition("key").sortWithinPartitions("key", "sid").mapInArrow(_live, "block long, cg long, sid long")
    blocks = s.table(live.groupBy("block", "sid").agg(F.min("cg").alias("cg"), F.max("cg").alias("last")), "blocks")

    def fetch(wanted: DataFrame) -> DataFrame:
        reps = s.table(spans.join(wanted, "sid", "left_semi").groupBy("sid").agg(F.min("text_hash").alias("text_hash")), "reps")
        return texts.mapInArrow(_paragraph_sets(least, sieve(reps.select("text_hash"))), "sid long, hashes binary")

    labels = components(link_sets(s, blocks, fetch, NUM, DEN, tile, _points), s).withColumnRenamed("node", "sid")
    # copies are counted before they meet: a text's rows and its smallest and largest document
    where = F.struct("low.doc_id", "line", "start", "length")
    counts = spans.join(per_text, "text_hash").groupBy("sid").agg(F.sum("rows").alias("n"), F.min(where).alias("at"), F.min("low").alias("low"), F.max("high").alias("high"))
    labelled = counts.join(labels, "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    many = labelled.groupBy("component").agg(F.sum("n").alias("occurrences"), F.min("at").alias("first"), F.min("low").alias("low"), F.max("high").alias("high")).where("low <> high")
    return s.table(labelled.join(many.select("component", "occurrences", "first"), "component").select("sid", "occurrences", "first"), "classes")


def _pieces(s: Scratch, texts: DataFrame, said: DataFrame, per_text: DataFrame, least: int) -> DataFrame:
    """text_hash, line, start, length, piece, one and two of the pieces that are part of a run of ``RUN`` words in two documents."""
    took = said.where("piece is not null").select("text_hash", "piece", "pos")
    # tables of their own, so that Spark can split the rows of a hot piece or window in the joins
    shared = s.table(took.groupBy("piece").agg(F.min("text_hash").alias("a"), F.max("text_hash").alias("b")).where("a <> b").select("piece"), "shared")
    at = took.join(shared, "piece", "left_semi").groupBy("text_hash").agg(F.collect_set("pos").alias("pos"))  # bounded by a text's length
    copies = per_text.where("low <> high").select("text_hash", F.lit(True).alias("copied"))
    need = s.table(at.join(copies, "text_hash", "full_outer").select("text_hash", "pos", F.coalesce("copied", F.lit(False)).alias("copied")), "need")
    found = texts.mapInArrow(_wanted_texts(sieve(need.select("text_hash"))), "text_hash long, text string").join(need, "text_hash").dropDuplicates(["text_hash"])
    placed = s.table(found.select("text_hash", "text", "pos", "copied").mapInArrow(_placed(least), PLACED), "placed")
    rows = placed.where("hashes is null").drop("low", "high", "hashes")
    windows = placed.where("hashes is not null").select("text_hash", "low", "high", F.explode("hashes").alias("h"))
    twice = s.table(windows.groupBy("h").agg(F.min("text_hash").alias("a"), F.max("text_hash").alias("b")).where("a <> b").select("h"), "twice")
    good = windows.join(twice, "h", "left_semi").select("text_hash", "low", "high").distinct()
    good = good.select("text_hash", F.explode(F.sequence("low", "high")).alias("k")).distinct()
    # the text itself stands in two documents, or one of the windows around the piece in two texts
    return s.table(rows.where("copied").unionByName(rows.where("not copied").join(good, ["text_hash", "k"], "left_semi")).drop("copied", "k"), "verified")


def _repeated(docs: DataFrame, least: int = 10, tile: int = TILE) -> DataFrame:
    """``repeated`` with text_hash and is_piece."""
    docs = keyed(docs)
    texts, rows = docs.select("text", "text_hash"), docs.select("doc_id", "text_hash")
    with Scratch(docs.sparkSession) as s:
        said = s.table(texts.mapInArrow(_said(least), SAID), "said")
        per_text = s.table(rows.groupBy("text_hash").agg(F.count("*").alias("rows"), F.min(F.struct("doc_id")).alias("low"), F.max(F.struct("doc_id")).alias("high")), "texts")
        classes = _paragraph_classes(s, texts, said, per_text, least, tile)
        lines = said.where("piece is null").select("text_hash", "line", "start", "length", "sid").join(classes, "sid").dropDuplicates(["text_hash", "line"]).drop("sid")
        verified = _pieces(s, texts, said, per_text, least)
        where = F.struct("low.doc_id", "line", "start", "length")
        ends = verified.select("piece", "one", "two").distinct()
        inside = ends.where("one <> 0 and two <> 0")
        for end in ("one", "two"):
            inside = inside.join(classes.select(F.col("sid").alias(end), F.lit(True).alias(f"in_{end}")), end, "left")
        outside = ends.where("one = 0 or two = 0").select("piece").unionByName(inside.where("in_one is null or in_two is null").select("piece")).distinct()
        named = verified.join(outside, "piece").join(per_text, "text_hash")
        whole = named.groupBy("piece").agg(F.sum("rows").alias("occurrences"), F.min(where).alias("first"))
        placed = verified.join(whole, "piece").select("text_hash", "line", "start", "length", "occurrences", "first")
        every = lines.withColumn("is_piece", F.lit(False)).unionByName(placed.withColumn("is_piece", F.lit(True)), allowMissingColumns=True)
        out = rows.join(every, "text_hash")
        here = F.struct("doc_id", "line", "start", "length")
        return materialize(
            out.select("doc_id", "line", "start", "length", F.col("first.doc_id").alias("component_id"), "occurrences", here.eqNullSafe(F.col("first")).alias("keep"), "text_hash", "is_piece"),
            "repeated",
        )


def _left(text: str, lines: str, cuts: str) -> Callable:
    """Texts without their dropped lines and pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i = b.schema.get_field_index(text)
            texts = b.column(i).to_pylist()
            for j, (drop, cut) in enumerate(zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in (lines, cuts)), strict=True)):
                if texts[j] is None or not (drop or cut):
                    continue
                stays = np.ones(len(texts[j]), bool)
                for c in cut or ():
                    stays[c["start"] : c["start"] + c["length"]] = False
                out, begin, gone = [], 0, set(drop or ())
                for n, line in enumerate(texts[j].split("\n")):
                    if n not in gone:
                        mask = stays[begin : begin + len(line)]
                        out.append(line if mask.all() else "".join(c for c, ok in zip(line, mask, strict=True) if ok))
                    begin += len(line) + 1
                texts[j] = "\n".join(out)
            yield b.set_column(i, b.schema.field(i), pa.array(texts, b.column(i).type)).select([c for c in b.schema.names if c not in (lines, cuts)])

    return run


def removed(docs: DataFrame, **options) -> DataFrame:
    """``docs`` whose repeated paragraphs and pieces stay only where they occur first."""
    doc, key, lines, cuts = (free_name(docs, c) for c in ("doc", "key", "lines", "cuts"))
    drop = _repeated(docs, **options).where("not keep").groupBy(F.col("doc_id").alias(doc), F.col("text_hash").alias(key)).agg(
        F.collect_set(F.when(~F.col("is_piece"), F.col("line"))).alias(lines), F.collect_set(F.when(F.col("is_piece"), F.struct("start", "length"))).alias(cuts)
    )
    joined = docs.join(drop, F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (text_hash() == F.col(key)), "left")
    return joined.select(*(f"`{c}`" for c in docs.columns), lines, cuts).mapInArrow(_left("text", lines, cuts), docs.schema)
