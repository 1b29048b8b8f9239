"""Vectorised words, shingles and tokenizer ids over Arrow string batches (NumPy and Arrow kernels, no per-word Python)."""

from __future__ import annotations

import ctypes
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash

U = np.uint64
#: The letters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others from U+0100 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LETTERS = dict(zip(_SHOWN + [b for b in range(256) if b not in _SHOWN], [chr(b) for b in _SHOWN] + [chr(256 + i) for i in range(256 - len(_SHOWN))], strict=True))
_LETTERS = {b: BYTE_LETTERS[b] for b in range(256)}
#: Bytes of a string that is hashed with others.
LONG = 256
#: Masks of the first bytes of eight.
_FIRST = np.array([(1 << 8 * i) - 1 for i in range(9)], U)
#: Text bytes that a kernel takes at once; one longer text is taken alone.
SLICE_BYTES = 2 << 20


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that their text stays under ``limit`` bytes; null text becomes empty."""
    for batch in batches:
        at = batch.schema.get_field_index(text)
        col = pc.fill_null(batch.column(at), "")
        batch = batch.set_column(at, pa.field(text, col.type), col)
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.binary_length(col).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop
    release()


def release() -> None:
    """Give a finished task's memory back: an idle worker stays beside the next stage's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit values."""
    y = x >> U(30)
    y ^= x
    y *= U(0xBF58476D1CE4E5B9)
    y ^= y >> U(27)
    y *= U(0x94D049BB133111EB)
    y ^= y >> U(31)
    return y


def split_words(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, pa.Array]:
    """Offsets per text and the flat array of its words, maximal runs of no ASCII white space."""
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    offsets = offsets - offsets[0]
    keep = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    before = np.concatenate([[0], np.cumsum(keep)])
    return before[offsets], flat.filter(pa.array(keep))


def hash_values(flat: pa.Array) -> np.ndarray:
    """64-bit hash of each string; only distinct strings are hashed."""
    if not len(flat):
        return np.zeros(0, U)
    coded = pc.dictionary_encode(flat)
    own = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), U, len(coded.dictionary))
    return own[coded.indices.to_numpy()]


def word_hashes(flat: pa.Array) -> np.ndarray:
    """64-bit hash of each string: its length, then eight bytes at a time, are mixed in; strings over ``LONG`` bytes are hashed one by one."""
    if not len(flat):
        return np.zeros(0, U)
    flat = flat.cast(pa.large_binary())
    ends = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1]
    data = np.concatenate([np.frombuffer(flat.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]], np.zeros(8, np.uint8)])
    at, left = ends[:-1] - ends[0], np.diff(ends)
    eight = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))  # from each byte on
    out = mix(left.astype(U) * U(0x9E3779B97F4A7C15) + U(1))
    long_ = np.flatnonzero(left > LONG)
    for i in long_.tolist():
        out[i] = xxhash.xxh3_64_intdigest(flat[i].as_py())
    on = np.flatnonzero((left > 0) & (left <= LONG)) if len(long_) or not left.all() else None
    while on is None or len(on):
        rows = slice(None) if on is None else on
        rest = left[rows]
        part = eight[at[rows]] & _FIRST[np.minimum(rest, 8)]
        out[rows] = mix((out[rows] ^ part) * U(0xD1B54A32D192ED03) + U(0x51ED))
        more = np.flatnonzero(rest > 8)
        on = more if on is None else on[more]
        at[on] += 8
        left[on] -= 8
    return out


def segments(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and position inside the owner for ragged rows of the given lengths."""
    owner = np.repeat(np.arange(len(lengths)), lengths)
    starts = np.cumsum(lengths) - lengths
    return owner, np.arange(len(owner)) - starts[owner]


def shingle_sets(texts: pa.Array, k: int, least: int = 1, split: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and the sorted distinct hashes of each text's k-word shingles; fewer words count as one shingle; texts of less than ``least`` words have none. ``split`` has the word offsets and hashes if they are known."""
    if split is None:
        offsets, flat = split_words(texts)
        split = offsets, word_hashes(flat)
    offsets, w = split
    n = np.diff(offsets)
    padded = np.concatenate([w, np.zeros(k, U)])
    h = np.full(len(w), U(k))
    for j in range(k):
        h = mix(h * U(0x9E3779B97F4A7C15) + padded[j : j + len(w)])
    owner, pos = segments(n)
    ok = pos <= np.where(n >= least, n - k, -1)[owner]
    short = np.flatnonzero((n >= max(least, 1)) & (n < k))
    tail = [xxhash.xxh3_64_intdigest(w[offsets[i] : offsets[i + 1]].tobytes(), seed=int(n[i])) for i in short]
    owner = np.concatenate([owner[ok], short])
    h = np.concatenate([h[ok], np.array(tail, U)])
    # one sort by (owner, hash): the owner stands in the top bits of the key only for ordering within a slice
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    first = np.ones(len(h), bool)
    first[1:] = (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])
    owner, h = owner[first], h[first]
    return np.searchsorted(owner, np.arange(len(n) + 1)), h


def gathered(pool: np.ndarray, begin: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parts of a pool one after another, and their ends with a first 0."""
    ends = np.concatenate([[0], np.cumsum(n)])
    at = np.repeat(begin - ends[:-1], n)
    at += np.arange(len(at))
    return pool[at], ends


#: The word vocabulary's pattern; no piece holds white space.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


#: What plain letters are in it: 0 white space, 1 letters, 2 numbers, 3 others.
_KINDS = np.array([0 if regex.match(r"\s", c) else 1 if regex.match(r"\p{L}", c) else 2 if regex.match(r"\p{N}", c) else 3 for c in map(chr, range(0x250))])


class Chunks:
    """Exact tokenizer ids by encoding each distinct chunk of a slice once.

    A text is cut before every single ASCII white-space character between two other characters. Both public vocabularies
    split there anyway: the byte-level pattern takes one leading blank with what follows and any other single white space
    alone, and the word vocabulary drops white space. No cut is made beside a non-ASCII white-space character.

    Chunks of plain letters (below U+0250, which NFC keeps and which lower-case to one letter) are put together from the ids of
    their pieces, which are found in all of them at once; others go to the library. Only distinct pieces are handled one by one.
    """

    #: Distinct pieces, and chunks of other letters, kept between slices and tasks of a worker; beyond that only those of the present slice stay.
    KEPT = 700_000
    #: Stands between chunks, with white space around it; no plain letter.
    BETWEEN = "\ue000"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.pieces = self._piece_pattern()
        self.forget()

    def _piece_pattern(self):
        """The pre-tokenizer's pattern if a chunk's ids are those of its pieces: NFC, white space and case folding, split, byte letters."""
        said = json.loads(self.tokenizer.to_str())
        steps = [x["type"] for x in (said["normalizer"] or {}).get("normalizers", [])]
        pre = (said["pre_tokenizer"] or {}).get("pretokenizers", [])
        if steps != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in pre] != ["Split", "ByteLevel"]:
            return None
        if not pre[0]["invert"] or pre[0]["behavior"] != "Removed" or pre[1]["use_regex"] or pre[1]["add_prefix_space"]:
            return None
        if pre[0]["pattern"].get("Regex") != WORD_PATTERN:
            return None  # another one might take white space
        return regex.compile(f"{self.BETWEEN}|{WORD_PATTERN}")

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.of_piece: dict[str, int] = {self.BETWEEN: 0}
        self.sizes = np.zeros(1, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def _learn(self, got: list[list[int]]) -> range:
        """Codes of new lists of ids."""
        self.sizes = np.concatenate([self.sizes, np.fromiter(map(len, got), np.int64, len(got))])
        self.pool = np.concatenate([self.pool, np.fromiter(chain.from_iterable(got), np.uint32)])
        return range(len(self.sizes) - len(got), len(self.sizes))

    def _pieces_known(self, pieces: list[str]) -> np.ndarray:
        """Codes of pieces of plain letters; new ones are encoded."""
        if new := list(set(pieces).difference(self.of_piece)):
            tokenize = self.tokenizer.model.tokenize
            letters = (p if p.isascii() and p.isprintable() else p.lower().encode().decode("latin-1").translate(_LETTERS) for p in new)
            self.of_piece.update(zip(new, self._learn([[x.id for x in tokenize(p)] for p in letters]), strict=True))
        return np.fromiter(map(self.of_piece.__getitem__, pieces), np.int64, len(pieces))

    @staticmethod
    def plain(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Which chunks have plain letters only, and nothing like an added token; which have an apostrophe."""
        ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
        data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[: ends[-1]]
        odd = data >= 0xCA
        odd[:-1] |= ((data[:-1] == 0xC9) & (data[1:] > 0x8F)) | ((data[:-1] == 0xC4) & (data[1:] == 0xB0)) | ((data[:-1] == 0x3C) & (data[1:] == 0x7C))
        holds = lambda x: (before := np.concatenate([[0], np.cumsum(x)]))[ends[1:]] > before[ends[:-1]]
        return ~holds(odd), holds(data == 0x27)

    @staticmethod
    def split(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """Number of pieces of each chunk of plain letters without apostrophes, and all pieces: runs of letters, single numbers, runs of others; A-Z is lower-cased."""
        ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
        data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
        ends = ends - ends[0]
        more = (data & 0xC0) == 0x80
        point = data.astype(np.int64)
        lead = np.flatnonzero(data >= 0xC0)
        point[lead] = point[lead + 1] = (point[lead] & 0x1F) << 6 | (point[lead + 1] & 0x3F)
        kind = _KINDS[point]
        cut = np.ones(len(data) + 1, bool)
        cut[1:-1] = ((kind[1:] != kind[:-1]) | (kind[1:] == 2)) & ~more[1:]
        cut[ends] = True
        start = np.flatnonzero(cut)
        keep = kind[start[:-1]] > 0
        data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
        flat = pa.Array.from_buffers(pa.large_string(), len(keep), [None, pa.py_buffer(start.astype(np.int64)), pa.py_buffer(data)])
        return np.diff(np.concatenate([[0], np.cumsum(keep)])[np.searchsorted(start, ends)]), flat.filter(pa.array(keep))

    def _codes(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A new order of distinct chunks, each one's number of codes in that order, and their codes."""
        if len(self.known) + len(self.of_piece) > self.KEPT:
            self.forget()
        plain, quoted = self.plain(words) if self.pieces else np.zeros((2, len(words)), bool)
        sorts = plain & ~quoted, plain & quoted, ~plain
        order, n, codes = np.concatenate(list(map(np.flatnonzero, sorts))), [], []
        smooth, quotes, other = (words.filter(pa.array(x)) for x in sorts)
        if len(smooth):
            number, flat = self.split(smooth)
            coded = pc.dictionary_encode(flat)
            n.append(number)
            codes.append(self._pieces_known(coded.dictionary.to_pylist())[coded.indices.to_numpy()])
        if len(quotes):
            got = self._pieces_known(self.pieces.findall(f" {self.BETWEEN} ".encode().join(quotes.to_pylist()).decode().lower()))
            n.append(np.diff(np.concatenate([[-1], np.flatnonzero(got == 0), [len(got)]])) - 1)
            codes.append(got[got != 0])
        if len(other):
            other = other.to_pylist()
            if new := [w for w in other if w not in self.known]:
                got = self.tokenizer.encode_batch_fast([w.decode() for w in new], add_special_tokens=False)
                self.known.update(zip(new, self._learn([e.ids for e in got]), strict=True))
            n.append(np.ones(len(other), np.int64))
            codes.append(np.fromiter(map(self.known.__getitem__, other), np.int64, len(other)))
        return order, np.concatenate(n), np.concatenate(codes)

    @staticmethod
    def cut(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """Chunk offsets per text and the flat chunk array (over the same bytes)."""
        texts = texts.cast(pa.large_binary())
        own = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[own[0] : own[-1]]
        own = own - own[0]
        if not len(data):
            return np.zeros(len(texts) + 1, np.int64), pa.array([], pa.large_binary())
        blank = (data == 32) | ((data >= 9) & (data <= 13))
        # lead bytes of characters that may be white space outside ASCII, and 0x1C-0x1F
        odd = (data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3)) | ((data >= 0x1C) & (data <= 0x1F))
        cut = np.zeros(len(data) + 1, bool)
        cut[1 : len(data) - 1] = blank[1:-1] & ~blank[:-2] & ~blank[2:] & ~odd[2:]
        filled = own[:-1][np.diff(own) > 0]
        cut[filled] = True
        cut[len(data)] = True
        starts = np.flatnonzero(cut)
        flat = pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
        return np.searchsorted(starts, own), flat

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Id offsets per text and all ids as unsigned 32-bit values."""
        offsets, flat = self.cut(texts)
        if not len(flat):
            return np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.uint32)
        coded = pc.dictionary_encode(flat)
        order, n, codes = self._codes(coded.dictionary)
        begin = np.cumsum(self.sizes) - self.sizes
        pool, ends = gathered(self.pool, begin[codes], self.sizes[codes])
        ends = ends[np.concatenate([[0], np.cumsum(n)])]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        code = place[coded.indices.to_numpy()]
        out, ends = gathered(pool, ends[:-1][code], np.diff(ends)[code])
        return ends[offsets], out


#: The byte-level pre-tokenizer's fixed pattern.
BYTE_PATTERN = r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteLevel:
    """Exact ids of a plain byte-level vocabulary by tiktoken's merging, several times as fast as the tokenizers library and without a cache.

    It holds where tokens are numbered in the order of their merges. Texts with an added token go to the library.
    """

    def __init__(self, tokenizer, said: dict):
        import tiktoken

        byte_of = {c: b for b, c in BYTE_LETTERS.items()}
        added = [t["content"] for t in said["added_tokens"]]
        ranks = {bytes(byte_of[c] for c in w): i for w, i in said["model"]["vocab"].items() if w not in added}
        self.tokenizer, self.added = tokenizer, added
        self.encode = tiktoken.Encoding("byte-level", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    @staticmethod
    def fits(said: dict) -> bool:
        pre, model = said["pre_tokenizer"] or {}, said["model"]
        if said["normalizer"] or said["truncation"] or said["padding"] or pre.get("type") != "ByteLevel" or pre["add_prefix_space"] or not pre.get("use_regex", True):
            return False
        if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            return False
        vocab, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        return {c for w in vocab for c in w} <= set(BYTE_LETTERS.values()) and all(vocab.get("".join(m)) == 256 + i for i, m in enumerate(merges))

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Id offsets per text and all ids as unsigned 32-bit values."""
        got = [
            np.array(self.tokenizer.encode(t, add_special_tokens=False).ids if any(x in t for x in self.added) else self.encode(t), np.uint32)
            for t in texts.to_pylist()
        ]
        return np.concatenate([[0], np.cumsum([len(x) for x in got], dtype=np.int64)]), np.concatenate([np.zeros(0, np.uint32), *got])


_ENCODERS: dict[str, Chunks | ByteLevel] = {}


def encoder(path: str) -> Chunks | ByteLevel:
    """The worker's encoder for a vocabulary file, kept between tasks."""
    if path not in _ENCODERS:
        import os

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokenizer = Tokenizer.from_file(path)
        said = json.loads(tokenizer.to_str())
        _ENCODERS[path] = ByteLevel(tokenizer, said) if ByteLevel.fits(said) else Chunks(path)
    return _ENCODERS[path]
