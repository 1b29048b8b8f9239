"""Tokenizer ids, packing and the ORC store: exact round trips."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from spanloom.llm import packing, token_store
from spanloom.llm.words import ByteLevel, Chunks, encoder, split_words
from tests.llm.util import AWKWARD, docs, low, words

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
PARTS = ["a", "B", "\n", " ", "\t", "\x0b", "\x1c", "\x85", "\xa0", "\u2003", "\u3000", "é", "e\u0301", "1", "23", "!", "'s", "<|endoftext|>", "the", "ß", "İ", "中", "\u200b", "😀", "'"]


def encode(path, texts, end):
    t = Tokenizer.from_file(path)
    return [[*e.ids, end] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_chunks_are_exact(path):
    rng = random.Random(1)
    texts = ["".join(rng.choices(PARTS, k=rng.randint(0, 12))) for _ in range(4000)]
    c = Chunks(path)
    c.KEPT = 500
    tok = Tokenizer.from_file(path)
    for part in (texts[i : i + 900] for i in range(0, len(texts), 900)):
        offsets, ids = c.ids(pa.array(part))
        for i, e in enumerate(tok.encode_batch(part, add_special_tokens=False)):
            assert ids[offsets[i] : offsets[i + 1]].tolist() == e.ids, part[i]


def test_byte_level_is_exact():
    tokenizer, fast = Tokenizer.from_file(BYTE), encoder(BYTE)
    assert isinstance(fast, ByteLevel) and isinstance(encoder(WORD), Chunks)
    rng = random.Random(7)
    odd = [chr(c) for c in range(0x2500)] + [chr(c) for c in range(0x2500, 0x110000, 97) if not 0xD800 <= c <= 0xDFFF]
    texts = [f"x{c}y {c}{c} 1{c} \n{c}  {c}.'s" for c in odd]
    texts += ["".join(rng.choice(" \n\t'stéaAß中1.!<|>" + rng.choice(odd)) for _ in range(rng.randint(0, 200))) for _ in range(3000)]
    texts += ["", "a" * 50_000, " " * 50_000, "a <|endoftext|> b", "<|endoftext|>", "a<|endoftext"]
    offsets, ids = fast.ids(pa.array(texts))
    want = tokenizer.encode_batch(texts, add_special_tokens=False)
    assert [ids[a:z].tolist() for a, z in zip(offsets[:-1], offsets[1:], strict=True)] == [e.ids for e in want]


def test_words():
    rng = random.Random(2)
    texts = ["".join(rng.choices(PARTS, k=rng.randint(0, 12))) for _ in range(3000)]
    offsets, flat = split_words(pa.array(texts))
    flat = flat.to_pylist()
    assert all(flat[offsets[i] : offsets[i + 1]] == words(low(t)) for i, t in enumerate(texts))


def test_packing(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma42"]) for _ in range(rng.choice([0, 3, 40, 700])))) for i in range(10, 150)]
    rows += [r for r in AWKWARD if r != (4, "one")]
    df = docs(spark, rows)
    out = packing.pack(df, BYTE, size=256, open_windows=5).collect()
    ids = dict(zip([d for d, _ in rows], encode(BYTE, [t for _, t in rows], 0)))
    have, room = defaultdict(list), defaultdict(list)
    for r in out:
        piece = np.frombuffer(r.ids, "<u4").tolist()
        assert len(piece) == r.length and crc(piece) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        have[r.doc_id].append((r.start, piece))
        room[r.sequence_id].append((r.offset, r.length))
    assert {d: sum((p for _, p in sorted(x)), []) for d, x in have.items()} == ids
    for parts in room.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256 and at & (at - 1) == 0  # full, or at a power of two: no padding
    assert packing.pack(df.where("false"), BYTE).count() == 0
    assert packing.pack(docs(spark, [(4, "one"), (4, "one")]), BYTE).count() == 2


def test_token_store(spark, tmp_path):
    rows = [(i * 7 % 101, f"Word {i} and more of it. " * (i % 9)) for i in range(100)] + AWKWARD
    df = docs(spark, rows)
    path = str(tmp_path / "tokens")
    token_store.write_tokens(df, path, WORD, 2)
    out = token_store.digest(token_store.read_tokens(spark, path)).collect()
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    at, want = 0, []
    for (d, _), ids in zip(rows, encode(WORD, [t for _, t in rows], 2)):
        want.append((d, at, len(ids), crc(ids)))
        at += len(ids)
    assert sorted(map(tuple, out), key=lambda r: r[1]) == want
    assert [r.n_tokens for r in token_store.lookup(spark, path, [14]).collect()] == [n for d, _, n, _ in want if d == 14]
    token_store.write_tokens(df.where("false"), str(tmp_path / "none"), WORD, 2)
    assert token_store.read_tokens(spark, str(tmp_path / "none")).count() == 0


def test_pieces_of_chunks_are_found_at_once():
    rng = random.Random(11)
    letters = [chr(c) for c in range(0x260)]
    texts = [f"x{c}y {c}{c} 1{c} \n{c}  {c}.'S {c}'lL" for c in letters]
    texts += ["".join(rng.choice([*" 'aZ1.<|stRe", *rng.sample(letters, 3)]) for _ in range(rng.randint(1, 60))) for _ in range(3000)]
    tokenizer, c = Tokenizer.from_file(WORD), Chunks(WORD)
    offsets, ids = c.ids(pa.array(texts))
    want = tokenizer.encode_batch(texts, add_special_tokens=False)
    assert [ids[a:z].tolist() for a, z in zip(offsets[:-1], offsets[1:], strict=True)] == [e.ids for e in want]
    c.forget()
    c.ids(pa.array(["Grün, grün! GRÜN? (grün) don't DON'T 1 11 111"]))
    assert {p for p in c.of_piece if p.isalpha()} <= {"grün", "grÜn", "don", "t"} and not c.known  # a piece is encoded once, whatever its chunk
