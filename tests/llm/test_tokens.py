"""Token counts, byte-level coding, shards and packing against the libraries."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from tests.llm.conftest import DOCS
from tradescope.llm import queries
from tradescope.llm.bpe_codec import Codec
from tradescope.llm.packing import encoder, hilbert_key, ids_of, pack, sequences
from tradescope.llm.token_counts import count_tokens
from tradescope.llm.token_shards import WordEncoder, read_documents, shard_lookup, write_shards
from tradescope.llm.wavelet import WaveletMatrix

BYTE = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD = public_tokenizers.path("word_bpe_49k.json")


def odd_texts(n: int = 60) -> list[str]:
    draw = random.Random(3)
    pools = [(32, 0x7F), (32, 0x180), (0x250, 0xD800), (0xE000, 0x1FFFF), (1, 40), (0x2000, 0x2070)]
    return ["".join(chr(draw.randrange(*draw.choice(pools))) for _ in range(120)) for _ in range(n)] + [
        "", "a" * 3001, "ab" * 999, " " * 300, "x" + "\n " * 20, "I'LL we'Re 'S'", "<|endoftext|><|endoftext|> <|ENDOFTEXT|>",
    ]


def library(path: str, texts: list[str]) -> list[list[int]]:
    return [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


def test_counts_equal_the_library():
    texts = odd_texts()
    assert count_tokens(texts, BYTE) == [len(ids) for ids in library(BYTE, texts)]


def test_codec_equals_the_library_and_returns_the_bytes():
    with open(RANKS, "rb") as file:
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, file)}
    theirs = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts, own = odd_texts(), Codec(RANKS)
    packed = own.encode(texts)
    assert [np.frombuffer(p, "<u4").tolist() for p in packed] == [theirs.encode_ordinary(t) for t in texts]
    assert own.decode(packed) == [t.encode() for t in texts]


def test_word_encoder_and_packing_encoder_equal_the_library():
    texts = odd_texts()
    own = WordEncoder(WORD)
    assert [np.frombuffer(own.encode(t), "<u4").tolist() for t in texts] == library(WORD, texts)
    fast = encoder(RANKS, (("<|endoftext|>", 50256),))
    assert [fast.encode(t, allowed_special="all") for t in texts] == library(BYTE, texts)


@pytest.mark.parametrize("n", [0, 1, 7, 3000])
def test_wavelet_matrix(n):
    ids = (np.random.default_rng(n).zipf(1.4, n) % 49_000).astype(np.uint32)
    matrix = WaveletMatrix.built(ids)
    assert matrix.ids().tolist() == ids.tolist()
    assert matrix.count(60_000) == 0 and matrix.find(60_000, 0) == -1
    for place in range(0, n, max(1, n // 20)):
        token = int(ids[place])
        where = np.flatnonzero(ids == token)
        assert matrix.access(place) == token
        assert matrix.count(token) == len(where) and matrix.count(token, 0, place) == (where < place).sum()
        assert matrix.find(token, len(where) - 1) == where[-1] and matrix.find(token, len(where)) == -1


def test_hilbert_key_visits_neighbours():
    side, bits = 8, 3
    order = sorted(((x, y, z) for x in range(side) for y in range(side) for z in range(side)), key=lambda p: hilbert_key(p, bits))
    assert len({hilbert_key(p, bits) for p in order}) == side**3
    assert all(sum(abs(a - b) for a, b in zip(p, q, strict=True)) == 1 for p, q in zip(order, order[1:], strict=False))


def multiset(rows):
    return sorted(rows, key=repr)


def test_op1_on_edge_cases(spark, edge_dir):
    got = queries.op1_token_counts(spark, edge_dir).collect()
    sizes = [len(i) for i in library(BYTE, [t or "" for _, t in DOCS])]
    want = [(i, len((t or "").encode()), n, n > 1024) for (i, t), n in zip(DOCS, sizes, strict=True)]
    assert multiset(map(tuple, got)) == multiset(want)


def test_op4_on_edge_cases(spark, edge_dir):
    got = queries.op4_bpe_codec(spark, edge_dir).collect()
    own = Codec(RANKS)
    packed = own.encode([t or "" for _, t in DOCS])
    want = [
        (i, len(p) // 4, hashlib.sha256(p).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
        for (i, t), p in zip(DOCS, packed, strict=True)
    ]
    assert multiset(map(tuple, got)) == multiset(want)


def test_op5_on_edge_cases(spark, edge_dir):
    got = queries.op5_token_shards(spark, edge_dir).orderBy("start").collect()
    ordered = sorted(DOCS, key=lambda d: (d[0] is not None, d[0] or 0, d[1] or ""))
    ids = [np.array([*x, 1], "<u4") for x in library(WORD, [t or "" for _, t in ordered])]
    starts = np.cumsum([0] + [len(i) for i in ids]).tolist()
    want = [(d[0], s, len(i), zlib.crc32(i.tobytes())) for d, s, i in zip(ordered, starts, ids, strict=False)]
    assert [tuple(r) for r in got] == want


def test_shards_are_cut_and_looked_up(spark, edge_dir, tmp_path):
    docs, folder = spark.read.parquet(f"{edge_dir}/documents.parquet"), str(tmp_path / "shards")
    write_shards(docs, folder, WORD, shard_tokens=500)
    assert spark.read.parquet(folder).count() > 3
    assert read_documents(spark, folder).count() == len(DOCS)
    asked = shard_lookup(spark, folder, "ends", lambda m: m.count(1))
    assert sum(r.ends for r in asked.collect()) == len(DOCS)


def test_op6_on_edge_cases(spark, edge_dir):
    pieces = queries.op6_packing(spark, edge_dir).collect()
    want = {}
    for (i, _), x in zip(DOCS, library(BYTE, [t or "" for _, t in DOCS]), strict=True):
        want.setdefault((i, len(x) + 1), []).append(np.array([*x, 1], "<u4"))
    covered: dict = {}
    for p in pieces:
        assert any(zlib.crc32(x[p.start : p.start + p.length].tobytes()) == p.ids_crc32 for x in want[p.doc_id, p.doc_tokens])
        covered[p.doc_id, p.doc_tokens] = covered.get((p.doc_id, p.doc_tokens), 0) + p.length
    assert covered == {k: k[1] * len(v) for k, v in want.items()}
    filled: dict = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == filled.get(p.sequence_id, 0)
        filled[p.sequence_id] = p.offset + p.length
    last = max(filled)
    assert sorted(filled) == list(range(last + 1)) and all(n == 2048 for s, n in filled.items() if s != last)


def test_sequences_hold_the_ids(spark, edge_dir):
    docs = spark.read.parquet(f"{edge_dir}/documents.parquet").where("doc_id in (4, 8, 9)")
    pieces = pack(docs, RANKS, length=64)
    rows = sequences(pieces, length=64).orderBy("sequence_id").collect()
    assert all(len(r.input_ids) == 64 for r in rows[:-1])
    stream = [x for r in rows for x in r.input_ids[: r.filled]]
    assert len(stream) == sum(p.length for p in pieces.collect()) and stream.count(1) == 4
    assert all(r.positions[0] == 0 and r.segments[0] == 1 for r in rows)


@pytest.mark.parametrize("name", ["op1_token_counts", "op4_bpe_codec", "op5_token_shards", "op6_packing"])
def test_empty_tables(spark, empty_dir, name):
    assert queries.queries()[name](spark, empty_dir).count() == 0


def letters(n: int) -> str:
    draw = random.Random(n)
    return "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))


LONG_RUNS = [letters(200_000), " " * 2_000_000, "x" * 2_000_000, "a" + " " * 1_000_000 + "b<|endoftext|>", "ACGT" * 3 + letters(3000) + "é" * 5000]


def test_long_runs_equal_the_library():
    """One run of many letters or blanks in a text: the same ids, without a crash or a spill."""
    fast = encoder(RANKS, (("<|endoftext|>", 50256),))
    byte, word, own = library(BYTE, LONG_RUNS), library(WORD, LONG_RUNS), Codec(RANKS)
    assert count_tokens(LONG_RUNS, BYTE) == [len(ids) for ids in byte]
    assert [ids_of(fast, t) for t in LONG_RUNS] == byte
    encoder5 = WordEncoder(WORD)
    assert [np.frombuffer(encoder5.encode(t), "<u4").tolist() for t in LONG_RUNS] == word
    plain = [t.replace("<|endoftext|>", "") for t in LONG_RUNS]
    packed = own.encode(plain)
    assert [np.frombuffer(p, "<u4").tolist() for p in packed] == library(BYTE, plain)
    assert own.decode(packed) == [t.encode() for t in plain]


@pytest.mark.parametrize("pool", ["abcdefghijklmnopqrstuvwxyz", "ab", "ACGT", "etaoin", "éüñabc", "日本語", "-=", "01"])
def test_cut_words_equal_whole_words(pool):
    draw, own = random.Random(pool), Codec(RANKS)
    words = ["".join(draw.choice(pool) for _ in range(draw.randrange(30, 700))) for _ in range(12)]
    assert [np.frombuffer(p, "<u4").tolist() for p in own.encode(words)] == library(BYTE, words)


def test_packing_of_long_runs(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(LONG_RUNS)], "doc_id long, text string")
    pieces = pack(docs, RANKS).drop("ids").groupBy("doc_id").sum("length").collect()
    assert {r[0]: r[1] for r in pieces} == {i: len(ids) + 1 for i, ids in enumerate(library(BYTE, LONG_RUNS))}
