"""Packing documents into fixed-length sequences along a space-filling curve.

Documents get a vector of hashed token counts, projected to a few dimensions; the Hilbert
index of the projected point puts similar documents next to each other.  The token stream
in that order is cut every ``length`` ids, so only the last sequence of a corpus is padded.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradescope.llm.common import kind, running_starts, texts
from tradescope.operators.staging import stage

# Hashed features per document, dimensions of the curve and bits per dimension.
FEATURES = 256
DIMENSIONS = 4
BITS = 12


@lru_cache(2)
def encoder(path: str, special: tuple[tuple[str, int], ...]) -> tiktoken.Encoding:
    """The byte-level vocabulary of a rank file, with special strings and their ids.

    Gives the ids of the tokenizers file of the same vocabulary, at several times its speed.
    """
    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding(
        "packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=dict(special)
    )


_SPLIT = regex.compile(public_tokenizers.PATTERN)


def ids_of(encode: tiktoken.Encoding, text: str) -> list[int]:
    """Ids of a whole text; its special strings are their ids.

    The library's own splitting gives up on some very long runs; then the text is split here
    and encoded word by word, with the same ids.
    """
    try:
        return encode.encode(text, allowed_special="all")
    except ValueError:
        specials = sorted(encode.special_tokens_set, key=len, reverse=True)
        marks = regex.split("(" + "|".join(map(regex.escape, specials)) + ")", text) if specials else [text]
        ids: list[int] = []
        for part in marks:
            if part in encode.special_tokens_set:
                ids.append(encode.encode_single_token(part))
            else:
                for word in _SPLIT.findall(part):
                    ids += encode._encode_single_piece(word.encode())
        return ids


@lru_cache(1)
def _projection() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature and sign of each token id (by a fixed hash), and the projection matrix."""
    mixed = np.arange(1 << 17, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(31)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    feature = (mixed >> np.uint64(40)).astype(np.int64) % FEATURES
    sign = np.where((mixed >> np.uint64(33)) & np.uint64(1), 1.0, -1.0)
    matrix = np.random.default_rng(7).choice([-1.0, 1.0], (FEATURES, DIMENSIONS))
    return feature, sign, matrix


def hilbert_key(point: np.ndarray, bits: int = BITS) -> int:
    """Place along the Hilbert curve of a point with integer coordinates below 2**bits.

    Works from the highest bit down: every level reflects and swaps the axes so that the
    curve leaves one cell where it enters the next, then the bits are read off crosswise.
    """
    x = [int(v) for v in point]
    top = 1 << (bits - 1)
    level = top
    while level > 1:
        low = level - 1
        for i in range(len(x)):
            if x[i] & level:
                x[0] ^= low
            else:
                swap = (x[0] ^ x[i]) & low
                x[0] ^= swap
                x[i] ^= swap
        level >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn, level = 0, top
    while level > 1:
        if x[-1] & level:
            turn ^= level - 1
        level >>= 1
    key = 0
    for bit in range(bits - 1, -1, -1):
        for v in x:
            key = key << 1 | ((v ^ turn) >> bit & 1)
    return key


def curve_key(ids: np.ndarray) -> int:
    """Hilbert key of a document's hashed and projected token counts; empty ones get 0."""
    if not len(ids):
        return 0
    feature, sign, matrix = _projection()
    slot = ids.astype(np.int64) % len(feature)
    vector = np.bincount(feature[slot], sign[slot], minlength=FEATURES)
    norm = np.linalg.norm(vector)
    # Coordinates of a unit vector under random signs have variance one.
    place = vector @ matrix / norm if norm else np.zeros(DIMENSIONS)
    side = 1 << BITS
    return hilbert_key(np.clip((np.tanh(place / 2) + 1) / 2 * side, 0, side - 1).astype(np.int64))


def encoded(
    docs: DataFrame,
    path: str,
    special: tuple[tuple[str, int], ...],
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Ids of each text with ``end_id`` behind them and curve key.

    The ids are packed little-endian, in 16 bits each where the vocabulary allows it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, special)
        packing = "<u2" if max(encode.max_token_value, end_id) < 1 << 16 else "<u4"
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                rows = [np.array(ids_of(encode, t), np.uint32) for t in texts(part, text_col)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(id_col),
                        pa.array([curve_key(r) for r in rows], pa.int64()),
                        pa.array([len(r) + 1 for r in rows], pa.int64()),
                        pa.array([np.append(r, np.uint32(end_id)).astype(packing).tobytes() for r in rows], pa.binary()),
                    ],
                    names=[id_col, "_curve", "doc_tokens", "_ids"],
                )

    schema = f"{id_col} {kind(docs, id_col)}, _curve long, doc_tokens long, _ids binary"
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def pack(
    docs: DataFrame,
    path: str,
    special: tuple[tuple[str, int], ...] = (("<|endoftext|>", 50256),),
    end_id: int = 1,
    length: int = 2048,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The pieces of all documents: where each lies in its document and in its sequence.

    Columns: id, start, length, ids (packed little-endian 32-bit), ids_crc32, doc_tokens,
    sequence_id and offset.  Documents are encoded once and written down; only (key, id,
    size) rows are sorted along the curve, and ids travel once, to meet their position.
    A null or empty text is just its end id.  Rows with equal keys stand in the order of
    id and input, so repeated rows are packed one after the other; null ids come first.
    An empty table gives no piece.  Other columns are not read.
    """
    written = stage(
        encoded(docs, path, special, end_id, id_col, text_col).withColumn("_row", F.monotonically_increasing_id()),
        "encoded",
    )
    light = written.select("_row", "_curve", id_col, "doc_tokens")
    placed = running_starts(light, ["_curve", id_col, "_row"], "doc_tokens", "_at", "curve").select("_row", "_at")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("doc_tokens").to_numpy()
            ats = batch.column("_at").to_numpy()
            row, begin, size, crc, ids, sequence, offset = ([] for _ in range(7))
            for i, (at, n, raw) in enumerate(zip(ats.tolist(), sizes.tolist(), batch.column("_ids").to_pylist(), strict=True)):
                done = 0
                if len(raw) == 2 * n:
                    raw = np.frombuffer(raw, "<u2").astype("<u4").tobytes()
                while done < n:
                    took = min(n - done, length - (at + done) % length)
                    piece = raw[4 * done : 4 * (done + took)]
                    row.append(i)
                    begin.append(done)
                    size.append(took)
                    crc.append(zlib.crc32(piece))
                    ids.append(piece)
                    sequence.append((at + done) // length)
                    offset.append((at + done) % length)
                    done += took
            take = pa.array(row, pa.int64())
            long = [pa.array(v, pa.int64()) for v in (begin, size, crc, sequence, offset)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(id_col).take(take),
                    *long[:3],
                    batch.column("doc_tokens").take(take),
                    *long[3:],
                    pa.array(ids, pa.binary()),
                ],
                names=[id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"],
            )

    schema = (
        f"{id_col} {kind(docs, id_col)}, start long, length long, ids_crc32 long, doc_tokens long, "
        "sequence_id long, offset long, ids binary"
    )
    return written.select("_row", id_col, "doc_tokens", "_ids").join(placed, "_row").mapInArrow(cut, schema)


def sequences(pieces: DataFrame, length: int = 2048, pad_id: int = 0) -> DataFrame:
    """The packed sequences: sequence_id, input ids, attention segments and position ids.

    A sequence holds at most ``length`` ids, so its group is bounded.  It is padded to
    ``length``, unless it ends at a smaller power of two.
    """

    def build(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by("offset")
        ids = np.concatenate([np.frombuffer(b, np.uint32) for b in group.column("ids").to_pylist()])
        sizes = group.column("length").to_numpy()
        filled = len(ids)
        full = filled if filled & (filled - 1) == 0 else length
        row = np.full(full, pad_id, np.int32)
        row[:filled] = ids
        segment = np.zeros(full, np.int32)
        segment[:filled] = np.repeat(np.arange(1, len(sizes) + 1), sizes)
        position = np.zeros(full, np.int32)
        position[:filled] = np.concatenate([np.arange(n) for n in sizes])
        return pa.table(
            {
                "sequence_id": pa.array([key[0].as_py()], pa.int64()),
                "input_ids": pa.array([row]),
                "segments": pa.array([segment]),
                "positions": pa.array([position]),
                "filled": pa.array([filled], pa.int32()),
            }
        )

    columns = pieces.select("sequence_id", "offset", "length", "ids")
    return columns.groupBy("sequence_id").applyInArrow(
        build, "sequence_id long, input_ids array<int>, segments array<int>, positions array<int>, filled int"
    )
