"""Document fingerprints by a homomorphic multiset hash of paragraphs.

A paragraph is hashed to a wide vector of integers; a document's fingerprint is the sum of
its paragraphs' vectors, lane by lane, modulo a power of two.  Order does not matter, and a
paragraph is inserted or deleted by adding or subtracting its vector.  The first lanes are
uniform (equality), the others count signed features of the paragraph, so that the angle
between two fingerprints tells how much two documents share.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradescope.llm.common import kind, running_starts
from tradescope.operators.staging import stage

# Lanes modulo 2**64 that settle equality, and lanes modulo 2**32 that measure likeness.
EQUAL_LANES = 8
LIKE_LANES = 128
# Bytes of a feature: windows of this many bytes of a paragraph, shorter ones at its end.
WINDOW = 16
_BYTES_AT_ONCE = 1 << 20
# Blocks of documents in id order; more documents make larger blocks, not more of them.
BLOCKS = 10_000


def paragraphs(text: str) -> list[bytes]:
    """The lines of a text; an empty text has one empty paragraph."""
    return text.encode().split(b"\n")


def _features(parts: list[bytes]) -> np.ndarray:
    """Signed feature counts of all paragraphs together.

    Zero bytes behind every paragraph keep its windows to itself, so the sum over the
    paragraphs does not depend on their order.
    """
    gap = b"\0" * WINDOW
    line = np.frombuffer(gap.join(parts) + gap, np.uint8)
    sizes = np.array([len(p) for p in parts])
    begins = np.cumsum(sizes + WINDOW) - sizes - WINDOW
    edge = np.zeros(len(line) + 1, np.int8)
    edge[begins] += 1
    edge[begins + sizes] -= 1
    inside = np.cumsum(edge, dtype=np.int8)
    out = np.zeros(LIKE_LANES)
    for i in range(0, len(line) - WINDOW, _BYTES_AT_ONCE):
        octets = np.lib.stride_tricks.sliding_window_view(line[i : i + _BYTES_AT_ONCE + WINDOW - 1], 8)
        word = np.ascontiguousarray(octets).view("<u8").ravel()
        mixed = word[:-8] * np.uint64(0x9E3779B97F4A7C15) ^ word[8:] * np.uint64(0xC2B2AE3D27D4EB4F)
        mixed = mixed[inside[i : i + len(mixed)] > 0]
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0xD6E8FEB86659FD93)
        lane = (mixed >> np.uint64(57)).astype(np.int64)
        sign = np.where(mixed & np.uint64(1 << 40), 1.0, -1.0)
        out += np.bincount(lane, sign, minlength=LIKE_LANES)
    return out.astype(np.int64)


def fingerprint(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Both lane groups of a text's fingerprint."""
    parts = paragraphs(text)
    equal = np.zeros(EQUAL_LANES, np.uint64)
    for part in parts:
        equal += np.frombuffer(hashlib.blake2b(part).digest(), "<u8")
    return equal, _features(parts).astype(np.int32)


def written(lanes: tuple[np.ndarray, np.ndarray]) -> str:
    """A fingerprint as hex digits."""
    return (lanes[0].astype("<u8").tobytes() + lanes[1].astype("<i4").tobytes()).hex()


def read(text: str) -> tuple[np.ndarray, np.ndarray]:
    raw = bytes.fromhex(text)
    return np.frombuffer(raw, "<u8", EQUAL_LANES), np.frombuffer(raw, "<i4", offset=8 * EQUAL_LANES)


def inserted(print_text: str, paragraph: str) -> str:
    """The fingerprint of a document after one more paragraph (without line feed)."""
    (equal, like), (more, features) = read(print_text), fingerprint(paragraph)
    return written((equal + more, like + features))


def deleted(print_text: str, paragraph: str) -> str:
    """The fingerprint of a document after losing one copy of a paragraph."""
    (equal, like), (less, features) = read(print_text), fingerprint(paragraph)
    return written((equal - less, like - features))


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """1 for equal fingerprints, else the cosine of the likeness lanes, at least 0."""
    if (a[0] == b[0]).all() and (a[1] == b[1]).all():
        return 1.0
    x, y = a[1].astype(float), b[1].astype(float)
    size = float(np.sqrt((x @ x) * (y @ y)))
    return min(1.0, max(0.0, float(x @ y) / size)) if size else 0.0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id and fingerprint of every whole text (null counts as empty), in one narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [written(fingerprint(t or "")) for t in batch.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(values, pa.string())], names=[id_col, "fingerprint"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind(docs, id_col)}, fingerprint string")


def _place(name: int | None, mark: int) -> tuple[bool, int, int]:
    """Where a document stands: ids descend, null ids come last, ``mark`` ascends."""
    return (True, 0, mark) if name is None else (False, ~name, mark)


def _blocks(rows: DataFrame) -> tuple[list[tuple], set[tuple]]:
    """The places at which blocks start but for the first, and those of many copies; ``BLOCKS`` of each at most.

    The copies of one of the latter count as one row, since they travel as one per task.
    """
    groups = stage(rows.groupBy("id", "mark").agg(F.count(F.lit(1)).alias("n")), "groups")
    size = max(256, -(-(groups.agg(F.sum("n")).first()[0] or 0) // BLOCKS))
    crowds = {_place(r.id, r.mark) for r in groups.where(F.col("n") > size).collect()}
    weighed = groups.select("id", "mark", F.when(F.col("n") > size, 1).otherwise(F.col("n")).alias("n"))
    placed = running_starts(weighed, [F.desc_nulls_last("id"), "mark"], "n", "place", "places")
    # Groups that hold a multiple of ``size`` in the overall order.
    reached = F.floor((F.col("place") + F.col("n") - 1) / size)
    starts = placed.where((F.col("place") > 0) & (reached > F.floor((F.col("place") - 1) / size)))
    return sorted(_place(r.id, r.mark) for r in starts.select("id", "mark").collect()), crowds


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every document, of its edited text, and how alike they are.

    The edited text has the last half of the code points (rounded down) replaced by as many
    first ones, or all, of the next document in descending order of id; after the last
    comes the first.  Documents are dealt out in blocks of consecutive ids; a block also
    gets the first document of the next one, so each text travels about once.

    Null texts count as empty.  Null ids come last; equal ids stand in the order of a 64-bit
    hash of their texts, then of the texts (null first), so repeated rows follow each other.
    Blocks are cut by id and hash, so one id may hold any share of the rows; a row that is
    repeated many times travels as one row and a count per task.  A single document is its own
    next.  An empty table gives no row; other columns are not read.  Ids that are no integers
    have to be castable to one.
    """
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("mark"))
    starts, crowds = _blocks(rows)
    opening = set(starts)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        led: dict[tuple, tuple] = {}  # start of a block -> least text sent to the block before
        held: dict[tuple, int] = {}  # row of many copies -> copies seen

        def out(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip(_DEALT.names, row, strict=True)) for row in found], _DEALT)

        for batch in batches:
            found = []
            for name, words, mark in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "mark")), strict=True):
                place = _place(name, mark)
                block = bisect_right(starts, place)
                if place in crowds:
                    row = (name, words, mark, block)
                    held[row] = held.get(row, 0) + 1
                else:
                    found.append((name, words, mark, block, 0, 1))
                order = (words is not None, words or "")
                if place in opening and (place not in led or order < led[place]):
                    led[place] = order
                    found.append((name, words, mark, block - 1, 1, 1))
            yield out(found)
        yield out([(*row, 0, n) for row, n in held.items()])

    dealt = rows.mapInArrow(deal, "id long, text string, mark long, block int, guest int, copies long")
    # The first document of all closes the last block; one row.
    top = F.lit(rows.agg(F.max("id")).first()[0]).cast("long")
    least = F.min(F.struct("mark", F.col("text").isNotNull().alias("a"), "text"))
    closing = rows.where(F.col("id").eqNullSafe(top)).groupBy("id").agg(least.alias("least")).select(
        "id", "least.text", "least.mark", F.lit(len(starts)).alias("block"), F.lit(2).alias("guest"), F.lit(1).cast("long").alias("copies")
    )
    order = ["block", "guest", F.desc_nulls_last("id"), "mark", F.asc_nulls_first("text")]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple = ()  # the last own document of the block: id, text, fingerprint
        copies = 0
        out: list[list] = [[] for _ in _COLUMNS]
        block = None

        def compared(text: str, lanes: tuple) -> tuple:
            own_id, own_text, own = held
            own_text = own_text or ""
            half = len(own_text) // 2
            edited = own_text[: len(own_text) - half] + text[:half]
            changed = fingerprint(edited)
            return (
                own_id, len(own_text), hashlib.sha256(edited.encode()).hexdigest(), written(own), written(changed),
                likeness(own, changed), likeness(own, lanes),
            )

        def close(text: str, lanes: tuple) -> None:
            add(compared(text, lanes), 1)
            if copies > 1:
                # All copies but the last one are followed by a copy.
                again = compared(held[1] or "", held[2])
                for done in range(0, copies - 1, _TIMES):
                    add(again, min(_TIMES, copies - 1 - done))

        def add(values: tuple, times: int) -> None:
            for column, value in zip(out, (*values, times), strict=True):
                column.append(value)

        def flushed() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64())
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=_COLUMNS)
            for column in out:
                column.clear()
            return batch

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("id", "text", "block", "guest", "copies"))
            for name, text, at, guest, n in zip(*columns, strict=True):
                if at != block:
                    held, block = (), at
                if guest and not held:
                    continue
                if held and not guest and held[:2] == (name, text):
                    copies += n
                    continue
                lanes = fingerprint(text or "")
                if held:
                    close(text or "", lanes)
                held, copies = () if guest else (name, text, lanes), n
            yield flushed()

    together = dealt.unionByName(closing).repartition("block").sortWithinPartitions(*order)
    result = together.mapInArrow(compare, _SCHEMA)
    if crowds:
        # The repeated rows of a crowd are written out by many tasks.
        result = result.repartition("doc_id", "times", F.monotonically_increasing_id())
    result = result.withColumn("_", F.explode(F.sequence(F.lit(1), "times"))).drop("_", "times")
    return result.withColumn("doc_id", F.col("doc_id").cast(docs.schema[id_col].dataType))


# Copies that one row of the comparison stands for at most.
_TIMES = 1_000
_DEALT = pa.schema(
    [("id", pa.int64()), ("text", pa.string()), ("mark", pa.int64()), ("block", pa.int32()), ("guest", pa.int32()), ("copies", pa.int64())]
)
_COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "times"]
_SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, times long"
)
