"""Which fingerprints of rows occur more than once, at six bytes a row.

A shuffled row of its own costs several times the fingerprint in it.  Tasks therefore sort
their fingerprints and send them in records of one slot (the leading bits) each, so only
the other bits of a fingerprint travel; slots meet, and are counted a few at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A fingerprint has sixty bits: twelve name its slot, the others travel.
_SLOT_BITS, _REST_BITS = 12, 48
_REST_BYTES = _REST_BITS // 8
_UNUSED_BITS = 64 - _SLOT_BITS - _REST_BITS
# Fingerprints that a task holds at once; a slot is held whole beyond that.
CHUNK = 1 << 20


Batches = Iterator[pa.RecordBatch]


def fingerprint(digest: Column) -> Column:
    """The fingerprint of a row by a long of its digest."""
    return F.shiftrightunsigned(digest, _UNUSED_BITS)


def _workers(chunk: int) -> tuple[Callable[[Batches], Batches], Callable[[Batches], Batches]]:
    """The two passes over batches.

    Everything is defined in here, so it travels to the workers by value, and they need not have
    the library.
    """

    def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Different values of a sorted array, and how often each occurs."""
        starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
        return values[starts], np.diff(np.append(starts, len(values)))

    def numbers(batch: pa.RecordBatch, column: str) -> np.ndarray:
        return batch.column(column).to_numpy(zero_copy_only=False).astype(np.int64)

    def records(number: int, values: np.ndarray, nulls: int) -> pa.RecordBatch:
        """A record a slot with its fingerprints, those that occur several times twice."""
        different, times = runs(np.sort(values))
        kept = np.repeat(different, np.minimum(times, 2))
        slots, sizes = runs(kept >> _REST_BITS)
        rest = kept.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :_REST_BYTES].tobytes()
        ends = np.concatenate([[0], np.cumsum(sizes)]) * _REST_BYTES
        packed = pa.Array.from_buffers(
            pa.large_binary(), len(slots), [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(rest)]
        )
        # The sums go with the first record.
        first = np.arange(len(slots)) == 0
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(slots), number, np.int32)),
                pa.array(slots.astype(np.int32)),
                packed.cast(pa.binary()),
                pa.array(first * len(values)),
                pa.array(first * nulls),
            ],
            names=["_table", "_slot", "_rest", "_rows", "_nulls"],
        )

    def unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """The fingerprints of a batch of records, and how many each record has."""
        rest = batch.column("_rest").cast(pa.large_binary())
        ends = np.frombuffer(rest.buffers()[1], np.int64)[rest.offset : rest.offset + len(rest) + 1]
        data = np.frombuffer(rest.buffers()[2], np.uint8)[ends[0] : ends[-1]].reshape(-1, _REST_BYTES)
        whole = np.zeros((len(data), 8), np.uint8)
        whole[:, :_REST_BYTES] = data
        sizes = np.diff(ends) // _REST_BYTES
        return whole.view("<i8").ravel() | np.repeat(numbers(batch, "_slot") << _REST_BITS, sizes), sizes

    def counted(number: int, values: np.ndarray, rows: int, nulls: int) -> pa.RecordBatch:
        """The sums of some slots of a table, then a row for each fingerprint that occurs several times."""
        different, times = runs(np.sort(values))
        several = different[times > 1]
        first = np.arange(len(several) + 1) == 0
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(first), number, np.int32)),
                pa.array(np.concatenate([[0], several]), mask=first),
                pa.array(first * rows),
                pa.array(first * nulls),
                pa.array(first * int((times == 1).sum())),
            ],
            names=["_table", "_print", "_rows", "_nulls", "_once"],
        )

    def pack(batches: Batches) -> Batches:
        held: dict[int, list[np.ndarray]] = {}
        nulls: dict[int, int] = {}
        size = 0

        def sent() -> Batches:
            for number, parts in held.items():
                yield records(number, np.concatenate(parts), nulls[number])

        for batch in batches:
            tables, values, empty = (numbers(batch, c) for c in ("_table", "_print", "_nulls"))
            for number in np.unique(tables).tolist():
                own = tables == number
                held.setdefault(number, []).append(values[own])
                nulls[number] = nulls.get(number, 0) + int(empty[own].sum())
            size += len(values)
            if size >= chunk:
                yield from sent()
                held, nulls, size = {}, {}, 0
        yield from sent()

    def merge(batches: Batches) -> Batches:
        def results(keys: np.ndarray, values: np.ndarray) -> Batches:
            ends = np.concatenate([[0], np.cumsum(keys[:, 4])])
            for number in np.unique(keys[:, 0]).tolist():
                low, high = np.searchsorted(keys[:, 0], [number, number + 1])
                rows, nulls = keys[low:high, 2:4].sum(axis=0).tolist()
                yield counted(number, values[ends[low] : ends[high]], rows, nulls)

        pending: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            own, sizes = unpacked(batch)
            pending.append((np.stack([*(numbers(batch, c) for c in ("_table", "_slot", "_rows", "_nulls")), sizes], axis=1), own))
            size += len(own)
            if size < chunk:
                continue
            keys = np.concatenate([k for k, _ in pending])
            values = np.concatenate([v for _, v in pending])
            # The last slot may go on in the next batch.
            whole = int((keys[:, :2] != keys[-1, :2]).any(axis=1).sum())
            cut = int(keys[:whole, 4].sum())
            if whole:
                yield from results(keys[:whole], values[:cut])
            pending, size = [(keys[whole:], values[cut:])], 0
        if pending:
            yield from results(np.concatenate([k for k, _ in pending]), np.concatenate([v for _, v in pending]))

    return pack, merge


def count_prints(prints: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(_table, _print, _rows, _nulls, _once) of rows (_table int, _print long, _nulls long).

    Each fingerprint that occurs more than once in its table has a row; rows without one
    hold sums: rows, nulls, and fingerprints that occur once.  A row that is repeated
    without end travels twice for every ``chunk`` rows of a task, not more.
    """
    pack, merge = _workers(chunk)
    packed = prints.mapInArrow(pack, "_table int, _slot int, _rest binary, _rows long, _nulls long")
    met = packed.repartition("_table", "_slot").sortWithinPartitions("_table", "_slot")
    return met.mapInArrow(merge, "_table int, _print long, _rows long, _nulls long, _once long")
