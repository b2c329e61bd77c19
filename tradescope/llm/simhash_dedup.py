"""SimHash near copies, found with vantage-point trees.

Equal fingerprints are one class.  Two fingerprints that differ in at most ``radius`` of
64 bits differ in at most ``radius // pieces`` bits in one of their ``pieces`` parts.  So
one vantage-point tree per part deals the classes out by the Hamming distance of that
part to vantage values; the triangle inequality says which values near a boundary have to
visit the other side as guests.  Inside a leaf whole fingerprints are compared, exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradescope.llm.common import fresh, kind, texts
from tradescope.llm.components import components
from tradescope.operators.staging import stage

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_SHINGLES_AT_ONCE = 200_000


def shingle_hashes(text: str, width: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``width`` words, repeats included.

    Words are cut at ASCII white space after lower-casing A-Z; fewer words than ``width``
    make one shingle, no word none.
    """
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    line, last = b" ".join(words), len(words) - 1
    if last < width:
        return np.array([xxhash.xxh64_intdigest(line, 42)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    begins = np.r_[0, ends[: last + 1 - width]].tolist()
    digest = xxhash.xxh64_intdigest
    cuts = zip(begins, (ends[width - 1 :] - 1).tolist(), strict=True)
    return np.fromiter((digest(line[a:b], 42) for a, b in cuts), np.uint64, len(begins))


def simhash(text: str, width: int) -> int:
    """The bits set in more than half of the shingle hashes; 0 for no word."""
    return majority(shingle_hashes(text, width))


def majority(hashes: np.ndarray) -> int:
    """The bits set in more than half of the hashes, as a signed 64-bit integer."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _SHINGLES_AT_ONCE):
        octets = hashes[i : i + _SHINGLES_AT_ONCE].view(np.uint8).reshape(-1, 8)
        for k in range(8):
            ones[8 * k : 8 * k + 8] += np.bincount(octets[:, k], minlength=256) @ _BITS
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and the fingerprint (as a signed long) of every text; null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [simhash(t, width) for t in texts(batch, text_col)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col), pa.array(values, pa.int64())], names=[id_col, "fingerprint"]
            )

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind(docs, id_col)}, fingerprint long")


@dataclass
class VantageTree:
    """A vantage-point tree over one part (``shift``, ``mask``) of the fingerprints."""

    shift: int
    mask: int
    radius: int
    # node: (vantage, threshold, inner child, outer child); a leaf is its number as ~leaf.
    nodes: list[tuple[int, int, int, int]]
    root: int = -1
    leaves: int = 0

    @classmethod
    def grown(cls, sample: np.ndarray, shift: int, mask: int, radius: int, leaf_size: int) -> VantageTree:
        tree = cls(shift, mask, radius, [])
        tree.root = tree._grow(tree._part(sample), leaf_size)
        return tree

    def _part(self, values: np.ndarray) -> np.ndarray:
        return (values >> np.uint64(self.shift)) & np.uint64(self.mask)

    def _grow(self, part: np.ndarray, leaf_size: int) -> int:
        if len(part) > leaf_size:
            vantage = part[0]
            away = np.bitwise_count(part ^ vantage)
            threshold = int(np.median(away))
            threshold -= bool((away <= threshold).all())
            inside = away <= threshold
            if inside.any():
                place = len(self.nodes)
                self.nodes.append((0, 0, 0, 0))
                inner = self._grow(part[inside][1:], leaf_size)
                outer = self._grow(part[~inside], leaf_size)
                self.nodes[place] = (int(vantage), threshold, inner, outer)
                return place
        self.leaves += 1
        return ~(self.leaves - 1)

    def route(self, values: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each leaf: places in ``values`` that go there, and which of them live there.

        Of two values within the radius that part at a node, the inner one visits the
        outer side: by the triangle inequality it lies less than the radius inside.
        """
        part = self._part(values)
        todo = [(self.root, np.arange(len(values)), np.ones(len(values), bool))]
        while todo:
            node, at, lives = todo.pop()
            if node < 0:
                yield ~node, at, lives
                continue
            vantage, threshold, inner, outer = self.nodes[node]
            away = np.bitwise_count(part[at] ^ np.uint64(vantage)).astype(np.int64)
            inside = away <= threshold
            to_inner = inside | ((away <= threshold + self.radius) & ~lives)
            to_outer = ~inside | (away > threshold - self.radius)
            todo.append((inner, at[to_inner], (lives & inside)[to_inner]))
            todo.append((outer, at[to_outer], (lives & ~inside)[to_outer]))


def _linked(row: np.ndarray, column: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``row`` and of ``column`` have another value within the radius across."""
    some_row, some_column = np.zeros(len(row), bool), np.zeros(len(column), bool)
    step = max(1, 1_000_000 // max(1, len(column)))
    for i in range(0, len(row), step):
        difference = row[i : i + step, None] ^ column[None, :]
        near = (np.bitwise_count(difference) <= radius) & (difference != 0)
        some_row[i : i + step] = near.any(axis=1)
        some_column |= near.any(axis=0)
    return some_row, some_column


def leaf_links(row: np.ndarray, column: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that join what is joined between ``row`` and ``column``, never all pairs.

    The values that have a neighbour are taken in balls: a pivot is tied to its ball, and
    only values within twice the radius of the pivot can have a neighbour inside the ball;
    those that do are tied to the pivot as well.
    """
    some_row, some_column = _linked(row, column, radius)
    left = np.unique(np.r_[row[some_row], column[some_column]])
    links: list[tuple[int, int]] = []
    while len(left):
        pivot = left[0]
        away = np.bitwise_count(left ^ pivot)
        ball, shell = left[away <= radius], left[(away > radius) & (away <= 2 * radius)]
        tied = np.r_[ball[1:], shell[_linked(shell, ball, radius)[0]]]
        links += [(int(pivot), int(t)) for t in tied]
        left = left[away > radius]
    return links


def _places(
    trees: list[VantageTree],
    sizes: dict[tuple[int, int], tuple[int, int]] | None,
    block: int,
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Deals fingerprints out to leaves; with ``sizes``, to tasks of a bounded number of values."""

    def cut(n: int) -> int:
        return max(1, -(-n // block))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("fingerprint").to_numpy(zero_copy_only=False).view(np.uint64)
            for number, tree in enumerate(trees):
                for leaf, at, lives in tree.route(values):
                    living, staying = sizes.get((number, leaf), (0, 0)) if sizes else (0, 0)
                    rows, columns = cut(living), cut(staying)
                    here = values[at]
                    mine, its = here % np.uint64(rows), here % np.uint64(columns)
                    for i in range(rows):
                        for j in range(columns):
                            as_row, as_column = lives & (mine == i), its == j
                            some = as_row | as_column
                            n = int(some.sum())
                            if n:
                                yield pa.RecordBatch.from_arrays(
                                    [
                                        pa.array(np.full(n, number, np.int32)),
                                        pa.array(np.full(n, leaf, np.int32)),
                                        pa.array(np.full(n, i * columns + j, np.int32)),
                                        pa.array(here[some].view(np.int64)),
                                        pa.array(as_row[some]),
                                        pa.array(as_column[some]),
                                    ],
                                    names=["tree", "leaf", "task", "fingerprint", "as_row", "as_column"],
                                )

    return run


_PLACE = "tree int, leaf int, task int, fingerprint long, as_row boolean, as_column boolean"


def _grown(frame: DataFrame, radius: int, pieces: int, sample: int, leaf_size: int) -> list[VantageTree]:
    """One tree per part of the fingerprints, from a sample of at most ``sample`` values."""
    total = frame.count()
    picked = frame.select("fingerprint").orderBy(F.xxhash64("fingerprint"), "fingerprint").limit(sample)
    values = np.array([r.fingerprint for r in picked.collect()], np.int64).view(np.uint64)
    share = max(8, leaf_size * len(values) // max(1, total))
    edges = [64 * k // pieces for k in range(pieces + 1)]
    return [
        VantageTree.grown(values, low, (1 << (high - low)) - 1, radius, share)
        for low, high in zip(edges, edges[1:], strict=False)
    ]


def _sizes(frame: DataFrame, trees: list[VantageTree], block: int) -> dict:
    """(living, staying) values of each leaf; one row per leaf of the bounded trees."""
    counted = (
        frame.mapInArrow(_places(trees, None, block), _PLACE)
        .groupBy("tree", "leaf")
        .agg(F.count_if("as_row").alias("living"), F.count(F.lit(1)).alias("staying"))
    )
    return {(r.tree, r.leaf): (r.living, r.staying) for r in counted.collect()}


def near_links(
    distinct: DataFrame, radius: int = 4, pieces: int = 4, sample: int = 20_000, leaf_size: int = 1_500, block: int = 8_192
) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints within ``radius`` bits.

    ``distinct`` has one column ``fingerprint``.  The trees are grown on a sample of at
    most ``sample`` values, so the driver and each task hold no more than that; leaves that
    turn out large are cut into blocks that meet pairwise.
    """
    trees = _grown(distinct, radius // pieces, pieces, sample, leaf_size)
    sizes = _sizes(distinct, trees, block)

    def join(_: tuple, group: pa.Table) -> pa.Table:
        value = group.column("fingerprint").to_numpy().view(np.uint64)
        row = value[group.column("as_row").to_numpy(zero_copy_only=False)]
        column = value[group.column("as_column").to_numpy(zero_copy_only=False)]
        links = leaf_links(row, column, radius)
        a, b = (np.array([x[k] for x in links], np.uint64).view(np.int64) for k in (0, 1))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    placed = distinct.mapInArrow(_places(trees, sizes, block), _PLACE)
    return placed.groupBy("tree", "leaf", "task").applyInArrow(join, "a long, b long")


def _class_components(prints: DataFrame, id_col: str, radius: int) -> DataFrame:
    """(fingerprint, component_id) of every distinct fingerprint of ``prints``."""
    classes = stage(prints.groupBy("fingerprint").agg(F.min(id_col).alias("_least")), "classes")
    tied = components(near_links(classes.select("fingerprint"), radius))
    rooted = classes.join(tied.withColumnsRenamed({"a": "fingerprint", "b": "_root"}), "fingerprint", "left").select(
        "fingerprint", "_least", F.coalesce("_root", "fingerprint").alias("_root")
    )
    named = rooted.groupBy("_root").agg(F.min("_least").alias("component_id"))
    return rooted.join(named, "_root").select("fingerprint", "_root", "component_id")


def near_duplicates(
    docs: DataFrame,
    width: int = 5,
    radius: int = 4,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Id, fingerprint (16 hex digits) and component (its least id) of every document.

    Null and wordless texts have fingerprint zero and are linked like any other.  Repeated
    rows are equal and share a component; the component of documents that all lack an id
    is null.  An empty table gives no row.  Other columns are not read.
    """
    prints = stage(fingerprints(docs, width, id_col, text_col), "fingerprints")
    component = _class_components(prints, id_col, radius).drop("_root")
    return prints.join(component, "fingerprint").select(
        id_col, F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_one(
    docs: DataFrame, width: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows, with all their columns, less all but one row of every component of near copies.

    Components are those of ``near_duplicates``: fingerprints of ``width``-word shingles, linked
    at ``radius`` or fewer differing bits.  All texts without a word have fingerprint zero and are
    linked like any other.  The row with the least id stays (ids before nulls, equal ids in
    input order), so of repeated rows one stays as well.  Rows are written down once with
    their number and fingerprint; what goes is decided on numbers and fingerprints alone.
    """
    row, mark = fresh("_row", docs), fresh("_print", docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = pa.array([simhash(t, width) for t in texts(batch, text_col)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, values], names=[*batch.schema.names, mark])

    marked = docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(mark, T.LongType())]))
    numbered = stage(marked.withColumn(row, F.monotonically_increasing_id()), "numbered")
    rank = F.struct(F.col(id_col).isNull().alias("a"), F.col(id_col).alias("b"), F.col(row).alias("c"))
    light = numbered.select(F.col(mark).alias("fingerprint"), rank.alias("rank"))
    classes = stage(light.groupBy("fingerprint").agg(F.min("rank").alias("rank")), "classes")
    tied = components(near_links(classes.select("fingerprint"), radius)).withColumnsRenamed({"a": "fingerprint", "b": "_root"})
    rooted = classes.join(tied, "fingerprint", "left").select("rank", F.coalesce("_root", "fingerprint").alias("_root"))
    kept = rooted.groupBy("_root").agg(F.min("rank").alias("rank")).select(F.col("rank.c").alias(row))
    return numbered.join(kept, row, "left_semi").select(*docs.columns)
