"""Approximate nearest neighbours by balanced posting lists.

Balanced centroids are fitted on a bounded sample and linked to a neighbour graph that every
task holds in memory.  Every vector is posted to its nearest list and, near a boundary, to
further ones; a query visits the lists whose centroid is nearly as close as the closest.
Equal vectors are one class, so copies neither fill lists nor multiply work.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradescope.operators.staging import stage

_DEGREE = 16
_ENTRIES = 8


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Rows at length one; scaled first, so that no square over- or underflows."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _halved(points: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Which half of the points lies nearer the first of two means; the halves are equal."""
    a, b = points[rng.choice(len(points), 2, replace=False)]
    for _ in range(4):
        lean = points @ (a - b)
        first = lean >= np.median(lean)
        if first.all():
            first[: len(first) // 2] = False
        a, b = points[first].mean(axis=0), points[~first].mean(axis=0)
    order = np.argsort(-(points @ (a - b)), kind="stable")
    half = np.zeros(len(points), bool)
    half[order[: len(points) // 2]] = True
    return half


@dataclass
class CentroidGraph:
    """Unit centroids, and each one's nearest other centroids."""

    centroids: np.ndarray
    near: np.ndarray
    entries: np.ndarray

    @classmethod
    def fitted(cls, sample: np.ndarray, lists: int) -> CentroidGraph:
        """Split the sample in equal halves again and again until there are enough parts."""
        rng = np.random.default_rng(11)
        parts = [np.arange(len(sample))]
        while len(parts) < lists and max(map(len, parts)) >= 4:
            at = int(np.argmax([len(p) for p in parts]))
            part = parts.pop(at)
            half = _halved(sample[part], rng)
            parts += [part[half], part[~half]]
        means = np.array([sample[p].mean(axis=0) for p in parts])
        flat = np.linalg.norm(means, axis=1) < 1e-12
        means[flat] = np.array([sample[p[0]] for p in parts])[flat]
        centroids = _unit(means)
        degree = min(_DEGREE, len(centroids) - 1)
        near = np.zeros((len(centroids), degree), np.int64)
        for i in range(0, len(centroids), 1024):
            like = centroids[i : i + 1024] @ centroids.T
            like[np.arange(len(like)), np.arange(i, i + len(like))] = -2
            near[i : i + 1024] = np.argsort(-like, axis=1, kind="stable")[:, :degree]
        entries = np.unique(np.linspace(0, len(centroids) - 1, _ENTRIES).astype(np.int64))
        return cls(centroids, near, entries)

    def search(self, vectors: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Up to ``beam`` centroids near each unit vector, with distances, nearest first.

        Best-first search on the graph for all vectors in step: each expands its nearest
        centroid not yet expanded, until its beam holds none.
        """
        n = len(vectors)
        found = np.tile(self.entries, (n, 1))
        away = self._away(vectors, found)
        done = np.zeros(found.shape, bool)
        active = np.arange(n)
        width = min(beam, len(self.centroids))
        best = np.full((n, width), -1, np.int64)
        distance = np.full((n, width), np.inf)
        while len(active):
            open_away = np.where(done | ~np.isfinite(away), np.inf, away)
            pick = open_away.argmin(axis=1)
            rows = np.arange(len(active))
            ended = ~np.isfinite(open_away[rows, pick])
            if ended.any():
                k = min(width, found.shape[1])
                best[active[ended], :k], distance[active[ended], :k] = found[ended, :k], away[ended, :k]
                active, found, away, done, pick = (x[~ended] for x in (active, found, away, done, pick))
                rows = np.arange(len(active))
                if not len(active):
                    break
            done[rows, pick] = True
            new = self.near[found[rows, pick]]
            found = np.concatenate([found, new], axis=1)
            away = np.concatenate([away, self._away(vectors[active], new)], axis=1)
            done = np.concatenate([done, np.zeros(new.shape, bool)], axis=1)
            # A centroid met again: the expanded copy stays.
            order = np.argsort(2 * found + ~done, axis=1, kind="stable")
            found, away, done = (np.take_along_axis(x, order, 1) for x in (found, away, done))
            away[:, 1:][found[:, 1:] == found[:, :-1]] = np.inf
            order = np.argsort(away, axis=1, kind="stable")[:, : max(width, len(self.entries))]
            found, away, done = (np.take_along_axis(x, order, 1) for x in (found, away, done))
        order = np.argsort(distance, axis=1, kind="stable")
        return np.take_along_axis(best, order, 1), np.take_along_axis(distance, order, 1)

    def _away(self, vectors: np.ndarray, at: np.ndarray) -> np.ndarray:
        like = np.einsum("nd,nkd->nk", vectors, self.centroids[at])
        return np.sqrt(np.maximum(0, 2 - 2 * like))

    def postings(self, vectors: np.ndarray, ratio: float, most: int) -> list[list[int]]:
        """Lists of each vector: the nearest, and others within ``ratio`` of its distance.

        A further list is taken only if no list taken before lies nearer to it than the
        vector does, so copies go to different sides of a boundary; ``most`` at most.
        """
        best, distance = self.search(vectors, 2 * most)
        out = []
        for near, away in zip(best, distance, strict=True):
            taken = [int(near[0])]
            for c, d in zip(near[1:], away[1:], strict=True):
                if c < 0 or d > ratio * away[0] or len(taken) == most:
                    break
                if (np.linalg.norm(self.centroids[taken] - self.centroids[c], axis=1) >= d).all():
                    taken.append(int(c))
            out.append(taken)
        return out

    def visits(self, vectors: np.ndarray, ratio: float, beam: int) -> list[list[int]]:
        """Lists a query looks at: those within ``ratio`` of its nearest centroid's distance."""
        best, distance = self.search(vectors, beam)
        keep = (best >= 0) & (distance <= ratio * distance[:, :1] + 1e-12)
        return [b[k].tolist() for b, k in zip(best, keep, strict=True)]


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Distinct (id, vector) rows that take part: whole, finite, not zero, of the main length.

    The main length is the most frequent one, the smaller of equally frequent ones.
    """
    entry = F.col("vector")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")).where(
        entry.isNotNull()
        & F.forall(entry, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(entry, lambda x: x != 0)
    )
    common = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("vector") == (common.n if common else 0)).distinct()


def nearest(
    vectors: DataFrame,
    every: int = 50,
    k: int = 5,
    list_size: int = 128,
    sample: int = 20_000,
    post_ratio: float = 1.15,
    post_most: int = 8,
    visit_ratio: float = 1.3,
    beam: int = 64,
    block: int = 4_096,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """The ``k`` nearest vectors by cosine of every vector whose id is divisible by ``every``.

    Columns: query_id, rank (from 1), vec_id, score.  All usable vectors are indexed; only
    the centroids are fitted on a sample of at most ``sample``, so their number is bounded
    and lists grow beyond ``list_size`` on very large inputs (then raise ``sample``).  The
    vectors and the questions of a list are both cut into blocks of about ``block``, and every
    block of the one meets every block of the other, so neither has to fit in one task.

    Null, zero and non-finite vectors, vectors of another length and rows without id take
    no part; repeated rows count once.  Equal scores go to the smaller id.  With no other
    vector a query has no row; an empty table gives none.  Other columns are not read.
    """
    rows = stage(usable(vectors, id_col, vector_col).where("id is not null"), "vectors")
    # The k + 1 smallest ids of each class are all that a result can name.
    inside = Window.partitionBy("vector").orderBy("id")
    least = rows.withColumn("_n", F.row_number().over(inside)).where(F.col("_n") <= k + 1)
    classes = stage(
        least.groupBy("vector")
        .agg(F.sort_array(F.collect_list("id")).alias("ids"))
        .withColumn("cls", F.monotonically_increasing_id()),
        "classes",
    )
    asked = stage(
        rows.where(F.col("id") % every == 0).join(classes.select("vector", "cls"), "vector").select("id", "cls"), "queries"
    )
    total = classes.count()
    empty = "query_id long, rank int, vec_id long, score double"
    if not total:
        return vectors.sparkSession.createDataFrame([], empty)
    picked = classes.orderBy(F.xxhash64("vector"), "cls").limit(sample).select("vector").toArrow()
    dim = len(picked.column("vector")[0])
    graph = CentroidGraph.fitted(_unit(_matrix(picked.column("vector"), dim)), max(1, total // list_size))

    def placed(frame: DataFrame, query: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in (batch.slice(i, 2_000) for i in range(0, batch.num_rows, 2_000)):
                    unit = _unit(_matrix(part.column("vector"), dim))
                    lists = graph.visits(unit, visit_ratio, beam) if query else graph.postings(unit, post_ratio, post_most)
                    row = pa.array(np.repeat(np.arange(len(lists)), [len(x) for x in lists]))
                    flat = pa.array([x for own in lists for x in own], pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [flat, *(part.column(c).take(row) for c in ("cls", "least", "vector"))],
                        names=["list", "cls", "least", "vector"],
                    )

        kind = frame.schema["vector"].dataType.simpleString()
        return frame.select("cls", F.element_at("ids", 1).alias("least"), "vector").mapInArrow(
            run, f"list int, cls long, least long, vector {kind}"
        )

    posted = stage(placed(classes, query=False), "postings")
    questions = stage(placed(classes.join(asked.select("cls").distinct(), "cls", "left_semi"), query=True), "questions")

    def blocks(frame: DataFrame, name: str) -> DataFrame:
        return frame.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(name))

    # One row per list of the graph, so bounded by ``sample``.
    cut = F.broadcast(blocks(posted, "_held").join(blocks(questions, "_asking"), "list"))

    def dealt(frame: DataFrame, own: str, other: str, own_block: str, other_block: str) -> DataFrame:
        """Rows in one block of their side of the list, sent to every block of the other side."""
        return (
            frame.join(cut, "list")
            .withColumn(own_block, F.pmod(F.xxhash64("cls"), own).cast("int"))
            .withColumn(other_block, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
            .drop("_held", "_asking")
        )

    posted = dealt(posted, "_held", "_asking", "block", "part")
    questions = dealt(questions, "_asking", "_held", "part", "block")

    def score(_: tuple, group: pa.Table) -> pa.Table:
        query = np.array(group.column("query"))
        cls, first = group.column("cls").to_numpy(), group.column("least").to_numpy()
        unit = _unit(_matrix(group.column("vector"), dim))
        held, own = unit[~query], cls[~query]
        held_first = first[~query]
        out: list[list] = [[], [], [], []]
        for q, name in zip(unit[query], cls[query], strict=True) if len(held) else ():
            like = held @ q
            # All that may tie with the last place; which tie goes first is settled below.
            last = max(0, len(like) - k - 1)
            near = np.flatnonzero(like >= np.partition(like, last)[last] - 1e-9)
            # Summed the same way in every list, so that equal pairs score alike.
            exact = np.minimum(1.0, np.maximum(-1.0, (held[near] * q).sum(axis=1)))
            order = np.lexsort((held_first[near], -exact))[: k + 1]
            for column, values in zip(out, ([name] * len(order), own[near][order], held_first[near][order], exact[order]), strict=True):
                column.extend(values)
        return pa.table(
            {
                "asking": pa.array(out[0], pa.int64()),
                "cls": pa.array(out[1], pa.int64()),
                "least": pa.array(out[2], pa.int64()),
                "score": pa.array(out[3], pa.float64()),
            }
        )

    together = posted.withColumn("query", F.lit(False)).unionByName(questions.withColumn("query", F.lit(True)))
    hits = together.groupBy("list", "block", "part").applyInArrow(score, "asking long, cls long, least long, score double").distinct()
    best = Window.partitionBy("asking").orderBy(F.desc("score"), "least")
    top = hits.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k + 1)
    answers = (
        top.join(classes.select("cls", "ids"), "cls")
        .groupBy("asking")
        .agg(F.collect_list(F.struct("score", "ids")).alias("found"))
    )
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        asked.join(answers, asked["cls"] == answers["asking"])
        .select(F.col("id").alias("query_id"), F.explode("found").alias("hit"))
        .select("query_id", F.col("hit.score").alias("score"), F.explode("hit.ids").alias("vec_id"))
        .where("vec_id <> query_id")
        .withColumn("rank", F.row_number().over(ranked))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
