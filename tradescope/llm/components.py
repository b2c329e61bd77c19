"""Connected components of an edge table of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradescope.operators.staging import stage


def _state(edges: DataFrame) -> tuple:
    """A digest of the edge set: one row, whatever its size."""
    mixed = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(mixed), F.sum(F.shiftright(mixed, 24))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node ties its larger neighbours to the least node it knows."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("_least"))
    larger = both.where(F.col("b") > F.col("a")).join(least, "a")
    return larger.select(F.col("b").alias("a"), F.col("_least").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node ties itself and its smaller neighbours to the least of these."""
    least = edges.groupBy("a").agg(F.min("b").alias("_least"))
    tied = edges.join(least, "a").select(F.col("b").alias("a"), F.col("_least").alias("b"))
    return tied.unionByName(least.select("a", F.col("_least").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Rows (a, b): every node ``a`` of a larger component than one, with its least node ``b``.

    ``edges`` has two columns ``a`` and ``b`` of one orderable type.  The least node of a
    component itself has no row.  Alternates large and small stars until nothing changes;
    each round is written down, so nothing is collected and no lineage grows.  The rounds
    grow with the logarithm of the longest chain.
    """
    edges = stage(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "edges",
    )
    state = _state(edges)
    while state[0]:
        edges = stage(_small_star(_large_star(edges)), "edges")
        before, state = state, _state(edges)
        if before == state:
            break
    return edges
