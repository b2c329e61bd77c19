"""A Merkle manifest of a dataset, with a proof for every row.

Rows are leaves, ordered by id inside their source; every run of ``FANOUT`` neighbours is
hashed into a parent until one node is left, the source's subroot, and the subroots are
hashed in the same way into the root.  Per level one window over blocks of neighbours
gives every node the lag and lead columns of its run at fixed offsets, masked by its slot
and the length of its run: they are its siblings, and the first child of a run hashes the
parent from them.

Nodes get their number by range partitioning, and a block holds ``BLOCK`` nodes, so no
source is ever sorted or hashed in one task.  Paths above a node are handed down once per
block, never once per row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradescope.llm.common import fresh
from tradescope.operators.ranking import position_in_group
from tradescope.operators.staging import stage

FANOUT = 16
# Nodes of a window; a multiple of the fan-out, so that no run crosses its border.
BLOCK = FANOUT * FANOUT
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PATH = "array<struct<left:string,right:string>>"


def field(value: Column) -> Column:
    """A value as its UTF-8 byte count, a colon and itself; null as a dash."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts one after the other."""
    return F.sha2(F.concat(*parts), 256)


def _run(nodes: DataFrame) -> DataFrame:
    """Nodes with their block, their slot and the (masked) lag and lead columns of their run."""
    nodes = nodes.withColumn("block", F.expr(f"idx div {BLOCK}"))
    near = Window.partitionBy("tree", "block").orderBy("idx")
    slot = F.col("idx") % FANOUT
    length = F.least(F.lit(FANOUT), F.col("n") - F.col("idx") + slot)
    shifts = range(1, FANOUT)
    seen = nodes.select(
        "*",
        slot.alias("slot"),
        length.alias("length"),
        *(F.lag("hash", k).over(near).alias(f"lag{k}") for k in shifts),
        *(F.lead("hash", k).over(near).alias(f"lead{k}") for k in shifts),
    )
    before = [F.when(F.col("slot") >= k, F.col(f"lag{k}")).otherwise("") for k in reversed(shifts)]
    after = [F.when(F.col("slot") + k < F.col("length"), F.col(f"lead{k}")).otherwise("") for k in shifts]
    return seen.select(*nodes.columns, "slot", F.concat(*before).alias("left"), F.concat(*after).alias("right"))


def parents(nodes: DataFrame) -> DataFrame:
    """The next level of every tree that still has several nodes, hashed by the first children."""
    first = _run(nodes.where("n > 1")).where("slot = 0")
    return first.select(
        "tree",
        F.expr(f"idx div {FANOUT}").alias("idx"),
        digest(F.col("hash"), F.col("right")).alias("hash"),
        F.expr(f"(n + {FANOUT - 1}) div {FANOUT}").alias("n"),
    )


def levels(leaves: DataFrame) -> list[DataFrame]:
    """All levels of the trees over ``leaves`` (tree, idx, hash, n), the leaves first.

    ``n`` is the number of the level's nodes in the tree; the node of a level with one is
    the tree's top.  Each level is written down and a sixteenth of the one below.
    """
    most = leaves.agg(F.max("n")).first()[0] or 0
    found = [leaves]
    while most > 1:
        found.append(stage(parents(found[-1].select("tree", "idx", "hash", "n")), "merkle"))
        most = -(-most // FANOUT)
    return found


def tops(found: list[DataFrame]) -> DataFrame:
    """The last node (tree, hash) of every tree."""
    return reduce(DataFrame.unionByName, (nodes.where("n = 1").select("tree", "hash") for nodes in found))


def paths(found: list[DataFrame], crown: DataFrame) -> DataFrame:
    """The lowest level with the path of every node: per level what stands left and right of it.

    ``crown`` has (tree, path, ...) of every tree's top; its further columns are handed down
    with the path.  A block of nodes meets one row with the paths of its parents, on the keys
    of the window, so siblings do not travel.
    """
    handed = [c for c in crown.columns if c != "tree"]
    above: DataFrame | None = None
    for nodes in reversed(found):
        done = nodes.where("n = 1").join(crown, "tree").select(*nodes.columns, *handed)
        if above is not None:
            given = (
                above.groupBy("tree", F.expr(f"idx div {FANOUT}").alias("block"))
                .agg(F.array_sort(F.collect_list(F.struct("idx", *handed))).alias("parents"))
            )
            parent = F.element_at("parents", (F.expr(f"idx div {FANOUT}") % FANOUT + 1).cast("int"))
            own = F.array(F.struct("left", "right"))
            inner = _run(nodes.where("n > 1")).join(given, ["tree", "block"]).withColumn("_parent", parent)
            done = done.unionByName(
                inner.select(
                    *nodes.columns,
                    *(
                        F.concat(own, "_parent.path").alias(c) if c == "path" else F.col(f"_parent.{c}").alias(c)
                        for c in handed
                    ),
                )
            )
        above = done
    return above


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows with their number (from 0) in their tree, ascending by ``order``, and the tree's size."""
    placed = position_in_group(rows, ["tree"], order, "idx").withColumn("idx", F.col("idx") - 1)
    sizes = rows.groupBy("tree").agg(F.count(F.lit(1)).alias("n"))
    return placed.join(sizes, "tree")


def merkle_manifest(
    docs: DataFrame,
    tampered: Column | None = None,
    id_col: str = "doc_id",
    tree_col: str = "source",
    fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
    text_col: str = "text",
) -> DataFrame:
    """Leaf, subroot, root and proof of every row, and the root its proof leads to.

    Columns: id, leaf, subroot, root, proof_sha256 (of the siblings up to the root),
    folded_root (from the row as it is found, its leaf hashed anew, and the siblings) and
    verified (whether that is the root).  Where ``tampered`` holds, the row is found with A-Z
    of its text in lower case.  Leaves ascend by id inside their source (null ids first, rows
    of one id by their leaf), sources bytewise with null first.  Null fields hash as a dash,
    a null id or null condition is never tampered with; repeated rows are leaves each, with
    equal hashes and their own proofs.  A source of one row has that leaf as its subroot; one
    source's subroot is the root.  An empty table gives no row.  Other columns are not read.
    """
    changed = F.coalesce(tampered, F.lit(False)) if tampered is not None else F.lit(False)

    def leaf(text: Column) -> Column:
        return digest(*(field(text if c == text_col else F.col(c)) for c in fields))

    row = fresh("_id", docs.select(id_col))
    scanned = docs.select(
        field(F.col(tree_col)).alias("tree"),
        F.col(id_col).alias(row),
        leaf(F.col(text_col)).alias("hash"),
        F.when(changed, leaf(F.translate(text_col, _UPPER, _LOWER))).alias("found"),
    )
    leaves = stage(scanned.withColumn("_at", F.monotonically_increasing_id()), "leaves")
    below = stage(_numbered(leaves, [row, "hash", "_at"]).drop("_at"), "numbered")
    sources = levels(below)
    subroots = tops(sources).withColumns(
        {
            # The source itself, for its order; the tree's name begins with a length.
            "source": F.when(F.col("tree") != "-", F.expr("substr(tree, instr(tree, ':') + 1)")),
            "name": F.col("tree"),
            "tree": F.lit(""),
        }
    )
    upper = levels(stage(_numbered(stage(subroots, "subroots"), ["source"]), "sources"))
    root = tops(upper).select("tree", F.expr(f"CAST(array() AS {_PATH})").alias("path"), F.col("hash").alias("root"))
    crown = stage(paths(upper, root).select(F.col("name").alias("tree"), "path", F.col("hash").alias("subroot"), "root"), "crown")
    folded = F.aggregate("path", F.coalesce("found", "hash"), lambda node, level: digest(level["left"], node, level["right"]))
    proof = F.sha2(F.array_join(F.transform("path", lambda level: F.concat(level["left"], level["right"])), ""), 256)
    return (
        paths(sources, crown)
        .select(F.col(row).alias(id_col), F.col("hash").alias("leaf"), "subroot", "root", proof.alias("proof_sha256"), folded.alias("folded_root"))
        .withColumn("verified", F.col("folded_root") == F.col("root"))
    )
