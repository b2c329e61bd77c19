"""Chat formatting as a prefix tree.

Conversations that share initial turns share the nodes of these turns.  The tree is emitted
depth first, each node's tokens once, with position ids that count from the root and the
attention intervals of its ancestors, so every conversation reads as if it stood alone.

A node is named by a running hash of the turns up to it.  Depth-first order needs no walk:
let the owner of a node be the smallest conversation through it.  Along a conversation the
owners only rise; where the owner changes, the path branches off.  The list of branches,
latest first within a branch, sorts as a depth-first walk does.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tradescope.llm.common import running_starts
from tradescope.operators.staging import stage

# Stands for a null conversation id while longs are compared.
_NO_ID = -(1 << 63)
# Tokens of the emitted stream in one block of the look-up by interval.
_BLOCK = 1024
# Sorts the end of a path before every branch off it.
_END = -(1 << 62)


@dataclass(frozen=True)
class ChatTemplate:
    """``start`` role line-feed text ``end`` line-feed, for every turn.

    Control strings inside roles and texts become a backslash and a letter, a backslash
    becomes two; a line feed in a role is escaped as well.  ``unescape`` undoes it exactly.
    """

    start: str = "<|im_start|>"
    end: str = "<|im_end|>"
    control: tuple[str, ...] = (
        "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
    )

    def __post_init__(self) -> None:
        if len(self.control) > 25 or not {self.start, self.end} <= {*self.control} or "\\" in "".join(self.control):
            raise ValueError("at most 25 control strings, the marks among them, without backslashes")

    @property
    def _codes(self) -> dict[str, str]:
        """Each control string's letter; the backslash stands for itself, n for a line feed."""
        letters = "abcdefghijklmopqrstuvwxyz"
        return {"\\": "\\", **dict(zip(self.control, letters, strict=False))}

    def escape(self, text: str, line_feed: bool = False) -> str:
        codes = self._codes | ({"\n": "n"} if line_feed else {})
        pattern = "|".join(re.escape(c) for c in sorted(codes, key=len, reverse=True))
        return re.sub(pattern, lambda m: "\\" + codes[m[0]], text)

    def unescape(self, text: str) -> str:
        meant = {code: string for string, code in self._codes.items()} | {"n": "\n"}
        return re.sub(r"\\(.)", lambda m: meant[m[1]], text, flags=re.DOTALL)

    def head(self, role: str) -> str:
        return f"{self.start}{self.escape(role, line_feed=True)}\n"

    def turn(self, role: str, text: str) -> str:
        return f"{self.head(role)}{self.escape(text)}{self.end}\n"


class _Tokens:
    """Byte-level ids of formatted text, with one id beyond the vocabulary per mark."""

    def __init__(self, path: str, template: ChatTemplate) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.first = self.tokenizer.get_vocab_size()
        self.template = template

    def turn(self, role: str, text: str) -> tuple[list[int], int, int]:
        """Ids of a turn, and where the ids of its text begin and end."""
        parts = (self.template.escape(role, line_feed=True) + "\n", self.template.escape(text), "\n")
        head, body, tail = (self.tokenizer.encode(p, add_special_tokens=False).ids for p in parts)
        ids = [self.first, *head, *body, self.first + 1, *tail]
        return ids, 1 + len(head), 1 + len(head) + len(body)

    def text(self, ids: list[int]) -> str:
        """The formatted text of ids; the marks come back as their strings."""
        marks = {self.first: self.template.start, self.first + 1: self.template.end}
        out, begin = [], 0
        for i, x in enumerate([*ids, self.first]):
            if x >= self.first:
                out.append(self.tokenizer.decode(ids[begin:i], skip_special_tokens=False))
                out.append(marks[x] if i < len(ids) else "")
                begin = i + 1
        return "".join(out)


@lru_cache(2)
def _tokens(path: str, template: ChatTemplate) -> _Tokens:
    return _Tokens(path, template)


def _paths(turns: DataFrame) -> DataFrame:
    """Each turn with its depth, its node and its parent's node, from sorted partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, depth, node = None, 0, b""
        for batch in batches:
            nodes, parents, depths = [], [], []
            rows = zip(*(batch.column(c).to_pylist() for c in ("conv", "role", "text")), strict=True)
            for name, role, text in rows:
                if name != conv:
                    conv, depth, node = name, 0, b""
                parents.append(node)
                own = role.encode() + b"\n" + text.encode()
                node = hashlib.blake2b(node + len(role).to_bytes(8, "little") + own, digest_size=16).digest()
                nodes.append(node)
                depths.append(depth)
                depth += 1
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array(depths, pa.int32()),
                    pa.array(nodes, pa.binary()),
                    pa.array(parents, pa.binary()),
                ],
                names=["conv", "role", "text", "depth", "node", "parent"],
            )

    ordered = turns.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")
    return ordered.select("conv", "role", "text").mapInArrow(
        run, "conv long, role string, text string, depth int, node binary, parent binary"
    )


def _ordered_keys(owned: DataFrame) -> DataFrame:
    """(node, conv, depth, tree, key) of the nodes a conversation owns.

    ``owned`` has (conv, depth, node, owner) of every turn.  ``key`` sorts depth first;
    ``tree`` is the owner of the root.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, path = None, []
        for batch in batches:
            nodes, convs, depths, trees, keys = [], [], [], [], []
            rows = zip(*(batch.column(c).to_pylist() for c in ("conv", "depth", "node", "owner")), strict=True)
            for name, depth, node, owner in rows:
                if name != conv:
                    conv, path = name, []
                if not path:
                    path = [owner]
                elif path[-1] != owner:
                    path += [-depth, owner]
                if owner == name:
                    nodes.append(node)
                    convs.append(name)
                    depths.append(depth)
                    trees.append(path[0])
                    keys.append([*path, _END, depth])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(nodes, pa.binary()),
                    pa.array(convs, pa.int64()),
                    pa.array(depths, pa.int32()),
                    pa.array(trees, pa.int64()),
                    pa.array(keys, pa.list_(pa.int64())),
                ],
                names=["node", "conv", "depth", "tree", "key"],
            )

    ordered = owned.repartition("conv").sortWithinPartitions("conv", "depth")
    return ordered.mapInArrow(run, "node binary, conv long, depth int, tree long, key array<bigint>")


@dataclass
class FormattedChats:
    """``nodes``: the emitted tree; ``ends``: (conv, n_turns, node) of every conversation."""

    nodes: DataFrame
    ends: DataFrame


def format_chats(conversations: DataFrame, path: str, template: ChatTemplate | None = None) -> FormattedChats:
    """Merge all conversations (conv_id, turn, role, text) into emitted prefix trees.

    ``nodes`` has one row per distinct sequence of turns: ``tree`` and ``node``, ``start``
    (its place in the emitted stream of all trees, depth first), ``token_ids``,
    ``position`` (of its first token, counted from the root), ``loss_begin`` and
    ``loss_end`` (its assistant text, in tokens of the node; empty otherwise) and
    ``attends``, the intervals (begin, end) of the stream that its tokens see: those of its
    ancestors, root first, and its own.

    Null roles and texts count as empty, a null turn comes first; turns with equal numbers
    stand in the order of role and text, and repeated rows are repeated turns.  Rows without
    conversation id make one conversation of their own.  An empty table gives no node.
    Other columns are not read.  No join multiplies rows: a shared node meets its turns
    many to one, and a long conversation is streamed from its sorted partition.
    """
    template = template or ChatTemplate()
    turns = conversations.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(_NO_ID)).alias("conv"),
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    paths = stage(_paths(turns), "turns")
    owners = paths.groupBy("node").agg(F.min("conv").alias("owner"))
    owned = paths.select("conv", "depth", "node").join(owners, "node")
    keyed = stage(_ordered_keys(owned.select("conv", "depth", "node", "owner")), "keys")

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _tokens(path, template)
        for batch in batches:
            made = [own.turn(r, t) for r, t in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True)]
            loss = [r == "assistant" for r in batch.column("role").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("node", "parent", "conv", "depth", "tree", "key")),
                    pa.array([m[0] for m in made], pa.list_(pa.int32())),
                    pa.array([len(m[0]) for m in made], pa.int64()),
                    pa.array([m[1] if k else 0 for m, k in zip(made, loss, strict=True)], pa.int32()),
                    pa.array([m[2] if k else 0 for m, k in zip(made, loss, strict=True)], pa.int32()),
                ],
                names=["node", "parent", "conv", "depth", "tree", "key", "token_ids", "size", "loss_begin", "loss_end"],
            )

    texts = paths.select("node", "parent", "conv", "depth", "role", "text")
    emitted = stage(
        texts.join(keyed, ["node", "conv", "depth"]).mapInArrow(
            tokens,
            "node binary, parent binary, conv long, depth int, tree long, key array<bigint>, "
            "token_ids array<int>, size long, loss_begin int, loss_end int",
        ),
        "emitted",
    )
    placed = running_starts(emitted.select("node", "key", "size"), ["key"], "size", "start", "order")
    placed = stage(placed.select("node", "start", "size"), "placed")

    # Ancestors: every conversation that owns a node knows all turns up to it.
    line = paths.select("conv", "depth", "node").join(placed, "node")
    attended = _attended(line, keyed)
    nodes = emitted.drop("key", "size").join(attended, "node").join(placed.select("node", "start"), "node")
    last = paths.groupBy("conv").agg(
        (F.max("depth") + 1).cast("long").alias("n_turns"), F.max_by("node", "depth").alias("node")
    )
    nodes = nodes.select(
        "tree", "node", "parent", "depth", "start", "token_ids", "position", "loss_begin", "loss_end", "attends"
    )
    return FormattedChats(stage(nodes, "nodes"), last)


def _attended(line: DataFrame, keyed: DataFrame) -> DataFrame:
    """(node, position, attends) of every node, from the turns of its owner.

    Neighbouring intervals are merged, so an unbranched line has a single interval.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, position, spans = None, 0, []
        for batch in batches:
            nodes, positions, attends = [], [], []
            rows = zip(*(batch.column(c).to_pylist() for c in ("conv", "node", "start", "size", "mine")), strict=True)
            for name, node, start, size, mine in rows:
                if name != conv:
                    conv, position, spans = name, 0, []
                if spans and spans[-1][1] == start:
                    spans = [*spans[:-1], (spans[-1][0], start + size)]
                else:
                    spans = [*spans, (start, start + size)]
                if mine:
                    nodes.append(node)
                    positions.append(position)
                    attends.append([{"begin": a, "end": b} for a, b in spans])
                position += size
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(nodes, pa.binary()),
                    pa.array(positions, pa.int64()),
                    pa.array(attends, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))),
                ],
                names=["node", "position", "attends"],
            )

    mine = keyed.select("conv", "depth", F.lit(True).alias("mine"))
    flagged = line.join(mine, ["conv", "depth"], "left")
    ordered = flagged.repartition("conv").sortWithinPartitions("conv", "depth")
    return ordered.mapInArrow(run, "node binary, position long, attends array<struct<begin: bigint, end: bigint>>")


def _chains(chats: FormattedChats) -> DataFrame:
    """(end, position, token_ids, loss_begin, loss_end): the nodes each last node attends to.

    The intervals meet the nodes that start inside them by blocks of the emitted stream.
    """
    nodes = chats.nodes
    span = chats.ends.select("node").distinct().join(nodes.select("node", "attends"), "node")
    span = span.select(F.col("node").alias("end"), F.explode("attends").alias("span"))
    blocks = F.sequence(F.expr(f"span.begin div {_BLOCK}"), F.expr(f"(span.end - 1) div {_BLOCK}"))
    asked = span.select("end", "span", F.explode(blocks).alias("block"))
    held = nodes.select(
        F.expr(f"start div {_BLOCK}").alias("block"), "start", "position", "token_ids", "loss_begin", "loss_end"
    )
    inside = (asked["block"] == held["block"]) & (held["start"] >= F.col("span.begin")) & (held["start"] < F.col("span.end"))
    return asked.join(held, inside).select("end", "position", "token_ids", "loss_begin", "loss_end")


def read_back(chats: FormattedChats, path: str, template: ChatTemplate | None = None) -> DataFrame:
    """Per conversation, from the emitted tokens alone: sizes and digests.

    Each distinct last node collects the nodes its intervals cover, in order of position;
    their tokens are decoded and parsed, the loss spans unescaped.  Conversations with
    equal turns share that work.
    """
    template = template or ChatTemplate()
    chain = _chains(chats)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _tokens(path, template)
        state: list = []
        names: list[list] = [[] for _ in range(6)]

        def close() -> None:
            if state:
                end, turns, sha, loss, loss_chars, chars = state
                row = (end, turns, sha.hexdigest(), loss_chars, loss.hexdigest(), chars)
                for column, value in zip(names, row, strict=True):
                    column.append(value)

        def flushed() -> pa.RecordBatch:
            kinds = (pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(names, kinds, strict=True)], names=_READ)
            for column in names:
                column.clear()
            return batch

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("end", "token_ids", "loss_begin", "loss_end"))
            for end, ids, begin, upto in zip(*columns, strict=True):
                if not state or state[0] != end:
                    close()
                    state = [end, 0, hashlib.sha256(), hashlib.sha256(), 0, 0]
                formatted = own.text(ids)
                head, body = formatted.removeprefix(template.start).removesuffix(template.end + "\n").split("\n", 1)
                state[1] += 1
                state[2].update(f"{template.unescape(head)}\n{template.unescape(body)}\n".encode())
                if upto > begin:
                    text = template.unescape(own.text(ids[begin:upto]))
                    state[3].update(text.encode())
                    state[4] += len(text)
                state[5] += len(formatted)
            yield flushed()
        close()
        yield flushed()

    read = chain.repartition("end").sortWithinPartitions("end", "position").mapInArrow(
        run, "end binary, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
    return (
        chats.ends.select("conv", "node")
        .join(read.withColumnRenamed("end", "node"), "node")
        .select(F.when(F.col("conv") != _NO_ID, F.col("conv")).alias("conv_id"), *_READ[1:])
    )


_READ = ["end", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
