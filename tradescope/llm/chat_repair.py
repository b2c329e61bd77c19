"""Repair of damaged conversations by the cheapest edits.

Turns are range-partitioned in conversation order, so a conversation of any length is cut
into segments of at most ``SEGMENT`` turns that are searched on their own (see
``edit_lattice``): from every state a segment can begin in to every state it can end in.
Segments are then chained in order, which needs the four best repairs so far and nothing
else.  A conversation that lies inside one segment is searched once, as a whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradescope.llm.common import forget, kind
from tradescope.llm.edit_lattice import ENDS, PAIRED, STATES, Found, cheapest, kept_state
from tradescope.llm.merkle import field as encoded
from tradescope.operators.staging import stage

SEGMENT = 256
_BLANKS = " \t\n\x0b\x0c\r"
_FIRM = ("su", "ua", "au")
_NONE, _BLANK, _DUPLICATE, _TRUNCATED = range(4)
_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def damaged(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """The turns after a fixed damage, which the checksum of (conversation, turn) picks, as conv_id, turn, role, text, lost.

    Of 20 cases: 0 drops the turn (kept as a row that is ``lost``, so that its conversation is
    not forgotten), 1 empties its text, 2 takes its full stops, 3 repeats it, 4 makes it a
    user's.  A null role or text becomes a space, and so do null keys for the checksum.
    """

    def spaced(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    case = F.crc32(F.concat(spaced(id_col), F.lit(":"), spaced("turn"))) % 20
    text = F.when(case == 1, "").when(case == 2, F.translate(spaced("text"), ".!?", "")).otherwise(spaced("text"))
    return turns.select(
        id_col,
        "turn",
        F.when(case == 4, "user").otherwise(spaced("role")).alias("role"),
        text.alias("text"),
        (case == 0).alias("lost"),
        F.explode(F.array_repeat(F.lit(0), F.when(case == 3, 2).otherwise(1))).alias("_copy"),
    ).drop("_copy")


def with_faults(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Turns (id, turn, role, text, lost) with the conversation's name, a row number and the first fault of each.

    1 blank: nothing but ASCII white space; 2 duplicate: role and text stand earlier in the
    conversation; 3 truncated: the last character that is no white space is not one of ``.!?``.
    """
    rows = stage(
        turns.select(
            encoded(F.col(id_col)).alias("name"),
            id_col,
            F.col("turn").cast("long").alias("turn"),
            "role",
            "text",
            "lost",
            F.unhex(F.sha2(F.concat(encoded(F.col("role")), F.col("text")), 256)).alias("print"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "turns",
    )
    # Only what is said twice: few rows, added up before they travel.
    said = rows.where("NOT lost").groupBy("name", "print").agg(
        F.min(F.struct("turn", "row")).alias("first"), F.count(F.lit(1)).alias("times")
    )
    first = said.where("times > 1").select("name", "print", F.col("first.row").alias("first"))
    rest = F.rtrim(F.col("text"), F.lit(_BLANKS))
    fault = (
        F.when(rest == "", _BLANK)
        .when(F.col("first") != F.col("row"), _DUPLICATE)
        .when(~F.right(rest, F.lit(1)).isin(".", "!", "?"), _TRUNCATED)
        .otherwise(_NONE)
    )
    return rows.join(first, ["name", "print"], "left").withColumn("fault", fault).drop("first")


def _sign(role: str, fault: int) -> str:
    if fault in (_BLANK, _DUPLICATE):
        return "-"
    sign = role[:1] if role[:1] in ("s", "u", "a") else "x"
    return sign.upper() if fault == _TRUNCATED else sign


def repaired(letters: str, state: int, turns: list[tuple[str, str]]) -> tuple[list[tuple[str, str]], int]:
    """The turns after the edits ``letters``, begun in ``state``, and the state they end in."""
    left, out = iter(turns), []
    for letter in letters:
        role, text = ("", "") if letter == "I" else next(left)
        if letter == "D":
            continue
        if letter == "K":
            state = kept_state(state, role[:1])
        else:
            state = PAIRED[state]
            role = "user" if state == 2 else "assistant"
        out.append((role, text))
    return out, state


@dataclass
class _Segment:
    """Consecutive turns of one conversation and what is counted over them."""

    turns: list[tuple[str, str]] = field(default_factory=list)
    faults: list[int] = field(default_factory=list)
    numbers: list[int] = field(default_factory=list)

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        self.turns.append((role, text))
        self.faults.append(fault)
        if turn is not None and turn not in self.numbers[-1:]:
            self.numbers.append(turn)

    @property
    def signs(self) -> str:
        return "".join(_sign(r, f) for (r, _), f in zip(self.turns, self.faults, strict=True))


class _Search:
    """``cheapest`` with a bounded memory: short conversations look alike."""

    def __init__(self) -> None:
        self.known: dict[tuple, Found | None] = {}

    def __call__(self, signs: str, begin: int, ends: tuple[int, ...]) -> Found | None:
        key = (signs, begin, ends)
        if key not in self.known:
            forget(self.known)
            self.known[key] = cheapest(*key)
        return self.known[key]

    def all_ways(self, signs: str) -> list[Found | None]:
        return [self(signs, begin, (end,)) for begin in STATES for end in STATES]


class _Chain:
    """A conversation, segment after segment: counts, and per state the best repair so far."""

    def __init__(self, with_turns: bool) -> None:
        self.with_turns = with_turns
        self.counts = dict.fromkeys(_COUNTS, 0)
        self.distinct, self.span = 0, ()
        self.initial: str | None = None
        self.best: dict[int, tuple] = {0: (0, "", hashlib.sha256(), 0, [])}

    def _count(self, segment: _Segment) -> None:
        for place, name in ((_BLANK, "blank"), (_DUPLICATE, "duplicate"), (_TRUNCATED, "truncated")):
            self.counts[name] += segment.faults.count(place)
        for role, _ in segment.turns:
            if self.initial is not None and self.initial + role[:1] not in _FIRM:
                self.counts["illegal"] += 1
            self.initial = role[:1]
        if segment.numbers:
            begin, end = segment.numbers[0], segment.numbers[-1]
            self.distinct += len(segment.numbers) - (self.span[1:] == (begin,))
            self.span = (self.span[0] if self.span else begin, end)

    def _extended(self, before: tuple, begin: int, way: Found, turns: list[tuple[str, str]]) -> tuple[int, tuple]:
        lines, state = repaired(way[1], begin, turns)
        digest, said = before[2].copy(), before[3]
        for role, text in lines:
            digest.update(("\n" * bool(said) + f"{role}:{text}").encode())
            said += 1
        return state, (before[0] + way[0], before[1] + way[1], digest, said, before[4] + lines if self.with_turns else [])

    def add(self, segment: _Segment, ways: list[Found | None]) -> None:
        """One more segment with its sixteen ``ways``, from each state to each."""
        self._count(segment)
        best: dict[int, tuple] = {}
        for end in STATES:
            found = [
                ((before[0] + way[0], before[1] + way[1]), begin, way)
                for begin, before in self.best.items()
                if (way := ways[4 * begin + end])
            ]
            if found:
                _, begin, way = min(found)
                best[end] = self._extended(self.best[begin], begin, way, segment.turns)[1]
        self.best = best

    def add_whole(self, segment: _Segment, search: _Search) -> None:
        """The only segment: searched once, to the states in which a conversation may end."""
        self._count(segment)
        state, label = self._extended(self.best[0], 0, search(segment.signs, 0, ENDS), segment.turns)
        self.best = {state: label}

    def row(self) -> dict:
        cost, audit, digest, _, lines = min((self.best[q] for q in ENDS if q in self.best), key=lambda b: b[:2])
        gaps = self.span[1] - self.span[0] + 1 - self.distinct if self.span else 0
        done = self.counts | {"gaps": gaps, "cost": cost, "audit": audit, "repaired_sha256": digest.hexdigest()}
        return done | {"repaired": [{"role": r, "text": t} for r, t in lines]} if self.with_turns else done


_TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
_OPEN = {
    "turns": _TURNS,
    "faults": pa.list_(pa.int32()),
    "numbers": pa.list_(pa.int64()),
    "costs": pa.list_(pa.int64()),
    "audits": pa.list_(pa.string()),
}
_OPEN_DDL = (
    "part int, place long, turns array<struct<role:string,text:string>>, faults array<int>, numbers array<long>, "
    "costs array<long>, audits array<string>"
)


def _results(with_turns: bool) -> tuple[dict[str, pa.DataType], str]:
    names = {c: pa.int64() for c in _COUNTS} | {"audit": pa.string(), "repaired_sha256": pa.string()}
    ddl = ", ".join(f"{c} long" for c in _COUNTS) + ", audit string, repaired_sha256 string"
    if with_turns:
        names, ddl = names | {"repaired": _TURNS}, ddl + ", repaired array<struct<role:string,text:string>>"
    return names, ddl


def _batch(rows: list[dict], fields: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], t) for c, t in fields.items()], names=list(fields))


def repair(turns: DataFrame, id_col: str = "conv_id", with_turns: bool = False) -> DataFrame:
    """Per conversation what is wrong with it and its cheapest repair.

    ``turns`` has the id, turn, role, text and ``lost`` (a turn that is gone but names its
    conversation).  Columns: id, gaps, blank, duplicate, truncated, illegal, cost, audit (the
    edits' initials), repaired_sha256 (of ``role:text`` lines) and, ``with_turns``, the repaired
    turns.  Turns stand by number (null first), then role, the first 64 characters of the text
    and its digest; equal turns follow one another.  The initial of a role is its first
    character, an empty role has none and fits nowhere; null roles and texts count as a
    space.  Null ids are one conversation.  Without a turn left everything is zero or empty.  An
    empty table gives no row.  Other columns are not read.

    No conversation is held whole by a task.  The digest of one is sequential, so the segments
    of a long one stream through the task that chains them; faults, searches and sorting
    are spread over all.
    """
    blank = F.lit(" ")
    rows = with_faults(
        turns.select(
            id_col,
            "turn",
            F.coalesce("role", blank).alias("role"),
            F.coalesce("text", blank).alias("text"),
            F.coalesce("lost", F.lit(False)).alias("lost"),
        ),
        id_col,
    )
    order = ["name", F.asc_nulls_first("turn"), "role", F.left("text", F.lit(64)), "print", "row"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    results, results_ddl = _results(with_turns)
    id_type = kind(turns, id_col)

    def fields_of(batch: pa.RecordBatch) -> dict[str, pa.DataType]:
        return {"name": pa.string(), id_col: batch.schema.field(id_col).type}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, search = TaskContext.get().partitionId(), _Search()
        name: str | None = None
        ident, segment, place, inside = None, _Segment(), 0, False
        out: list[dict] = []
        fields: dict[str, pa.DataType] = {}

        def close(whole: bool) -> dict:
            row = {"name": name, id_col: ident}
            if whole and not place:
                chain = _Chain(with_turns)
                chain.add_whole(segment, search)
                return row | chain.row()
            ways = search.all_ways(segment.signs)
            return row | {
                "part": part,
                "place": place,
                "turns": [{"role": r, "text": t} for r, t in segment.turns],
                "faults": segment.faults,
                "numbers": segment.numbers,
                "costs": [w[0] if w else None for w in ways],
                "audits": [w[1] if w else None for w in ways],
            }

        for batch in batches:
            fields = fields or fields_of(batch) | results | {"part": pa.int32(), "place": pa.int64()} | _OPEN
            columns = (batch.column(c).to_pylist() for c in ("name", id_col, "turn", "role", "text", "lost", "fault"))
            for own, own_id, turn, role, text, lost, fault in zip(*columns, strict=True):
                if own != name:
                    if name is not None:
                        # The first conversation of a partition may have begun before it.
                        out.append(close(whole=inside))
                        inside = True
                    name, ident, segment, place = own, own_id, _Segment(), 0
                elif len(segment.turns) == SEGMENT:
                    out.append(close(whole=False))
                    segment, place = _Segment(), place + 1
                if not lost:
                    segment.add(turn, role, text, fault)
                if len(out) >= 1_000:
                    yield _batch(out, fields)
                    out = []
        if name is not None:
            # The last one may go on behind it.
            out.append(close(whole=False))
            yield _batch(out, fields)

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name: str | None = None
        ident, chain = None, _Chain(with_turns)
        out: list[dict] = []
        fields: dict[str, pa.DataType] = {}
        wanted = ("name", id_col, "turns", "faults", "numbers", "costs", "audits")
        for batch in batches:
            fields = fields or fields_of(batch) | results
            for own, own_id, said, faults, numbers, costs, audits in zip(*(batch.column(c).to_pylist() for c in wanted), strict=True):
                if own != name:
                    if name is not None:
                        out.append({"name": name, id_col: ident} | chain.row())
                    name, ident, chain = own, own_id, _Chain(with_turns)
                ways = [None if c is None else (c, a) for c, a in zip(costs, audits, strict=True)]
                chain.add(_Segment([(t["role"], t["text"]) for t in said], faults, numbers), ways)
            if out:
                yield _batch(out, fields)
                out = []
        if name is not None:
            yield _batch([{"name": name, id_col: ident} | chain.row()], fields)

    head = f"name string, {id_col} {id_type}, {results_ddl}"
    cuts = stage(ranged.mapInArrow(cut, f"{head}, {_OPEN_DDL}"), "segments")
    loose = cuts.where("place IS NOT NULL").drop(*results)
    chains = loose.repartition("name").sortWithinPartitions("name", "part", "place").mapInArrow(chained, head)
    return cuts.where("place IS NULL").select("name", id_col, *results).unionByName(chains).drop("name")
