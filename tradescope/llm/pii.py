"""Personal data in texts: fixed patterns, and a character tagger that adds to them.

The patterns (mail addresses, IP addresses, card and phone numbers) always count.  The
tagger, a bidirectional LSTM with CRF transitions (``char_tagger``), is trained on windows
in which the patterns have labelled the spans, some of them rewritten in ways that the
patterns do not know.  It reads overlapping windows around every digit and every ``@``, since
a span holds one by definition; what the windows say is reconciled over the whole text.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradescope.llm.char_tagger import Tagger, codes
from tradescope.llm.common import fresh, kind, texts
from tradescope.operators.staging import stage

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE = 64, 32
# Characters around a digit or ``@`` that are read with it.
CONTEXT = 20
_WINDOWS_AT_ONCE = 1_024

Span = tuple[int, int, int]  # kind, begin, end

_SIGN = re.compile(r"[0-9@]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# The same matches as the patterns of the contract, in time linear in the text: a run of
# digits that leads to no match is not tried again from its middle.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for place, d in enumerate(reversed(digits)):
        n = int(d) * (1 + place % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        begin = at
        if domain:
            while begin > done and text[begin - 1] in _LOCAL:
                begin -= 1
            if begin < at:
                done = domain.end()
                yield begin, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """What the patterns find, by kind and place; failing matches are dropped, not retried."""
    found: list[Span] = [(0, a, b) for a, b in _emails(text)]
    if not _DIGIT.search(text):
        return found
    found += [(1, *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append((2, *m.span()))
    found += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_DIGIT.findall(m[0])) <= 15]
    return found


def islands(text: str) -> list[tuple[int, int]]:
    """The stretches around digits and ``@`` that windows have to cover."""
    found: list[list[int]] = []
    for m in _SIGN.finditer(text):
        begin, end = max(0, m.start() - CONTEXT), min(len(text), m.end() + CONTEXT)
        if found and begin <= found[-1][1]:
            found[-1][1] = end
        else:
            found.append([begin, end])
    return [(a, b) for a, b in found]


def windows(text: str) -> list[int]:
    """Where the overlapping windows over all islands begin."""
    return [
        begin
        for a, b in islands(text)
        for begin in range(a, max(a + 1, b - (WINDOW - STRIDE)), STRIDE)
    ]


def disguised(span: str, sort: int, form: int) -> str:
    """A labelled span in one of the ways that the patterns do not know."""
    if sort == 0:
        return span.replace("@", " @ " if form % 2 else "@ ")
    if sort == 1:
        return span.replace(".", " . " if form % 2 else " .")
    if sort == 2:
        digits = re.sub(r"[ -]", "", span)
        return (".", "  ", "_", "/")[form % 4].join(digits[i : i + 4] for i in range(0, len(digits), 4))
    return span[1:] if form % 2 else "00" + span[1:]


def _plausible(sort: int, span: str) -> bool:
    """What any span of the kind has, however it is written."""
    digits = len(_DIGIT.findall(span))
    if sort == 0:
        return span.count("@") == 1 and not span.startswith("@") and not span.endswith("@")
    if sort == 1:
        parts = re.findall(r"[0-9]+", span)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if sort == 2:
        return 16 <= digits <= 19 and luhn("".join(_DIGIT.findall(span)))
    return 8 <= digits <= 15


def _examples(text: str) -> Iterator[tuple[str, list[int]]]:
    """Windows of a text with their tags, some spans disguised; windows that cut a span are left out."""
    spans = sorted(base_spans(text), key=lambda s: s[1])
    begins = [s[1] for s in spans]
    for begin in windows(text):
        end = min(len(text), begin + WINDOW)
        held, cut = [], False
        # Spans of different kinds may overlap; the first one counts then.
        at = max(0, bisect_right(begins, begin) - 4)
        last = begin
        while at < len(spans) and spans[at][1] < end:
            sort, a, b = spans[at]
            at += 1
            if b <= begin:
                continue
            if a < begin or b > end:
                cut = True
            elif a >= last:
                held.append((sort, a, b))
                last = b
        if cut:
            continue
        yield from (_written(text, begin, end, held, form) for form in ((None, 0, 1, 2, 3) if held else (None,)))


def _written(text: str, begin: int, end: int, spans: list[Span], form: int | None) -> tuple[str, list[int]]:
    out, tags, done = [], [], begin
    for sort, a, b in spans:
        out.append(text[done:a])
        tags += [0] * (a - done)
        said = text[a:b] if form is None else disguised(text[a:b], sort, form)
        out.append(said)
        tags += [1 + 2 * sort] + [2 + 2 * sort] * (len(said) - 1)
        done = b
    out.append(text[done:end])
    tags += [0] * (end - done)
    return "".join(out)[:WINDOW], tags[:WINDOW]


@dataclass
class PiiModel:
    """A trained tagger, or none where there was nothing to learn from."""

    tagger: Tagger | None
    confidence: float


def fit_pii(
    docs: DataFrame,
    sample: int = 4_000,
    steps: int = 400,
    confidence: float = 0.9,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> PiiModel:
    """Train the tagger on about ``sample`` different windows at most, chosen by a hash of their contents.

    Every window with a labelled span comes as it is and in four disguises.  ``confidence`` is
    the mean probability of its tags that a span needs to be added.  Without any labelled span
    nothing is trained and nothing added.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [e for t in texts(batch, text_col) for e in _examples(t)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([w for w, _ in found], pa.string()), pa.array([t for _, t in found], pa.list_(pa.int32()))],
                names=["window", "tags"],
            )

    # Windows are few and short; written down, a share of them can be taken without a sort.
    shown = stage(docs.select(text_col).mapInArrow(run, "window string, tags array<int>"), "windows")
    share = sample / max(1, shown.count())
    place = F.pmod(F.xxhash64("window", "tags"), F.lit(1 << 40)) / float(1 << 40)
    # In a fixed order, so that the training does not depend on how tasks are cut.
    picked = sorted(shown.where(place < share).distinct().collect())
    if not any(max(r.tags, default=0) for r in picked):
        return PiiModel(None, confidence)
    chars = np.array([codes(r.window, WINDOW) for r in picked])
    tags = np.array([r.tags + [0] * (WINDOW - len(r.tags)) for r in picked], np.int64)
    tagger = Tagger(len(KINDS))
    tagger.train(chars, tags, steps)
    return PiiModel(tagger, confidence)


def _spans_of(tags: np.ndarray) -> list[Span]:
    """Spans of one window's tags."""
    found: list[Span] = []
    for place in np.flatnonzero(tags).tolist():
        tag = int(tags[place])
        if tag % 2:
            found.append(((tag - 1) // 2, place, place + 1))
        else:
            sort, a, _ = found[-1]
            found[-1] = (sort, a, place + 1)
    return found


def reconciled(candidates: dict[Span, float]) -> list[Span]:
    """The non-overlapping spans of greatest total weight, over the whole text.

    Weights are the evidence of all windows for a span; of equal totals the earlier spans win.
    """
    order = sorted(candidates, key=lambda s: (s[2], s[1], s[0]))
    ends = [s[2] for s in order]
    best: list[tuple[float, int]] = [(0.0, 0)]  # weight up to here, and where it continues
    for i, span in enumerate(order):
        before = bisect_right(ends, span[1], 0, i)
        taken = best[before][0] + candidates[span]
        best.append((taken, before) if taken > best[-1][0] + 1e-9 else (best[-1][0], -1))
    found, i = [], len(order)
    while i:
        if best[i][1] < 0:
            i -= 1
        else:
            found.append(order[i - 1])
            i = best[i][1]
    return found[::-1]


def added_spans(model: PiiModel, held: list[tuple[str, list[Span]]]) -> list[list[Span]]:
    """What the tagger adds to the base spans of each text."""
    places = [(i, begin) for i, (text, _) in enumerate(held) for begin in windows(text)]
    found: list[dict[Span, float]] = [{} for _ in held]
    if model.tagger is None:
        return [[] for _ in held]
    for first in range(0, len(places), _WINDOWS_AT_ONCE):
        some = places[first : first + _WINDOWS_AT_ONCE]
        tags, sure = model.tagger.decode(np.array([codes(held[i][0][b : b + WINDOW], WINDOW) for i, b in some]))
        for row, (i, begin) in enumerate(some):
            text = held[i][0]
            for sort, a, b in _spans_of(tags[row]):
                weight = float(sure[row, a:b].mean())
                a, b = begin + a, begin + b  # noqa: PLW2901
                # A span at the border of a window is cut; the next window holds it whole.
                cut = (a == begin and begin > 0) or (b == begin + WINDOW and b < len(text))
                if not cut and b <= len(text) and weight >= model.confidence and _plausible(sort, text[a:b]):
                    span = (sort, a, b)
                    found[i][span] = max(weight, found[i].get(span, 0.0))
    out = []
    for (_, base), candidates in zip(held, found, strict=True):
        taken = sorted((a, b) for _, a, b in base)
        ends = np.maximum.accumulate([b for _, b in taken]) if taken else np.empty(0)
        begins = [a for a, _ in taken]

        def free(span: Span, begins: list[int] = begins, ends: np.ndarray = ends) -> bool:
            before = bisect_right(begins, span[2] - 1)
            return before == 0 or ends[before - 1] <= span[1]

        out.append(reconciled({s: w for s, w in candidates.items() if free(s)}))
    return out


def spelled(spans: list[Span]) -> str:
    """kind:begin:end by kind and place, with commas."""
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def find_pii(docs: DataFrame, model: PiiModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, base spans per kind and their digest, and all spans of every whole text.

    Columns: n_email, n_ip, n_card, n_phone (what the patterns find), base_sha256, spans (base
    and added ones, as kind:begin:end in code points) and n_added.  One narrow pass, in time
    linear in the text.  An added span overlaps no base span and no other added one.  Null
    and empty texts have no span; repeated rows give equal results; other columns are not read;
    an empty table gives no row.
    """
    ident = fresh("_text", docs.select(id_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(t, base_spans(t)) if _SIGN.search(t) else ("", []) for t in texts(batch, ident)]
            added = added_spans(model, found)
            base = [spans for _, spans in found]
            counts = [pa.array([sum(s[0] == k for s in spans) for spans in base], pa.int64()) for k in range(len(KINDS))]
            digests = [hashlib.sha256(spelled(spans).encode()).hexdigest() for spans in base]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(id_col),
                    *counts,
                    pa.array(digests, pa.string()),
                    pa.array([spelled(a + b) for a, b in zip(base, added, strict=True)], pa.string()),
                    pa.array([len(a) for a in added], pa.int64()),
                ],
                names=[id_col, *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"],
            )

    counts = ", ".join(f"n_{k} long" for k in KINDS)
    schema = f"{id_col} {kind(docs, id_col)}, {counts}, base_sha256 string, spans string, n_added long"
    return docs.select(id_col, F.col(text_col).alias(ident)).mapInArrow(run, schema)
