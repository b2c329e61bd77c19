"""Cheapest repair of a run of turns, by a bidirectional Dijkstra search over the edit lattice.

A turn is one sign: s, u, a (its role), x (any other role), in upper case if its text is
truncated, or ``-`` if it has to go.  A node of the lattice is (turns read, state); the
state says what the repaired roles so far are: nothing (0), a system turn (1), an open
user turn (2) or whole pairs (3).  Edits are the edges: Keep 0, Rerole 2, Delete 3, Insert 2,
and one more for a truncated turn that stays.
"""

from __future__ import annotations

from heapq import heappop, heappush

# Where a user or assistant turn leads: the state alone says which of the two it is.
PAIRED = {0: 2, 1: 2, 2: 3, 3: 2}
_ROLE = {0: "u", 1: "u", 2: "a", 3: "u"}
STATES = range(4)
# The repaired roles are s?(ua)+ or nothing.
ENDS = (0, 3)

Edge = tuple[int, int, int, str]


def kept_state(state: int, initial: str) -> int | None:
    """The state after a kept turn; None where its role does not fit."""
    if initial == "s":
        return 1 if state == 0 else None
    return PAIRED[state] if _ROLE[state] == initial else None


def _edges(sign: str) -> list[Edge]:
    """(state, state after, cost, letter) of the edits of a turn."""
    found: list[Edge] = [(q, q, 3, "D") for q in STATES]
    if sign != "-":
        late = int(sign.isupper())
        found += [(q, PAIRED[q], 2 + late, "R") for q in STATES]
        kept = ((q, kept_state(q, sign.lower())) for q in STATES)
        found += [(q, to, late, "K") for q, to in kept if to is not None]
    return found


def _by(edges: list[Edge], end: int) -> list[list[tuple[int, int, str]]]:
    """The edges listed by their first (0) or second (1) state: (other state, cost, letter)."""
    return [[(e[1 - end], e[2], e[3]) for e in edges if e[end] == q] for q in STATES]


_INSERTS = [_by([(q, PAIRED[q], 2, "I") for q in STATES], end) for end in (0, 1)]
_TURNS = {sign: [_by(_edges(sign), end) for end in (0, 1)] for sign in "suaxSUAX-"}

Found = tuple[int, str]


class _Side:
    """One of the two searches: labels (cost, letters) by node, and a heap.

    Letters are put behind those of the forward search and before those of the reverse one.
    An edge without cost always reads a turn, so in the order (cost, turns read) a node's
    least label is known before it is settled.  For the letters: two equally cheap ways to
    a node read the same turns, and neither is the beginning of the other (the rest would be
    insertions that lead back to the node at no cost), so the least letters of a node are
    part of the least letters through it.
    """

    def __init__(self, signs: str, end: int, begin: tuple[int, ...]) -> None:
        self.signs, self.end = signs, end
        place = len(signs) if end else 0
        self.label: dict[tuple[int, int], Found] = {(place, q): (0, "") for q in begin}
        self.heap = [(0, 0, (place, q)) for q in begin]
        self.settled: set[tuple[int, int]] = set()

    def top(self) -> float:
        while self.heap and self.heap[0][2] in self.settled:
            heappop(self.heap)
        return self.heap[0][0] if self.heap else float("inf")

    def neighbours(self, node: tuple[int, int]) -> list[tuple[tuple[int, int], int, str]]:
        place, state = node
        found = [((place, q), cost, letter) for q, cost, letter in _INSERTS[self.end][state]]
        turn = place - 1 if self.end else place
        if 0 <= turn < len(self.signs):
            after = turn if self.end else turn + 1
            found += [((after, q), cost, letter) for q, cost, letter in _TURNS[self.signs[turn]][self.end][state]]
        return found

    def settle(self) -> tuple[int, int]:
        node = heappop(self.heap)[2]
        self.settled.add(node)
        cost, letters = self.label[node]
        for other, more, letter in self.neighbours(node):
            label = (cost + more, letter + letters if self.end else letters + letter)
            if other not in self.label or label < self.label[other]:
                self.label[other] = label
                read = len(self.signs) - other[0] if self.end else other[0]
                heappush(self.heap, (label[0], read, other))
        return node


def cheapest(signs: str, begin: int = 0, ends: tuple[int, ...] = ENDS) -> Found | None:
    """Least cost and, at that cost, ASCII-least letters of the edits from state ``begin`` to one of ``ends``.

    Both searches go on until their next nodes are together dearer than the best crossing:
    then one edge of every cheapest way has been settled from both sides, so all crossings of
    equal cost are known and the least concatenation of letters is picked among them.  None
    where no end can be reached.
    """
    sides = (_Side(signs, 0, (begin,)), _Side(signs, 1, ends))
    best: Found | None = None
    while True:
        tops = [side.top() for side in sides]
        if tops[0] + tops[1] > (best[0] if best else float("inf")) or float("inf") in tops:
            return best
        own = 0 if tops[0] <= tops[1] else 1
        side, other = sides[own], sides[1 - own]
        node = side.settle()
        cost, letters = side.label[node]
        crossings = [(node, 0, ""), *side.neighbours(node)]
        for across, more, letter in crossings:
            if across in other.settled:
                rest_cost, rest = other.label[across]
                whole = (cost + more + rest_cost, rest + letter + letters if own else letters + letter + rest)
                if best is None or whole < best:
                    best = whole
