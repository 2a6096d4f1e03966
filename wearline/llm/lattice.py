"""Cheapest repair of a run of conversation turns: bidirectional Dijkstra over its edit lattice.

A node is (rows consumed, state), the states being those of the role grammar
``(s?(ua)+)?``: nothing yet, a system turn, a user turn waiting for its answer, an answered
turn.  Edges consume a row (``K`` keep, ``R`` give it the role the state wants, ``D`` delete)
or none (``I`` insert a turn).  One heap searches from the start, one from the goals.  Both
run until their smallest open distances add up to more than the best crossing, so that every
edge at which two halves of equal total cost meet is known; the least concatenated audit of
those crossings is the answer.

The cost of a path follows from its audit and the rows it consumed, so two cheapest paths to
one node never have one audit a proper prefix of the other: the least prefix and the least
suffix of a node may be kept alone.

Rows are given as one byte each: ``s``, ``u``, ``a`` or ``x`` (any other initial), upper case
if the text is truncated, ``-`` if the row must go.
"""

from __future__ import annotations

from functools import lru_cache
from heapq import heappop, heappush

START, SYSTEM, USER, ANSWER = range(4)
GOALS = (START, ANSWER)
# The grammar: state -> (role initial, next state); only these edges exist.
NEXT = {
    START: (("s", SYSTEM), ("u", USER)),
    SYSTEM: (("u", USER),),
    USER: (("a", ANSWER),),
    ANSWER: (("u", USER),),
}
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
MUST_GO = "-"

Edge = tuple[int, str, int, int]  # cost, initial of the edit, row, state


def _row_edges(symbol: str, state: int) -> list[tuple[int, str, int]]:
    """Edits that consume a row of this symbol in this state: (cost, initial, next state)."""
    edges = [(DELETE, "D", state)]
    if symbol != MUST_GO:
        extra = TRUNCATED if symbol.isupper() else 0
        for role, then in NEXT[state]:
            if role == symbol.lower():
                edges.append((extra, "K", then))
            if role != "s":
                edges.append((REROLE + extra, "R", then))
    return edges


_INSERTS = {q: [(INSERT, "I", then) for role, then in NEXT[q] if role != "s"] for q in NEXT}
_FORWARD = {(c, q): _row_edges(c, q) for c in "suaxSUAX-" for q in NEXT}
_BACK = {c: {q: [(w, e, p) for p in NEXT for w, e, t in _FORWARD[c, p] if t == q] for q in NEXT} for c in "suaxSUAX-"}
_INSERTS_BACK = {q: [(w, e, p) for p in NEXT for w, e, t in _INSERTS[p] if t == q] for q in NEXT}


def cheapest(symbols: str, start: int = START, goals: tuple[int, ...] = GOALS) -> tuple[int, str] | None:
    """(cost, audit) of the cheapest path from ``start`` over all rows to one of ``goals``,
    the ASCII-least audit among equal ones; None if no path exists (never for a whole
    conversation: deleting all rows is one)."""
    n = len(symbols)
    # Per side: open entries by (distance, order, state, audit half) and settled nodes.  The
    # order makes rows settle in the direction of the search where edges cost nothing, so a
    # node's half audit is final when it is settled.
    ahead = [(0, 0, start, "")]
    back = [(0, 0, q, "") for q in goals]
    halves: tuple[dict, dict] = {}, {}  # (row, state) -> (distance, half audit)
    best: list = [None, ""]

    def crossing(cost: int, audit: str) -> None:
        if best[0] is None or (cost, audit) < (best[0], best[1]):
            best[:] = cost, audit

    while ahead and back and (best[0] is None or ahead[0][0] + back[0][0] <= best[0]):
        forward = ahead[0][0] <= back[0][0]
        if forward:
            d, i, q, half = heappop(ahead)
            node = (i, q)
            if node in halves[0]:
                continue
            halves[0][node] = (d, half)
            if node in halves[1]:
                crossing(d + halves[1][node][0], half + halves[1][node][1])
            steps = [(w, e, i, t) for w, e, t in _INSERTS[q]]
            if i < n:
                steps += [(w, e, i + 1, t) for w, e, t in _FORWARD[symbols[i], q]]
            for w, e, j, t in steps:
                met = halves[1].get((j, t))
                if met is not None:
                    crossing(d + w + met[0], half + e + met[1])
                if (j, t) not in halves[0]:
                    heappush(ahead, (d + w, j, t, half + e))
        else:
            d, left, q, half = heappop(back)
            i = n - left
            node = (i, q)
            if node in halves[1]:
                continue
            halves[1][node] = (d, half)
            if node in halves[0]:
                crossing(halves[0][node][0] + d, halves[0][node][1] + half)
            steps = [(w, e, i, p) for w, e, p in _INSERTS_BACK[q]]
            if i > 0:
                steps += [(w, e, i - 1, p) for w, e, p in _BACK[symbols[i - 1]][q]]
            for w, e, j, p in steps:
                met = halves[0].get((j, p))
                if met is not None:
                    crossing(met[0] + w + d, met[1] + e + half)
                if (j, p) not in halves[1]:
                    heappush(back, (d + w, n - j, p, e + half))
    return None if best[0] is None else (best[0], best[1])


@lru_cache(maxsize=50_000)
def whole(symbols: str) -> tuple[int, str]:
    """The repair of a whole conversation; short runs of symbols repeat, so they are kept."""
    found = cheapest(symbols)
    assert found is not None
    return found


Table = dict[tuple[int, int], tuple[int, str]]  # (state before, state after) -> (cost, audit)


def table_of(symbols: str) -> Table:
    """Cheapest repairs of a piece of a conversation for every pair of states at its ends."""
    out = {}
    for q in NEXT:
        for p in NEXT:
            found = cheapest(symbols, q, (p,))
            if found is not None:
                out[q, p] = found
    return out


def joined(a: Table, b: Table) -> Table:
    """The table of two neighbouring pieces."""
    out: Table = {}
    for (q, m), (c1, e1) in a.items():
        for (m2, p), (c2, e2) in b.items():
            if m == m2:
                found = (c1 + c2, e1 + e2)
                if (q, p) not in out or found < out[q, p]:
                    out[q, p] = found
    return out


def all_joined(tables: list[Table]) -> tuple[int, str]:
    """The repair of a conversation from its pieces' tables, in order (joined pairwise, so
    that audits are copied a logarithmic number of times)."""
    while len(tables) > 1:
        tables = [joined(*tables[i:i + 2]) if i + 1 < len(tables) else tables[i] for i in range(0, len(tables), 2)]
    return min(tables[0][START, q] for q in GOALS if (START, q) in tables[0])


def applied(audit: str, rows: list[tuple[str, str]], state: int = START) -> tuple[list[tuple[str, str, str]], int]:
    """(edit, role, text) of the repaired turns that ``audit`` makes of (role, text) rows, and
    the state behind them.  Deleted rows are left out."""
    out, at = [], 0
    for e in audit:
        if e == "D":
            at += 1
            continue
        role, text = ("", "") if e == "I" else rows[at]
        at += e != "I"
        if e == "K":
            state = next(t for r, t in NEXT[state] if r == role[:1])
        else:
            wanted, state = next((r, t) for r, t in NEXT[state] if r != "s")
            role = "user" if wanted == "u" else "assistant"
        out.append((e, role, text))
    return out, state
