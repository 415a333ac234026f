"""Cheapest edits of a conversation as a dynamic program over four states.

States: nothing kept yet, after a leading system turn, after a user turn, after an
assistant turn. A state fixes the role that an Insert or a Rerole must write, so an audit
(the edits' initials) fixes the repaired conversation. Rows are symbols: one letter for
the role initial (system, user, assistant, other) and the fault (none, truncated, must go).
"""

from __future__ import annotations

from functools import lru_cache

START, SYSTEM, USER, ASSISTANT = range(4)
#: The role that Insert and Rerole write in each state, and the state after it.
WRITES = ("user", "user", "assistant", "user")
WRITTEN = (USER, USER, ASSISTANT, USER)
#: State after keeping a row of each initial; None: not possible there.
KEPT = {"s": (SYSTEM, None, None, None), "u": (USER, USER, None, USER), "a": (None, None, ASSISTANT, None),
        "o": (None,) * 4}
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
FAR = 1 << 40
#: Costs after the last row: a conversation ends empty or with an assistant turn.
END = (0, 4, 2, 0)

Vector = tuple[int, int, int, int]


def symbol(initial: str, fault: int) -> str:
    """Letter of a row; fault 0: none, 1: truncated, 2: must go."""
    return "abcdefghijkl"["suao".index(initial if initial in ("s", "u", "a") else "o") * 3 + fault]


ROWS = {symbol(i, f): (i, f) for i in "suao" for f in range(3)}


@lru_cache(maxsize=1 << 16)
def _step(after: Vector, row: str) -> tuple[int, Vector]:
    """Costs before a row from the costs after it, less their minimum."""
    initial, fault = ROWS[row]
    out = [DELETE + c for c in after]
    if fault < 2:
        more = TRUNCATED if fault else 0
        for q in range(4):
            out[q] = min(out[q], REROLE + more + after[WRITTEN[q]])
            if KEPT[initial][q] is not None:
                out[q] = min(out[q], more + after[KEPT[initial][q]])
    user, assistant = out[USER], out[ASSISTANT]
    out[USER], out[ASSISTANT] = min(user, INSERT + assistant), min(assistant, INSERT + user)
    for q in (START, SYSTEM):
        out[q] = min(out[q], INSERT + out[USER])
    low = min(out)
    return low, tuple(min(c - low, FAR) if c < FAR else FAR for c in out)


def back(rows: str, after: Vector) -> Vector:
    """Costs before ``rows`` from the costs after them; only the running vector is held."""
    total, vector = _settle(0, after)
    for row in reversed(rows):
        low, vector = _step(vector, row)
        total += low
    return tuple(FAR if c >= FAR else c + total for c in vector)


def _settle(total: int, vector: Vector) -> tuple[int, Vector]:
    low = min(vector)
    return total + low, tuple(FAR if c >= FAR else c - low for c in vector)


@lru_cache(maxsize=1 << 14)
def transfer(rows: str) -> tuple[Vector, ...]:
    """Cheapest way through ``rows`` to each state (outer) from each state (inner)."""
    return tuple(back(rows, tuple(0 if q == end else FAR for q in range(4))) for end in range(4))


def before_block(ways: tuple[Vector, ...], after: Vector) -> Vector:
    """Costs before a block from those after it, by its transfer table."""
    return tuple(min(ways[r][q] + after[r] for r in range(4)) for q in range(4))


def walks(rows: str, after: Vector) -> tuple[tuple[str, int], ...]:
    """From each state before the block: the ASCII-least tight edits and the state after it.
    The block's vectors are computed again here and dropped with it."""
    total, vector = _settle(0, after)
    costs = [(total, vector)]
    for row in reversed(rows):
        low, vector = _step(vector, row)
        total += low
        costs.append((total, vector))
    costs.reverse()
    return tuple(_walk(rows, costs, q) for q in range(4))


def _walk(rows: str, costs: list[tuple[int, Vector]], q: int) -> tuple[str, int]:
    out = []
    for i, row in enumerate(rows):
        (here, now), (there, then) = costs[i], costs[i + 1]
        initial, fault = ROWS[row]
        more = TRUNCATED if fault == 1 else 0
        while True:
            want = here + now[q] - there     # cost still to pay, less what all later states share
            kept = KEPT[initial][q] if fault < 2 else None
            if DELETE + then[q] == want:
                out.append("D")
            elif now[q] == INSERT + now[WRITTEN[q]]:
                out.append("I")
                q = WRITTEN[q]
                continue
            elif kept is not None and more + then[kept] == want:
                out.append("K")
                q = kept
            else:
                out.append("R")
                q = WRITTEN[q]
            break
    return "".join(out), q


def tail(q: int) -> str:
    """Inserts after the last row."""
    return "I" * (END[q] // INSERT)


class Editor:
    """Applies an audit row by row; ``open`` yields (edit, role, text) of what stays."""

    def __init__(self) -> None:
        self.q, self.edits, self.at = START, "", 0

    def load(self, edits: str) -> None:
        """The edits of the next block (those of the last one are used up)."""
        self.edits, self.at = self.edits[self.at:] + edits, 0

    def inserts(self):
        while self.at < len(self.edits) and self.edits[self.at] == "I":
            self.at += 1
            yield "I", WRITES[self.q], ""
            self.q = WRITTEN[self.q]

    def row(self, role: str, text: str):
        yield from self.inserts()
        edit, self.at = self.edits[self.at], self.at + 1
        if edit == "K":
            self.q = KEPT[role[0]][self.q]
            yield edit, role, text
        elif edit == "R":
            role, self.q = WRITES[self.q], WRITTEN[self.q]
            yield edit, role, text
