"""Cheapest edits of a long row of turns, by chunks that are solved on their own and stitched.

A turn is one byte: the initial of its role (s, u, a, other), 4 more if its text breaks off, or 8 and over if it must be
deleted. What has been put out so far is one of four states: nothing, a system turn only, a user turn last, an
assistant turn last. The cost vector of a place says, for each state, what the rest of the conversation costs at
least. It follows from the vector behind the turn by a product in the (min, +) algebra. Such products lose rank: from
whatever vector a chunk is started, after some turns its vectors differ from the true ones by a constant only. So
chunks start from a guess, and a pass of fix-ups starts them again from the vector that the next chunk now has,
until it meets the old vectors up to a constant.
"""

from __future__ import annotations

from functools import cache
from typing import NamedTuple

NOTHING, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
# The costs of the edits.
KEEP, REROLE, DELETE, INSERT, BROKEN = 0, 2, 3, 2, 1
BLANK, DUPLICATE = 8, 9
_FAR = 1 << 20

Vector = tuple[int, int, int, int]
# The state behind a user or assistant turn that is put out, and the role of that turn.
_NEXT = {NOTHING: (USER, "user"), SYSTEM: (USER, "user"), USER: (ASSISTANT, "assistant"), ASSISTANT: (USER, "user")}
# The state behind a turn that keeps its role, by its initial.
_KEPT = [{NOTHING: SYSTEM}, {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER}, {USER: ASSISTANT}, {}]


def _with_inserts(vector: list[int]) -> list[int]:
    """A cost vector if turns may be put in first; two in a row are enough to reach any state that they can reach."""
    for _ in range(2):
        vector = [min(cost, INSERT + vector[_NEXT[state][0]]) for state, cost in zip(STATES, vector)]
    return vector


def _relative(vector: list[int]) -> tuple[Vector, int]:
    least = min(vector)
    return tuple(cost - least for cost in vector), least


# Behind the last turn nothing may be missing: no turn at all, or an answer at the end.
END: Vector = tuple(_with_inserts([0, _FAR, _FAR, 0]))
# The guess of a chunk that others follow: as if it were the end.
GUESS = END


def _edits(code: int, state: int) -> list[tuple[str, int, int, str | None]]:
    """Edits of a turn in a state: letter, cost, next state, the new role or None for its own."""
    if code >= BLANK:
        return [("D", DELETE, state, None)]
    broken = BROKEN if code & 4 else 0
    out = [("D", DELETE, state, None)]
    if (kept := _KEPT[code & 3].get(state)) is not None:
        out.append(("K", KEEP + broken, kept, None))
    after, role = _NEXT[state]
    return [*out, ("R", REROLE + broken, after, role)]


@cache
def step(code: int, behind: Vector) -> tuple[Vector, int]:
    """The cost vector before a turn less its least cost, and that cost; ``behind`` is the vector after the turn."""
    own = [min(cost + behind[after] for _, cost, after, _ in _edits(code, state)) for state in STATES]
    return _relative(_with_inserts(own))


def solve(codes: bytes, behind: Vector) -> Vector:
    """The vector before a chunk, up to a constant."""
    for code in reversed(codes):
        behind = step(code, behind)[0]
    return behind


def fix_up(codes: bytes, old: Vector, new: Vector, before: Vector) -> Vector:
    """As ``solve(codes, new)`` for a chunk that had ``before`` from ``old``; ends where both differ by a constant only."""
    for code in reversed(codes):
        if old == new:
            return before
        old, new = step(code, old)[0], step(code, new)[0]
    return new


class Edit(NamedTuple):
    """What is done up to and with a turn: letters, their cost, the next state, the roles of turns put in before it, its new
    role (None for its own), and whether it stays."""

    letters: str
    cost: int
    state: int
    puts: tuple[str, ...]
    role: str | None
    stays: bool


@cache
def _choice(code: int, state: int, behind: Vector) -> Edit:
    """The least letters among the cheapest edits."""
    ahead, least = step(code, behind)
    letters, cost, roles = "", 0, []
    while True:
        best = ahead[state] + least
        ways = {letter: (letter, price, after, role) for letter, price, after, role in _edits(code, state) if price + behind[after] == best}
        after, role = _NEXT[state]
        if "D" not in ways and INSERT + ahead[after] + least == best:
            letters, cost, state = letters + "I", cost + INSERT, after
            roles.append(role)
            continue
        letter, price, after, role = ways[min(ways)]
        return Edit(letters + letter, cost + price, after, tuple(roles), role, letter != "D")


def exits(codes: bytes, behind: Vector) -> list[int]:
    """The state behind a chunk for each state before it."""
    vectors = _vectors(codes, behind)
    out = list(STATES)
    for code, vector in zip(codes, vectors):
        out = [_choice(code, state, vector).state for state in out]
    return out


def _vectors(codes: bytes, behind: Vector) -> list[Vector]:
    """The vector behind each turn of a chunk."""
    out = []
    for code in reversed(codes):
        out.append(behind)
        behind = step(code, behind)[0]
    return out[::-1]


def trace(codes: bytes, behind: Vector, state: int) -> tuple[list[Edit], int]:
    """The edits of each turn of a chunk, and the state behind it."""
    out = []
    for code, vector in zip(codes, _vectors(codes, behind)):
        out.append(_choice(code, state, vector))
        state = out[-1].state
    return out, state


def ending(state: int) -> list[str]:
    """Roles of the turns that are put in behind the last turn."""
    roles = []
    while state in (SYSTEM, USER):
        state, role = _NEXT[state]
        roles.append(role)
    return roles
