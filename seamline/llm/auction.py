"""Cheapest edits that give a conversation its form, by an auction on the edit lattice.

A node is a place between rows and the role that stands last: nothing, system, user or
assistant.  Its price is what the way from there to the end costs.  A path starts at a
node and is extended along its cheapest arc while the price pays for that arc; when it
does not, the price is raised to what the cheapest arc asks and the path is contracted
by a node.  A path that reaches a node whose price has converged has paid its own way,
and all prices along it have converged too.  Starting points are taken from the last row
to the first, so that every path is short and the work grows with the rows; the prices
of a row start at the least of the row below, which no way from it can undercut.

Where all prices have converged, an arc is on a cheapest way exactly if its cost is the
difference of the prices at its ends.  These tight arcs, taken in the order of their
letters, spell the least of the cheapest edits.
"""

from __future__ import annotations

from collections.abc import Sequence

START, SYSTEM, USER, ASSISTANT = range(4)  # what stands last; also the codes of role initials, 0 for others
NEXT = (USER, USER, ASSISTANT, USER)  # what an inserted or renamed row becomes
NEVER = 1 << 40
TRUNCATED, REMOVED = 4, 8  # bits of a row's code beside its role
ENDS = (0, 4, 2, 0)  # what is still to pay after the last row: the pairs that are not complete
_INSERT, _RENAME, _DELETE = 2, 2, 3
_FOLLOWS = {(START, SYSTEM), (START, USER), (SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}


def _kept(code: int, state: int) -> bool:
    return not code & REMOVED and (state, code & 3) in _FOLLOWS


def _ways(code: int, state: int, below: Sequence[int]) -> int:
    """The least that the arcs which use up the row ask for."""
    least = _DELETE + below[state]
    if not code & REMOVED:
        late = 1 if code & TRUNCATED else 0
        least = min(least, _RENAME + late + below[NEXT[state]])
        if (state, code & 3) in _FOLLOWS:
            least = min(least, late + below[code & 3])
    return least


def prices(codes: Sequence[int], ends: Sequence[int] = ENDS) -> list[list[int]]:
    """Converged prices of the four nodes before each row and, as given, after the last."""
    table = [list(ends)]
    # No way leads from user or assistant to the other two.
    lost = ends[USER] >= NEVER and ends[ASSISTANT] >= NEVER
    for code in reversed(codes):
        below = table[-1]
        price = [min(below)] * 4
        done = [False] * 4
        if lost:
            price[USER] = price[ASSISTANT] = NEVER
            done[USER] = done[ASSISTANT] = True
        down = [_ways(code, state, below) for state in range(4)]
        for origin in (ASSISTANT, USER, SYSTEM, START):
            path = [origin]
            while not done[path[-1]]:
                state = path[-1]
                across = _INSERT + price[NEXT[state]]
                asked = min(down[state], across, NEVER)
                if price[state] < asked:
                    price[state] = asked
                    if len(path) > 1:
                        path.pop()
                elif down[state] <= across or asked == NEVER:
                    break
                else:
                    path.append(NEXT[state])
            for state in path:
                done[state] = True
        table.append(price)
    return table[::-1]


def trace(codes: Sequence[int], table: list[list[int]], state: int, last: bool = True) -> tuple[str, int]:
    """The letters of the least cheapest edits from a node before the first row, and the node they end at.

    D deletes the row, I inserts one before it, K keeps it, R renames its role.
    ``last``: rows that are missing after the last row are inserted as well.
    """
    letters = []
    for code, here, below in zip(codes, table, table[1:]):
        late = 1 if code & TRUNCATED else 0
        while True:
            price = here[state]
            if price == _DELETE + below[state]:
                letters.append("D")
                break
            if price == _INSERT + here[NEXT[state]]:
                letters.append("I")
                state = NEXT[state]
                continue
            if _kept(code, state) and price == late + below[code & 3]:
                letters.append("K")
                state = code & 3
            else:
                letters.append("R")
                state = NEXT[state]
            break
    while last and ENDS[state]:
        letters.append("I")
        state = NEXT[state]
    return "".join(letters), state


def passage(codes: Sequence[int]) -> list[list[int]]:
    """What it costs at least to go from each node before some rows to each node after them."""
    columns = [prices(codes, [0 if k == end else NEVER for k in range(4)])[0] for end in range(4)]
    return [[min(columns[end][state], NEVER) for end in range(4)] for state in range(4)]


def before(passage: Sequence[Sequence[int]], ends: Sequence[int]) -> list[int]:
    """The prices before some rows from those after them."""
    return [min(min(cost + end for cost, end in zip(row, ends)), NEVER) for row in passage]
