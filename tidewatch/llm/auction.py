"""Cheapest edits of a run of conversation turns: an auction for the shortest path over the lattice of turns and states.

A node is a turn boundary and a state of the role pattern ``(s?(ua)+)?``: START, SYSTEM (after the first s), USER (an answer is due) or DONE.
Arcs keep, rerole, delete or insert a turn at integer costs.  The auction holds a path from the entry and a price for each node; at the
path's end it either raises the price to the cheapest arc's and steps back, or steps forward along that arc.  Prices never exceed the
distance to the exit, and where the path arrives the entry's price equals it.  Then every arc of every cheapest path is tight, and the
least audit is traced over tight arcs alone.
"""

from __future__ import annotations

START, SYSTEM, USER, DONE = range(4)
STATES = 4
#: No path; above any sum of costs.
NEVER = 1 << 60
#: Prices behind the last turn of a conversation.
END = (0, NEVER, NEVER, 0)
KEEP, REROLE, DELETE, INSERT, BROKEN = 0, 2, 3, 2, 1
#: Kinds of a turn: its first fault.
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)

_KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): DONE, (DONE, "u"): USER}
#: The state behind a user's or assistant's turn, whichever the state allows.
NEXT = (USER, USER, DONE, USER)
ROLE = ("user", "user", "assistant", "user")
GOAL = -1


class Lattice:
    """The turns of a piece by role initials and kinds; ``last`` allows inserts behind the last turn, others are before a turn."""

    def __init__(self, initials: list[str], kinds: list[int], exits=END, last: bool = True):
        self.initials, self.kinds, self.exits, self.last = initials, kinds, exits, last
        least = min(exits)
        # The cost of a turn that no edit can avoid is a lower bound to start from.
        self.price = [least] * (STATES * (len(kinds) + 1))
        for i in range(len(kinds) - 1, -1, -1):
            least = min(NEVER, least + (DELETE if kinds[i] in (BLANK, DUPLICATE) else BROKEN if kinds[i] == TRUNCATED else 0))
            self.price[STATES * i : STATES * (i + 1)] = [least] * STATES
        if exits[USER] >= NEVER and exits[DONE] >= NEVER:
            self._cut()

    def _cut(self) -> None:
        """Nodes without a way to an exit before the first user's turn: their prices would rise for ever."""
        way = self.exits[START] < NEVER
        for i in range(len(self.kinds), -1, -1):
            way = way or self.exits[SYSTEM] < NEVER and i < len(self.kinds) and self.initials[i] == "s" and self.kinds[i] not in (BLANK, DUPLICATE)
            for q, open_ in ((START, way), (SYSTEM, self.exits[SYSTEM] < NEVER), (USER, False), (DONE, False)):
                if not open_:
                    self.price[STATES * i + q] = NEVER

    def arcs(self, node: int) -> list[tuple[str, int, int]]:
        """(label, cost, node behind) of a node's arcs by label, the exit first."""
        i, q = divmod(node, STATES)
        insert = ("I", INSERT, STATES * i + NEXT[q])
        if i == len(self.kinds):
            out = [("", self.exits[q], GOAL)] if self.exits[q] < NEVER else []
            return [*out, insert] if self.last else out
        kind, on = self.kinds[i], STATES * (i + 1)
        out = [("D", DELETE, on + q), insert]
        if kind not in (BLANK, DUPLICATE):
            extra = BROKEN if kind == TRUNCATED else 0
            kept = _KEPT.get((q, self.initials[i]))
            if kept is not None:
                out.append(("K", KEEP + extra, on + kept))
            out.append(("R", REROLE + extra, on + NEXT[q]))
        return out

    def distance(self, entry: int) -> int:
        """Cost from a state before the first turn to the exit, by the auction; prices stay for the next entry."""
        price, path = self.price, [entry]
        while path[-1] != GOAL:
            node = path[-1]
            best, behind = NEVER, GOAL
            for _, cost, to in self.arcs(node):
                total = cost + (price[to] if to != GOAL else 0)
                if total < best:
                    best, behind = total, to
            if price[node] < best or best == NEVER:
                price[node] = best
                if len(path) > 1:
                    path.pop()
                elif best == NEVER:
                    return NEVER
            else:
                path.append(behind)
        return price[entry]

    def trace(self, entry: int) -> tuple[int, str]:
        """(exit state, labels) of the cheapest path whose labels are ASCII-least; (-1, "") where there is none."""
        if self.distance(entry) >= NEVER:
            return -1, ""
        price, dead = self.price, set()
        path, labels = [entry], []
        while True:
            node = path[-1]
            for label, cost, to in self.arcs(node):
                if to == GOAL and price[node] == cost:
                    return node % STATES, "".join(labels)
                if to != GOAL and to not in dead and price[node] == cost + price[to]:
                    path.append(to)
                    labels.append(label)
                    break
            else:
                dead.add(path.pop())
                labels.pop()


def matrix(initials: list[str], kinds: list[int], last: bool) -> list[int]:
    """Costs from each entry state to each exit state of a piece, entries first; of a last piece, to the end of the conversation."""
    out = [NEVER] * (STATES * STATES)
    if last:
        lattice = Lattice(initials, kinds)
        for entry in range(STATES):
            out[STATES * entry + DONE] = lattice.distance(entry)
        return out
    for q in range(STATES):
        lattice = Lattice(initials, kinds, tuple(0 if p == q else NEVER for p in range(STATES)), False)
        for entry in range(STATES):
            out[STATES * entry + q] = lattice.distance(entry)
    return out


def before(costs: list[int], exits: list[int]) -> list[int]:
    """Prices before a piece from those behind it."""
    return [min(NEVER, *(costs[STATES * q + p] + exits[p] for p in range(STATES))) for q in range(STATES)]


__all__ = ["Lattice", "before", "matrix"]
