"""Many name patterns at once; the helper behind ``filters.target_semi_join``.

A name is written as one text, database and table between marks, and a pattern is
cut at its stars into literal pieces; where a piece begins or ends a name it takes the
mark with it. An automaton over the pieces (Aho and Corasick 1975) finds all that
a text holds in one walk. A pattern is looked at only if the piece it shares with
the fewest other patterns is there, and then by its other pieces, before their
order is checked.
"""

from __future__ import annotations

import re
from collections import Counter

START, MIDDLE, END = "\x02", "\x03", "\x04"


class PatternAutomaton:
    """``patterns`` are pairs for database and table; ``*`` alone is anything, null too, else any run without a newline."""

    def __init__(self, patterns: list[tuple[str, str]]):
        pieces = [_pieces(*p) for p in patterns]
        shared = Counter(piece for some in pieces for piece in some)
        self.always = [_Pattern(*p) for p, some in zip(patterns, pieces) if not some]
        self.by_piece: dict[str, list[tuple[frozenset[str], _Pattern]]] = {}
        for pattern, some in zip(patterns, pieces):
            if some:
                rarest = min(some, key=lambda piece: (shared[piece], -len(piece), piece))
                self.by_piece.setdefault(rarest, []).append((frozenset(some), _Pattern(*pattern)))
        self._build(sorted(shared))

    def _build(self, pieces: list[str]) -> None:
        """Edges between nodes; where a walk goes on when it is stuck; the pieces that end at a node."""
        edges: dict[tuple[int, str], int] = {}
        self.ends: list[str | None] = [None]
        below: list[list[tuple[str, int, int]]] = []  # the edges of each depth
        for piece in pieces:
            node = 0
            for depth, letter in enumerate(piece):
                onward = edges.get((node, letter))
                if onward is None:
                    onward = edges[node, letter] = len(self.ends)
                    self.ends.append(None)
                    if depth == len(below):
                        below.append([])
                    below[depth].append((letter, node, onward))
                node = onward
            self.ends[node] = piece
        self.edges = edges
        self.fallback = [0] * len(self.ends)
        self.shorter = [0] * len(self.ends)  # the next node behind a node's fallbacks at which a piece ends
        for level in below[1:]:
            for letter, node, child in level:
                back = self.fallback[node]
                while back and (back, letter) not in edges:
                    back = self.fallback[back]
                back = edges.get((back, letter), 0)
                self.fallback[child] = back
                self.shorter[child] = back if self.ends[back] else self.shorter[back]

    def found(self, text: str) -> set[str]:
        """The pieces that the text holds."""
        found: set[str] = set()
        edges, fallback, ends, shorter = self.edges, self.fallback, self.ends, self.shorter
        node = 0
        for letter in text:
            while node and (node, letter) not in edges:
                node = fallback[node]
            node = edges.get((node, letter), 0)
            at = node if ends[node] else shorter[node]
            # What ends at a node that was met before has been taken with it.
            while at and ends[at] not in found:
                found.add(ends[at])
                at = shorter[at]
        return found

    def matches(self, database: str | None, table: str | None) -> bool:
        if any(pattern.matches(database, table) for pattern in self.always):
            return True
        found = self.found(_text(database, table))
        for piece in found:
            for needed, pattern in self.by_piece.get(piece, ()):
                if needed <= found and pattern.matches(database, table):
                    return True
        return False


def _text(database: str | None, table: str | None) -> str:
    # An unknown half is left out with its marks, so that no piece of it is found.
    first = "" if database is None else START + database + MIDDLE
    second = "" if table is None else MIDDLE + table + END
    return first + second if database is None or table is None else first + second[1:]


def _pieces(database: str, table: str) -> list[str]:
    """Literal pieces of a pattern; two names without a star are one piece."""
    if "*" not in database + table:
        return [START + database + MIDDLE + table + END]
    return _of_half(database, START, MIDDLE) + _of_half(table, MIDDLE, END)


def _of_half(half: str, before: str, behind: str) -> list[str]:
    if "*" not in half:
        return [before + half + behind]
    head, *inner, tail = half.split("*")
    return [before + head] * bool(head) + [piece for piece in inner if piece] + [tail + behind] * bool(tail)


class _Pattern:
    """One pattern, whole; its expressions are made when first needed."""

    __slots__ = ("halves", "tests")

    def __init__(self, database: str, table: str):
        self.halves, self.tests = (database, table), None

    def matches(self, *names: str | None) -> bool:
        if self.tests is None:
            self.tests = [None if h == "*" else re.compile(r"[^\n]*".join(map(re.escape, h.split("*")))).fullmatch for h in self.halves]
        return all(test is None or (name is not None and test(name) is not None) for test, name in zip(self.tests, names))
