"""Levenshtein automata intersected with a trie.

The automaton of a query word accepts every word within k edits. An edit is an
insertion, deletion, substitution or swap of neighbours, or one of the glyph
merges given (two written letters read as one, or one as two). Walking the trie
with the automaton visits only prefixes that can still be completed, so the
retrieval is complete without comparing the query with every entry.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable


class Automaton:
    """Nondeterministic automaton of `query`; states are (position, errors, owed).

    `owed` is text that the accepted word must still spell before `position` holds.
    """

    def __init__(self, query: str, k: int, merges: Iterable[tuple[str, str]] = ()) -> None:
        self.q, self.k = query, k
        self.merges = [(w, r) for w, r in merges if r in query]

    def start(self) -> dict[tuple[int, str], int]:
        return self._close({(0, ""): 0})

    def _close(self, states: dict[tuple[int, str], int]) -> dict[tuple[int, str], int]:
        # letters of the query that the word does not have
        work = list(states.items())
        for (i, owed), e in work:
            if not owed and e < self.k and i < len(self.q):
                s = (i + 1, "")
                if states.get(s, self.k + 1) > e + 1:
                    states[s] = e + 1
                    work.append((s, e + 1))
        return states

    def step(self, states: dict[tuple[int, str], int], c: str) -> dict[tuple[int, str], int]:
        out: dict[tuple[int, str], int] = {}
        q, k, n = self.q, self.k, len(self.q)

        def put(s: tuple[int, str], e: int) -> None:
            if out.get(s, k + 1) > e:
                out[s] = e

        for (i, owed), e in states.items():
            if owed:
                if owed[0] == c:
                    put((i, owed[1:]), e)
                continue
            if i < n and q[i] == c:
                put((i + 1, ""), e)
            if e < k:
                put((i, ""), e + 1)
                if i < n:
                    put((i + 1, ""), e + 1)
                if i + 1 < n and q[i + 1] == c and q[i] != c:
                    put((i + 2, q[i]), e + 1)
                for written, read in self.merges:
                    if written[0] == c and q.startswith(read, i):
                        put((i + len(read), written[1:]), e + 1)
        return self._close(out)

    def accepted(self, states: dict[tuple[int, str], int]) -> int | None:
        """Errors of the cheapest accepting state, None if there is none."""
        return states.get((len(self.q), ""))


class Trie:
    """Words with payloads; several payloads may share a word (alias paths)."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, word: str, payload) -> None:
        node = self.root
        for c in word:
            node = node.setdefault(c, {})
        node.setdefault("", []).append(payload)

    def within(self, automaton: Automaton) -> list[tuple[int, object]]:
        """(errors, payload) of every entry that the automaton accepts."""
        found: list[tuple[int, object]] = []
        stack = [(self.root, automaton.start())]
        while stack:
            node, states = stack.pop()
            for c, child in node.items():
                if c == "":
                    e = automaton.accepted(states)
                    if e is not None:
                        found += [(e, p) for p in child]
                    continue
                nxt = automaton.step(states, c)
                if nxt:
                    stack.append((child, nxt))
        return found


def jamo(text: str) -> str:
    """Hangul syllables as letters, so that one wrong letter is one edit."""
    return unicodedata.normalize("NFD", text)
