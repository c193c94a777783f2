"""Levenshtein automata intersected with the trie of a lexicon, made one state at a time.

A state is a set of (trie node, edits so far); reading a character of a word gives the next state.
States are numbered when they are first met and remembered with their transitions, so a word costs
one dictionary look-up per character, and most words end after a few characters in the state that
no term can be reached from. Once `capacity` states are held all are forgotten, which bounds the
memory and changes no result.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

DEAD = -1


def edits_allowed(term: str) -> int:
    """Edits within which a misspelling of a term is looked for."""
    return 0 if len(term) < 5 else 1 if len(term) < 8 else 2


class LexiconAutomaton:
    """Finds the nearest term of a lexicon for a word or for one of its prefixes."""

    def __init__(self, terms: Sequence[str], allowed: Callable[[str], int] = edits_allowed, capacity: int = 200_000):
        self.terms, self.capacity = list(terms), capacity
        self.children: list[dict[str, int]] = [{}]
        self.term_at = [-1]
        self.reach = [0]
        self.allowed = [allowed(t) for t in self.terms]
        for number, term in enumerate(self.terms):
            node, k = 0, self.allowed[number]
            self.reach[0] = max(self.reach[0], k)
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.term_at.append(-1)
                    self.reach.append(0)
                node = self.children[node][c]
                self.reach[node] = max(self.reach[node], k)
            self.term_at[node] = number
        self._forget()

    def _forget(self) -> None:
        self.numbers: dict[tuple, int] = {}
        self.sets: list[tuple] = []
        self.found: list[tuple[int, int] | None] = []
        self.moves: list[dict[str, int]] = []
        self.start = self._number({0: 0})

    def _number(self, edits: dict[int, int]) -> int:
        """The state of a set of nodes, with terms' characters skipped at one edit each."""
        queue = list(edits)
        for node in queue:
            cost = edits[node] + 1
            for child in self.children[node].values():
                if cost <= self.reach[child] and cost < edits.get(child, 9):
                    edits[child] = cost
                    queue.append(child)
        key = tuple(sorted(edits.items()))
        if not key:
            return DEAD
        if key not in self.numbers:
            self.numbers[key] = len(self.sets)
            self.sets.append(key)
            self.moves.append({})
            ends = [(e, self.term_at[n]) for n, e in key if self.term_at[n] >= 0 and e <= self.allowed[self.term_at[n]]]
            self.found.append(min(ends, default=None))
        return self.numbers[key]

    def _move(self, state: int, c: str) -> int:
        after: dict[int, int] = {}
        for node, e in self.sets[state]:
            if e + 1 <= self.reach[node]:
                after[node] = min(e + 1, after.get(node, 9))
            for letter, child in self.children[node].items():
                cost = e + (letter != c)
                if cost <= self.reach[child] and cost < after.get(child, 9):
                    after[child] = cost
        number = self._number(after)
        self.moves[state][c] = number
        return number

    def nearest(self, word: str) -> tuple[int, int, bool] | None:
        """(edits, number of the term, whether the whole word was read) of the best match.

        A match of the whole word goes before one of a prefix with as many edits.
        """
        if len(self.sets) > self.capacity:
            self._forget()
        state, prefix, last = self.start, None, len(word) - 1
        for i, c in enumerate(word):
            moved = self.moves[state].get(c)
            state = self._move(state, c) if moved is None else moved
            if state == DEAD:
                break
            ends = self.found[state]
            if ends is not None:
                if i == last:
                    return (*ends, True) if prefix is None or ends[0] <= prefix[0] else (*prefix, False)
                if prefix is None or ends[0] <= prefix[0]:
                    prefix = ends
        return None if prefix is None else (*prefix, False)
