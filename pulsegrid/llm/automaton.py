"""A lexicon trie walked together with the Levenshtein automaton of a word, as one lazily built automaton."""

from __future__ import annotations

from dataclasses import dataclass

MAX_STATES = 200_000


@dataclass(frozen=True)
class Term:
    """A lexicon entry. A stem matches every word that begins with it."""

    text: str
    weight: float
    stem: bool = False


@dataclass(frozen=True)
class Match:
    term: Term
    edits: int


class LexiconAutomaton:
    """Finds the best lexicon term within ``edits`` edits (insert, delete, replace) of a word.

    A state is the set of (trie node, edits so far) that some reading of the word so far can have reached; terms
    shorter than ``fuzzy_length`` (stems: ``fuzzy_stem``, the same unless given) allow no edits. A stem and a word may
    have the same letters. States and their transitions are built when a word first needs them
    and shared by all words, so a known word costs one lookup per letter, and most words end in the empty state after
    a few.
    """

    def __init__(self, terms: list[Term], edits: int = 1, fuzzy_length: int = 5, fuzzy_stem: int | None = None):
        self.edits, self.fuzzy_length = edits, fuzzy_length
        self.fuzzy_stem = fuzzy_length if fuzzy_stem is None else fuzzy_stem
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[Term]] = [[]]
        self.fuzzy: list[bool] = [False]  # a term at or below a node allows edits
        for term in terms:
            node = 0
            fuzzy = self._editable(term)
            self.fuzzy[0] |= fuzzy
            for letter in term.text:
                if letter not in self.children[node]:
                    self.children[node][letter] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                    self.fuzzy.append(False)
                node = self.children[node][letter]
                self.fuzzy[node] |= fuzzy
            self.ends[node].append(term)
        self._forget()

    def _editable(self, term: Term) -> bool:
        return len(term.text) >= (self.fuzzy_stem if term.stem else self.fuzzy_length)

    def _forget(self) -> None:
        self.numbers: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.next: list[dict[str, int]] = []
        self.best: list[Match | None] = []  # if the word ended here
        self.seen: list[Match | None] = []  # stems read completely here
        self.start = self._number(self._skips({0: 0}))

    def _allowed(self, node: int) -> int:
        return self.edits if self.fuzzy[node] else 0

    def _skips(self, reached: dict[int, int]) -> dict[int, int]:
        """Adds what can be reached by leaving out letters of a term."""
        todo = list(reached)
        while todo:
            node = todo.pop()
            spent = reached[node] + 1
            for child in self.children[node].values():
                if spent <= self._allowed(child) and spent < reached.get(child, self.edits + 1):
                    reached[child] = spent
                    todo.append(child)
        return reached

    def _number(self, reached: dict[int, int]) -> int:
        key = frozenset(reached.items())
        if key in self.numbers:
            return self.numbers[key]
        matches = [
            Match(term, spent)
            for node, spent in key
            for term in self.ends[node]
            if spent == 0 or self._editable(term)
        ]
        order = lambda m: (-m.edits, m.term.weight, m.term.text)
        self.numbers[key] = len(self.sets)
        self.sets.append(key)
        self.next.append({})
        self.best.append(max(matches, key=order, default=None))
        self.seen.append(max((m for m in matches if m.term.stem), key=order, default=None))
        return len(self.sets) - 1

    def _step(self, state: int, letter: str) -> int:
        reached: dict[int, int] = {}

        def reach(node: int, spent: int) -> None:
            if spent <= self._allowed(node) or spent == 0:
                reached[node] = min(spent, reached.get(node, spent))

        for node, spent in self.sets[state]:
            for other, child in self.children[node].items():
                reach(child, spent + (other != letter))  # same letter, or another one
            reach(node, spent + 1)  # a letter too many
        return self._number(self._skips(reached))

    def match(self, word: str) -> Match | None:
        """The term with fewest edits, then of greatest weight, that the word (or for a stem, its beginning) is."""
        if len(self.sets) > MAX_STATES:
            self._forget()
        state, found = self.start, None
        for letter in word:
            following = self.next[state].get(letter)
            if following is None:
                following = self.next[state][letter] = self._step(state, letter)
            state = following
            stem = self.seen[state]
            if stem and (found is None or stem.edits < found.edits):
                found = stem
            if not self.sets[state]:
                return found
        end = self.best[state]
        if end and (found is None or (end.edits, -end.term.weight) <= (found.edits, -found.term.weight)):
            return end
        return found
