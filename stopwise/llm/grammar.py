"""Probabilistic automata of short strings, by merging states of a prefix tree.

States whose futures do not differ significantly (Hoeffding bounds on the share
of ends and of every next symbol) are merged until none is left to merge.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable

# Symbols: digits, letters that are hexadecimal digits or not, and signs by themselves.
_CLASSES = ["0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", *"+/_.=-"]
SYMBOL = {letter: i for i, letters in enumerate(_CLASSES) for letter in letters}
SYMBOLS = len(_CLASSES)
_SMALLEST = 1e-4  # share that a state leaves to what it has not seen


def symbols(text: str) -> list[int]:
    return [SYMBOL[c] for c in text]


class Automaton:
    """A probabilistic automaton inferred from symbol strings.

    ``alpha`` is the significance of the merge test: the smaller, the more merges.
    """

    def __init__(self, strings: Iterable[list[int]], alpha: float = 0.05):
        self.seen: list[int] = [0]
        self.ends: list[int] = [0]
        self.next: list[dict[int, int]] = [{}]
        self._bound = math.sqrt(0.5 * math.log(2 / alpha))
        for string in strings:
            self._insert(string)
        self._passed = [Counter({s: self.seen[t] for s, t in n.items()}) for n in self.next]
        self._infer()

    def _insert(self, string: list[int]) -> None:
        state = 0
        self.seen[0] += 1
        for symbol in string:
            below = self.next[state].get(symbol)
            if below is None:
                below = self.next[state][symbol] = len(self.seen)
                self.seen.append(0)
                self.ends.append(0)
                self.next.append({})
            state = below
            self.seen[state] += 1
        self.ends[state] += 1

    def _differ(self, f: int, n: int, g: int, m: int) -> bool:
        return abs(f / n - g / m) > self._bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def _compatible(self, one: int, two: int) -> bool:
        pairs = [(one, two)]
        while pairs:
            a, b = pairs.pop()
            n, m = self.seen[a], self.seen[b]
            if self._differ(self.ends[a], n, self.ends[b], m):
                return False
            for symbol in self.next[a].keys() | self.next[b].keys():
                if self._differ(self._passed[a][symbol], n, self._passed[b][symbol], m):
                    return False
                if symbol in self.next[a] and symbol in self.next[b]:
                    pairs.append((self.next[a][symbol], self.next[b][symbol]))
        return True

    def _fold(self, keep: int, drop: int) -> None:
        """Add the tree below ``drop`` to ``keep``."""
        pairs = [(keep, drop)]
        while pairs:
            a, b = pairs.pop()
            self.seen[a] += self.seen[b]
            self.ends[a] += self.ends[b]
            self._passed[a].update(self._passed[b])
            for symbol, below in self.next[b].items():
                if symbol in self.next[a]:
                    pairs.append((self.next[a][symbol], below))
                else:
                    self.next[a][symbol] = below

    def _infer(self) -> None:
        settled = [0]
        while True:
            border = [
                (self.seen[t], s, symbol, t)
                for s in settled
                for symbol, t in self.next[s].items()
                if t not in settled
            ]
            if not border:
                break
            _, above, symbol, state = max(border)
            for other in settled:
                if self._compatible(other, state):
                    self.next[above][symbol] = other
                    self._fold(other, state)
                    break
            else:
                settled.append(state)
        self.states = settled

    def log_likelihood(self, string: list[int]) -> float:
        """Natural logarithm of the string's probability; what was never seen gets
        a small share."""
        state, total = 0, 0.0
        for symbol in string:
            below = self.next[state].get(symbol)
            share = self._passed[state][symbol] / self.seen[state] if self.seen[state] else 0.0
            total += math.log(max(share, _SMALLEST))
            state = state if below is None else below
        end = self.ends[state] / self.seen[state] if self.seen[state] else 0.0
        return total + math.log(max(end, _SMALLEST))
