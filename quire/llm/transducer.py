"""Byte-pair merges compiled into a deterministic transducer.

A sequence of tokens is what the merges make of its bytes if and only if each
two neighbours are what they make of those two's bytes.  So for every prefix of
a word exactly one token can be the last, and it is found from the last tokens
of shorter prefixes.  A state holds what the future can depend on: the longest
end of the bytes read with which a token can begin, and for each place in it the
last token there and the number of tokens, relative to the number at its end.
That is a finite number of states; they are compiled when first reached.  A
transition on a byte emits the change in the number of tokens, the one at the
word's end what the end-of-word token changes.
"""

from __future__ import annotations

import functools


class Transducer:
    STATES = 400_000  # if there are more, all are dropped before the next word

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], end: str = ""):
        """vocabulary: token strings (one character a byte; `end` closes those at
        a word's end).  merges: pairs in their order."""
        self.end, self.vocabulary = end, vocabulary
        self.rank = {tuple(pair): i for i, pair in reversed(list(enumerate(merges)))}
        self.made = {a + b: (i, a, b) for (a, b), i in self.rank.items()}
        if len(self.made) < len(self.rank):
            raise ValueError("a token is made by two merges")
        heads = {t[: -len(end)] if end and t.endswith(end) else t for t in vocabulary}
        self.beginnings = {t[:n] for t in heads for n in range(len(t) + 1)}
        self.neighbours = functools.lru_cache(1 << 20)(self._neighbours)
        self.spine = functools.cache(self._spine)
        self.whole = functools.cache(lambda token: self.merged(self._symbols(token)) == [token])
        self._clear()

    def _clear(self) -> None:
        # a state: (bytes, last token and relative count at each place in them)
        self.number: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.arcs: list[dict[str, tuple[int, int]]] = []
        self.ends: list[int | None] = []
        self._state(("", ((None, 0),)))

    def _state(self, state: tuple) -> int:
        at = self.number.get(state)
        if at is None:
            at = self.number[state] = len(self.states)
            self.states.append(state)
            self.arcs.append({})
            self.ends.append(None)
        return at

    def merged(self, symbols: list[str]) -> list[str]:
        """The merges applied one after the other, lowest first, leftmost first."""
        symbols = list(symbols)
        while len(symbols) > 1:
            rank, at = min((self.rank.get(p, len(self.rank)), i) for i, p in enumerate(zip(symbols, symbols[1:])))
            if rank == len(self.rank):
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def _symbols(self, token: str) -> list[str]:
        if self.end and token.endswith(self.end):
            body = token[: -len(self.end)]
            return [*body[:-1], body[-1:] + self.end]
        return list(token)

    def _spine(self, token: str, side: int) -> list[tuple[str, float]]:
        """The symbols at the token's left (1) or right (2) edge while it is made,
        smallest first, each with the rank of the merge that ends it."""
        out, ends = [], float("inf")
        while True:
            out.append((token, ends))
            if token not in self.made:
                return out[::-1]
            ends, token = self.made[token][0], self.made[token][side]

    def _neighbours(self, a: str | None, b: str) -> bool:
        """Whether the merges make just these two of their bytes: each alone is
        made whole, and no merge over their border is due before the symbols at
        it have become part of larger ones.  (A merge's rank is above those of
        the two it joins, so ranks are times; of equal ones the left is first.)"""
        if not self.whole(b):
            return False
        if a is None:
            return True
        left, right, i, j = self.spine(a, 2), self.spine(b, 1), 0, 0
        while True:
            (x, x_ends), (y, y_ends) = left[i], right[j]
            due = self.rank.get((x, y))
            if due is not None and due < x_ends and due <= y_ends:
                return False
            if x_ends == y_ends == float("inf"):
                return True
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1

    def _last(self, text: str, places: tuple, close: str) -> tuple[str, int]:
        """The last token of `text` and the number of tokens, relative to that at
        the last of `places`, the places before each of the bytes."""
        for at, (before, count) in enumerate(places):
            token = text[at:] + close
            if token in self.vocabulary and self.neighbours(before, token):
                return token, count + 1
        raise ValueError(f"no token ends {text!r}")

    def _arc(self, at: int, byte: str) -> tuple[int, int]:
        text, places = self.states[at]
        text += byte
        token, emitted = self._last(text, places, "")
        places = tuple((t, n - emitted) for t, n in places) + ((token, 0),)
        cut = next(k for k in range(len(text) + 1) if text[k:] in self.beginnings)
        arc = self.arcs[at][byte] = (self._state((text[cut:], places[cut:])), emitted)
        return arc

    def _end(self, at: int) -> int:
        """What the end of the word emits.  Its last byte is read already, so the
        places before each byte are all but the last one."""
        text, places = self.states[at]
        emitted = self.ends[at] = self._last(text, places[:-1], self.end)[1] if self.end else 0
        return emitted

    def count(self, word: str) -> int:
        """Tokens of a word (one character a byte): the sum of what its path emits."""
        if len(self.states) > self.STATES:
            self._clear()
        if not word:
            return 0
        state, total = 0, 0
        for byte in word:
            state, emitted = self.arcs[state].get(byte) or self._arc(state, byte)
            total += emitted
        last = self.ends[state]
        return total + (self._end(state) if last is None else last)
