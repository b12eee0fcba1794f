"""Texts as words with their places, read by small grammars; replacements that don't meet."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import deque
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np

#: Dice, numbers, words, and signs one by one.
_WORD = re.compile(r"\d*[dD]\d+|\d+|[^\W\d]+|[^\w\s]")


class Span(NamedTuple):
    """A stretch of a text and what replaces it."""

    start: int
    end: int
    text: str


class Words:
    """The words and signs of a text. Places in it are numbers of words; reading beyond the end gives empty words."""

    def __init__(self, text: str):
        self.text = text
        self.at = [m.span() for m in _WORD.finditer(text)]
        self.words = [text[a:b] for a, b in self.at]

    def __len__(self) -> int:
        return len(self.words)

    def word(self, i: int) -> str:
        return self.words[i] if 0 <= i < len(self.words) else ""

    def take(self, i: int, options) -> int:
        """The place behind word i if it is one of the options, else i."""
        return i + (self.word(i) in options and i < len(self.words))

    def touches(self, i: int) -> bool:
        """Whether nothing stands between word i and the word before."""
        return 0 < i < len(self.at) and self.at[i - 1][1] == self.at[i][0]

    def bound(self, i: int) -> bool:
        """Whether a word may start or end before word i: there aren't letters or digits on both sides without a blank."""
        return not (self.touches(i) and self.word(i - 1)[-1].isalnum() and self.word(i)[0].isalnum())

    def between(self, i: int, j: int) -> str:
        """The text from word i to the word before j."""
        return self.text[self.at[i][0] : self.at[j - 1][1]] if i < j else ""


class Phrases:
    """A dictionary of phrases, each with a value; the longest that stands at a place is found."""

    def __init__(self, values: dict[str, object]):
        self.by_first: dict[str, list[tuple[int, str, object]]] = {}
        for phrase, value in values.items():
            words = _WORD.findall(phrase)
            self.by_first.setdefault(words[0], []).append((len(words), phrase, value))
        for found in self.by_first.values():
            found.sort(key=lambda p: -p[0])

    @property
    def openers(self) -> frozenset[str]:
        """The first words of all phrases."""
        return frozenset(self.by_first)

    def at(self, words: Words, i: int) -> tuple[int, object] | None:
        """The place behind the phrase at word i, and its value."""
        for n, phrase, value in self.by_first.get(words.word(i), ()):
            if i + n <= len(words) and " ".join(words.between(i, i + n).split()) == phrase:
                return i + n, value
        return None


def either_case(*phrases: str) -> dict[str, str]:
    """Phrases with a small and with a capital first letter."""
    return {form: p for p in phrases for form in (p, p[0].upper() + p[1:])}


def scan(words: Words, grammar, starts: Iterable[int]) -> Iterator[tuple[int, int, object]]:
    """(first word, word behind, value) where a grammar reads something at one of the places, from the left and without overlaps."""
    free = 0
    for i in starts:
        if i >= free and (read := grammar(words, i)) is not None:
            yield i, *read
            free = max(read[0], i + 1)


class Automaton:
    """An Aho-Corasick automaton that reads many texts at once.

    Its moves are one array, state by character class. Texts are cut into strips of equal width that begin so far
    before their own part that every pattern that ends in it is seen whole; a step moves all strips by one character.
    """

    WIDTH = 256

    def __init__(self, patterns: Iterable[str]):
        self.patterns = sorted(set(patterns) - {""})
        self.codes = np.array(sorted({ord(c) for p in self.patterns for c in p}), np.uint32)
        self.lead = max(map(len, self.patterns), default=1) - 1
        place = {chr(c): k for k, c in enumerate(self.codes.tolist())}
        children, self.ends = [{}], [-1]
        for n, p in enumerate(self.patterns):
            state = 0
            for c in p:
                if place[c] not in children[state]:
                    children[state][place[c]] = len(children)
                    children.append({})
                    self.ends.append(-1)
                state = children[state][place[c]]
            self.ends[state] = n
        self.moves = np.zeros((len(children), len(self.codes) + 1), np.int32)
        self.shorter = np.zeros(len(children), np.int32)  # the next state down that ends a pattern, 0: none
        fail, todo = [0] * len(children), deque([0])
        while todo:
            state = todo.popleft()
            if state:
                self.moves[state] = self.moves[fail[state]]
                self.shorter[state] = fail[state] if self.ends[fail[state]] >= 0 else self.shorter[fail[state]]
            for c, child in children[state].items():
                fail[child] = int(self.moves[fail[state], c]) if state else 0
                todo.append(child)
            for c, child in children[state].items():
                self.moves[state, c] = child
        self.ends = np.array(self.ends, np.int32)
        self.hit = (self.ends >= 0) | (self.shorter > 0)
        self.size = np.array([*map(len, self.patterns), 0], np.int64)

    def find(self, points: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, place in it and pattern of all occurrences, for texts that begin at ``at`` in an array of code points (its end is last)."""
        size = np.diff(at)
        width = int(min(self.WIDTH, max(size.max(initial=0), 1)))
        strips = -(-size // width)
        text = np.repeat(np.arange(len(size)), strips)
        part = np.arange(len(text)) - np.repeat(np.cumsum(strips) - strips, strips)
        begin = at[:-1][text] + part * width - self.lead
        kind = np.searchsorted(self.codes, points).astype(np.int32)
        kind[np.append(self.codes, np.uint32(0xFFFFFFFF))[kind] != points] = len(self.codes)
        kind = np.append(kind, np.int32(len(self.codes)))
        lo, hi = at[:-1][text], np.minimum(at[1:][text], begin + self.lead + width)
        state, found = np.zeros(len(text), np.int32), []
        for k in range(self.lead + width):
            here = begin + k
            state = self.moves[state, kind[np.where((here >= lo) & (here < hi), here, len(points))]]
            if k >= self.lead and (hits := np.flatnonzero(self.hit[state])).size:
                found.append((hits, here[hits], state[hits]))
        if not found:
            none = np.zeros(0, np.int64)
            return none, none, none
        strip, end, state = (np.concatenate(x) for x in zip(*found, strict=True))
        out = []
        while len(state):
            own = self.ends[state] >= 0
            n = self.ends[state[own]]
            out.append((text[strip[own]], end[own] - at[text[strip[own]]] - self.size[n] + 1, n))
            state = self.shorter[state]
            strip, end, state = strip[state > 0], end[state > 0], state[state > 0]
        t, start, n = (np.concatenate(x) for x in zip(*out, strict=True))
        order = np.lexsort((n, start, t))
        return t[order], start[order], n[order]

    def opened(self, texts: list[str]) -> np.ndarray:
        """Whether each text holds one of the patterns."""
        at = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) for t in texts], out=at[1:])
        out = np.zeros(len(texts), bool)
        out[self.find(np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), at)[0]] = True
        return out


def disjoint(spans: Iterable[Span], taken: Iterable[Span] = ()) -> list[Span]:
    """Of spans in order of precedence those that meet none before them nor any taken, by place."""
    order = sorted(taken)
    mine = set()
    for s in spans:
        k = bisect_left(order, (s.start,))
        if (k == 0 or order[k - 1].end <= s.start) and (k == len(order) or s.end <= order[k].start):
            order.insert(k, s)
            mine.add(s)
    return [s for s in order if s in mine]


def label(text: str) -> str:
    """A link's visible text, which can't hold its closing brace."""
    return text.replace("}", ")")
