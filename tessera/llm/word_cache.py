"""What a worker remembers of words, bounded in bytes.

Two generations are kept: a word asked for again moves to the young one, and when that is full the old one goes. So
frequent words stay, rare ones leave, and the memory of a worker does not depend on the corpus.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Generic, TypeVar

import regex

Value = TypeVar("Value")

#: What an entry takes beside the characters of its word and its value: two objects and their place in a table.
ENTRY_BYTES = 230
#: Characters of text that are split into words at once.
GROUP_CHARS = 1 << 19
#: No pre-token of the patterns in use goes on from a letter to white space, whatever follows.
_CUT = regex.compile(r"(?<=\p{L})\s")


class WordCache(Generic[Value]):
    """Values of words; ``learn`` makes those that are asked for and not there. Each generation has ``limit`` bytes."""

    def __init__(self, learn: Callable[[list[str]], Iterable[Value]], limit: int, size: Callable[[Value], int] = lambda v: 0):
        self.learn, self.limit, self.size = learn, limit, size
        self.young: dict[str, Value] = {}
        self.old: dict[str, Value] = {}
        self.held = 0

    def turn(self) -> None:
        """Let the old generation go if the young one is full. What was asked for before may be gone then."""
        if self.held > self.limit:
            self.young, self.old, self.held = {}, self.young, 0

    def hold(self, words: Iterable[Sequence[str]]) -> dict[str, Value]:
        """A table that has all these words until the next turn."""
        new = set().union(*words).difference(self.young)
        if self.old and (known := new & self.old.keys()):
            self.young.update((w, self.old[w]) for w in known)
            new -= known
            self.held += ENTRY_BYTES * len(known) + sum(map(len, known))
        if new:
            listed = list(new)
            values = list(self.learn(listed))
            self.young.update(zip(listed, values, strict=True))
            self.held += ENTRY_BYTES * len(listed) + sum(map(len, listed)) + sum(map(self.size, values))
        return self.young


def segments(text: str, limit: int = GROUP_CHARS) -> Iterator[str]:
    """A long text in parts of about ``limit`` characters, cut where white space follows a letter, so no word is cut."""
    start = 0
    while len(text) - start > limit and (found := _CUT.search(text, start + limit)):
        yield text[start : found.start()]
        start = found.start()
    yield text[start:] if start else text


def groups(texts: Sequence[str], limit: int = GROUP_CHARS) -> Iterator[list[tuple[int, str]]]:
    """(place of its text, segment) of all texts in turn, in lists of about ``limit`` characters."""
    waiting: list[tuple[int, str]] = []
    chars = 0
    for k, text in enumerate(texts):
        for part in segments(text, limit):
            waiting.append((k, part))
            chars += len(part)
            if chars >= limit:
                yield waiting
                waiting, chars = [], 0
    if waiting:
        yield waiting
