"""Work that depends on one word only: hashes of many words at once, and bounded caches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from sys import getsizeof

import numpy as np

M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: A random number for each byte at each of 64 places; a word's hash is the sum of its bytes' numbers, mixed.
PLACES = 64
NUMBERS = np.random.default_rng(20).integers(0, 2**64, PLACES * 256, np.uint64)
#: Bytes that are hashed at a time; a longer word is taken whole.
STEP = 1 << 18


def _parts(texts: list[bytes]) -> Iterator[tuple[list[bytes], list[int]]]:
    """(pieces, the text of each): whole texts together, large texts cut before white space, about STEP bytes at a time."""
    pieces: list[bytes] = []
    whose: list[int] = []
    size = 0
    for k, text in enumerate(texts):
        at = 0
        while True:
            end = at + STEP
            while end < len(text) and not SPACE[text[end]]:
                end += 1
            pieces.append(text[at:end])
            whose.append(k)
            size += len(pieces[-1])
            if size > STEP:
                yield pieces, whose
                pieces, whose, size = [], [], 0
            at = end
            if at >= len(text):
                break
    if pieces:
        yield pieces, whose


def _hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, begin) of each word of a part."""
    raw = np.frombuffer(data, np.uint8)
    inside = ~SPACE[raw]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    begin = np.flatnonzero(inside & ~before)
    if not len(begin):
        return np.zeros(0, np.uint64), begin
    end = np.flatnonzero(before & ~inside)
    size = end - begin
    first = np.cumsum(size) - size
    letters = raw[inside].astype(np.int32)
    place = np.arange(len(letters), dtype=np.int32) - np.repeat(first.astype(np.int32), size)
    values = NUMBERS[(place % PLACES << 8) + letters]
    if size.max() > PLACES:
        powers = np.full(int(size.max()) // PLACES + 1, M1)
        powers[0] = 1
        values *= np.cumprod(powers)[place // PLACES]
    x = np.add.reduceat(values, first) + size.astype(np.uint64) * M1
    x = (x ^ (x >> np.uint64(30))) * M2
    return x ^ (x >> np.uint64(29)), begin


def word_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, and how many each text has.

    Words stand between ASCII white space; A-Z count as a-z. Different words share a
    hash with a chance of 2**-64. Memory is that of the hashes and of a part of the texts."""
    found, counts = [np.zeros(0, np.uint64)], np.zeros(len(texts), np.int64)
    for pieces, whose in _parts([t or b"" for t in texts]):
        h, begin = _hashes(b" ".join(pieces).lower() + b" ")
        found.append(h)
        ends = np.cumsum([len(p) + 1 for p in pieces])
        np.add.at(counts, whose, np.diff(np.searchsorted(begin, ends), prepend=0))
    return np.concatenate(found), counts


#: Characters of the longest word that a cache keeps, and bytes that it allows for each of ``bound`` entries.
LONGEST, ENTRY = 256, 200


class WordCache(dict):
    """``cache[word]`` computes a missing value. Holds at most ``bound`` words, and as many bytes as that many usual words
    take, keys and values counted, in two generations.

    When the young generation is full it becomes the old one, and the old one is
    forgotten; a word that is asked for again moves to the young one. So frequent
    words stay. A word of over ``LONGEST`` characters, as in scripts without spaces, is
    computed each time it comes and not kept.
    """

    def __init__(self, make: Callable, bound: int) -> None:
        super().__init__()
        self.make, self.half, self.old = make, max(1, bound // 2), {}
        self.room, self.size = max(1, bound * ENTRY // 2), 0

    def __missing__(self, word):
        if len(word) > LONGEST:
            return self.make(word)
        value = self.old.get(word)
        if value is None:
            value = self.make(word)
        self.put(word, value)
        return value

    def _turn(self) -> None:
        if len(self) >= self.half or self.size >= self.room:
            self.old = dict(self)
            self.clear()
            self.size = 0

    def put(self, word, value) -> None:
        self._turn()
        self[word] = value
        self.size += getsizeof(word) + getsizeof(value) + 100  # and a place in the table

    def put_all(self, values: dict) -> None:
        """Many at once, of one batch of texts: the bounds may be passed by these."""
        self._turn()
        self.update(values)
        self.size += sum(map(getsizeof, values)) + sum(map(getsizeof, values.values())) + 100 * len(values)

    def missing(self, words: set) -> set:
        """Those of ``words`` that could be kept and that neither generation holds."""
        return {w for w in words.difference(self).difference(self.old) if len(w) <= LONGEST}
