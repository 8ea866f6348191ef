"""Words of many texts at once as arrays: code points, word spans and hashes of word parts."""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np

#: Characters that are worked on at once.
PIECE = 1 << 20
MULT = np.uint64(0x9E3779B97F4A7C15)


@functools.cache
def lower_letters() -> np.ndarray:
    """For each code point its lower-case form if that is one letter, the code point if it is a letter, else 32."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


@functools.cache
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """MULT ** i and its inverse for i below n, modulo 2 ** 64."""
    inverse = np.uint64(pow(int(MULT), -1, 1 << 64))
    one = np.ones(1, np.uint64)
    return np.concatenate([one, np.cumprod(np.full(n - 1, MULT, np.uint64))]), np.concatenate([one, np.cumprod(np.full(n - 1, inverse, np.uint64))])


@dataclass
class Words:
    """codes: lower-case letters, 32 for anything else. A word is codes[start:stop]; doc i has words first[i]:first[i + 1]."""

    codes: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    first: np.ndarray
    base: np.ndarray  # where each text begins in codes

    @functools.cached_property
    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        """Running sums of codes times powers, and the inverse powers that move a difference of them to place 0."""
        up, down = powers(1 << max(21, int(len(self.codes)).bit_length()))
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.codes.astype(np.uint64) * up[1 : len(self.codes) + 1])]), down

    def hashes(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """A 64-bit hash of codes[lo:hi] for each pair; equal strings have equal hashes wherever they stand."""
        sums, down = self.sums
        h = (sums[hi] - sums[lo]) * down[lo]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(29))


def words_of(texts: list[str]) -> Words:
    """Each text ends with a gap, so no word runs from one text into the next."""
    lens = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    raw = np.frombuffer(" ".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = lower_letters()[raw]
    letter = np.concatenate([[False], codes != 32, [False]])
    edge = np.flatnonzero(letter[1:] != letter[:-1])
    start, stop = edge[::2], edge[1::2]
    base = np.concatenate([[0], np.cumsum(lens)])
    return Words(codes, start, stop, np.searchsorted(start, base), base[:-1])


def in_pieces(texts: Iterable[str | None], piece: int = PIECE) -> Iterator[list[str]]:
    """The texts in order, in lists of about piece characters (a longer text is a list of its own); null is empty."""
    held, size = [], 0
    for t in texts:
        t = t or ""
        if held and size + len(t) > piece:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held
