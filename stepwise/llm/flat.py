"""Many texts as one array of characters, words and hashed features: what the classifiers read."""

from __future__ import annotations

import functools
from typing import NamedTuple

import numpy as np

_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_ODD = 0x100000001B3
_INVERSE = pow(_ODD, -1, 1 << 64)


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


class Words(NamedTuple):
    codes: np.ndarray
    letter: np.ndarray
    start: np.ndarray
    end: np.ndarray
    #: The text that each word stands in.
    doc: np.ndarray
    #: Running sums of a rolling hash.
    sums: np.ndarray


def words(texts: list[str]) -> Words:
    """The runs of letters of lower-cased texts, in order."""
    lower = [t.lower() for t in texts]
    codes = np.frombuffer("\n".join(lower).encode("utf-32-le", "replace"), np.uint32)
    letter = _letters()[codes]
    edge = np.diff(letter.astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    first = np.cumsum([0, *[len(t) + 1 for t in lower]])
    return Words(codes, letter, start, end, np.searchsorted(first, start, side="right") - 1, hashed(codes))


def mix(h: np.ndarray, bits: int) -> np.ndarray:
    """The top ``bits`` bits of multiplied hashes."""
    h = (h ^ (h >> np.uint64(31))) * _FACTOR
    h = (h ^ (h >> np.uint64(29))) * _FACTOR
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def hashed(codes: np.ndarray) -> np.ndarray:
    """Running sums of a rolling hash of characters, for ``between``."""
    up, _ = _powers(1 << max(16, len(codes).bit_length()))
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[: len(codes)])))


def between(sums: np.ndarray, start: np.ndarray, end: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit hash of the characters from each start to each end."""
    _, down = _powers(1 << max(16, (len(sums) - 1).bit_length()))
    return (sums[end] - sums[start]) * down[start] * np.uint64(2 * salt + 1) + np.uint64(salt)


def span_hash(w: Words, start: np.ndarray, end: np.ndarray, salt: int) -> np.ndarray:
    return between(w.sums, start, end, salt)


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _ODD, np.uint64), np.full(n, _INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)
