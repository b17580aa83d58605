"""Suffix arrays by induced sorting, and permuted common prefixes, over numpy arrays."""

from __future__ import annotations

import numpy as np


def _types(t: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than the next one (S); the last one, the end mark, counts as such."""
    n = len(t)
    differs = np.append(t[:-1] != t[1:], True)
    at = np.where(differs, np.arange(n), n - 1)
    at = np.minimum.accumulate(at[::-1])[::-1]
    less = np.append(t[:-1] < t[1:], True)
    return less[at]


def _batches(least: list[int]) -> list[tuple[int, int]]:
    """Ranges of symbols that are worked through at once: no suffix in one is induced from another in it, but where it is one symbol."""
    out, a, sigma = [], 0, len(least)
    while a < sigma:
        b, limit = a + 1, least[a]
        if limit > a:
            while b < limit and b < sigma and least[b] > b:
                limit = min(limit, least[b])
                b += 1
        out.append((a, b))
        a = b
    return out


def _induce(t: np.ndarray, wanted: np.ndarray, seeds: np.ndarray, sigma: int) -> np.ndarray:
    """The ``wanted`` suffixes in order, each induced from the one behind it, which begins with no larger symbol.

    ``seeds``, in order, are the suffixes behind wanted ones that aren't wanted
    themselves.  The scan goes up the symbols, and in each from the wanted
    suffixes, first to last, to the seeds.  Instead of one suffix at a time it
    takes a range of symbols whose suffixes are all placed; only in a run of one
    symbol the suffixes just placed are taken up again.
    """
    mine = np.flatnonzero(wanted)
    symbols = t[mine]
    start = np.zeros(sigma + 1, np.int32)
    np.cumsum(np.bincount(symbols, minlength=sigma), out=start[1:])
    head = start[:-1].copy()
    out = np.empty(len(mine), np.int32)
    least = np.full(sigma, sigma, t.dtype if sigma <= np.iinfo(t.dtype).max else np.int32)
    np.minimum.at(least, t[mine + 1], symbols)
    low, starts = least.tolist(), start.tolist()
    seed_starts = np.searchsorted(t[seeds], np.arange(sigma + 1)).tolist()
    count_up = np.arange(len(mine) + 1, dtype=np.int32)

    def place(sources: np.ndarray) -> None:
        j = sources - 1
        j = j[wanted[j] & (sources > 0)]
        if not len(j):
            return
        c = t[j]
        order = c.argsort(kind="stable")
        j, c = j[order], c[order]
        edge = (c[1:] != c[:-1]).nonzero()[0]
        if not len(edge):
            at = int(head[c[0]])
            out[at : at + len(j)] = j
            head[c[0]] += len(j)
            return
        bound = np.empty(len(edge) + 2, np.int32)
        bound[0], bound[1:-1], bound[-1] = 0, edge + 1, len(j)
        first, size = bound[:-1], bound[1:] - bound[:-1]
        own = c[first]
        begin = head[own]
        out[(begin - first).repeat(size) + count_up[: len(j)]] = j
        head[own] = begin + size

    for a, b in _batches(low):
        if low[a] == a:
            done = starts[a]
            while done < head[a]:
                block = out[done : head[a]]
                done = int(head[a])
                place(block)
            place(seeds[seed_starts[a] : seed_starts[b]])
        elif starts[a] < starts[b] or seed_starts[a] < seed_starts[b]:
            sources = np.concatenate((out[starts[a] : starts[b]], seeds[seed_starts[a] : seed_starts[b]]))
            if b > a + 1:
                sources = sources[np.argsort(t[sources], kind="stable")]
            place(sources)
    return out


def _induced(t: np.ndarray, mirrored: np.ndarray, smaller: np.ndarray, marks: np.ndarray, sigma: int) -> tuple[np.ndarray, np.ndarray]:
    """Larger (L) and smaller (S) suffixes in order, without the end mark, from the leftmost smaller ones in order."""
    n = len(t)
    larger = _induce(t, ~smaller, marks, sigma)
    wanted = smaller.copy()
    wanted[n - 1] = False
    behind = larger[(larger > 0) & smaller[larger - 1]]
    return larger, _induce(mirrored, wanted, behind[::-1], sigma)[::-1]


def _names(t: np.ndarray, order: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, int]:
    """A number for each of the substrings (from ``order``, of ``size`` symbols, in order): equal ones share it."""
    a, b = order[:-1], order[1:]
    same = size[:-1] == size[1:]
    live = np.flatnonzero(same)
    step = 0
    while len(live):
        equal = t[a[live] + step] == t[b[live] + step]
        same[live[~equal]] = False
        live = live[equal]
        step += 1
        live = live[size[live] > step]
    names = np.concatenate(([0], np.cumsum(~same)))
    return names, int(names[-1]) + 1


def suffix_array(t: np.ndarray, sigma: int) -> np.ndarray:
    """The suffixes of ``t`` (symbols below ``sigma``; the last is 0 and stands nowhere else) in order.

    Suffixes are classified as larger or smaller than the next one.  The
    substrings between leftmost smaller ones are sorted by inducing, and named;
    if a name repeats, the string of names is sorted the same way.  From the
    order of the leftmost smaller suffixes all others are induced.
    """
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int32)
    smaller = _types(t)
    marks = (np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1).astype(np.int32)
    mirrored = (sigma - 1 - t).astype(t.dtype)
    # The substrings: marks in order of their first symbols alone, then all that follows from these.
    first = marks[np.argsort(t[marks], kind="stable")]
    if len(marks) > 1:
        is_mark = np.zeros(n, bool)
        is_mark[marks] = True
        _, s = _induced(t, mirrored, smaller, first, sigma)
        order = np.concatenate((marks[-1:], s[is_mark[s]]))
        number = np.empty(n, np.int32)
        number[marks] = np.arange(len(marks))
        size = np.append(np.diff(marks) + 1, 1)[number[order]]
        names, count = _names(t, order, size)
        if count < len(marks):
            reduced = np.empty(len(marks), np.int32)
            reduced[number[order]] = names
            order = marks[suffix_array(reduced, count)]
        first = order
    larger, smallest = _induced(t, mirrored, smaller, first, sigma)
    both = np.concatenate((larger, smallest))
    return np.concatenate((marks[-1:], both[np.argsort(t[both], kind="stable")]))


def common_prefixes(t: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each of the suffixes ``order`` (sorted), how many symbols it shares with the one before it; 0 for the first.

    Prefixes are permuted into the order of the text: where a suffix and the one
    before it both stand one further than a pair did, they share one symbol
    less.  Only the others are compared, four symbols at a time.
    """
    n, sentinel = len(t), -2
    before = np.full(n, sentinel, np.int64)
    before[order[1:]] = order[:-1]
    p = np.flatnonzero(before >= 0)
    q = before[p]
    last, last_q = np.maximum(p - 1, 0), before[np.maximum(p - 1, 0)]
    follows = (p > 0) & (last_q >= 0) & (last_q == q - 1) & (t[last] == t[np.maximum(last_q, 0)])
    shared = np.zeros(len(p), np.int64)
    padded = np.concatenate((t.astype(np.uint16), np.zeros(8, np.uint16)))
    four = np.ndarray((n + 4,), "<u8", padded, strides=(2,))
    live = np.flatnonzero(~follows)
    at = np.zeros(len(live), np.int64)
    while len(live):
        equal = four[p[live] + at] == four[q[live] + at]
        shared[live[~equal]] = at[~equal]
        live, at = live[equal], at[equal] + 4
    live = np.flatnonzero(~follows)
    for _ in range(3):
        equal = padded[p[live] + shared[live]] == padded[q[live] + shared[live]]
        live = live[equal]
        shared[live] += 1
    # The rest, by how far they stand behind the pair that was compared.
    head = np.maximum.accumulate(np.where(follows, 0, np.arange(len(p))))
    shared = shared[head] - (np.arange(len(p)) - head)
    out = np.zeros(n, np.int64)
    out[p] = shared
    return out[order]
