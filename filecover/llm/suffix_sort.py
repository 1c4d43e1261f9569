"""Suffix sorting by a difference cover modulo 3, on arrays.

The suffixes at places that are 1 or 2 modulo 3 are sorted by their first three symbols; the triples'
ranks become the symbols of a string of two thirds the length, which is sorted in the same way if names
repeat. The suffixes at multiples of 3 are sorted by symbol and the rank that follows, and
merged in: against a place that is 1 modulo 3 one symbol and a rank decide, against 2 modulo 3 two symbols
and a rank.
"""

from __future__ import annotations

import numpy as np


def _ranked(*columns: np.ndarray) -> np.ndarray:
    """Dense ranks from 1 of rows compared column by column. Columns are not negative."""
    key = columns[0].astype(np.int64)
    for column in columns[1:]:
        top, width = int(key.max(initial=0)) + 1, int(column.max(initial=0)) + 1
        if top * width >= 1 << 62:
            key = np.unique(key, return_inverse=True)[1]
        key = key * width + column
    return np.unique(key, return_inverse=True)[1].astype(np.int64) + 1


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in order. Symbols are integers from 1."""
    n = len(symbols)
    if n < 6:
        rows = symbols.tolist()
        return np.array(sorted(range(n), key=lambda i: rows[i:]), np.int64)
    s = np.concatenate([symbols.astype(np.int64), np.zeros(5, np.int64)])
    end = n + (n % 3 == 1)  # one place more, so that the last place 0 modulo 3 has a sample after it
    ones, twos = np.arange(1, end, 3), np.arange(2, end, 3)
    sample = np.concatenate([ones, twos])
    names = _ranked(s[sample], s[sample + 1], s[sample + 2])
    if int(names.max()) == len(names):
        order = np.argsort(names)
    else:
        order = suffix_array(names)
    rank = np.zeros(n + 6, np.int64)
    by_rank = sample[order]
    rank[by_rank] = np.arange(1, len(order) + 1)
    by_rank = by_rank[by_rank < n]
    wide = len(order) + 2

    zeros = np.arange(0, n, 3)
    zeros = zeros[np.argsort(s[zeros] * wide + rank[zeros + 1])]
    first, second = by_rank[by_rank % 3 == 1], by_rank[by_rank % 3 == 2]
    below = np.searchsorted(s[first] * wide + rank[first + 1], s[zeros] * wide + rank[zeros + 1])
    both = np.concatenate([second, zeros])
    pair = _ranked(s[both], s[both + 1])
    key = pair * wide + rank[both + 2]
    below += np.searchsorted(key[: len(second)], key[len(second) :])

    result = np.empty(n, np.int64)
    place = below + np.arange(len(zeros))
    rest = np.ones(n, bool)
    rest[place] = False
    result[place] = zeros
    result[rest] = by_rank
    return result


def equal_prefixes(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """For starts in suffix order: does each share its first `length` bytes with the one before? (the first: no)"""
    same = np.zeros(len(starts), bool)
    if len(starts) < 2:
        return same
    words = np.ndarray((len(data) - 7,), np.dtype("<u8"), data.tobytes(), strides=(1,)) if len(data) >= 8 else None
    alive = np.arange(1, len(starts))
    step = 8 if words is not None and length >= 8 else 1
    source = words if step == 8 else data
    for offset in [*range(0, length - step + 1, step), length - step]:
        alive = alive[source[starts[alive] + offset] == source[starts[alive - 1] + offset]]
    same[alive] = True
    return same
