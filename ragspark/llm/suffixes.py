"""Suffix arrays of integer sequences cut into segments, by prefix doubling of unresolved suffixes."""

from __future__ import annotations

import numpy as np


def suffix_array(key: np.ndarray, limit: np.ndarray, levels: list | None = None) -> np.ndarray:
    """Positions ordered by the symbols from there to the end of their segment.

    ``key`` holds the symbols (any ordered type), ``limit[i]`` the end of the segment of position i.
    A suffix that is a prefix of another comes first; equal suffixes of different segments come in
    order of position.  Ranks after 1, 2, 4, ... symbols are appended to ``levels``: at 2^j, two
    positions share a rank exactly if the next 2^j symbols are equal and within their segments.
    """
    n = len(key)
    sa = np.argsort(key)
    if not n:
        return sa
    rows, width = np.arange(n), 1
    rank = np.empty(n, np.int64)
    ordered = key[sa]
    while True:
        first = np.concatenate(([True], ordered[1:] != ordered[:-1]))
        start = np.flatnonzero(first)
        group = np.cumsum(first) - 1
        rank[sa[rows]] = rows[start][group]
        if levels is not None:
            levels.append(rank.astype(np.int32))
        rows = rows[np.diff(np.append(start, len(rows)))[group] > 1]
        if not len(rows):
            return sa
        at = sa[rows]
        after = at + width
        follow = np.where(after < limit[at], n + rank[np.minimum(after, n - 1)], at)
        pair = (rank[at] << 32) | follow
        order = np.argsort(pair)
        sa[rows] = at[order]
        ordered = pair[order]
        width *= 2


def common_prefix(i: np.ndarray, j: np.ndarray, levels: list[np.ndarray], limit: np.ndarray) -> np.ndarray:
    """Length of the longest common prefix of the suffixes at i and j (pairs of different positions)."""
    i, j = i.copy(), j.copy()
    length = np.zeros(len(i), np.int64)
    ends_i, ends_j = limit[i], limit[j]
    n = len(limit) - 1
    for depth in range(len(levels) - 1, -1, -1):
        rank = levels[depth]
        same = (i < ends_i) & (j < ends_j) & (rank[np.minimum(i, n)] == rank[np.minimum(j, n)])
        step = same.astype(np.int64) << depth
        length += step
        i += step
        j += step
    return length
