"""Connected parts of a mask, found over its runs of set pixels in time linear in its size."""

from __future__ import annotations

import numpy as np


def runs_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end (exclusive) of every run of set pixels, in row order."""
    edge = np.zeros((mask.shape[0], mask.shape[1] + 2), np.int8)
    edge[:, 1:-1] = mask
    change = np.diff(edge, axis=1)
    rows, starts = np.nonzero(change == 1)
    return rows, starts, np.nonzero(change == -1)[1]


def joined_runs(rows: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The first run of the 8-connected part that each run belongs to, by union-find over runs that touch in neighbouring rows."""
    parent, rows, starts, ends = list(range(len(rows))), rows.tolist(), starts.tolist(), ends.tolist()

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    above = 0  # the first run of the row above that can still touch
    for i, row in enumerate(rows):
        while above < i and (rows[above] < row - 1 or rows[above] == row - 1 and ends[above] < starts[i]):
            above += 1
        j = above
        while j < i and rows[j] == row - 1 and starts[j] <= ends[i]:
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
            j += 1
    return np.array([root(i) for i in range(len(parent))], np.int64)


def largest_part(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ys and xs of the pixels of the largest 8-connected part; of equal ones, that with the first pixel in row order."""
    rows, starts, ends = runs_of(mask)
    if not len(rows):
        return rows, starts
    part = joined_runs(rows, starts, ends)
    own = part == np.bincount(part, ends - starts).argmax()
    rows, starts, sizes = rows[own], starts[own], (ends - starts)[own]
    return np.repeat(rows, sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes - starts, sizes)
