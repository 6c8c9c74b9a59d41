"""Blocks of scored pairs inside Arrow batches: bounded top-k heaps and vector matrices.

Workers call these on whole batches with numpy; Spark deals the batches. ``TopK``
keeps, for many keys at once, every pair that can still be among the key's ``k``
best under the run order (score rounded to 6 decimals descending, id ascending).
"""

from __future__ import annotations

import numpy as np

MARGIN = 2e-6  # two engines may round a score to neighbouring values at 6 decimals


def vectors(column):
    """``(matrix, present)`` of an Arrow list column; a missing or empty vector is a row of zeros."""
    import pyarrow.compute as pc

    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    present = size > 0
    dim = int(size.max()) if len(size) else 0
    if (size[present] != dim).any():
        raise ValueError("vectors of one column must have one length")
    out = np.zeros((len(size), dim))
    if dim:
        out[present] = pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return out, present


def unit_rows(m):
    """Rows divided by their norms; a row of zeros stays."""
    n = np.sqrt((m * m).sum(axis=1))
    n[n == 0] = 1.0
    return m / n[:, None]


class TopK:
    """The best pairs of each key (a number below ``n_keys``); ``k`` None keeps all."""

    def __init__(self, k, n_keys):
        self.k, self.floor = k, np.full(n_keys, -np.inf)
        self.parts, self.rows, self.limit = [], 0, 1 << 18

    def add(self, key, ids, score, *values):
        """Pairs with an id and further value columns each; a score that is not a number ranks last."""
        if self.k is not None:
            rounded = np.where(np.isnan(score), -np.inf, np.round(score, 6))
            keep = rounded >= self.floor[key]
            key, ids, score, values = key[keep], ids[keep], score[keep], [v[keep] for v in values]
        if len(key):
            self.parts.append((key, ids, score, *values))
            self.rows += len(key)
            if self.k is not None and self.rows > self.limit:
                self.cut()
                self.limit = max(1 << 18, 2 * self.rows)

    def cut(self):
        if not self.parts:
            return
        columns = [np.concatenate(c) for c in zip(*self.parts)]
        key, ids, score = columns[:3]
        if self.k is not None:
            rounded = np.where(np.isnan(score), -np.inf, np.round(score, 6))
            place = ids if ids.dtype.kind in "iu" else np.unique(ids, return_inverse=True)[1]
            order = np.lexsort((place, -rounded, key))
            key, rounded = key[order], rounded[order]
            at = np.arange(len(key))
            new = np.concatenate([[True], key[1:] != key[:-1]])
            level = new | np.concatenate([[True], rounded[1:] != rounded[:-1]])
            first = np.maximum.accumulate(np.where(new, at, 0))
            nth, nth_of_level = at - first, at - np.maximum.accumulate(np.where(level, at, 0))
            full = nth == self.k - 1
            self.floor[key[full]] = rounded[full] - MARGIN
            keep = order[(nth < self.k) | ((rounded >= self.floor[key]) & (nth_of_level < self.k))]
            columns = [c[keep] for c in columns]
        self.parts, self.rows = [tuple(columns)], len(columns[0])

    def take(self):
        """All columns of what is left (key, ids, score, values...), or None."""
        self.cut()
        return self.parts[0] if self.parts else None


def pair_products(left, right, rows, columns, limit=1 << 22):
    """``left[rows] . right[columns]`` of many pairs: whole matrix products where pairs are dense, single products where they are few.

    ``rows`` ascend. Never more than about ``limit`` numbers are made at once.
    """
    out = np.empty(len(rows))
    step = max(1, limit // max(1, len(right)))
    if len(rows) * 32 >= len(left) * len(right):
        for a in range(0, len(left), step):
            lo, hi = np.searchsorted(rows, [a, a + step])
            if hi > lo:
                out[lo:hi] = (left[a:a + step] @ right.T)[rows[lo:hi] - a, columns[lo:hi]]
        return out
    step = max(1, limit // max(1, left.shape[1]))
    for a in range(0, len(rows), step):
        out[a:a + step] = np.einsum("ij,ij->i", left[rows[a:a + step]], right[columns[a:a + step]])
    return out
