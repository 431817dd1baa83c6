"""Sums of columns by keys over the Arrow batches of one task."""

from __future__ import annotations

import numpy as np

#: Groups that a task holds before it passes them on.
MAX_GROUPS = 200_000


def columns(batch, names) -> np.ndarray:
    """Columns of an Arrow batch as the rows of one float matrix (null: NaN)."""
    out = np.empty((len(names), batch.num_rows))
    for i, name in enumerate(names):
        out[i] = batch.column(name).to_numpy(zero_copy_only=False)
    return out


def sum_by(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct columns of ``keys`` (k x n, sorted; NaN equals NaN) and the sums of ``values`` (m x n) over each."""
    order = np.lexsort(keys[::-1])
    keys = keys[:, order]
    same = (keys[:, 1:] == keys[:, :-1]) | (np.isnan(keys[:, 1:]) & np.isnan(keys[:, :-1]))
    at = np.flatnonzero(np.concatenate([[True], ~same.all(axis=0)]))
    return keys[:, at], np.add.reduceat(values[:, order], at, axis=1)


class KeyedSums:
    """Adds up batches.  ``add`` gives back (keys, sums) once more than ``MAX_GROUPS`` groups are held, ``rest`` what
    is left; the same keys can come back more than once.  ``raw``: what is added holds each key once."""

    def __init__(self, max_groups: int = MAX_GROUPS, raw: bool = False):
        self.max_groups, self.raw, self.held, self.rows = max_groups, raw, [], 0

    def add(self, keys: np.ndarray, values: np.ndarray, last: bool = False):
        if keys.shape[1]:
            self.held.append((keys, values) if self.raw else sum_by(keys, values))
            self.rows += self.held[-1][0].shape[1]
        if last or self.rows <= self.max_groups:
            return None
        got = self.rest()
        if got[0].shape[1] > self.max_groups // 2:
            return got
        self.held, self.rows = [got], got[0].shape[1]
        return None

    def rest(self):
        got = sum_by(*(np.concatenate(part, axis=1) for part in zip(*self.held, strict=True))) if self.held else None
        self.held, self.rows = [], 0
        return got
