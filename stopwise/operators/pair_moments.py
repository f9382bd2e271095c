"""Moments of column pairs over one task's rows, on Arrow batches with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

MOMENTS = (
    "i int, j int, n double, mean_x double, mean_y double, m2_x double, m2_y double,"
    " c_xy double, lo_x double, hi_x double, lo_y double, hi_y double"
)

# A variance below this share of the shifted squares has lost too many digits.
_LOST = 1e-6


def _ends(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return low.min(axis=0), high.max(axis=0)


class PairMoments:
    """Moments of every column pair over the rows where both are present.

    ``mean[a, b]``, ``m2[a, b]``, ``lo`` and ``hi`` describe column a over the
    rows shared with b. Blocks are centred before they are squared and merged
    by their means, so large offsets do not cancel; the exact minimum and
    maximum tell a constant column from one with a tiny variance.
    """

    def __init__(self, width: int):
        shape = (width, width)
        self.n, self.mean, self.m2, self.c = (np.zeros(shape) for _ in range(4))
        self.lo, self.hi = np.full(shape, np.inf), np.full(shape, -np.inf)

    def add(self, x: np.ndarray) -> None:
        """Add rows by products of the values with the mask of those present.

        The cost does not depend on how the gaps are spread. Columns are shifted
        to their means first; where a pair's variance is still lost in that of
        its sums, its rows are looked at by themselves. An infinite value counts
        as zero in the products and makes its pairs' moments undefined.
        """
        present = ~np.isnan(x)
        finite = np.isfinite(x)
        known = np.where(finite, x, 0.0)
        shift = known.sum(axis=0) / np.maximum(1, finite.sum(axis=0))
        values = np.where(finite, x - shift, 0.0)
        mask = present.astype("float64")
        n = mask.T @ mask
        some = np.maximum(n, 1.0)
        sums = values.T @ mask
        squares = (values * values).T @ mask
        m2 = squares - sums * sums / some
        c = values.T @ values - sums * sums.T / some
        mean = shift[:, None] + sums / some
        lo, hi = self._extremes(x, present)
        lost = (n > 0) & (m2 <= _LOST * squares) & (lo < hi) & np.isfinite(lo) & np.isfinite(hi)
        for a, b in np.argwhere(lost | lost.T):
            rows = present[:, a] & present[:, b]
            own, other = x[rows, a], x[rows, b]
            mean[a, b] = own.mean()
            m2[a, b] = ((own - mean[a, b]) ** 2).sum()
            c[a, b] = ((own - mean[a, b]) * (other - other.mean())).sum()
        m2[(n > 0) & (lo == hi)] = 0.0
        endless = (np.isinf(x).astype("float64").T @ mask) > 0
        m2[endless] = mean[endless] = np.nan
        c[endless | endless.T] = np.nan
        self._merge(n, mean, m2, c, lo, hi)

    @staticmethod
    def _extremes(x: np.ndarray, present: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest value of each column over the rows each other one has."""
        width = x.shape[1]
        lo, hi = np.full((width, width), np.inf), np.full((width, width), -np.inf)
        if len(x) and present.all():
            lo[:], hi[:] = x.min(axis=0)[:, None], x.max(axis=0)[:, None]
            return lo, hi
        low, high = np.where(present, x, np.inf), np.where(present, x, -np.inf)
        found = {}  # most columns have a value in the same rows
        for b in range(width):
            rows = present[:, b]
            same = rows.tobytes()
            if same not in found:
                found[same] = _ends(low[rows], high[rows]) if rows.any() else (np.inf, -np.inf)
            lo[:, b], hi[:, b] = found[same]
        return lo, hi

    def _merge(self, n, mean, m2, c, lo, hi) -> None:
        total = self.n + n
        some = np.maximum(total, 1.0)
        gap = np.where((self.n > 0) & (n > 0), mean - self.mean, 0.0)
        weight = self.n * n / some
        self.m2 += np.where(n > 0, m2, 0.0) + gap * gap * weight
        self.c += np.where(n > 0, c, 0.0) + gap * gap.T * weight
        self.mean = np.where(self.n > 0, self.mean + gap * n / some, np.where(n > 0, mean, 0.0))
        self.lo, self.hi = np.minimum(self.lo, lo), np.maximum(self.hi, hi)
        self.n = total

    def rows(self) -> pa.RecordBatch:
        i, j = np.triu_indices(self.n.shape[0], 1)
        x, y = (i, j), (j, i)
        values = {
            "i": i.astype("int32"),
            "j": j.astype("int32"),
            "n": self.n[x],
            "mean_x": self.mean[x],
            "mean_y": self.mean[y],
            "m2_x": self.m2[x],
            "m2_y": self.m2[y],
            "c_xy": self.c[x],
            "lo_x": self.lo[x],
            "hi_x": self.hi[x],
            "lo_y": self.lo[y],
            "hi_y": self.hi[y],
        }
        return pa.RecordBatch.from_pydict(values)


def task_moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    moments = None
    for batch in batches:
        if moments is None:
            moments = PairMoments(batch.num_columns)
        if batch.num_rows:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            moments.add(np.column_stack(columns).astype("float64", copy=False))
    if moments is not None:
        yield moments.rows()
