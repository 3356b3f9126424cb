"""Linear systems with five diagonals, open or closed to a ring: one factorisation, then a sweep down and up for each right side."""

from __future__ import annotations

import numpy as np

#: Unknowns up to which the inverse is written out.
DENSE = 64


class FiveDiagonals:
    """The system of the diagonals -2..2 (`bands[k][i]` is the entry of row i at column i + k - 2).

    `closed`: columns beyond an end go on at the other one; the last two unknowns then form a border of the banded rest.
    """

    def __init__(self, bands: np.ndarray, closed: bool):
        self.n, self.inverse, self.closed = bands.shape[1], None, closed
        n = self.n
        if n <= DENSE:
            full = np.zeros((n, n))
            for k in range(5):
                for i in range(n):
                    if closed or 0 <= i + k - 2 < n:
                        full[i, (i + k - 2) % n] += bands[k][i]
            self.inverse = np.linalg.inv(full)
            return
        inner = n - 2 if closed else n
        self._factorise(bands[:, :inner])
        if closed:
            side, foot, corner = np.zeros((inner, 2)), np.zeros((2, inner)), np.zeros((2, 2))
            for i in [0, 1, inner - 2, inner - 1]:
                for k in range(5):
                    j = (i + k - 2) % n
                    if j >= inner:
                        side[i, j - inner] += bands[k][i]
            for i in (inner, inner + 1):
                for k in range(5):
                    j = (i + k - 2) % n
                    if j >= inner:
                        corner[i - inner, j - inner] += bands[k][i]
                    else:
                        foot[i - inner, j] += bands[k][i]
            self.foot = foot
            self.side = np.column_stack([self._sweep(side[:, c]) for c in (0, 1)])
            self.corner = np.linalg.inv(corner - foot @ self.side)

    def _factorise(self, bands: np.ndarray) -> None:
        low2, low1, middle, up1, up2 = (b.tolist() for b in bands)
        n = len(middle)
        self.low2, self.low1, self.pivot, self.up1, self.up2 = low2, [0.0] * n, [0.0] * n, [0.0] * n, [0.0] * n
        for i in range(n):
            low = low1[i] - (self.up1[i - 2] * low2[i] if i > 1 else 0.0)
            pivot = middle[i] - (self.up2[i - 2] * low2[i] if i > 1 else 0.0)
            above = up1[i]
            if i:
                pivot -= self.up1[i - 1] * low
                above -= self.up2[i - 1] * low
            self.low1[i], self.pivot[i] = low, pivot
            self.up1[i], self.up2[i] = (above / pivot if i + 1 < n else 0.0), (up2[i] / pivot if i + 2 < n else 0.0)

    def _sweep(self, right: np.ndarray) -> np.ndarray:
        out = right.tolist()
        one = two = 0.0
        for i, value in enumerate(out):
            here = (value - (self.low1[i] * one if i else 0.0) - (self.low2[i] * two if i > 1 else 0.0)) / self.pivot[i]
            out[i], one, two = here, here, one
        one = two = 0.0
        for i in range(len(out) - 1, -1, -1):
            here = out[i] - self.up1[i] * one - self.up2[i] * two
            out[i], one, two = here, here, one
        return np.array(out)

    def solve(self, right: np.ndarray) -> np.ndarray:
        if self.inverse is not None:
            return self.inverse @ right
        if not self.closed:
            return self._sweep(right)
        inner = self._sweep(right[:-2])
        ends = self.corner @ (right[-2:] - self.foot @ inner)
        return np.concatenate([inner - self.side @ ends, ends])
