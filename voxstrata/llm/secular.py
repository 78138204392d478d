"""Eigendecompositions of symmetric matrices kept up under rank-one updates, by the secular equation.

For Q diag(d) Q' + z z' with w = Q' z, the new eigenvalues are the roots of 1 + sum_i w_i**2 / (d_i - x), one between each
two neighbouring d. Components that don't matter are deflated first: those whose w is negligible keep their pair, and among
equal d rotations gather all of w in one. Roots are found as distances from the nearer pole, all at once, by rational
interpolation inside a bracket; w is then recomputed from the roots, which makes the new eigenvectors orthogonal to
working precision however close the roots are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: What is negligible, relative to the largest eigenvalue; steps of the root finder at most.
NEGLIGIBLE, STEPS = 1e-15, 60
#: The size, relative to its terms, below which the secular function is zero but for rounding.
ROUNDED = 2e-15


def roots(d: np.ndarray, w2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ascending, distinct d and positive w2: the pole next to each root of 1 + sum w2 / (d - x), and the root's distance from it."""
    n = len(d)
    ends = np.append(d, d[-1] + w2.sum() * (1 + 1e-15) + np.finfo(float).tiny)
    middle = (ends[:-1] + ends[1:]) / 2
    at_middle = 1 + (w2 / (d - middle[:, None])).sum(1)
    pole = np.where(at_middle >= 0, np.arange(n), np.arange(n) + 1)
    pole[-1] = n - 1
    shifted = d - d[pole][:, None]  # distances of all poles from each root's own
    low, high = ends[:-1] - d[pole], ends[1:] - d[pole]
    half = (low + high) / 2
    low, high = np.where(at_middle >= 0, low, half), np.where(at_middle >= 0, half, high)
    t = (low + high) / 2
    left = np.arange(n) <= np.arange(n)[:, None]
    right = np.append(np.diag(shifted, 1), ends[-1] - d[-1])  # the pole above each root
    with np.errstate(all="ignore"):
        for _ in range(STEPS):
            gap = shifted - t[:, None]
            part = w2 / gap
            f = 1 + part.sum(1)
            slope = part / gap
            psi, phi = (slope * left).sum(1), (slope * ~left).sum(1)
            low, high = np.where(f < 0, t, low), np.where(f < 0, high, t)
            # f = c + a / (pole below - x) + b / (pole above - x), matched in value and slope
            p, q = np.diag(gap), right - t
            c = f - p * psi - q * phi
            a, b = (p + q) * f - p * q * (psi + phi), p * q * f
            s = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = np.where(a <= 0, (a - s) / (2 * c), 2 * b / (a + s))
            new = t + step
            found = np.abs(f) <= ROUNDED * (1 + np.abs(part).sum(1) + np.abs(t) * (psi + phi))
            found |= (np.abs(step) <= 4e-16 * np.abs(t)) & (np.abs(f) < 1)
            if found.all():
                break
            new = np.where((new > low) & (new < high), new, (low + high) / 2)
            t = np.where(found, t, new)
    return pole, t


def updated(q: np.ndarray, d: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvectors (columns) and ascending eigenvalues of q diag(d) q' + z z'."""
    w = q.T @ z
    norm2 = float(w @ w)
    if not norm2 > 0:
        return q, d
    small = NEGLIGIBLE * (abs(d).max() + norm2)
    q, w = q.copy(), w.copy()
    for i in np.flatnonzero(np.diff(d) <= small):  # equal values: rotate the weight of the lower one into the upper one
        r = np.hypot(w[i], w[i + 1])
        if r > 0:
            c, s = w[i + 1] / r, w[i] / r
            q[:, i], q[:, i + 1] = c * q[:, i] - s * q[:, i + 1], s * q[:, i] + c * q[:, i + 1]
            w[i], w[i + 1] = 0.0, r
    live = np.flatnonzero(np.abs(w) * np.sqrt(norm2) > small)
    if not len(live):
        return q, d
    own, weight = d[live], w[live]
    # what is left apart by less than is negligible was gathered above; neighbours among the live ones differ
    pole, t = roots(own, weight * weight)
    distance = (own[pole][:, None] - own) + t[:, None]  # root k less pole i
    n = len(own)
    ratio = distance.T.copy()  # row i: all roots less pole i
    between = own - own[:, None]
    between[np.diag_indices(n)] = 1.0
    # product over k of (root_k - pole_i) / (pole_k - pole_i), paired so that each factor is near 1, and the own factor
    with np.errstate(all="ignore"):
        factors = ratio / between
        again = np.sqrt(np.maximum(np.abs(np.prod(factors, axis=1)), 0))
    again = np.where(np.isfinite(again), again, np.abs(weight)) * np.sign(weight)
    with np.errstate(all="ignore"):
        v = again / -distance  # row k: the eigenvector of root k among the live ones
    v[~np.isfinite(v)] = 0.0
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    out_d = d.copy()
    out_d[live] = own[pole] + t
    q[:, live] = q[:, live] @ v.T
    sort = np.argsort(out_d, kind="stable")
    return q[:, sort], out_d[sort]


@dataclass
class Spectrum:
    """Number, mean and scatter (in eigenvectors and eigenvalues) of a set of rows."""

    n: int
    mean: np.ndarray
    q: np.ndarray
    d: np.ndarray

    @classmethod
    def empty(cls, width: int) -> Spectrum:
        return cls(0, np.zeros(width), np.eye(width), np.zeros(width))

    def moved(self, n: int, mean: np.ndarray) -> None:
        """Room for n further rows of that mean, centred on the mean of all: one rank-one update."""
        gap, total = mean - self.mean, self.n + n
        if self.n:
            self.q, self.d = updated(self.q, self.d, gap * np.sqrt(self.n * n / total))
        self.mean, self.n = self.mean + gap * (n / total), total

    def add(self, rows: np.ndarray) -> None:
        """Rows one by one as centred updates; more rows than columns go as their centred triangular factor, which has the same scatter."""
        if len(rows) > rows.shape[1] + 1:
            mean = rows.mean(0)
            factor = np.linalg.qr(rows - mean, mode="r")
            self.moved(len(rows), mean)
            for z in factor:
                self.q, self.d = updated(self.q, self.d, z)
        else:
            for row in rows:
                self.moved(1, row)

    def combine(self, other: Spectrum) -> None:
        """Another set's rows: its mean, then each of its eigenvectors, scaled, as a rank-one update."""
        if not other.n:
            return
        self.moved(other.n, other.mean)
        for i in np.flatnonzero(other.d > 0):
            self.q, self.d = updated(self.q, self.d, other.q[:, i] * np.sqrt(other.d[i]))
