"""Spectra of scatter matrices, kept up to date by symmetric changes of rank one.

A spectrum is the eigendecomposition of the scatter matrix of some vectors about their mean. One more vector changes the
matrix by rank one; the new eigenvalues are the roots of a secular equation between the old ones, and the new eigenvectors
follow from the roots. Directions that the change doesn't touch and eigenvalues that coincide are deflated: they need no root.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np

_EPS = float(np.finfo(np.float64).eps)
STEPS = 80


@cache
def _below(n: int) -> np.ndarray:
    """1 for pole i and root j with i <= j."""
    return np.triu(np.ones((n, n)))


@cache
def _roots_below(n: int) -> np.ndarray:
    return np.tri(n, n, -1, dtype=bool)


def secular_roots(d: np.ndarray, z2: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """The roots of 1 + rho * sum(z2 / (d - x)) for rising, distinct ``d``, positive ``z2`` and ``rho``.

    Each root is given as the index of the pole next to it and the distance from there, so that differences
    to the poles keep all their digits. Rational steps through the poles on both sides, halving where one leaves the bracket.
    """
    n = len(d)
    upper = np.append(d[1:], d[-1] + rho * z2.sum())
    beside = np.append(z2[1:], 0.0)
    half = (upper - d) / 2
    at = np.arange(n)
    weights, left, one = z2[:, None], _below(n), 1.0 / rho
    with np.errstate(all="ignore"):
        terms = weights / (d[:, None] - d - half)
        middle = one + terms.sum(0)
        ahead = middle < 0  # the root lies in the upper half
        near_upper = ahead.copy()
        near_upper[-1] = False
        origin = at + near_upper
        low = np.where(near_upper, -half, np.where(ahead, half, 0.0))
        high = low + half
        under = d - d[origin]
        over = upper - d[origin]
        apart = d[:, None] - d[origin]
        # the first guess: the two poles beside the root as they are, all others as they are at the middle
        c = middle + (z2 - beside) / half
        p = c * (under + over) + z2 + beside
        q = c * under * over + z2 * over + beside * under
        root = np.sqrt(np.maximum(0.0, p * p - 4 * q * c))
        tau = np.where(p > 0, 2 * q / (p + root), (p - root) / (2 * c))
        tau = np.where((tau > low) & (tau < high), tau, low + half / 2)
        for _ in range(STEPS):
            away = apart - tau  # pole i less root j
            terms = weights / away
            slopes = terms / away
            below, own = np.einsum("ij,ij->j", terms, left), np.einsum("ij,ij->j", slopes, left)
            all_terms, slope = terms.sum(0), slopes.sum(0)
            f = one + all_terms
            done = np.abs(f) <= _EPS * (one + 8 * (all_terms - 2 * below) + np.abs(tau) * slope)
            if done.all():
                break
            behind = f < 0
            low, high = np.where(behind, tau, low), np.where(behind, high, tau)
            a, b = under - tau, over - tau  # the poles on both sides, seen from the root
            ab = a * b
            c = f - a * own - b * (slope - own)
            p, q = (a + b) * f - ab * slope, ab * f
            root = np.sqrt(np.maximum(0.0, p * p - 4 * q * c))
            step = np.where(p <= 0, (p - root) / (2 * c), 2 * q / (p + root))
            step[-1] = a[-1] * (1.0 + a[-1] * own[-1] / (f[-1] - a[-1] * own[-1]))  # one pole only
            new = tau + step
            new = np.where((new > low) & (new < high), new, (low + high) / 2)
            tau = np.where(done | (high - low <= 2 * _EPS * np.abs(tau)), tau, new)
    return origin, tau


def rank_one(values: np.ndarray, vectors: np.ndarray, change: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, rising, and eigenvectors (columns) of Q diag(values) Q' + rho * change change', rho positive."""
    z = vectors.T @ change
    size = float(z @ z)
    if rho * size == 0.0:
        return values, vectors
    tol = 8 * _EPS * max(float(np.abs(values).max()), rho * size)
    values, vectors = values.copy(), vectors.copy()
    # equal eigenvalues: turn their vectors so that the change touches only the last of them
    apart = values[1:] - values[:-1] > tol
    begins = [] if apart.all() else [0, *(np.flatnonzero(apart) + 1).tolist(), len(values)]
    for a, b in zip(begins[:-1], begins[1:], strict=True):
        if b - a > 1:
            part = z[a:b].copy()
            length = float(np.sqrt(part @ part))
            if length > 0:
                mirror = part.copy()
                mirror[-1] += np.copysign(length, part[-1])
                mirror /= np.sqrt(mirror @ mirror)
                vectors[:, a:b] -= 2.0 * np.outer(vectors[:, a:b] @ mirror, mirror)
                z[a:b] = 0.0
                z[b - 1] = -np.copysign(length, part[-1])
    live = np.flatnonzero(rho * np.abs(z) * np.sqrt(size) > tol)
    if not len(live):
        return values, vectors
    d, z2 = values[live], z[live] ** 2
    origin, tau = secular_roots(d, z2, rho)
    away = (d[:, None] - d[origin]) - tau  # pole i less root j
    # the change whose exact roots these are; it differs from z by rounding and gives vectors that are orthogonal
    n = len(live)
    gaps = d[:, None] - d
    np.fill_diagonal(gaps, 1.0)
    beside = np.empty((n, n))  # roots below pole i against the poles they stand above, the others against those they stand below
    beside[:, 1:] = away[:, :-1]
    ratios = np.where(_roots_below(n), away, beside) / gaps
    np.fill_diagonal(ratios, 1.0)
    product = ratios.prod(axis=1) * -away[:, -1]
    exact = np.sqrt(np.maximum(product, 0.0) / rho) * np.where(z[live] < 0, -1.0, 1.0)
    turn = exact[:, None] / away
    turn /= np.sqrt((turn * turn).sum(axis=0))
    vectors[:, live] = vectors[:, live] @ turn
    values[live] = d[origin] + tau
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


@dataclass
class Spectrum:
    """Count, mean and the eigendecomposition of the scatter about the mean."""

    n: int
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def empty(cls, dim: int) -> Spectrum:
        return cls(0, np.zeros(dim), np.zeros(dim), np.eye(dim))

    def add(self, x: np.ndarray) -> None:
        """One more vector: a change of rank one about the mean before it."""
        away = x - self.mean
        self.values, self.vectors = rank_one(self.values, self.vectors, away, self.n / (self.n + 1.0))
        self.mean = self.mean + away / (self.n + 1)
        self.n += 1

    def merge(self, other: Spectrum) -> None:
        """Another spectrum: one change for each of its directions and one for the distance of the means."""
        if not other.n:
            return
        for value, vector in zip(other.values, other.vectors.T, strict=True):
            if value > 0:
                self.values, self.vectors = rank_one(self.values, self.vectors, vector, float(value))
        away, n = other.mean - self.mean, self.n + other.n
        if self.n:
            self.values, self.vectors = rank_one(self.values, self.vectors, away, self.n * (other.n / n))
        self.mean = self.mean + away * (other.n / n)
        self.n = n
