"""Leading eigenpairs of a symmetric matrix: Householder tridiagonal form, bisection on Sturm counts, inverse iteration.

The matrix has one row per dimension of a vector, so it is small beside the data it was summed from.
"""

from __future__ import annotations

import numpy as np

_EPS = float(np.finfo(np.float64).eps)
_ROUNDS = 5


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(diagonal, off-diagonal, reflectors): reflector ``k`` is the unit vector of H = I - 2 v v' that clears column ``k`` from row ``k + 2`` on."""
    a = np.array(matrix, dtype=np.float64)
    n = len(a)
    reflectors = []
    for k in range(n - 2):
        x = a[k + 1 :, k]
        size = float(np.abs(x).max())
        v = np.zeros(n - k - 1)
        if size > 0 and np.abs(x[1:]).max() > 0:
            v = x / size
            v[0] += np.copysign(np.linalg.norm(v), v[0])
            v /= np.linalg.norm(v)
            rest = a[k + 1 :, k + 1 :]
            p = rest @ v
            w = p - (v @ p) * v
            rest -= 2 * (np.outer(v, w) + np.outer(w, v))
            a[k + 1 :, k] = x - 2 * v * (v @ x)
        reflectors.append(v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflectors


def below(d: np.ndarray, e: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues of the tridiagonal matrix are smaller than each of ``at``: sign changes of its Sturm sequence."""
    least = _EPS * max(float(np.abs(d).max()), float(np.abs(e).max(initial=0)), np.finfo(float).tiny / _EPS)
    pivot = d[0] - at
    count = (pivot < 0).astype(np.int64)
    for i in range(1, len(d)):
        pivot = np.where(np.abs(pivot) < least, -least, pivot)
        pivot = d[i] - at - e[i - 1] ** 2 / pivot
        count += pivot < 0
    return count


def largest(d: np.ndarray, e: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling; all of them are halved in on side by side."""
    n = len(d)
    reach = np.concatenate([[0.0], np.abs(e)]) + np.concatenate([np.abs(e), [0.0]])
    low, high = np.full(k, (d - reach).min()), np.full(k, (d + reach).max())
    slack = 2 * _EPS * max(float(np.abs(low[0])), float(np.abs(high[0]))) + np.finfo(float).tiny
    low, high = low - slack, high + slack
    rank = n - 1 - np.arange(k)  # so many eigenvalues are smaller than the wanted one
    while True:
        middle = (low + high) / 2
        if np.all((middle <= low) | (middle >= high) | (high - low <= _EPS * np.abs(middle))):
            return middle
        above = below(d, e, middle) <= rank
        low, high = np.where(above, middle, low), np.where(above, high, middle)


def _factors(d: np.ndarray, e: np.ndarray, value: float, least: float) -> tuple[np.ndarray, ...]:
    """Elimination with row exchanges of the tridiagonal matrix less ``value``: three upper diagonals, multipliers, exchanges."""
    n = len(d)
    u0, u1, u2 = d - value, np.append(e, 0.0), np.zeros(n)
    factor, swapped = np.zeros(n), np.zeros(n, bool)
    for i in range(n - 1):
        below_, next0, next1 = e[i], u0[i + 1], u1[i + 1]
        if abs(below_) > abs(u0[i]):
            swapped[i] = True
            factor[i] = u0[i] / below_
            u0[i + 1], u1[i + 1] = u1[i] - factor[i] * next0, -factor[i] * next1
            u0[i], u1[i], u2[i] = below_, next0, next1
        else:
            factor[i] = below_ / u0[i] if u0[i] else 0.0
            u0[i + 1] = next0 - factor[i] * u1[i]
    u0[np.abs(u0) < least] = least
    return u0, u1, u2, factor, swapped


def _solve(factors: tuple[np.ndarray, ...], b: np.ndarray) -> np.ndarray:
    u0, u1, u2, factor, swapped = factors
    x = b.copy()
    n = len(x)
    for i in range(n - 1):
        if swapped[i]:
            x[i], x[i + 1] = x[i + 1], x[i] - factor[i] * x[i + 1]
        else:
            x[i + 1] -= factor[i] * x[i]
    for i in range(n - 1, -1, -1):
        rest = (u1[i] * x[i + 1] if i + 1 < n else 0.0) + (u2[i] * x[i + 2] if i + 2 < n else 0.0)
        x[i] = (x[i] - rest) / u0[i]
        if abs(x[i]) > 1e150:
            x *= 1e-150
    return x


def vectors(d: np.ndarray, e: np.ndarray, values: np.ndarray, seed: int = 0) -> np.ndarray:
    """Unit eigenvectors of the tridiagonal matrix, one a row; those of a cluster of values are kept orthogonal."""
    n = len(d)
    norm = float(np.max(np.abs(d) + np.concatenate([[0.0], np.abs(e)]) + np.concatenate([np.abs(e), [0.0]]))) or 1.0
    start = np.random.Generator(np.random.PCG64(seed))
    out = np.zeros((len(values), n))
    first, shifted = 0, float("inf")
    for j, value in enumerate(values):
        if j and values[j - 1] - value > 1e-3 * norm:
            first = j
        # Equal values are told apart a little, so that their iterations do not run into the same vector.
        shifted = min(float(value), shifted - 10 * _EPS * norm) if j > first else float(value)
        factors = _factors(d, e, shifted, _EPS * norm)
        x = start.standard_normal(n)
        for _ in range(_ROUNDS):
            x = _solve(factors, x / np.linalg.norm(x))
            x /= np.abs(x).max()
            for _ in range(2):
                x -= out[first:j].T @ (out[first:j] @ x)
        out[j] = x / np.linalg.norm(x)
    return out


def leading(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, unit vectors one a row) of the ``k`` largest eigenvalues, falling; the largest entry of each vector is positive."""
    k = min(k, len(matrix))
    if not k:
        return np.zeros(0), np.zeros((0, len(matrix)))
    d, e, reflectors = tridiagonal(matrix)
    values = largest(d, e, k)
    found = vectors(d, e, values)
    for i in range(len(reflectors) - 1, -1, -1):
        part = found[:, i + 1 :]
        part -= 2 * np.outer(part @ reflectors[i], reflectors[i])
    found /= np.linalg.norm(found, axis=1, keepdims=True)
    top = found[np.arange(k), np.abs(found).argmax(axis=1)]
    return values, found * np.where(top < 0, -1.0, 1.0)[:, None]
