"""Eigenvalues and eigenvectors of a symmetric matrix: reduction to tridiagonal form, then divide and conquer.

A tridiagonal matrix is two halves and a rank-one link. The halves are solved by recursion, the eigenvalues of the whole are
the roots of the secular equation of the link, each kept as a pole and its distance from it, and the link's vector is
recomputed from the roots found, so that vectors of close eigenvalues stay orthogonal. Entries of the link that are
negligible, and all but one of equal poles, are taken out first.
"""

from __future__ import annotations

import numpy as np

_EPS = np.finfo(float).eps


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, off-diagonal and orthogonal q with a = q t q^T, by reflections."""
    a, n = np.array(a, float), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        x[0] += np.copysign(np.linalg.norm(x), x[0])
        size = np.linalg.norm(x)
        if size == 0:
            continue
        x /= size
        a[k + 1 :] -= 2 * np.outer(x, x @ a[k + 1 :])
        a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ x, x)
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ x, x)
    return np.diag(a).copy(), np.diag(a, 1).copy(), q


def _distances(gap: np.ndarray, z2: np.ndarray, rho: float, sign: np.ndarray, most: np.ndarray) -> np.ndarray:
    """For each root its distance from its pole, in (0, most]: bisection over the bits of a positive double, so that it is
    as precise for distances near 0; gap[j, i] is pole j minus the pole of root i, sign whether the root lies above.
    """
    low, high = np.zeros(len(most), np.int64), np.maximum(most, np.finfo(float).tiny).view(np.int64).copy()
    for _ in range(64):
        mid = low + (high - low) // 2
        at = mid.view(float)
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            f = 1 + rho * np.nansum(z2[:, None] / (gap - sign * at), axis=0)
        # f grows with the eigenvalue: above the pole a negative value means further out, below it a positive one.
        out = np.where(sign > 0, f < 0, f > 0)
        low, high = np.where(out, mid, low), np.where(out, high, mid)
    return np.maximum(high.view(float), np.finfo(float).tiny)


def _linked(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and vectors of diag(d) + rho z z^T, for d ascending and rho over 0."""
    n, q, d, z = len(d), np.eye(len(d)), d.copy(), z.copy()
    tol = 8 * _EPS * max(np.abs(d).max(), rho * float(z @ z))
    kept: list[int] = []
    for i in range(n):
        if rho * abs(z[i]) * np.linalg.norm(z) <= tol:
            continue
        if kept:
            p = kept[-1]
            r = np.hypot(z[p], z[i])
            c, s = z[i] / r, z[p] / r
            if abs((d[i] - d[p]) * c * s) <= tol:  # equal poles: turn the link away from the first
                q[:, [p, i]] = q[:, [p, i]] @ np.array([[c, s], [-s, c]])
                d[p], d[i] = d[p] * c * c + d[i] * s * s, d[p] * s * s + d[i] * c * c
                z[p], z[i] = 0.0, r
                kept[-1] = i
                continue
        kept.append(i)
    if not kept:
        return d, q
    k, w, x = np.array(kept), d[kept], z[kept]
    m, z2 = len(k), x * x
    width = np.append(np.diff(w), rho * z2.sum())
    with np.errstate(divide="ignore"):
        middle = 1 + rho * (z2[:, None] / (w[:, None] - (w + width / 2))).sum(axis=0)
    right = (middle < 0) & (np.arange(m) < m - 1)
    base, sign = np.where(right, np.arange(m) + 1, np.arange(m)) % m, np.where(right, -1.0, 1.0)
    gap = w[:, None] - w[base]
    far = _distances(gap, z2, rho, sign, np.where(np.arange(m) < m - 1, width / 2, width * (1 + 4 * _EPS)))
    apart = gap - sign * far  # pole j minus root i
    between = w[:, None] - w + np.eye(m)
    ratio = apart / np.where(np.eye(m) > 0, 1, between.T * -1)
    x = np.copysign(np.sqrt(np.abs(ratio.prod(axis=1)) / rho), x)
    vectors = x[:, None] / apart
    vectors /= np.linalg.norm(vectors, axis=0)
    values = d.copy()
    values[k] = w[base] + sign * far
    out = q.copy()
    out[:, k] = q[:, k] @ vectors
    return values, out


def _conquer(d: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(d)
    if n == 1:
        return d.copy(), np.eye(1)
    h, rho = n // 2, e[n // 2 - 1]
    d = d.copy()
    d[h - 1] -= rho
    d[h] -= rho
    (d1, q1), (d2, q2) = _conquer(d[:h], e[: h - 1]), _conquer(d[h:], e[h:])
    values, z = np.concatenate([d1, d2]), np.concatenate([q1[-1], q2[0]])
    q = np.zeros((n, n))
    q[:h, :h], q[h:, h:] = q1, q2
    if rho != 0:
        up = 1 if rho > 0 else -1
        order = np.argsort(up * values, kind="stable")
        found, turn = _linked(up * values[order], z[order], abs(rho))
        values, q = up * found, q[:, order] @ turn
    order = np.argsort(values, kind="stable")
    return values[order], q[:, order]


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns."""
    size = np.abs(a).max() if a.size else 0.0
    if size == 0:
        return np.zeros(len(a)), np.eye(len(a))
    d, e, q = tridiagonal(a / size)
    e[np.abs(e) <= _EPS * (np.abs(d[1:]) + np.abs(d[:-1]))] = 0.0
    values, turn = _conquer(d, e)
    return values[::-1] * size, (q @ turn)[:, ::-1]
