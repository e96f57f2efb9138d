"""Largest eigenpairs of a symmetric matrix by contour integration (FEAST), with inertia counts.

An interval that holds m eigenvalues is ringed by a circle; the resolvent, solved at
complex shifts on it, applied to a random block and summed, projects onto the
eigenvectors inside.  Rayleigh-Ritz extracts them, and the block goes round again until
residuals are at rounding level.  How many eigenvalues lie above a shift is the number of
positive pivots of the shifted matrix in tridiagonal form (Sylvester's law of
inertia): it places the intervals' ends and shows that none was missed.
"""

from __future__ import annotations

import numpy as np

NODES = 8
ROUNDS = 60
MOST = 24
# Width of an interval against its upper end.  Narrow circles keep all but a few near eigenvalues far outside, so a few rounds do.
NARROW = 0.02
NOTHING = 1e-13
EXACT = 2e-14


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(diagonal, off-diagonal) of an orthogonally similar tridiagonal matrix, by reflections."""
    a = a.copy()
    n = len(a)
    for k in range(n - 2):
        v = a[k + 1:, k].copy()
        size = np.linalg.norm(v)
        if size == 0:
            continue
        v[0] += np.copysign(size, v[0])
        v /= np.linalg.norm(v)
        p = 2 * (a[k + 1:, k + 1:] @ v)
        p -= v * (v @ p)
        a[k + 1:, k + 1:] -= np.outer(v, p) + np.outer(p, v)
        a[k + 1:, k] = a[k, k + 1:] = 0
        a[k + 1, k] = a[k, k + 1] = -np.copysign(size, v[0])
    return np.diag(a).copy(), np.diag(a, 1).copy()


def above(form: tuple[np.ndarray, np.ndarray], shift: float) -> int:
    """How many eigenvalues exceed the shift: the positive pivots of the shifted matrix."""
    found, pivot = 0, 1.0
    for d, e in zip(form[0], np.append(0.0, form[1]), strict=True):
        pivot = d - shift - e * e / pivot
        if pivot == 0:
            pivot = -1e-300
        found += pivot > 0
    return found


def _clear(form, shift: float) -> float:
    """A shift near the given one that no eigenvalue touches."""
    for _ in range(60):
        if above(form, shift * (1 - 1e-10)) == above(form, shift * (1 + 1e-10)):
            break
        shift *= 1 - 1e-9
    return shift


def _edge(form, want: int, top: float, least: float, close: float = 1e-4) -> tuple[float, float]:
    """(low, high) closely around the eigenvalue with number ``want`` from above."""
    low, high = least, top
    while high - low > close * high:
        mid = (low + high) / 2
        low, high = (mid, high) if above(form, mid) >= want else (low, mid)
    return low, high


def intervals(form, want: int, top: float, least: float) -> list[tuple[float, float, int]]:
    """Intervals (low, high, eigenvalues inside) that hold the ``want`` largest at least."""
    _, top = _edge(form, 1, top, least)
    low, _ = _edge(form, want, top, least)
    m = above(form, low)
    if above(form, least) > m:  # the end lies amid the gap to the next eigenvalue
        low = (low + _edge(form, m + 1, low, least)[1]) / 2
    else:
        low = (low + least) / 2
    ends, out = [(_clear(form, low), _clear(form, top * 1.001))], []
    while ends:
        a, b = ends.pop()
        m = above(form, a) - above(form, b)
        if m and b - a > NARROW * b or m > MOST and b - a > 1e-6 * b:
            mid = _clear(form, (a + b) / 2)
            ends += [(a, mid), (mid, b)]
        elif m:
            out.append((a, b, m))
    return out


def _inside(a: np.ndarray, low: float, high: float, m: int, rng) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors) of the m eigenvalues between two shifts."""
    n = len(a)
    centre, radius = (low + high) / 2, (high - low) / 2
    block = rng.standard_normal((n, min(n, m + max(8, m))))
    turns = np.exp(1j * np.pi * (np.arange(NODES) + 0.5) / NODES)
    for _ in range(ROUNDS):
        # the lower half of the circle is the conjugate of the upper one
        projected = sum((radius * t * np.linalg.solve((centre + radius * t) * np.eye(n) - a, block)).real for t in turns) / NODES
        q, _ = np.linalg.qr(projected)
        values, small = np.linalg.eigh(q.T @ a @ q)
        block = q @ small
        at = (values > low) & (values < high)
        if at.sum() == m and np.linalg.norm(a @ block[:, at] - block[:, at] * values[at], axis=0).max() < EXACT * np.sqrt(n):
            return values[at], block[:, at]
    raise ArithmeticError(f"{m} eigenvalues between {low} and {high}, {at.sum()} found")


def largest(matrix: np.ndarray, k: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues, falling, and their unit eigenvectors as columns, of a matrix without negative ones.

    Fewer where the rank is smaller: eigenvalues that are 0 but for rounding do not count.
    """
    trace = float(np.trace(matrix)) if matrix.size else 0.0
    if not trace > 0 or k < 1:
        return np.zeros(0), np.zeros((len(matrix), 0))
    a = (matrix + matrix.T) / (2 * trace)
    form = tridiagonal(a)
    least = NOTHING * len(a)
    want = min(k, above(form, least))
    found = [_inside(a, low, high, m, np.random.default_rng(seed)) for low, high, m in intervals(form, want, 1.0 + 1e-6, least)]
    values, vectors = np.concatenate([v for v, _ in found]), np.hstack([x for _, x in found])
    # one more Rayleigh-Ritz step over all intervals: vectors of neighbours become orthogonal
    q, _ = np.linalg.qr(vectors)
    values, small = np.linalg.eigh(q.T @ a @ q)
    vectors = (q @ small)[:, ::-1][:, :want]
    return values[::-1][:want] * trace, vectors / np.linalg.norm(vectors, axis=0)
