"""Leading eigenpairs of a symmetric matrix by contour integration (FEAST).

An interval's spectral projector is the integral of the resolvent along a circle around
it. Gauss-Legendre nodes on the circle turn it into complex shifted solves, applied to a
block of vectors; Rayleigh-Ritz in the projected space gives eigenpairs, and the pairs
go through the projector again until their residuals are at rounding level. Inertia
counts choose the intervals and tell how many pairs each must give.
"""

from __future__ import annotations

import numpy as np

NODES = 8
PER_INTERVAL = 8
ROUNDS = 60


def count_above(a: np.ndarray, shift: float) -> int:
    """Eigenvalues above ``shift``, by Sylvester's law: the positive pivots of a symmetric
    elimination of a - shift. Pivots are 1 x 1 or 2 x 2 blocks, the largest entry left."""
    m = a - shift * np.eye(len(a))
    above = 0
    while len(m):
        d = np.abs(np.diag(m))
        i = int(np.argmax(d))
        off = np.abs(m - np.diag(np.diag(m)))
        top = off.max() if len(m) > 1 else 0.0
        if d[i] >= 0.64 * top:
            if d[i] == 0:
                return above  # nothing but zeros is left
            above += bool(m[i, i] > 0)
            keep = np.delete(np.arange(len(m)), i)
            m = m[np.ix_(keep, keep)] - np.outer(m[keep, i], m[i, keep]) / m[i, i]
        else:  # this block's determinant is negative: one eigenvalue on either side
            r, c = np.unravel_index(int(np.argmax(off)), off.shape)
            pair, keep = [r, c], np.delete(np.arange(len(m)), [r, c])
            above += int((np.linalg.eigvalsh(m[np.ix_(pair, pair)]) > 0).sum())
            m = m[np.ix_(keep, keep)] - m[np.ix_(keep, pair)] @ np.linalg.solve(m[np.ix_(pair, pair)], m[np.ix_(pair, keep)])
        m = (m + m.T) / 2
    return above


def _boundary(a: np.ndarray, wanted: int, low: float, high: float) -> tuple[float, int]:
    """A shift with ``wanted`` eigenvalues above it, or, where that one and the next are
    equal to rounding, the fewest more; in the middle of the gap that halving finds."""
    more, fewer = low, high  # count_above(more) > wanted >= count_above(fewer)
    if count_above(a, low) <= wanted:
        return low, count_above(a, low)
    scale = max(abs(low), abs(high))
    while fewer - more > 1e-13 * scale:
        mid = (more + fewer) / 2
        if count_above(a, mid) > wanted:
            more = mid
        else:
            fewer = mid
        if count_above(a, fewer) == wanted:
            break
    if count_above(a, fewer) != wanted:  # equal eigenvalues at the border: take all of them
        shift = more - 4e-13 * scale
        return shift, count_above(a, shift)
    # Widen the gap: the nearest eigenvalue below, the nearest above.
    below, above = more, fewer
    for _ in range(12):
        mid = (below + fewer) / 2
        below, fewer = (mid, fewer) if count_above(a, mid) > wanted else (below, mid)
    top = high
    for _ in range(12):
        mid = (above + top) / 2
        above, top = (mid, top) if count_above(a, mid) == wanted else (above, mid)
    return (fewer + above) / 2, wanted


def _filtered(a: np.ndarray, block: np.ndarray, low: float, high: float) -> np.ndarray:
    """The block projected onto the eigenvectors of [low, high], by quadrature of the
    resolvent on the upper half circle; the lower half is its complex conjugate."""
    x, w = np.polynomial.legendre.leggauss(NODES)
    centre, radius = (low + high) / 2, (high - low) / 2
    out = np.zeros_like(block)
    for node, weight in zip(x, w):
        turn = np.exp(0.5j * np.pi * (node + 1))
        solved = np.linalg.solve((centre + radius * turn) * np.eye(len(a)) - a, block.astype(complex))
        out += 0.5 * weight * (radius * turn * solved).real
    return out


def _interval(a: np.ndarray, low: float, high: float, count: int, rng: np.random.Generator) -> np.ndarray:
    """The ``count`` unit eigenvectors of (low, high)."""
    d, size = len(a), min(len(a), count + max(4, count // 2))
    scale = max(abs(low), abs(high), float(np.abs(a).max()))
    while True:
        q, best = np.linalg.qr(rng.standard_normal((d, size)))[0], np.inf
        for _ in range(ROUNDS):
            q = np.linalg.qr(_filtered(a, q, low, high))[0]
            values, turn = np.linalg.eigh(q.T @ a @ q)
            q = q @ turn
            inside = (values > low) & (values < high)
            if inside.sum() == count:
                v = q[:, inside]
                worst = float(np.linalg.norm(a @ v - v * values[inside], axis=0).max())
                if worst <= 1e-15 * scale * d or worst >= 0.5 * best and worst <= 1e-13 * scale * d:
                    return v
                best = min(best, worst)
        if size == d:
            raise ArithmeticError(f"{int(inside.sum())} eigenpairs in an interval that holds {count}")
        size = min(d, 2 * size)


def leading(a: np.ndarray, k: int, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues, falling, and their unit eigenvectors as columns.

    Every interval's number of eigenvectors is held against the inertia counts of its
    ends, so none is missed; a last Rayleigh-Ritz step makes vectors of neighbouring
    intervals orthogonal.
    """
    d, k = len(a), min(k, len(a))
    reach = float(np.abs(a).sum(axis=1).max())
    if k == 0 or reach == 0:
        return np.zeros(k), np.eye(d)[:, :k]
    rng, parts, done = np.random.default_rng(seed), [], 0
    high = reach * (1 + 1e-9)
    while done < k:
        low, above = _boundary(a, min(k, done + PER_INTERVAL), -reach * (1 + 1e-9), high)
        parts.append(_interval(a, low, high, above - done, rng))
        done, high = above, low
    q = np.linalg.qr(np.concatenate(parts, axis=1))[0]
    values, turn = np.linalg.eigh(q.T @ a @ q)
    order = np.argsort(-values, kind="stable")[:k]
    return values[order], (q @ turn)[:, order]
