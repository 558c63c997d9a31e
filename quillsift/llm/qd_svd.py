"""Singular values and right singular vectors of a small triangle, by qd arithmetic.

1. Householder reflections from both sides bring the triangle to an upper bidiagonal B.
2. dqds finds the squared singular values of B. Every shift is a Newton step, a proven lower
   bound of the smallest value left, so all qd arrays stay positive and small values keep their
   relative accuracy. Blocks between negligible off-diagonals are solved alone.
3. Twisted factorisations of B'B - value * I, joined from a stationary transform from the top
   and a progressive one from the bottom, give each vector by products alone, without a solve.
   Values closer than ``CLUSTER`` share a subspace; their vectors are made orthogonal, taking
   other twists where one of them repeats.

Memory and time depend on the width of the triangle only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

EPS = float(np.finfo(float).eps)
#: An off-diagonal below this share of what lies beside it is zero.
NEGLIGIBLE = (8 * EPS) ** 2
#: Neighbouring values whose relative distance is smaller are one cluster.
CLUSTER = 1e-3
_TINY = 1e-300


def bidiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, superdiagonal, V) with matrix = U B V', for as many rows as columns."""
    work = np.array(matrix, dtype=np.float64)
    width = work.shape[1]
    right = np.eye(width)
    for k in range(width):
        _reflect(work[k:, k:].T, None)
        if k + 2 <= width:
            _reflect(work[k:, k + 1 :], right[:, k + 1 :])
    return np.diag(work).copy(), np.diag(work, 1).copy(), right


def _reflect(rows: np.ndarray, follow: np.ndarray | None) -> None:
    """Turn the first row into a multiple of the first axis by one reflection of the columns."""
    normal = rows[0].copy()
    length = np.linalg.norm(normal)
    if length == 0:
        return
    normal[0] += length if normal[0] >= 0 else -length
    normal /= np.linalg.norm(normal)
    for part in (rows, follow):
        if part is not None:
            part -= 2 * np.outer(part @ normal, normal)
    rows[0, 1:] = 0


def squared_singular_values(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Squares of all singular values of a bidiagonal, falling."""
    scale = max(np.abs(diagonal).max(initial=0.0), np.abs(above).max(initial=0.0))
    if scale == 0:
        return np.zeros(len(diagonal))
    q, e = ((diagonal / scale) ** 2).tolist(), ((above / scale) ** 2).tolist()
    found: list[float] = []
    stack = [(q, e, 0.0)]
    while stack:
        q, e, shift = stack.pop()
        while q:
            cut = next((i for i in range(len(e) - 1, -1, -1) if e[i] <= NEGLIGIBLE * (shift + min(q[i], q[i + 1]))), None)
            if cut is not None and cut < len(e) - 1:
                stack.append((q[: cut + 1], e[:cut], shift))
                q, e = q[cut + 1 :], e[cut + 1 :]
                continue
            if cut is not None or len(q) == 1:
                found.append(shift + q.pop())
                e = e[: max(0, len(q) - 1)]
                continue
            q, e, least, inverse = _transformed(q, e, 0.0)
            step = (1 - 4 * EPS) / inverse if least > 0 else 0.0
            if step > EPS * shift:
                moved = _transformed(q, e, step)
                if moved[2] >= 0:
                    q, e, shift = moved[0], moved[1], shift + step
    return np.sort(np.array(found))[::-1] * scale * scale


def _transformed(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float, float]:
    """One dqds transform: new q and e, the smallest d and the sum of 1 / d.

    Without a shift each 1 / d is a diagonal entry of the inverse of B'B, so 1 / (their sum) is at
    most the smallest squared singular value.
    """
    d = q[0] - shift
    least, inverse = d, 1 / max(d, _TINY)
    new_q, new_e = [], []
    for at, off in enumerate(e):
        both = d + off
        ratio = q[at + 1] / both if both > _TINY else 0.0
        new_q.append(both)
        new_e.append(off * ratio)
        d = d * ratio - shift
        least = min(least, d)
        inverse += 1 / max(d, _TINY)
    new_q.append(d)
    return new_q, new_e, least, inverse


def twisted_vectors(diagonal: np.ndarray, above: np.ndarray, value: float, wanted: int) -> list[np.ndarray]:
    """Unit vectors z with (B'B - value) z nearly zero, one for each of the ``wanted`` best twists."""
    q, e, ab = (diagonal**2).tolist(), (above**2).tolist(), (diagonal[:-1] * above).tolist()
    width = len(q)
    floor = EPS * EPS * max(max(q), _TINY)
    stationary, lower = [-value], []
    for i in range(width - 1):
        pivot = stationary[i] + q[i]
        pivot = pivot if abs(pivot) > floor else floor
        lower.append(ab[i] / pivot)
        stationary.append(e[i] * stationary[i] / pivot - value)
    progressive, upper = [0.0] * (width - 1) + [q[-1] - value], [0.0] * (width - 1)
    for i in range(width - 2, -1, -1):
        pivot = e[i] + progressive[i + 1]
        pivot = pivot if abs(pivot) > floor else floor
        upper[i] = ab[i] / pivot
        progressive[i] = progressive[i + 1] * q[i] / pivot - value
    twists = np.abs(np.array(stationary) + np.array(progressive) + value)
    vectors = []
    for twist in np.argsort(twists, kind="stable")[:wanted].tolist():
        z = np.zeros(width)
        z[twist] = 1.0
        for i in range(twist - 1, -1, -1):
            z[i] = -lower[i] * z[i + 1]
        for i in range(twist, width - 1):
            z[i + 1] = -upper[i] * z[i]
        length = np.linalg.norm(z)
        if np.isfinite(length):
            vectors.append(z / length)
    return vectors


def right_vectors(diagonal: np.ndarray, above: np.ndarray, values: np.ndarray, count: int) -> np.ndarray:
    """Columns: right singular vectors of the bidiagonal for the first ``count`` falling squares."""
    width = len(diagonal)
    # A negligible off-diagonal splits B; a vector lives in one part, so each part has its own twists.
    cuts = np.flatnonzero(np.abs(above) <= 4 * width * EPS * np.sqrt(values[0])) + 1
    parts = [(int(p[0]), int(p[-1]) + 1) for p in np.split(np.arange(width), cuts)]
    out = np.zeros((width, count))
    first = 0
    for k in range(count):
        if k and values[k - 1] - values[k] > CLUSTER * values[k - 1]:
            first = k
        before = out[:, first:k]
        best, best_length = None, 0.0
        for wanted, allowed in ((1, 1e-12), (width, 1e-12), (width, 1e-7)):
            for full in _candidates(diagonal, above, parts, float(values[k]), wanted, allowed * values[0]):
                full -= before @ (before.T @ full)
                length = float(np.linalg.norm(full))
                if length > best_length:
                    best, best_length = full / length, length
            if best_length > 0.1:
                break
        if best is None:
            raise ArithmeticError(f"no vector for singular value {k}")
        for _ in range(2):
            best = best - before @ (before.T @ best)
            best /= np.linalg.norm(best)
        out[:, k] = best
    return out


def _candidates(
    diagonal: np.ndarray, above: np.ndarray, parts: list[tuple[int, int]], value: float, wanted: int, allowed: float
) -> Iterator[np.ndarray]:
    """Vectors of all parts that are off by ``allowed`` at most."""
    for begin, end in parts:
        for z in twisted_vectors(diagonal[begin:end], above[begin : end - 1], value, wanted):
            full = np.zeros(len(diagonal))
            full[begin:end] = z
            if _off(diagonal, above, full, value) <= allowed:
                yield full


def _off(diagonal: np.ndarray, above: np.ndarray, z: np.ndarray, value: float) -> float:
    """Length of (B'B - value) z."""
    up = diagonal * z
    up[:-1] += above * z[1:]
    down = diagonal * up
    down[1:] += above * up[:-1]
    return float(np.linalg.norm(down - value * z))


def right_singular(triangle: np.ndarray, count: int, least: float = 1e-13) -> tuple[np.ndarray, np.ndarray]:
    """(all squared singular values, right vectors of the ``count`` largest) of a square matrix.

    Fewer vectors where the rank is smaller: a singular value of at most ``least`` times the
    width times the largest one counts as zero and has no vector.
    """
    diagonal, above, right = bidiagonal(triangle)
    values = squared_singular_values(diagonal, above)
    floor = (least * len(values)) ** 2 * values.max(initial=0.0)
    count = min(count, int((values > floor).sum()))
    vectors = right @ right_vectors(diagonal, above, values, count) if count else np.zeros((len(right), 0))
    return values, vectors
