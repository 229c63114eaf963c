"""Leading eigenpairs of a symmetric matrix by spectrum slicing.

The signs in D of the factorisation A - s I = L D L^T count the eigenvalues above s (Sylvester's law of
inertia). Bisection on these counts isolates one eigenvalue after the other, Rayleigh quotient iteration
then converges cubically, and counts on both sides of the result certify its number.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps
PIVOT = (1 + 17**0.5) / 8  # Bunch and Kaufman's bound on the growth of the entries


def count_above(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues are greater than ``shift``, by LDL^T with blocks of one or two rows."""
    a = matrix - shift * np.eye(len(matrix))
    size, k, positive = len(a), 0, 0
    while k < size:
        diagonal = abs(a[k, k])
        below = np.abs(a[k + 1 :, k])
        largest = below.max(initial=0.0)
        if max(diagonal, largest) == 0:
            k += 1  # an eigenvalue equal to the shift
            continue
        pivot, width = k, 1
        if diagonal < PIVOT * largest:
            r = k + 1 + int(below.argmax())
            row = np.abs(a[r, k:])
            row[r - k] = 0
            other = row.max()
            if diagonal * other < PIVOT * largest**2:
                pivot, width = (r, 1) if abs(a[r, r]) >= PIVOT * other else (r, 2)
        last = k + width - 1
        if pivot != last:
            a[[last, pivot]] = a[[pivot, last]]
            a[:, [last, pivot]] = a[:, [pivot, last]]
        if width == 1:
            positive += a[k, k] > 0
            column = a[k + 1 :, k].copy()
            a[k + 1 :, k + 1 :] -= np.outer(column, column / a[k, k])
        else:
            block, columns = a[k : k + 2, k : k + 2].copy(), a[k + 2 :, k : k + 2].copy()
            determinant = block[0, 0] * block[1, 1] - block[0, 1] * block[1, 0]
            positive += 1 if determinant < 0 else 2 * int(block[0, 0] + block[1, 1] > 0)
            a[k + 2 :, k + 2 :] -= columns @ np.linalg.solve(block, columns.T)
        k += width
    return int(positive)


def rayleigh(matrix: np.ndarray, shift: float, found: list[np.ndarray], scale: float, seed: int) -> tuple[float, np.ndarray, float]:
    """Eigenvalue, unit eigenvector and residual near ``shift``, at right angles to the vectors found."""
    size = len(matrix)

    def improve(vector: np.ndarray, at: float) -> np.ndarray:
        try:
            vector = np.linalg.solve(matrix - at * np.eye(size), vector)
        except np.linalg.LinAlgError:  # the shift is an eigenvalue to the last bit
            vector = np.linalg.solve(matrix - (at + EPS * scale) * np.eye(size), vector)
        return unit(vector / np.abs(vector).max())

    def unit(vector: np.ndarray) -> np.ndarray:
        for _ in range(2):
            for other in found:
                vector = vector - (other @ vector) * other
        return vector / np.linalg.norm(vector)

    vector = unit(np.random.default_rng(seed).standard_normal(size))
    for _ in range(3):  # inverse iteration towards the isolated eigenvalue
        vector = improve(vector, shift)
    best = (np.inf, 0.0, vector)
    for _ in range(12):
        value = float(vector @ matrix @ vector)
        residual = float(np.linalg.norm(matrix @ vector - value * vector))
        if residual >= best[0]:
            break
        best = (residual, value, vector)
        if residual <= EPS * scale:
            break
        vector = improve(vector, value)
    return best[1], best[2], best[0]


def leading_eigenpairs(matrix: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, and their unit eigenvectors as columns.

    Equal eigenvalues are told apart by number; their vectors are then any orthonormal ones of the
    space they share. Raises ArithmeticError if the counts do not certify a pair.
    """
    matrix = np.asarray(matrix, float)
    size = len(matrix)
    radius = np.abs(matrix).sum(axis=1) - np.abs(np.diag(matrix))
    top, bottom = float((np.diag(matrix) + radius).max()), float((np.diag(matrix) - radius).min())
    scale = max(abs(top), abs(bottom))
    if scale == 0:
        return np.zeros(min(wanted, size)), np.eye(size)[:, : min(wanted, size)]
    slack = 8 * size * EPS * scale
    top, bottom = top + slack, bottom - slack
    known = {top: 0, bottom: size}
    values: list[float] = []
    vectors: list[np.ndarray] = []

    def above(shift: float) -> int:
        if shift not in known:
            known[shift] = count_above(matrix, shift)
        return known[shift]

    for number in range(1, min(wanted, size) + 1):
        low = max(s for s, c in known.items() if c >= number)
        high = min(s for s, c in known.items() if c < number)
        while True:
            alone = above(low) == number and above(high) == number - 1
            narrow = high - low <= slack
            if alone or narrow:
                value, vector, residual = rayleigh(matrix, (low + high) / 2, vectors, scale, number)
                margin = slack + residual
                if low - margin <= value <= high + margin and residual <= slack:
                    if above(value + margin) < number <= above(value - margin):
                        break
                if narrow:
                    raise ArithmeticError(f"eigenvalue {number} could not be certified")
            middle = (low + high) / 2
            if above(middle) >= number:
                low = middle
            else:
                high = middle
        values.append(value)
        vectors.append(vector)
    return np.array(values), np.array(vectors).T
