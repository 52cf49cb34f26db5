"""Leading eigenpairs of a symmetric matrix by slicing its spectrum.

The inertia of ``A - s`` (the signs of D in a factorisation LDLᵀ) says how many eigenvalues lie below s. Bisection
with these counts isolates the eigenvalue of each number; Rayleigh quotient iteration inside its interval
converges cubically; two more counts, just below and just above the result, certify the number. Equal eigenvalues can't be
isolated: their vectors are kept orthogonal to those already found, and the counts certify that all of them lie there.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps
#: Largest growth of entries in a step is least with this ratio between pivots of one and of two rows.
ALPHA = (1 + 17**0.5) / 8


def below_zero(a: np.ndarray) -> int:
    """How many eigenvalues of a symmetric matrix are negative: LDLᵀ with complete pivoting, pivots of one or two rows."""
    a = a.copy()
    found = 0
    while len(a):
        n = len(a)
        diagonal = np.abs(np.diagonal(a))
        k = int(diagonal.argmax())
        off = np.abs(np.tril(a, -1))
        p, q = divmod(int(off.argmax()), n)
        if max(diagonal[k], off[p, q]) == 0:
            return found
        if diagonal[k] >= ALPHA * off[p, q]:
            found += bool(a[k, k] < 0)
            rest = np.delete(np.arange(n), k)
            column = a[rest, k]
            a = a[np.ix_(rest, rest)] - np.outer(column, column) / a[k, k]
        else:  # the off-diagonal entry outweighs the diagonal, so of this pair's eigenvalues just one is negative
            found += 1
            rest = np.delete(np.arange(n), [p, q])
            pair = a[np.ix_([p, q], [p, q])]
            columns = a[np.ix_(rest, [p, q])]
            a = a[np.ix_(rest, rest)] - columns @ np.linalg.solve(pair, columns.T)
        a = (a + a.T) / 2
    return found


class Slices:
    """Counts of eigenvalues below a shift, remembered; number 1 is the largest eigenvalue."""

    def __init__(self, a: np.ndarray):
        self.a, self.d = a, len(a)
        radius = np.abs(a).sum(1)
        self.norm = float(radius.max(initial=0.0))
        self.least = 4 * self.d * EPS * self.norm  # counts this close to an eigenvalue may go either way
        self.known = {-self.norm - 2 * self.least - 1: 0, self.norm + 2 * self.least + 1: self.d}

    def count(self, shift: float) -> int:
        if shift not in self.known:
            self.known[shift] = below_zero(self.a - shift * np.eye(self.d))
        return self.known[shift]

    def interval(self, number: int) -> tuple[float, float]:
        """Borders around the eigenvalue of this number: alone between them, or as close as counts can tell."""
        below = self.d - number
        while True:
            low = max(s for s, c in self.known.items() if c <= below)
            high = min(s for s, c in self.known.items() if c > below)
            alone = self.known[low] == below and self.known[high] == below + 1
            if alone or high - low <= 2 * self.least:
                return low, high
            self.count((low + high) / 2)

    def halved(self, low: float, high: float, number: int) -> tuple[float, float]:
        middle = (low + high) / 2
        return (middle, high) if self.count(middle) <= self.d - number else (low, middle)


def _solved(a: np.ndarray, shift: float, v: np.ndarray, nudge: float) -> np.ndarray:
    while True:
        try:
            x = np.linalg.solve(a - shift * np.eye(len(a)), v)
            if np.isfinite(x).all():
                return x
        except np.linalg.LinAlgError:
            pass
        shift, nudge = shift + nudge, 2 * nudge


def leading(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues, falling, and their unit vectors as columns. Eigenvalues that are zero but for
    rounding are left out, so there may be fewer."""
    slices = Slices(a)
    values, vectors = [], np.zeros((len(a), 0))
    if slices.norm == 0:
        return np.array(values), vectors
    rng = np.random.default_rng(0)
    for number in range(1, min(k, len(a)) + 1):
        low, high = slices.interval(number)
        if high <= 4 * slices.least:
            break
        while True:
            v = rng.standard_normal(len(a))
            shift, rest = (low + high) / 2, np.inf
            for _ in range(60):
                v = _solved(a, shift, v, slices.least)
                for _ in range(2):  # twice: the first pass leaves rounding errors of the large parts it takes away
                    v -= vectors @ (vectors.T @ v)
                    v /= np.linalg.norm(v)
                shift = float(v @ a @ v)
                before, rest = rest, float(np.linalg.norm(a @ v - shift * v))
                if rest <= slices.least and rest >= before / 2:
                    break
            near = max(2 * rest, slices.least) * 2
            certain = slices.count(shift - near) <= slices.d - number < slices.count(shift + near)
            if certain and rest <= 16 * slices.least:
                break
            if high - low <= slices.least / 4:
                raise ArithmeticError(f"eigenvalue {number} could not be certified")
            low, high = slices.halved(low, high, number)
        if shift <= 4 * slices.least:
            break
        values.append(shift)
        vectors = np.column_stack([vectors, v])
    return np.array(values), vectors
