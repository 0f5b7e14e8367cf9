"""Exact matrix kernel on nested lists, for sizes beyond the closed column forms.

Numbers are taken as the rationals of their decimal text, so rank and determinant are exact.
"""

from __future__ import annotations

import math
from fractions import Fraction

Matrix = list[list[float]]


def rational(x: float | int) -> Fraction:
    return Fraction(x) if isinstance(x, int) else Fraction(repr(float(x)))


def plain(x: Fraction, digits: int = 2) -> float | int:
    """An integer stays one; anything else is rounded."""
    return int(x) if x.denominator == 1 else round(float(x), digits)


def shape(m: Matrix) -> tuple[int, int]:
    """Rows and columns; ValueError if empty or ragged."""
    if not m or not m[0] or any(len(r) != len(m[0]) for r in m):
        raise ValueError("Matrix must be rectangular and not empty")
    return len(m), len(m[0])


def _square(m: Matrix) -> int:
    n, k = shape(m)
    if n != k:
        raise ValueError("Matrix must be square")
    return n


def _eliminate(m: Matrix) -> tuple[int, Fraction, list[list[Fraction]]]:
    """Rank, determinant of the leading square block, and the reduced rows."""
    a = [[rational(x) for x in r] for r in m]
    rank, det = 0, Fraction(1)
    for col in range(len(a[0])):
        pivot = next((i for i in range(rank, len(a)) if a[i][col]), None)
        if pivot is None:
            det = Fraction(0)
            continue
        if pivot != rank:
            a[rank], a[pivot] = a[pivot], a[rank]
            det = -det
        det *= a[rank][col]
        top = [x / a[rank][col] for x in a[rank]]
        a[rank] = top
        for i in range(len(a)):
            if i != rank and a[i][col]:
                f = a[i][col]
                a[i] = [x - f * y for x, y in zip(a[i], top)]
        rank += 1
        if rank == len(a):
            break
    return rank, det, a


def transpose(m: Matrix) -> Matrix:
    shape(m)
    return [list(c) for c in zip(*m)]


def determinant_exact(m: Matrix) -> Fraction:
    n = _square(m)
    if n <= 3:
        a = [[rational(x) for x in r] for r in m]
        if n == 1:
            return a[0][0]
        if n == 2:
            return a[0][0] * a[1][1] - a[0][1] * a[1][0]
        (p, q, r), (s, t, u), (v, w, x) = a
        return p * (t * x - u * w) - q * (s * x - u * v) + r * (s * w - t * v)
    rank, det, _ = _eliminate(m)
    return det if rank == n else Fraction(0)


def determinant(m: Matrix) -> float:
    return round(float(determinant_exact(m)), 2)


def cofactor(m: Matrix) -> Matrix:
    n = _square(m)
    if n == 1:
        return [[1]]
    minor = lambda i, j: [r[:j] + r[j + 1 :] for k, r in enumerate(m) if k != i]
    return [[plain((-1) ** (i + j) * determinant_exact(minor(i, j))) for j in range(n)] for i in range(n)]


def rank(m: Matrix) -> int:
    shape(m)
    return _eliminate(m)[0]


def trace(m: Matrix) -> float:
    return round(float(sum(rational(m[i][i]) for i in range(_square(m)))), 2)


def frobenius(m: Matrix) -> float:
    shape(m)
    return round(math.sqrt(float(sum(rational(x) ** 2 for r in m for x in r))), 2)


def multiply(a: Matrix, b: Matrix) -> Matrix:
    if shape(a)[1] != shape(b)[0]:
        raise ValueError("Inner sizes must agree")
    return [[plain(sum((rational(x) * rational(y) for x, y in zip(row, col)), Fraction(0))) for col in zip(*b)] for row in a]


def solve(a: Matrix, b: list[float]) -> Matrix:
    n = _square(a)
    if len(b) != n:
        raise ValueError("Sizes must agree")
    rank_, _, rows = _eliminate([[*r, x] for r, x in zip(a, b)])
    if rank_ != n or any(rows[i][i] != 1 for i in range(n)):
        raise ValueError("Matrix must be invertible")
    return [[plain(rows[i][n])] for i in range(n)]


def inverse(m: Matrix) -> Matrix:
    n = _square(m)
    rank_, _, rows = _eliminate([[*r, *(1 if i == j else 0 for j in range(n))] for i, r in enumerate(m)])
    if any(rows[i][i] != 1 for i in range(n)):
        raise ValueError("Matrix must be invertible")
    return [[plain(x) for x in r[n:]] for r in rows]
