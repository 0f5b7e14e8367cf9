"""Parsing and comparing answers: numbers and matrices written as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.functions.text import strip

#: Answers are equal if they agree to this distance.
TOLERANCE = 1e-6
LITERAL = r"^-?(?:\d[\d_]*\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"


def cells(text: Column) -> Column:
    """The numbers of a literal row by row, array<array<double>>; a scalar is [[x]], a flat list a column. Null if it is no literal."""
    t = F.translate(strip(text), "()−", "[]-")
    scalar = F.when(t.rlike(LITERAL), F.array(F.array(F.regexp_replace(t, "_", "").cast("double"))))
    single = F.size(F.from_json(F.concat(F.lit("["), t, F.lit("]")), "array<string>")) == 1  # nothing may follow the value
    flat = F.transform(F.from_json(F.when(single & t.rlike(r"(?s)^\[\s*[^\[]"), t), "array<double>"), lambda x: F.array(x))
    grid = F.from_json(F.when(single & t.rlike(r"(?s)^\[\s*\["), t), "array<array<double>>")
    return F.coalesce(scalar, flat, grid)


def is_scalar(text: Column) -> Column:
    return F.coalesce(F.translate(strip(text), "−", "-").rlike(LITERAL), F.lit(False))


def equal(a: Column, b: Column, tolerance: float = TOLERANCE) -> Column:
    """Whether two texts state the same value; false if either states none. A scalar differs from a 1x1 matrix."""
    x, y = cells(a), cells(b)
    rows = lambda m: F.transform(m, lambda r: F.size(r))
    near = F.forall(F.zip_with(F.flatten(x), F.flatten(y), lambda p, q: F.abs(p - q) <= tolerance), lambda ok: F.coalesce(ok, F.lit(False)))
    return F.coalesce((is_scalar(a) == is_scalar(b)) & (rows(x) == rows(y)) & near, F.lit(False))
