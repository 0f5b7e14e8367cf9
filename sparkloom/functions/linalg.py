"""Matrix functions as column expressions over ``array<array<double>>``.

Matrices of up to 3 rows and columns are computed by closed forms inside generated code; larger ones
go to Arrow UDFs around the exact kernel, which sees only those. The closed forms alone (``*_small``)
serve inside lambdas, where no UDF can be called, for matrices known to be small. A matrix that a
function isn't defined for gives null, never an exception.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions import exact

MATRIX = "array<array<double>>"


def let(value: Column, f) -> Column:
    """f(value) with the value computed once: it is bound as a lambda's variable, so the plan doesn't repeat it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def fenced(c: Column) -> Column:
    """The column, computed once below the filters on it: they aren't pushed through an expression that depends on the partition, which would copy it to each of its uses."""
    return F.when(F.spark_partition_id() >= 0, c)


def parse(text: Column) -> Column:
    """A JSON matrix, or null."""
    return F.from_json(text, MATRIX)


def at(m: Column, i: int, j: int) -> Column:
    return F.get(F.get(m, F.lit(i)), F.lit(j))


def n_rows(m: Column) -> Column:
    return F.size(m)


def n_cols(m: Column) -> Column:
    return F.size(F.get(m, F.lit(0)))


def is_rectangular(m: Column) -> Column:
    return (F.size(m) > 0) & (n_cols(m) > 0) & F.forall(m, lambda r: F.size(r) == n_cols(m))


def is_square(m: Column) -> Column:
    return (F.size(m) > 0) & F.forall(m, lambda r: F.size(r) == F.size(m))


def transpose(m: Column) -> Column:
    """L1."""
    return F.when(is_rectangular(m), F.transform(F.sequence(F.lit(0), n_cols(m) - 1), lambda j: F.transform(m, lambda r: F.get(r, j))))


def _minor(m: Column, i: int, k: int, j: int, n: int) -> Column:
    return at(m, i, j) * at(m, k, n) - at(m, i, n) * at(m, k, j)


def _det3(m: Column) -> Column:
    return at(m, 0, 0) * _minor(m, 1, 2, 1, 2) - at(m, 0, 1) * _minor(m, 1, 2, 0, 2) + at(m, 0, 2) * _minor(m, 1, 2, 0, 1)


def determinant_small(m: Column) -> Column:
    """L3, up to 3x3."""
    d = F.when(F.size(m) == 1, at(m, 0, 0)).when(F.size(m) == 2, _minor(m, 0, 1, 0, 1)).when(F.size(m) == 3, _det3(m))
    return F.when(is_square(m), F.round(d, 2))


def cofactor_small(m: Column) -> Column:
    """L2, up to 3x3."""
    two = F.array(F.array(at(m, 1, 1), -at(m, 1, 0)), F.array(-at(m, 0, 1), at(m, 0, 0)))
    rest = {0: (1, 2), 1: (0, 2), 2: (0, 1)}
    three = F.array(*[F.array(*[_minor(m, *rest[i], *rest[j]) * (1 if (i + j) % 2 == 0 else -1) for j in range(3)]) for i in range(3)])
    c = F.when(F.size(m) == 1, F.array(F.array(F.lit(1.0)))).when(F.size(m) == 2, two).when(F.size(m) == 3, three)
    return F.when(is_square(m), F.transform(c, lambda r: F.transform(r, lambda x: F.round(x, 2) + 0.0)))


def trace(m: Column) -> Column:
    """L6, any size."""
    diagonal = F.transform(m, lambda r, i: F.get(r, i))
    return F.when(is_square(m), F.round(F.aggregate(diagonal, F.lit(0.0), lambda a, x: a + x), 2))


def frobenius(m: Column) -> Column:
    """L4, any size."""
    return F.when(is_rectangular(m), F.round(F.sqrt(F.aggregate(F.flatten(m), F.lit(0.0), lambda a, x: a + x * x)), 2))


def rank_small(m: Column) -> Column:
    """L5, up to 3 rows and columns, by minors."""
    pairs = [(0, 1), (0, 2), (1, 2)]
    some2 = F.coalesce(*[F.when(_minor(m, *p, *q) != 0, F.lit(True)) for p in pairs for q in pairs], F.lit(False))
    some1 = F.exists(F.flatten(m), lambda x: x != 0)
    r = F.when(F.coalesce(_det3(m) != 0, F.lit(False)), 3).when(some2, 2).when(some1, 1).otherwise(0)
    return F.when(is_rectangular(m) & (n_rows(m) <= 3) & (n_cols(m) <= 3), r)


def multiply(a: Column, b: Column) -> Column:
    """L7."""
    dot = lambda r, c: F.aggregate(F.zip_with(r, c, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    columns = lambda t: F.transform(a, lambda r: F.transform(t, lambda c: F.round(dot(r, c), 2)))
    return F.when(is_rectangular(a) & is_rectangular(b) & (n_cols(a) == n_rows(b)), let(transpose(b), columns))


def inverse_small(m: Column) -> Column:
    """L9, up to 3x3: transposed cofactors over the determinant."""

    def divided(c: Column) -> Column:
        d = c["d"]
        return F.when(d != 0, F.transform(transpose(c["c"]), lambda r: F.transform(r, lambda x: F.round(x / d, 2) + 0.0)))

    return let(F.struct(cofactor_small(m).alias("c"), determinant_small(m).alias("d")), divided)


def solve_small(m: Column, b: Column) -> Column:
    """L8, up to 3x3, as a column: the exact adjugate applied to b, over the determinant."""

    def applied(c: Column) -> Column:
        d = c["d"]
        dot = lambda r: F.aggregate(F.zip_with(r, c["b"], lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        return F.when((d != 0) & (F.size(c["b"]) == F.size(c["c"])), F.transform(transpose(c["c"]), lambda r: F.array(F.round(dot(r) / d, 2) + 0.0)))

    return let(F.struct(cofactor_small(m).alias("c"), determinant_small(m).alias("d"), b.alias("b")), applied)


def is_small(m: Column) -> Column:
    """Whether the closed forms cover a matrix."""
    return (n_rows(m) <= 3) & (n_cols(m) <= 3)


def _large(m: Column) -> Column:
    """What the UDFs get to see: null for small matrices."""
    return F.when(~is_small(m), m)


def determinant(m: Column) -> Column:
    """L3, any size."""
    return F.when(is_small(m), determinant_small(m)).otherwise(determinant_any(_large(m)))


def cofactor(m: Column) -> Column:
    """L2, any size."""
    return F.when(is_small(m), cofactor_small(m)).otherwise(matrix_any(exact.cofactor)(_large(m)))


def rank(m: Column) -> Column:
    """L5, any size and shape."""
    return F.when(is_small(m), rank_small(m).cast("bigint")).otherwise(rank_any(_large(m)))


def inverse(m: Column) -> Column:
    """L9, any size."""
    return F.when(is_small(m), inverse_small(m)).otherwise(matrix_any(exact.inverse)(_large(m)))


def solve(m: Column, b: Column) -> Column:
    """L8, any size, as a column."""
    return F.when(is_small(m), solve_small(m, b)).otherwise(solve_any(_large(m), b))


def compact(m: Column) -> Column:
    """A matrix as text for reports: rows by semicolons, whole numbers without decimals."""
    cell = lambda x: F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(F.round(x, 2).cast("string"))
    return F.array_join(F.transform(m, lambda r: F.array_join(F.transform(r, cell), ",")), ";")


def as_json(m: Column) -> Column:
    """A matrix as JSON with a blank after each comma."""
    cell = lambda x: F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))
    return F.concat(F.lit("[["), F.array_join(F.transform(m, lambda r: F.array_join(F.transform(r, cell), ", ")), "], ["), F.lit("]]"))


def _exact(f, plain: bool = True):
    def run(values: pd.Series) -> pd.Series:
        def one(m):
            try:
                return f([[float(x) for x in r] for r in m] if plain else m)
            except (ValueError, TypeError, ZeroDivisionError):
                return None

        return values.map(lambda m: None if m is None else one(m))

    return run


def determinant_any(m: Column) -> Column:
    return F.pandas_udf(_exact(exact.determinant), T.DoubleType())(m)


def rank_any(m: Column) -> Column:
    return F.pandas_udf(_exact(exact.rank), T.LongType())(m)


def matrix_any(f):
    """A one-matrix function of the exact kernel as an Arrow UDF."""
    return F.pandas_udf(_exact(lambda m: [[float(x) for x in r] for r in f(m)]), T.ArrayType(T.ArrayType(T.DoubleType())))


def solve_any(m: Column, b: Column) -> Column:
    def run(ms: pd.Series, bs: pd.Series) -> pd.Series:
        one = _exact(lambda x: [[float(v) for v in r] for r in exact.solve(*x)], plain=False)
        return one(pd.Series([None if m is None or b is None else ([[float(x) for x in r] for r in m], [float(x) for x in b]) for m, b in zip(ms, bs)], dtype=object))

    return F.pandas_udf(run, T.ArrayType(T.ArrayType(T.DoubleType())))(m, b)


#: Names of the registry's tools, with what they return and compute.
KERNEL = {
    "determinant": ("number", exact.determinant), "frobenius_norm": ("number", exact.frobenius), "matrix_cofactor": ("matrix", exact.cofactor), "matrix_rank": ("integer", exact.rank),
    "matrix_trace": ("number", exact.trace), "matrix_transpose": ("matrix", exact.transpose),
}
TOOLS = tuple(KERNEL)
_DESCRIBED = {"determinant": "determinant of a square matrix", "frobenius_norm": "Frobenius norm of a matrix", "matrix_cofactor": "cofactor matrix of a square matrix", "matrix_rank": "rank of a matrix", "matrix_trace": "trace of a square matrix", "matrix_transpose": "transpose of a matrix"}


def tool_schemas() -> list[dict]:
    """The registry as JSON schemas of function tools."""
    matrix = {"type": "array", "items": {"type": "array", "items": {"type": "number"}}}
    return [
        {"type": "function", "function": {"name": n, "description": f"The {_DESCRIBED[n]}.", "parameters": {"type": "object", "properties": {"matrix": matrix}, "required": ["matrix"]}, "returns": kind}} for n, (kind, _) in KERNEL.items()
    ]


def return_kind_ok(name: Column, result: Column) -> Column:
    """Whether a result's text is of the kind its tool returns; null for unknown tools."""
    patterns = {"number": r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$", "integer": r"^\d+$", "matrix": r"(?s)^\[\s*\[.*\]\s*\]$"}
    out = F.lit(None).cast("boolean")
    for n, (kind, _) in KERNEL.items():
        out = F.when(name == n, F.coalesce(F.trim(result).rlike(patterns[kind]), F.lit(False))).otherwise(out)
    return out


def execute_small(name: Column, m: Column, error: str = "ERROR: ", kind: str = "ValueError: ") -> Column:
    """A tool by its name for matrices of up to 3 rows and columns, as text; errors are text too."""
    square, shape = F.lit(f"{error}{kind}Matrix must be square"), F.lit(f"{error}{kind}Matrix must be rectangular")

    def chosen(v: Column) -> Column:
        name, m = v["name"], v["m"]
        return (
            F.when(~F.coalesce(name.isin(*TOOLS), F.lit(False)), F.concat(F.lit(f"{error}Function '"), F.coalesce(name, F.lit("None")), F.lit("' not found in library")))
            .when(~F.coalesce(is_rectangular(m), F.lit(False)), shape)
            .when(name == "matrix_transpose", let(transpose(m), as_json))
            .when(name == "frobenius_norm", frobenius(m).cast("string"))
            .when(name == "matrix_rank", rank_small(m).cast("string"))
            .when(~is_square(m), square)
            .when(name == "matrix_cofactor", let(cofactor_small(m), as_json))
            .when(name == "determinant", determinant_small(m).cast("string"))
            .otherwise(trace(m).cast("string"))
        )

    return let(F.struct(name.alias("name"), m.alias("m")), chosen)


def execute(name: Column, m: Column, error: str = "ERROR: ", kind: str = "ValueError: ") -> Column:
    """A tool by its name, for any size."""

    def run(names: pd.Series, ms: pd.Series) -> pd.Series:
        def one(n, m):
            if m is None or n not in KERNEL:
                return None
            m = [[float(x) for x in r] for r in m]
            try:
                exact.shape(m)
            except ValueError:
                return f"{error}{kind}Matrix must be rectangular"
            try:
                value = KERNEL[n][1](m)
            except ValueError as e:
                return f"{error}{kind}{e}"
            return "[" + ", ".join("[" + ", ".join(shown(x) for x in r) + "]" for r in value) + "]" if isinstance(value, list) else str(value)

        return pd.Series([one(n, m) for n, m in zip(names, ms)], dtype=object)

    large = F.pandas_udf(run, T.StringType())(name, _large(m))
    return F.coalesce(large, execute_small(name, m, error, kind))


def shown(x: float) -> str:
    """A matrix entry as as_json() writes it."""
    return str(int(x)) if float(x) == int(x) else str(x)
