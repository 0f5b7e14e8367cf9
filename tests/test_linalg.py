"""Matrix functions against the exact kernel and known values."""

import json
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import exact, linalg

KNOWN = [
    ("matrix_transpose", [[1, 2, 3], [4, 5, 6]], "[[1, 4], [2, 5], [3, 6]]"), ("matrix_transpose", [[1]], "[[1]]"),
    ("matrix_cofactor", [[1, 2], [3, 4]], "[[4, -3], [-2, 1]]"), ("matrix_cofactor", [[1]], "[[1]]"),
    ("determinant", [[1, 2], [3, 4]], "-2.0"), ("determinant", [[2, 0], [0, 3]], "6.0"), ("determinant", [[5]], "5.0"),
    ("determinant", [[1, 2, 3], [4, 5, 6]], "ERROR: ValueError: Matrix must be square"),
    ("frobenius_norm", [[1, 2], [3, 4]], "5.48"), ("frobenius_norm", [[0, 0], [0, 0]], "0.0"),
    ("matrix_rank", [[1, 2], [3, 4]], "2"), ("matrix_rank", [[1, 2], [2, 4]], "1"), ("matrix_trace", [[1, 2], [3, 4]], "5.0"), ("matrix_trace", [[5]], "5.0"),
    ("nothing", [[1]], "ERROR: Function 'nothing' not found in library"),
]


def test_known_values(spark):
    df = spark.createDataFrame([(t, [[float(x) for x in r] for r in m]) for t, m, _ in KNOWN], "tool string, m array<array<double>>")
    got = [r["r"] for r in df.select(linalg.execute(F.col("tool"), F.col("m")).alias("r")).collect()]
    assert got == [e for *_, e in KNOWN]


def test_closed_forms_equal_exact_kernel(spark):
    rng = random.Random(5)
    ms = [[[float(rng.randint(-9, 9)) for _ in range(c)] for _ in range(r)] for r in (1, 2, 3) for c in (1, 2, 3) for _ in range(12)]
    ms += [[[1.0, 2.0], [2.0, 4.0]], [[0.0, 0.0, 0.0]] * 3, [[1.0, 2.0, 3.0], [2.0, 4.0, 6.0], [1.0, 0.0, 1.0]]]
    m = F.col("m")
    df = spark.createDataFrame([(x,) for x in ms], "m array<array<double>>")
    rows = df.select("m", linalg.determinant(m).alias("d"), linalg.rank(m).alias("r"), linalg.cofactor(m).alias("c"), linalg.inverse(m).alias("i"), linalg.rank_any(m).alias("ra"), linalg.determinant_any(m).alias("da")).collect()
    for x in rows:
        a = x["m"]
        assert x["r"] == x["ra"] == exact.rank(a)
        if len(a) != len(a[0]):
            assert x["d"] is None and x["c"] is None and x["da"] is None
            continue
        assert x["d"] == x["da"] == exact.determinant(a)
        assert x["c"] == exact.cofactor(a)
        if x["d"]:
            assert all(abs(p - q) <= 0.011 for r, t in zip(x["i"], exact.inverse(a)) for p, q in zip(r, t))
        else:
            assert x["i"] is None


def test_undefined_matrices_give_null(spark):
    m = F.col("m")
    df = spark.createDataFrame([(None,), ([],), ([[]],), ([[1.0, 2.0], [3.0]],)], "m array<array<double>>")
    assert all(r[0] is None and r[1] is None and r[2] is None for r in df.select(linalg.determinant(m), linalg.transpose(m), linalg.frobenius(m)).collect())


def test_dormant_functions(spark):
    df = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0]], [[2.0, 0.0], [1.0, 3.0]], [[2.0, 1.0], [1.0, 3.0]], [7.0, 8.0])], "a array<array<double>>, b array<array<double>>, c array<array<double>>, d array<double>")
    r = df.select(linalg.multiply(F.col("a"), F.col("b")).alias("p"), linalg.solve(F.col("c"), F.col("d")).alias("s"), linalg.inverse(F.col("a")).alias("i")).first()
    assert r["p"] == [[4.0, 6.0], [10.0, 12.0]] and r["s"] == [[2.6], [1.8]] and r["i"] == [[-2.0, 1.0], [1.5, -0.5]]
    assert exact.multiply([[1, 2], [3, 4]], [[5], [6]]) == [[17], [39]] and exact.solve([[2, 1], [1, 3]], [7, 8]) == [[2.6], [1.8]] and exact.inverse([[2, 0], [0, 3]]) == [[0.5, 0], [0, 0.33]]


def test_exact_determinant_of_larger_sizes():
    rng = random.Random(1)

    def expand(m):
        return m[0][0] if len(m) == 1 else sum((-1) ** j * m[0][j] * expand([r[:j] + r[j + 1 :] for r in m[1:]]) for j in range(len(m)))

    for n in (4, 5):
        m = [[rng.randint(-5, 5) for _ in range(n)] for _ in range(n)]
        assert exact.determinant_exact(m) == Fraction(expand(m))
    with pytest.raises(ValueError):
        exact.determinant([[1, 2]])


def test_json_round_trip(spark):
    m = [[1.0, -2.5], [3.0, 4.0]]
    df = spark.createDataFrame([(json.dumps(m),)], "t string")
    assert df.select(linalg.parse(F.col("t")).alias("m")).first()["m"] == m


def test_every_tool_at_every_size(spark):
    """4x4, 4x2, 2x4, singular, ragged and empty matrices through execute(), against the exact kernel."""
    rng = random.Random(9)
    ms = [[[float(rng.randint(-9, 9)) for _ in range(c)] for _ in range(r)] for r, c in ((4, 4), (4, 2), (2, 4), (5, 5), (3, 3), (1, 6))]
    ms += [[[(2.0, 3.0, 1.0, 1.0)[i] * (i == j) for j in range(4)] for i in range(4)], [[1.0] * 4] * 4, [[1.0, 2.0], [3.0]], []]
    rows = [(t, m) for t in linalg.TOOLS for m in ms]
    df = spark.createDataFrame(rows, "tool string, m array<array<double>>")
    got = [r["r"] for r in df.select(linalg.execute(F.col("tool"), F.col("m")).alias("r")).collect()]

    def expected(tool, m):
        try:
            exact.shape(m)
        except ValueError:
            return "ERROR: ValueError: Matrix must be rectangular"
        try:
            value = linalg.KERNEL[tool][1](m)
        except ValueError as e:
            return f"ERROR: ValueError: {e}"
        return [[float(x) for x in r] for r in value] if isinstance(value, list) else float(value)

    def parsed(text):
        return text if text.startswith("ERROR") else [[float(x) for x in r] for r in json.loads(text)] if text.startswith("[") else float(text)

    assert [parsed(g) for g in got] == [expected(t, m) for t, m in rows]
    m = F.col("m")
    four = spark.createDataFrame([(ms[6], [2.0, 3.0, 1.0, 1.0])], "m array<array<double>>, b array<double>").select(linalg.determinant(m).alias("d"), linalg.rank(m).alias("r"), linalg.inverse(m).alias("i"), linalg.solve(m, F.col("b")).alias("x")).first()
    assert four["d"] == 6.0 and four["r"] == 4 and four["i"][0][0] == 0.5 and four["x"] == [[1.0]] * 4
