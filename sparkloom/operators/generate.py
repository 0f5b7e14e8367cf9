"""Deterministic generation of questions: every value is a hash of seed, type and index.

Rows come from a range crossed with a small table of recipes; entries are uniform over the
admissible values, so nothing is drawn twice; composite recipes chain column expressions.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions import linalg

SEED = 146959810

#: Recipes, tool by tool, with the entropy that sets the size of their entries.
RECIPES = (
    ("one_determinant", ("D",), 0.9), ("one_matrix_trace", ("S",), 2.1), ("one_frobenius_norm", ("F",), 2.6), ("one_matrix_rank", ("R",), 2.5),
    ("one_matrix_transpose", ("T",), 3.2), ("one_matrix_cofactor", ("C",), 1.6),
    ("two_transpose_determinant", ("T", "D"), 0.7), ("two_cofactor_trace", ("C", "S"), 1.4), ("two_cofactor_rank", ("C", "R"), 1.5), ("two_transpose_frobenius", ("T", "F"), 2.8),
    ("three_transpose_cofactor_rank", ("T", "C", "R"), 3.2), ("three_cofactor_transpose_trace", ("C", "T", "S"), 2.9), ("three_transpose_cofactor_frobenius", ("T", "C", "F"), 2.9),
)
DEFAULT_ROWS = {1: 770, 2: 990, 3: 660}
TOOL = {"T": "matrix_transpose", "C": "matrix_cofactor", "D": "determinant", "F": "frobenius_norm", "R": "matrix_rank", "S": "matrix_trace"}
DIFFICULTY = {1: "ONE_TOOL_CALL", 2: "TWO_TOOL_CALLS", 3: "THREE_TOOL_CALLS"}
#: Recipes that are known but not drawn by default.
DORMANT = (("two_cofactor_frobenius", ("C", "F"), 1.5), ("two_cofactor_determinant", ("C", "D"), 0.7), ("three_transpose_cofactor_trace", ("T", "C", "S"), 2.9), ("three_cofactor_transpose_determinant", ("C", "T", "D"), 0.7))
#: Three wordings of a question for each operation (G13); {v} is the verb, {x} the matrix' letter, {m} what stands for it.
WORDINGS = {
    "D": ("{v} the determinant of matrix {x}, where {x} = {m}.", "Given {x} = {m}, what is det({x})?", "For the matrix {x} = {m}, work out det({x})."),
    "S": ("{v} the trace of matrix {x}, where {x} = {m}.", "Given {x} = {m}, what is tr({x})?", "For the matrix {x} = {m}, add up the diagonal to get tr({x})."),
    "F": ("{v} the Frobenius norm of matrix {x}, where {x} = {m}.", "Given {x} = {m}, what is ||{x}||_F?", "For the matrix {x} = {m}, work out ||{x}||_F."),
    "R": ("{v} the rank of matrix {x}, where {x} = {m}.", "Given {x} = {m}, what is rank({x})?", "For the matrix {x} = {m}, work out rank({x})."),
    "T": ("{v} the transpose of matrix {x}, where {x} = {m}.", "Given {x} = {m}, what is its transpose?", "For the matrix {x} = {m}, swap rows and columns."),
    "C": ("{v} the cofactor matrix of {x}, where {x} = {m}.", "Given {x} = {m}, what is its cofactor matrix?", "For the matrix {x} = {m}, work out all cofactors."),
}
VERBS = ("Compute", "Find", "Calculate", "Evaluate", "Determine")


def uniform(*keys: Column) -> Column:
    """A number in [0, 1) by hash."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 11) / F.lit(float(1 << 53))


def integer(entropy: Column, *keys: Column, least: int = 1) -> Column:
    """G1: a whole number of the entropy's range, at least ``least`` in size, uniform over the admissible ones."""
    most = F.ceil((F.pow(F.lit(10.0), entropy) + least) / 2)
    size = least + F.floor(uniform(F.lit(1), *keys) * (most - least + 1))
    return F.when(uniform(F.lit(2), *keys) < 0.5, -size).otherwise(size).cast("double")


def matrix(entropy: Column, n: Column, *keys: Column) -> Column:
    """A square matrix of such numbers."""
    side = F.sequence(F.lit(0), n - 1)
    return F.transform(side, lambda i: F.transform(side, lambda j: integer(entropy, *keys, i, j)))


_STEP = {"T": linalg.transpose, "C": linalg.cofactor_small, "D": linalg.determinant_small, "F": linalg.frobenius, "R": linalg.rank_small, "S": linalg.trace}  # generated matrices are small


def _json(letter: str, value: Column) -> Column:
    return linalg.as_json(value) if letter in "TC" else value.cast("string")


def questions(spark: SparkSession, rows: dict[int, int] | None = None, seed: int = SEED, recipes: tuple = RECIPES) -> DataFrame:
    """The given number of rows for each recipe of one, two and three steps, with their steps and golden answer. G15: pass DORMANT as further recipes."""
    rows = rows or DEFAULT_ROWS
    frames = []
    for problem, letters, entropy in recipes:
        n = F.lit(2) if len(letters) == 3 else 2 + F.floor(uniform(F.lit(seed), F.lit(problem), F.col("i"), F.lit("n")) * 2).cast("int")
        d = spark.range(rows[len(letters)]).select(F.col("id").alias("i"))
        d = d.withColumn("m", matrix(F.lit(entropy), n, F.lit(seed), F.lit(problem), F.col("i")))
        value, steps = F.col("m"), []
        for k, letter in enumerate(letters):
            d = d.withColumn(f"r{k}", _STEP[letter](value))
            depends = F.create_map(F.lit("input_matrix"), F.lit(k - 1)) if k else F.lit(None).cast("map<string,int>")
            steps.append(F.struct(F.lit(TOOL[letter]).alias("tool"), _json(letter, F.col(f"r{k}")).alias("result"), F.lit(str(k)).alias("step_id"), depends.alias("dependent_on")))
            value = F.col(f"r{k}")
        verb = F.element_at(F.array(*[F.lit(v) for v in VERBS]), 1 + F.floor(uniform(F.lit(seed), F.lit(problem), F.col("i"), F.lit("v")) * len(VERBS)).cast("int"))
        pick = lambda letter, k, shown: F.element_at(
            F.array(*[F.format_string(w.format(v="%1$s", x="ABCDEFGHIJK"[k], m="%2$s"), verb, shown) for w in WORDINGS[letter]]), 1 + F.floor(uniform(F.lit(seed), F.lit(problem), F.col("i"), F.lit(f"w{k}")) * 3).cast("int")
        )
        parts = [pick(letter, k, linalg.as_json(F.col("m")) if k == 0 else F.lit(f"the result from step {k}")) for k, letter in enumerate(letters)]
        asked = parts[0] if len(parts) == 1 else F.concat_ws("\n", *[F.concat(F.lit(f"Step {k}: "), F.lower(F.substring(p, 1, 1)), F.substr(p, F.lit(2))) for k, p in enumerate(parts, 1)])
        frames.append(
            d.select(
                F.col("i"), F.lit(problem).alias("problem_type"), asked.alias("question"), F.lit(DIFFICULTY[len(letters)]).alias("difficulty"), F.lit(float(entropy)).alias("entropy_used"),
                F.lit(len(letters)).alias("tool_calls_required"), linalg.fenced(F.array(*steps)).alias("stepwise"), linalg.fenced(steps[-1]["result"]).alias("final_answer"), linalg.fenced(F.col("m")).alias("matrix"),
            )
        )
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def verified(df: DataFrame) -> DataFrame:
    """V1-V3, V6: whether each generated row's steps come out again from their JSON inputs, by the exact kernel and not by the forms that made them, and its golden answer is the last step."""

    def run(steps: pd.Series, starts: pd.Series, finals: pd.Series) -> pd.Series:
        def one(held, start, final) -> bool:
            results: list = []
            for s in held:
                before = (s["dependent_on"] or {}) if not isinstance(s["dependent_on"], list) else dict(s["dependent_on"])
                at = before.get("input_matrix")
                if at is not None and not 0 <= at < len(results):
                    return False
                try:
                    value = linalg.KERNEL[s["tool"]][1](json.loads(start if at is None else results[at]))
                except (KeyError, ValueError, TypeError):
                    return False
                if not same_value(value, json.loads(s["result"])):
                    return False
                results.append(s["result"])
            return bool(results) and results[-1] == final

        return pd.Series([one(h, s, f) for h, s, f in zip(steps, starts, finals)])

    return df.withColumn("is_valid", F.pandas_udf(run, T.BooleanType())(F.col("stepwise"), linalg.as_json(F.col("matrix")), F.col("final_answer")))


def same_value(a, b, tolerance: float = 0.005) -> bool:
    """Whether two numbers or matrices agree to the rounding of results."""
    if isinstance(a, list) != isinstance(b, list):
        return False
    if isinstance(a, list):
        return len(a) == len(b) and all(same_value(x, y, tolerance) for x, y in zip(a, b))
    return abs(a - b) <= tolerance + 1e-9


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor of two whole numbers by Euclid's steps; 46 suffice for 32 bits."""
    step = lambda s, _: F.struct(s["b"].alias("a"), F.when(s["b"] == 0, F.lit(0).cast("bigint")).otherwise(s["a"] % s["b"]).alias("b"))
    # after b reaches 0, a must stay
    kept = lambda s, i: F.when(s["b"] == 0, s).otherwise(step(s, i))
    return F.aggregate(F.sequence(F.lit(1), F.lit(46)), F.struct(F.abs(a.cast("bigint")).alias("a"), F.abs(b.cast("bigint")).alias("b")), kept, lambda s: s["a"])


def admissible_integer(entropy: Column, *keys: Column, signed: bool = True, least: int = 0, coprime_to: Column | None = None) -> Column:
    """G1: a whole number of the entropy's range, uniform over those of at least ``least`` in size that share no factor with ``coprime_to``; null if there is none."""
    top = F.pow(F.lit(10.0), entropy) + least
    if coprime_to is not None:
        from sparkloom.functions.text import coprime_density

        c = F.abs(coprime_to.cast("bigint"))
        top = F.when(c >= 2, top / coprime_density(c) + 1).otherwise(top)
    most = F.ceil(top / 2) if signed else F.ceil(top)
    low = -most if signed else F.lit(least).cast("bigint")
    ok = lambda v: (F.abs(v) >= least) & (F.lit(True) if coprime_to is None else gcd(v, coprime_to) == 1)
    values = F.filter(F.sequence(low, most), ok)
    return linalg.let(values, lambda v: F.get(v, F.floor(uniform(F.lit(7), *keys) * F.size(v)).cast("int")))


def rational(entropy: Column, *keys: Column, signed: bool = True) -> Column:
    """Numerator and denominator, at least 2 and without common factor, sharing the entropy between them."""
    share = uniform(F.lit(8), *keys)
    numerator = admissible_integer(entropy * share, F.lit("n"), *keys, signed=signed, least=1)
    return linalg.let(numerator, lambda n: F.struct(n.alias("numerator"), admissible_integer(entropy * (1 - share), F.lit("d"), *keys, signed=False, least=2, coprime_to=n).alias("denominator")))


def drawn_entropy(low: Column, high: Column, *keys: Column, centred: bool = False) -> Column:
    """An entropy of a range, uniform, or drawn to its centre: Beta(2, 2) is the middle one of three uniform numbers."""
    u = [uniform(F.lit(f"e{i}"), *keys) for i in range(3)]
    x = sum(u, F.lit(0.0)) - F.greatest(*u) - F.least(*u) if centred else u[0]
    return low + (high - low) * x


def split_counts(count: int, total: Column, *keys: Column) -> Column:
    """``count`` whole numbers of at least 1 with a sum, uniform: cut places are the first of a hashed order; null if the sum is too small."""
    places = F.transform(F.array_sort(F.transform(F.sequence(F.lit(1), F.greatest(total - 1, F.lit(1))), lambda i: F.struct(F.xxhash64(F.lit("cut"), *keys, i).alias("h"), i.alias("i")))), lambda x: x["i"])
    cuts = F.array_sort(F.slice(places, 1, count - 1)) if count > 1 else F.array().cast("array<int>")
    ends = F.concat(F.array(F.lit(0)), F.transform(cuts, lambda x: x.cast("int")), F.array(total.cast("int")))
    return F.when(total >= count, F.transform(F.sequence(F.lit(1), F.lit(count)), lambda i: F.get(ends, i) - F.get(ends, i - 1)))


def split_entropy(entropy: Column, counts: Column, *keys: Column, least_share: float = 0.0) -> Column:
    """The entropy over components by a Dirichlet draw with whole parameters (sums of exponential draws), each with at least a share."""
    draw = lambda i, j: -F.log(1 - uniform(F.lit("g"), *keys, i, j) + 1e-300)
    gammas = F.transform(counts, lambda k, i: F.aggregate(F.transform(F.sequence(F.lit(1), k), lambda j: draw(i, j)), F.lit(0.0), lambda s, x: s + x))
    total = lambda g: F.aggregate(g, F.lit(0.0), lambda s, x: s + x)
    return linalg.let(gammas, lambda g: F.transform(g, lambda x: entropy * (F.least(F.lit(least_share), 1 / F.size(g)) + (1 - F.least(F.lit(least_share), 1 / F.size(g)) * F.size(g)) * x / total(g))))


def within_budget(parts: Column, total: Column, slack: float = 1e-12) -> Column:
    """Whether the components' entropies stay within the budget."""
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x) <= total + slack


def invertible_matrix(entropy: Column, n: Column, *keys: Column, tries: int = 20) -> Column:
    """The first of several matrices whose determinant isn't 0; null if all are singular."""
    made = F.transform(F.sequence(F.lit(0), F.lit(tries - 1)), lambda t: matrix(entropy, n, *keys, t))
    return F.get(F.filter(made, lambda m: linalg.determinant_small(m) != 0), F.lit(0))


def merged_constraints(given: dict, mandatory: dict) -> dict:
    """Constraints of a generator with the mandatory ones of its recipe; a key that both set differently is an error, ranges must be ranges."""
    clash = sorted(k for k in given.keys() & mandatory.keys() if given[k] is not None and mandatory[k] is not None and given[k] != mandatory[k])
    if clash:
        raise ValueError(f"constraints differ: {', '.join(clash)}")
    out = {k: v for k, v in {**given, **{k: v for k, v in mandatory.items() if v is not None}}.items() if v is not None}
    for k in ("rows", "cols", "size"):
        if k in out and (not isinstance(out[k], int) or out[k] < 1):
            raise ValueError(f"{k} must be a positive whole number")
    if "entropy" in out:
        low, high = out["entropy"] if isinstance(out["entropy"], tuple) else (out["entropy"],) * 2
        if not 0 <= low <= high:
            raise ValueError("entropy must be a range of numbers of at least 0")
    return out


def mixed_radix(index: Column, sizes: list[int]) -> list[Column]:
    """The digits of a flat index in a system of mixed radices, the last one fastest, so that a grid needs no join."""
    out, rest = [], 1
    for size in reversed(sizes):
        out.append((F.floor(index / F.lit(rest)) % size).cast("int"))
        rest *= size
    return out[::-1]


def template_samples(spark: SparkSession, recipe: tuple[str, ...]) -> DataFrame:
    """Every combination of wordings of a recipe once: place, wordings, text."""
    sizes = [len(WORDINGS[letter]) for letter in recipe]
    total = 1
    for n in sizes:
        total *= n
    digits = mixed_radix(F.col("place"), sizes)
    shown = lambda k: "{matrix}" if k == 0 else f"the result from step {k}"
    texts = [F.element_at(F.array(*[F.lit(w.format(v=VERBS[0], x="ABCDEFGHIJK"[k], m=shown(k))) for w in WORDINGS[letter]]), d + 1) for k, (letter, d) in enumerate(zip(recipe, digits))]
    stepped = texts if len(texts) == 1 else [F.concat(F.lit(f"Step {k}: "), F.lower(F.substring(t, 1, 1)), F.substr(t, F.lit(2))) for k, t in enumerate(texts, 1)]
    return spark.range(total).select(F.col("id").alias("place"), F.array(*digits).alias("wordings"), F.concat_ws("\n", *stepped).alias("text"))


def dormant_questions(spark: SparkSession, rows: int, seed: int = SEED) -> DataFrame:
    """Products, systems and inverses: i, problem_type, matrix, other (right-hand side or factor), result as JSON."""
    i = F.col("i")
    d = spark.range(rows).select(F.col("id").alias("i")).withColumn("n", 2 + (i % 2).cast("int"))
    d = d.withColumn("a", invertible_matrix(F.lit(1.0), F.col("n"), F.lit(seed), F.lit("a"), i)).withColumn("b", matrix(F.lit(1.0), F.col("n"), F.lit(seed), F.lit("b"), i)).filter("a is not null")
    column = F.transform("b", lambda r: F.slice(r, 1, 1))
    first = F.transform("b", lambda r: F.get(r, F.lit(0)))
    made = (
        ("matrix_matrix_multiplication", F.col("b"), linalg.multiply(F.col("a"), F.col("b"))), ("matrix_vector_multiplication", column, linalg.multiply(F.col("a"), column)),
        ("linear_system_solver", column, linalg.solve_small(F.col("a"), first)), ("matrix_inverse", F.lit(None).cast(linalg.MATRIX), linalg.inverse_small(F.col("a"))),
    )
    kinds = F.explode(F.array(*[F.struct(F.lit(name).alias("problem_type"), other.alias("other"), value.alias("value")) for name, other, value in made]))
    out = d.select("i", "a", kinds.alias("k"))
    return out.select("i", "k.problem_type", linalg.as_json(F.col("a")).alias("matrix"), linalg.as_json(F.col("k.other")).alias("other"), linalg.as_json(F.col("k.value")).alias("result"))


def grid_statistics(spark: SparkSession, letter: str, axis: list[float], samples: int, size: int = 2, seed: int = SEED) -> DataFrame:
    """For each entropy of the axis, the range of a tool's values over samples: run, entropy, n, min_value, max_value, and rows that gave none."""
    digits = mixed_radix(F.col("id"), [len(axis), samples])
    d = spark.range(len(axis) * samples).select(digits[0].alias("run"), digits[1].alias("i"))
    d = d.withColumn("entropy", F.element_at(F.array(*[F.lit(float(x)) for x in axis]), F.col("run") + 1))
    m = matrix(F.col("entropy"), F.lit(size), F.lit(seed), F.col("run"), F.col("i"))
    value = _STEP[letter](m)
    v = d.select("run", "entropy", linalg.fenced(F.flatten(value) if letter in "TC" else F.array(value.cast("double"))).alias("v"))
    return v.groupBy("run", "entropy").agg(F.count("*").alias("n"), F.min(F.array_min("v")).alias("min_value"), F.max(F.array_max("v")).alias("max_value"), F.count_if(F.array_min("v").isNull()).alias("n_failed"))
