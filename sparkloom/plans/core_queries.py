"""One query for each operator on the driver's tables, with the SQL that must give the same rows.

Query names begin with the operator's id in the survey. Every query runs over its whole tables.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import answers, linalg, text
from sparkloom.operators import curriculum, generate, metrics, nested, prepare, stats, validate
from sparkloom.session import table

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under the operator's name."""

    def add(f: Query) -> Query:
        REGISTRY[name] = (f, sql)
        return f

    return add


# Nested records ----------------------------------------------------------------------------------

_P4 = """
WITH qs AS (
  SELECT question_id AS id, len(stepwise) AS n, UNNEST(stepwise) AS s, generate_subscripts(stepwise, 1) - 1 AS pos, stepwise AS all_steps FROM questions
), q AS (
  SELECT 'questions' AS src, id AS record_id, pos AS step_pos, s.tool AS tool,
         list_distinct(list_filter(map_values(s.verification.dependent_on), lambda v: v >= 0 AND v < n AND all_steps[v + 1] IS NOT NULL)) AS parents
  FROM qs WHERE s IS NOT NULL
), t1 AS (
  SELECT base_id, dependency_edges AS e, TRY_CAST(stepwise_ground_truths AS JSON) AS j FROM base_dataset WHERE json_valid(stepwise_ground_truths)
), t2 AS (
  SELECT base_id, e, CASE WHEN json_type(j) = 'VARCHAR' THEN (CASE WHEN json_valid(j ->> '$') THEN CAST(j ->> '$' AS JSON) END) ELSE j END AS j FROM t1
), t3 AS (
  SELECT base_id, e, CASE json_type(j) WHEN 'ARRAY' THEN CAST(j AS JSON[]) WHEN 'OBJECT' THEN [j] END AS els FROM t2
), els AS (
  SELECT base_id, e, UNNEST(els) AS x, generate_subscripts(els, 1) - 1 AS pos FROM t3
), steps AS (
  SELECT base_id, e, pos, UNNEST(CASE WHEN list_contains(json_keys(x), 'tool') THEN [x ->> '$.tool'] ELSE json_keys(x) END) AS tool FROM els WHERE json_type(x) = 'OBJECT'
), has AS (SELECT base_id, list(DISTINCT pos) AS places FROM steps GROUP BY base_id),
b AS (
  SELECT 'base_dataset' AS src, s.base_id AS record_id, s.pos AS step_pos, s.tool,
         list_distinct(list_transform(list_filter(CAST(s.e AS BIGINT[][]), lambda p: p[2] = s.pos AND list_contains(h.places, p[1])), lambda p: p[1])) AS parents
  FROM steps s JOIN has h ON h.base_id = s.base_id
), u AS (SELECT src, record_id, step_pos, tool, parents FROM q UNION ALL SELECT * FROM b)
SELECT src, record_id, CAST(step_pos AS INTEGER) AS step_pos, tool, CAST(UNNEST(CASE WHEN coalesce(len(parents), 0) = 0 THEN [-1] ELSE parents END) AS INTEGER) AS parent_pos FROM u
"""


@query("p4_found", _P4)
def p4_found(s: SparkSession, d: str) -> DataFrame:
    return nested.flatten_links(table(s, d, "questions"), table(s, d, "base_dataset"))


@query(
    "p4_records",
    f"SELECT src, record_id, count(DISTINCT (step_pos, tool)) AS n_steps, CAST(sum(CASE WHEN parent_pos >= 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_links FROM ({_P4}) GROUP BY src, record_id",
)
def p4_records(s: SparkSession, d: str) -> DataFrame:
    return nested.record_table(nested.flatten_links(table(s, d, "questions"), table(s, d, "base_dataset")))


@query("p4_all_records")
def p4_all_records(s: SparkSession, d: str) -> DataFrame:
    return nested.all_records(table(s, d, "questions"), table(s, d, "base_dataset"))


@query("p4_steps")
def p4_steps(s: SparkSession, d: str) -> DataFrame:
    return nested.flatten_steps(table(s, d, "questions"), table(s, d, "base_dataset"))


# Matrix functions --------------------------------------------------------------------------------

MATRICES = """WITH st AS (SELECT question_id, problem_type, UNNEST(stepwise) AS s, CAST(generate_subscripts(stepwise, 1) - 1 AS INTEGER) AS step FROM questions),
t AS (SELECT question_id, step, problem_type, s.tool AS tool, CAST(json_extract(s.verification.input, '$.matrix') AS DOUBLE[][]) AS m FROM st), v AS (SELECT * FROM t WHERE m IS NOT NULL),
sq AS (SELECT * FROM v WHERE len(m) = len(m[1])) """
SHOWN = "array_to_string(list_transform({}, lambda r: array_to_string(list_transform(r, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',')), ';')"
DET = "CASE len(m) WHEN 1 THEN m[1][1] WHEN 2 THEN m[1][1]*m[2][2]-m[1][2]*m[2][1] ELSE m[1][1]*(m[2][2]*m[3][3]-m[2][3]*m[3][2])-m[1][2]*(m[2][1]*m[3][3]-m[2][3]*m[3][1])+m[1][3]*(m[2][1]*m[3][2]-m[2][2]*m[3][1]) END"


def _cof(i: int, j: int) -> str:
    r, c = [x for x in (1, 2, 3) if x != i], [x for x in (1, 2, 3) if x != j]
    minor = f"m[{r[0]}][{c[0]}]*m[{r[1]}][{c[1]}]-m[{r[0]}][{c[1]}]*m[{r[1]}][{c[0]}]"
    return f"({minor})" if (i + j) % 2 == 0 else f"-({minor})"


COF = "CASE len(m) WHEN 1 THEN [[1.0]] WHEN 2 THEN [[m[2][2], -m[2][1]], [-m[1][2], m[1][1]]] ELSE [" + ", ".join("[" + ", ".join(_cof(i, j) for j in (1, 2, 3)) + "]" for i in (1, 2, 3)) + "] END"


def matrices(s: SparkSession, d: str) -> DataFrame:
    """The input matrix of every step of every question: question_id, step, problem_type, tool, m."""
    steps = table(s, d, "questions").select("question_id", "problem_type", F.posexplode("stepwise").alias("step", "s"))
    held = F.from_json(F.col("s.verification.input"), "matrix array<array<double>>")["matrix"]
    return steps.select("question_id", "step", "problem_type", F.col("s.tool").alias("tool"), linalg.fenced(held).alias("m")).filter("m is not null")


def _unary(name: str, f: Callable, sql: str, square: bool = True) -> None:
    """The function's value for every matrix, null where it isn't defined. No square matrix of the tables is larger than 3x3; the SQL knows no others."""

    def run(s: SparkSession, d: str) -> DataFrame:
        return matrices(s, d).select("question_id", "step", linalg.fenced(f(F.col("m"))).alias("result"))

    defined = f"CASE WHEN len(m) = len(m[1]) THEN {sql} END" if square else sql
    REGISTRY[name] = (run, f"{MATRICES} SELECT question_id, step, {defined} AS result FROM v")


_unary("L1_transpose", lambda m: linalg.let(linalg.transpose(m), linalg.compact), SHOWN.format("list_transform(range(1, len(m[1]) + 1), lambda j: list_transform(m, lambda r: r[j]))"), square=False)
_unary("L2_cofactor", lambda m: linalg.compact(linalg.cofactor(m)), SHOWN.format(COF))
_unary("L3_determinant", linalg.determinant, DET)
_unary("L4_frobenius", linalg.frobenius, "round(sqrt(list_sum(list_transform(flatten(m), lambda x: x * x))), 2)", square=False)
_unary("L6_trace", linalg.trace, "list_sum(list_transform(range(1, len(m) + 1), lambda i: m[i][i]))")
_unary("L7_product_with_transpose", lambda m: linalg.let(linalg.multiply(m, linalg.transpose(m)), linalg.compact), SHOWN.format("list_transform(m, lambda a: list_transform(m, lambda b: list_sum(list_transform(list_zip(a, b), lambda z: z[1] * z[2]))))"), square=False)  # noqa: E501


# The rank of any shape in SQL: the most independent rows by minors, which suffices for two rows or columns, or 3x3.
_MINORS = "list_bool_or(list_transform(range(1, len(m) + 1), lambda i: list_bool_or(list_transform(range(1, len(m) + 1), lambda k: list_bool_or(list_transform(range(1, len(m[1]) + 1), lambda j: list_bool_or(list_transform(range(1, len(m[1]) + 1), lambda l: m[i][j] * m[k][l] <> m[i][l] * m[k][j]))))))))"  # noqa: E501


@query("L5_rank", f"{MATRICES} SELECT question_id, step, CAST(CASE WHEN len(m) = 3 AND len(m[1]) = 3 AND {DET} <> 0 THEN 3 WHEN {_MINORS} THEN 2 WHEN list_bool_or(list_transform(flatten(m), lambda x: x <> 0)) THEN 1 ELSE 0 END AS BIGINT) AS result FROM v")  # noqa: E501
def l5(s: SparkSession, d: str) -> DataFrame:
    return matrices(s, d).select("question_id", "step", linalg.rank(F.col("m")).alias("result"))


@query("L8_solve", f"{MATRICES}, f AS (SELECT question_id, step, m, {DET} AS det, list_transform(m, lambda r: r[1]) AS b, {COF} AS c FROM sq) SELECT question_id, step, array_to_string(list_transform(range(1, len(m) + 1), lambda i: CAST(CAST(round(list_sum(list_transform(range(1, len(m) + 1), lambda k: c[k][i] * b[k])) / det, 2) AS BIGINT) AS VARCHAR)), ';') AS result FROM f WHERE det <> 0")  # noqa: E501
def l8(s: SparkSession, d: str) -> DataFrame:
    """The first column as right-hand side; singular and other matrices have no solution."""
    m = F.col("m")
    solved = matrices(s, d).select("question_id", "step", linalg.fenced(linalg.solve(m, F.transform(m, lambda r: F.get(r, F.lit(0))))).alias("x"))
    return solved.filter("x is not null").select("question_id", "step", linalg.compact(F.col("x")).alias("result"))


@query("L9_inverse_trace", f"{MATRICES}, f AS (SELECT question_id, step, m, {DET} AS det, {COF} AS c FROM sq) SELECT question_id, step, round(list_sum(list_transform(range(1, len(m) + 1), lambda i: round(c[i][i] / det, 2))), 2) + 0.0 AS result FROM f WHERE det <> 0")  # noqa: E501
def l9(s: SparkSession, d: str) -> DataFrame:
    inverted = matrices(s, d).select("question_id", "step", linalg.fenced(linalg.inverse(F.col("m"))).alias("x"))
    return inverted.filter("x is not null").select("question_id", "step", (linalg.trace(F.col("x")) + 0.0).alias("result"))


_TRACE = "list_sum(list_transform(range(1, len(m) + 1), lambda i: m[i][i]))"
_JSON = "'[[' || array_to_string(list_transform({}, lambda r: array_to_string(list_transform(r, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ', ')), '], [') || ']]'"
_TRANSPOSED = "list_transform(range(1, len(m[1]) + 1), lambda j: list_transform(m, lambda r: r[j]))"
_TEXT = (
    "CASE WHEN tool = 'matrix_transpose' THEN " + _JSON.format(_TRANSPOSED) + " WHEN tool = 'frobenius_norm' THEN CAST(round(sqrt(list_sum(list_transform(flatten(m), lambda x: x * x))), 2) AS VARCHAR) "
    f"WHEN tool = 'matrix_rank' THEN CAST(CASE WHEN len(m) = 3 AND len(m[1]) = 3 AND {DET} <> 0 THEN 3 WHEN {_MINORS} THEN 2 WHEN list_bool_or(list_transform(flatten(m), lambda x: x <> 0)) THEN 1 ELSE 0 END AS VARCHAR) "
    "WHEN tool IN ('determinant', 'matrix_cofactor', 'matrix_trace') AND len(m) <> len(m[1]) THEN '{}Matrix must be square' WHEN tool = 'determinant' THEN CAST(" + DET + " AS VARCHAR) "
    "WHEN tool = 'matrix_trace' THEN CAST(" + _TRACE + " AS VARCHAR) WHEN tool = 'matrix_cofactor' THEN " + _JSON.format(COF) + " ELSE '{}Function ''' || coalesce(tool, 'None') || ''' not found in library' END"
)


def _executed(error: str, kind: str) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        result = linalg.execute(F.col("tool"), F.col("m"), error, kind)
        plain_number = F.when(F.col("tool").isin("determinant", "matrix_trace", "frobenius_norm"), F.col("r").try_cast("double"))
        return matrices(s, d).select("question_id", "step", "tool", result.alias("r")).select("question_id", "step", F.when(plain_number.isNull(), F.col("r")).alias("text"), plain_number.alias("number"))

    return run


def _executed_sql(error: str, kind: str) -> str:
    text = _TEXT.replace("'{}Matrix", f"'{error}{kind}Matrix").replace("'{}Function", f"'{error}Function")
    return f"{MATRICES}, r AS (SELECT question_id, step, tool, {text} AS r FROM v), n AS (SELECT *, CASE WHEN tool IN ('determinant', 'matrix_trace', 'frobenius_norm') THEN TRY_CAST(r AS DOUBLE) END AS number FROM r) SELECT question_id, step, CASE WHEN number IS NULL THEN r END AS text, number FROM n"


REGISTRY["L12_execute"] = (_executed("ERROR: ", "ValueError: "), _executed_sql("ERROR: ", "ValueError: "))
REGISTRY["L13_tool_wrappers"] = (_executed("Error: ", ""), _executed_sql("Error: ", ""))


@query("L10_tool_schemas", "SELECT * FROM (VALUES ('determinant', 'number'), ('frobenius_norm', 'number'), ('matrix_cofactor', 'matrix'), ('matrix_rank', 'integer'), ('matrix_trace', 'number'), ('matrix_transpose', 'matrix')) t(name, returns)")
def l10(s: SparkSession, d: str) -> DataFrame:
    return s.createDataFrame([(t["function"]["name"], t["function"]["returns"]) for t in linalg.tool_schemas()], "name string, returns string")


@query("L11_return_kinds", "WITH st AS (SELECT question_id, UNNEST(stepwise) AS s, CAST(generate_subscripts(stepwise, 1) - 1 AS INTEGER) AS step FROM questions), r AS (SELECT question_id, step, s.tool AS tool, trim(s.result) AS r FROM st WHERE s IS NOT NULL) SELECT question_id, step, CASE WHEN tool IN ('determinant', 'frobenius_norm', 'matrix_trace') THEN coalesce(regexp_full_match(r, '-?\\d+(\\.\\d+)?([eE][+-]?\\d+)?'), false) WHEN tool = 'matrix_rank' THEN coalesce(regexp_full_match(r, '\\d+'), false) WHEN tool IN ('matrix_cofactor', 'matrix_transpose') THEN coalesce(regexp_full_match(r, '\\[\\s*\\[.*\\]\\s*\\]', 's'), false) END AS ok FROM r")  # noqa: E501
def l11(s: SparkSession, d: str) -> DataFrame:
    """Whether each stated result is of the kind its tool returns."""
    steps = table(s, d, "questions").select("question_id", F.posexplode("stepwise").alias("step", "s")).filter("s is not null")
    return steps.select("question_id", "step", linalg.return_kind_ok(F.col("s.tool"), F.col("s.result")).alias("ok"))


def flagship(s: SparkSession, d: str) -> DataFrame:
    """Cofactor, transpose, trace of every invertible matrix; ranges of the result per problem type."""
    m = F.col("m")
    v = matrices(s, d).select("problem_type", linalg.determinant(m).alias("det"), linalg.cofactor(m).alias("c")).filter("det <> 0").select("problem_type", linalg.fenced(linalg.let(linalg.transpose(F.col("c")), linalg.trace)).alias("value"))
    return v.groupBy("problem_type").agg(F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.min(F.abs("value")).alias("min_abs"), F.count("*").alias("n"))


REGISTRY["flagship"] = (
    flagship,
    f"{MATRICES}, f AS (SELECT problem_type, {DET} AS det, m, {COF} AS c FROM sq), g AS (SELECT problem_type, list_sum(list_transform(range(1, len(m) + 1), lambda i: c[i][i])) AS value FROM f WHERE det <> 0) SELECT problem_type, min(value) AS min_value, max(value) AS max_value, min(abs(value)) AS min_abs, count(*) AS n FROM g GROUP BY problem_type",  # noqa: E501
)

# Statistics --------------------------------------------------------------------------------------

STEPS = "s AS (SELECT question_id, problem_type, UNNEST(stepwise) AS s, generate_subscripts(stepwise, 1) - 1 AS step FROM questions), vals AS (SELECT question_id, problem_type, CAST(step AS INTEGER) AS step, CAST(UNNEST(regexp_extract_all(s.result, '-?\\d+(?:\\.\\d+)?(?:[eE][+-]?\\d+)?')) AS DOUBLE) AS value FROM s WHERE s.result IS NOT NULL)"  # noqa: E501


@query("A1_value_statistics", f"WITH {STEPS} SELECT problem_type, step, CAST(GROUPING(step) * 2 + GROUPING(problem_type) AS BIGINT) AS grouping, min(value) AS min_value, max(value) AS max_value, min(abs(value)) AS min_abs, count(*) AS n FROM vals GROUP BY GROUPING SETS ((), (step), (problem_type))")  # noqa: E501
def a1(s: SparkSession, d: str) -> DataFrame:
    return stats.value_statistics(table(s, d, "questions"))


@query("A1_per_question", f"WITH {STEPS} SELECT q.question_id, min(value) AS min_value, max(value) AS max_value, coalesce(min(abs(value)), 0.0) AS min_abs, count(value) AS n FROM questions q LEFT JOIN vals v ON v.question_id = q.question_id GROUP BY q.question_id")  # noqa: E501
def a1q(s: SparkSession, d: str) -> DataFrame:
    return stats.question_statistics(table(s, d, "questions"))


@query("A2_numbers", f"WITH {STEPS} SELECT question_id, count(*) AS n, round(sum(value), 2) AS total FROM vals GROUP BY question_id")
def a2(s: SparkSession, d: str) -> DataFrame:
    return stats.step_values(table(s, d, "questions")).groupBy("question_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("A4_summary", "SELECT difficulty, CAST(GROUPING(difficulty) AS BIGINT) AS grouping, count(*) AS n_rows, count(DISTINCT problem_type) AS n_types, count(DISTINCT topic) AS n_topics, min(entropy_used) AS min_entropy, max(entropy_used) AS max_entropy, round(avg(entropy_used), 6) AS avg_entropy, min(tool_calls_required) AS min_calls, max(tool_calls_required) AS max_calls, round(avg(tool_calls_required), 6) AS avg_calls FROM questions GROUP BY GROUPING SETS ((), (difficulty))")  # noqa: E501
def a4(s: SparkSession, d: str) -> DataFrame:
    return stats.summary(table(s, d, "questions"))


@query("A5_split_shares", "SELECT split, count(*) AS n_rows, round(count(*) * 100 / sum(count(*)) OVER (), 6) AS percent FROM questions GROUP BY split")
def a5(s: SparkSession, d: str) -> DataFrame:
    return stats.shares(table(s, d, "questions"), "split")


@query("A6_verification_counts", "SELECT count(*) AS n, count_if(is_valid) AS n_valid, count_if(NOT is_valid) AS n_invalid, count_if(is_valid IS NULL) AS n_unknown FROM questions")
def a6(s: SparkSession, d: str) -> DataFrame:
    v = F.col("is_valid")
    return table(s, d, "questions").agg(F.count("*").alias("n"), F.count_if(v).alias("n_valid"), F.count_if(~v).alias("n_invalid"), F.count_if(v.isNull()).alias("n_unknown"))


@query("A7_success", "SELECT source, count(*) AS n, count_if(is_correct) AS n_correct, round(count_if(is_correct) / count(*), 6) AS share FROM conversations_chat GROUP BY source")
def a7(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "conversations_chat").groupBy("source").agg(F.count("*").alias("n"), F.count_if("is_correct").alias("n_correct"), F.round(F.count_if("is_correct") / F.count("*"), 6).alias("share"))


#: Targets of every problem type; those of the tables' larger entries.
TARGETS = (
    ("one_determinant", -5e8, 5e8), ("one_matrix_trace", -2400.0, 2400.0), ("one_matrix_rank", 1.0, 3.0), ("two_cofactor_rank", -700000.0, 700000.0), ("one_frobenius_norm", 0.0, 2000.0), ("one_matrix_transpose", -800.0, 800.0), ("one_matrix_cofactor", -1e6, 1e6),
    ("two_transpose_determinant", -5e8, 5e8), ("two_cofactor_trace", -1e6, 1e6), ("two_transpose_frobenius", 0.0, 2000.0), ("three_transpose_cofactor_rank", 1.0, 3.0), ("three_cofactor_transpose_trace", -1e6, 1e6), ("three_transpose_cofactor_frobenius", 0.0, 1e6),
    ("sequential_problem", -1e6, 1e6),
)
_TARGET_ROWS = ", ".join(f"('{a}', {b}, {c})" for a, b, c in TARGETS)


@query("V4_targets", f"WITH {STEPS}, tg(problem_type, target_min, target_max) AS (SELECT column0, CAST(column1 AS DOUBLE), CAST(column2 AS DOUBLE) FROM (VALUES {_TARGET_ROWS}) x(column0, column1, column2)) SELECT v.problem_type, target_min, target_max, min(value) AS min_value, max(value) AS max_value, count(*) AS n, count_if(value BETWEEN target_min AND target_max) AS n_within, count(*) = count_if(value BETWEEN target_min AND target_max) AS ok FROM vals v JOIN tg USING (problem_type) GROUP BY v.problem_type, target_min, target_max")  # noqa: E501
def v4(s: SparkSession, d: str) -> DataFrame:
    targets = s.createDataFrame(list(TARGETS), "problem_type string, target_min double, target_max double")
    return stats.within_targets(table(s, d, "questions"), targets)


@query("V7_ranked_runs", f"WITH {STEPS}, r AS (SELECT q.run_id AS run, min(value) AS min_value, max(value) AS max_value, count(*) AS n FROM vals v JOIN questions q USING (question_id) WHERE q.run_id IS NOT NULL GROUP BY q.run_id) SELECT *, round(abs(min_value + 1e8) + abs(max_value - 1e8), 6) AS score FROM r WHERE min_value BETWEEN -1e8 AND 1e8 AND max_value BETWEEN -1e8 AND 1e8 ORDER BY score, run LIMIT 10")  # noqa: E501
def v7(s: SparkSession, d: str) -> DataFrame:
    """The top ten is the feature."""
    q = table(s, d, "questions")
    runs = q.select("run_id", F.explode("stepwise").alias("s")).select(F.col("run_id").alias("run"), F.explode(stats.numbers_in(F.col("s.result"))).alias("value")).filter("run is not null")
    return stats.ranked(runs.groupBy("run").agg(F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.count("*").alias("n")), -1e8, 1e8, 10)


@query("K10_histogram", "SELECT CAST(least(floor((entropy_used - 0) * 20 / CAST(4 AS DOUBLE)) + 1, 20) AS INTEGER) AS bin, count(*) AS n FROM questions WHERE entropy_used BETWEEN 0 AND 4 GROUP BY 1")
def k10(s: SparkSession, d: str) -> DataFrame:
    return stats.histogram(table(s, d, "questions"), "entropy_used", 0.0, 4.0, 20)


# Preparation -------------------------------------------------------------------------------------

@query("W1_representative", "SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY doc_id) <= 40")
def w1(s: SparkSession, d: str) -> DataFrame:
    """The first rows per category are the feature."""
    return prepare.representative(table(s, d, "documents").select("doc_id", "lang"), "lang", 40, "doc_id")


_MIX = "(({} % 2147483648) * 2654435761 + {}) % 4294967296"


@query("W2_stratified_split", f"WITH r AS (SELECT question_id, problem_type, row_number() OVER (PARTITION BY problem_type ORDER BY {_MIX.format('question_id', 7)}, question_id) AS k, count(*) OVER (PARTITION BY problem_type) AS n FROM questions) SELECT question_id, problem_type, CASE WHEN k <= floor(n * CAST(0.1 AS DOUBLE)) THEN 'test' WHEN k <= floor(n * CAST(0.1 + 0.15 AS DOUBLE)) THEN 'validation' ELSE 'train' END AS split FROM r")  # noqa: E501
def w2(s: SparkSession, d: str) -> DataFrame:
    return prepare.stratified_split(table(s, d, "questions").select("question_id", "problem_type"), "problem_type", "question_id", 0.1, 0.15, 7)


@query("O6_seeded_order", f"SELECT question_id, {_MIX.format('question_id', 3)} AS order_key FROM questions")
def o6(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "questions").select("question_id", prepare.mixed(F.col("question_id"), 3).alias("order_key"))


@query("F1_valid_questions", "SELECT question_id FROM questions WHERE is_valid AND length(question) > 0 AND length(answer) > 0")
def f1(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "questions").filter("is_valid and length(question) > 0 and length(answer) > 0").select("question_id")


@query("F3_outcomes", "SELECT CASE WHEN is_correct THEN 'correct' ELSE 'failed' END AS outcome, idx FROM conversations_chat WHERE is_correct IS NOT NULL")
def f3(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "conversations_chat").filter("is_correct is not null").select(F.when(F.col("is_correct"), "correct").otherwise("failed").alias("outcome"), "idx")


@query("F5_head_per_split", "SELECT question_id, split FROM questions QUALIFY row_number() OVER (PARTITION BY split ORDER BY question_id) <= 25")
def f5(s: SparkSession, d: str) -> DataFrame:
    """The first rows per split are the feature."""
    return prepare.head_per_split(table(s, d, "questions").select("question_id", "split"), 25, "question_id")


@query("F6_index_range", "SELECT task_id FROM tasks WHERE task_id >= 100 AND task_id < 300")
def f6(s: SparkSession, d: str) -> DataFrame:
    return prepare.index_range(table(s, d, "tasks").select("task_id"), "task_id", 100, 300)


@query("P1_examples", """WITH x AS (SELECT question_id, question, difficulty, problem_type, stepwise IS NULL AS no_steps, list_filter(stepwise, lambda s: s IS NOT NULL) AS st, stepwise AS sw FROM questions),
y AS (SELECT *, list_filter(st, lambda s: s.tool IS NOT NULL AND coalesce(json_valid(s.result), false)) AS us FROM x),
e AS (SELECT question_id, string_agg('[' || d || ', ' || i || ']', ', ' ORDER BY i, o) AS edges FROM (SELECT question_id, i, UNNEST(map_values(s.verification.dependent_on)) AS d, generate_subscripts(map_values(s.verification.dependent_on), 1) AS o FROM (SELECT question_id, UNNEST(sw) AS s, generate_subscripts(sw, 1) - 1 AS i FROM x)) GROUP BY question_id)
SELECT y.question_id, question AS query, us[len(us)].result AS ground_truth, '[' || array_to_string(list_transform(us, lambda s: '{"' || s.tool || '": ' || s.result || '}'), ', ') || ']' AS stepwise_ground_truths, difficulty, problem_type,
CASE WHEN len(st) > 1 THEN 'sequential' WHEN len(st) = 1 THEN 'single' END AS composition_type, '[' || e.edges || ']' AS dependency_edges FROM y LEFT JOIN e ON e.question_id = y.question_id""")  # noqa: E501
def p1x(s: SparkSession, d: str) -> DataFrame:
    return prepare.example(table(s, d, "questions"))


@query("P14_tasks_to_actions", "SELECT task_id, CAST(generate_subscripts(actions, 1) - 1 AS INTEGER) AS pos, UNNEST(actions).name AS tool, UNNEST(actions).kwargs['matrix'] AS expected_result FROM tasks")
def p14(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "tasks").select("task_id", F.posexplode("actions").alias("pos", "a")).select("task_id", "pos", F.col("a.name").alias("tool"), F.try_element_at("a.kwargs", F.lit("matrix")).alias("expected_result"))


MESSAGES = "ms AS (SELECT idx, source, UNNEST(messages) AS m, CAST(generate_subscripts(messages, 1) - 1 AS INTEGER) AS pos FROM conversations_chat), mm AS (SELECT idx, source, pos, m.role AS role, m.content AS content, m.tool_calls AS tool_calls, m.name AS name, m.tool_call_id AS tool_call_id FROM ms WHERE m IS NOT NULL)"  # noqa: E501


@query("P15_first_actions", f"WITH {MESSAGES} SELECT idx, pos, coalesce(tool_calls[1].function.name, 'respond') AS action FROM mm WHERE role = 'assistant'")
def p15(s: SparkSession, d: str) -> DataFrame:
    m = table(s, d, "conversations_chat").select("idx", F.posexplode("messages").alias("pos", "m")).filter("m.role = 'assistant'")
    return m.select("idx", "pos", prepare.first_action(F.col("m"))["name"].alias("action"))


@query("P17_tool_sequences", f"WITH {MESSAGES}, c AS (SELECT idx, pos, UNNEST(tool_calls).function.name AS tool, generate_subscripts(tool_calls, 1) AS k FROM mm) SELECT c.idx, coalesce(string_agg(tool, '>' ORDER BY pos, k), '') AS tools FROM c GROUP BY c.idx")
def p17(s: SparkSession, d: str) -> DataFrame:
    q = table(s, d, "conversations_chat").select("idx", prepare.tool_sequence(F.col("messages")).alias("t"))
    return q.filter(F.size("t") > 0).select("idx", F.array_join("t", ">").alias("tools"))


@query("P21_labels", "SELECT question_id, CASE WHEN length(one) > 96 THEN left(one, 93) || '...' ELSE one END AS label FROM (SELECT question_id, regexp_replace(regexp_replace(question, '[\\s\\x0b\\x{85}\\p{Z}]+', ' ', 'g'), '^ | $', '', 'g') AS one FROM questions)")
def p21(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "questions").select("question_id", text.label(F.col("question")).alias("label"))


@query("P22_user_query", f"WITH {MESSAGES}, u AS (SELECT idx, arg_max(content, pos) AS query FROM mm WHERE role = 'user' AND trim(content, ' ') <> '' GROUP BY idx) SELECT c.idx, CASE WHEN trim(t.instruction, ' ') <> '' THEN t.instruction ELSE u.query END AS query FROM conversations_chat c LEFT JOIN tasks t ON t.task_id = c.task_id LEFT JOIN u ON u.idx = c.idx")
def p22(s: SparkSession, d: str) -> DataFrame:
    """The task's instruction as the query, else what the user asked last."""
    t = table(s, d, "tasks").select("task_id", "instruction")
    return chat(s, d).select("idx", "task_id", "messages").join(t, "task_id", "left").select("idx", prepare.user_query(F.col("instruction"), F.col("messages")).alias("query"))


@query("P25_names", "SELECT s_suppkey, regexp_replace(regexp_replace(regexp_replace('run of ' || s_name || ' / ' || s_nationkey || '--x.', '[^A-Za-z0-9._-]+', '-', 'g'), '-{2,}', '-', 'g'), '^[-.]+|[-.]+$', '', 'g') AS name FROM supplier")
def p25(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "supplier").select("s_suppkey", text.repository_name(F.concat(F.lit("run of "), "s_name", F.lit(" / "), "s_nationkey", F.lit("--x."))).alias("name"))


@query("P12_map_without_prefix", "SELECT event_id, array_to_string(list_sort(list_transform(list_filter(json_keys(props), lambda k: NOT starts_with(k, 'p')), lambda k: k || '=' || coalesce(props ->> k, '-'))), ',') AS kept FROM events WHERE json_valid(props)")
def p12(s: SparkSession, d: str) -> DataFrame:
    m = prepare.without_prefix(F.from_json("props", "map<string,string>"), "p")
    pairs = F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("-")))))
    return table(s, d, "events").select("event_id", F.array_join(pairs, ",").alias("kept")).filter("kept is not null")


@query("U2_aligned_union", "SELECT 'question' AS kind, question_id AS id, problem_type, difficulty, CAST(NULL AS VARCHAR) AS composition_type FROM questions UNION ALL SELECT 'base', base_id, problem_type, difficulty, composition_type FROM base_dataset")
def u2(s: SparkSession, d: str) -> DataFrame:
    q = table(s, d, "questions").select(F.lit("question").alias("kind"), F.col("question_id").alias("id"), "problem_type", "difficulty")
    b = table(s, d, "base_dataset").select(F.lit("base").alias("kind"), F.col("base_id").alias("id"), "problem_type", "difficulty", "composition_type")
    return prepare.aligned_union([q, b])


@query("K5_annotation_records", """SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS text FROM documents""")
def k5(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", text.escaped(F.col("text")).alias("text"))


@query("K1_split_round_trip", "SELECT split, count(*) AS n FROM questions WHERE split IS NOT NULL GROUP BY split")
def k1(s: SparkSession, d: str) -> DataFrame:
    """Written by split into the shared folder and read again."""
    from sparkloom.session import ensure_checkpoint_dir
    from sparkloom.sources.io import write_splits

    ensure_checkpoint_dir(s)
    path = os.path.join(s.sparkContext.getCheckpointDir(), f"splits-{uuid.uuid4().hex}")
    write_splits(table(s, d, "questions").select("question_id", "split").filter("split is not null"), path)
    return s.read.parquet(path).groupBy("split").agg(F.count("*").alias("n"))


# Text and answers --------------------------------------------------------------------------------

ASSISTANT = f"WITH {MESSAGES}, a AS (SELECT * FROM mm WHERE role = 'assistant' AND content IS NOT NULL) "
_SPACE = "[\\s\\x0b\\x{1c}-\\x{1f}\\x{85}\\p{Z}]"


def contents(s: SparkSession, d: str) -> DataFrame:
    return validate.messages(table(s, d, "conversations_chat")).filter("role = 'assistant' and content is not null")


def _tag(tag: str) -> str:
    return f"regexp_extract_all(content, '(?s)<{tag}>{_SPACE}*(.*?){_SPACE}*</{tag}>', 1)"


@query("X1_tag_contents", f"{ASSISTANT} SELECT idx, pos, CAST(len({_tag('think')}) AS INTEGER) AS n_thoughts, CAST(len({_tag('answer')}) AS INTEGER) AS n_answers, {_tag('answer')}[-1] AS answer FROM a")
def x1(s: SparkSession, d: str) -> DataFrame:
    c = F.col("content")
    return contents(s, d).select("idx", "pos", F.size(text.tag_contents(c, "think")).alias("n_thoughts"), F.size(text.tag_contents(c, "answer")).alias("n_answers"), text.last_content(c, "answer").alias("answer"))


_TAIL = "string_split(content, '<think>')[-1]"
_STRICT = f"(contains(content, '<think>') AND strpos({_TAIL}, '</think>') > 0 AND regexp_matches(substr({_TAIL}, strpos({_TAIL}, '</think>') + 8), '(?s)^{_SPACE}*<answer>.*</answer>\\n?\\z'))"


@query("X3_strict_format", f"{ASSISTANT} SELECT idx, pos, {_STRICT} AS valid_answer FROM a")
def x3(s: SparkSession, d: str) -> DataFrame:
    return contents(s, d).select("idx", "pos", text.thinks_then_answers(F.col("content")).alias("valid_answer"))


@query("X6_outside_tags", f"{ASSISTANT} SELECT idx, pos, regexp_replace(regexp_replace(regexp_replace(regexp_replace(content, '(?s)<think>.*?</think>', '', 'g'), '(?s)<tool_call>.*?</tool_call>', '', 'g'), '(?s)<answer>.*?</answer>', '', 'g'), '{_SPACE}', '', 'g') <> '' AS outside FROM a")  # noqa: E501
def x6(s: SparkSession, d: str) -> DataFrame:
    return contents(s, d).select("idx", "pos", text.outside_tags(F.col("content")).alias("outside"))


@query("X7_unbalanced_tags", f"{ASSISTANT} SELECT idx, pos, contains(content, '<think>') AND NOT contains({_TAIL}, '</think>') AS unclosed, contains(content, '</think>') AND NOT contains(string_split(content, '</think>')[1], '<think>') AS unopened FROM a")
def x7(s: SparkSession, d: str) -> DataFrame:
    c = F.col("content")
    return contents(s, d).select("idx", "pos", text.is_unclosed(c, "think").alias("unclosed"), text.is_unopened(c, "think").alias("unopened"))


@query("X9_normalized_length", "SELECT question_id, length(replace(nfc_normalize(question), chr(8722), '-')) AS n FROM questions WHERE regexp_full_match(question, '[\\x00-\\x7f\\x{2212}]*')")
def x9(s: SparkSession, d: str) -> DataFrame:
    q = table(s, d, "questions").filter("question rlike '^[\\\\x00-\\\\x7f\\\\x{2212}]*$'")
    return q.select("question_id", F.length(text.normalized(F.col("question"))).cast("bigint").alias("n"))


@query("X9_normalized_all")
def x9_all(s: SparkSession, d: str) -> DataFrame:
    """Every question's normalised length (no SQL: DuckDB has no NFKC)."""
    return table(s, d, "questions").select("question_id", F.length(text.normalized(F.col("question"))).cast("bigint").alias("n"))


@query("X10_spaced_thoughts", f"{ASSISTANT} SELECT idx, pos, regexp_replace(regexp_replace(content, '<think>{_SPACE}*', '<think>\n', 'g'), '{_SPACE}*</think>', '\n</think>', 'g') AS content FROM a")
def x10(s: SparkSession, d: str) -> DataFrame:
    return contents(s, d).select("idx", "pos", text.spaced_think(F.col("content")).alias("content"))


_REASON = f"""CASE WHEN nt > 1 THEN 'multiple <think> blocks (nested/repeated)' WHEN na > 1 THEN 'multiple <answer> blocks (nested/repeated)' WHEN nt = 0 AND na = 0 THEN 'no <think>/<tool_call>/<answer> blocks'
WHEN na = 0 THEN 'no tool call or answer' WHEN nt = 0 THEN 'missing <think>' WHEN outside THEN 'content outside allowed tags' WHEN NOT valid THEN 'invalid format' WHEN NOT policy THEN 'answer without tool response' ELSE 'unspecified issue' END"""


@query("X11_failure_reasons", f"""{ASSISTANT}, b AS (SELECT idx, pos, len({_tag('think')}) AS nt, len({_tag('answer')}) AS na, {_STRICT} AS valid, regexp_replace(regexp_replace(regexp_replace(content, '(?s)<think>.*?</think>', '', 'g'), '(?s)<answer>.*?</answer>', '', 'g'), '{_SPACE}', '', 'g') <> '' AS outside FROM a),
p AS (SELECT idx, pos, lag(m.role) OVER (PARTITION BY idx ORDER BY pos) AS before FROM ms) SELECT b.idx, b.pos, {_REASON} AS reason FROM (SELECT b.*, coalesce(p.before = 'tool', false) AS policy FROM b JOIN p ON p.idx = b.idx AND p.pos = b.pos) b""")  # noqa: E501
def x11(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "conversations_chat").select("idx", F.explode(F.transform("messages", lambda m, i: F.struct(m.alias("m"), i.alias("pos"), F.get("messages", i - 1)["role"].alias("before")))).alias("x"))
    c = c.filter("x.m.role = 'assistant' and x.m.content is not null").select("idx", "x.pos", F.col("x.m.content").alias("content"), F.coalesce(F.col("x.before") == "tool", F.lit(False)).alias("policy"))
    return c.withColumn("a", text.analysis(F.col("content"), linalg.TOOLS)).select("idx", "pos", text.failure_reason(F.col("a"), F.col("policy")).alias("reason"))


@query("X14_arguments", f"""WITH {MESSAGES}, c AS (SELECT idx, pos, generate_subscripts(tool_calls, 1) - 1 AS k, UNNEST(tool_calls).function.arguments AS a FROM mm),
o AS (SELECT idx, pos, CAST(k AS INTEGER) AS k, CASE WHEN json_valid(a) THEN CASE json_type(a) WHEN 'OBJECT' THEN a WHEN 'VARCHAR' THEN CASE WHEN json_valid(CAST(a AS JSON) ->> '$') AND json_type(CAST(a AS JSON) ->> '$') = 'OBJECT' THEN CAST(a AS JSON) ->> '$' ELSE '{{}}' END ELSE '{{}}' END ELSE '{{}}' END AS arguments FROM c)
SELECT * FROM o""")  # noqa: E501
def x14(s: SparkSession, d: str) -> DataFrame:
    c = validate.messages(table(s, d, "conversations_chat")).select("idx", "pos", F.posexplode("tool_calls").alias("k", "t"))
    return c.select("idx", "pos", "k", text.arguments(F.col("t.function.arguments")).alias("arguments"))


@query("X16_literals", "SELECT question_id, TRY_CAST(replace(trim(answer, ' '), '−', '-') AS DOUBLE) AS value FROM questions WHERE regexp_full_match(replace(trim(answer, ' '), '−', '-'), '-?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?')")
def x16(s: SparkSession, d: str) -> DataFrame:
    a = F.translate(F.trim("answer"), "−", "-")
    q = table(s, d, "questions").filter(a.rlike(r"^-?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\z"))
    return q.select("question_id", F.get(F.get(answers.cells(F.col("answer")), F.lit(0)), F.lit(0)).alias("value"))


@query("X16_literals_all")
def x16_all(s: SparkSession, d: str) -> DataFrame:
    """The numbers of every answer, null where it is no literal."""
    return table(s, d, "questions").select("question_id", answers.cells(F.col("answer")).alias("cells"))


_VALUE = "TRY_CAST(replace({}, '−', '-') AS DOUBLE)"


@query("X17_equal_scalars", f"SELECT question_id, coalesce(abs({_VALUE.format('answer')} - {_VALUE.format('golden.final_answer')}) <= 1e-6, false) AS same FROM questions WHERE regexp_full_match(answer, '[-−]?\\d+(\\.\\d+)?') AND regexp_full_match(golden.final_answer, '-?\\d+(\\.\\d+)?')")  # noqa: E501
def x17(s: SparkSession, d: str) -> DataFrame:
    q = table(s, d, "questions").filter(F.col("answer").rlike(r"^[-−]?\d+(\.\d+)?\z") & F.col("golden.final_answer").rlike(r"^-?\d+(\.\d+)?\z"))
    return q.select("question_id", answers.equal(F.col("answer"), F.col("golden.final_answer")).alias("same"))


@query("X17_equal_all")
def x17_all(s: SparkSession, d: str) -> DataFrame:
    """Every answer against its final answer, whatever they are."""
    return table(s, d, "questions").select("question_id", answers.equal(F.col("answer"), F.col("golden.final_answer")).alias("same"))


@query("X19_hidden_thoughts", f"{ASSISTANT} SELECT idx, pos, regexp_replace(content, '(?s)<think>.*?</think>', '[$1]', 'g') AS content FROM a")
def x19(s: SparkSession, d: str) -> DataFrame:
    return contents(s, d).select("idx", "pos", text.hidden_thoughts(F.col("content"), "[$1]").alias("content"))


@query("X20_partial_content", f"{ASSISTANT} SELECT idx, pos, CASE WHEN contains(content, '<answer>') THEN string_split(string_split(content, '<answer>')[-1], '</answer>')[1] END AS answer FROM a")
def x20(s: SparkSession, d: str) -> DataFrame:
    return contents(s, d).select("idx", "pos", text.partial_content(F.col("content"), "answer").alias("answer"))


# Conversations -----------------------------------------------------------------------------------

def chat(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "conversations_chat")


CALLS = f"WITH {MESSAGES}, calls AS (SELECT idx, pos, UNNEST(tool_calls).function.name AS tool FROM mm) "


@query("A8_tool_usage", f"{CALLS} SELECT idx, tool, count(*) AS n_calls, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS places FROM calls GROUP BY idx, tool")
def a8(s: SparkSession, d: str) -> DataFrame:
    return validate.tool_usage(chat(s, d))


@query("V10_repeated_calls", f"{CALLS} SELECT idx, tool, count(*) AS n_calls FROM calls WHERE tool IS NOT NULL GROUP BY idx, tool HAVING count(*) > 1")
def v10(s: SparkSession, d: str) -> DataFrame:
    return validate.repeated_calls(chat(s, d))


@query("V9_answer_mismatch")
def v9(s: SparkSession, d: str) -> DataFrame:
    """No SQL: the comparison of literals is tested by fixtures."""
    return validate.final_answer_issue(chat(s, d))


@query("V11_sequence_issues")
def v11(s: SparkSession, d: str) -> DataFrame:
    """No SQL: the comparison of literals is tested by fixtures."""
    return validate.sequence_issues(chat(s, d))


@query("V12_message_counts", "WITH t AS (SELECT idx, len(messages) AS n, CASE WHEN json_valid(stepwise_ground_truths) AND json_type(stepwise_ground_truths) = 'ARRAY' THEN CAST(list_sum(list_transform(CAST(stepwise_ground_truths AS JSON[]), lambda x: len(json_keys(x)))) AS BIGINT) END AS k FROM conversations_chat) SELECT idx, coalesce(n = 2 * k + 3, false) AS count_ok FROM t")  # noqa: E501
def v12(s: SparkSession, d: str) -> DataFrame:
    return validate.count_ok(chat(s, d))


@query("V13_long_messages", f"WITH {MESSAGES} SELECT idx, pos, CAST(len(list_filter(regexp_split_to_array(content, '{_SPACE}+'), lambda w: w <> '')) AS BIGINT) AS n_words FROM mm WHERE role IS DISTINCT FROM 'system' AND len(list_filter(regexp_split_to_array(content, '{_SPACE}+'), lambda w: w <> '')) > 60")  # noqa: E501
def v13(s: SparkSession, d: str) -> DataFrame:
    return validate.long_messages(chat(s, d), 60)


_THOUGHTS = f"th AS (SELECT idx, pos, {_tag('think')}[1] AS thought FROM mm WHERE role = 'assistant')"


@query("V14_repeated_thoughts", f"WITH {MESSAGES}, {_THOUGHTS} SELECT a.idx, a.pos AS first, b.pos AS second, b.pos - a.pos = 2 AS adjacent FROM th a JOIN th b ON a.idx = b.idx AND a.thought = b.thought AND a.pos < b.pos")
def v14(s: SparkSession, d: str) -> DataFrame:
    return validate.repeated_thoughts(chat(s, d))


@query("W7_keep_first_thought", f"WITH {MESSAGES}, {_THOUGHTS}, r AS (SELECT idx, pos, row_number() OVER (PARTITION BY idx, thought ORDER BY pos) > 1 AS repeats FROM th WHERE thought IS NOT NULL) SELECT r.idx, r.pos, repeats, CASE WHEN repeats THEN regexp_replace(content, '(?s)<think>.*?</think>', '<think>(as before)</think>', 'g') ELSE content END AS content FROM r JOIN mm ON mm.idx = r.idx AND mm.pos = r.pos")
def w7(s: SparkSession, d: str) -> DataFrame:
    return validate.without_repeated_thoughts(chat(s, d))


@query("W4_alternation", "SELECT idx, len(messages) AS n_messages, NOT coalesce(list_bool_or(list_transform(range(2, len(messages) + 1), lambda i: coalesce(messages[i].role, '') = coalesce(messages[i - 1].role, ''))), false) AS alternates FROM conversations_chat WHERE messages IS NOT NULL")
def w4(s: SparkSession, d: str) -> DataFrame:
    return validate.alternation(chat(s, d))


@query("J7_last_call", f"WITH {MESSAGES}, c AS (SELECT *, last_value(tool_calls[-1].id IGNORE NULLS) OVER (PARTITION BY idx ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_call FROM mm) SELECT idx, pos, tool_call_id, last_call FROM c WHERE role = 'tool'")
def j7(s: SparkSession, d: str) -> DataFrame:
    return validate.with_last_call(chat(s, d))


@query("J8_answer_policy", f"WITH {MESSAGES}, p AS (SELECT idx, pos, m.role AS role, m.content AS content, lag(m.role) OVER (PARTITION BY idx ORDER BY pos) AS before FROM ms WHERE m IS NULL OR NOT coalesce(m.role = 'user' AND regexp_matches(m.content, '^{_SPACE}*\\[diag\\] '), false)) SELECT idx, pos, coalesce(before = 'tool', false) AS allowed FROM p WHERE role = 'assistant' AND {_tag('answer')}[-1] <> ''")  # noqa: E501
def j8(s: SparkSession, d: str) -> DataFrame:
    return validate.answer_policy(chat(s, d))


@query("A11_issue_report")
def a11(s: SparkSession, d: str) -> DataFrame:
    return validate.issue_report(chat(s, d))


@query("V15_clean_conversations")
def v15(s: SparkSession, d: str) -> DataFrame:
    return validate.clean(chat(s, d)).select("idx")


@query("V16_edited", f"""WITH {MESSAGES}, n AS (SELECT idx AS i, len(messages) AS n FROM conversations_chat), e AS (SELECT mm.idx, mm.pos, CASE WHEN n = 5 AND pos = 4 THEN regexp_replace(content, '(?s)<think>.*?</think>', '<think>checked</think>', 'g') ELSE content END AS content FROM mm JOIN n ON n.i = mm.idx WHERE NOT (n = 5 AND pos IN (2, 3)))
SELECT idx, string_agg(coalesce(content, '~'), '|' ORDER BY pos) AS contents FROM e GROUP BY idx""")
def v16(s: SparkSession, d: str) -> DataFrame:
    """An edit for every conversation, which applies to those of five messages (J1): the contents that are left."""
    c = chat(s, d)
    config = c.select("idx", F.array(F.lit(2), F.lit(3)).alias("to_remove"), F.create_map(F.lit(4), F.lit("checked")).alias("to_replace"), F.lit(5).alias("initial_msg_count"), F.lit(3).alias("expected_final_msg_count"))
    left = F.filter("messages", lambda m: m.isNotNull())
    out = validate.edited(c, config).select("idx", left.alias("m")).filter(F.size("m") > 0)
    return out.select("idx", F.array_join(F.transform("m", lambda m: F.coalesce(m["content"], F.lit("~"))), "|").alias("contents"))


# Metrics -----------------------------------------------------------------------------------------

_TRIALS = "tr AS (SELECT task_id AS task, coalesce(is_correct, false) AS success FROM conversations_chat WHERE task_id IS NOT NULL), per AS (SELECT task, count(*) AS n, count_if(success) AS c FROM tr GROUP BY task)"
_CHOOSE = "(CASE WHEN k > {0} THEN 0.0 ELSE list_product(list_transform(range(1, k + 1), lambda i: CAST({0} - k + i AS DOUBLE) / i)) END)"


@query("A12_pass_hat_k", f"WITH {_TRIALS}, x AS (SELECT n, c, UNNEST(range(1, 5)) AS k FROM per) SELECT CAST(k AS INTEGER) AS k, count(*) AS n_tasks, round(avg({_CHOOSE.format('c')} / {_CHOOSE.format('n')}), 6) AS pass_k FROM x WHERE k <= n GROUP BY k")
def a12(s: SparkSession, d: str) -> DataFrame:
    trials = chat(s, d).filter("task_id is not null").select(F.col("task_id").alias("task"), F.coalesce("is_correct", F.lit(False)).alias("success"))
    return metrics.pass_hat_k(trials, 4)


@query("A13_metric_summary", "WITH per AS (SELECT user_id, event_type AS metric, avg(value) AS v FROM events GROUP BY user_id, event_type) SELECT metric, count(*) AS n_runs, round(avg(v), 9) AS mean, round(min(v), 9) AS least, round(max(v), 9) AS most, round(stddev_pop(v), 9) AS deviation FROM per GROUP BY metric")
def a13(s: SparkSession, d: str) -> DataFrame:
    return metrics.metric_summary(table(s, d, "events").select(F.col("user_id").alias("run"), F.col("event_type").alias("metric"), "value"))


_GROUPS = "g AS (SELECT user_id, stddev_pop(value) AS deviation FROM events GROUP BY user_id)"


@query("A15_exclusive_p95", f"WITH {_GROUPS}, o AS (SELECT deviation AS v, row_number() OVER (ORDER BY deviation) AS r, count(*) OVER () AS n FROM g WHERE deviation IS NOT NULL), k AS (SELECT n, CAST(0.95 AS DOUBLE) * (n + 1) AS pl FROM o LIMIT 1), ab AS (SELECT k.n, k.pl, (SELECT v FROM o WHERE r = least(floor(k.pl), k.n)) AS a, (SELECT v FROM o WHERE r = least(floor(k.pl) + 1, k.n)) AS b, (SELECT max(v) FROM o) AS m FROM k) SELECT n, round(CASE WHEN n < 20 THEN m ELSE a + (pl - floor(pl)) * (b - a) END, 6) AS p95 FROM ab")  # noqa: E501
def a15(s: SparkSession, d: str) -> DataFrame:
    return metrics.exclusive_p95(table(s, d, "events").groupBy("user_id").agg(F.stddev_pop("value").alias("deviation")), "deviation")


@query("A15_group_diversity", "SELECT user_id AS \"group\", count(*) AS n, round(avg(value), 9) AS mean_reward, round(stddev_pop(value), 9) AS deviation, round(count(DISTINCT event_type) / count(event_type), 6) AS distinct_share FROM events GROUP BY user_id")
def a15g(s: SparkSession, d: str) -> DataFrame:
    return metrics.group_diversity(table(s, d, "events").select(F.col("user_id").alias("group"), F.col("value").alias("reward"), F.col("event_type").alias("first_tool")))


@query("O4_top_values", "SELECT source, count(*) AS n, min(doc_id) AS first_seen FROM documents WHERE source IS NOT NULL GROUP BY source ORDER BY n DESC, first_seen LIMIT 5")
def o4(s: SparkSession, d: str) -> DataFrame:
    """The top five is the feature."""
    return metrics.top_values(table(s, d, "documents"), "source", "doc_id", 5)


# Curriculum and generation -----------------------------------------------------------------------

BUCKETS = "b AS (SELECT task_id, CAST(len(actions) AS INTEGER) AS bucket FROM tasks WHERE actions IS NOT NULL)"


def buckets(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "tasks").filter("actions is not null").select("task_id", F.size("actions").alias("bucket"))


_WEIGHTS = f"{BUCKETS}, k AS (SELECT DISTINCT bucket FROM b WHERE bucket <= 3), w AS (SELECT bucket, exp(-power(bucket - (greatest(min(bucket) OVER (), 1) + 0.5 * (3 - greatest(min(bucket) OVER (), 1))), 2) / (2 * 0.8 * 0.8)) AS w FROM k), p AS (SELECT bucket, w / sum(w) OVER () AS p, bucket = min(bucket) OVER () AS e FROM w), q AS (SELECT bucket, p, e, sum(CASE WHEN e THEN p ELSE 0 END) OVER () AS pe FROM p), wt AS (SELECT bucket, CASE WHEN pe >= 0.3 THEN p WHEN e THEN 0.3 ELSE p * 0.7 / (1 - pe) END AS weight FROM q)"  # noqa: E501


@query("C2_mixture", f"WITH {_WEIGHTS} SELECT bucket, round(weight, 6) AS weight FROM wt")
def c2(s: SparkSession, d: str) -> DataFrame:
    return curriculum.mixture(buckets(s, d), 0.5, 1, 3, 0.8, 0.3).select("bucket", F.round("weight", 6).alias("weight"))


@query("C3_allotted", f"WITH {_WEIGHTS}, x AS (SELECT bucket, weight / sum(weight) OVER () * 128 AS e FROM wt), y AS (SELECT bucket, floor(e) AS base, row_number() OVER (ORDER BY round(e - floor(e), 9) DESC, bucket) AS r, 128 - sum(floor(e)) OVER () AS rest FROM x) SELECT bucket, CAST(base + CASE WHEN r <= rest THEN 1 ELSE 0 END AS BIGINT) AS n FROM y")  # noqa: E501
def c3(s: SparkSession, d: str) -> DataFrame:
    return curriculum.allotted(curriculum.mixture(buckets(s, d), 0.5, 1, 3, 0.8, 0.3), 128)


@query("C5_unlocked", f"WITH {BUCKETS}, o AS (SELECT b.*, row_number() OVER (PARTITION BY bucket ORDER BY {_MIX.format('task_id', 11)}, task_id) AS place, count(*) OVER (PARTITION BY bucket) AS size FROM b WHERE bucket <= greatest(2, (SELECT min(bucket) FROM b))), p AS (SELECT *, row_number() OVER (ORDER BY bucket, place) AS position FROM o) SELECT task_id, bucket, position FROM p WHERE place <= ceil(CAST(0.5 AS DOUBLE) * size) OR position <= 50")  # noqa: E501
def c5(s: SparkSession, d: str) -> DataFrame:
    return curriculum.unlocked(buckets(s, d), 0.5, 1, 3, 0.25, 0.75, 50, 11)


@query("C1_bag_draws", f"WITH {BUCKETS}, n AS (SELECT count(*) AS n FROM b), c AS (SELECT b.task_id, UNNEST(range(0, 3)) AS cycle FROM b), o AS (SELECT cycle, task_id, row_number() OVER (PARTITION BY cycle ORDER BY {_MIX.format('(task_id * 1000003 + cycle)', 5)}, task_id) AS place FROM c) SELECT CAST(cycle * n + place - 1 AS BIGINT) AS draw, CAST(cycle AS INTEGER) AS cycle, task_id FROM o, n WHERE cycle * n + place - 1 < 2 * n + 10")  # noqa: E501
def c1(s: SparkSession, d: str) -> DataFrame:
    pool = buckets(s, d)
    return curriculum.bag_draws(pool, 2 * pool.count() + 10, 5)


@query("C8_coverage", f"WITH {BUCKETS}, dr AS (SELECT task_id % 20 AS step, task_id, least(bucket, 4) AS bucket FROM b UNION ALL SELECT task_id % 7, task_id, least(bucket, 4) FROM b), f AS (SELECT task_id, bucket, min(step) AS step FROM dr GROUP BY task_id, bucket), nw AS (SELECT step, bucket, count(*) AS n_new FROM f GROUP BY step, bucket), c AS (SELECT step, bucket, count(*) AS n_drawn FROM dr GROUP BY step, bucket) SELECT c.step, c.bucket, c.n_drawn, CAST(sum(coalesce(n_new, 0)) OVER (PARTITION BY c.bucket ORDER BY c.step) AS BIGINT) AS n_seen FROM c LEFT JOIN nw ON nw.step = c.step AND nw.bucket = c.bucket")  # noqa: E501
def c8(s: SparkSession, d: str) -> DataFrame:
    b = buckets(s, d)
    draws = b.select((F.col("task_id") % 20).alias("step"), "task_id", "bucket").unionByName(b.select((F.col("task_id") % 7).alias("step"), "task_id", "bucket"))
    return curriculum.coverage(draws)


@query("G16_generated", "SELECT * FROM (VALUES " + ", ".join(f"('{p}', {generate.DEFAULT_ROWS[len(x)]}, true)" for p, x, _ in generate.RECIPES) + ") t(problem_type, n, all_valid)")
def g16(s: SparkSession, d: str) -> DataFrame:
    """The default dataset, generated and verified step by step (V1-V3)."""
    g = generate.verified(generate.questions(s))
    return g.groupBy("problem_type").agg(F.count("*").cast("int").alias("n"), F.bool_and("is_valid").alias("all_valid"))


# More of the same operators, one by one --------------------------------------------------------------

MESSAGE = "struct<role:string,content:string,tool_calls:array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>,tool_call_id:string,name:string>"


@query("P7_initial_messages", "SELECT question_id, 2 AS n, 'system' AS first_role, question AS query FROM questions")
def p7i(s: SparkSession, d: str) -> DataFrame:
    m = prepare.initial_messages(F.col("question"), "Answer by tools.")
    return table(s, d, "questions").select("question_id", m.alias("m")).select("question_id", F.size("m").alias("n"), F.col("m")[0]["role"].alias("first_role"), F.col("m")[1]["content"].alias("query"))


@query("P13_indexed_lists", "SELECT task_id, array_to_string(list_filter(list_transform(outputs, lambda x, i: CASE WHEN trim(coalesce(x, ''), ' ') <> '' THEN (i - 1) || ': ' || x END), lambda y: y IS NOT NULL), chr(10)) AS listed FROM tasks")
def p13(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "tasks").select("task_id", prepare.indexed_list(F.col("outputs")).alias("listed"))


@query("F8_role_filter", f"WITH {MESSAGES} SELECT idx, count(*) AS n_tool FROM mm WHERE role = 'tool' GROUP BY idx")
def f8(s: SparkSession, d: str) -> DataFrame:
    return chat(s, d).select("idx", F.size(F.filter("messages", lambda m: m["role"] == "tool")).cast("bigint").alias("n_tool")).filter("n_tool > 0")


@query("F4_drop_by_issues", f"{CALLS}, bad AS (SELECT idx FROM calls WHERE tool IS NOT NULL GROUP BY idx, tool HAVING count(*) > 1) SELECT idx FROM conversations_chat WHERE idx NOT IN (SELECT idx FROM bad)")
def f4(s: SparkSession, d: str) -> DataFrame:
    return chat(s, d).join(validate.repeated_calls(chat(s, d)).select("idx").distinct(), "idx", "left_anti").select("idx")


@query("J11_grid", "SELECT a * 10 + b AS place, CAST(a AS DOUBLE) / 10 AS first, CAST(b AS DOUBLE) / 10 AS second FROM range(0, 10) x(a), range(0, 10) y(b)")
def j11(s: SparkSession, d: str) -> DataFrame:
    """A grid of two axes, each point from the digits of its place, so nothing is joined."""
    a, b = generate.mixed_radix(F.col("id"), [10, 10])
    return s.range(100).select(F.col("id").alias("place"), (a / 10).alias("first"), (b / 10).alias("second"))


@query("A10_longest_message", f"WITH {MESSAGES}, w AS (SELECT idx, len(list_filter(regexp_split_to_array(content, '{_SPACE}+'), lambda w: w <> '')) AS n FROM mm WHERE role = 'assistant') SELECT c.idx, CAST(coalesce(max(n), 0) AS BIGINT) AS longest FROM conversations_chat c LEFT JOIN w ON w.idx = c.idx GROUP BY c.idx")
def a10(s: SparkSession, d: str) -> DataFrame:
    n = F.transform(F.filter("messages", lambda m: m["role"] == "assistant"), lambda m: F.size(F.filter(F.split(F.coalesce(m["content"], F.lit("")), r"(?U)\s+"), lambda w: w != "")))
    return chat(s, d).select("idx", F.coalesce(F.array_max(n), F.lit(0)).cast("bigint").alias("longest"))


@query("W6_last_answers", f"{ASSISTANT}, t AS (SELECT idx, pos, {_tag('answer')}[-1] AS answer FROM a) SELECT idx, arg_max(answer, pos) AS answer FROM t WHERE answer IS NOT NULL GROUP BY idx")
def w6(s: SparkSession, d: str) -> DataFrame:
    """The last answer of each conversation, by max_by over exploded messages."""
    t = contents(s, d).select("idx", "pos", text.last_content(F.col("content"), "answer").alias("answer")).filter("answer is not null")
    return t.groupBy("idx").agg(F.max_by("answer", "pos").alias("answer"))


@query("W3_ranked_messages", f"WITH {MESSAGES}, w AS (SELECT idx, pos, length(content) AS n FROM mm WHERE content IS NOT NULL) SELECT idx, pos, n FROM w QUALIFY row_number() OVER (ORDER BY n DESC, idx, pos) <= 20")
def w3(s: SparkSession, d: str) -> DataFrame:
    """The top twenty is the feature: a limit over a sort, no window over all rows (O2, O3)."""
    m = validate.messages(chat(s, d)).filter("content is not null").select("idx", "pos", F.length("content").cast("bigint").alias("n"))
    return m.orderBy(F.desc("n"), "idx", "pos").limit(20)


@query("O5_sorted_tools", f"{CALLS} SELECT idx, string_agg(DISTINCT tool, ',' ORDER BY tool) AS tools FROM calls WHERE tool IS NOT NULL GROUP BY idx")
def o5(s: SparkSession, d: str) -> DataFrame:
    names = F.filter(prepare.tool_sequence(F.col("messages")), lambda x: x.isNotNull())
    return chat(s, d).select("idx", F.array_sort(F.array_distinct(names)).alias("t")).filter(F.size("t") > 0).select("idx", F.array_join("t", ",").alias("tools"))


@query("U3_union_of_sets", "SELECT question_id FROM questions WHERE tool_calls_required >= 3 UNION SELECT question_id FROM questions WHERE entropy_used > 3")
def u3(s: SparkSession, d: str) -> DataFrame:
    q = table(s, d, "questions")
    return q.filter("tool_calls_required >= 3 or entropy_used > 3").select("question_id").distinct()


@query("U6_tool_difference", f"{CALLS}, u AS (SELECT c.idx, t.actions, (SELECT list(DISTINCT tool) FROM calls k WHERE k.idx = c.idx) AS used FROM conversations_chat c JOIN tasks t ON t.task_id = c.task_id WHERE t.actions IS NOT NULL) SELECT idx, coalesce(array_to_string(list_sort(list_distinct(list_filter(list_transform(actions, lambda a: a.name), lambda n: n IS NOT NULL AND NOT coalesce(list_contains(used, n), false)))), ','), '') AS missing FROM u")  # noqa: E501
def u6(s: SparkSession, d: str) -> DataFrame:
    """Tools that a conversation's task expects but the conversation never calls."""
    t = table(s, d, "tasks").filter("actions is not null").select("task_id", F.filter(F.transform("actions", lambda a: a["name"]), lambda n: n.isNotNull()).alias("expected"))
    c = chat(s, d).select("idx", "task_id", F.coalesce(prepare.tool_sequence(F.col("messages")), F.array().cast("array<string>")).alias("used"))
    return c.join(t, "task_id").select("idx", F.array_join(F.array_sort(F.array_except("expected", "used")), ",").alias("missing"))





@query("X23_stable_seeds")
def x23(s: SparkSession, d: str) -> DataFrame:
    """A seed for each question from base, type, topic and index; the hash differs between engines."""
    return table(s, d, "questions").select("question_id", prepare.hash_order(generate.SEED, "problem_type", "topic", "question_id").alias("seed"))


@query("X26_coprime_density", "SELECT p_partkey, round(list_product(list_transform(list_filter([2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37, 41, 43, 47], lambda p: p_size % p = 0), lambda p: 1 - 1.0::DOUBLE / p)), 6) AS density FROM part WHERE p_size > 1")
def x26(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").filter("p_size > 1").select("p_partkey", F.round(text.coprime_density(F.col("p_size")), 6).alias("density"))


@query("X28_difficulty_of_steps", "SELECT task_id, least(greatest(CAST(task_id AS DOUBLE) / 19, 0), 1) AS difficulty FROM tasks")
def x28(s: SparkSession, d: str) -> DataFrame:
    """Tasks as steps of a run of twenty."""
    return table(s, d, "tasks").select("task_id", curriculum.difficulty_at(F.col("task_id"), 20).alias("difficulty"))


@query("X29_chat_format", "SELECT idx, len(messages) > 0 AND list_bool_and(list_transform(messages, lambda m: m IS NOT NULL AND m.role IS NOT NULL)) AS ok FROM conversations_chat WHERE messages IS NOT NULL")
def x29(s: SparkSession, d: str) -> DataFrame:
    ok = (F.size("messages") > 0) & F.forall("messages", lambda m: m.isNotNull() & m["role"].isNotNull())
    return chat(s, d).filter("messages is not null").select("idx", ok.alias("ok"))


@query("V5_contract", "SELECT count(*) AS n, count_if(coalesce(trim(query, ' '), '') = '') AS n_blank, count_if(NOT coalesce(json_valid(ground_truth), false)) AS n_unreadable FROM base_dataset")
def v5(s: SparkSession, d: str) -> DataFrame:
    """Every row is checked, not only the first; missing columns are reported by prepare.missing_columns."""
    b = table(s, d, "base_dataset")
    readable = F.size(F.from_json(F.concat(F.lit("["), "ground_truth", F.lit("]")), "array<string>", {"allowSingleQuotes": "false"})) == 1
    return b.agg(F.count("*").alias("n"), F.count_if(F.trim(F.coalesce("query", F.lit(""))) == "").alias("n_blank"), F.count_if(~F.coalesce(readable, F.lit(False))).alias("n_unreadable"))


@query("R4_overuse", f"{CALLS}, n AS (SELECT idx, count(*) AS used FROM calls GROUP BY idx) SELECT n.idx, CAST(CASE WHEN len(t.actions) > 0 THEN least(greatest(used - len(t.actions), 0), 3) ELSE 0 END AS INTEGER) AS overuse FROM n JOIN conversations_chat c ON c.idx = n.idx JOIN tasks t ON t.task_id = c.task_id WHERE t.actions IS NOT NULL")
def r4(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "tasks").filter("actions is not null").select("task_id", F.size("actions").alias("expected"))
    c = chat(s, d).select("idx", "task_id", F.size(prepare.tool_sequence(F.col("messages"))).alias("used")).filter("used > 0").join(t, "task_id")
    return c.select("idx", metrics.overuse(F.col("used"), F.col("expected")).cast("int").alias("overuse"))


def actions(s: SparkSession, d: str) -> DataFrame:
    """Conversations as actions with what followed them: idx, actions, correct, expected."""
    acts = F.filter(F.transform("messages", lambda m, i: F.struct(m["role"].alias("role"), prepare.first_action(m)["name"].alias("name"), F.coalesce(m["content"], F.lit("")).alias("content"), F.get("messages", i + 1)["content"].alias("observation"))), lambda a: a["role"] == "assistant")  # noqa: E501
    return chat(s, d).select("idx", acts.alias("actions"), F.coalesce("is_correct", F.lit(False)).alias("correct"), F.greatest(F.size(validate.truths(F.col("stepwise_ground_truths"))), F.lit(0)).alias("expected"))


_ACTIONS = f"""WITH {MESSAGES}, f AS (SELECT idx, pos, m, lead(m.content) OVER (PARTITION BY idx ORDER BY pos) AS observation FROM ms),
act AS (SELECT idx, pos, coalesce(m.tool_calls[1].function.name, 'respond') AS name, coalesce(m.content, '') AS content, observation, row_number() OVER (PARTITION BY idx ORDER BY pos DESC) = 1 AS is_last FROM f WHERE m.role = 'assistant'),
sc AS (SELECT idx, count(*) AS n, bool_or(is_last AND name = 'respond') AS ends, sum(CASE WHEN len({_tag('think')}) > 0 THEN 1 ELSE 0 END) + sum(CASE WHEN is_last AND len({_tag('answer')}) > 0 THEN 2 ELSE 0 END) AS earned,
count_if(NOT is_last AND observation IS NOT NULL) AS seen, count_if(NOT is_last AND observation IS NOT NULL AND NOT (starts_with(observation, 'Error:') OR starts_with(observation, 'Unknown action'))) AS fine FROM act GROUP BY idx),
tr AS (SELECT idx, coalesce(is_correct, false) AS correct, CASE WHEN json_valid(stepwise_ground_truths) AND json_type(stepwise_ground_truths) = 'ARRAY' THEN CAST(list_sum(list_transform(CAST(stepwise_ground_truths AS JSON[]), lambda x: len(json_keys(x)))) AS BIGINT) ELSE 0 END AS expected FROM conversations_chat),
z AS (SELECT sc.*, tr.correct, tr.expected, CAST(earned AS DOUBLE) / (n + 2) AS format, CASE WHEN seen > 0 THEN CAST(fine AS DOUBLE) / seen ELSE 0 END AS success, CASE WHEN expected > 0 THEN least(greatest(n - 1 - expected, 0), 3) ELSE 0 END AS over, CASE WHEN expected > 0 THEN greatest(-0.5, -0.1 * abs(n - 1 - expected)) ELSE 0 END AS off FROM sc JOIN tr ON tr.idx = sc.idx) """  # noqa: E501


@query("R1_rewards", f"{_ACTIONS} SELECT idx, round(CASE WHEN n = 1 THEN -0.3 WHEN NOT ends THEN -1 ELSE (CAST(correct AS INTEGER) + 0.1 * format + 0.1 * success - 0.1 * over) / 1.2 END, 9) AS reward FROM z")
def r1(s: SparkSession, d: str) -> DataFrame:
    r = actions(s, d).filter(F.size("actions") > 0)
    return r.select("idx", F.round(metrics.reward(F.col("actions"), F.col("correct"), F.col("expected")), 9).alias("reward"))


@query("R2_format_scores", f"{_ACTIONS} SELECT idx, round(format, 9) AS format FROM z")
def r2(s: SparkSession, d: str) -> DataFrame:
    return actions(s, d).filter(F.size("actions") > 0).select("idx", F.round(metrics.format_score(F.col("actions")), 9).alias("format"))


@query("R3_tool_success", f"{_ACTIONS} SELECT idx, round(success, 9) AS success FROM z")
def r3(s: SparkSession, d: str) -> DataFrame:
    return actions(s, d).filter(F.size("actions") > 0).select("idx", F.round(metrics.tool_success(F.col("actions")), 9).alias("success"))


@query("R5_earlier_rewards", f"{_ACTIONS} SELECT idx, round(CASE WHEN n = 1 OR NOT ends THEN -1 ELSE 0.9 * CAST(correct AS INTEGER) + 0.1 * format + off END, 9) AS reward FROM z")
def r5(s: SparkSession, d: str) -> DataFrame:
    r = actions(s, d).filter(F.size("actions") > 0)
    return r.select("idx", F.round(metrics.earlier_reward(F.col("actions"), F.col("correct"), F.col("expected")), 9).alias("reward"))


@query("R6_reasoning_depth", f"{_ACTIONS} SELECT idx, round(avg(CASE WHEN length(content) > 100 AND length(content) < 400 THEN 1.0::DOUBLE ELSE 0.5 END), 9) AS depth FROM act GROUP BY idx")
def r6(s: SparkSession, d: str) -> DataFrame:
    """With limits that suit the texts of the table."""
    return actions(s, d).filter(F.size("actions") > 0).select("idx", F.round(metrics.reasoning_depth(F.col("actions"), 100, 400), 9).alias("depth"))


@query("R10_rollout_metrics", f"{_ACTIONS}, rw AS (SELECT idx, n, expected, round(CASE WHEN n = 1 THEN -0.3 WHEN NOT ends THEN -1 ELSE (CAST(correct AS INTEGER) + 0.1 * format + 0.1 * success - 0.1 * over) / 1.2 END, 9) AS r FROM z) SELECT idx, abs(r - 1) <= 1e-6 AS optimal, r > -0.3 AS valid, CAST(n - expected - 1 AS INTEGER) AS turn_deviation FROM rw")
def r10(s: SparkSession, d: str) -> DataFrame:
    r = actions(s, d).filter(F.size("actions") > 0).withColumn("reward", F.round(metrics.reward(F.col("actions"), F.col("correct"), F.col("expected")), 9))
    x = metrics.derived(F.col("reward"), F.size("actions"), F.col("expected") + 1)
    return r.select("idx", x["optimal"].alias("optimal"), x["valid"].alias("valid"), x["turn_deviation"].alias("turn_deviation"))


@query("C7_curriculum", f"WITH {BUCKETS}, n AS (SELECT count(*) AS n FROM b), st AS (SELECT step, (SELECT ceil(n / 16.0) FROM n) AS total FROM range(0, 1000000) r(step) WHERE step < (SELECT ceil(n / 16.0) FROM n)) SELECT step, round(CASE WHEN total <= 1 THEN 1.0 ELSE CAST(step AS DOUBLE) / (total - 1) END, 9) AS difficulty FROM st")
def c7(s: SparkSession, d: str) -> DataFrame:
    """Steps of one epoch of groups of sixteen and their difficulty: a pure function of the step, so resuming needs no replay."""
    steps = -(-buckets(s, d).count() // 16)
    return s.range(steps).select(F.col("id").alias("step"), F.round(curriculum.difficulty_at(F.col("id"), steps), 9).alias("difficulty"))


@query("T1_stream_equals_batch", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def t1(s: SparkSession, d: str) -> DataFrame:
    """Events as micro-batches into the shared folder, then counted."""
    from sparkloom.session import ensure_checkpoint_dir
    from sparkloom.streaming import micro

    ensure_checkpoint_dir(s)
    base = os.path.join(s.sparkContext.getCheckpointDir(), f"stream-{uuid.uuid4().hex}")
    events = table(s, d, "events").select("event_id", "event_type")
    events.repartition(4).write.parquet(f"{base}/in")
    micro.write_available(micro.read_files(s, f"{base}/in", events.schema, 2), f"{base}/out", f"{base}/mark")
    return s.read.parquet(f"{base}/out").groupBy("event_type").agg(F.count("*").alias("n"))


def _all() -> dict[str, tuple[Query, str | None]]:
    """The registry with the queries of the other modules of this package."""
    from sparkloom.plans import dialogue_queries, training_queries  # noqa: F401

    return REGISTRY


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql}
