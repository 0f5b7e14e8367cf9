"""Tags, JSON and answers by fixtures."""

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import answers, text
from sparkloom.functions.linalg import TOOLS

CALL = '<tool_call>{"name":"determinant","arguments":{"matrix":[[1]]}}</tool_call>'
MESSAGES = [
    ("<think>a</think><answer>2</answer>", True, "unspecified issue"),
    ("<think>a</think><answer>2</answer>", False, "answer without tool response"),
    ("<think>a</think>" + CALL, False, "unspecified issue"),
    ('<think>a</think><tool_call>{"name":"determinant","arguments":"{\\"matrix\\":[[1]]}"}</tool_call>', False, "unspecified issue"),
    ("<think>a</think><tool_call>{bad}</tool_call>", False, "invalid tool JSON"),
    ('<think>a</think><tool_call>{"name":"determinant","arguments":"[1]"}</tool_call>', False, "invalid tool arguments"),
    ('<think>a</think><tool_call>{"name":"foo","arguments":{}}</tool_call>', False, "unknown tool name"),
    ("<think>a</think><think>b</think><answer>2</answer>", True, "multiple <think> blocks (nested/repeated)"),
    ("<answer>2</answer>", True, "missing <think>"),
    ("<think>a</think>", True, "no tool call or answer"),
    ("plain text", True, "no <think>/<tool_call>/<answer> blocks"),
    ("<think>a</think>x<answer>2</answer>", True, "content outside allowed tags"),
    ("<think>a</think><tool_call>{}</tool_call><answer>2</answer>", True, "both tool call and answer present"),
    ("<think>a</think><answer>1</answer><answer>2</answer>", True, "multiple <answer> blocks (nested/repeated)"),
    ("<think>a</think><answer>2", True, "no tool call or answer"),
    ("<answer>2</answer><think>a</think>", True, "invalid format"),
]


def test_failure_reasons(spark):
    df = spark.createDataFrame([(i, c, p) for i, (c, p, _) in enumerate(MESSAGES)], "i int, c string, p boolean")
    got = df.withColumn("a", text.analysis(F.col("c"), TOOLS)).select("i", text.failure_reason(F.col("a"), F.col("p")).alias("r")).orderBy("i").collect()
    assert [r["r"] for r in got] == [e for *_, e in MESSAGES]


EQUAL = [
    ("42", "42", True), ("-17.5", "-17.5", True), ("[[1, 2], [3, 4]]", "[[1, 2], [3, 4]]", True), ("[1, 2, 3]", "[1, 2, 3]", True), ("1.5e-10", "1.5e-10", True), ("2.0", "2", True),
    ("[[1.0, 2.0], [3.0, 4.0]]", "[[1, 2], [3, 4]]", True), ("0.0", "0", True), ("-0", "0", True), ("42", "43", False), ("-17.5", "17.5", False), ("[[1, 2], [3, 4]]", "[[4, 3], [2, 1]]", False),
    ("[1, 2, 3]", "[3, 2, 1]", False), ("5", "0", False), ("<answer>42</answer>", "42", False), ("The answer is 42", "42", False), ("[[1, 2], [3, 4", "[[1, 2], [3, 4]]", False), ("42.5.6", "42.5", False),
    ("[[1, 2]] and [[3, 4]]", "[[1, 2]]", False), ("", "42", False), ("42", "", False), ("", "", False), (None, "1", False), ("(1, 2)", "[1, 2]", True), ("[1, 2]", "[[1], [2]]", True), ("1", "[[1]]", False),
]


def test_answers(spark):
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(EQUAL)], "i int, a string, b string")
    got = df.select("i", answers.equal(F.col("a"), F.col("b")).alias("e")).orderBy("i").collect()
    assert [(EQUAL[r["i"]], r["e"]) for r in got if r["e"] != EQUAL[r["i"]][2]] == []


@pytest.mark.parametrize(
    ("f", "given", "expected"),
    [
        (text.spaced_think, "<think>  a </think>b", "<think>\na\n</think>b"),
        (text.with_think_prefix, " <think>a", " <think>a"),
        (text.with_think_prefix, "a", "<think>a"),
        (lambda c: text.hidden_thoughts(c, "$1"), "<think>a</think>b", "$1b"),
        (lambda c: text.replaced_content(c, "think", F.lit("a\\b$1")), "<think>x</think>y", "<think>a\\b$1</think>y"),
        (lambda c: text.partial_content(c, "answer"), "x<answer>12", "12"),
        (text.label, "a" * 100, "a" * 93 + "..."),
        (text.repository_name, "--a b//c--.", "a-b-c"),
        (text.escaped, "<a & 'b'>", "&lt;a &amp; &#x27;b&#x27;&gt;"),
        (text.normalized, "ﬁ −1", "fi -1"),
        (text.arguments, '"{\\"a\\": 1}"', '{"a": 1}'),
        (text.arguments, "[1]", "{}"),
        (text.arguments, None, "{}"),
        (text.strip, "  a ", "a"),
    ],
)
def test_text_functions(spark, f, given, expected):
    assert spark.createDataFrame([(given,)], "c string").select(f(F.col("c")).alias("r")).first()["r"] == expected


def test_coprime_density(spark):
    assert spark.createDataFrame([(6,)], "n int").select(F.round(text.coprime_density(F.col("n")), 6)).first()[0] == round(0.5 * 2 / 3, 6)


def test_answer_queries_run_on_every_row(spark, tmp_path):
    """Matrices, prose, broken literals and letters that normalisation changes."""
    from sparkloom.plans import core_queries

    rows = [
        (1, "½ ﬁt −1", "[[1, 2], [3, 4]]", ("[[1.0,2],[3,4]]",)), (2, "x²", "(1, 2)", ("[1, 2]",)), (3, "plain", "So the rank is 2.", ("2",)), (4, "é", "[[1, 2], [3", ("[[1, 2], [3, 4]]",)),
        (5, None, None, ("2",)), (6, "a", "−2.5", ("-2.5",)), (7, "a", "[[2]]", ("2",)), (8, "a", "[1, x]", ("[1, x]",)), (9, "a", "[[1, 2]]", ("[[1, 3]]",)), (10, "a", "2", None),
    ]
    spark.createDataFrame(rows, "question_id bigint, question string, answer string, golden struct<final_answer:string>").write.parquet(f"{tmp_path}/questions.parquet")
    got = {q: dict(tuple(r) for r in core_queries.queries()[q](spark, str(tmp_path)).collect()) for q in ("X9_normalized_all", "X16_literals_all", "X17_equal_all")}
    assert all(set(g) == set(range(1, 11)) for g in got.values())
    assert [got["X9_normalized_all"][i] for i in range(1, 6)] == [len("1⁄2 fit -1"), 2, 5, 1, None]
    assert got["X16_literals_all"][1] == [[1.0, 2.0], [3.0, 4.0]] and got["X16_literals_all"][2] == [[1.0], [2.0]] and got["X16_literals_all"][6] == [[-2.5]]
    assert all(got["X16_literals_all"][i] is None for i in (3, 4, 5))
    assert {i for i, same in got["X17_equal_all"].items() if same} == {1, 2, 6}
