"""Conversations: multi-turn runs over given outputs, hints, formats, rewards, on fixtures."""

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import dialogue as D

CALL = '<think>a</think><tool_call>{"name": "determinant", "arguments": {"matrix": [[2, 0], [0, 3]]}}</tool_call>'
LARGE = '<think>a</think><tool_call>{"name": "determinant", "arguments": {"matrix": [[2,0,0,0],[0,3,0,0],[0,0,1,0],[0,0,0,1]]}}</tool_call>'
BROKEN = '<think>a</think><tool_call>{"name": "determinant", "arguments": {"matrix": [[1, 2]]}}</tool_call>'
ANSWER = "<think>b</think><answer>6</answer>"


def run(spark, outputs, n_turns=5, queries=(1, 2, 3, 4, 5, 6, 7)):
    q = spark.createDataFrame([(i, f"query {i}") for i in queries], "idx bigint, query string")
    o = spark.createDataFrame([(i, t, x) for i, held in outputs.items() for t, x in enumerate(held)], "idx bigint, turn int, output string")
    return {r["idx"]: r for r in D.multi_turn(q, o, n_turns).collect()}


def test_multi_turn(spark):
    got = run(spark, {1: [CALL, ANSWER, "more"], 2: [ANSWER, CALL, ANSWER], 3: [None, "", "plain text", LARGE[7:], ANSWER], 4: [BROKEN, ANSWER], 5: [CALL] * 7, 6: ["<think>x</think>"]})
    one = got[1]
    assert one["final_answer"] == "6" and one["n_used"] == 2 and one["tools"] == ["determinant"] and one["malformed_turns"] == one["tool_errors"] == 0
    assert [m["role"] for m in one["messages"]] == ["user", "assistant", "tool", "assistant"] and one["messages"][2]["content"] == "6.0"
    assert one["messages"][1]["tool_calls"][0]["id"] == one["messages"][2]["tool_call_id"] and one["messages"][3]["content"] == "<think>b</think>\n\n<answer>6</answer>"
    assert got[2]["diagnostics"] == ["turn 0: answer without tool response"] and got[2]["final_answer"] == "6" and got[2]["n_used"] == 3
    assert got[3]["malformed_turns"] == 3 and got[3]["diagnostics"][:2] == ["turn 0: empty generation", "turn 1: empty generation"] and got[3]["messages"][2]["content"] == "6.0" and got[3]["final_answer"] == "6"
    assert got[4]["tool_errors"] == 1 and got[4]["messages"][2]["content"] == "ERROR: ValueError: Matrix must be square"
    assert got[5]["n_used"] == 5 and got[5]["final_answer"] is None and len(got[5]["tools"]) == 4 and got[5]["messages"][-1]["role"] == "assistant"  # the last call isn't carried out
    assert got[6]["diagnostics"] == ["turn 0: no tool call or answer"] and len(got[7]["messages"]) == 1 and got[7]["n_used"] == 0
    assert run(spark, {}, queries=()) == {}


def messages(spark, rows):
    return spark.createDataFrame([([(r, c, None, None, None) for r, c in rows],)], f"m array<{D.MESSAGE}>")


def test_hints_go_with_their_cause(spark):
    rows = [("system", "s"), ("user", "[diag] kept, as it is the first"), ("assistant", "bad"), ("user", "[diag] one"), ("assistant", "bad 2"), ("user", " [diag] two"), ("assistant", "good")]
    contents = lambda c: messages(spark, rows).select(F.transform(c, lambda m: m["content"]).alias("x")).first()["x"]
    m = F.col("m")
    assert contents(D.without_hints(m)) == ["s", "[diag] kept, as it is the first", "good"]
    assert contents(D.without_hints(m, with_cause=False)) == ["s", "[diag] kept, as it is the first", "bad", "bad 2", "good"]
    assert contents(D.without_hints(m, keep=1)) == ["s", "[diag] kept, as it is the first", "bad 2", " [diag] two", "good"]
    assert contents(D.final_output(m, keep_system=False)) == ["[diag] kept, as it is the first", "good"]
    assert messages(spark, []).select(D.final_output(m).alias("x")).first()["x"] == []


def test_messages(spark):
    df = messages(spark, [("system", "s"), ("user", "q")])
    ok = df.select(D.appended(F.col("m"), D.message("assistant", F.lit("a"))).alias("x")).first()["x"]
    assert [m["content"] for m in ok] == ["s", "q", "a"]
    twice = messages(spark, [("assistant", "a")]).select(D.appended(F.col("m"), D.message("assistant", F.lit("b"))).alias("x"), D.appended(F.col("m"), F.lit(None).cast(D.MESSAGE)).alias("y")).first()
    assert twice["x"] is None and len(twice["y"]) == 1
    r = df.select(D.with_reasoning(F.lit(None), F.lit("x")).alias("a"), D.user_echo(F.lit("x")).alias("b"), D.truncated(F.lit(5), F.lit(5)).alias("c"), D.truncated(F.lit(None), F.lit(5)).alias("d"), D.failure_prompt(F.array(F.lit("r1"), F.lit("r2"))).alias("e")).first()
    assert r["a"] == "<think></think>x" and r["b"] == "x\n" and r["c"] and not r["d"] and "ROLLOUT 2" in r["e"]
    assert df.select(D.hint(F.lit("missing <think>")).alias("h")).first()["h"].startswith("[diag] Format error: missing <think>.\nRequired")


@pytest.mark.parametrize(
    ("content", "marks"),
    [("</think><answer>1</answer>", 3), ("</think><tool_call>x</tool_call><answer>", 3), ("</think></think><answer>", 1), ("<answer><answer></answer>", 1), ("<tool_call><answer>1</answer>", 1), (None, 0), ("", 0)],
)
def test_partial_format(spark, content, marks):
    df = spark.createDataFrame([(content,)], "c string")
    assert df.select(D.partial_format(F.col("c")).alias("n")).first()["n"] == marks


def test_rewards(spark):
    df = spark.createDataFrame([('{"a": [1, {"c": 2, "b": null}]}', '{"a": [1, {"b": null, "c": 2}]}', ["1,234"], ["so 1234."]), ("{}", "[]", None, None), ("x", "x", ["7"], [None, "8"])], "d string, e string, o array<string>, r array<string>")
    assert [r[0] for r in df.select(D.environment_reward(F.col("d"), F.col("e"), F.col("o"), F.col("r"))).collect()] == [1.0, 0.0, 0.0]
    turns = spark.createDataFrame([(1, 0, 5), (1, 1, None), (2, 0, 50)], "idx int, turn int, completion_tokens int")
    got = {r["idx"]: r for r in D.solve_counters(turns, 3, 50).collect()}
    assert got[1]["total_tokens"] == 5 and got[1]["steps"] == 2 and not got[1]["forced_stop"] and got[2]["forced_stop"]


def test_evaluation(spark):
    o = spark.createDataFrame([(1, 0, CALL), (1, 1, ANSWER), (1, 2, CALL), (2, 0, "junk"), (2, 1, CALL), (3, 0, CALL), (3, 1, CALL)], "idx bigint, turn int, output string")
    got = {r["idx"]: tuple(r)[1:] for r in D.evaluation_turns(D.judged_turns(o), spark.createDataFrame([(1, 2), (2, 2), (3, 1)], "idx bigint, steps int")).collect()}
    assert got == {1: (2, "6", "final_answer_provided"), 2: (1, None, "extraction_failed"), 3: (2, None, None)}
    c = spark.createDataFrame(
        [([("system", "s", None, None, None), ("user", "q", None, None, None), ("assistant", CALL, None, None, None), ("tool", "6.0", None, None, None), ("assistant", ANSWER, None, None, None)], '[{"determinant": 6.0}]', "6.0"), (None, None, None)],
        f"messages array<{D.MESSAGE}>, stepwise_ground_truths string, ground_truth string",
    )
    n = D.evaluation_counts(c).first()
    assert tuple(n) == (2, 1, 1, 2, 1, 1) and tuple(D.evaluation_ratios(D.evaluation_counts(c)).first()) == (0.666667, 1.0, 0.5, 0.5)
