"""Nested records, preparation, validation, metrics, curricula, streams and IO on small fixtures."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import curriculum, generate, metrics, nested, prepare, stats, validate
from sparkloom.sources import io

STEP = "struct<tool string, result string, step_id string, verification struct<dependent_on map<string,int>, inputs map<string,string>, generator_type string, input string>>".replace(" string", ":string").replace("verification struct", "verification:struct").replace("dependent_on map", "dependent_on:map").replace("inputs map", "inputs:map")
QUESTIONS = f"question_id bigint, stepwise array<{STEP}>, record_id string, src int, steps string"
BASE = "base_id bigint, stepwise_ground_truths string, dependency_edges string, tool string, step_pos int"


def step(tool, deps=None):
    return (tool, "1", "0", (deps, None, None, None))


def questions(spark, rows):
    return spark.createDataFrame([(i, s, "x", 1, "y") for i, s in rows], QUESTIONS)


def base(spark, rows):
    return spark.createDataFrame([(i, t, e, "x", 9) for i, t, e in rows], BASE)


def expected_links(q_rows, b_rows):
    """Brute force, row by row."""
    out = set()
    for i, steps in q_rows:
        for pos, s in enumerate(steps or []):
            if s is not None:
                deps = {v for v in ((s[3] and s[3][0]) or {}).values() if v is not None and 0 <= v < len(steps) and steps[v] is not None}
                out |= {("questions", i, pos, s[0], v) for v in deps or {-1}}
    for i, t, e in b_rows:
        try:
            v = json.loads(t)
            v = json.loads(v) if isinstance(v, str) else v
        except (ValueError, TypeError):
            continue
        v = [v] if isinstance(v, dict) else v
        if not isinstance(v, list):
            continue
        has = {p for p, x in enumerate(v) if isinstance(x, dict) and x}
        for pos in has:
            for tool in [v[pos]["tool"]] if "tool" in v[pos] else v[pos]:
                parents = {a for a, b in (json.loads(e) if e else []) if b == pos and a in has}
                out |= {("base_dataset", i, pos, tool, p) for p in parents or {-1}}
    return out


Q_ROWS = [
    (1, [step("a"), step("b", {"m": 0})]), (2, None), (3, []), (4, [None, step("a", {"m": 0, "n": 0}), step(None, {"x": 7, "y": -1})]), (5, [step("a", {"m": 0})]),
    (6, [step("a"), step("b", {}), step("c", {"p": 0, "q": 1, "r": 1, "s": None})]), (6, [step("a")]), (7, [(None, None, None, None)]),
]
B_ROWS = [
    (1, '[{"a": 1}, {"b": null}]', "[[0, 1], [0, 1], [5, 1]]"), (2, '{"a": {"v": 1}}', None), (3, json.dumps('[{"a": 1}]'), None), (4, '[null, {"tool": "t", "result": "x"}, {"a": 1, "b": 2}]', "[[1, 2], [0, 2], [1, 1]]"),
    (5, None, None), (6, "", None), (7, "null", None), (8, "[]", "[[0, 1]]"), (9, '[{"a": 1', None), (10, "[{'a': 1}]", None), (11, '[{"a": 1}] x', None), (12, '[{}, {"a": "' + "x" * 100_000 + '"}]', "[[0, 1]]"), (13, json.dumps('{"a": 1}'), None), (1, '[{"a": 1}]', None),
]


def test_links_equal_brute_force(spark):
    got = [tuple(r) for r in nested.flatten_links(questions(spark, Q_ROWS), base(spark, B_ROWS)).collect()]
    assert set(got) == expected_links(Q_ROWS, B_ROWS)


def test_links_of_empty_tables(spark):
    out = nested.flatten_links(questions(spark, []), base(spark, []))
    assert out.count() == 0 and out.columns == ["src", "record_id", "step_pos", "tool", "parent_pos"]


def test_every_record_and_step(spark):
    """Records without steps have a row, steps without a tool count, and the optional fields of steps are kept."""
    full = ("a", "5", "s0", (None, {"m": "x"}, "gen", "[[1]]"))
    q = questions(spark, Q_ROWS + [(8, [None, None]), (9, [full, step(None, {"m": 0})])]).withColumn("golden", F.expr("named_struct('final_answer', '7', 'from_step_id', 's0')"))
    b_rows = B_ROWS + [(90, None, None), (91, "{broken", None), (92, "[]", None), (93, '[{"tool": "t", "result": 3, "step_id": "z"}, {"u": 4}]', "[[0, 1]]")]
    b = base(spark, b_rows).withColumn("ground_truth", F.lit("g"))
    records = nested.all_records(q, b).collect()
    assert len(records) == len(Q_ROWS) + 2 + len(b_rows) and {r["final_answer"] for r in records} == {"7", "g"}
    of = {(r["src"], r["record_id"]): (r["n_steps"], r["n_links"]) for r in records}
    assert of["questions", 2] == of["questions", 3] == of["questions", 8] == of["base_dataset", 90] == of["base_dataset", 91] == of["base_dataset", 92] == (0, 0)
    assert of["questions", 9] == (2, 1) and of["questions", 4] == (2, 0) and of["base_dataset", 93] == (2, 1)
    steps, links = nested.flatten_steps(q, b).collect(), nested.flatten_links(q, b).collect()
    key = lambda r: (r["src"], r["record_id"], r["step_pos"], r["tool"])
    assert {key(r) for r in steps} == {key(r) for r in links} and sum(r["n_steps"] for r in records) == len(steps)
    assert sum(r["n_links"] for r in records) == sum(r["parent_pos"] >= 0 for r in links)
    assert [tuple(r)[3:] for r in steps if r["src"] == "questions" and r["record_id"] == 9] == [("a", "s0", "5", {"m": "x"}, "gen", "[[1]]"), (None, "0", "1", None, None, None)]
    assert [tuple(r)[2:6] for r in steps if r["record_id"] == 93] == [(0, "t", "z", "3"), (1, "u", None, "4")]


def test_links_of_random_records(spark):
    rng = random.Random(3)
    rows = []
    for i in range(300):
        n = rng.randint(0, 6)
        rows.append((i, [None if rng.random() < 0.2 else step(rng.choice("abc"), {f"k{j}": rng.randint(-2, n + 1) for j in range(rng.randint(0, 3))}) for _ in range(n)]))
    got = {tuple(r) for r in nested.question_links(questions(spark, rows)).collect()}
    assert got == expected_links(rows, [])


def test_records(spark):
    r = {(x["src"], x["record_id"]): (x["n_steps"], x["n_links"]) for x in nested.record_table(nested.question_links(questions(spark, [(1, [step("a"), step("b", {"m": 0})])]))).collect()}
    assert r == {("questions", 1): (2, 1)}


def test_value_statistics(spark):
    df = spark.createDataFrame([(0, "t", [("a", "[1, -2]"), ("b", "5")]), (1, "u", [("a", "[[3, 4], [0, -7]]")]), (2, "u", None)], "question_id bigint, problem_type string, stepwise array<struct<tool:string,result:string>>")
    rows = {(r["grouping"], r["step"], r["problem_type"]): r for r in stats.value_statistics(df).collect()}
    assert tuple(rows[3, None, None])[-4:] == (-7.0, 5.0, 0.0, 7)
    assert rows[1, 0, None]["n"] == 6 and rows[1, 1, None]["n"] == 1
    per = {r["question_id"]: r["n"] for r in stats.question_statistics(df).collect()}
    assert per == {0: 3, 1: 4, 2: 0}


def test_ranked(spark):
    runs = spark.createDataFrame([("a", -7.0, 5.0), ("b", -7.0, 11.0)], "run string, min_value double, max_value double")
    assert [(r["run"], r["score"]) for r in stats.ranked(runs, -10, 10, 10).collect()] == [("a", 8.0)]


def test_stratified_split_is_exact(spark):
    df = spark.range(1000).select(F.col("id"), F.when(F.col("id") % 10 == 0, F.lit(None)).otherwise(F.col("id") % 3).alias("k"))
    out = prepare.stratified_split(df, "k", "id", 0.1, 0.2, 1)
    assert out.count() == 1000
    for r in out.groupBy("k").agg(F.count("*").alias("n"), F.count_if(F.col("split") == "test").alias("t"), F.count_if(F.col("split") == "validation").alias("v")).collect():
        assert r["t"] == math.floor(r["n"] * 0.1) and r["t"] + r["v"] == math.floor(r["n"] * (0.1 + 0.2))


MESSAGE = "struct<role:string,content:string,tool_calls:array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>,tool_call_id:string,name:string>"


def conversation(*messages):
    return [(r, c, [(f"id{i}", "function", (t, "{}"))] if t else None, None, None) for i, (r, c, t) in enumerate(messages)]


CLEAN = conversation(("system", "s", None), ("user", "u", None), ("assistant", "<think>a</think>", "determinant"), ("tool", "-2.0", None), ("assistant", "<think>b</think><answer>-2.0</answer>", None))
WRONG = conversation(("system", "s", None), ("user", "u", None), ("assistant", "<think>a</think>", "rank"), ("tool", "-2.0", None), ("assistant", "<think>a</think><answer>3</answer>", None))


@pytest.fixture(scope="module")
def chats(spark):
    rows = [(1, CLEAN, '[{"determinant": -2.0}]'), (2, WRONG, '[{"determinant": -2.0}]'), (3, None, None), (4, [], "x"), (5, CLEAN[:2] + [None] + CLEAN[2:], '[{"determinant": -2.0}]')]
    return spark.createDataFrame(rows, f"idx bigint, messages array<{MESSAGE}>, stepwise_ground_truths string")


def test_checks(chats):
    of = {}
    for r in validate.issues(chats).collect():
        of.setdefault(r["idx"], set()).add(r["check_name"])
    assert 1 not in of and {"answer", "sequence", "thought"} <= of[2]
    assert [tuple(r) for r in validate.repeated_thoughts(chats).collect()] == [(2, 2, 4, True)]
    assert [(r["idx"], r["error"]) for r in validate.sequence_issues(chats).filter("idx = 2").collect()] == [(2, "tool name mismatch")]
    assert {r["idx"]: r["count_ok"] for r in validate.count_ok(chats).collect()} == {1: True, 2: True, 3: False, 4: False, 5: False}
    assert {r["idx"] for r in validate.clean(chats).collect()} == {1}
    lenient = {r["idx"]: r["f"] for r in chats.select("idx", validate.failed_checks(minimal=False, most_tokens=0).alias("f")).collect()}
    assert lenient == {1: ["tokens"], 2: ["answer", "tokens", "thought"], 3: ["count"], 4: ["count"], 5: ["count", "tokens"]}
    assert {r["check_name"]: r["n_failed"] for r in validate.issue_report(chats).collect()} == {"answer": 1, "repeated_call": 0, "sequence": 2, "count": 3, "tokens": 0, "thought": 1, "any": 4}


def test_edits_are_idempotent(spark, chats):
    config = io.cleaning_config(spark, {2: {"to_remove": "2,3", "to_replace": {4: "new"}, "initial_msg_count": 5, "expected_final_msg_count": 3}})
    once = validate.edited(chats, config).drop("as_expected")
    twice = validate.edited(once, config)
    row = twice.filter("idx = 2").first()
    assert row["as_expected"] and len(row["messages"]) == 3 and row["messages"][2]["content"].startswith("<think>new</think>")
    assert once.orderBy("idx").select("idx", F.size("messages")).collect() == twice.orderBy("idx").select("idx", F.size("messages")).collect()


THINK, FINAL = "<think>t</think>", "<think>t</think><answer>1</answer>"
REWARDS = [
    ([], 1, True, -1.0), ([("respond", FINAL, "")], 1, True, -0.3), ([("determinant", THINK, "1"), ("determinant", THINK, "1")], 1, True, -1.0),
    ([("determinant", THINK, "1"), ("respond", FINAL, "")], 1, True, 1.0), ([("determinant", THINK, "1"), ("respond", FINAL, "")], 1, False, 0.2 / 1.2),
    ([("determinant", THINK, "1")] * 3 + [("respond", FINAL, "")], 1, True, 1.0 / 1.2), ([("determinant", THINK, "1"), ("determinant", THINK, "Error: x"), ("respond", FINAL, "")], 2, True, 1.15 / 1.2),
]


def test_rewards(spark):
    df = spark.createDataFrame([(i, a, e, c) for i, (a, e, c, _) in enumerate(REWARDS)], "i int, a array<struct<name:string,content:string,observation:string>>, e int, c boolean")
    got = [r["r"] for r in df.select("i", metrics.reward(F.col("a"), F.col("c"), F.col("e")).alias("r")).orderBy("i").collect()]
    assert got == pytest.approx([x for *_, x in REWARDS])


def test_pass_hat_k(spark):
    df = spark.createDataFrame([("a", True)] * 3 + [("b", True), ("b", False), ("b", False)], "task string, success boolean")
    assert {r["k"]: r["pass_k"] for r in metrics.pass_hat_k(df, 4).collect()} == {1: 0.666667, 2: 0.5, 3: 0.5}


@pytest.mark.parametrize(("n", "expected"), [(0, None), (5, 5.0), (20, 19.95), (100, 95.95)])
def test_exclusive_p95(spark, n, expected):
    r = metrics.exclusive_p95(spark.range(1, n + 1).select(F.col("id").cast("double").alias("v")), "v").first()
    assert r["n"] == n and r["p95"] == expected


def test_allotted(spark):
    w = spark.createDataFrame([(1, 0.5), (2, 0.3), (3, 0.2)], "bucket int, weight double")
    assert {r["bucket"]: r["n"] for r in curriculum.allotted(w, 16).collect()} == {1: 8, 2: 5, 3: 3}
    assert {r["bucket"]: r["n"] for r in curriculum.allotted(w.withColumn("weight", F.lit(0.0)), 4).collect()} == {1: 2, 2: 1, 3: 1}


def test_unlocked_grows(spark):
    tasks = spark.range(200).select(F.col("id").alias("task_id"), (1 + F.col("id") % 4).cast("int").alias("bucket"))
    seen = set()
    for difficulty in (0.0, 0.3, 0.6, 1.0):
        now = {r["task_id"] for r in curriculum.unlocked(tasks, difficulty, 1, 4, 0.25, 1.0, 10).collect()}
        assert seen <= now
        seen = now
    assert len(seen) == 200


def test_bag_uses_all_before_repeating(spark):
    pool = spark.range(7).select(F.col("id").alias("task_id"))
    d = curriculum.bag_draws(pool, 17).orderBy("draw").collect()
    assert [r["draw"] for r in d] == list(range(17)) and len({r["task_id"] for r in d[:7]}) == 7 and len({r["task_id"] for r in d[7:14]}) == 7


def test_generated_rows_are_valid_and_stable(spark):
    g = generate.verified(generate.questions(spark, {1: 5, 2: 5, 3: 5}))
    assert g.filter("is_valid").count() == 13 * 5
    again = generate.questions(spark, {1: 5, 2: 5, 3: 5})
    assert {tuple(r) for r in g.select("problem_type", "i", "question", "final_answer").collect()} == {tuple(r) for r in again.select("problem_type", "i", "question", "final_answer").collect()}


def test_io(spark, tmp_path):
    df = spark.createDataFrame([(1, "train", True, "3"), (2, "test", False, "x"), (3, "train", None, None)], "i bigint, split string, is_correct boolean, task_index string").withColumn("trajectory_idx", F.col("i"))
    io.write_splits(df, str(tmp_path / "a"))
    assert io.read_split(spark, str(tmp_path / "a"), "train").count() == 2
    for _ in range(2):
        io.replace_dataset(df, str(tmp_path / "b"))
    assert spark.read.parquet(str(tmp_path / "b")).count() == 3
    io.write_by_outcome(df, str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c")).count() == 2
    io.write_trajectories(df, str(tmp_path / "d"))
    assert sorted(r["task_index"] for r in spark.read.json(str(tmp_path / "d")).collect()) == [2, 3, 3]


def test_stream_resumes(spark, tmp_path):
    from sparkloom.streaming import micro

    source, sink, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    df = spark.range(10).select("id", (F.col("id") % 2).cast("string").alias("k"))
    df.write.parquet(source)
    run = lambda: micro.write_available(micro.read_files(spark, source, df.schema, 1), sink, mark)
    run()
    df.write.mode("append").parquet(source)
    run()
    assert spark.read.parquet(sink).count() == 20
    counts = micro.running_counts(micro.read_files(spark, source, df.schema), "k", str(tmp_path / "counts"), mark + "2")
    assert {r["k"]: r["n"] for r in counts.collect()} == {"0": 10, "1": 10}
