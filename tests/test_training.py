"""Generator draws, bags over growing pools, mixture batches, and reports on fixtures."""

import math
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkloom.functions import exact
from sparkloom.operators import curriculum, generate, metrics, prepare
from sparkloom.sources import io


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 9), st.integers(0, 12)), max_size=8))
def test_cycles_draw_everything_once(steps):
    pools, size = [], 0
    for p, _ in steps:
        size = max(size, p)
        pools.append(size)
    draws = [n for _, n in steps]
    cycles = curriculum.bag_cycles(pools, draws)
    assert sum(c[2] for c in cycles) == sum(draws)
    for number, start, n, sizes in cycles[:-1]:
        assert n == sizes[-1] and sizes == sorted(sizes)  # a cycle ends when all that is in the pool was drawn
    assert [c[1] for c in cycles] == [sum(x[2] for x in cycles[:i]) for i in range(len(cycles))]


def test_growing_bag(spark):
    tasks = spark.createDataFrame([(100 + i, i) for i in range(1, 9)], "task_id bigint, rank bigint")
    pools, draws = [3, 3, 5, 8], [2, 4, 3, 9]
    got = sorted(tuple(r) for r in curriculum.growing_bag(tasks, pools, draws, 1).collect())
    assert [r[1] for r in sorted(got, key=lambda r: r[1])] == list(range(18)) and [sum(r[0] == i for r in got) for i in range(4)] == draws
    assert all(t - 100 <= pools[s] for s, _, t in got)  # only what is in the pool
    order = [t for _, _, t in sorted(got, key=lambda r: r[1])]
    for number, start, n, sizes in curriculum.bag_cycles(pools, draws):
        assert len(set(order[start : start + n])) == n  # no repeat within a cycle
    assert curriculum.growing_bag(tasks, [], [], 1).count() == 0


def test_curriculum_draws(spark):
    tasks = spark.createDataFrame([(i, 1 + i % 3) for i in range(90)], "task_id bigint, bucket int")
    got = curriculum.curriculum_draws(tasks, 6, 12, 1, 3, 0.8, 0.3, 0.25, 1.0, 7).collect()
    again = curriculum.curriculum_draws(tasks, 6, 12, 1, 3, 0.8, 0.3, 0.25, 1.0, 7).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again)) and len(got) == 72
    assert all(sorted(r["place"] for r in got if r["step"] == s) == list(range(1, 13)) for s in range(6))
    easy = [sum(r["step"] == s and r["bucket"] == 1 for r in got) for s in range(6)]
    assert easy[0] > easy[-1] >= math.floor(0.3 * 12) and all(r["bucket"] == 1 + r["task_id"] % 3 for r in got)
    assert curriculum.curriculum_draws(tasks.filter("false"), 3, 4, 1, 3, 0.8, 0.3, 0.25, 1.0).count() == 0
    assert curriculum.mixture_weights([1, 2, 3], 0.5, 1, 3, 0.0, 0.0) == [0.0, 1.0, 0.0] and curriculum.whole_counts([0.5, 0.25, 0.25], 5) == [3, 1, 1]


def test_plans_agree_with_columns(spark):
    b = spark.createDataFrame([(k,) for k in (1, 2, 3)], "bucket int")
    w = curriculum.mixture(b, 0.4, 1, 3, 0.7, 0.3)
    held = {r["bucket"]: r["weight"] for r in w.collect()}
    assert [held[k] for k in (1, 2, 3)] == pytest.approx(curriculum.mixture_weights([1, 2, 3], 0.4, 1, 3, 0.7, 0.3))
    counts = {r["bucket"]: r["n"] for r in curriculum.allotted(w, 17).collect()}
    assert [counts[k] for k in (1, 2, 3)] == curriculum.whole_counts([held[k] for k in (1, 2, 3)], 17)


def test_sample_to_length(spark):
    df = spark.range(10).withColumnRenamed("id", "k")
    few, many = ([r["k"] for r in curriculum.sample_to_length(df, "k", n, 1).collect()] for n in (4, 25))
    assert len(set(few)) == 4 and len(many) == 25 and set(many) <= set(range(10))
    assert curriculum.sample_to_length(df, "k", 0).count() == 0 and curriculum.sample_to_length(df.filter("false"), "k", 5).count() == 0


def test_draws(spark):
    i = F.col("id")
    df = spark.range(400)
    r = df.select(
        generate.admissible_integer(F.lit(1.0), i, least=3, coprime_to=F.lit(6)).alias("v"), generate.admissible_integer(F.lit(0.5), i, signed=False, least=2).alias("u"), generate.rational(F.lit(1.5), i).alias("q"),
        generate.drawn_entropy(F.lit(0.0), F.lit(1.0), i, centred=True).alias("b"), generate.split_counts(3, F.lit(6), i).alias("c"), generate.gcd(i, F.lit(12)).alias("g"),
    ).collect()
    assert all(abs(x["v"]) >= 3 and math.gcd(x["v"], 6) == 1 for x in r) and {x["u"] for x in r} == {2, 3, 4, 5, 6}
    assert all(math.gcd(x["q"]["numerator"], x["q"]["denominator"]) == 1 and x["q"]["denominator"] >= 2 for x in r)
    mean = sum(x["b"] for x in r) / 400
    assert abs(mean - 0.5) < 0.05 and abs(sum((x["b"] - mean) ** 2 for x in r) / 400 - 0.05) < 0.015  # of Beta(2, 2): 1/20
    assert all(sum(x["c"]) == 6 and min(x["c"]) >= 1 for x in r) and len({tuple(x["c"]) for x in r}) == 10  # all compositions
    assert [x["g"] for x in r] == [math.gcd(k, 12) for k in range(400)]
    e = df.select(generate.split_entropy(F.lit(2.0), F.array(F.lit(1), F.lit(2)), i, least_share=0.1).alias("e")).collect()
    assert all(sum(x["e"]) == pytest.approx(2.0) and min(x["e"]) >= 0.2 - 1e-9 for x in e) and abs(sum(x["e"][0] for x in e) / 400 - (0.2 + 1.6 / 3)) < 0.06
    m = df.select(generate.invertible_matrix(F.lit(0.5), F.lit(2), i).alias("m")).collect()
    assert all(exact.determinant(x["m"]) != 0 for x in m)
    assert df.limit(1).select(generate.within_budget(F.array(F.lit(0.1), F.lit(0.2)), F.lit(0.3)).alias("ok")).first()["ok"]


def test_generated_rows_and_tampering(spark):
    q = generate.questions(spark, {1: 6, 2: 6, 3: 6}, recipes=generate.RECIPES + generate.DORMANT)
    v = generate.verified(q)
    assert v.filter("not is_valid").count() == 0 and v.count() == 17 * 6
    assert q.filter("question like '%null%' or question like '%{%'").count() == 0 and q.select("question").distinct().count() == 17 * 6
    bad = q.withColumn("stepwise", F.transform("stepwise", lambda s: F.when(s["tool"] == "determinant", s.withField("result", F.lit("12345.0"))).otherwise(s)))
    assert generate.verified(bad).filter("is_valid").filter(F.exists("stepwise", lambda s: s["tool"] == "determinant")).count() == 0
    two = {r["text"] for r in generate.template_samples(spark, ("T", "C")).collect()}
    assert len(two) == 9 and all("\n" in t and "{matrix}" in t and "the result from step 1" in t for t in two)


def test_constraints():
    assert generate.merged_constraints({"rows": 2, "entropy": (0.1, 2.0)}, {"size": 3, "rows": None}) == {"rows": 2, "entropy": (0.1, 2.0), "size": 3}
    for bad in (({"rows": 2}, {"rows": 3}), ({"rows": 0}, {}), ({"entropy": (2.0, 1.0)}, {}), ({"entropy": -1.0}, {})):
        with pytest.raises(ValueError):
            generate.merged_constraints(*bad)


def test_percentile_of_hot_values(spark):
    import statistics

    for values in ([1.0] * 500 + [2.0] * 30 + [float(i) for i in range(3, 20)], [3.0, 1.0, 2.0], [5.0] * 40, [float(i) for i in range(1, 20)], [float(i % 7) for i in range(20)]):
        got = metrics.exclusive_p95(spark.createDataFrame([(v,) for v in values] + [(None,)], "v double"), "v").first()
        expected = max(values) if len(values) < 20 else statistics.quantiles(values, n=20, method="exclusive")[-1]
        assert got["n"] == len(values) and got["p95"] == pytest.approx(expected)
    none = metrics.exclusive_p95(spark.createDataFrame([], "v double"), "v").first()
    assert none["n"] == 0 and none["p95"] is None


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 2.0, "x"), ("a", 1.0, "y"), ("b", 1.0, "z")], "problem_type string, score double, run string")
    io.append_results(df, str(tmp_path / "runs"))
    io.append_results(df, str(tmp_path / "runs"))
    assert spark.read.json(str(tmp_path / "runs")).count() == 6
    io.write_ranking(df, str(tmp_path / "top"), 2)
    assert spark.read.json(str(tmp_path / "top")).count() == 2
    assert {tuple(r) for r in metrics.best_per_problem(df).collect()} == {("a", "y", 1.0), ("b", "z", 1.0)}
    lines = io.write_report(df.select("run", "score"), "Runs", str(tmp_path / "report"))
    assert lines[0] == "Runs" and lines[1] == "run: x, score: 2.0" and len(lines) == 4
    io.replace_dataset(df, str(tmp_path / "set"))
    io.replace_dataset(df.limit(1), str(tmp_path / "set"))
    assert spark.read.parquet(str(tmp_path / "set")).count() == 1 and sorted(x for x in os.listdir(tmp_path) if "__" in x) == []
    made = prepare.to_schema(df, "run string, score int, more string").first()
    assert made["score"] == 2 and made["more"] is None
    assert prepare.call_row(df, ["run"], {"n": F.lit(1)}, {"a": F.col("score"), "b": F.lit(None)}).first()["metadata"] == {"a": "2.0"}


def test_arrow_folders(spark, tmp_path):
    import pyarrow as pa

    t = pa.table({"a": [1, 2, 3], "b": ["x", None, "z"]})
    with pa.OSFile(str(tmp_path / "one.arrow"), "wb") as f, pa.ipc.new_stream(f, t.schema) as w:
        w.write_table(t)
    with pa.OSFile(str(tmp_path / "two.arrow"), "wb") as f, pa.ipc.new_file(f, t.schema) as w:
        w.write_table(t, max_chunksize=2)
    assert sorted((r["a"], r["b"] or "") for r in io.read_arrow(spark, str(tmp_path)).collect()) == [(1, "x"), (1, "x"), (2, ""), (2, ""), (3, "z"), (3, "z")]
    with pytest.raises(FileNotFoundError):
        io.read_arrow(spark, str(tmp_path / ".."))


def test_small_pieces(spark):
    assert [prepare.subset_size(10, n) for n in (None, -1, 3, 30)] == [10, 10, 3, 10]
    df = spark.createDataFrame([([1, 2], [3, 4]), ([1], [3, 4]), ([], [])], "a array<int>, b array<int>")
    z = [r["z"] for r in df.select(prepare.zipped(x=F.col("a"), y=F.col("b")).alias("z")).collect()]
    assert [tuple(x) for x in z[0]] == [(1, 3), (2, 4)] and z[1] is None and z[2] == []
    assert "matrix_rank" in prepare.system_prompt([{"function": {"name": "matrix_rank"}}])
