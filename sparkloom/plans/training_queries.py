"""Queries of generation, curricula, reports and validation; names and SQL as in core_queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import linalg
from sparkloom.operators import curriculum, dialogue, generate, metrics, prepare, stats, validate
from sparkloom.plans.core_queries import _MIX, _THOUGHTS, _VALUE, BUCKETS, CALLS, buckets, chat, query
from sparkloom.session import table
from sparkloom.sources import io

# Validation --------------------------------------------------------------------------------------


@query("V15_structural_checks", f"""{CALLS}, {_THOUGHTS}, rc AS (SELECT DISTINCT idx FROM (SELECT idx, tool FROM calls WHERE tool IS NOT NULL GROUP BY idx, tool HAVING count(*) > 1)),
t AS (SELECT idx, len(messages) AS n, CASE WHEN json_valid(stepwise_ground_truths) AND json_type(stepwise_ground_truths) = 'ARRAY' THEN CAST(list_sum(list_transform(CAST(stepwise_ground_truths AS JSON[]), lambda x: len(json_keys(x)))) AS BIGINT) END AS k FROM conversations_chat),
w AS (SELECT idx, max(len(list_filter(regexp_split_to_array(content, '[\\s\\x0b\\x{{1c}}-\\x{{1f}}\\x{{85}}\\p{{Z}}]+'), lambda w: w <> ''))) AS longest FROM mm WHERE role = 'assistant' GROUP BY idx)
SELECT 'repeated_call' AS check_name, idx FROM rc UNION ALL SELECT 'count', idx FROM t WHERE NOT coalesce(n = 2 * k + 3, false) UNION ALL SELECT 'tokens', idx FROM w WHERE longest > 60
UNION ALL SELECT 'thought', idx FROM (SELECT idx, thought FROM th WHERE thought IS NOT NULL GROUP BY idx, thought HAVING count(*) > 1) GROUP BY idx""")  # noqa: E501
def v15s(s: SparkSession, d: str) -> DataFrame:
    """The checks of V15 that SQL can follow, from the same single pass; V9 and V11 compare literals."""
    return validate.issues(chat(s, d), most_tokens=60).filter(F.col("check_name").isin("repeated_call", "count", "tokens", "thought"))


@query("V9_scalar_answers", f"""WITH l AS (SELECT idx, messages[-1].content AS c, messages[-2].role AS role, messages[-2].content AS response FROM conversations_chat WHERE len(messages) >= 2),
a AS (SELECT idx, role, {_VALUE.format("trim(regexp_extract_all(c, '(?s)<answer>(.*?)</answer>', 1)[-1], ' ')")} AS x, {_VALUE.format("trim(response, ' ')")} AS y FROM l) SELECT idx FROM a WHERE role = 'tool' AND x IS NOT NULL AND y IS NOT NULL AND isfinite(x) AND isfinite(y) AND abs(x - y) > 1e-6""")
def v9s(s: SparkSession, d: str) -> DataFrame:
    """V9 where both sides are plain numbers; V9_answer_mismatch has all."""
    from sparkloom.functions import answers, text

    last, before = F.try_element_at("messages", F.lit(-1)), F.try_element_at("messages", F.lit(-2))
    both = answers.is_scalar(text.last_content(last["content"], "answer")) & answers.is_scalar(before["content"])
    return chat(s, d).filter(validate.answer_differs() & both).select("idx")


# Curricula ---------------------------------------------------------------------------------------


@query("C6_sample_to_length", f"WITH r AS (SELECT task_id, row_number() OVER (ORDER BY {_MIX.format('task_id', 3)}, task_id) AS place FROM tasks) SELECT CAST(place - 1 AS BIGINT) AS draw, task_id FROM r WHERE place <= 25")
def c6(s: SparkSession, d: str) -> DataFrame:
    return curriculum.sample_to_length(table(s, d, "tasks"), "task_id", 25, 3)


@query("C4_mixture_batches")
def c4(s: SparkSession, d: str) -> DataFrame:
    """Every batch of 16 of an epoch: a mixture of buckets drawn from bags over growing pools."""
    b = buckets(s, d)
    return curriculum.curriculum_draws(b, -(-b.count() // 16), 16, 1, 3, 0.8, 0.3, 0.25, 1.0, 7)


@query("C7_bucket_counts")
def c7(s: SparkSession, d: str) -> DataFrame:
    """How often each bucket is drawn at each step."""
    return c4(s, d).groupBy("step", "bucket").agg(F.count("*").alias("n"))


@query("C1_growing_bag", f"""WITH {BUCKETS}, r AS (SELECT task_id, row_number() OVER (ORDER BY {_MIX.format('task_id', 0)}, task_id) AS rank FROM b), n AS (SELECT count(*) AS n FROM b), k AS (SELECT n // 2 AS first_pool, n AS second_pool FROM n),
g AS (SELECT task_id, CASE WHEN rank <= first_pool THEN 0 ELSE 1 END AS level, first_pool FROM r, k), p AS (SELECT task_id, level, first_pool, row_number() OVER (PARTITION BY level ORDER BY {_MIX.format('(task_id * 1000003)', 5)}, task_id) AS place FROM g)
SELECT CAST(CASE WHEN level = 0 THEN place - 1 ELSE first_pool + place - 1 END AS BIGINT) AS draw, task_id FROM p""")
def c1g(s: SparkSession, d: str) -> DataFrame:
    """One cycle of a bag whose pool grows from half of the tasks to all of them before the half is used up."""
    b = buckets(s, d)
    ranked = prepare.with_rank(b.select("task_id", F.lit(0).alias("g"), prepare.mixed(F.col("task_id"), 0).alias("key")), ["g"], "key", "task_id").select("task_id", "rank")
    n = b.count()
    return curriculum.growing_bag(ranked, [n // 2, n], [n // 4, n - n // 4], 5).select("draw", "task_id")


# Generation --------------------------------------------------------------------------------------


@query("G1_admissible_integers", "SELECT p_partkey, true AS ok FROM part WHERE p_size > 1")
def g1(s: SparkSession, d: str) -> DataFrame:
    """A coprime integer of at least 2 in size for each part."""
    v = generate.admissible_integer(F.lit(1.3), F.col("p_partkey"), least=2, coprime_to=F.col("p_size"))
    p = table(s, d, "part").filter("p_size > 1").select("p_partkey", "p_size", v.alias("v"))
    return p.select("p_partkey", ((F.abs("v") >= 2) & (generate.gcd(F.col("v"), F.col("p_size")) == 1)).alias("ok"))


@query("G1_gcd", "SELECT p_partkey, gcd(p_size, p_partkey) AS g FROM part")
def g1g(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").select("p_partkey", generate.gcd(F.col("p_size"), F.col("p_partkey")).alias("g"))


@query("G2_rationals", "SELECT p_partkey, true AS ok FROM part")
def g2(s: SparkSession, d: str) -> DataFrame:
    """Numerator and denominator without common factor, the denominator at least 2."""
    p = table(s, d, "part").select("p_partkey", generate.rational(F.lit(2.0), F.col("p_partkey")).alias("r"))
    return p.select("p_partkey", ((F.col("r.denominator") >= 2) & (F.abs("r.numerator") >= 1) & (generate.gcd(F.col("r.numerator"), F.col("r.denominator")) == 1)).alias("ok"))


@query("G3_drawn_entropies", "SELECT count(*) AS n, true AS in_range, true AS centred FROM questions")
def g3(s: SparkSession, d: str) -> DataFrame:
    """Draws of a range, uniform and drawn to the centre: the latter's deviation is the smaller one."""
    e = lambda centred: generate.drawn_entropy(F.lit(1.0), F.lit(3.0), F.col("question_id"), centred=centred)
    q = table(s, d, "questions").select(e(False).alias("a"), e(True).alias("b"))
    return q.agg(F.count("*").alias("n"), F.bool_and(F.col("a").between(1, 3) & F.col("b").between(1, 3)).alias("in_range"), (F.stddev("b") < F.stddev("a")).alias("centred"))


@query("G4_budget_splits", "SELECT question_id, 7 AS parts, true AS within FROM questions")
def g4(s: SparkSession, d: str) -> DataFrame:
    """Seven modules over three components, the entropy split by a Dirichlet draw with a least share."""
    k = F.col("question_id")
    q = table(s, d, "questions").select("question_id", generate.split_counts(3, F.lit(7), k).alias("c"))
    q = q.select("question_id", "c", generate.split_entropy(F.lit(3.0), F.col("c"), k, least_share=0.2).alias("e"))
    ok = generate.within_budget(F.col("e"), F.lit(3.0)) & F.forall("e", lambda x: x >= 0.6 - 1e-9) & F.forall("c", lambda x: x >= 1)
    return q.select("question_id", F.aggregate("c", F.lit(0), lambda a, x: a + x).alias("parts"), ok.alias("within"))


@query("G5_invertible_matrices", "SELECT p_partkey, true AS ok FROM part")
def g5(s: SparkSession, d: str) -> DataFrame:
    m = generate.invertible_matrix(F.lit(1.0), (F.col("p_partkey") % 2 + 2).cast("int"), F.col("p_partkey"))
    return table(s, d, "part").select("p_partkey", linalg.fenced(m).alias("m")).select("p_partkey", (linalg.determinant(F.col("m")) != 0).alias("ok"))


@query("G8_dormant_kinds", "SELECT * FROM (VALUES ('linear_system_solver', 40), ('matrix_inverse', 40), ('matrix_matrix_multiplication', 40), ('matrix_vector_multiplication', 40)) t(problem_type, n)")
def g8(s: SparkSession, d: str) -> DataFrame:
    """Products, systems and inverses, forty of each with a result."""
    return generate.dormant_questions(s, 40).filter("result is not null").groupBy("problem_type").agg(F.count("*").cast("int").alias("n"))


@query("G15_dormant_recipes", "SELECT * FROM (VALUES ('two_cofactor_frobenius', 30, 30), ('two_cofactor_determinant', 30, 30), ('three_transpose_cofactor_trace', 20, 20), ('three_cofactor_transpose_determinant', 20, 20)) t(problem_type, n, n_valid)")
def g15(s: SparkSession, d: str) -> DataFrame:
    q = generate.verified(generate.questions(s, {1: 40, 2: 30, 3: 20}, recipes=generate.DORMANT))
    return q.groupBy("problem_type").agg(F.count("*").cast("int").alias("n"), F.count_if("is_valid").cast("int").alias("n_valid"))


@query("G18_grid_search")
def g18(s: SparkSession, d: str) -> DataFrame:
    """Entropies from 0.3 to 1.2 in steps of 0.1 with 200 samples each: determinants, ranked against a target range."""
    grid = generate.grid_statistics(s, "D", [round(0.3 + 0.1 * i, 1) for i in range(10)], 200)
    return stats.ranked(grid, -500.0, 500.0, 10)


@query("G19_template_samples", "SELECT a * 9 + b * 3 + c AS place, CAST(a AS INTEGER) AS first, CAST(b AS INTEGER) AS second, CAST(c AS INTEGER) AS third, 3 AS n_steps FROM range(0, 3) x(a), range(0, 3) y(b), range(0, 3) z(c)")
def g19(s: SparkSession, d: str) -> DataFrame:
    """Every combination of wordings of a three-step recipe once."""
    t = generate.template_samples(s, ("T", "C", "R"))
    w = F.col("wordings")
    return t.select("place", w[0].alias("first"), w[1].alias("second"), w[2].alias("third"), F.size(F.split("text", "\n")).alias("n_steps"))


@query("J12_mixed_radix", "SELECT p_partkey, CAST(p_partkey // 35 % 4 AS INTEGER) AS a, CAST(p_partkey // 7 % 5 AS INTEGER) AS b, CAST(p_partkey % 7 AS INTEGER) AS c FROM part")
def j12(s: SparkSession, d: str) -> DataFrame:
    digits = generate.mixed_radix(F.col("p_partkey"), [4, 5, 7])
    return table(s, d, "part").select("p_partkey", *[x.alias(n) for x, n in zip(digits, "abc")])


# Reports -----------------------------------------------------------------------------------------


@query("V8_optimised", "SELECT question_id, coalesce(entropy_used < 3.2 - 0.2 OR tool_calls_required < 2 - 0.2, false) AS optimised FROM questions")
def v8(s: SparkSession, d: str) -> DataFrame:
    runs = table(s, d, "questions").select("question_id", F.array(F.col("entropy_used"), F.col("tool_calls_required").cast("double")).alias("chosen"), F.array(F.lit(3.2), F.lit(2.0)).alias("upper"))
    return metrics.optimised(runs, 0.2).select("question_id", "optimised")


@query("K8_best_runs", "WITH r AS (SELECT problem_type, question_id AS run, abs(entropy_used - 2) AS score FROM questions WHERE problem_type IS NOT NULL AND entropy_used IS NOT NULL) SELECT problem_type, run, round(score, 6) AS score FROM r QUALIFY row_number() OVER (PARTITION BY problem_type ORDER BY round(score, 9), run) = 1")
def k8(s: SparkSession, d: str) -> DataFrame:
    """The question nearest to an entropy of 2 of each type."""
    r = table(s, d, "questions").filter("problem_type is not null and entropy_used is not null").select("problem_type", F.col("question_id").alias("run"), F.round(F.abs(F.col("entropy_used") - 2), 9).alias("score"))
    return metrics.best_per_problem(r).select("problem_type", "run", F.round("score", 6).alias("score"))


@query("K9_text_report", "SELECT 'Events' AS value UNION ALL SELECT 'event_type: ' || coalesce(event_type, '-') || ', n: ' || count(*) FROM events GROUP BY event_type")
def k9(s: SparkSession, d: str) -> DataFrame:
    return io.text_report(table(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n")), "Events")


@query("A16_labels", "SELECT event_type AS metric, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def a16(s: SparkSession, d: str) -> DataFrame:
    """Means under their names without the ending, counts left out."""
    m = table(s, d, "events").groupBy(F.concat("event_type", F.lit("_mean")).alias("metric")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    return metrics.without_mean_suffix(m)


@query("X12_hint_texts", "SELECT source, '[diag] Format error: ' || coalesce(source, 'none') || '.' AS first_line FROM conversations_chat GROUP BY source")
def x12(s: SparkSession, d: str) -> DataFrame:
    c = chat(s, d).select("source").distinct()
    return c.select("source", F.substring_index(dialogue.hint(F.coalesce("source", F.lit("none"))), "\n", 1).alias("first_line"))
