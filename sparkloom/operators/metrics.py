"""Rewards of single trajectories and metrics over many."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import text


def is_error(observation: Column) -> Column:
    """A tool response that reports a failure."""
    return F.coalesce(observation.startswith("Error:") | observation.startswith("Unknown action"), F.lit(False))


def calls_of(actions: Column) -> Column:
    """All actions but the last, which is the response."""
    return F.slice(actions, F.lit(1), F.greatest(F.size(actions) - 1, F.lit(0)))


def tool_success(actions: Column) -> Column:
    """Share of the calls with an observation that didn't fail; 0 without any. ``actions``: array of name, content, observation."""
    seen = F.filter(calls_of(actions), lambda a: a["observation"].isNotNull())
    return F.coalesce(F.try_divide(F.size(F.filter(seen, lambda a: ~is_error(a["observation"]))), F.size(seen)), F.lit(0.0))


def overuse(actual: Column, expected: Column, most: int = 3) -> Column:
    """Calls beyond the expected ones, up to a limit; 0 where none are expected."""
    return F.when(expected > 0, F.least(F.greatest(actual - expected, F.lit(0)), F.lit(most))).otherwise(0)


def format_score(actions: Column) -> Column:
    """R2: a thought in a call weighs 1; in the last action a thought weighs 1 and an answer 2."""
    has = lambda a, tag: F.coalesce(F.size(text.tag_contents(a["content"], tag)) > 0, F.lit(False)).cast("int")
    last = F.try_element_at(actions, F.lit(-1))
    earned = F.aggregate(calls_of(actions), F.lit(0), lambda s, a: s + has(a, "think")) + has(last, "think") + 2 * has(last, "answer")
    return F.when(F.size(actions) > 0, earned / (F.size(actions) + 2)).otherwise(0.0)


def reward(actions: Column, correct: Column, expected: Column) -> Column:
    """Nothing done or no response at the end gives -1, a lone action -0.3; else correctness, format and tool success less overuse, of 1.2."""
    ends = F.try_element_at(actions, F.lit(-1))["name"] == "respond"
    score = (correct.cast("double") + 0.1 * format_score(actions) + 0.1 * tool_success(actions) - 0.1 * overuse(F.size(actions) - 1, expected)) / 1.2
    return F.when(F.coalesce(F.size(actions), F.lit(0)) <= 0, -1.0).when(F.size(actions) == 1, -0.3).when(~ends, -1.0).otherwise(score)


def earlier_reward(actions: Column, correct: Column, expected: Column, format_weight: float = 0.1) -> Column:
    """Structural failures give -1; else correctness and format less a tenth for each call too many or too few, half at most."""
    n = F.size(actions) - 1
    last = F.try_element_at(actions, F.lit(-1))
    off = F.when(expected > 0, F.greatest(F.lit(-0.5), -0.1 * F.abs(n - expected))).otherwise(0.0)
    score = (1 - format_weight) * correct.cast("double") + format_weight * format_score(actions) + off
    broken = (F.coalesce(F.size(actions), F.lit(0)) <= 1) | (last["name"] != "respond") | last["content"].isNull()
    return F.when(broken, -1.0).otherwise(score)


def reasoning_depth(actions: Column, least: int = 650, most: int = 3500) -> Column:
    """Mean over the actions' texts of 1 for a length between the limits, else 0.5; 0 without texts."""
    held = F.filter(actions, lambda a: a["content"].isNotNull())
    total = F.aggregate(held, F.lit(0.0), lambda s, a: s + F.when((F.length(a["content"]) > least) & (F.length(a["content"]) < most), 1.0).otherwise(0.5))
    return F.coalesce(F.try_divide(total, F.size(held)), F.lit(0.0))


def derived(reward_: Column, turns: Column, expected_turns: Column) -> Column:
    """Optimal and valid flags of a trajectory, and its deviation in turns."""
    return F.struct((F.abs(reward_ - 1) <= 1e-6).alias("optimal"), (reward_ > -0.3).alias("valid"), (turns - expected_turns).alias("turn_deviation"))


def choose(n: Column, k: Column) -> Column:
    """Number of ways to choose k of n, as a product, so that n may be large."""
    return F.when(k > n, F.lit(0.0)).when(k <= 0, F.lit(1.0)).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), F.lit(1.0), lambda s, i: s * (n - k + i) / i))


def pass_hat_k(trials: DataFrame, most: int) -> DataFrame:
    """For k = 1.. the mean over tasks of C(successes, k) / C(trials, k); tasks with fewer trials than k don't count."""
    per = trials.groupBy("task").agg(F.count("*").cast("int").alias("n"), F.count_if("success").cast("int").alias("c"))
    k = per.select("n", "c", F.explode(F.sequence(F.lit(1), F.lit(most))).alias("k")).filter("k <= n")
    return k.groupBy("k").agg(F.count("*").alias("n_tasks"), F.round(F.avg(choose(F.col("c"), F.col("k")) / choose(F.col("n"), F.col("k"))), 6).alias("pass_k"))


def metric_summary(runs: DataFrame) -> DataFrame:
    """Per metric of ``runs`` (run, metric, value): mean per run, then mean, min, max and population deviation over runs."""
    per = runs.groupBy("run", "metric").agg(F.avg("value").alias("v"))
    return per.groupBy("metric").agg(
        F.count("*").alias("n_runs"), F.round(F.avg("v"), 9).alias("mean"), F.round(F.min("v"), 9).alias("least"), F.round(F.max("v"), 9).alias("most"), F.round(F.stddev_pop("v"), 9).alias("deviation")
    )


def exclusive_p95(df: DataFrame, column: str) -> DataFrame:
    """The exclusive 95th percentile of a column, or its maximum below 20 rows.

    Equal values are counted first, so a hot value is one row; the counted values are range-partitioned,
    and a sum per partition tells in which one the wanted ranks lie.
    """
    from sparkloom.session import cut_lineage, partitions_for

    spark = df.sparkSession
    counted = df.select(F.col(column).cast("double").alias("v")).filter("v is not null").groupBy("v").agg(F.count("*").alias("n"))
    ordered = cut_lineage(counted.repartitionByRange(partitions_for(spark), "v").withColumn("part", F.spark_partition_id()))
    upto = Window.partitionBy(F.lit(1)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over the few partitions
    parts = ordered.groupBy("part").agg(F.sum("n").alias("m")).withColumn("before", F.coalesce(F.sum("m").over(upto), F.lit(0))).withColumn("all", F.sum("m").over(Window.partitionBy(F.lit(1))))
    at = 0.95 * (F.col("all") + 1)
    low = F.when(F.col("all") < 20, F.col("all")).otherwise(F.least(F.floor(at), F.col("all")))
    high = F.least(low + 1, F.col("all"))
    hit = parts.filter((F.col("before") < high) & (F.col("before") + F.col("m") >= low)).select("part", "before", low.alias("low"), high.alias("high"), at.alias("at"), F.col("all").alias("total"))
    within = Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    placed = ordered.join(F.broadcast(hit), "part").withColumn("last", F.col("before") + F.sum("n").over(within)).withColumn("first", F.col("last") - F.col("n") + 1)
    of = lambda rank: F.max(F.when((F.col("first") <= F.col(rank)) & (F.col("last") >= F.col(rank)), F.col("v")))
    two = placed.agg(of("low").alias("a"), of("high").alias("b"), F.max("at").alias("at"), F.max("low").alias("low"), F.max("total").alias("total"))
    value = F.when(F.col("total") < 20, F.col("a")).otherwise(F.col("a") + (F.col("at") - F.col("low")) * (F.col("b") - F.col("a")))
    return two.select(F.coalesce("total", F.lit(0)).alias("n"), F.round(value, 6).alias("p95"))


def group_diversity(trials: DataFrame) -> DataFrame:
    """Per group: number, mean and population deviation of rewards, distinct share of first tools."""
    return trials.groupBy("group").agg(
        F.count("*").alias("n"), F.round(F.avg("reward"), 9).alias("mean_reward"), F.round(F.stddev_pop("reward"), 9).alias("deviation"),
        F.round(F.try_divide(F.count_distinct("first_tool"), F.count("first_tool")), 6).alias("distinct_share"),
    )


def top_values(df: DataFrame, column: str, order: str, most: int) -> DataFrame:
    """The most frequent values, ties by first appearance."""
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"), F.min(order).alias("first_seen")).orderBy(F.desc("n"), "first_seen").limit(most)


def format_ratios(messages: DataFrame) -> DataFrame:
    """Of assistant contents: share of strict formats, of answers and of calls; 0 where there are none."""
    c = F.col("content")
    ok = text.thinks_then_answers(c)
    answered = F.size(text.tag_contents(c, "answer")) > 0
    ratio = lambda a, b: F.round(F.coalesce(F.try_divide(F.count_if(a), F.count_if(b)), F.lit(0.0)), 6)
    return messages.filter("role = 'assistant'").agg(F.count("*").alias("n_messages"), ratio(ok, F.lit(True)).alias("format_share"), ratio(ok & answered, answered).alias("answer_format_share"), F.count_if(answered).alias("n_answers"))


def without_mean_suffix(summary: DataFrame, column: str = "metric", count: str = "n") -> DataFrame:
    """Metric names without their _mean ending, the count left out."""
    return summary.drop(count).withColumn(column, F.regexp_replace(column, "_mean$", ""))


def optimised(runs: DataFrame, jitter: float) -> DataFrame:
    """V8: whether any component's chosen entropy lies below its upper bound by more than the jitter. ``runs``: run, chosen, upper (arrays)."""
    below = F.exists(F.zip_with("chosen", "upper", lambda c, u: c < u - jitter), lambda x: F.coalesce(x, F.lit(False)))
    return runs.withColumn("optimised", F.coalesce(below, F.lit(False)))


def best_per_problem(ranked: DataFrame) -> DataFrame:
    """K8: the best run of each problem by score, ties by run; partial aggregation, no window."""
    return ranked.groupBy("problem_type").agg(F.min(F.struct("score", "run")).alias("best")).select("problem_type", "best.run", "best.score")
