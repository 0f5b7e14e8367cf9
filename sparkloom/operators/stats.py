"""Statistics of the values that steps produce, and rankings against targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Targets are joined by broadcast up to this many rows, else by shuffle.
TARGET_ROWS = 100_000
NUMBER = r"-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?"


def numbers_in(text: Column) -> Column:
    """A2: every number of a nested value's JSON text, in order."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({NUMBER})"), F.lit(1)), lambda x: x.cast("double"))


def step_values(questions: DataFrame) -> DataFrame:
    """A3: a row for each number of each step: question_id, problem_type, step, value."""
    steps = questions.select("question_id", "problem_type", F.posexplode("stepwise").alias("step", "s"))
    return steps.select("question_id", "problem_type", "step", F.explode(numbers_in(F.col("s.result"))).alias("value"))


def value_statistics(questions: DataFrame) -> DataFrame:
    """A1: min, max, least absolute value and count overall, per step and per problem type, in one pass."""
    v = step_values(questions).select("problem_type", "step", "value")
    sets = v.groupingSets([[], ["step"], ["problem_type"]], "step", "problem_type")
    return sets.agg(
        F.grouping_id().cast("bigint").alias("grouping"), F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.min(F.abs("value")).alias("min_abs"), F.count("*").alias("n")
    )


def question_statistics(questions: DataFrame) -> DataFrame:
    """A1, per question: computed within the row, without a shuffle; questions without numbers give count 0."""
    v = F.flatten(F.transform(F.coalesce("stepwise", F.array()), lambda s: numbers_in(s["result"])))
    q = questions.select("question_id", v.alias("v"))
    least = F.aggregate("v", F.lit(None).cast("double"), lambda a, x: F.least(F.coalesce(a, F.abs(x)), F.abs(x)))
    return q.select("question_id", F.array_min("v").alias("min_value"), F.array_max("v").alias("max_value"), F.coalesce(least, F.lit(0.0)).alias("min_abs"), F.size("v").cast("bigint").alias("n"))


def summary(questions: DataFrame) -> DataFrame:
    """A4: overall and per difficulty: rows, distinct types, entropy and tool calls."""
    return questions.groupingSets([[], ["difficulty"]], "difficulty").agg(
        F.grouping_id().cast("bigint").alias("grouping"), F.count("*").alias("n_rows"), F.count_distinct("problem_type").alias("n_types"), F.count_distinct("topic").alias("n_topics"),
        F.min("entropy_used").alias("min_entropy"), F.max("entropy_used").alias("max_entropy"), F.round(F.avg("entropy_used"), 6).alias("avg_entropy"),
        F.min("tool_calls_required").alias("min_calls"), F.max("tool_calls_required").alias("max_calls"), F.round(F.avg("tool_calls_required"), 6).alias("avg_calls"),
    )


def shares(df: DataFrame, column: str) -> DataFrame:
    """A5: rows and percentage per value; the total is a sum over the few groups."""
    from pyspark.sql import Window

    n = df.groupBy(column).agg(F.count("*").alias("n_rows"))
    return n.withColumn("percent", F.round(F.col("n_rows") * 100 / F.sum("n_rows").over(Window.partitionBy(F.lit(1))), 6))


def within_targets(questions: DataFrame, targets: DataFrame) -> DataFrame:
    """Per problem type of ``targets`` (problem_type, target_min, target_max): range, and how many values comply."""
    few = targets.limit(TARGET_ROWS + 1).count() <= TARGET_ROWS
    v = step_values(questions).join(F.broadcast(targets) if few else targets, "problem_type")
    return v.groupBy("problem_type", "target_min", "target_max").agg(
        F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.count("*").alias("n"), F.count_if(F.col("value").between(F.col("target_min"), F.col("target_max"))).alias("n_within")
    ).withColumn("ok", F.col("n") == F.col("n_within"))


def ranked(runs: DataFrame, target_min: float, target_max: float, most: int) -> DataFrame:
    """Runs whose whole range lies within the targets, by distance to them; ties by run."""
    ok = runs.filter(F.col("min_value").between(target_min, target_max) & F.col("max_value").between(target_min, target_max))
    return ok.withColumn("score", F.round(F.abs(F.col("min_value") - target_min) + F.abs(F.col("max_value") - target_max), 6)).orderBy("score", "run").limit(most)


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts of equal bins over a range."""
    place = F.floor((F.col(column) - low) * bins / (high - low)) + 1
    return df.filter(F.col(column).between(low, high)).groupBy(F.least(place, F.lit(bins)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
