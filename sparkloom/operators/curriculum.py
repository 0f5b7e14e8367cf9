"""Curricula over tasks in buckets of difficulty, as pure functions of the step: resuming needs no replay."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.prepare import mixed, with_rank


def difficulty_at(step: Column, total: int) -> Column:
    """0 at the first step, 1 at the last."""
    return F.lit(1.0) if total <= 1 else F.least(F.greatest(step / (total - 1), F.lit(0.0)), F.lit(1.0))


def mixture(buckets: DataFrame, difficulty: float, initial: int, final: int, sigma: float, floor: float = 0.0) -> DataFrame:
    """Weight of each bucket (column ``bucket``): a bell around the target, with a floor for the easiest.

    Without a width, all weight lies on the nearest bucket, the lower of two.
    """
    all_ = Window.partitionBy(F.lit(1))  # buckets are few
    used = buckets.select("bucket").distinct().filter(F.col("bucket") <= final)
    easiest = F.min("bucket").over(all_)
    start = F.greatest(easiest, F.lit(initial)).cast("double")
    target = start + max(0.0, min(1.0, difficulty)) * (F.greatest(start, F.lit(float(final))) - start)
    d = used.withColumn("is_easiest", F.col("bucket") == easiest).withColumn("distance", F.abs(F.col("bucket") - target))
    if sigma <= 0 or sigma * sigma == 0:
        nearest = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("distance", "bucket"))
        d = d.withColumn("p", (nearest == 1).cast("double"))
    else:
        best = F.min("distance").over(all_)
        d = d.withColumn("w", F.exp(-(F.col("distance") ** 2 - best**2) / (2 * sigma * sigma))).withColumn("p", F.col("w") / F.sum("w").over(all_))
    p_easy = F.sum(F.when(F.col("is_easiest"), F.col("p")).otherwise(0.0)).over(all_)
    lifted = F.when(F.col("is_easiest"), F.lit(floor)).otherwise(F.col("p") * (1 - floor) / (1 - p_easy))
    return d.withColumn("weight", F.when((p_easy >= floor) | (p_easy >= 1), F.col("p")).otherwise(lifted)).select("bucket", "weight")


def allotted(weights: DataFrame, total: int) -> DataFrame:
    """Whole counts by largest remainders, ties to the lower bucket; equal weights where all are 0."""
    all_ = Window.partitionBy(F.lit(1))
    w = weights.withColumn("w", F.greatest(F.col("weight"), F.lit(0.0)))
    mass = F.sum("w").over(all_)
    expected = F.when(mass > 0, F.col("w") / mass * total).otherwise(total / F.count("*").over(all_))
    d = w.withColumn("expected", expected).withColumn("base", F.floor("expected"))
    rank = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc(F.round(F.col("expected") - F.col("base"), 9)), "bucket"))
    return d.withColumn("n", F.col("base") + (rank <= total - F.sum("base").over(all_)).cast("bigint")).select("bucket", "n")


def unlocked(tasks: DataFrame, difficulty: float, initial: int, final: int, start: float, end: float, min_total: int, seed: int = 0) -> DataFrame:
    """Tasks (task_id, bucket) open at a difficulty: a growing share of each unlocked bucket, and the first of all.

    The set grows with the difficulty, as every bucket's order is fixed by the seed.
    """
    levels = max(1, max(final, initial) - initial + 1)
    allowed = initial + min(levels - 1, math.floor(difficulty * levels))
    share = max(0.0, min(1.0, start + difficulty * (end - start)))
    least = tasks.agg(F.min("bucket").alias("least")).first()["least"]
    open_ = tasks.filter(F.col("bucket") <= max(allowed, least if least is not None else allowed))
    ranked = with_rank(open_.select("task_id", "bucket", mixed(F.col("task_id"), seed).alias("key")), ["bucket"], "key", "task_id")
    earlier = Window.partitionBy(F.lit(1)).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # over the few buckets
    sizes = open_.groupBy("bucket").agg(F.count("*").alias("n")).select("bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    d = ranked.join(sizes, "bucket").withColumn("position", F.col("before") + F.col("rank"))
    return d.filter((F.col("rank") <= F.ceil(F.lit(share) * F.col("size"))) | (F.col("position") <= max(min_total, 1))).select("task_id", "bucket", "position")


def bag_draws(pool: DataFrame, draws: int, seed: int = 0) -> DataFrame:
    """The sequence of a shuffle bag over a fixed pool (column ``task_id``): no repeat before the pool is used up.

    Closed form: cycle c of draw i is i div n, ordered by a hash of seed, cycle and task.
    """
    size = pool.count()
    if not size or draws <= 0:
        return pool.sparkSession.createDataFrame([], "draw bigint, cycle int, task_id bigint")
    cycles = pool.select("task_id", F.explode(F.sequence(F.lit(0), F.lit(-(-draws // size) - 1))).alias("cycle"))
    ranked = with_rank(cycles.withColumn("key", mixed(F.col("task_id") * 1_000_003 + F.col("cycle"), seed)), ["cycle"], "key", "task_id")
    return ranked.withColumn("draw", F.col("cycle") * F.lit(size) + F.col("rank") - 1).filter(F.col("draw") < draws).select("draw", "cycle", "task_id")


def coverage(draws: DataFrame, most: int = 3) -> DataFrame:
    """Per step and bucket: tasks drawn, and tasks seen so far for the first time. ``draws``: step, task_id, bucket."""
    bucket = F.least(F.col("bucket"), F.lit(most + 1)).alias("bucket")
    first = draws.groupBy("task_id", bucket).agg(F.min("step").alias("step")).groupBy("step", "bucket").agg(F.count("*").alias("n_new"))
    drawn = draws.groupBy("step", bucket).agg(F.count("*").alias("n_drawn"))
    w = Window.partitionBy("bucket").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return drawn.join(first, ["step", "bucket"], "left").select("step", "bucket", "n_drawn", F.sum(F.coalesce("n_new", F.lit(0))).over(w).alias("n_seen"))


def sample_to_length(df: DataFrame, key: str, length: int, seed: int = 0) -> DataFrame:
    """``length`` rows: without replacement if there are enough, else with it. Columns draw and the key."""
    n = df.count()
    if length <= 0 or n == 0:
        return df.select(F.lit(0).cast("bigint").alias("draw"), key).limit(0)
    ranked = with_rank(df.select(key, F.lit(0).alias("__all"), mixed(F.col(key), seed).alias("__hash")), ["__all"], "__hash", key)
    if n >= length:
        return ranked.filter(F.col("rank") <= length).select((F.col("rank") - 1).alias("draw"), key)
    draws = df.sparkSession.range(length).select(F.col("id").alias("draw"), (F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(n)) + 1).alias("rank"))
    return draws.join(ranked.select("rank", key), "rank").select("draw", key)


def bag_cycles(pools: list[int], draws: list[int]) -> list[tuple[int, int, int, list[int]]]:
    """Cycles of a shuffle bag whose pool grows: number, first draw, draws, and the sizes the pool had in it, of steps with a pool size and a number of draws.

    A cycle lasts until everything that is in the pool by then was drawn once.
    """
    out, at, used, sizes = [], 0, 0, []
    size = 0
    for pool, n in zip(pools, draws):
        size = max(size, pool)  # a growing pool; shrinking ones are drawn from by eligibility before
        if size and (not sizes or sizes[-1] != size):
            sizes.append(size)
        while n > 0 and size:
            take = min(n, size - used)
            used, n = used + take, n - take
            if used == size and n > 0:
                out.append((len(out), at, used, sizes))
                at, used, sizes = at + used, 0, [size]
    if used:
        out.append((len(out), at, used, sizes))
    return out


def growing_bag(tasks: DataFrame, pools: list[int], draws: list[int], seed: int = 0) -> DataFrame:
    """Draws from a bag over the first pool[i] tasks by ``rank`` at step i: step, draw, task_id.

    In each cycle the tasks that are in the pool from its start are shuffled by a hash; those that join
    later follow, in the order they joined, shuffled likewise: so they come before any repeat, and
    every place of the order is in the pool when it is drawn. A closed form: no task waits for another.
    """
    spark = tasks.sparkSession
    cycles = bag_cycles(pools, draws)
    if not cycles:
        return spark.createDataFrame([], "step int, draw bigint, task_id bigint")
    c = spark.createDataFrame(cycles, "cycle int, start bigint, n bigint, sizes array<bigint>")
    level = F.size(F.filter("sizes", lambda k: k < F.col("rank")))
    held = tasks.select("task_id", "rank", F.explode(F.sequence(F.lit(0), F.lit(len(cycles) - 1))).alias("cycle")).join(F.broadcast(c), "cycle")
    held = held.filter(F.col("rank") <= F.element_at("sizes", -1)).withColumn("level", level).withColumn("base", F.when(F.col("level") > 0, F.element_at("sizes", F.col("level"))).otherwise(F.lit(0)))
    held = held.select("task_id", "cycle", "level", "base", "start", "n", mixed(F.col("task_id") * 1_000_003 + F.col("cycle"), seed).alias("key"))
    placed = with_rank(held, ["cycle", "level"], "key", "task_id").withColumn("place", F.col("base") + F.col("rank") - 1).filter(F.col("place") < F.col("n"))
    steps, at = [], 0
    for i, n in enumerate(draws):
        if n > 0:
            steps.append((i, at, at + n - 1))
            at += n
    of = spark.createDataFrame(steps, "step int, first bigint, last bigint").select("step", F.explode(F.sequence("first", "last")).alias("draw"))
    return placed.select((F.col("start") + F.col("place")).alias("draw"), "task_id").join(of, "draw").select("step", "draw", "task_id")


def mixture_weights(keys: list[int], difficulty: float, initial: int, final: int, sigma: float, floor: float) -> list[float]:
    """mixture() for the few buckets of a plan, without a job."""
    start = max(float(min(keys)), float(initial))
    target = start + max(0.0, min(1.0, difficulty)) * (max(start, float(final)) - start)
    near = [abs(k - target) for k in keys]
    if sigma <= 0:
        best = min(range(len(keys)), key=lambda i: (near[i], keys[i]))
        p = [float(i == best) for i in range(len(keys))]
    else:
        w = [math.exp(-(d * d - min(near) ** 2) / (2 * sigma * sigma)) for d in near]
        p = [x / sum(w) for x in w]
    easy = min(range(len(keys)), key=lambda i: keys[i])
    if p[easy] < floor and p[easy] < 1:
        p = [floor if i == easy else x * (1 - floor) / (1 - p[easy]) for i, x in enumerate(p)]
    return p


def whole_counts(weights: list[float], total: int) -> list[int]:
    """allotted() for a list: largest remainders, ties to the earlier."""
    mass = sum(max(0.0, w) for w in weights)
    expected = [max(0.0, w) / mass * total if mass > 0 else total / len(weights) for w in weights]
    base = [math.floor(x) for x in expected]
    order = sorted(range(len(base)), key=lambda i: (-round(expected[i] - base[i], 9), i))
    for i in order[: total - sum(base)]:
        base[i] += 1
    return base


def curriculum_draws(tasks: DataFrame, steps: int, batch: int, initial: int, final: int, sigma: float, floor: float, start: float, end: float, seed: int = 0) -> DataFrame:
    """The batches of all training steps: step, place, bucket, task_id.

    Per step the mixture of buckets for its difficulty gives whole counts; each bucket draws them from
    a bag over a growing share of its tasks; the batch is shuffled. A pure function of the seed and
    the step, so a resumed run takes the steps it needs. The driver plans steps and buckets only.
    """
    ranked = with_rank(tasks.select("task_id", "bucket", mixed(F.col("task_id"), seed).alias("key")), ["bucket"], "key", "task_id").select("task_id", "bucket", "rank", "size")
    sizes = {r["bucket"]: r["size"] for r in ranked.filter(F.col("bucket") <= final).groupBy("bucket").agg(F.max("size").alias("size")).collect()}
    keys = sorted(sizes)
    if not keys or steps <= 0:
        return tasks.sparkSession.createDataFrame([], "step int, place int, bucket int, task_id bigint")
    counts, shares = [], []
    for i in range(steps):
        d = 1.0 if steps <= 1 else i / (steps - 1)
        counts.append(whole_counts(mixture_weights(keys, d, initial, final, sigma, floor), batch))
        shares.append(max(0.0, min(1.0, start + d * (end - start))))
    out = None
    for k, bucket in enumerate(keys):
        pools = [max(1, math.ceil(round(f * sizes[bucket], 9))) for f in shares]
        drawn = growing_bag(ranked.filter(F.col("bucket") == bucket), pools, [c[k] for c in counts], seed + bucket).withColumn("bucket", F.lit(bucket))
        out = drawn if out is None else out.unionByName(drawn)
    place = F.row_number().over(Window.partitionBy("step").orderBy(F.xxhash64(F.lit(seed), "step", "bucket", "draw"), "bucket", "draw"))  # a batch is small
    return out.withColumn("place", place).select("step", "place", "bucket", "task_id")
