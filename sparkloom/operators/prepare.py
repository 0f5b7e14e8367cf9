"""Preparation of datasets: flat examples, splits, samples, and schema alignment."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(seed: int, *keys: str) -> Column:
    """A seeded order that depends on keys alone."""
    return F.xxhash64(F.lit(seed), *keys)


def mixed(key: Column, seed: int = 0) -> Column:
    """An arithmetic hash of a whole number to 32 bits, the same in any engine."""
    return F.pmod(F.pmod(key, F.lit(1 << 31)) * F.lit(2654435761) + F.lit(seed), F.lit(1 << 32))


def example(questions: DataFrame) -> DataFrame:
    """The flat dataset row of a question: truths [{tool: result}], composition and dependency edges (null if none)."""
    steps = F.filter("stepwise", lambda s: s.isNotNull())
    truth = lambda s: F.concat(F.lit('{"'), s["tool"], F.lit('": '), s["result"], F.lit("}"))
    usable = F.filter(steps, lambda s: s["tool"].isNotNull() & F.try_parse_json(s["result"]).isNotNull())
    edge = lambda s, i: F.transform(F.map_values(s["verification"]["dependent_on"]), lambda d: F.struct(d.alias("src"), i.alias("dst")))
    edges = F.flatten(F.filter(F.transform("stepwise", edge), lambda e: e.isNotNull()))
    return questions.select(
        "question_id", F.col("question").alias("query"), F.get(usable, F.size(usable) - 1)["result"].alias("ground_truth"),
        F.concat(F.lit("["), F.array_join(F.transform(usable, truth), ", "), F.lit("]")).alias("stepwise_ground_truths"),
        "difficulty", "problem_type", F.when(F.size(steps) > 1, "sequential").when(F.size(steps) == 1, "single").alias("composition_type"),
        F.when(F.size(edges) > 0, F.concat(F.lit("["), F.array_join(F.transform(edges, lambda e: F.concat(F.lit("["), e["src"].cast("string"), F.lit(", "), e["dst"].cast("string"), F.lit("]"))), ", "), F.lit("]"))).alias("dependency_edges"),
    )


def representative(df: DataFrame, category: str, per_category: int, order: str, with_rest: bool = False) -> DataFrame:
    """The first rows of each category in order; ``with_rest``: then the others, marked. ``order`` is unique.

    A window that keeps the first rows lets each task drop the others before the shuffle; with the
    rest, those few firsts are marked, so that no category is sorted in one task.
    """
    rank = F.row_number().over(Window.partitionBy(category).orderBy(order))
    if not with_rest:
        return df.withColumn("__rank", rank).filter(F.col("__rank") <= per_category).drop("__rank")
    first = df.select(F.col(category), F.col(order).alias("__order")).withColumn("__rank", F.row_number().over(Window.partitionBy(category).orderBy("__order"))).filter(F.col("__rank") <= per_category)
    return df.join(first.select("__order", F.lit(False).alias("is_rest")), F.col(order) == F.col("__order"), "left").withColumn("is_rest", F.coalesce("is_rest", F.lit(True))).drop("__order")


def with_rank(df: DataFrame, groups: list[str], key: str, tie: str, bits: int = 14) -> DataFrame:
    """Adds ``rank`` (from 1, by a 32-bit ``key``, ties by ``tie``) and ``size`` of each row's group.

    Ranks come from a count of key prefixes, so a large group is never sorted in one task: a task
    ranks the rows of one prefix, and only counts of prefixes are summed along a group.
    """
    keyed = df.withColumn("__prefix", F.shiftright(key, 32 - bits))
    upto = Window.partitionBy(*groups).orderBy("__prefix").rowsBetween(Window.unboundedPreceding, 0)
    named = [F.col(g).alias(f"__{g}") for g in groups]
    counts = (
        keyed.groupBy(*groups, "__prefix").agg(F.count("*").alias("__n"))
        .select(*named, F.col("__prefix").alias("__p"), (F.sum("__n").over(upto) - F.col("__n")).alias("__before"), F.sum("__n").over(Window.partitionBy(*groups)).alias("size"))
    )
    same = F.col("__prefix") == F.col("__p")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"__{g}"))
    place = F.row_number().over(Window.partitionBy(*groups, "__prefix").orderBy(key, tie))
    return keyed.join(counts, same).withColumn("rank", place + F.col("__before")).drop("__prefix", "__p", "__before", *[f"__{g}" for g in groups])


def stratified_split(df: DataFrame, stratum: str, key: str, test: float, validation: float, seed: int = 0) -> DataFrame:
    """Split column with exact shares per stratum, by an arithmetic hash of the key; validation is a share of the whole."""
    ranked = with_rank(df.withColumn("__hash", mixed(F.col(key), seed)), [stratum], "__hash", key)
    r = F.col("rank")
    split = F.when(r <= F.floor(F.col("size") * test), "test").when(r <= F.floor(F.col("size") * (test + validation)), "validation").otherwise("train")
    return ranked.withColumn("split", split).drop("__hash", "rank", "size")


def head_per_split(df: DataFrame, n: int, order: str, split: str = "split") -> DataFrame:
    """the first n rows of each split."""
    return df.withColumn("__rank", F.row_number().over(Window.partitionBy(split).orderBy(order))).filter(F.col("__rank") <= n).drop("__rank")


def index_range(df: DataFrame, index: str, start: int, end: int, ids: list[int] | None = None) -> DataFrame:
    """rows by index range, -1 for no end; explicit ids win."""
    if ids:
        return df.filter(F.col(index).isin(ids))
    return df.filter(F.col(index) >= max(0, start)) if end == -1 else df.filter((F.col(index) >= max(0, start)) & (F.col(index) < end))


def aligned_union(frames: list[DataFrame]) -> DataFrame:
    """Union by name, nulls for missing columns."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    """U4, V5: required columns that a dataset lacks."""
    return [c for c in required if c not in df.columns]


def without_prefix(m: Column, prefix: str) -> Column:
    """A map without the keys of a prefix."""
    return F.map_filter(m, lambda k, v: ~k.startswith(prefix))


def indexed_list(items: Column) -> Column:
    """Non-blank items with their original places, as lines."""
    marked = F.transform(items, lambda x, i: F.when(F.trim(F.coalesce(x, F.lit(""))) != "", F.concat(i.cast("string"), F.lit(": "), x)))
    return F.array_join(marked, "\n")


def initial_messages(query: Column, system: str | None) -> Column:
    """The opening messages of a conversation."""
    m = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(m("user", query)) if system is None else F.array(m("system", F.lit(system)), m("user", query))


def rendered(messages: Column) -> Column:
    """A rollout as text, a line for each message and each of its calls."""
    calls = lambda m: F.transform(F.coalesce(m["tool_calls"], F.expr("array()").cast("array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>")), lambda t: F.concat(F.lit("TOOL CALL: "), t["function"]["name"], F.lit(": "), t["function"]["arguments"]))  # noqa: E731,E501
    lines = F.transform(F.filter(messages, lambda m: m.isNotNull()), lambda m: F.concat_ws("\n", F.concat(F.upper(m["role"]), F.lit(": "), F.coalesce(m["content"], F.lit(""))), F.array_join(calls(m), "\n")))
    return F.array_join(lines, "\n")


def user_query(query: Column, messages: Column) -> Column:
    """The query, else the last non-blank user message."""
    users = F.filter(messages, lambda m: (m["role"] == "user") & (F.trim(F.coalesce(m["content"], F.lit(""))) != ""))
    return F.coalesce(F.when(F.trim(query) != "", query), F.try_element_at(users, F.lit(-1))["content"])


def tool_sequence(messages: Column) -> Column:
    """Names of all tool calls in order."""
    return F.flatten(F.transform(F.filter(messages, lambda m: m["tool_calls"].isNotNull()), lambda m: F.transform(m["tool_calls"], lambda t: t["function"]["name"])))


def first_action(m: Column) -> Column:
    """Name and content of a message's action: its first call, else respond."""
    call = F.get(m["tool_calls"], F.lit(0))["function"]
    return F.struct(F.coalesce(call["name"], F.lit("respond")).alias("name"), F.coalesce(call["arguments"], m["content"]).alias("content"))


def with_constant(df: DataFrame, column: str, value: str) -> DataFrame:
    """A column that is missing or null gets a constant."""
    return df.withColumn(column, F.coalesce(F.col(column), F.lit(value)) if column in df.columns else F.lit(value))


def to_schema(df: DataFrame, schema: str) -> DataFrame:
    """The columns of a schema by name, cast; missing ones are null, others are dropped."""
    from pyspark.sql.types import _parse_datatype_string

    fields = _parse_datatype_string(schema).fields
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])


def as_text_map(values: dict[str, Column]) -> Column:
    """Metadata as a map of texts; null values are left out."""
    made = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast("string"))])
    return F.map_filter(made, lambda k, v: v.isNotNull())


def call_row(df: DataFrame, inputs: list[str], outputs: dict[str, Column], metadata: dict[str, Column]) -> DataFrame:
    """The row of a model call: its inputs, its outputs and a map of metadata."""
    return df.select(*inputs, *[c.alias(n) for n, c in outputs.items()], as_text_map(metadata).alias("metadata"))


def split_name(c: Column) -> Column:
    """Train, test or validation of any spelling; null for unknown names."""
    name = F.lower(F.trim(c))
    return F.when(name.isin("val", "validation"), "validation").when(name.isin("train", "test"), name)


def difficulty_of_type(c: Column) -> Column:
    """Difficulty by the prefix of a problem type's name; null for other names."""
    name = F.upper(c)
    return F.when(name.startswith("ONE_"), "ONE_TOOL_CALL").when(name.startswith("TWO_"), "TWO_TOOL_CALLS").when(name.startswith("THREE_"), "THREE_TOOL_CALLS")


def conversation_report(c: DataFrame, index: str, start: int = 0, end: int = -1, ids: list[int] | None = None) -> DataFrame:
    """The chosen conversations as text."""
    return index_range(c, index, start, end, ids).select(index, rendered(F.filter("messages", lambda m: m.isNotNull())).alias("report"))


def chat_text(messages: Column) -> Column:
    """Messages in a plain chat template, with the mark of the next turn at the end."""
    one = lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), F.coalesce(m["content"], F.lit("")), F.lit("<|im_end|>\n"))
    return F.concat(F.array_join(F.transform(F.filter(messages, lambda m: m.isNotNull() & m["role"].isNotNull()), one), ""), F.lit("<|im_start|>assistant\n"))


def subset_size(total: int, wanted: int | None) -> int:
    """All for none or a negative number, else at most what is there."""
    return total if wanted is None or wanted < 0 else min(total, wanted)


def same_variables(a: Column, b: Column) -> Column:
    """whether two lists name exactly the same variables."""
    return F.coalesce(F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b)), F.lit(False))


def zipped(**columns: Column) -> Column:
    """Lists by position as one list of structs; null where their lengths differ, as nothing may be lost."""
    names, held = list(columns), list(columns.values())
    even = F.lit(True)
    for c in held[1:]:
        even = even & (F.size(held[0]) == F.size(c))
    return F.when(even, F.transform(held[0], lambda _, i: F.struct(*[F.get(c, i).alias(n) for n, c in zip(names, held)]))) if held else F.array()


def per_conversation(turns: DataFrame, key: str, turn: str, value: str) -> DataFrame:
    """Per-turn statistics put together per conversation, in order of the turns, which are few."""
    return turns.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(turn, value))).alias("__s")).select(key, F.transform("__s", lambda x: x[value]).alias("stats"))


def system_prompt(tools: list[dict]) -> str:
    """The system prompt with the tags and the tools' schemas."""
    import json

    lines = "\n".join(json.dumps(t) for t in tools)
    return f"Think first, between <think> and </think>. Then call one tool, between <tool_call> and </tool_call>, or give the result, between <answer> and </answer>.\nTools:\n{lines}"
