"""Checks and cleaning of tool-use conversations.

Conversations are judged inside the row, by array functions over their messages, wherever a check
needs no other row; only reports group over rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import answers, text
from sparkloom.operators.prepare import tool_sequence


def messages(conversations: DataFrame) -> DataFrame:
    """A row for each message that isn't null: idx, pos, role, content, tool_calls, name."""
    return conversations.select("idx", F.posexplode("messages").alias("pos", "m")).filter("m is not null").select("idx", "pos", "m.role", "m.content", "m.tool_calls", "m.name", "m.tool_call_id")


def truths(c: Column) -> Column:
    """Steps of a truths text as entries (key, value as JSON text); null if it can't be read."""
    return F.flatten(F.transform(F.from_json(c, "array<map<string,string>>"), lambda s: F.map_entries(s)))


def last_answer(m: Column) -> Column:
    """M8: the answer tag's content of the last assistant message, else its content."""
    last = F.try_element_at(F.filter(m, lambda x: x["role"] == "assistant"), F.lit(-1))["content"]
    return F.coalesce(text.last_content(last, "answer"), last)


def answer_differs(minimal: bool = True) -> Column:
    """V9: whether the last answer differs from the tool response before it; without ``minimal`` a determinant answered by 1, 2 or 3 is exempt."""
    last, before = F.try_element_at("messages", F.lit(-1)), F.try_element_at("messages", F.lit(-2))
    answer = text.last_content(last["content"], "answer")
    issue = (before["role"] == "tool") & answer.isNotNull() & ~answers.equal(answer, before["content"])
    if not minimal:
        issue = issue & ~F.coalesce((before["name"] == "determinant") & answer.isin("1", "2", "3"), F.lit(False))
    return F.coalesce(issue, F.lit(False))


def final_answer_issue(c: DataFrame, minimal: bool = True) -> DataFrame:
    """V9: conversations whose answer differs from the tool response before it."""
    return c.filter(answer_differs(minimal)).select("idx")


def calls(c: DataFrame) -> DataFrame:
    """A row for each tool call: idx, pos of the message, tool, arguments."""
    return messages(c).select("idx", "pos", F.explode("tool_calls").alias("t")).select("idx", "pos", F.col("t.function.name").alias("tool"), F.col("t.function.arguments").alias("arguments"))


def tool_usage(c: DataFrame) -> DataFrame:
    """Calls per conversation and tool, with the places of the messages."""
    return calls(c).groupBy("idx", "tool").agg(F.count("*").alias("n_calls"), F.array_join(F.array_sort(F.collect_list("pos")), ",").alias("places"))


def repeated_calls(c: DataFrame) -> DataFrame:
    """Tools called more than once in a conversation, counted within the row."""
    names = tool_sequence(F.col("messages"))
    return c.select("idx", F.explode(F.array_distinct(names)).alias("tool"), names.alias("names")).withColumn("n_calls", F.size(F.filter("names", lambda x: x == F.col("tool")))).filter("n_calls > 1").select("idx", "tool", F.col("n_calls").cast("bigint").alias("n_calls"))


def step_error(tool: Column, value: Column, step: Column) -> Column:
    """The first error of a step against the message pair where it should be, two by two from the third message on."""
    at, after = F.get("messages", F.lit(2) + step * 2), F.get("messages", F.lit(3) + step * 2)
    call = F.get(at["tool_calls"], F.lit(0))["function"]
    return (
        F.when(at.isNull(), "missing tool call")
        .when(F.coalesce(F.size(at["tool_calls"]), F.lit(0)) <= 0, "no tool_calls")
        .when(~F.coalesce(call["name"] == tool, F.lit(False)), "tool name mismatch")
        .when(after.isNull() | (F.coalesce(after["role"], F.lit("")) != "tool"), "missing tool response")
        .when(~answers.equal(after["content"], value), "value mismatch")
    )


def sequence_issues(c: DataFrame) -> DataFrame:
    """Idx, step, error of each step that isn't where and what it should be."""
    steps = c.select("idx", "messages", F.posexplode(truths(F.col("stepwise_ground_truths"))).alias("step", "t"))
    return steps.select("idx", "step", step_error(F.col("t.key"), F.col("t.value"), F.col("step")).alias("error")).filter("error is not null")


def has_due_count() -> Column:
    """Whether a conversation has twice its steps and three messages."""
    n = F.size(truths(F.col("stepwise_ground_truths")))
    return F.coalesce((F.size("messages") == 2 * n + 3) & (n >= 0), F.lit(False))


def count_ok(c: DataFrame) -> DataFrame:
    """V12, per conversation."""
    return c.select("idx", has_due_count().alias("count_ok"))


def repeated_thoughts(c: DataFrame) -> DataFrame:
    """Pairs of messages of a conversation with equal first thoughts, within the row; adjacent ones are two apart."""
    thoughts = F.filter(F.transform("messages", lambda m, i: F.struct(i.alias("pos"), F.get(text.tag_contents(m["content"], "think"), F.lit(0)).alias("thought"), m["role"].alias("role"))), lambda x: (x["role"] == "assistant") & x["thought"].isNotNull())
    t = c.select("idx", thoughts.alias("t"))
    pairs = F.flatten(F.transform("t", lambda a: F.transform(F.filter("t", lambda b: (b["pos"] > a["pos"]) & (b["thought"] == a["thought"])), lambda b: F.struct(a["pos"].alias("first"), b["pos"].alias("second")))))
    return t.select("idx", F.explode(pairs).alias("p")).select("idx", "p.first", "p.second", (F.col("p.second") - F.col("p.first") == 2).alias("adjacent"))


def without_repeated_thoughts(c: DataFrame, placeholder: str = "<think>(as before)</think>") -> DataFrame:
    """Contents whose thought repeats an earlier one of the conversation get a placeholder; the first is kept. Within the row."""
    thought = lambda m: F.when(m["role"] == "assistant", F.get(text.tag_contents(m["content"], "think"), F.lit(0)))
    t = c.select("idx", "messages", F.transform("messages", thought).alias("t"))
    m = t.select("idx", "t", F.posexplode("messages").alias("pos", "m")).withColumn("thought", F.get("t", F.col("pos"))).filter("thought is not null")
    m = m.withColumn("repeats", F.array_position("t", F.col("thought")) - 1 < F.col("pos"))
    return m.select("idx", "pos", "repeats", F.when(F.col("repeats"), text.hidden_thoughts(F.col("m.content"), placeholder)).otherwise(F.col("m.content")).alias("content"))


def words(content: Column) -> Column:
    """How many words a text has; the counter that is used unless another is given, as that of a tokenizer."""
    return F.size(F.filter(F.split(F.coalesce(content, F.lit("")), r"(?U)\s+"), lambda w: w != ""))


def long_messages(c: DataFrame, most: int, counter: Callable[[Column], Column] = words) -> DataFrame:
    """Messages of more than ``most`` tokens by the counter, system messages aside."""
    return messages(c).filter("not (role <=> 'system')").select("idx", "pos", counter(F.col("content")).cast("bigint").alias("n_words")).filter(F.col("n_words") > most)


def longest_message(counter: Callable[[Column], Column] = words) -> Column:
    """A10: tokens of the longest assistant message, 0 without any."""
    return F.coalesce(F.array_max(F.transform(F.filter("messages", lambda m: m["role"] == "assistant"), lambda m: counter(m["content"]))), F.lit(0))


def alternation(c: DataFrame) -> DataFrame:
    """Whether no two neighbouring messages have the same role."""
    roles = F.transform("messages", lambda m: F.coalesce(m["role"], F.lit("")))
    same = F.exists(F.sequence(F.lit(1), F.greatest(F.size(roles) - 1, F.lit(1))), lambda i: (F.get(roles, i) == F.get(roles, i - 1)))
    return c.filter("messages is not null").select("idx", F.size("messages").cast("bigint").alias("n_messages"), (~F.coalesce(same, F.lit(False))).alias("alternates"))


def with_last_call(c: DataFrame) -> DataFrame:
    """Each tool response with the last call before it, an as-of join by a window over the conversation."""
    w = Window.partitionBy("idx").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    m = messages(c).withColumn("call_id", F.try_element_at("tool_calls", F.lit(-1))["id"])
    return m.withColumn("last_call", F.last("call_id", ignorenulls=True).over(w)).filter("role = 'tool'").select("idx", "pos", "tool_call_id", "last_call")


def answer_policy(c: DataFrame) -> DataFrame:
    """Each message with an answer and whether a tool response stands right before it, hints aside."""
    kept = F.filter(F.transform("messages", lambda m, i: F.struct(i.alias("pos"), m["role"].alias("role"), m["content"].alias("content"))), lambda x: ~F.coalesce((x["role"] == "user") & x["content"].rlike(r"(?U)^\s*\[diag\] "), F.lit(False)))
    t = c.select("idx", kept.alias("k"))
    one = t.select("idx", F.explode(F.transform("k", lambda x, i: F.struct(x.alias("m"), F.get("k", i - 1)["role"].alias("before")))).alias("x"))
    answered = one.filter("x.m.role = 'assistant'").withColumn("answer", text.last_content(F.col("x.m.content"), "answer")).filter("answer <> ''")
    return answered.select("idx", "x.m.pos", F.coalesce(F.col("x.before") == "tool", F.lit(False)).alias("allowed"))


#: Checks of a conversation, in order (V9-V14). Sequences count for minimal datasets only, lengths where a limit is given.
CHECKS = ("answer", "repeated_call", "sequence", "count", "tokens", "thought")


def failed_checks(minimal: bool = True, most_tokens: int | None = None, counter: Callable[[Column], Column] = words) -> Column:
    """Names of the failed checks of a conversation, all judged within its row."""
    names = F.filter(tool_sequence(F.col("messages")), lambda x: x.isNotNull())
    thoughts = F.filter(F.transform(F.filter("messages", lambda m: m["role"] == "assistant"), lambda m: F.get(text.tag_contents(m["content"], "think"), F.lit(0))), lambda x: x.isNotNull())
    repeats = lambda a: F.coalesce(F.size(a) > F.size(F.array_distinct(a)), F.lit(False))
    wrong_step = F.exists(F.transform(truths(F.col("stepwise_ground_truths")), lambda t, i: step_error(t["key"], t["value"], i)), lambda e: e.isNotNull())
    tests = (
        answer_differs(minimal), repeats(names), F.coalesce(wrong_step, F.lit(False)) if minimal else F.lit(False), ~has_due_count(),
        F.lit(False) if most_tokens is None else F.coalesce(longest_message(counter) > most_tokens, F.lit(False)), repeats(thoughts),
    )
    return F.filter(F.array(*[F.when(t, F.lit(n)) for t, n in zip(tests, CHECKS)]), lambda x: x.isNotNull())


def issues(c: DataFrame, minimal: bool = True, most_tokens: int | None = None, counter: Callable[[Column], Column] = words) -> DataFrame:
    """Every failed check of every conversation as rows: check_name, idx. One pass, no shuffle."""
    return c.select("idx", F.explode(failed_checks(minimal, most_tokens, counter)).alias("check_name")).select("check_name", "idx")


def issue_report(c: DataFrame, minimal: bool = True, most_tokens: int | None = None) -> DataFrame:
    """Conversations per failed check and with any, and their percentage of all: one aggregation."""
    f = c.select(failed_checks(minimal, most_tokens).alias("f"))
    counts = f.agg(F.count("*").alias("total"), F.count_if(F.size("f") > 0).alias("any"), *[F.count_if(F.array_contains("f", n)).alias(n) for n in CHECKS])
    rows = counts.select("total", F.explode(F.array(*[F.struct(F.lit(n).alias("check_name"), F.col(n).alias("n_failed")) for n in (*CHECKS, "any")])).alias("r"))
    return rows.select("r.check_name", "r.n_failed", F.round(F.coalesce(F.try_divide(F.col("r.n_failed") * 100, F.col("total")), F.lit(0.0)), 6).alias("percent"))


def clean(c: DataFrame, minimal: bool = True, most_tokens: int | None = None) -> DataFrame:
    """Conversations without any failed check."""
    return c.filter(F.size(failed_checks(minimal, most_tokens)) == 0)


def edited(c: DataFrame, config: DataFrame) -> DataFrame:
    """Thoughts replaced, then messages removed, where the number of messages is the expected initial one, so that a second run changes nothing.

    ``config``: idx, to_remove array<int>, to_replace map<int,string>, initial_msg_count, expected_final_msg_count.
    """
    swap = lambda m, i: F.when(F.element_at("to_replace", i).isNotNull(), m.withField("content", text.replaced_content(m["content"], "think", F.element_at("to_replace", i)))).otherwise(m)  # noqa: E731,E501
    replaced = F.transform("messages", swap)
    numbered = F.transform(replaced, lambda m, i: F.struct(m.alias("m"), i.alias("i")))
    kept = F.transform(F.filter(numbered, lambda x: ~F.array_contains(F.coalesce("to_remove", F.array().cast("array<int>")), x["i"])), lambda x: x["m"])
    due = F.coalesce(F.size("messages") == F.col("initial_msg_count"), F.lit(False))
    out = c.join(config, "idx", "left").withColumn("messages", F.when(due, kept).otherwise(F.col("messages")))
    return out.withColumn("as_expected", F.coalesce(F.size("messages") == F.col("expected_final_msg_count"), F.lit(True))).drop("to_remove", "to_replace", "initial_msg_count", "expected_final_msg_count")
