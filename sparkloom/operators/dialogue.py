"""Building and running tool-use conversations.

A model is a table of outputs (conversation, turn, text): everything else about a multi-turn run is
column logic. What a turn does depends on its own text and on which turns before it could be used,
so turns are judged as rows, and a conversation is put together inside one row from its few turns.
Messages are structs of role, content, tool_calls, tool_call_id and name.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import answers, linalg, text

CALLS = "array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>"
MESSAGE = f"struct<role:string,content:string,tool_calls:{CALLS},tool_call_id:string,name:string>"

#: The prompt's wording of the format, and the reason of a blank turn.
FORMAT_RULES = (
    "Required format: <think>reasoning</think>, then either\n"
    '<tool_call>{"name":"<function_name>","arguments":{"<param>":"<value>"}}</tool_call>\n'
    "or <answer>result</answer>."
)
EMPTY_TURN = "empty generation"


def message(role: str, content: Column, calls: Column | None = None, call_id: Column | None = None, name: Column | None = None) -> Column:
    """One message."""
    null = F.lit(None).cast("string")
    return F.struct(
        F.lit(role).alias("role"), content.cast("string").alias("content"), (F.lit(None) if calls is None else calls).cast(CALLS).alias("tool_calls"), (null if call_id is None else call_id).alias("tool_call_id"), (null if name is None else name).alias("name"),
    )


def call_id(*keys: Column) -> Column:
    """A stable id of a call: a hash of what it belongs to."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(k.cast("string"), F.lit("")) for k in keys]), 256), 1, 24)


def assistant_message(thought: Column, answer: Column, tool: Column, arguments: Column, id_: Column) -> Column:
    """A thought with its answer, or with its call; null if there is neither."""
    thinks = F.concat(F.lit("<think>"), F.coalesce(thought, F.lit("")), F.lit("</think>"))
    calls = F.array(F.struct(id_.alias("id"), F.lit("function").alias("type"), F.struct(tool.alias("name"), arguments.alias("arguments")).alias("function")))
    return F.when(answer.isNotNull(), message("assistant", F.concat(thinks, F.lit("\n\n<answer>"), answer, F.lit("</answer>")))).when(tool.isNotNull(), message("assistant", thinks, calls))


def tool_message(name: Column, result: Column, id_: Column) -> Column:
    """A tool's response."""
    return message("tool", result, None, id_, name)


def appended(messages: Column, new: Column) -> Column:
    """M2: a message at the end; null adds nothing, and an assistant may only follow a user or a tool, else the result is null."""
    last = F.try_element_at(messages, F.lit(-1))["role"]
    refused = (new["role"] == "assistant") & ~F.coalesce(last.isin("user", "tool"), F.lit(False))
    return F.when(new.isNull(), messages).when(refused, F.lit(None)).otherwise(F.array_append(messages, new))


def with_reasoning(reasoning: Column, content: Column) -> Column:
    """The reasoning as a thought before the content, an empty one if there is none."""
    return F.concat(F.lit("<think>"), F.coalesce(reasoning, F.lit("")), F.lit("</think>"), F.coalesce(content, F.lit("")))


def without_call_contents(messages: Column) -> Column:
    """Assistant messages that call tools lose their content."""
    return F.transform(messages, lambda m: F.when((m["role"] == "assistant") & (F.size(m["tool_calls"]) > 0), m.withField("content", F.lit(""))).otherwise(m))


def with_system_prompt(messages: Column, prompt: str) -> Column:
    """Another first system prompt; conversations that begin otherwise stay as they are."""
    return F.transform(messages, lambda m, i: F.when((i == 0) & (m["role"] == "system"), m.withField("content", F.lit(prompt))).otherwise(m))


def for_training(messages: Column) -> Column:
    """Assistant thoughts on lines of their own."""
    return F.transform(messages, lambda m: F.when(m["role"] == "assistant", m.withField("content", text.spaced_think(m["content"]))).otherwise(m))


def only_messages(entries: Column) -> Column:
    """The entries that are messages."""
    return F.filter(entries, lambda m: m.isNotNull() & m["role"].isNotNull())


def split_system(messages: Column) -> Column:
    """The leading system message's content, and the other messages."""
    leads = F.get(messages, F.lit(0))["role"] == "system"
    rest = F.slice(messages, F.when(leads, 2).otherwise(1), F.greatest(F.size(messages), F.lit(1)))
    return F.struct(F.when(leads, F.get(messages, F.lit(0))["content"]).alias("system"), rest.alias("messages"))


def is_hint(m: Column) -> Column:
    """a user message that only reports a format error."""
    return F.coalesce((m["role"] == "user") & m["content"].rlike(r"(?U)^\s*\[diag\] "), F.lit(False))


def without_hints(messages: Column, with_cause: bool = True, keep: int = 0) -> Column:
    """messages without hints but the last ``keep``; the first user message always stays. ``with_cause``: the assistant message before each hint goes, too."""
    first_user = F.array_position(F.transform(messages, lambda m: F.coalesce(m["role"], F.lit(""))), "user") - 1
    marked = F.transform(messages, lambda m, i: F.struct(m.alias("m"), (is_hint(m) & (i != first_user)).alias("hint"), i.alias("i")))
    places = F.transform(F.filter(marked, lambda x: x["hint"]), lambda x: x["i"])
    gone = F.slice(places, 1, F.greatest(F.size(places) - keep, F.lit(0)))

    def stays(x: Column) -> Column:
        causes = (x["m"]["role"] == "assistant") & F.array_contains(gone, x["i"] + 1) if with_cause else F.lit(False)
        return ~F.array_contains(gone, x["i"]) & ~F.coalesce(causes, F.lit(False))

    return F.transform(F.filter(marked, stays), lambda x: x["m"])


def hint(reason: Column) -> Column:
    """The text of a hint."""
    return F.concat(F.lit(f"{text.HINT} Format error: "), reason, F.lit(f".\n{FORMAT_RULES}"))


def final_output(messages: Column, keep_system: bool = True) -> Column:
    """M3: a finished conversation without hints, and without its system prompt if so asked; an empty list if there is nothing."""
    out = without_hints(messages)
    out = out if keep_system else split_system(out)["messages"]
    return F.coalesce(F.when(F.size(messages) > 0, out), F.array().cast(f"array<{MESSAGE}>"))


def kept_diagnostics(items: Column) -> Column:
    """M7: diagnostics without null and empty ones."""
    return F.filter(items, lambda x: F.coalesce(x, F.lit("")) != "")


def user_echo(content: Column) -> Column:
    """The user of the environment repeats what it is told."""
    return F.concat(content, F.lit("\n"))


def truncated(output_tokens: Column, most: Column) -> Column:
    """M5: a turn that used all tokens it had."""
    return F.coalesce(output_tokens == most, F.lit(False))


def failure_prompt(rollouts: Column) -> Column:
    """Failed rollouts as one prompt, numbered."""
    return F.concat(F.lit("The following rollouts failed. Say what went wrong in each.\n\n"), F.array_join(F.transform(rollouts, lambda r, i: F.concat(F.lit("--- ROLLOUT "), (i + 1).cast("string"), F.lit(" ---\n"), r)), "\n\n"))


def judged_turns(outputs: DataFrame) -> DataFrame:
    """What each output (idx, turn, output) is by itself: thought, answer, tool and its result, or the reason why it can't be used.

    The missing opening of a thought is put in front, as the prompt ends with it. An answer is only
    usable after a tool's response, which the row doesn't know yet: reason_first holds what is wrong
    with it if there is none.
    """
    a = outputs.withColumn("seeded", text.with_think_prefix(F.col("output"))).withColumn("a", text.analysis(F.col("seeded"), linalg.TOOLS))
    blank = text.is_blank(F.col("output"))
    usable = F.coalesce(F.col("a.valid") & ~F.col("a.outside") & (F.col("a.think_count") == 1) & ((F.col("a.tool_call_count") == 1) != (F.col("a.answer_count") == 1)), F.lit(False))
    called = usable & (F.col("a.tool_call_count") == 1) & F.col("a.call.json_valid") & F.col("a.call.arguments_valid") & F.col("a.name_known")
    answered = usable & (F.col("a.answer_count") == 1)
    args = F.when(called, F.get_json_object("a.tool_block", "$.arguments"))
    result = linalg.execute(F.when(called, F.col("a.call.name")), F.from_json(F.get_json_object(args, "$.matrix"), linalg.MATRIX))
    reason = lambda ok: F.when(blank, F.lit(EMPTY_TURN)).otherwise(text.failure_reason(F.col("a"), F.lit(ok)))
    return a.select(
        "idx", "turn", "output", F.col("a.thought").alias("thought"), called.alias("called"), answered.alias("answered"), F.when(called, F.col("a.call.name")).alias("tool"), args.alias("arguments"),
        F.when(answered, F.col("a.answer")).alias("answer"), F.when(called, result).alias("result"), F.when(~called & ~answered, reason(True)).alias("reason"), F.when(answered, reason(False)).alias("reason_first"),
    )


def multi_turn(queries: DataFrame, outputs: DataFrame, n_turns: int, system: str | None = None) -> DataFrame:
    """Conversations run over given outputs: idx, messages, final_answer, n_used, malformed_turns, tool_errors, tools, diagnostics.

    ``queries``: idx, query. A conversation goes on, turn by turn, until an answer that follows a
    tool's response, or ``n_turns``; an unusable turn adds only a diagnosis, and is asked again. The
    last turn's call isn't carried out. The few turns of a conversation are one array in its row.
    """
    turns = judged_turns(outputs.filter((F.col("turn") >= 0) & (F.col("turn") < n_turns)))
    held = turns.groupBy("idx").agg(F.array_sort(F.collect_list(F.struct("turn", "output", "thought", "called", "answered", "tool", "arguments", "answer", "result", "reason", "reason_first"))).alias("t"))
    d = queries.join(held, "idx", "left").withColumn("t", F.coalesce("t", F.array().cast(held.schema["t"].dataType)))
    first_call = F.array_min(F.transform(F.filter("t", lambda x: x["called"]), lambda x: x["turn"]))
    last_turn = F.array_min(F.transform(F.filter("t", lambda x: x["answered"] & F.coalesce(x["turn"] > F.col("first_call"), F.lit(False))), lambda x: x["turn"]))
    d = d.withColumn("first_call", first_call).withColumn("ends", last_turn).withColumn("t", F.filter("t", lambda x: F.col("ends").isNull() | (x["turn"] <= F.col("ends"))))
    early = lambda x: x["answered"] & ~F.coalesce(x["turn"] > F.col("first_call"), F.lit(False))
    bad = lambda x: x["reason"].isNotNull() | early(x)
    id_ = lambda x: call_id(F.col("idx"), x["turn"])
    spoken = lambda x: F.when(bad(x), F.lit(None).cast(MESSAGE)).otherwise(assistant_message(x["thought"], x["answer"], x["tool"], x["arguments"], id_(x)))
    reply = lambda x: F.when(x["called"] & (x["turn"] < n_turns - 1), tool_message(x["tool"], x["result"], id_(x)))
    said = F.filter(F.flatten(F.transform("t", lambda x: F.array(spoken(x), reply(x)))), lambda m: m.isNotNull())
    opening = F.array(message("user", F.col("query"))) if system is None else F.array(message("system", F.lit(system)), message("user", F.col("query")))
    ran = lambda x: x["called"] & (x["turn"] < n_turns - 1)
    return d.select(
        "idx", F.concat(opening, said).alias("messages"), F.try_element_at(F.filter("t", lambda x: x["turn"] == F.col("ends")), F.lit(1))["answer"].alias("final_answer"), F.size("t").alias("n_used"),
        F.size(F.filter("t", bad)).alias("malformed_turns"), F.size(F.filter("t", lambda x: ran(x) & F.coalesce(x["result"].startswith("ERROR:"), F.lit(False)))).alias("tool_errors"),
        F.transform(F.filter("t", ran), lambda x: x["tool"]).alias("tools"),
        F.transform(F.filter("t", bad), lambda x: F.concat(F.lit("turn "), x["turn"].cast("string"), F.lit(": "), F.coalesce(x["reason"], x["reason_first"]))).alias("diagnostics"),
    )


def solve_counters(turns: DataFrame, most_steps: int, most_tokens: int) -> DataFrame:
    """Per conversation of ``turns`` (idx, turn, completion_tokens): total, mean and largest tokens, steps, and whether it was stopped by a limit."""
    n, tokens = F.count("*"), F.coalesce(F.col("completion_tokens"), F.lit(0))
    return turns.groupBy("idx").agg(
        F.sum(tokens).alias("total_tokens"), F.round(F.avg(tokens), 6).alias("avg_tokens"), F.max(tokens).alias("max_tokens"), n.alias("steps"), ((n >= most_steps) | (F.max(tokens) >= most_tokens)).alias("forced_stop")
    )


def final_reward(kind: Column, reward: Column, forced_stop: Column, judged: Column) -> Column:
    """-1 for a forced stop; else the environment's reward, kept as it is for 'real' and 'general_rm', with the judge's score for 'real+llm'; null for other kinds."""
    return F.when(F.coalesce(forced_stop, F.lit(False)), F.lit(-1.0)).when(kind.isin("real", "general_rm"), reward).when(kind == "real+llm", reward + F.coalesce(judged, F.lit(0.0)))


def environment_reward(data: Column, expected_data: Column, outputs: Column, responses: Column) -> Column:
    """1 if the data's canonical hashes agree and each output stands in some response, ignoring case and commas; else 0."""
    plain = lambda c: F.lower(F.replace(c, F.lit(","), F.lit("")))
    found = F.forall(F.coalesce(outputs, F.array().cast("array<string>")), lambda o: F.exists(F.coalesce(responses, F.array().cast("array<string>")), lambda r: F.coalesce(F.contains(plain(r), plain(o)), F.lit(False))))
    return F.when((canonical_hash(data) == canonical_hash(expected_data)) & found, 1.0).otherwise(0.0)


def canonical(value: Column) -> Column:
    """A nested value as text in one order: JSON with sorted keys, nulls kept."""

    def run(values: pd.Series) -> pd.Series:
        def one(v):
            if v is None:
                return None
            try:
                return json.dumps(json.loads(v), sort_keys=True, ensure_ascii=False)
            except ValueError:
                return v

        return values.map(one)

    return F.pandas_udf(run, "string")(value)


def canonical_hash(value: Column) -> Column:
    """SHA-256 of a nested value's JSON text, whatever the order of its keys."""
    return F.sha2(canonical(value), 256)


def evaluation_turns(judged: DataFrame, n_steps: DataFrame) -> DataFrame:
    """Per sample of judged_turns() the turns used (at most its steps and one), the answer, and why it stopped early.

    ``n_steps``: idx, steps. Reasons: extraction_failed (unusable turn), final_answer_provided; null
    if the turns ran out.
    """
    d = judged.join(n_steps, "idx").filter(F.col("turn") <= F.col("steps"))
    held = d.groupBy("idx").agg(F.array_sort(F.collect_list(F.struct("turn", "called", "answered", "answer"))).alias("t"))
    stops = F.array_min(F.transform(F.filter("t", lambda x: ~x["called"]), lambda x: x["turn"]))
    at = F.try_element_at(F.filter("t", lambda x: x["turn"] == F.col("stops")), F.lit(1))
    h = held.withColumn("stops", stops)
    return h.select(
        "idx", F.coalesce(F.col("stops") + 1, F.size("t")).alias("n_turns"), at["answer"].alias("answer"), F.when(at["answered"], "final_answer_provided").when(F.col("stops").isNotNull(), "extraction_failed").alias("early_stop_reason"),
    )


def partial_format(content: Column) -> Column:
    """A closed thought that occurs exactly once, and tool tags, or answer tags if there are none of those, each once."""
    once = lambda t: F.coalesce((F.size(F.split(content, t, -1)) == 2).cast("int"), F.lit(0))
    tools = once("<tool_call>") + once("</tool_call>")
    return once("</think>") + F.when(tools == 0, once("<answer>") + once("</answer>")).otherwise(tools)


def format_scores(c: DataFrame) -> DataFrame:
    """Per conversation the mean partial and strict format of the messages after the first two, 0 without any."""
    rest = F.slice("messages", 3, F.greatest(F.size("messages"), F.lit(1)))
    mean = lambda f: F.coalesce(F.try_divide(F.aggregate(rest, F.lit(0.0), lambda s, m: s + F.coalesce(f(m["content"]).cast("double"), F.lit(0.0))), F.size(rest)), F.lit(0.0))
    strict = lambda x: text.thinks_then_answers(x) | text.thinks_then_calls(x)
    return c.filter("messages is not null").select("idx", F.round(mean(partial_format), 6).alias("partial_format"), F.round(mean(strict), 6).alias("strict_format"))


def evaluation_counts(c: DataFrame, tools: tuple[str, ...] = linalg.TOOLS) -> DataFrame:
    """Over conversations (messages, stepwise_ground_truths, ground_truth): samples, expected and actual calls, answers, and right last answers."""
    from sparkloom.operators.validate import truths

    assistant = F.filter(F.slice("messages", 3, F.greatest(F.size("messages"), F.lit(1))), lambda m: m["role"] == "assistant")
    calls = F.aggregate(assistant, F.lit(0), lambda s, m: s + F.greatest(F.size(F.coalesce(m["tool_calls"], F.array().cast(CALLS))), F.size(text.tag_contents(m["content"], "tool_call")).cast("int")))
    given = F.filter(F.transform(assistant, lambda m: text.last_content(m["content"], "answer")), lambda x: x.isNotNull())
    last = F.try_element_at(given, F.lit(-1))
    per = c.select(F.greatest(F.size(truths(F.col("stepwise_ground_truths"))), F.lit(0)).alias("expected"), F.coalesce(calls, F.lit(0)).alias("calls"), F.greatest(F.size(given), F.lit(0)).alias("answers"), answers.equal(last, F.col("ground_truth")).alias("right"))
    return per.agg(
        F.count("*").alias("samples"), F.sum("expected").alias("expected_calls"), F.sum("calls").alias("actual_calls"), F.count("*").alias("expected_answers"), F.sum("answers").alias("actual_answers"), F.count_if("right").alias("correct_answers")
    )


def evaluation_ratios(counts: DataFrame) -> DataFrame:
    """Ratios of evaluation_counts(), 0 where the denominator is 0."""
    ratio = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    c = F.col
    return counts.select(
        ratio(c("actual_calls") + c("actual_answers"), c("expected_calls") + c("samples")).alias("format_accuracy"), ratio(c("actual_calls"), c("expected_calls")).alias("format_tool_call_accuracy"),
        ratio(c("actual_answers"), c("expected_answers")).alias("format_answer_accuracy"), ratio(c("correct_answers"), c("samples")).alias("answer_accuracy"),
    )
