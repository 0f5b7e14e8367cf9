"""Queries of the conversation operators; names and SQL as in core_queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import text
from sparkloom.operators import dialogue, prepare, validate
from sparkloom.plans.core_queries import _SPACE, _STRICT, ASSISTANT, MESSAGES, _tag, chat, query
from sparkloom.session import table
from sparkloom.sources import io

_CONTENTS = "array_to_string(list_transform({}, lambda x: coalesce(x, '~')), '|')"


def _shown(messages):
    """Contents of all messages as one text, so that content itself is compared."""
    return F.array_join(F.transform(messages, lambda m: F.coalesce(m["content"], F.lit("~"))), "|")


@query("P2_contents", f"SELECT idx, {_CONTENTS.format('list_transform(messages, lambda m: m.content)')} AS contents, len(messages) AS n FROM conversations_chat WHERE messages IS NOT NULL")
def p2(s: SparkSession, d: str) -> DataFrame:
    """Messages stored as JSON text come back with their contents."""
    q = chat(s, d).filter("messages is not null").select("idx", F.from_json(F.to_json("messages"), f"array<{dialogue.MESSAGE}>").alias("m"))
    return q.select("idx", _shown(F.col("m")).alias("contents"), F.size("m").cast("bigint").alias("n"))


@query("P4_with_tools", "SELECT question_id, coalesce(topic, 'all tools') AS tools FROM questions")
def p4(s: SparkSession, d: str) -> DataFrame:
    """A constant where the column is missing or null."""
    return prepare.with_constant(table(s, d, "questions").withColumnRenamed("topic", "tools"), "tools", "all tools").select("question_id", "tools")


@query("P6_for_training", f"WITH {MESSAGES} SELECT idx, pos, CASE WHEN role = 'assistant' THEN regexp_replace(regexp_replace(content, '<think>{_SPACE}*', '<think>' || chr(10), 'g'), '{_SPACE}*</think>', chr(10) || '</think>', 'g') ELSE content END AS content FROM mm")
def p6(s: SparkSession, d: str) -> DataFrame:
    return validate.messages(chat(s, d).withColumn("messages", dialogue.for_training(F.col("messages")))).select("idx", "pos", "content")


@query("P8_system_prompt", f"WITH {MESSAGES} SELECT idx, pos, CASE WHEN pos = 0 AND role = 'system' THEN 'Use the tools.' ELSE content END AS content FROM mm")
def p8(s: SparkSession, d: str) -> DataFrame:
    return validate.messages(chat(s, d).withColumn("messages", dialogue.with_system_prompt(F.col("messages"), "Use the tools."))).select("idx", "pos", "content")


@query("P10_cast_to_schema", "SELECT base_id, question_id, query, difficulty, CAST(NULL AS VARCHAR) AS tools FROM base_dataset")
def p10(s: SparkSession, d: str) -> DataFrame:
    """A split in the schema of another: columns by name, missing ones null, others dropped."""
    return prepare.to_schema(table(s, d, "base_dataset"), "base_id bigint, question_id bigint, query string, difficulty string, tools string")


@query("P18_only_messages", f"WITH {MESSAGES} SELECT idx, pos, role FROM mm WHERE role IS NOT NULL")
def p18(s: SparkSession, d: str) -> DataFrame:
    m = chat(s, d).withColumn("messages", F.transform("messages", lambda m, i: m.withField("name", i.cast("string"))))  # the place before anything is dropped
    kept = m.select("idx", F.explode(dialogue.only_messages(F.col("messages"))).alias("m"))
    return kept.select("idx", F.col("m.name").cast("int").alias("pos"), "m.role")


@query("P23_call_rows", "SELECT task_id, user_id, instruction, len(actions) AS generated, 'kernel' AS model, CAST(base_id AS VARCHAR) AS base FROM tasks")
def p23(s: SparkSession, d: str) -> DataFrame:
    """Input columns, the output, and metadata as text."""
    t = table(s, d, "tasks")
    row = prepare.call_row(t, ["task_id", "user_id", "instruction"], {"generated": F.nullif(F.size("actions"), F.lit(-1)).cast("bigint")}, {"model": F.lit("kernel"), "base": F.col("base_id")})
    return row.select("task_id", "user_id", "instruction", F.when(F.col("generated") >= 0, F.col("generated")).alias("generated"), F.col("metadata")["model"].alias("model"), F.col("metadata")["base"].alias("base"))


@query("P24_without_call_contents", f"WITH {MESSAGES} SELECT idx, pos, CASE WHEN role = 'assistant' AND len(tool_calls) > 0 THEN '' ELSE content END AS content FROM mm")
def p24(s: SparkSession, d: str) -> DataFrame:
    return validate.messages(chat(s, d).withColumn("messages", dialogue.without_call_contents(F.col("messages")))).select("idx", "pos", "content")


@query("P19_rendered_text", f"""WITH {MESSAGES}, l AS (SELECT idx, pos, upper(role) || ': ' || coalesce(content, '') || coalesce(chr(10) || nullif(array_to_string(list_transform(tool_calls, lambda t: 'TOOL CALL: ' || t.function.name || ': ' || t.function.arguments), chr(10)), ''), chr(10)) AS line FROM mm WHERE role IS NOT NULL)
SELECT idx, md5(string_agg(line, chr(10) ORDER BY pos)) AS digest FROM l GROUP BY idx""")
def p19(s: SparkSession, d: str) -> DataFrame:
    """The whole text of each conversation, with its calls, as a digest."""
    m = dialogue.only_messages(F.col("messages"))
    return chat(s, d).select("idx", m.alias("m")).filter(F.size("m") > 0).select("idx", F.md5(prepare.rendered(F.col("m"))).alias("digest"))


_DIAG = f"coalesce(role = 'user' AND regexp_matches(content, '^{_SPACE}*\\[diag\\] '), false)"


@query("F10_hints_and_causes", f"""WITH {MESSAGES}, turned AS (SELECT idx, pos, role, CASE WHEN role = 'user' AND pos % 3 = 1 THEN '[diag] ' || coalesce(content, '') ELSE content END AS content FROM mm),
u AS (SELECT idx, min(pos) AS first_user FROM turned WHERE role = 'user' GROUP BY idx), h AS (SELECT t.idx, t.pos FROM turned t JOIN u ON u.idx = t.idx WHERE {_DIAG} AND t.pos <> first_user)
SELECT t.idx, t.pos, t.content FROM turned t WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.idx = t.idx AND h.pos = t.pos) AND NOT (coalesce(t.role, '') = 'assistant' AND EXISTS (SELECT 1 FROM h WHERE h.idx = t.idx AND h.pos = t.pos + 1))""")  # noqa: E501
def f10(s: SparkSession, d: str) -> DataFrame:
    """Every third message of users turned into a hint; hints go with the assistant message before them, but for the first user message."""
    hinted = F.transform("messages", lambda m, i: F.when((m["role"] == "user") & (i % 3 == 1), m.withField("content", F.concat(F.lit("[diag] "), F.coalesce(m["content"], F.lit(""))))).otherwise(m))
    marked = F.transform(hinted, lambda m, i: m.withField("name", i.cast("string")))
    left = chat(s, d).withColumn("messages", marked).select("idx", F.explode(dialogue.without_hints(F.col("messages"))).alias("m")).filter("m is not null")
    return left.select("idx", F.col("m.name").cast("int").alias("pos"), "m.content")


@query("M20_split_system", "SELECT idx, CASE WHEN messages[1].role = 'system' THEN messages[1].content END AS system, len(messages) - CASE WHEN coalesce(messages[1].role = 'system', false) THEN 1 ELSE 0 END AS n FROM conversations_chat WHERE messages IS NOT NULL")
def m20(s: SparkSession, d: str) -> DataFrame:
    m = chat(s, d).filter("messages is not null").select("idx", dialogue.split_system(F.col("messages")).alias("x"))
    return m.select("idx", "x.system", F.size("x.messages").cast("bigint").alias("n"))


@query("M7_diagnostics", "SELECT task_id, array_to_string(list_filter(outputs, lambda x: coalesce(x, '') <> ''), '|') AS kept FROM tasks")
def m7(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "tasks").select("task_id", F.array_join(dialogue.kept_diagnostics(F.col("outputs")), "|").alias("kept"))


@query("M24_split_names", "SELECT question_id, CASE WHEN lower(trim(split, ' ')) IN ('val', 'validation') THEN 'validation' WHEN lower(trim(split, ' ')) IN ('train', 'test') THEN lower(trim(split, ' ')) END AS split FROM questions")
def m24(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "questions").select("question_id", prepare.split_name(F.col("split")).alias("split"))


@query("M10_difficulty_by_name", "SELECT question_id, CASE WHEN upper(problem_type) LIKE 'ONE\\_%' ESCAPE '\\' THEN 'ONE_TOOL_CALL' WHEN upper(problem_type) LIKE 'TWO\\_%' ESCAPE '\\' THEN 'TWO_TOOL_CALLS' WHEN upper(problem_type) LIKE 'THREE\\_%' ESCAPE '\\' THEN 'THREE_TOOL_CALLS' END AS difficulty FROM questions")
def m10(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "questions").select("question_id", prepare.difficulty_of_type(F.col("problem_type")).alias("difficulty"))


@query("M26_with_reasoning", f"{ASSISTANT} SELECT idx, pos, '<think>' || coalesce({_tag('think')}[-1], '') || '</think>' || coalesce({_tag('answer')}[-1], '') AS content FROM a")
def m26(s: SparkSession, d: str) -> DataFrame:
    a = validate.messages(chat(s, d)).filter("role = 'assistant' and content is not null")
    return a.select("idx", "pos", dialogue.with_reasoning(text.last_content(F.col("content"), "think"), text.last_content(F.col("content"), "answer")).alias("content"))


_ONCE = "CAST(coalesce(len(string_split(content, '{}')) = 2, false) AS INTEGER)"
_MARKS = f"({_ONCE.format('</think>')} + CASE WHEN {_ONCE.format('<tool_call>')} + {_ONCE.format('</tool_call>')} = 0 THEN {_ONCE.format('<answer>')} + {_ONCE.format('</answer>')} ELSE {_ONCE.format('<tool_call>')} + {_ONCE.format('</tool_call>')} END)"


@query("X32_format_scores", f"""WITH {MESSAGES}, r AS (SELECT idx, len(messages) AS n FROM conversations_chat WHERE messages IS NOT NULL),
s AS (SELECT idx, sum(CASE WHEN content IS NULL THEN 0 ELSE {_MARKS} END) AS marks, sum(CAST(coalesce({_STRICT}, false) AS INTEGER)) AS strict FROM mm WHERE pos >= 2 GROUP BY idx)
SELECT r.idx, round(CASE WHEN n > 2 THEN coalesce(marks, 0) / (n - 2) ELSE 0 END, 6) AS partial_format, round(CASE WHEN n > 2 THEN coalesce(strict, 0) / (n - 2) ELSE 0 END, 6) AS strict_format FROM r LEFT JOIN s ON s.idx = r.idx""")  # noqa: E501
def x32(s: SparkSession, d: str) -> DataFrame:
    """Partial and strict format per conversation."""
    return dialogue.format_scores(chat(s, d))


def outputs(s: SparkSession, d: str) -> DataFrame:
    """The assistant contents of the conversations as a model's outputs, their calls written as tags."""
    m = F.filter("messages", lambda m: m["role"] == "assistant")
    call = lambda x: F.get(x["tool_calls"], F.lit(0))["function"]
    tag = lambda x: F.coalesce(F.concat(F.lit('\n<tool_call>{"name": "'), call(x)["name"], F.lit('", "arguments": '), call(x)["arguments"], F.lit("}</tool_call>")), F.lit(""))
    return chat(s, d).select("idx", F.posexplode(F.transform(m, lambda x: F.concat(F.coalesce(x["content"], F.lit("")), tag(x)))).alias("turn", "output"))


@query("T2_multi_turn")
def t2(s: SparkSession, d: str) -> DataFrame:
    """Every conversation run again over its own outputs, six turns at most."""
    first = F.get(F.filter("messages", lambda m: m["role"] == "user"), F.lit(0))["content"]
    ran = dialogue.multi_turn(chat(s, d).select("idx", first.alias("query")), outputs(s, d), 6, "Use the tools.")
    return ran.select("idx", _shown(F.col("messages")).alias("contents"), "final_answer", "n_used", "malformed_turns", "tool_errors", F.array_join("tools", ",").alias("tools"), F.array_join("diagnostics", "; ").alias("diagnostics"))


@query("M21_evaluation_turns")
def m21(s: SparkSession, d: str) -> DataFrame:
    """How far each conversation's own outputs go within its steps and one."""
    steps = chat(s, d).select("idx", F.greatest(F.size(validate.truths(F.col("stepwise_ground_truths"))), F.lit(0)).alias("steps"))
    return dialogue.evaluation_turns(dialogue.judged_turns(outputs(s, d)), steps)


@query("A17_evaluation_counts")
def a17(s: SparkSession, d: str) -> DataFrame:
    """Literal equality of answers has no SQL; the ratios (A18) follow from these counts."""
    return dialogue.evaluation_counts(chat(s, d))


@query("A18_evaluation_ratios")
def a18(s: SparkSession, d: str) -> DataFrame:
    return dialogue.evaluation_ratios(dialogue.evaluation_counts(chat(s, d)))


@query("A19_progress", "SELECT count(*) AS samples, round(avg(CAST(is_correct AS INTEGER)), 6) AS correct, round(count(final_answer) / count(*), 6) AS answer_rate FROM conversations_chat")
def a19(s: SparkSession, d: str) -> DataFrame:
    """Progress means over all samples, and the share of those with an answer."""
    return chat(s, d).agg(F.count("*").alias("samples"), F.round(F.avg(F.col("is_correct").cast("int")), 6).alias("correct"), F.round(F.count("final_answer") / F.count("*"), 6).alias("answer_rate"))


@query("A20_category_counts", f"WITH {MESSAGES} SELECT source, coalesce(role, 'none') AS category, count(*) AS n FROM mm GROUP BY source, coalesce(role, 'none')")
def a20(s: SparkSession, d: str) -> DataFrame:
    """Counts per group and category."""
    m = chat(s, d).select("source", F.explode("messages").alias("m")).filter("m is not null")
    return m.groupBy("source", F.coalesce("m.role", F.lit("none")).alias("category")).agg(F.count("*").alias("n"))


@query("A21_group_rewards", "WITH g AS (SELECT task_id, avg(CAST(coalesce(is_correct, false) AS INTEGER)) AS reward FROM conversations_chat WHERE task_id IS NOT NULL GROUP BY task_id) SELECT count(*) AS n_groups, round(avg(reward), 6) AS avg_reward FROM g")
def a21(s: SparkSession, d: str) -> DataFrame:
    """Mean over groups of the groups' mean rewards."""
    g = chat(s, d).filter("task_id is not null").groupBy("task_id").agg(F.avg(F.coalesce("is_correct", F.lit(False)).cast("int")).alias("reward"))
    return g.agg(F.count("*").alias("n_groups"), F.round(F.avg("reward"), 6).alias("avg_reward"))


@query("R11_solve_counters", f"WITH {MESSAGES}, t AS (SELECT idx, coalesce(length(content), 0) AS tokens FROM mm WHERE role = 'assistant') SELECT idx, CAST(sum(tokens) AS BIGINT) AS total_tokens, round(avg(tokens), 6) AS avg_tokens, max(tokens) AS max_tokens, count(*) AS steps, count(*) >= 4 OR max(tokens) >= 600 AS forced_stop FROM t GROUP BY idx")
def r11(s: SparkSession, d: str) -> DataFrame:
    """Characters stand for tokens here; any counter may be given."""
    t = validate.messages(chat(s, d)).filter("role = 'assistant'").select("idx", F.col("pos").alias("turn"), F.length("content").cast("bigint").alias("completion_tokens"))
    return dialogue.solve_counters(t, 4, 600)


@query("R8_final_rewards", "SELECT idx, CAST(CASE WHEN idx % 7 = 0 THEN -1.0 WHEN idx % 4 IN (0, 1) THEN CAST(coalesce(is_correct, false) AS INTEGER) WHEN idx % 4 = 2 THEN CAST(coalesce(is_correct, false) AS INTEGER) + 0.25 END AS DOUBLE) AS reward FROM conversations_chat")
def r8(s: SparkSession, d: str) -> DataFrame:
    """Kinds, stops and judge scores by place; the fourth kind is unknown."""
    kinds = F.element_at(F.array(*[F.lit(k) for k in ("real", "general_rm", "real+llm", "other")]), (F.col("idx") % 4 + 1).cast("int"))
    return chat(s, d).select("idx", dialogue.final_reward(kinds, F.coalesce("is_correct", F.lit(False)).cast("double"), F.col("idx") % 7 == 0, F.lit(0.25)).alias("reward"))


@query("R7_environment_rewards", f"WITH {MESSAGES}, r AS (SELECT idx, list(lower(replace(content, ',', ''))) AS said FROM mm WHERE role = 'assistant' GROUP BY idx) SELECT c.idx, CASE WHEN list_bool_and(list_transform(t.outputs, lambda o: list_bool_or(list_transform(r.said, lambda x: contains(x, lower(replace(o, ',', ''))))))) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS reward FROM conversations_chat c JOIN tasks t ON t.task_id = c.task_id JOIN r ON r.idx = c.idx WHERE len(t.outputs) > 0 AND len(list_filter(t.outputs, lambda o: o IS NULL)) = 0")  # noqa: E501
def r7(s: SparkSession, d: str) -> DataFrame:
    """Outputs of the task in the responses; the data of the environment doesn't change here, only the order of its keys."""
    t = table(s, d, "tasks").select("task_id", "outputs").filter("size(outputs) > 0 and forall(outputs, o -> o is not null)")
    said = F.transform(F.filter("messages", lambda m: m["role"] == "assistant"), lambda m: m["content"])
    c = chat(s, d).select("idx", "task_id", said.alias("said")).filter(F.size("said") > 0).join(t, "task_id")
    return c.select("idx", dialogue.environment_reward(F.lit('{"a": 1, "b": [2]}'), F.lit('{"b": [2], "a": 1}'), F.col("outputs"), F.col("said")).alias("reward"))


@query("X24_canonical_hashes", "SELECT base_id, sha256(query) AS digest, true AS ordered FROM base_dataset WHERE query IS NOT NULL AND NOT json_valid(query)")
def x24(s: SparkSession, d: str) -> DataFrame:
    """Hashes of values; of JSON text the order of keys doesn't matter."""
    b = table(s, d, "base_dataset").filter("query is not null")
    b = b.filter(F.try_parse_json("query").isNull())
    same = dialogue.canonical_hash(F.lit('{"x": 1, "y": {"a": null, "b": 2}}')) == dialogue.canonical_hash(F.lit('{"y": {"b": 2, "a": null}, "x": 1}'))
    return b.select("base_id", dialogue.canonical_hash(F.col("query")).alias("digest"), same.alias("ordered"))


@query("M9_reports", f"""WITH {MESSAGES}, l AS (SELECT idx, pos, upper(role) || ': ' || coalesce(content, '') || coalesce(chr(10) || nullif(array_to_string(list_transform(tool_calls, lambda t: 'TOOL CALL: ' || t.function.name || ': ' || t.function.arguments), chr(10)), ''), chr(10)) AS line FROM mm WHERE role IS NOT NULL AND idx >= 10 AND idx < 20)
SELECT idx, md5(string_agg(line, chr(10) ORDER BY pos)) AS digest FROM l GROUP BY idx""")
def m9(s: SparkSession, d: str) -> DataFrame:
    """Reports of the conversations of an index range, which is the feature."""
    c = chat(s, d).withColumn("messages", dialogue.only_messages(F.col("messages"))).filter(F.size("messages") > 0)
    return prepare.conversation_report(c, "idx", 10, 20).select("idx", F.md5("report").alias("digest"))


@query("P20_chat_text", f"WITH {MESSAGES} SELECT idx, md5(string_agg('<|im_start|>' || role || chr(10) || coalesce(content, '') || '<|im_end|>' || chr(10), '' ORDER BY pos) || '<|im_start|>assistant' || chr(10)) AS digest FROM mm WHERE role IS NOT NULL GROUP BY idx")
def p20(s: SparkSession, d: str) -> DataFrame:
    c = chat(s, d).filter(F.size(dialogue.only_messages(F.col("messages"))) > 0)
    return c.select("idx", F.md5(prepare.chat_text(F.col("messages"))).alias("digest"))


@query("F12_same_tools", "WITH e AS (SELECT t.task_id, list_sort(list_distinct(list_filter(list_transform(t.actions, lambda a: a.name), lambda n: n IS NOT NULL))) AS a, list_sort(list_distinct(list_filter(list_transform(q.stepwise, lambda x: x.tool), lambda n: n IS NOT NULL))) AS b FROM tasks t JOIN base_dataset b ON b.base_id = t.base_id JOIN questions q ON q.question_id = b.question_id WHERE t.actions IS NOT NULL AND q.stepwise IS NOT NULL) SELECT task_id, a = b AS same FROM e")
def f12(s: SparkSession, d: str) -> DataFrame:
    """Whether a task and its question name exactly the same tools."""
    names = lambda c, field: F.filter(F.transform(c, lambda x: x[field]), lambda n: n.isNotNull())
    t = table(s, d, "tasks").filter("actions is not null").select("task_id", "base_id", names("actions", "name").alias("a"))
    q = table(s, d, "questions").filter("stepwise is not null").select("question_id", names("stepwise", "tool").alias("b"))
    joined = t.join(table(s, d, "base_dataset").select("base_id", "question_id"), "base_id").join(q, "question_id")
    return joined.select("task_id", prepare.same_variables(F.col("a"), F.col("b")).alias("same"))


@query("J9_zipped", "SELECT task_id, CASE WHEN len(actions) = len(outputs) THEN array_to_string(list_transform(list_zip(actions, outputs), lambda z: coalesce(z[1].name, '-') || '=' || coalesce(z[2], '-')), ';') END AS pairs FROM tasks WHERE len(actions) > 0 AND outputs IS NOT NULL")
def j9(s: SparkSession, d: str) -> DataFrame:
    """Actions with outputs by position, null where their numbers differ."""
    t = table(s, d, "tasks").filter("size(actions) > 0 and outputs is not null")
    z = F.transform(prepare.zipped(a=F.col("actions"), o=F.col("outputs")), lambda x: F.concat(F.coalesce(x["a"]["name"], F.lit("-")), F.lit("="), F.coalesce(x["o"], F.lit("-"))))
    return t.select("task_id", F.array_join(z, ";").alias("pairs"))


@query("J10_turn_statistics", f"WITH {MESSAGES} SELECT idx, string_agg(CAST(coalesce(length(content), 0) AS VARCHAR), ',' ORDER BY pos) AS stats FROM mm WHERE role = 'assistant' GROUP BY idx")
def j10(s: SparkSession, d: str) -> DataFrame:
    m = validate.messages(chat(s, d)).filter("role = 'assistant'").select("idx", "pos", F.coalesce(F.length("content"), F.lit(0)).alias("n"))
    return prepare.per_conversation(m, "idx", "pos", "n").select("idx", F.array_join(F.transform("stats", lambda x: x.cast("string")), ",").alias("stats"))


@query("S10_first_queries", "SELECT base_id, query FROM base_dataset WHERE trim(coalesce(query, ''), ' ') <> '' ORDER BY base_id LIMIT 10")
def s10(s: SparkSession, d: str) -> DataFrame:
    """The first ten are the feature."""
    return io.first_queries(table(s, d, "base_dataset"), "query", "base_id")
