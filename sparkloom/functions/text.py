"""Tags, JSON and formatting of messages as column expressions.

White space is Unicode white space, as everywhere in the library: ``(?U)`` patterns.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TAGS = ("think", "tool_call", "answer")
HINT = "[diag]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def is_blank(c: Column) -> Column:
    return F.coalesce(strip(c) == "", F.lit(True))


def tag_contents(c: Column, tag: str) -> Column:
    """Contents of all closed blocks of a tag, stripped."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(rf"(?Us)<{tag}>\s*(.*?)\s*</{tag}>"), F.lit(1))


def last_content(c: Column, tag: str) -> Column:
    """Content of the last closed block, or null."""
    return F.try_element_at(tag_contents(c, tag), F.lit(-1))


def _format(c: Column, tag: str) -> Column:
    """From the last thought on: the thought, then exactly a block of the tag up to the end."""
    tail = F.substring_index(c, "<think>", -1)
    closed = F.instr(tail, "</think>")
    after = F.substr(tail, closed + 8)
    return F.coalesce((F.instr(c, "<think>") > 0) & (closed > 0) & after.rlike(rf"(?Us)^\s*<{tag}>.*</{tag}>\n?\z"), F.lit(False))


def thinks_then_answers(c: Column) -> Column:
    """X3."""
    return _format(c, "answer")


def thinks_then_calls(c: Column) -> Column:
    """X3."""
    return _format(c, "tool_call")


def with_think_prefix(c: Column) -> Column:
    """X4."""
    return F.when(c.rlike(r"(?U)^\s*<think>"), c).otherwise(F.concat(F.lit("<think>"), c))


def outside_tags(c: Column) -> Column:
    """Whether anything but white space stands outside closed blocks."""
    for tag in TAGS:
        c = F.regexp_replace(c, rf"(?s)<{tag}>.*?</{tag}>", "")
    return ~is_blank(c)


def is_unclosed(c: Column, tag: str) -> Column:
    """No closing tag after the last opening one."""
    return F.coalesce((F.instr(c, f"<{tag}>") > 0) & (F.instr(F.substring_index(c, f"<{tag}>", -1), f"</{tag}>") == 0), F.lit(False))


def is_unopened(c: Column, tag: str) -> Column:
    """A closing tag before any opening one."""
    return F.coalesce((F.instr(c, f"</{tag}>") > 0) & (F.instr(F.substring_index(c, f"</{tag}>", 1), f"<{tag}>") == 0), F.lit(False))


def fenced_call(c: Column) -> Column:
    """A code fence in the last tool call."""
    return F.coalesce(F.instr(last_content(c, "tool_call"), "```") > 0, F.lit(False))


def json_object(c: Column) -> Column:
    """The text if it is a JSON object, else null."""
    v = F.try_parse_json(c)
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), c)


def arguments(c: Column) -> Column:
    """A tool's arguments as the text of a JSON object, perhaps encoded twice; {} where there is none."""
    inner = F.try_variant_get(F.try_parse_json(c), "$", "string")
    return F.coalesce(json_object(c), json_object(inner), F.lit("{}"))


def call(block: Column) -> Column:
    """Struct of json_valid, name and arguments of a tool-call block."""
    v = F.try_parse_json(block)
    name, args = F.try_variant_get(v, "$.name", "string"), F.try_variant_get(v, "$.arguments", "variant")
    kind = F.schema_of_variant(args)
    text = F.try_variant_get(v, "$.arguments", "string")
    is_name = F.schema_of_variant(F.try_variant_get(v, "$.name", "variant")) == "STRING"
    as_text = (kind == "STRING") & F.try_parse_json(text).isNotNull()
    valid = F.coalesce(json_object(block).isNotNull() & is_name & (kind.startswith("OBJECT") | as_text), F.lit(False))
    is_object = F.coalesce(kind.startswith("OBJECT") | json_object(text).isNotNull(), F.lit(False))
    return F.struct(valid.alias("json_valid"), F.when(valid, name).alias("name"), (valid & is_object).alias("arguments_valid"))


def analysis(c: Column, tools: tuple[str, ...]) -> Column:
    """Everything known of one assistant message."""
    found = call(last_content(c, "tool_call"))
    return F.struct(
        last_content(c, "think").alias("thought"), last_content(c, "answer").alias("answer"), last_content(c, "tool_call").alias("tool_block"),
        *[F.size(tag_contents(c, t)).alias(f"{t}_count") for t in TAGS],
        *[is_unclosed(c, t).alias(f"{t}_unclosed") for t in TAGS], *[is_unopened(c, t).alias(f"{t}_unopened") for t in TAGS],
        (thinks_then_answers(c) | thinks_then_calls(c)).alias("valid"), thinks_then_answers(c).alias("valid_answer"), outside_tags(c).alias("outside"),
        found.alias("call"), F.coalesce(found["name"].isin(*tools), F.lit(False)).alias("name_known"),
    )


#: Reasons of unusable messages, in the order of the contract; the last stands for none of the others.
REASONS = (
    "multiple <think> blocks (nested/repeated)",
    "multiple <tool_call> blocks (nested/repeated)",
    "multiple <answer> blocks (nested/repeated)",
    "no <think>/<tool_call>/<answer> blocks",
    "both tool call and answer present",
    "no tool call or answer",
    "missing <think>",
    "invalid tool JSON",
    "invalid tool arguments",
    "unknown tool name",
    "content outside allowed tags",
    "invalid format",
    "answer without tool response",
    "unspecified issue",
)


def failure_reason(a: Column, policy_ok: Column) -> Column:
    """X11: the first reason that applies to an analysis()."""
    n = {t: a[f"{t}_count"] for t in TAGS}
    called, answered = n["tool_call"] > 0, n["answer"] > 0
    tests = [n[t] > 1 for t in TAGS]
    tests += [n["think"] + n["tool_call"] + n["answer"] == 0, called & answered, ~called & ~answered, n["think"] == 0]
    tests += [called & ~ok for ok in (a["call"]["json_valid"], a["call"]["arguments_valid"], a["name_known"])]
    tests += [a["outside"], ~a["valid"], answered & ~policy_ok]
    return F.coalesce(*[F.when(test, reason) for test, reason in zip(tests, REASONS)], F.lit(REASONS[-1]))


def spaced_think(c: Column) -> Column:
    """One line break after <think> and before </think>."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)<think>\s*", "<think>\n"), r"(?U)\s*</think>", "\n</think>")


def hidden_thoughts(c: Column, placeholder: str) -> Column:
    """X19."""
    return F.regexp_replace(c, r"(?s)<think>.*?</think>", placeholder.replace("\\", "\\\\").replace("$", "\\$"))


def replaced_content(c: Column, tag: str, text: Column) -> Column:
    """The content of each block of a tag replaced by literal text."""
    safe = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
    return F.regexp_replace(c, F.lit(rf"(?s)<{tag}>.*?</{tag}>"), F.concat(F.lit(f"<{tag}>"), safe, F.lit(f"</{tag}>")))


def partial_content(c: Column, tag: str) -> Column:
    """What follows the last opening tag, up to a closing one if there is any."""
    return F.when(F.instr(c, f"<{tag}>") > 0, F.substring_index(F.substring_index(c, f"<{tag}>", -1), f"</{tag}>", 1))


def hint_text(reason: Column) -> Column:
    """X12."""
    return F.concat(F.lit(f"{HINT} "), reason)


def label(c: Column, most: int = 96) -> Column:
    """One line of at most ``most`` characters."""
    one = strip(F.regexp_replace(c, r"(?U)\s+", " "))
    return F.when(F.length(one) > most, F.concat(F.substring(one, 1, most - 3), F.lit("..."))).otherwise(one)


def repository_name(c: Column) -> Column:
    """P25: other characters to dashes, dashes collapsed, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9._-]+", "-"), r"-{2,}", "-"), r"^[-.]+|[-.]+$", "")


def escaped(c: Column) -> Column:
    """K5: HTML-escaped text."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def normalized(c: Column) -> Column:
    """NFKC with plain minus signs; the UDF gets only texts that aren't ASCII, as others stay as they are."""

    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s).replace("−", "-"))

    plain = c.rlike(r"^[\x00-\x7f]*\z")
    return F.when(plain, c).otherwise(F.pandas_udf(run, T.StringType())(F.when(~plain, c)))


def coprime_density(c: Column, most: int = 50) -> Column:
    """The share of numbers coprime to a small positive number."""
    divides = lambda p: c % p == 0
    primes = [p for p in range(2, most) if all(p % q for q in range(2, p))]
    out = F.lit(1.0)
    for p in primes:
        out = out * F.when(divides(p), 1 - 1 / p).otherwise(1.0)
    return out
