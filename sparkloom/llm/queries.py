"""The queries of this subpackage, and their SQL where SQL can express them on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import bpe, defects, mixture, overlap, quota, residue, truncation
from sparkloom.session import table

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    """Every query over its whole tables."""
    return {
        "p1_found": lambda s, d: overlap.found(table(s, d, "questions")),
        "p1_report": lambda s, d: overlap.report(table(s, d, "questions")),
        "p2_found": lambda s, d: defects.found(table(s, d, "questions"), table(s, d, "conversations_chat"), table(s, d, "tasks")),
        "p2_report": lambda s, d: defects.report(table(s, d, "questions"), table(s, d, "conversations_chat"), table(s, d, "tasks")),
        "p3_found": lambda s, d: quota.shortfalls(table(s, d, "questions"), table(s, d, "sample_targets")),
        "p3_sample": lambda s, d: quota.draw_sample(table(s, d, "questions"), table(s, d, "sample_targets")),
        "p3_report": lambda s, d: quota.QuotaPlan(table(s, d, "questions"), table(s, d, "sample_targets")).report(),
        "p3_below_need": lambda s, d: quota.below_need(table(s, d, "questions"), table(s, d, "sample_targets")),
        "p5_found": lambda s, d: truncation.found(table(s, d, "conversations_chat"), table(s, d, "tasks")),
        "p5_report": lambda s, d: truncation.report(table(s, d, "conversations_chat"), table(s, d, "tasks")),
        "p6_ids": lambda s, d: bpe.encode_corpus(table(s, d, "documents")),
        "p7_mix": lambda s, d: mixture.Mixture(table(s, d, "documents"), table(s, d, "mix_targets")).rows(),
        "p7_shares": lambda s, d: mixture.Mixture(table(s, d, "documents"), table(s, d, "mix_targets")).shares(),
        "p8_found": lambda s, d: residue.found(table(s, d, "documents")),
        "p8_report": lambda s, d: residue.report(table(s, d, "documents")),
        "p8_kept": lambda s, d: residue.exclude(table(s, d, "documents")).select("doc_id"),
    }


_P3_NEED = """
WITH q AS (
  SELECT CASE lower(trim(difficulty)) WHEN 'easy (1 tool call)' THEN 'ONE_TOOL_CALL' WHEN 'medium (2 tool calls)' THEN 'TWO_TOOL_CALLS'
              WHEN 'hard (3 tool calls)' THEN 'THREE_TOOL_CALLS' ELSE trim(difficulty) END AS difficulty,
         problem_type, CAST(tool_calls_required AS VARCHAR) AS tool_calls_required
  FROM questions
), n AS (
  SELECT 'difficulty' AS attribute, difficulty AS category, count(*) AS available FROM q GROUP BY difficulty
  UNION ALL SELECT 'problem_type', problem_type, count(*) FROM q GROUP BY problem_type
  UNION ALL SELECT 'tool_calls_required', tool_calls_required, count(*) FROM q GROUP BY tool_calls_required
)
SELECT t.plan_id, t.attribute, t.category
FROM sample_targets t LEFT JOIN n ON n.attribute = t.attribute AND n.category = t.category
WHERE greatest(t.min_rows, CAST(ceil(CAST(t.share_permille AS DECIMAL(38, 3)) * t.sample_rows / 1000) AS BIGINT)) > coalesce(n.available, 0)
"""


def oracle_sql() -> dict[str, str]:
    return {"p3_found": _P3_NEED}
