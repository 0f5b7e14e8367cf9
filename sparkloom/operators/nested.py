"""Flattening of nested step lists into related tables by Arrow list-offset kernels.

A batch of nested records is turned into child arrays straight from the list offsets: parent
indices are repeated by list length, children are gathered by vectorised take, and links are
resolved with sorted searches. No record is visited one by one.

Defined cases: null or empty lists, and unreadable JSON, give no rows; a null element keeps its
place but is no step; an element without any key is no step; repeated dependencies count once; a
dependency on a place that holds no step does not exist; a step without existing dependencies has
the parent -1. Extra columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEPS = "src string, record_id bigint, step_pos int, tool string, step_id string, result string, inputs map<string,string>, generator_type string, input string"
LINKS = "src string, record_id bigint, step_pos int, tool string, parent_pos int"


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start..start+length-1 of every range, in order."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def children(arr: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parent index, place within the parent, and index into the values of each child of a list or map array."""
    offsets = arr.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    lengths = np.diff(offsets)
    if arr.null_count:
        lengths = np.where(arr.is_valid().to_numpy(zero_copy_only=False), lengths, 0)
    parent = np.repeat(np.arange(len(arr)), lengths)
    at = ranges(offsets[:-1], lengths)
    first = np.cumsum(lengths) - lengths
    return parent, np.arange(len(at)) - first[parent] if len(at) else at, at


def values_of(arr: pa.Array) -> pa.Array:
    """The child values of a list or map array, not cut to its offsets."""
    return arr.items if isinstance(arr, pa.MapArray) else arr.values


def link(rec, pos, tool, dep_rec, dep_to, dep_from, has_rec, has_pos):
    """Each step joined with its distinct existing dependencies; (record index, place, tool index, parent)."""
    width = np.int64(1) << 31
    ok = (dep_to >= 0) & (dep_from >= 0) & (dep_to < width) & (dep_from < width)
    dep_rec, dep_to, dep_from = dep_rec[ok], dep_to[ok], dep_from[ok]
    there = np.unique(has_rec * width + has_pos)

    def exists(r: np.ndarray, p: np.ndarray) -> np.ndarray:
        key = r * width + p
        at = np.searchsorted(there, key)
        return (at < len(there)) & (there[np.minimum(at, max(len(there) - 1, 0))] == key) if len(there) else np.zeros(len(key), bool)

    ok = exists(dep_rec, dep_from) & exists(dep_rec, dep_to)
    to, frm = (dep_rec * width + dep_to)[ok], dep_from[ok]
    if len(to):
        order = np.lexsort((frm, to))
        to, frm = to[order], frm[order]
        new = np.r_[True, (to[1:] != to[:-1]) | (frm[1:] != frm[:-1])]
        to, frm = to[new], frm[new]
    key = rec * width + pos
    left, right = np.searchsorted(to, key, "left"), np.searchsorted(to, key, "right")
    n = right - left
    rows = np.repeat(np.arange(len(rec)), np.maximum(n, 1))
    parent = np.full(len(rows), -1, np.int64)
    at = ranges(left, n)
    parent[np.repeat(n, np.maximum(n, 1)) > 0] = frm[at]
    return rec[rows], pos[rows], tool[rows], parent


def emit(src: str, ids: pa.Array, tools: pa.Array, rec, pos, tool, parent) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(rec), src, object), pa.string()), ids.take(pa.array(rec)), pa.array(pos.astype(np.int32)), tools.take(pa.array(tool)), pa.array(parent.astype(np.int32))],
        names=["src", "record_id", "step_pos", "tool", "parent_pos"],
    )


def native_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kernel over native nested steps: columns record_id, steps array<struct<tool, deps array<int>>>."""
    for b in batches:
        ids, steps = b.column(0), b.column(1)
        rec, pos, at = children(steps)
        values = values_of(steps).take(pa.array(at))
        held = values.is_valid().to_numpy(zero_copy_only=False)
        tools, deps = pc.struct_field(values, [0]), pc.struct_field(values, [1])
        step, _, dat = children(deps)
        child = values_of(deps).take(pa.array(dat))
        known = child.is_valid().to_numpy(zero_copy_only=False)
        frm = pc.fill_null(child, -1).to_numpy(zero_copy_only=False).astype(np.int64)[known]
        step = step[known]
        index = np.flatnonzero(held)
        yield emit("questions", ids, tools, *link(rec[index], pos[index], index, rec[step], pos[step], frm, rec[index], pos[index]))


def parsed_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kernel over parsed exports: columns record_id, elements array<array<tool>>, edges array<struct<from,to>>."""
    for b in batches:
        ids, elements, edges = b.column(0), b.column(1), b.column(2)
        rec, pos, at = children(elements)
        inner = values_of(elements).take(pa.array(at))
        el, _, tat = children(inner)
        tools = values_of(inner).take(pa.array(tat))
        erec, _, eat = children(edges)
        pairs = values_of(edges).take(pa.array(eat))
        ends = [pc.fill_null(pc.struct_field(pairs, [i]), -1).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1)]
        yield emit("base_dataset", ids, tools, *link(rec[el], pos[el], np.arange(len(el)), erec, ends[1], ends[0], rec[el], pos[el]))


def _json_list(text: Column, options: dict) -> Column:
    """The elements' JSON texts of a list that is perhaps encoded twice; a bare object is a list of one."""
    one = lambda c: F.from_json(F.concat(F.lit("["), c, F.lit("]")), "array<string>", options)
    peel = lambda c: F.when(F.size(one(c)) == 1, F.element_at(one(c), 1))
    whole = F.when(F.ltrim(text).startswith('"'), peel(peel(text))).otherwise(peel(text))  # null unless the text is one value
    return F.when(F.ltrim(whole).startswith("{"), F.array(whole)).when(F.ltrim(whole).startswith("["), F.from_json(whole, "array<string>", options))


def question_links(questions: DataFrame) -> DataFrame:
    """Steps of ``questions.stepwise`` with the places they depend on."""
    steps = F.transform("stepwise", lambda s: F.when(s.isNotNull(), F.struct(s["tool"].alias("tool"), F.map_values(s["verification"]["dependent_on"]).alias("deps"))))
    return questions.select(F.col("question_id").cast("bigint").alias("record_id"), steps.alias("steps")).mapInArrow(native_links, LINKS)


STRICT = {"allowSingleQuotes": "false", "allowUnquotedFieldNames": "false"}


def export_elements(read) -> Column:
    """``read`` of each element of ``stepwise_ground_truths``, given as a map of its fields' texts."""
    return F.transform(_json_list(F.col("stepwise_ground_truths"), STRICT), lambda e: F.transform(F.array(F.from_json(e, "map<string,string>", STRICT)), read)[0])


def export_tools() -> Column:
    """The tools that each element of ``stepwise_ground_truths`` names."""
    return export_elements(lambda m: F.when(F.array_contains(F.map_keys(m), "tool"), F.array(F.element_at(m, "tool"))).otherwise(F.array_distinct(F.map_keys(m))))


def export_edges() -> Column:
    """``dependency_edges`` as structs of two places."""
    edges = F.from_json("dependency_edges", "array<array<string>>", STRICT)
    return F.transform(F.filter(edges, lambda e: F.size(e) == 2), lambda e: F.struct(e[0].try_cast("bigint").alias("src"), e[1].try_cast("bigint").alias("dst")))


def export_links(base: DataFrame) -> DataFrame:
    """Steps of ``base_dataset.stepwise_ground_truths`` with the places their edges name."""
    return base.select(F.col("base_id").cast("bigint").alias("record_id"), export_tools().alias("elements"), export_edges().alias("edges")).mapInArrow(parsed_links, LINKS)


def flatten_links(questions: DataFrame, base: DataFrame) -> DataFrame:
    """Both sources as one link table: one row for each step and each distinct step it depends on."""
    return question_links(questions).unionByName(export_links(base))


def record_table(links: DataFrame) -> DataFrame:
    """Parent table: a row per record with its number of steps and links."""
    return links.groupBy("src", "record_id").agg(
        F.count_distinct("step_pos", "tool").alias("n_steps"), F.sum((F.col("parent_pos") >= 0).cast("bigint")).alias("n_links")
    )


def native_steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kernel over native nested steps: columns record_id, steps array<struct of the fields of a step>."""
    for b in batches:
        ids, steps = b.column(0), b.column(1)
        rec, pos, at = children(steps)
        values = values_of(steps).take(pa.array(at))
        held = np.flatnonzero(values.is_valid().to_numpy(zero_copy_only=False))
        fields = [pc.struct_field(values, [i]).take(pa.array(held)) for i in range(6)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(held), "questions", object), pa.string()), ids.take(pa.array(rec[held])), pa.array(pos[held].astype(np.int32)), *fields],
            names=["src", "record_id", "step_pos", "tool", "step_id", "result", "inputs", "generator_type", "input"],
        )


def question_steps(questions: DataFrame) -> DataFrame:
    """The steps of ``questions.stepwise`` with their optional fields."""
    v = lambda s, name: s["verification"][name].alias(name)
    steps = F.transform("stepwise", lambda s: F.when(s.isNotNull(), F.struct(s["tool"].alias("tool"), s["step_id"].alias("step_id"), s["result"].alias("result"), v(s, "inputs"), v(s, "generator_type"), v(s, "input"))))
    return questions.select(F.col("question_id").cast("bigint").alias("record_id"), steps.alias("steps")).mapInArrow(native_steps, STEPS)


def export_steps(base: DataFrame) -> DataFrame:
    """The steps of ``base_dataset.stepwise_ground_truths``; an element that names no tool holds results by tool."""

    def read(m: Column) -> Column:
        field = lambda name: F.try_element_at(m, F.lit(name))
        named = F.array(F.struct(field("tool").alias("tool"), field("step_id").alias("step_id"), field("result").alias("result")))
        by_tool = F.transform(F.array_distinct(F.map_keys(m)), lambda k: F.struct(k.alias("tool"), F.lit(None).cast("string").alias("step_id"), F.try_element_at(m, k).alias("result")))
        return F.when(F.array_contains(F.map_keys(m), "tool"), named).otherwise(by_tool)

    rows = base.select(F.col("base_id").cast("bigint").alias("record_id"), F.posexplode(export_elements(read)).alias("step_pos", "steps")).select("record_id", "step_pos", F.explode("steps").alias("s"))
    none = lambda name, kind="string": F.lit(None).cast(kind).alias(name)
    return rows.select(F.lit("base_dataset").alias("src"), "record_id", "step_pos", "s.tool", "s.step_id", "s.result", none("inputs", "map<string,string>"), none("generator_type"), none("input"))


def flatten_steps(questions: DataFrame, base: DataFrame) -> DataFrame:
    """Both sources as one step table: one row for each step, also for one without a tool."""
    return question_steps(questions).unionByName(export_steps(base))


def all_records(questions: DataFrame, base: DataFrame) -> DataFrame:
    """Parent table with a row for each input row, also for one without any step: its numbers of steps and links, and its final answer."""
    total = lambda sizes: F.coalesce(F.aggregate(sizes, F.lit(0).cast("bigint"), lambda n, x: n + F.coalesce(x.cast("bigint"), F.lit(0).cast("bigint"))), F.lit(0).cast("bigint"))
    there = lambda of, at: (at >= 0) & (at < F.size(of))
    steps = F.col("stepwise")
    parents = lambda s: F.filter(F.array_distinct(F.filter(F.map_values(s["verification"]["dependent_on"]), lambda v: there(steps, v))), lambda v: F.get(steps, v).isNotNull())
    q = questions.select(
        F.lit("questions").alias("src"), F.col("question_id").cast("bigint").alias("record_id"), total(F.transform(steps, lambda s: s.isNotNull().cast("int"))).alias("n_steps"),
        total(F.transform(steps, lambda s: F.when(s.isNotNull(), F.size(parents(s))))).alias("n_links"), F.col("golden.final_answer").alias("final_answer"), F.col("golden.from_step_id").alias("from_step_id"),
    )
    els = F.col("elements")
    n_tools = lambda at: F.coalesce(F.size(F.get(els, at.cast("int"))), F.lit(0))
    inside = F.array_distinct(F.filter("edges", lambda e: there(els, e["src"]) & there(els, e["dst"])))
    parsed = base.select(F.col("base_id").cast("bigint").alias("record_id"), "ground_truth", export_tools().alias("elements"), export_edges().alias("edges"))
    b = parsed.select(
        F.lit("base_dataset").alias("src"), "record_id", total(F.transform(els, lambda e: F.size(e))).alias("n_steps"),
        total(F.transform(inside, lambda e: F.when(n_tools(e["src"]) > 0, n_tools(e["dst"])))).alias("n_links"), F.col("ground_truth").alias("final_answer"), F.lit(None).cast("string").alias("from_step_id"),
    )
    return q.unionByName(b)
