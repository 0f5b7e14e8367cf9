"""Texts that were cut in storage or transfer, found by structure and by prefixes of longer copies.

A text is parsed by a pushdown automaton; one that ends within a tag, a bracket or a fence is cut. Else, if its
last sentence has no closing mark, that fragment is looked up among all sentences of the corpus,
with numbers, matrices and one-letter names masked: distinct strings are range-partitioned and
sorted, where the longer copies of a fragment follow it directly, so one scan
tells how often each fragment is a strict prefix of longer copies elsewhere. A fragment that is
itself a usual ending (it ends more texts than continue it) isn't cut. Formal texts must
also end like their copies do: a sentence that most formal texts close was cut before its mark where it
is open. Equal texts count once, so a hot text that is cut again and again doesn't outvote its whole copies.
Values are compared with the true values that the same row states.

Sorting distinct strings keeps hot texts (one system prompt in a third of the rows) from a single
task: they collapse before the shuffle.

Defined cases: null, empty and blank texts are not cut; short and informal texts without closing
mark are not cut; repeated rows are judged alike; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import structure as S
from sparkloom.session import cut_lineage, partitions_for

#: A text of fewer characters without closing mark counts as informal.
SHORT = 12
#: How a text holds a sentence, as bits: closed and open ones of formal texts, and of informal ones.
CLOSED, OPEN, INFORMAL_CLOSED, INFORMAL_OPEN = 1, 2, 4, 8


def stated_values(text: str | None) -> list[str]:
    """Texts of the values that a row's JSON truths state."""
    out: list[str] = []

    def walk(x) -> None:
        if isinstance(x, dict):
            for v in x.values():
                walk(v)
        elif isinstance(x, list) and not (x and isinstance(x[0], list) and not any(isinstance(y, dict) for y in x)) and any(isinstance(y, dict) for y in x):
            for v in x:
                walk(v)
        elif x is not None:
            out.append(x if isinstance(x, str) else json.dumps(x))

    try:
        walk(json.loads(text or "null"))
    except (ValueError, RecursionError):
        if text:
            out.append(text)
    return out


def number_or_none(text: str) -> float | None:
    try:
        return float(text)
    except ValueError:
        return None


def cut_value(text: str, truths: list[str]) -> bool:
    """Whether a bare value was cut: open brackets, or less than the start of a true value."""
    squeezed = text.replace(" ", "")
    if "[" in S.unclosed(text) or re.fullmatch(r"-?\d+\.", squeezed):
        return True
    value, values = number_or_none(squeezed), [t.replace(" ", "") for t in truths]
    if len(squeezed) < 3 or not re.search(r"\d", squeezed) or squeezed in values or (value is not None and value in map(number_or_none, values)):
        return False
    return any(t.startswith(squeezed) for t in values)


def squashed(text: str) -> str:
    return re.sub(r"[\W_]+", "", text).lower()


def ends_like(text: str, prompts: list[str]) -> bool:
    """Whether a text stops where a prompt it gives back stops."""
    t = squashed(text)
    return any(t.endswith(u) or (len(t) > SHORT and u.endswith(t)) for u in (squashed(S.plain(p)) for p in prompts if p) if len(u) > SHORT)


def judge(text: str | None, formal: bool, truths: list[str], prompts: list[str] = []) -> tuple[str, list[str], list[tuple[str, bool]]]:
    """cut, whole, or open (trail: before dots) with the fragments to look up; and the masked sentences for the corpus."""
    if not text:
        return "whole", [], []
    if S.SCALAR.fullmatch(text):
        return ("cut" if truths and cut_value(text.strip(), truths) else "whole"), [], []
    if S.WHOLE_MATRIX.fullmatch(text) and S.is_bare(text):
        return "whole", [], []
    if not (t := S.plain(text)):
        return "whole", [], []
    if t.endswith("�"):
        t = t.rstrip("�") + " �"
    parts = S.sentences(t)
    known = [k for k in (S.known_sentence(s) for s, _ in parts) if k]
    if S.broken_tag(t.rstrip("… ")) or any(x in S.TAGS or x in "```[{" for x in S.unclosed(t)) or t.endswith("�"):
        return "cut", [], known[:-1]
    if S.is_bare(t):
        return ("cut" if cut_value(t, truths) else "whole"), [], known
    if t.endswith(">") or not parts:
        return "whole", [], known
    last, closed = parts[-1]
    trailed = last.endswith("…")
    if (closed and not trailed) or (not formal and (t.endswith("]") or len(t) < SHORT)):
        return "whole", [], known
    if S.dangling_list(t) or "(" in S.unclosed(last):
        return "cut", [], known[:-1]
    if S.is_bare(last):
        return ("cut" if formal and len(parts) > 1 else "whole"), [], known
    if formal and prompts and ends_like(t, prompts):
        return "whole", [], known
    bare = last.rstrip("… ")
    return "trail" if trailed else "open", list(dict.fromkeys((S.mask(bare), S.mask(bare, last=False)))), known


ROWS = "kind string, key string, pos int, state string, frag string, text_id bigint, held int, formal boolean, text string"


def _parse(texts: DataFrame) -> DataFrame:
    """Judged texts (kind t) and the corpus' masked sentences with the texts that hold them (kind s)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            held: dict[tuple[str, int], int] = {}
            for key, pos, text, formal, truths, asked, prompts in S.rows(b):
                state, frags, known = judge(text, formal, stated_values(truths) if truths and text and S.is_bare(text) else [], prompts or [])
                if known:
                    text_id = xxhash.xxh3_64_intdigest(text) - (1 << 63)
                    for s, c in known:
                        held[s, text_id] = held.get((s, text_id), 0) | ((CLOSED if c else OPEN) if formal else (INFORMAL_CLOSED if c else INFORMAL_OPEN))
                if asked:
                    kept = text if formal and prompts and frags else None  # further prompts may come
                    out += [("t", key, pos, state, f, None, None, formal, kept if i == 0 else None) for i, f in enumerate(frags or [None])]
            out += [("s", None, None, None, s, text_id, how, None, None) for (s, text_id), how in held.items()]
            kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 9, kinds)], names=["kind", "key", "pos", "state", "frag", "text_id", "held", "formal", "text"])

    return texts.select("key", "pos", "text", "formal", "truths", "asked", "prompts").mapInArrow(run, ROWS)


def sentence_counts(rows: DataFrame) -> DataFrame:
    """frag, and of how many distinct texts it is a closed or open sentence: n_closed, n_open; of formal ones: n_formal_closed, n_formal_open."""
    held = rows.filter("kind = 's'").groupBy("frag", "text_id").agg(F.bit_or("held").alias("held"))
    n = lambda bits, name: F.count(F.when(F.col("held").bitwiseAND(F.lit(bits)) != 0, 1)).alias(name)
    return held.groupBy("frag").agg(n(CLOSED | INFORMAL_CLOSED, "n_closed"), n(OPEN | INFORMAL_OPEN, "n_open"), n(CLOSED, "n_formal_closed"), n(OPEN, "n_formal_open"))


def longer_copies(strings: DataFrame) -> DataFrame:
    """frag, n_longer of every string that is a strict prefix of others: how often those occur together.

    ``strings`` has frag (distinct) and n. All strings that begin with a string follow it in the
    order, so a stack of open prefixes counts them in one scan of each sorted partition. Strings
    still open at a partition's end may be continued in later partitions, at whose start the longer
    ones must stand: those whose first string goes on an open one are told the lengths and hashes of
    the open strings, a few for each partition and never the strings, and count what begins with them.
    """
    parts = partitions_for(strings.sparkSession)
    ordered = cut_lineage(strings.select("frag", "n").repartitionByRange(parts, "frag").sortWithinPartitions("frag").withColumn("part", F.spark_partition_id()))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[list] = []  # string, n, n of longer ones
        part, begun = None, False
        names, kinds = ["frag", "n_longer", "part", "hash", "role"], (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string())

        def closed(out: list[tuple], is_open: bool) -> None:
            s, n, longer = stack.pop()
            if stack:
                stack[-1][2] += n + longer
            if longer or is_open:
                out.append((s, longer, part, prefix_hash(s) if is_open else None, "open" if is_open else "closed"))

        def batch(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 5, kinds)], names=names)

        for b in batches:
            out: list[tuple] = []
            for s, n, part in S.rows(b):
                if not begun:
                    out.append((s, None, part, None, "first"))
                    begun = True
                while stack and not s.startswith(stack[-1][0]):
                    closed(out, False)
                stack.append([s, n, 0])
            yield batch(out)
        if stack:
            out = []
            while stack:
                closed(out, True)
            yield batch(out)

    seen = cut_lineage(ordered.mapInArrow(scan, "frag string, n_longer bigint, part int, hash bigint, role string"))
    edges = [tuple(r) for r in seen.filter("role = 'open'").select("part", F.length("frag"), "hash").collect()]

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            into = [part for s, part in S.rows(b) if any(p < part and length <= len(s) and prefix_hash(s[:length]) == h for p, length, h in edges)]
            yield pa.RecordBatch.from_arrays([pa.array(into, pa.int32())], names=["part"])

    entered = [r["part"] for r in seen.filter("role = 'first'").select("frag", "part").mapInArrow(met, "part int").collect()]  # most often none
    closed_ones = seen.filter("role = 'closed'").select("frag", "n_longer")
    if not entered:
        return closed_ones.unionByName(seen.filter("role = 'open' and n_longer > 0").select("frag", "n_longer"))

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list[list] | None = None  # prefix, hash, n of what begins with it
        done: list[tuple] = []
        for b in batches:
            for s, n, part in S.rows(b) if open_ or open_ is None else ():
                if open_ is None:
                    open_ = [[s[:length], h, 0] for p, length, h in edges if p < part and length <= len(s) and prefix_hash(s[:length]) == h]
                for e in open_:
                    if s.startswith(e[0]):
                        e[2] += n
                done += [(e[1], e[2]) for e in open_ if not s.startswith(e[0])]
                open_ = [e for e in open_ if s.startswith(e[0])]
                if not open_:
                    break
        done += [(h, n) for _, h, n in open_ or []]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*done) if done else [[]] * 2)], names=["hash", "n_later"])

    later = ordered.filter(F.col("part").isin(entered)).mapInArrow(follow, "hash bigint, n_later bigint").groupBy("hash").agg(F.sum("n_later").alias("n_later"))
    crossed = seen.filter("role = 'open'").join(later, "hash", "left").select("frag", (F.col("n_longer") + F.coalesce("n_later", F.lit(0))).alias("n_longer"))
    return closed_ones.unionByName(crossed.filter("n_longer > 0"))


def prefix_hash(s: str) -> int:
    return xxhash.xxh3_64_intdigest(s) - (1 << 63)


def given_back(opened: DataFrame, prompts: DataFrame) -> DataFrame:
    """key, pos of the open texts that stop where one of the ``prompts`` (key, prompt) stops, and so were written to their end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = pa.array([ends_like(S.plain(t), [p]) for t, p in zip(b.column("text").to_pylist(), b.column("prompt").to_pylist())], pa.bool_())
            yield b.select(["key", "pos"]).filter(ok)

    held = opened.filter("text is not null").select("key", "pos", "text").join(prompts.filter("prompt is not null"), "key")
    return held.select("key", "pos", "text", "prompt").mapInArrow(run, "key string, pos int")


def cut_texts(texts: DataFrame, prompts: DataFrame | None = None) -> DataFrame:
    """key, pos, cause of each asked text that was cut: by its structure, as a prefix of longer copies, or before its closing mark.

    ``texts``: key string, pos int, text string, formal boolean (prose that closes its sentences),
    truths string (JSON of true values, or null), asked boolean (else it only serves as a copy),
    prompts array<string> (texts that it may give back whole, or null). ``prompts``: key, prompt of
    further such texts, looked up for open texts only.
    """
    rows = cut_lineage(_parse(texts))
    sentences = sentence_counts(rows)
    asked = rows.filter("kind = 't' and state in ('open', 'trail')").select("key", "pos", "frag", (F.col("formal") & (F.col("state") == "open")).alias("closes"))
    frags = asked.select("frag").distinct()
    strings = sentences.select("frag", (F.col("n_closed") + F.col("n_open")).alias("n")).unionByName(frags.join(sentences, "frag", "left_anti").withColumn("n", F.lit(0).cast("bigint")))
    longer = longer_copies(strings)
    known = frags.join(sentences, "frag", "left").join(longer, "frag", "left")
    count = lambda c: F.coalesce(c, F.lit(0))
    continued = F.col("n_longer").isNotNull() & (count("n_open") <= F.col("n_longer"))
    unmarked = (count("n_formal_closed") >= 1) & (count("n_formal_closed") >= count("n_formal_open"))
    verdict = known.select("frag", continued.alias("continued"), unmarked.alias("unmarked")).filter("continued or unmarked")
    opened = asked.join(verdict, "frag").filter("continued or (unmarked and closes)").groupBy("key", "pos").agg(F.when(F.bool_or("continued"), "prefix").otherwise("mark").alias("cause"))
    if prompts is not None:
        opened = opened.join(given_back(rows.filter("kind = 't'"), prompts), ["key", "pos"], "left_anti")
    return rows.filter("kind = 't' and state = 'cut'").select("key", "pos", F.lit("structure").alias("cause")).distinct().unionByName(opened)


def has_letters(c: Column) -> Column:
    """Whether a text isn't a bare value, so that its truths needn't be sent along."""
    return c.rlike("\\p{L}")


def may_be_open(c: Column) -> Column:
    """Whether a text might end without a closing mark, so that its prompts must be sent along."""
    return ~c.rlike("[.>]\\s*\\z")


def copies(df: DataFrame, column: str) -> DataFrame:
    """Texts that only serve as copies."""
    return df.select(
        F.lit("").alias("key"), F.lit(0).alias("pos"), F.col(column).alias("text"), F.lit(False).alias("formal"), F.lit(None).cast("string").alias("truths"), F.lit(False).alias("asked"),
        F.lit(None).cast("array<string>").alias("prompts"),
    ).filter("text is not null")


def instructions(tasks: DataFrame) -> DataFrame:
    """task_id, instruction: one row a task; of a task with several instructions the first in order."""
    return tasks.filter("task_id is not null").groupBy("task_id").agg(F.min("instruction").alias("instruction"))


def message_texts(conversations: DataFrame, tasks: DataFrame | None = None) -> DataFrame:
    """The contents of all messages as texts to judge; instructions serve as further copies."""
    user = F.get(F.filter("messages", lambda x: x["role"] == "user"), F.lit(0))["content"]
    m = conversations.select(F.col("idx").cast("string").alias("key"), "stepwise_ground_truths", F.array(user).alias("prompts"), F.posexplode("messages").alias("pos", "m"))
    role, content = F.coalesce("m.role", F.lit("")), F.col("m.content")
    texts = m.select(
        "key", "pos", F.col("m.content").alias("text"), (role != "user").alias("formal"), F.when(role.isin("tool", "assistant") & ~has_letters(content), F.col("stepwise_ground_truths")).alias("truths"),
        F.lit(True).alias("asked"), F.when((role == "assistant") & may_be_open(content), F.col("prompts")).alias("prompts"),
    ).filter("text is not null")
    if tasks is not None:
        texts = texts.unionByName(copies(tasks.select("instruction"), "instruction"))
    return texts


def task_prompts(conversations: DataFrame, tasks: DataFrame) -> DataFrame:
    """key, prompt: the instruction of each conversation's task."""
    return conversations.select(F.col("idx").cast("string").alias("key"), "task_id").join(instructions(tasks), "task_id").select("key", F.col("instruction").alias("prompt"))


def cut_messages(conversations: DataFrame, tasks: DataFrame | None = None) -> DataFrame:
    """idx, msg_pos, cause of each message whose content was cut."""
    cut = cut_texts(message_texts(conversations, tasks), None if tasks is None else task_prompts(conversations, tasks))
    return cut.select(F.col("key").cast("bigint").alias("idx"), F.col("pos").alias("msg_pos"), "cause")


def found(conversations: DataFrame, tasks: DataFrame | None = None) -> DataFrame:
    """idx, msg_pos of each message whose content was cut."""
    return cut_messages(conversations, tasks).select("idx", "msg_pos")


def report(conversations: DataFrame, tasks: DataFrame | None = None) -> DataFrame:
    """Per source: messages with content, cut ones by cause, and their share."""
    cut = cut_messages(conversations, tasks)
    m = conversations.select("idx", "source", F.posexplode("messages").alias("msg_pos", "m")).filter("m.content is not null").select("idx", "source", "msg_pos")
    causes = [F.count_if(F.col("cause") == c).alias(f"n_{c}") for c in ("structure", "prefix", "mark")]
    return m.join(cut, ["idx", "msg_pos"], "left").groupBy("source").agg(
        F.count("*").alias("n_messages"), F.count("cause").alias("n_cut"), *causes, F.round(F.count("cause") / F.count("*"), 6).alias("cut_share")
    )
