"""Encoding, mixing, residue and quota samples on fixtures."""

import os
import random
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkloom.llm import bpe, mixture, quota, residue

DOCS = "doc_id bigint, text string, source string, ids string, n_tokens int, cid int, rank int"
here = os.path.exists(f"{bpe.TOKENIZERS}/byte_bpe_50k.tiktoken")
needs_vocabulary = pytest.mark.skipif(not here, reason="no vocabulary files here")
RANKS = bpe.load_ranks(f"{bpe.TOKENIZERS}/byte_bpe_50k.tiktoken") if here else {}


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", 1, 2, 3) for i, t, s in rows], DOCS)


def naive(piece: bytes) -> list[int]:
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        best = min(((RANKS[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in RANKS), default=None)
        if best is None:
            return [RANKS[p] for p in parts]
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]


@needs_vocabulary
@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text("aeinrst", min_size=1, max_size=40), st.binary(min_size=1, max_size=20)))
def test_tree_equals_naive_merging(x):
    piece = x.encode() if isinstance(x, str) else x
    assert bpe.encode_piece(piece, RANKS) == naive(piece)


@needs_vocabulary
def test_ids_equal_the_public_encoder(spark):
    import tiktoken

    texts = ["Hello  world\n\n  x", "", None, "   ", "a" * 30_000, "ünï ☃ 行列 🙂", "<|endoftext|> is text", "don't we'll", "​\x00\x07", "Hello  world\n\n  x", "=" * 5000 + "[[1, -2]]"]
    got = {r["doc_id"]: r["ids"] for r in bpe.encode_corpus(docs(spark, [(i, t, None) for i, t in enumerate(texts)])).collect()}
    own = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    assert got == {i: own.encode_ordinary(t or "") for i, t in enumerate(texts)}
    assert bpe.encode_corpus(docs(spark, [])).count() == 0


@needs_vocabulary
def test_mixture(spark):
    rng = random.Random(1)
    rows = [(i, "word " * rng.randint(1, 9), "big") for i in range(900)] + [(1000 + i, "word " * 5, "small") for i in range(20)] + [(2000, None, "big"), (2001, "", "big"), (2002, "x", None), (2003, "word " * 3000, "big")]
    targets = spark.createDataFrame([(1, "big", 500, 1, 1000), (1, "small", 500, 3, 1000), (2, "small", 400, 50, 1000), (2, "none", 600, 2, 1000), (2, "none", 600, 2, 1000)], "mix_id int, source_name string, target_permille int, max_repeats int, budget_tokens bigint")
    m = mixture.Mixture(docs(spark, rows), targets)
    got = m.rows().collect()
    assert not {r["doc_id"] for r in got} & {2000, 2001, 2002}
    shares = {(r["mix_id"], r["source"]): r for r in m.shares().collect()}
    small = shares[1, "small"]
    assert small["most_copies"] == 3 and small["n_rows"] == 60 and small["capped"] and small["missing_tokens"] > 0
    assert abs(shares[2, "small"]["tokens"] - 400) <= 12 and shares[2, "none"]["missing_tokens"] == 600
    assert len({(r["mix_id"], r["doc_id"], r["copy_no"]) for r in got}) == len(got)
    again = {(r["mix_id"], r["doc_id"], r["copy_no"]) for r in mixture.Mixture(docs(spark, rows), targets).rows().collect()}
    assert again == {(r["mix_id"], r["doc_id"], r["copy_no"]) for r in got}
    assert mixture.Mixture(docs(spark, []), targets).rows().count() == 0


@needs_vocabulary
def test_ranks_are_complete(spark):
    rows = [(i, "w " * (1 + i % 7), "abc"[i % 3]) for i in range(500)]
    ranked = mixture.ranked_documents(docs(spark, rows), "byte_bpe_50k", bpe.TOKENIZERS).collect()
    for s in "abc":
        own = sorted((r for r in ranked if r["source"] == s), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, len(own) + 1)) and [r["n_tokens"] for r in own] == sorted(r["n_tokens"] for r in own)


RESIDUE = [
    "Dear {{name}}, your sheet on [[matrix]] was graded with @@author@@.", "The answer is {answer} because {topic}.", "Lorem ipsum dolor amet magna tempor esse.", "<html><head><title>502 Bad Gateway</title></head></html>",
    "HTTP/1.1 401 Unauthorized\ncontent-length: 0", "Please enable JavaScript to view this page.", "BITTE AKTIVIEREN SIE COOKIES, UM DIE AUFGABE ANZUZEIGEN.", "This page is under construction. Check back later!", "Text goes here. Text goes here.",
    "Note that rank is kept.\n\nYour browser does not support the embedded player.", "Please enable​ cookies and reload", "TBD - summary will be added later", '{"error": {"code": 503, "message": "Service Unavailable"}}', "proof: to be written",
]
CONTENT = [
    "Write \\frac{{p}}{{q}} only when both are whole numbers.", "Jinja replaces {{ result }} by the matrix, which is why the braces are doubled.", "A template has a slot such as `{value}`, and the engine fills it.", 'In the notebook we print(f"step = {step}") to watch it.',
    "The shell script reads ${OUT_DIR} and falls back to a seed of 3.", 'def fmt(x): return "{}".format(round(x, 6))', "The set {1, 2, 4} indexes the rows, and ${a_{ij}}$ denotes an entry.", "When a cookie is missing the demo still works.", "Our demo draws its plots with JavaScript, in a headless browser.",
    "Section 4 is not found in the printed edition, but the proof is in the appendix.", "An HTTP 503 in the trace counts as a tool error.", "Please avoid filler such as lorem ipsum in exercise sheets.", "Rows marked TODO in the old sheet were solved in session 3.",
    'The tool reported "Error: Matrix must be square", as it should.', "Access to the queue was denied to guests, which the release note explains.", "<user> Call f with [[1, 2], [3, 4]].\n<tool> [[1, 2]]", "The rank is 2.", None, "", "  \n",
]


def test_residue(spark):
    rows = [(i, t, None) for i, t in enumerate(RESIDUE)] + [(100 + i, t, None) for i, t in enumerate(CONTENT)] + [(0, RESIDUE[0], None), (500, "The rank is kept. " * 20_000, None), (501, "Wort" * 300_000, None)]
    got = [r["doc_id"] for r in residue.found(docs(spark, rows)).collect()]
    assert sorted(got) == list(range(len(RESIDUE)))  # a repeated id gives one row
    kept = {r["doc_id"] for r in residue.exclude(docs(spark, rows)).collect()}
    assert kept == {100 + i for i in range(len(CONTENT))} | {500, 501}
    assert residue.found(docs(spark, [])).count() == 0
    r = residue.report(docs(spark, rows)).first()
    assert r["n_seed"] + r["n_spread"] == len(RESIDUE) + 1


def test_filler_without_common_marks(spark):
    """Runs of any words of the filler lists, not only of the frequent ones."""
    filler = ["bla bla bla bla", "test test test test", "Ut enim ad minim veniam quis nostrud exercitation ullamco laboris.", "bar qux xyzzy bar"]
    rows = [(i, t, None) for i, t in enumerate(filler)] + [(100, "A test of the bar, a test of foo, and a test.", None), (101, "In est one, ad two, et three, ex four.", None)]
    assert {r["doc_id"] for r in residue.found(docs(spark, rows)).collect()} == set(range(len(filler)))


def test_passages_within_longer_texts(spark):
    """A passage that is trusted where it stands alone is found at the start, in the middle and at the end of other texts."""
    other = ["The rank is 2.", "Note that the trace is kept", "Why does the sign change?"]
    rows = [(1, "Your browser is out of date and cannot display this notebook.", None), (2, f"{other[0]} Your browser is out of date and cannot display this notebook! {other[2]}", None)]
    rows += [(3, f"{other[1]} Your browser is out of date and cannot display this notebook", None), (4, f"- Your browser is out of date and cannot display this notebook {other[1]}", None), (5, " ".join(other), None)]
    got = {r["doc_id"]: r["by_spread"] for r in residue.labelled(docs(spark, rows)).collect()}
    assert got.keys() == {1, 2, 3, 4} and not got[1] and got[2] and got[3]


def test_parts_of_one_sentence_lead_to_no_content(spark):
    """Residue runs on from content without a mark; part by part, the sentence loses the residue, which labels its content and that of other texts."""
    residue_text = "Your Browser is out of Date and cannot display this Notebook"
    content = "Tool: [[1, -2], [-3, 4]] Compare the Norm of each Column with the Norm of each Row, then Write the Determinant Beside the Trace"
    rows = [(1, f"{residue_text}.", None), (2, f"{content} {residue_text}", None), (3, f"{content}.", None), (4, f"Why?\n{content} The Sign stays.", None), (5, f"Note that {residue_text}", None)]
    assert {r["doc_id"] for r in residue.found(docs(spark, rows)).collect()} == {1, 2, 5}


def test_open_ends_of_rules_lead_to_no_content(spark):
    """Trusted texts whose residue is followed by content without a mark or after another one than a full stop: not the content of other texts."""
    content = ["Reward is shared between the answer tag and the sign pattern at a ratio of 3 to 5", "Suppose [[1, -2, 3], [4, 5, -6]] were well-scaled; then largest entry would have to be 12", "Does every column keep its norm when rows are swapped?"]
    later = ["Reward is shared between the answer tag and the last sign pattern at a ratio of 9 to 2.", "Suppose [[1, 2, 3], [4, -5, -6]] were well-scaled; then largest entry would have to be 7."]
    rows = [(1, f"FIXME summary missing {content[0]}.", None), (2, f"Enable JS and reload {content[1]}", None), (3, f"Please wait while the viewer starts! {content[2]}", None), (4, f"fixme proof missing {content[0].lower()}", None)]
    rows += [(5, "Traceback (most recent call last):\n File \"render.py\", line 3, in render\nKeyError: 'a' " + content[0], None), (6, f"{later[0]} Fixme summary missing", None), (7, "XXX introduction XXX", None)]
    rows += [(100 + i, t, None) for i, t in enumerate([*content, *later, *(f"Lemma 3. {t}\nThe rank is 2." for t in (*content, *later)), "Introduction\nThe rank is 2."])]
    assert {r["doc_id"] for r in residue.found(docs(spark, rows)).collect()} == {1, 2, 3, 4, 5, 6, 7}


def test_residue_that_no_seed_text_holds(spark):
    """A single residue sentence among content, with no text of residue alone; ids in capitals are ids."""
    rows = [(1, "The rank is 2.\nTODO: write the diagram section\nThe trace is 3.\nThe norm is kept.", None), (2, 'The rank is 2.\n{"STATUS": "ERROR", "DETAIL": "NOT FOUND", "REQUEST_ID": "A5AF4DED97"}\nThe trace is 3.\nThe norm is kept.', None)]
    assert {r["doc_id"] for r in residue.found(docs(spark, [*rows, (3, "The rank is 2.\nThe trace is 3.", None)])).collect()} == {1, 2}


def test_texts_without_slots_or_runs_are_not_searched(monkeypatch):
    """Single words of the filler lists and brackets that begin no slot cost no search."""
    tried = []
    monkeypatch.setattr(residue, "runs", lambda *a: tried.append(a) or [])
    monkeypatch.setattr(residue, "slots", lambda *a: tried.append(a) or [])
    text = "In one of the rows do a test in the foo column: in the end [[1, 2], [3, 4]] is in a Größe of 3 < 4."
    assert residue.with_slots_masked(text) == text and not tried


@pytest.mark.parametrize("text", ["A. B!\" c\n\n d.) \n e <user> f<TOOL>g… h", "。 x。y ！ z", ".", "", "a.. b <userx> .\n<user>.", "<\n<user>'\n?'] \n"])
def test_sentences_end_as_their_pattern_says(text):
    assert [x for x in residue.sentences(text) if x] == [x for x in residue.SENTENCES.split(text) if x]


def chain_of_passages(n):
    words = [f"word{chr(97 + i)}{chr(97 + i)}x" for i in range(24)]
    out = [" ".join(words)]
    for i in range(n):
        words = words.copy()
        words[3 * i], words[3 * i + 1] = f"changed{chr(97 + i)}", f"other{chr(105 + i)}"
        out.append(" ".join(words))
    return out


def test_labels_reach_near_duplicates_in_rings(spark):
    """A chain of passages, each near the next; only the first is trusted."""
    chain = chain_of_passages(4)
    assert not residue.similar(residue.grams(chain[0], {}), residue.grams(chain[4], {}))  # reached through the others only
    rows = [(p, i == 0) for i, p in enumerate(chain)] + [("something else altogether stands in this passage", False)]
    df = spark.createDataFrame([(i, residue.class_id(p), t, p) for i, (p, t) in enumerate(rows)], "doc_id bigint, cid bigint, trusted boolean, passage string")
    reached = {r["cid"] for r in residue.spread(residue.classes_of(df)).collect()}
    assert reached & {residue.class_id(p) for p, _ in rows} == {residue.class_id(p) for p in chain}


def test_crowds_give_the_same_labels(spark):
    """Labelled and other near-copies in one table entry: shares of the ring change nothing."""
    base = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}z" for i in range(60)]
    variant = lambda i: " ".join([*base[: i % 60], f"v{chr(97 + i % 26)}{chr(97 + i // 26)}", *base[i % 60 + 1 :]])
    df = spark.createDataFrame([(i, residue.class_id(variant(i)), i < 40, variant(i)) for i in range(90)] + [(500, 5, False, "the rank is kept")], "doc_id bigint, cid bigint, trusted boolean, passage string")
    c = residue.classes_of(df).checkpoint()
    plain, crowded = ({r["cid"] for r in residue.spread(c, crowd=n).collect()} for n in (2000, 5))
    assert plain == crowded and {residue.class_id(variant(i)) for i in range(90)} <= plain and 5 not in plain


@pytest.mark.parametrize("length", [8, 15, 40, 150])
def test_recall_of_the_tables(spark, length):
    """Pairs just above the similarity that counts: at least 0.9 of them meet in a table and pass the Hamming test."""
    rng = random.Random(length)
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(3, 9)))
    pairs = []
    while len(pairs) < 200:
        a = [word() for _ in range(length)]
        b = a.copy()
        for i in rng.sample(range(length), max(1, round(length * 0.11))):
            b[i] = word() if rng.random() < 0.5 else b[i][: len(b[i]) // 2] + word()[:2]
        x, y = " ".join(a), " ".join(b)
        s, t = residue.grams(x, {}), residue.grams(y, {})
        if 0.8 <= len(s & t) / len(s | t) < 0.86:
            pairs.append((x, y))
    rows = [(i, residue.class_id(p), False, p) for i, p in enumerate(p for pair in pairs for p in pair)]
    c = residue.classes_of(spark.createDataFrame(rows, "doc_id bigint, cid bigint, trusted boolean, passage string")).filter("not trusted").checkpoint()
    met = residue.table_rows(c, "a", True).join(residue.table_rows(c, "b", False), "key").filter("cid_a <> cid_b").select("cid_a", "cid_b").distinct()
    n = len({frozenset((r["cid_a"], r["cid_b"])) for r in met.collect()} & {frozenset(map(residue.class_id, p)) for p in pairs})
    assert n >= 0.9 * len(pairs)
    near = residue.alike(met, c, c).distinct().count()
    assert near >= 0.9 * 2 * len(pairs)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 9), min_size=1, max_size=4), min_size=1, max_size=5), st.randoms(use_true_random=False))
def test_controlled_rounding(there, rng):
    m = max(len(r) for r in there)
    there = [r + [0] * (m - len(r)) for r in there]
    quotas = [rng.randint(0, sum(r)) for r in there]
    cells = [[Fraction(q * x, sum(r)) if sum(r) else Fraction(0) for x in r] for q, r in zip(quotas, there)]
    out = quota.controlled_rounding(cells)
    for row, frac, q, r in zip(out, cells, quotas, there):
        assert sum(row) == (q if sum(r) else 0)
        assert all(int(f) <= x <= -(-f.numerator // f.denominator) and x <= n for x, f, n in zip(row, frac, r))
    for j in range(m):
        total = sum(c[j] for c in cells)
        assert int(total) <= sum(o[j] for o in out) <= -(-total.numerator // total.denominator)


Q = "question_id bigint, difficulty string, problem_type string, tool_calls_required int, source string, stratum string, category string, key string"
T = "plan_id int, attribute string, category string, share_permille int, min_rows int, sample_rows bigint"


def test_quota_sample(spark):
    rows = [(i, ["ONE_TOOL_CALL", "easy (1 tool call)", "TWO_TOOL_CALLS", None][i % 4], None if i % 5 == 0 else "t", 1 + i % 2, None if i % 7 == 0 else f"s{i % 3}", "x", "y", "z") for i in range(400)]
    rows += [rows[0]]
    targets = spark.createDataFrame([(1, "difficulty", "ONE_TOOL_CALL", 700, 1, 100), (1, "difficulty", "TWO_TOOL_CALLS", 200, 30, 100), (1, "difficulty", "THREE_TOOL_CALLS", 100, 2, 100), (2, "problem_type", "t", 1000, 1, 5000), (3, "tool_calls_required", "2", 1000, 0, 50)], T)
    p = quota.QuotaPlan(spark.createDataFrame(rows, Q), targets)
    report = {(r["plan_id"], r["category"]): r for r in p.report().collect()}
    assert report[1, "THREE_TOOL_CALLS"]["quota"] == 0 and report[1, "TWO_TOOL_CALLS"]["quota"] == 30 and report[1, "ONE_TOOL_CALL"]["available"] == 201
    drawn = p.draw().collect()
    for (plan, category), r in report.items():
        assert sum(d["plan_id"] == plan and d["category"] == category for d in drawn) == r["quota"]
    assert {tuple(r) for r in quota.shortfalls(spark.createDataFrame(rows, Q), targets).collect()} == {(1, "difficulty", "THREE_TOOL_CALLS"), (2, "problem_type", "t")}
    by_source = {}
    for d in drawn:
        if d["plan_id"] == 3:
            by_source[d["stratum"]] = by_source.get(d["stratum"], 0) + 1
    assert sum(by_source.values()) == 50 and None in by_source


def test_many_strata_share_one_and_null_stays_apart(spark):
    rows = [(i, "ONE_TOOL_CALL", None, None, None if i % 10 == 0 else f"s{i % 10}", "x", "y", "z") for i in range(300)]
    targets = spark.createDataFrame([(1, "difficulty", "ONE_TOOL_CALL", 1000, 1, 100)], T)
    drawn = quota.QuotaPlan(spark.createDataFrame(rows, Q), targets, max_strata=3).draw().collect()
    n = {}
    for d in drawn:
        n[d["stratum"]] = n.get(d["stratum"], 0) + 1
    assert sum(n.values()) == 100 and n[None] == 10 and n.keys() == {None, "s1", "s2", "s3", "(other)"} and n["(other)"] == 60


def test_reasons_of_quotas_below_need(spark):
    rows = [(i, ["ONE_TOOL_CALL", "TWO_TOOL_CALLS"][i % 2], "t", 1, "s", "x", "y", "z") for i in range(200)]
    targets = spark.createDataFrame([(1, "difficulty", "ONE_TOOL_CALL", 800, 1, 100), (1, "difficulty", "TWO_TOOL_CALLS", 100, 50, 100), (1, "difficulty", "THREE_TOOL_CALLS", 100, 3, 100)], T)
    got = {r["category"]: (r["unmet"], r["reason"]) for r in quota.below_need(spark.createDataFrame(rows, Q), targets).collect()}
    assert got == {"ONE_TOOL_CALL": (0, "other minima"), "THREE_TOOL_CALLS": (10, "rows")}


def test_quota_of_empty_tables(spark):
    empty = quota.QuotaPlan(spark.createDataFrame([], Q), spark.createDataFrame([(1, "difficulty", "ONE_TOOL_CALL", 1000, 1, 10)], T))
    assert empty.report().first()["quota"] == 0 and empty.draw().count() == 0
    none = quota.QuotaPlan(spark.createDataFrame([], Q), spark.createDataFrame([], T))
    assert none.report().count() == 0 and none.draw().count() == 0


def test_minima_take_from_the_larger():
    assert quota.category_quotas([900, 100], [1, 40], 100, [1000, 1000]) == [60, 40]
    assert sum(quota.category_quotas([333, 333, 334], [0, 0, 0], 100, [1000] * 3)) == 100


def test_unclosed_groups_of_copies_stay_one_class(spark):
    rows = [(i, "Please enable JavaScript to view page 12 now, or leave this place for another.", None) for i in range(300)] + [(999, "The rank is 2.", None)]
    assert residue.labelled(docs(spark, rows)).count() == 300
