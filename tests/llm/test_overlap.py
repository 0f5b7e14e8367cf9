"""Cross-split overlap: the segment join against brute force, and the defined cases."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkloom.llm import overlap


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from("ab"), max_size=10), st.lists(st.sampled_from("ab"), max_size=10), st.integers(0, 4))
def test_banded_distance_and_segments(a, b, k):
    near = distance(a, b) <= k
    assert overlap.within(a, b, k) == near
    if near:
        assert overlap.own_signatures(7, a, k) & overlap.allowed_signatures(7, b, [(len(a), k)])


def brute_force(rows):
    """Pairs by comparing every evaluation row with every training row."""
    held = [(i, s.strip().lower(), overlap.read_record(q, a)) for i, s, q, a in rows if s is not None]
    held = [(i, s, r[0], r[1].split(" "), overlap.edits(r[2], overlap.SHARE)) for i, s, r in held if r]
    train = [h for h in held if h[1] in ("train", "training")]
    out = set()
    for i, s, key, words, k in held:
        if s in ("test", "val", "valid", "validation", "dev"):
            out |= {(min(i, j), max(i, j)) for j, _, key_b, words_b, _ in train if key == key_b and distance(words, words_b) <= k and overlap.same_operations(words, words_b)}
    return out


def test_whole_table_against_brute_force(spark):
    q = spark.read.parquet("/root/testdata/sf0.01/questions.parquet")
    rows = [tuple(r) for r in q.select("question_id", "split", "question", "answer").collect()]
    got = {tuple(r) for r in overlap.found(q).collect()}
    assert got == brute_force(rows) and len(got) > 50
    texts = {i: (a, b) for i, _, a, b in rows}
    assert sum(texts[a] != texts[b] for a, b in got) > len(got) / 2  # most are copies with differences


def test_join_loses_no_pair(spark):
    rng = random.Random(2)
    words = ["find", "the", "rank", "of", "this", "map", "then"]
    rows = [(i, rng.choice(("train", "test")), " ".join(rng.choice(words) for _ in range(rng.randint(3, 9))), rng.choice(("yes", "yes it is"))) for i in range(300)]
    assert {tuple(r) for r in overlap.found(frame(spark, rows)).collect()} == brute_force(rows)


SCHEMA = "question_id bigint, split string, question string, answer string, source string, form string, row_id int, is_eval string"
SAME = [
    "Compute the determinant of M, where M = [[1, -2], [3, 4]].", "compute  the  deeterminant of m, where m := [ [1.0, −2.0] , [3.0, 4.0] ]", "<p>Find the determinant of G, where G = [[1,-2],[3,4]].</p>", "Q: Compute the determinant of X, where X = [[1, -2], [3, 4]]. Thanks!",
]
OTHER = ["Compute the determinant of M, where M = [[1, 4], [3, -2]].", "Compute the trace of M, where M = [[1, -2], [3, 4]].", "Compute the determinant of M, where M = [[1, -2], [3, 5]].", "Compute the determinant of M, where M = [[1, -2, 3], [4, 0, 0]]."]


def frame(spark, rows):
    return spark.createDataFrame([(i, s, q, a, "src", "x", 1, "y") for i, s, q, a in rows], SCHEMA)


def test_same_problem_in_other_words(spark):
    rows = [(1, "train", SAME[0], "10.0")] + [(10 + i, "TEST", q, "It is 10.0") for i, q in enumerate(SAME)] + [(20 + i, "val", q, "10") for i, q in enumerate(OTHER)]
    assert {tuple(r) for r in overlap.found(frame(spark, rows)).collect()} == {(1, 10 + i) for i in range(len(SAME))}


def test_defined_cases(spark):
    rows = [
        (1, "Train ", SAME[0], "10"), (2, "test", SAME[0], "10"), (2, "test", SAME[0], "10"), (3, None, SAME[0], "10"), (4, "other", SAME[0], "10"), (5, "test", None, "10"), (6, "test", SAME[0], None), (7, "test", SAME[0], "no idea"), (12, "train", "Prove it is linear.", "Yes"), (13, "dev", "Prove it is linear", "yes!"),
        (8, "test", SAME[0], "11"), (9, "test", "", "10"), (10, "validation", "word " * 50_000 + SAME[0], "10"), (11, "test", "no numbers", "10"),
    ]
    got = sorted(tuple(r) for r in overlap.found(frame(spark, rows)).collect())
    assert got == [(1, 2), (1, 2), (12, 13)]
    r = overlap.report(frame(spark, rows)).agg(F.sum("n_rows"), F.sum("n_pairs")).first()
    assert r[0] == 10 and r[1] >= 3


@pytest.mark.parametrize("rows", [[], [(1, "train", SAME[0], "10")], [(1, "test", SAME[0], "10")]])
def test_empty_sides(spark, rows):
    out = overlap.found(frame(spark, rows))
    assert out.columns == ["question_id_a", "question_id_b"] and out.count() == 0


def test_group_of_copies(spark):
    rows = [(i, "train", SAME[0], "10") for i in range(60)] + [(100 + i, "test", SAME[1], "10.0") for i in range(40)]
    assert overlap.found(frame(spark, rows)).distinct().count() == 60 * 40


def test_hot_string_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(overlap, "CHUNK", 7)
    test_group_of_copies(spark)


def test_records():
    a = overlap.read_record("Compute the rank of A, where A = [[1, 2], [2, 4.0]].", "Rank: 1.0")
    assert a == ("1,2;2,4 / | / 1", "compute the rank of # where # | rank", 14)
    assert overlap.read_text("1 2; 3 4")[0] == overlap.read_text("[[1.0, 2], [3, 4]]")[0] != overlap.read_text("[[1, 2, 3, 4]]")[0]
    assert overlap.operations("find the rnak of the trasnpose with norm || # ||".split()) == "RTF"
