"""Cut texts and defective pairs on fixtures."""

import pytest

from sparkloom.llm import defects, language, structure, truncation

MESSAGE = "struct<role:string,content:string,tool_calls:array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>,tool_call_id:string,name:string>"
CHATS = f"idx bigint, task_id bigint, source string, messages array<{MESSAGE}>, stepwise_ground_truths string, instruction string, key string, text string"
TASKS = "task_id bigint, instruction string, key string"
FULL = "The sign pattern was checked before the products were added. So the determinant is 12.5."


def chat(spark, rows):
    def messages(ms):
        return None if ms is None else [None if m is None else (m[0], m[1], [("c", "function", ("determinant", "{}"))] if len(m) > 2 else None, None, None) for m in ms]

    return spark.createDataFrame([(i, t, "src", messages(ms), g, "x", "y", "z") for i, t, ms, g in rows], CHATS)


@pytest.mark.parametrize(
    ("text", "open_"),
    [("(a [b", ["(", "["]), ("[[1, 2], [3", ["[", "["]), ("1) a 2) b", []), ("<think>a</think><answer>b", ["answer"]), ("<think>a", ["think"]), ("```x (", ["```"]), ("```x ( ```", []), ('say "a', ['"']), (":) fine", []), ("{[(])}", [])],
)
def test_pushdown(text, open_):
    assert [x for x in structure.unclosed(text)] == open_ or text == "{[(])}" and not structure.unclosed(text)


def test_every_cut_of_a_text_is_found(spark):
    """All prefixes of a text that has a whole copy, but those that end with a sentence."""
    rows = [(0, 1, [("assistant", FULL)], None)] + [(i, 1, [("assistant", FULL[:i])], None) for i in range(13, len(FULL))]
    got = {r["idx"] for r in truncation.found(chat(spark, rows)).collect()}
    ends = {FULL.index(".") + 1, FULL.index(".") + 2}
    number = {i for i in range(len(FULL) - 5, len(FULL))}  # within 12.5 a cut may read as another value
    assert {i for i in range(13, len(FULL))} - got <= ends | number and 0 not in got


def test_cut_cases(spark):
    whole = "<think>One call is needed.</think>\n\n<answer>So the rank is 2.</answer>"
    rows = [
        (1, 1, [("user", "need the rank please"), ("assistant", whole), ("assistant", whole[:20]), ("assistant", whole[:-4]), ("tool", "[[1, 2], [3, "), ("tool", "-12"), ("tool", "3")], '[{"determinant": -125.0}]'),
        (2, None, [None, ("assistant", None), ("assistant", ""), ("assistant", "  "), ("assistant", "result: 4"), ("user", "thx")], None), (3, None, None, None), (4, 2, [], "{broken"),
        (5, 1, [("assistant", "Find the rank of A. " * 30_000)], None), (6, 1, [("assistant", "[[1, 2]]")], None), (7, 1, [("assistant", "Find the trace of A, where A = [[1]]")], None),
    ]
    tasks = spark.createDataFrame([(1, "Find the trace of A, where A = [[1]].", "k"), (1, "again", "k"), (None, None, None)], TASKS)
    got = {tuple(r) for r in truncation.found(chat(spark, rows), tasks).collect()}
    assert got == {(1, 2), (1, 3), (1, 4), (1, 5)}


def test_long_bare_values_are_compared(spark):
    """A value of any length that is the start of the stated one was cut."""
    value = "; ".join(str(1000 + i) for i in range(1500))
    rows = [(i, 1, [("tool", value[:n])], '[{"values": "%s"}]' % value) for i, n in enumerate((100, 3998, 6004, len(value)))]
    assert {r["idx"] for r in truncation.found(chat(spark, rows)).collect()} == {0, 1, 2}


def test_cut_dots(spark):
    rows = [(1, 1, [("assistant", "Hmm, one thing at a time…")], None), (2, 1, [("assistant", "The tool may complain about this input.")], None), (3, 1, [("assistant", "Hmm, one thing at a time… The tool may compl…")], None)]
    assert {tuple(r) for r in truncation.found(chat(spark, rows)).collect()} == {(3, 0)}


@pytest.mark.parametrize("times", [1, 10])
def test_usual_endings_by_shares(spark, times):
    """An ending of eight texts that one continues is usual, however large the table is; one that is mostly continued is cut."""
    rows = [(i, 1, [("assistant", f"Row {i} was read. so the rank of it stays")], None) for i in range(8 * times)]
    rows += [(1000 + i, 1, [("assistant", f"Row {i} was read. so the rank of it stays as it was.")], None) for i in range(times)]
    rows += [(2000 + i, 1, [("assistant", f"Row {i} was read. then the trace of it was")], None) for i in range(3 * times)]
    rows += [(3000 + i, 1, [("assistant", f"Row {i} was read. then the trace of it was added.")], None) for i in range(5 * times)]
    assert {r["idx"] for r in truncation.found(chat(spark, rows)).collect()} == set(range(2000, 2000 + 3 * times))


def test_hot_cut_texts_do_not_outvote_their_copies(spark):
    whole = "The sign pattern was checked before. then every product was added to the sum."
    rows = [(i, 1, [("assistant", whole[:60])], None) for i in range(40)] + [(100 + i, 1, [("assistant", whole)], None) for i in range(3)]
    assert {r["idx"] for r in truncation.found(chat(spark, rows)).collect()} == set(range(40))


def test_formal_texts_end_like_formal_copies(spark):
    """A user message with the same sentence doesn't matter."""
    rows = [(1, 1, [("assistant", "Terms were added. So every sign is kept.")], None), (2, 1, [("assistant", "Rows were read. So every sign is kept")], None), (3, 1, [("user", "So every sign is kept")], None)]
    assert {tuple(r) for r in truncation.found(chat(spark, rows)).collect()} == {(2, 0)}


@pytest.mark.parametrize("parts", [1, 4, 40])
def test_longer_copies_equal_brute_force(spark, parts):
    import random

    rng = random.Random(parts)
    strings = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 8))) for _ in range(300)})
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df = spark.createDataFrame([(s, 1 + len(s)) for s in strings], "frag string, n bigint")
        got = [(r["frag"], r["n_longer"]) for r in truncation.longer_copies(df).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    expected = {s: sum(1 + len(t) for t in strings if t != s and t.startswith(s)) for s in strings}
    assert len(got) == len(set(got)) and dict(got) == {s: n for s, n in expected.items() if n}


def test_very_long_strings_leave_few_edges(spark):
    """A string of a megabyte in each partition: what crosses their borders is counted without its prefixes."""
    base = "x" * 1_000_000
    strings = [base[:500_000], base[:999_999], base, base + "a", base + "b" * 500_000, "y" + base, "y" + base + "z"]
    df = spark.createDataFrame([(s, 1) for s in strings], "frag string, n bigint")
    got = {len(r["frag"]): r["n_longer"] for r in truncation.longer_copies(df).collect()}
    assert got == {500_000: 4, 999_999: 3, 1_000_000: 2, 1_000_001: 1}


def test_causes(spark):
    whole = "The sign pattern was checked before. then every product was added to the sum."
    rows = [(1, 1, [("assistant", whole)], None), (2, 1, [("assistant", whole[:60])], None), (3, 1, [("assistant", whole[:-1])], None), (4, 1, [("assistant", "<think>The sign")], None)]
    assert {r["idx"]: r["cause"] for r in truncation.cut_messages(chat(spark, rows)).collect()} == {2: "prefix", 3: "mark", 4: "structure"}
    r = truncation.report(chat(spark, rows)).first()
    assert (r["n_messages"], r["n_cut"], r["n_structure"], r["n_prefix"], r["n_mark"]) == (4, 3, 1, 1, 1)


def test_empty_tables(spark):
    c, t, q = chat(spark, []), spark.createDataFrame([], TASKS), spark.createDataFrame([], QUESTIONS)
    assert truncation.found(c, t).count() == 0 and truncation.report(c, t).count() == 0 and defects.found(q, c, t).count() == 0


QUESTIONS = "question_id bigint, question string, answer string, golden struct<final_answer:string>, cut boolean, prompt string"
ASKED = "Compute the determinant of M, where M = [[11, -2], [3, 4]]."
PAIRS = [
    ("50.0", None), ("So the determinant is 50.0.", None), ("Sorry about the slip in the draft; the determinant is 50.0.", None), ("It is not possible to simplify further, and the determinant stays at 50.0.", None),
    ("I can't stress enough that signs matter here: the determinant is 50.0.", None), ("Voilà, the determinant is 50.0, quod erat demonstrandum.", None), ("German notes call such things Spur, Rang or Norm; in our words, the determinant is 50.0.", None),
    (None, "empty"), ("", "empty"), ("  ​", "empty"), ("N/A", "empty"), ("...", "empty"), ("(no answer)", "empty"), ("[]", "empty"), ("-", "empty"),
    ("I'm sorry, but I can't help with this request.", "refusal"), ("THIS FALLS BEYOND MY ROLE, SO THE ANSWER STAYS OPEN.", "refusal"), ("Nope, not doing matrices today.", "refusal"), ("Lo siento, pero no puedo ayudar con este ejercicio.", "refusal"),
    (ASKED, "copy"), ("compute  the determinant of m, where m = [[11, -2], [3, 4]]", "copy"), ('"' + ASKED + '"', "copy"), ("The question was: " + ASKED, "copy"), (ASKED + " " + ASKED, "copy"),
    ("So the determ", "truncated"), ("[[11, -2], [3", "truncated"), ("So the determinant is 50.0. Every pro", "truncated"),
    ("Por lo tanto, el valor pedido es 50.0.", "other_language"), ("Искомое значение равно 50.0.", "other_language"), ("De gevraagde waarde is dus 50.0. Eerst zijn de producten van rij 1 opgeschreven.", "other_language"),
    ("[[11, 3], [-2, 4]]", None), ("result: 50.0", None), ("The determinant = 50.0", None),
]


def test_pairs(spark):
    rows = [(i, ASKED, a, ("50.0",), True, "x") for i, (a, _) in enumerate(PAIRS)] + [(1000 + i, ASKED, s, ("50.0",), True, "x") for i, s in enumerate(["So the determinant is 7.0.", "Every product was written down before the sum was taken. So the determinant is 7.0."])]
    rows += [(2000, None, "50", None, None, None), (2001, None, None, None, None, None), (2002, ASKED, "So the determinant is 7.0. " * 20_000, ("7.0",), None, None), (2003, ASKED, "", None, None, None), (2003, ASKED, "", None, None, None)]
    got = [tuple(r) for r in defects.defects(defects.question_pairs(spark.createDataFrame(rows, QUESTIONS))).collect()]
    of = {i: d for _, i, d in got}
    assert [(PAIRS[i][0], of.get(i)) for i in range(len(PAIRS)) if of.get(i) != PAIRS[i][1]] == []
    assert of[2001] == "empty" and 2000 not in of and 2002 not in of and sum(i == 2003 for _, i, _ in got) == 2


def test_task_pairs(spark):
    whole = "<think>One call is needed.</think>\n\n<answer>{}</answer>"
    rows = [
        (1, 1, [("assistant", "x", "call"), ("assistant", whole.format("50.0"))], None), (2, 1, [("assistant", whole.format(""))], None), (3, 1, [("assistant", whole.format("50.0")[:40])], None),
        (4, None, [("assistant", "")], None), (5, 1, [("assistant", "", "call")], None), (6, 9, [("assistant", "")], None), (7, 1, [("assistant", whole.format(ASKED)), ("user", "thanks!")], None), (8, 1, [("assistant", None)], None), (9, 1, None, None),
    ]
    tasks = spark.createDataFrame([(1, ASKED, "k"), (2, None, "k")], TASKS)
    got = {r["pair_id"]: r["defect"] for r in defects.defects(defects.task_pairs(chat(spark, rows), tasks)).collect()}
    assert got == {2: "empty", 3: "truncated", 7: "copy", 8: "empty"}


def test_tiling():
    a, b = "a b c d e f".split(), "x a b c y d e f".split()
    in_a, in_b = defects.tiling(a, b)
    assert in_a == set(range(6)) and in_b == {1, 2, 3, 5, 6, 7}
    assert defects.tiling(["a", "b"], ["a", "b"]) == (set(), set())


@pytest.mark.parametrize("text", ["The matrix is singular.", "Yes, it is symmetric.", "It has full rank, so the columns are independent.", "Matrix invertible, columns independent, rank maximal overall", "The system cannot be solved uniquely.", "No, there is none."])
def test_answers_without_digits_are_no_defects(text):
    assert defects.classify(ASKED, text, False) is None


@pytest.mark.parametrize(
    "text",
    [
        "We are not allowed to discuss graded homework.", "Requests like this one are not answered.", "My guidelines prohibit replying to it.", "I would prefer you try it yourself.", "Leider darf ich diese Frage nicht beantworten.", "Malheureusement, je ne peux pas répondre.",
        "Purtroppo non posso aiutare.", "Helaas kan ik niet helpen.", "Infelizmente não posso responder.", "That goes against our policy.", "I respectfully decline.",
    ],
)
def test_refusals(text):
    assert defects.classify(ASKED, text, False) == "refusal"


@pytest.mark.parametrize("times", [1, 2, 3, 4, 12])
def test_prompts_given_back_many_times(times):
    long = "Compute the rank of M and tell which of its columns are independent, where M is the matrix that the tutor wrote on the board in the last lesson before the break, please."
    assert defects.classify(long, " ".join([long] * times), False) == "copy"
    assert defects.classify("Rank of [[1, 2]]?", " / ".join(["rank of [[1,2]]"] * times), False) == "copy"
    assert defects.classify(long, " ".join([long] * times) + " It is 7.", False) is None


def test_long_repetitions_take_no_long():
    import time

    began = time.perf_counter()
    defects.is_copy("word " * 3000, "word " * 9000)
    defects.tiling([str(i % 50) for i in range(20_000)], [str(i % 50) for i in range(20_000)])
    assert time.perf_counter() - began < 20


HELD_OUT = {
    "en": "After the rows were swapped we saw that nothing else would change, so the answer stays where it was.", "de": "Nachdem wir die Zeilen getauscht hatten, änderte sich sonst nichts, deshalb bleibt die Antwort gleich.",
    "fr": "Quand on échange les lignes, rien d'autre ne change, donc la réponse reste la même.", "es": "Cuando se cambian las filas no cambia nada más, así que la respuesta sigue igual.", "it": "Quando si scambiano le righe non cambia altro, perciò la risposta resta la stessa.",
    "nl": "Wanneer we de rijen verwisselen verandert er verder niets, dus blijft het antwoord hetzelfde.", "pt": "Quando trocamos as linhas nada mais muda, portanto a resposta continua a mesma.", "pl": "Gdy zamienimy wiersze, nic więcej się nie zmienia, więc odpowiedź pozostaje taka sama.",
    "tr": "Satırları değiştirdiğimizde başka bir şey değişmez, bu yüzden cevap aynı kalır.", "ru": "Если поменять строки, ничего больше не изменится.", "zh": "交换两行以后，其他都不变。",
}


def test_languages_held_out():
    """Sentences outside the samples: each is likely of its own language, and nearly all pairs of others differ clearly."""
    assert all(own in language.likely(text) and not language.differs(text, text) for own, text in HELD_OUT.items())
    missed = [(a, b) for a in HELD_OUT for b in HELD_OUT if a != b and not language.differs(HELD_OUT[a], HELD_OUT[b])]
    assert len(missed) <= 0.02 * len(HELD_OUT) * (len(HELD_OUT) - 1)
