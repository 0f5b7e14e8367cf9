"""Records that appear, exactly or almost, in both the training and an evaluation split.

A record's string is the sequence of the words of its question and of its answer, normalised
(compatibility form, lower case, no markup or invisible characters, one mark for all one-letter
names). Strings are joined by edit distance, with words as letters: an evaluation string is cut
into k+1 segments, one of which must appear unchanged in any training string within distance k, at
a place that k edits can reach; candidates are verified by a banded dynamic program. k grows with
the length of the evaluation string (``share`` of its words and numbers). Numbers are never edited,
as another number makes another problem: the numbers of question and answer, by matrix, row and
place, are part of every segment's signature. So only strings with the same numbers on both sides
are cut at all. A last exact check demands that the same operations are asked.

Copies meet as one string, so a group of copies costs one comparison. Rows are narrow hashes until
a string is needed: it is read again for one row of each distinct string whose numbers occur on
both sides. Pairs of rows are made from links between strings and membership, in chunks of
``CHUNK`` training rows, so that no task expands a hot string alone; the report adds up sizes of
groups and makes no pairs.

Defined cases: rows whose split is null or unknown, or whose question or answer is null or holds
neither word nor number take no part; texts without numbers are compared by their words alone;
repeated rows count like others; extra columns are not read.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.session import cut_lineage, spread_out

#: Words that name an operation, by its letter (stems, lower case, no accents).
OPERATIONS = {
    "T": ("transpose", "transposed", "transponierte", "transposee", "traspuesta", "transpuesta"),
    "C": ("cofactor", "cofactors", "kofaktormatrix", "comatrice", "cofactores", "cofacteurs"),
    "D": ("determinant", "determinante", "det"),
    "F": ("frobenius",),
    "R": ("rank", "rang", "rango"),
    "S": ("trace", "spur", "traza", "tr"),
    "P": ("product", "produkt", "produit", "producto"),
    "I": ("inverse", "inversa"),
}
LETTER = {word: letter for letter, words in OPERATIONS.items() for word in words}
#: Common words that a misspelling of an operation might be taken for.
ORDINARY = frozenset(("trade", "track", "spur", "take", "rand", "range", "grace", "place", "transport", "productos", "frac", "bank", "tank", "rang", "tras", "traces"))

#: Edits that count as a few: a share of the words and numbers of the evaluation string, and in long ones never more than MOST.
SHARE, MOST = 0.4, 30
#: Training rows of one string that one task pairs with an evaluation row.
CHUNK = 1000

NUMBER = re.compile(r"-?\d+(?:\.\d+)?(?:e[+-]?\d+)?")
MATRIX = re.compile(r"\[\s*\[.*?\]\s*\]", re.S)
ROWS = re.compile(r"\d\s*;|\d\s*\\\\")
WORD = re.compile(r"\|\||[^\W\d_]+")
TAG = re.compile(r"</?[a-z][^<>]*>")
DASHES = dict.fromkeys(map(ord, "−–‐‑﹣－"), "-")
ANSWER, NAME = "|", "#"


def plain_text(text: str) -> str:
    """Compatibility form without invisible characters, with plain minus signs, in lower case."""
    text = unicodedata.normalize("NFKC", text).translate(DASHES)
    if not text.isascii():
        text = "".join(ch for ch in text if unicodedata.category(ch) != "Cf")
    return text.lower()


def one_slip(a: str, b: str) -> bool:
    """Whether two words differ by one letter inserted, lost, changed, or swapped with its neighbour."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


def operation(word: str) -> str:
    """Letter of the operation that a word names, perhaps misspelt; empty for other words."""
    bare = "".join(ch for ch in unicodedata.normalize("NFD", word) if not unicodedata.combining(ch)) if not word.isascii() else word
    found = LETTER.get(bare, "")
    if not found and len(bare) >= 4 and bare not in ORDINARY:
        found = next((letter for w, letter in LETTER.items() if len(w) >= 4 and one_slip(bare, w)), "")
    return found


def operations(words: Sequence[str]) -> str:
    """Letters of the operations that a question's words ask for; a pair of bars is a norm."""
    out, norm = [], False
    for w in words:
        if w == "||":
            norm = not norm
            if norm:
                out.append("F")
        else:
            out.append(operation(w))
    return "".join(out)


def number(text: str) -> str:
    """One spelling per value."""
    x = float(text)
    return str(int(x)) if x == int(x) and abs(x) < 1e15 else repr(x)


def read_matrix(text: str) -> str:
    """Rows of numbers of a bracketed or semicolon-separated matrix, in one spelling."""
    rows: list[list[str]] = [[]]
    for m in re.finditer(r"-?\d+(?:\.\d+)?(?:e[+-]?\d+)?|[\];]|\\\\", text):
        if m.group()[0] in "];\\":
            rows.append([])
        else:
            rows[-1].append(number(m.group()))
    return ";".join(",".join(r) for r in rows if r)


def read_text(text: str) -> tuple[str, int, list[str]]:
    """The numbers of a text by matrix, row and place, how many there are, and its words."""
    text = plain_text(text)
    if "<" in text:
        text = TAG.sub(" ", text)
    matrices = [read_matrix(m) for m in MATRIX.findall(text)] if "[" in text else []
    rest = MATRIX.sub(" ", text) if matrices else text
    if not matrices and ROWS.search(text):
        matrices, loose = [read_matrix(text)], []
    else:
        loose = [number(x) for x in NUMBER.findall(rest)]
    key = " ".join((*matrices, "/", *loose))
    return key, key.count(",") + key.count(";") + len(matrices) + len(loose), [w if len(w) > 1 else NAME for w in WORD.findall(rest)]


def read_record(question: str | None, answer: str | None) -> tuple[str, str, int] | None:
    """Numbers, words and the length in words and numbers of a record; None if a text holds neither."""
    if not question or not answer:
        return None
    key, n, words = read_text(question)
    key_a, n_a, words_a = read_text(answer)
    if not (n or words) or not (n_a or words_a):
        return None
    words += [ANSWER, *words_a]
    return f"{key} {ANSWER} {key_a}", " ".join(words), n + n_a + len(words)


def edits(length: int, share: float) -> int:
    """k of a string of so many words and numbers."""
    return min(MOST, max(1, int(length * share)))


def segments(length: int, k: int) -> list[tuple[int, int]]:
    """Start and length of k+1 segments of a string, as even as possible."""
    short, longer = divmod(length, k + 1)
    out, at = [], 0
    for i in range(k + 1):
        n = short + (i >= k + 1 - longer)
        out.append((at, n))
        at += n
    return out


def signature(key: int, length: int, k: int, i: int, segment: Sequence[str]) -> int:
    return xxhash.xxh3_64_intdigest(f"{key}.{length}.{k}.{i}.{' '.join(segment)}") - (1 << 63)


def own_signatures(key: int, s: Sequence[str], k: int) -> set[int]:
    """Of an evaluation string: one for each segment."""
    return {signature(key, len(s), k, i, s[p : p + n]) for i, (p, n) in enumerate(segments(len(s), k))}


def allowed_signatures(key: int, s: Sequence[str], lengths: Sequence[tuple[int, int]]) -> set[int]:
    """Of a training string: each part that could be a segment of an evaluation string of one of the (length, k) within distance k."""
    out = set()
    for length, k in lengths:
        shift = len(s) - length
        if abs(shift) > k:
            continue
        for i, (p, n) in enumerate(segments(length, k)):
            first = max(0, p - i, p + shift - (k - i))
            last = min(len(s) - n, p + i, p + shift + (k - i))
            for at in range(first, last + 1):
                out.add(signature(key, length, k, i, s[at : at + n]))
    return out


def within(a: Sequence[str], b: Sequence[str], k: int) -> bool:
    """Whether the edit distance is at most k: a dynamic program over the 2k+1 diagonals."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > k:
        return False
    far = k + 1
    row = [abs(d) if d >= 0 else far for d in range(-k, k + 1)]  # row[d+k]: distance of a[:i] and b[:i+d]
    for i in range(1, len(a) + 1):
        new = []
        for d in range(-k, k + 1):
            j = i + d
            if j < 0 or j > len(b):
                new.append(far)
                continue
            best = row[d + k] + (a[i - 1] != b[j - 1]) if j else far
            if d < k:
                best = min(best, row[d + k + 1] + 1)
            if d > -k:
                best = min(best, new[-1] + 1)
            new.append(min(best, far) if j else min(i, far))
        row = new
        if min(row) > k:
            return False
    return row[len(b) - len(a) + k] <= k


def same_operations(a: Sequence[str], b: Sequence[str]) -> bool:
    """The exact check on two strings: their questions ask for the same operations, as far as both name any."""
    x, y = operations(a[: a.index(ANSWER)]), operations(b[: b.index(ANSWER)])
    return x == y or not x or not y


def split_name(c: Column) -> Column:
    """train, validation or test of any spelling, else null."""
    name = F.lower(F.trim(c))
    return F.when(name.isin("val", "valid", "validation", "dev"), "validation").when(name.isin("train", "training"), "train").when(name == "test", "test")


def hashed(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


class Overlap:
    """Links between strings of both sides, and the rows that hold them."""

    def __init__(self, questions: DataFrame, share: float = SHARE, id_col: str = "question_id", question_col: str = "question", answer_col: str = "answer", split_col: str = "split"):
        self.share = share
        side = split_name(F.col(split_col))
        self.texts = questions.select(F.col(id_col).cast("bigint").alias("row_id"), (side != "train").alias("is_eval"), F.col(question_col).alias("q"), F.col(answer_col).alias("a")).filter(
            "is_eval is not null and q is not null and a is not null"
        )
        self.rows = cut_lineage(self._narrow())
        self.links = cut_lineage(self._linked())

    def _narrow(self) -> DataFrame:
        """row_id, is_eval, kid (hash of the numbers), fid (of numbers and words), n_words, k of every row that takes part."""
        share = self.share

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = []
                for i, e, q, a in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3)):
                    if held := read_record(q.as_py(), a.as_py()):
                        key, words, length = held
                        out.append((i, e, hashed(key), hashed(f"{key} {words}"), words.count(" ") + 1, edits(length, share)))
                kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 6, kinds)], names=["row_id", "is_eval", "kid", "fid", "n_words", "k"])

        return spread_out(self.texts).mapInArrow(run, "row_id bigint, is_eval boolean, kid bigint, fid bigint, n_words int, k int")

    def _strings(self) -> DataFrame:
        """kid, fid, has_eval, has_train, k, words, and the (length, k) of the evaluation strings with the same numbers, of each string whose numbers occur on both sides."""
        held = F.col("is_eval")
        shared = (
            self.rows.groupBy("kid").agg(F.bool_or(held).alias("e"), F.bool_or(~held).alias("t"), F.collect_set(F.when(held, F.struct("n_words", "k"))).alias("lengths"))
            .filter("e and t").select("kid", "lengths")
        )
        distinct = self.rows.join(shared, "kid").groupBy("kid", "fid").agg(F.bool_or(held).alias("has_eval"), F.bool_or(~held).alias("has_train"), F.min("row_id").alias("row_id"), F.first("k").alias("k"), F.first("lengths").alias("lengths"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                held = [read_record(q.as_py(), a.as_py()) for q, a in zip(b.column("q"), b.column("a"))]
                own = [h is not None and hashed(f"{h[0]} {h[1]}") == f for h, f in zip(held, b.column("fid").to_pylist())]  # rows of one id may differ
                words = pa.array([h[1] if ok else None for h, ok in zip(held, own)], pa.string())
                kept = ["kid", "fid", "has_eval", "has_train", "k", "lengths"]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), words], names=[*kept, "words"]).filter(words.is_valid())

        named = distinct.join(self.texts.select("row_id", "q", "a"), "row_id")
        return named.mapInArrow(run, "kid bigint, fid bigint, has_eval boolean, has_train boolean, k int, lengths array<struct<n_words:int,k:int>>, words string").dropDuplicates(["fid"])

    def _linked(self) -> DataFrame:
        """fid_eval, fid_train of the strings within distance k of each other that ask for the same operations."""
        strings = cut_lineage(self._strings())

        def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                sig, fid, side = [], [], []
                for kid, f, e, t, k, lengths, words in zip(*(b.column(c).to_pylist() for c in ("kid", "fid", "has_eval", "has_train", "k", "lengths", "words"))):
                    s = words.split(" ")
                    own = own_signatures(kid, s, k) if e else ()
                    allowed = allowed_signatures(kid, s, [(x["n_words"], x["k"]) for x in lengths]) if t else ()
                    sig += [*own, *allowed]
                    fid += [f] * (len(own) + len(allowed))
                    side += [True] * len(own) + [False] * len(allowed)
                yield pa.RecordBatch.from_arrays([pa.array(sig, pa.int64()), pa.array(fid, pa.int64()), pa.array(side, pa.bool_())], names=["sig", "fid", "side"])

        def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                strings = ((x.split(" "), y.split(" "), k) for x, y, k in zip(*(b.column(c).to_pylist() for c in ("words_eval", "words_train", "k"))))
                ok = pa.array([within(x, y, k) and same_operations(x, y) for x, y, k in strings], pa.bool_())
                yield b.select(["fid_eval", "fid_train"]).filter(ok)

        signed = strings.mapInArrow(sign, "sig bigint, fid bigint, side boolean")
        pairs = (
            signed.filter("side").select("sig", F.col("fid").alias("fid_eval"))
            .join(signed.filter("not side").select("sig", F.col("fid").alias("fid_train")), "sig")
            .select("fid_eval", "fid_train").distinct()
        )
        named = lambda side: strings.filter(f"has_{side}").select(F.col("fid").alias(f"fid_{side}"), F.col("words").alias(f"words_{side}"), *(["k"] if side == "eval" else []))
        return pairs.join(named("eval"), "fid_eval").join(named("train"), "fid_train").mapInArrow(verify, "fid_eval bigint, fid_train bigint")

    def sizes(self) -> DataFrame:
        """fid_train, and how many training rows hold it."""
        return self.rows.filter("not is_eval").groupBy(F.col("fid").alias("fid_train")).agg(F.count("*").alias("n_train"))

    def pairs(self) -> DataFrame:
        """eval_id, train_id: every pair of an evaluation and a training row that hold the same problem."""
        chunks = F.greatest(F.ceil(F.col("n_train") / CHUNK), F.lit(1)).cast("int")
        links = self.links.join(self.sizes(), "fid_train").select("fid_eval", "fid_train", chunks.alias("chunks"))
        spread = links.join(self.rows.filter("is_eval").select(F.col("row_id").alias("eval_id"), F.col("fid").alias("fid_eval")), "fid_eval").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        train = self.rows.filter("not is_eval").join(self.links.select(F.col("fid_train").alias("fid")).distinct().join(self.sizes().withColumnRenamed("fid_train", "fid"), "fid"), "fid")
        chunk = F.pmod(F.xxhash64(F.lit(3), "row_id"), chunks.cast("bigint")).cast("int")
        return spread.join(train.select(F.col("row_id").alias("train_id"), F.col("fid").alias("fid_train"), chunk.alias("chunk")), ["fid_train", "chunk"]).select("eval_id", "train_id")

    def overlapping(self) -> DataFrame:
        """row_id of each evaluation row with a link, and its number of training rows, without making the pairs."""
        per = self.links.join(self.sizes(), "fid_train").groupBy(F.col("fid_eval").alias("fid")).agg(F.sum("n_train").alias("n"))
        return self.rows.filter("is_eval").join(per, "fid").select("row_id", "n")


def cross_split_pairs(questions: DataFrame, share: float = SHARE) -> DataFrame:
    """eval_id, train_id of all pairs."""
    return Overlap(questions, share).pairs()


def found(questions: DataFrame, share: float = SHARE) -> DataFrame:
    """The pairs by id, smaller id first."""
    pairs = cross_split_pairs(questions, share)
    return pairs.select(F.least("eval_id", "train_id").alias("question_id_a"), F.greatest("eval_id", "train_id").alias("question_id_b"))


def report(questions: DataFrame, share: float = SHARE) -> DataFrame:
    """Per evaluation split and source: rows, rows that overlap with training, and pairs, added up from group sizes."""
    hit = Overlap(questions, share).overlapping().groupBy(F.col("row_id").alias("question_id")).agg(F.max("n").alias("n"))  # an id may be repeated
    rows = questions.select("question_id", split_name(F.col("split")).alias("split"), "source").filter("split in ('validation', 'test')")
    return rows.join(hit, "question_id", "left").groupBy("split", "source").agg(
        F.count("*").alias("n_rows"), F.count("n").alias("n_overlapping"), F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n_pairs")
    )
