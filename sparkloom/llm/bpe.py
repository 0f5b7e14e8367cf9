"""Byte-level BPE encoding of a whole corpus by a segment tree over adjacent pair ranks.

A text is cut into pieces by the tokenizer's pattern. Within a piece, the leaves of a segment tree
hold the merge ranks of adjacent pairs; its root yields the leftmost pair of lowest rank. A merge
changes at most three leaves, each updated in logarithmic time, until no mergeable pair remains, so
a run of n bytes costs O(n log n) however long it is. Pieces repeat heavily, so each Python worker
keeps the ids of short pieces in a bounded table that is emptied when full (speed only).

Defined cases: an empty list for null and for empty texts; marks of special tokens are plain text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the public vocabularies; a parameter of every operator here.
TOKENIZERS = "/opt/tokenizers"

#: Fixed value: the pattern that splits a text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

NO_RANK = 1 << 30
CACHED_PIECES, CACHED_BYTES = 200_000, 64


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class PairTree:
    """Minimum tree over pair ranks; of equal ranks the leftmost wins."""

    def __init__(self, ranks: list[int]):
        self.base = 1 << max(0, len(ranks) - 1).bit_length()
        self.tree = [NO_RANK] * self.base + ranks + [NO_RANK] * (self.base - len(ranks))
        for i in range(self.base - 1, 0, -1):
            a, b = self.tree[2 * i], self.tree[2 * i + 1]
            self.tree[i] = a if a <= b else b

    def put(self, at: int, rank: int) -> None:
        t, i = self.tree, at + self.base
        t[i] = rank
        while i > 1:
            i >>= 1
            a, b = t[2 * i], t[2 * i + 1]
            least = a if a <= b else b
            if t[i] == least:
                return
            t[i] = least

    def lowest(self) -> int:
        """Place of the leftmost lowest rank, or -1."""
        t = self.tree
        if t[1] == NO_RANK:
            return -1
        i = 1
        while i < self.base:
            i = 2 * i if t[2 * i] == t[i] else 2 * i + 1
        return i - self.base


def encode_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    parts: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
    tree = PairTree([ranks.get(piece[i : i + 2], NO_RANK) for i in range(n - 1)])
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while (i := tree.lowest()) >= 0:
        j = after[i]
        k = after[j]
        parts[i], parts[j] = parts[i] + parts[j], None
        after[i] = k
        if k < n:
            before[k] = i
        if j < n - 1:
            tree.put(j, NO_RANK)
        if i < n - 1:
            tree.put(i, ranks.get(parts[i] + parts[k], NO_RANK) if k < n else NO_RANK)
        if (h := before[i]) >= 0:
            tree.put(h, ranks.get(parts[h] + parts[i], NO_RANK))
    return [ranks[p] for p in parts if p is not None]


class Encoder:
    """Encodes texts with one vocabulary; one per Python worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        import regex

        self.ranks, self.pieces, self.known = ranks, regex.compile(pattern).finditer, {}

    def encode(self, text: str | None) -> list[int]:
        ids: list[int] = []
        known = self.known
        for m in self.pieces(text or ""):
            piece = m.group()
            found = known.get(piece)
            if found is None:
                found = encode_piece(piece.encode("utf-8", "replace"), self.ranks)
                if len(piece) <= CACHED_BYTES:
                    if len(known) >= CACHED_PIECES:
                        known.clear()
                    known[piece] = found
            ids += found
        return ids


_ENCODERS: dict[str, Encoder] = {}


def _encoder(name: str, shared) -> Encoder:
    """The worker's encoder for a broadcast vocabulary."""
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(shared.value)
    return _ENCODERS[name]


def share_ranks(df: DataFrame, vocabulary: str, folder: str):
    """The vocabulary (about 50,000 entries, 1 MB, whatever the corpus) as a broadcast."""
    return df.sparkSession.sparkContext.broadcast(load_ranks(f"{folder}/{vocabulary}.tiktoken"))


def encode_corpus(documents: DataFrame, vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``ids``, the token ids of every text; a scan without any shuffle."""
    name, shared = f"{folder}/{vocabulary}", share_ranks(documents, vocabulary, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(name, shared).encode
        for b in batches:
            for at in range(0, b.num_rows, 256):  # few lists in memory at a time, as texts may be long
                part = b.slice(at, 256)
                ids = pa.array([encode(t.as_py()) for t in part.column(1)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=[id_col, "ids"])

    return documents.select(F.col(id_col).cast("bigint").alias(id_col), F.col(text_col).alias("text")).mapInArrow(run, f"{id_col} bigint, ids array<int>")


def count_tokens(df: DataFrame, keep: list[str], vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS, text_col: str = "text") -> DataFrame:
    """``keep`` columns and ``n_tokens`` of every text, 0 for null and empty texts."""
    name, shared = f"{folder}/{vocabulary}", share_ranks(df, vocabulary, folder)
    kept = df.select(*keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(name, shared).encode
        for b in batches:
            n = pa.array([len(encode(t.as_py())) for t in b.column(b.num_columns - 1)], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], n], names=[*keep, "n_tokens"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", n_tokens bigint"
    return df.select(*keep, F.col(text_col).alias("__text")).mapInArrow(run, schema)
