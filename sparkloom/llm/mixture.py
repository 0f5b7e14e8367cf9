"""Mixing sources to target shares of tokens by systematic sampling.

Within a source every document gets the same expected number of copies, the source's target over
its size, at most the cap. Expected copies are prefix-summed over the documents in order of size,
one random offset is added, and a copy is emitted for each integer boundary crossed; so a document
is used floor or ceiling of its expectation, never more than the cap, and since neighbours in the
order are alike in size, the tokens drawn stay close to the target.

The order is a range partitioning by source, size and id, which splits a large source over many
tasks; ranks are made by counts per partition and source, of which there are few, and added up.

Defined cases: documents without tokens or without source take no part; a source without documents
contributes nothing and is reported with all of its target missing; ties in size are ordered by id;
of repeated rows of ``targets`` the smallest counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.bpe import TOKENIZERS, count_tokens
from sparkloom.session import cut_lineage, partitions_for

#: Targets are joined by broadcast up to this many rows, else by shuffle.
BROADCAST_ROWS = 100_000


def ranked_documents(documents: DataFrame, vocabulary: str, folder: str) -> DataFrame:
    """doc_id, source, n_tokens, and the rank of each document within its source by size."""
    sized = count_tokens(documents.filter("source is not null").select("doc_id", "source", "text"), ["doc_id", "source"], vocabulary, folder).filter("n_tokens > 0")
    sized = cut_lineage(sized)  # else the sampling of ranges would count all tokens once more
    parts = partitions_for(documents.sparkSession)
    ordered = cut_lineage(sized.repartitionByRange(parts, "source", "n_tokens", "doc_id").sortWithinPartitions("source", "n_tokens", "doc_id").withColumn("part", F.spark_partition_id()))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ordered.groupBy("source", "part").agg(F.count("*").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = Window.partitionBy("source", "part").orderBy("n_tokens", "doc_id")
    return ordered.withColumn("place", F.row_number().over(within)).join(starts, ["source", "part"]).select("doc_id", "source", "n_tokens", (F.col("place") + F.col("start")).alias("rank"))


def plan(targets: DataFrame, sizes: DataFrame, seed: int) -> DataFrame:
    """mix_id, source, target_tokens, max_repeats, size of the source, expected copies, offset in [0, 1)."""
    held = ("target_permille", "max_repeats", "budget_tokens")
    one = targets.groupBy("mix_id", "source_name").agg(F.min(F.struct(*held)).alias("t")).select("mix_id", "source_name", *[f"t.{c}" for c in held])
    wanted = one.select(
        "mix_id", F.col("source_name").alias("source"), "target_permille", "max_repeats", "budget_tokens", (F.col("target_permille") * F.col("budget_tokens") / 1000).alias("target_tokens")
    )
    offset = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "mix_id", "source"), 11) / F.lit(float(1 << 53))
    return (
        wanted.join(sizes, "source", "left")
        .withColumn("copies", F.least(F.col("max_repeats").cast("double"), F.try_divide("target_tokens", "size_tokens")))
        .withColumn("offset", offset)
    )


class Mixture:
    def __init__(self, documents: DataFrame, targets: DataFrame, seed: int = 146959810, vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS):
        self.ranked = cut_lineage(ranked_documents(documents, vocabulary, folder))
        sizes = self.ranked.groupBy("source").agg(F.sum("n_tokens").alias("size_tokens"), F.count("*").alias("n_docs"))
        self.plan = cut_lineage(plan(targets, sizes, seed))
        small = self.plan.count() <= BROADCAST_ROWS
        p = self.plan.filter("copies > 0").select("mix_id", "source", "copies", "offset")
        upto = lambda r: F.floor(F.col("copies") * r + F.col("offset"))
        self.drawn = (
            self.ranked.join(F.broadcast(p) if small else p, "source")
            .withColumn("n_copies", (upto(F.col("rank")) - upto(F.col("rank") - 1)).cast("int"))
            .filter("n_copies > 0")
            .select("mix_id", "source", "doc_id", "n_tokens", "n_copies")
        )

    def rows(self) -> DataFrame:
        """A row for each copy: mix_id, source, doc_id, copy_no from 1, n_tokens."""
        return self.drawn.select("mix_id", "source", "doc_id", F.explode(F.sequence(F.lit(1), "n_copies")).alias("copy_no"), "n_tokens")

    def shares(self) -> DataFrame:
        """Target and reached tokens and permille of each source of each mix, and what is missing."""
        got = self.drawn.groupBy("mix_id", "source").agg(
            F.sum(F.col("n_tokens") * F.col("n_copies")).alias("tokens"), F.sum("n_copies").cast("bigint").alias("n_rows"), F.max("n_copies").alias("most_copies")
        )
        out = self.plan.join(got, ["mix_id", "source"], "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)).cast("bigint"))
        whole = F.sum("tokens").over(Window.partitionBy("mix_id"))
        return out.select(
            "mix_id", "source", "target_permille", F.col("target_tokens").cast("bigint").alias("target_tokens"), "tokens",
            F.round(F.coalesce(F.try_divide(F.col("tokens") * 1000, whole), F.lit(0.0)), 1).alias("reached_permille"),
            F.greatest(F.lit(0), F.col("target_tokens").cast("bigint") - F.col("tokens")).alias("missing_tokens"),
            F.coalesce("n_rows", F.lit(0)).cast("bigint").alias("n_rows"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
            (F.coalesce("copies", F.lit(0.0)) >= F.col("max_repeats")).alias("capped"),
        )
