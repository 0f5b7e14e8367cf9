"""Micro-batch runs over files: progress lives in the checkpoint, so a run resumes where it stopped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_files(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 16) -> DataFrame:
    """A Parquet folder as a stream of micro-batches."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def write_available(df: DataFrame, path: str, checkpoint: str) -> None:
    """What is there now into Parquet; a second call adds only what is new."""
    q = df.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True).outputMode("append").start()
    q.awaitTermination()


def running_counts(df: DataFrame, key: str, path: str, checkpoint: str, until: int | None = None, counted: str | None = None) -> DataFrame:
    """T5: rows per key over all batches so far, as checkpointed state; stops early once ``counted`` reaches ``until``.

    Each batch's counts are a table of their own under ``path``; only the one row of ``counted`` is read
    back for the stop, and the result is the table of the last batch.
    """
    spark = df.sparkSession
    held: dict[str, str] = {}

    def keep(batch: DataFrame, number: int) -> None:
        out = f"{path}/batch={number}"
        batch.write.mode("overwrite").parquet(out)
        held["last"] = out

    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    q = counts.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).outputMode("complete").trigger(availableNow=True).start()
    while not q.awaitTermination(1):
        if until is not None and "last" in held and not spark.read.parquet(held["last"]).filter((F.col(key).cast("string") == counted) & (F.col("n") >= until)).isEmpty():
            q.stop()
            break
    return spark.read.parquet(held["last"]) if held else spark.createDataFrame([], counts.schema)
