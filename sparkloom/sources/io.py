"""Reading and writing of datasets."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.text import escaped


def read_split(spark: SparkSession, path: str, split: str, take: int | None = None) -> DataFrame:
    """One split of a dataset partitioned by split; the partition filter reaches the scan."""
    df = spark.read.parquet(path).filter(F.col("split") == split)
    return df if take is None else df.limit(take)


def write_splits(df: DataFrame, path: str) -> None:
    """K1: a dataset partitioned by split."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def replace_dataset(df: DataFrame, path: str) -> None:
    """K2: the new version is complete beside the old one before it takes its place, and the old one is kept until it has."""
    spark = df.sparkSession
    fresh = f"{path}.__new"
    df.write.mode("overwrite").parquet(fresh)
    hadoop = spark._jvm.org.apache.hadoop.fs
    target, source, old = hadoop.Path(path), hadoop.Path(fresh), hadoop.Path(f"{path}.__old")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(old, True)
    if fs.exists(target) and not fs.rename(target, old):
        raise OSError(f"could not move {path} aside")
    if not fs.rename(source, target):
        fs.rename(old, target)
        raise OSError(f"could not move {fresh} to {path}")
    fs.delete(old, True)


def write_by_outcome(df: DataFrame, path: str, flag: str = "is_correct") -> None:
    """Correct and failed rows apart; rows without a verdict are in neither."""
    df.filter(F.col(flag).isNotNull()).write.mode("overwrite").partitionBy(flag).parquet(path)


def write_trajectories(df: DataFrame, path: str) -> None:
    """K6: JSON lines; a task index that is no number is replaced by the row's position."""
    df.withColumn("task_index", F.coalesce(F.col("task_index").try_cast("bigint"), F.col("trajectory_idx"))).write.mode("overwrite").json(path)


def annotation_records(df: DataFrame, columns: list[str]) -> DataFrame:
    """K5: flat string columns, HTML-escaped."""
    return df.select(*[escaped(F.col(c).cast("string")).alias(c) for c in columns])


def read_calibration(spark: SparkSession, path: str) -> DataFrame:
    """A JSON map of problem types to settings as rows: problem_type, settings (JSON text)."""
    with open(path) as f:
        held = json.load(f)
    return spark.createDataFrame([(k, json.dumps(v)) for k, v in held.items()], "problem_type string, settings string")


def cleaning_config(spark: SparkSession, entries: dict[int, dict]) -> DataFrame:
    """Index to edits, as the table that ``validate.edited`` joins; places may be written as "4,5"."""
    places = lambda x: [int(p) for p in str(x).split(",")] if isinstance(x, str) and x else list(x or [])
    rows = [(int(i), places(e.get("to_remove")), {int(k): v for k, v in (e.get("to_replace") or {}).items()}, e.get("initial_msg_count"), e.get("expected_final_msg_count")) for i, e in entries.items()]
    return spark.createDataFrame(rows, "idx bigint, to_remove array<int>, to_replace map<int,string>, initial_msg_count int, expected_final_msg_count int")


def best_checkpoints(folder: str) -> list[tuple[str, int]]:
    """(split, step) of the archived checkpoints in a folder."""
    out = []
    for split in sorted(os.listdir(folder)) if os.path.isdir(folder) else []:
        steps = [int(s) for s in os.listdir(os.path.join(folder, split)) if s.isdigit()] if os.path.isdir(os.path.join(folder, split)) else []
        out += [(split, s) for s in sorted(steps)]
    return out


def append_results(df: DataFrame, path: str) -> None:
    """K7: results of a run added to those of earlier ones; files are only ever added, so no lock is needed."""
    df.write.mode("append").json(path)


def write_ranking(ranked: DataFrame, path: str, most: int = 10) -> None:
    """K8: the best runs as JSON."""
    ranked.orderBy("score", "run").limit(most).write.mode("overwrite").json(path)


def text_report(df: DataFrame, title: str) -> DataFrame:
    """K9: a report's rows as lines of text under a title, in the order of the first column."""
    shown = [F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit("-"))) for c in df.columns]
    lines = df.select(F.lit(1).alias("__part"), F.col(df.columns[0]).cast("string").alias("__key"), F.concat_ws(", ", *shown).alias("value"))
    head = df.sparkSession.createDataFrame([(0, "", title)], "__part int, __key string, value string")
    return head.unionByName(lines).orderBy("__part", "__key", "value").select("value")


def write_report(df: DataFrame, title: str, path: str) -> list[str]:
    """K9: the report as a text file, and its lines for the console. Reports are small."""
    report = text_report(df, title)
    report.coalesce(1).write.mode("overwrite").text(path)
    return [r["value"] for r in report.collect()]


def read_arrow(spark: SparkSession, folder: str) -> DataFrame:
    """A local folder of Arrow files (streams or files) as a table; each file is read by a task of its own, batch by batch."""
    import pyarrow as pa

    def open_any(path: str):
        source = pa.memory_map(path)
        try:
            return pa.ipc.open_stream(source)
        except pa.ArrowInvalid:
            return pa.ipc.open_file(source)

    def batches_of(reader):
        return (reader.get_batch(i) for i in range(reader.num_record_batches)) if hasattr(reader, "num_record_batches") else iter(reader)

    files = sorted(os.path.join(folder, f) for f in os.listdir(folder) if f.endswith(".arrow"))
    if not files:
        raise FileNotFoundError(f"no Arrow files in {folder}")
    from pyspark.sql.pandas.types import from_arrow_schema

    def run(paths):
        for b in paths:
            for path in b.column(0).to_pylist():
                yield from batches_of(open_any(path))

    schema = from_arrow_schema(open_any(files[0]).schema)
    return spark.createDataFrame([(f,) for f in files], "path string").repartition(len(files)).mapInArrow(run, schema)


def first_queries(df: DataFrame, column: str, order: str, most: int = 10) -> DataFrame:
    """The first non-blank queries of a dataset in order."""
    return df.filter(F.trim(F.coalesce(F.col(column), F.lit(""))) != "").orderBy(order).limit(most).select(order, column)
