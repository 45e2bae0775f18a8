"""Tables in and out: CSV matrices, statistics lines, change logs, checkpoints that say what they hold."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import shared_folder


def written(rows: DataFrame, label: str) -> DataFrame:
    """rows as a Parquet table in the folder that all executors share."""
    path = f"{shared_folder(rows.sparkSession)}/ledgerfold/{label}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def read_csv(spark: SparkSession, path: str, schema: str, columns: list[str] | None = None) -> DataFrame:
    rows = spark.read.csv(path, header=True, schema=schema)
    return rows.select(*columns) if columns else rows


def write_csv(rows: DataFrame, path: str, sep: str = ",") -> None:
    """One file, for reports: rows are few by nature (a matrix, points of a curve)."""
    rows.coalesce(1).write.csv(path, header=True, sep=sep)


def statistics(row: DataFrame, section: str) -> DataFrame:
    """A row of counters as lines section.name=value."""
    names = row.columns
    long = row.select(*(F.col(n).cast("double").alias(n) for n in names)).unpivot([], names, "name", "value")
    return long.select(F.concat(F.lit(f"{section}."), "name", F.lit("="), F.col("value").cast("string")).alias("value"))


def append_log(changes: DataFrame, path: str) -> None:
    """A redo log: Parquet by epoch, appended; a reader orders by epoch and seq."""
    changes.write.mode("append").partitionBy("epoch").parquet(path)


def checkpoint(state: DataFrame, path: str, version: int, config: str) -> None:
    """A snapshot under path/version=N, and a metadata row beside it, written last: without it the snapshot is dirty."""
    target = f"{path}/version={version}"
    state.write.mode("overwrite").parquet(f"{target}/data")
    columns = state.schema.simpleString()
    state.sparkSession.createDataFrame([(version, config, columns)], "version long, config string, columns string").coalesce(1).write.mode("overwrite").parquet(f"{target}/meta")


def attach(spark: SparkSession, path: str, version: int, config: str) -> DataFrame:
    """The snapshot, if it is clean and was written under the same configuration."""
    target = f"{path}/version={version}"
    try:
        meta = spark.read.parquet(f"{target}/meta").first()
    except Exception as e:
        raise ValueError(f"version {version} is not clean: it has no metadata") from e
    if meta["config"] != config:
        raise ValueError("the snapshot was written under another configuration")
    state = spark.read.parquet(f"{target}/data")
    if meta["columns"] != state.schema.simpleString():
        raise ValueError("the snapshot has other columns than its metadata says")
    return state
