"""Structured Streaming over the operation log: epochs, batch commit in micro-batches, row placement with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import txn


def events(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Events as they arrive in files; the time gets its zone, which watermarks need. The path is given as a pattern, as
    Spark watches folders or patterns and a table may be one file."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{path[:-1]}[{path[-1]}]").withColumn("ts", F.col("ts").cast("timestamp"))


def epoch_counts(stream: DataFrame, seconds: int, late: str = "1 hour") -> DataFrame:
    """Transactions of each epoch, by event time; rows later than `late` behind the newest are left out."""
    windows = stream.withWatermark("ts", late).groupBy(F.window("ts", f"{seconds} seconds").alias("w"))
    return windows.agg(F.count("*").alias("txns")).select(F.col("w.start").alias("epoch_start"), "txns")


def commit_in_batches(stream: DataFrame, to_log, path: str, state: str, mode: str = "reorder") -> None:
    """Decides every micro-batch as one batch of transactions and writes the outcome under path/batch=N. A batch that is
    run again after a failure overwrites its own folder, so each is written once in effect. to_log makes the access log
    (epoch, txn, key, kind) of a batch."""

    def apply(batch: DataFrame, number: int) -> None:
        txn.commits(to_log(batch), mode).select("epoch", "txn", "committed").write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = stream.writeStream.foreachBatch(apply).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()


def placements(stream: DataFrame) -> DataFrame:
    """Placement of each row as a state machine over its accesses: private until another node than its owner touches it
    (a first insert excepted), then shared until its owner moves it out. stream: key, seq, node, owner, op ("PUT",
    "GET", "DELETE", "MOVE_OUT"). Gives, for each key and micro-batch, the moves so far and where the row is.

    A key's accesses of one micro-batch are ordered by seq; across batches the state carries on."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        there, shared, moved_in, moved_out = state.get if state.exists else (False, False, 0, 0)
        rows = pd.concat(list(frames)).sort_values("seq")
        for node, owner, op in zip(rows["node"], rows["owner"], rows["op"]):
            if op == "MOVE_OUT":
                if shared and node == owner:
                    shared, moved_out = False, moved_out + 1
                continue
            if node != owner and not shared and there:
                shared, moved_in = True, moved_in + 1
            if op == "PUT":
                there = True
            elif op == "DELETE":
                there, shared = False, False
        state.update((there, shared, moved_in, moved_out))
        yield pd.DataFrame({"key": [key[0]], "shared": [shared], "moved_in": [moved_in], "moved_out": [moved_out]})

    return stream.groupBy("key").applyInPandasWithState(step, "key long, shared boolean, moved_in long, moved_out long", "there boolean, shared boolean, moved_in long, moved_out long", "update", GroupStateTimeout.NoTimeout)


def run_once(stream: DataFrame, path: str, state: str, mode: str) -> None:
    """Works off what is there. Results of each micro-batch go to path/batch=N."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
