"""The key-value store as a value: an operation log, and what it answers. Nothing is changed in place; every batch of
operations gives a new store, and a checkpoint folds the log so far to one row for each key."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import stable_partition
from ..sources import tables
from . import access, oplog

STATUS = ("kOk", "kNotFound", "kAlreadyExists", "kCompareFailed", "kInvalidArgument", "kOutOfMemory", "kCorruption", "kOwnerViolation")
COLUMNS = "seq long, key string, op string, value string"


@dataclass
class Store:
    """log: seq, key, op (PUT or DELETE), value; texts. last: the highest seq so far."""

    log: DataFrame
    last: int = -1
    partitions: int = 8
    nodes: int = 2
    max_key: int = 256
    max_value: int = 4096

    def valid(self, key: Column, value: Column | None = None) -> Column:
        ok = (F.octet_length(key) > 0) & (F.octet_length(key) <= self.max_key)
        return ok if value is None else ok & (F.octet_length(value) > 0) & (F.octet_length(value) <= self.max_value)

    def state(self) -> DataFrame:
        return oplog.latest(self.log)

    def apply(self, batch: DataFrame) -> tuple["Store", DataFrame]:
        """Puts and deletes: rows (n, key, op, value), n from 0 up in their order. Gives the new store and each row's
        status: what is empty or too large is refused, deleting an absent key finds nothing."""
        rows = batch.withColumn("ok", F.when(F.col("op") == "PUT", self.valid(F.col("key"), F.col("value"))).otherwise(self.valid(F.col("key"))))
        sane = rows.where("ok").select((F.col("n") + self.last + 1).alias("seq"), "key", "op", "value")
        both = self.log.unionByName(sane)
        before = F.last("op").over(Window.partitionBy("key").orderBy("seq").rowsBetween(-1, -1))
        seen = both.withColumn("before", before).where(F.col("seq") > self.last).select((F.col("seq") - self.last - 1).alias("n"), "before")
        status = F.when(~F.coalesce("ok", F.lit(False)), "kInvalidArgument").when((F.col("op") == "DELETE") & (F.coalesce("before", F.lit("DELETE")) == "DELETE"), "kNotFound").otherwise("kOk")
        last = batch.agg(F.max("n")).first()[0]
        new = Store(both, self.last + 1 + (last if last is not None else -1), self.partitions, self.nodes, self.max_key, self.max_value)
        return new, rows.join(seen, "n", "left").select("n", "key", status.alias("status"))

    def get(self, keys: DataFrame) -> DataFrame:
        return access.get(self.state(), keys, "key", ["value"])

    def scan(self, start: str, limit: int) -> DataFrame:
        return access.scan(self.state(), "key", start, limit).select("key", "value")

    def increment(self, batch: DataFrame) -> DataFrame:
        """What increments give: rows (n, key, delta), in order. An absent key counts from 0; a value that is no whole
        number is refused, and every increment of it."""
        base = batch.join(self.state().select("key", "value"), "key", "left").withColumn("base", F.when(F.col("value").isNull(), F.lit(0).cast("bigint")).otherwise(F.expr("try_cast(value AS BIGINT)")))
        total = F.sum("delta").over(Window.partitionBy("key").orderBy("n"))
        ok = F.col("base").isNotNull()
        return base.select("n", "key", F.when(ok, "kOk").otherwise("kInvalidArgument").alias("status"), F.when(ok, F.col("base") + total).alias("new_value"))

    def placed(self) -> DataFrame:
        """Keys with their partition and the node that owns it."""
        part = stable_partition(F.col("key"), self.partitions)
        return self.state().withColumn("partition", part).withColumn("owner", F.pmod("partition", F.lit(self.nodes)))

    def memory(self) -> DataFrame:
        size = F.octet_length("key") + F.octet_length("value")
        return self.state().agg(F.count("*").alias("rows"), F.coalesce(F.sum(size), F.lit(0)).alias("payload_bytes"))

    def checkpoint(self, path: str, config: str = "") -> "Store":
        """Writes the state and goes on from it: one row for each key."""
        tables.checkpoint(self.state().select("seq", "key", F.lit("PUT").alias("op"), "value"), path, self.last + 1, config)
        log = tables.attach(self.log.sparkSession, path, self.last + 1, config)
        return Store(log, self.last, self.partitions, self.nodes, self.max_key, self.max_value)
