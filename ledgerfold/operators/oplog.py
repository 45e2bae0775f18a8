"""The normal form: an operation log of rows (seq, key, op, value), and the tables it folds to.

State is never stored: it is the fold of the log up to a point. Values are whole cents, so sums are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows, or groups, that a task of dealt() holds.
ROWS_A_TASK = 500_000


def dealt(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """n rows by keys, in as many partitions as leave each ROWS_A_TASK: where nearly each row is a group of its own, a
    task's memory is then the same at any size, and a partial aggregation before the shuffle would only hold them all."""
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(least, -(-n // ROWS_A_TASK)), *keys)


def cents(column: str | Column) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.round(c * 100).cast("bigint")


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as operations on a key: purchases and signups put, errors delete, the rest get."""
    kind = F.when(F.col("event_type").isin("purchase", "signup"), "PUT").when(F.col("event_type") == "error", "DELETE").otherwise("GET")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("key"), kind.alias("op"), cents("value").alias("value"), "event_type", "ts")


def latest(log: DataFrame) -> DataFrame:
    """Last-writer-wins state: the live keys with their value and the sequence number of their last change. One partial
    aggregation by key, so a hot key costs no more than any other."""
    last = log.where(F.col("op") != "GET").groupBy("key").agg(F.max_by(F.struct("op", "value"), "seq").alias("w"), F.max("seq").alias("seq"))
    return last.where(F.col("w.op") == "PUT").select("key", F.col("w.value").alias("value"), "seq")


def versions(log: DataFrame) -> DataFrame:
    """State with a version: the number of puts since the key's last delete."""
    changes = log.where(F.col("op") != "GET")
    deleted = changes.groupBy("key").agg(F.max(F.when(F.col("op") == "DELETE", F.col("seq"))).alias("gone"))
    live = changes.join(deleted, "key").where((F.col("op") == "PUT") & (F.col("seq") > F.coalesce("gone", F.lit(-1))))
    return live.groupBy("key").agg(F.max_by("value", "seq").alias("value"), F.count("*").alias("version"))


def as_of(log: DataFrame, span: int = 4096) -> DataFrame:
    """Every get with what it sees: hit and value of the last change of its key before it.

    The log of a key is cut into stretches of `span` sequence numbers. Inside a stretch the last change is carried by a
    window; what a stretch starts with is carried over the few rows that sum the stretches up. So a key that holds a
    third of the log is spread over many tasks."""
    change = F.when(F.col("op") != "GET", F.struct(F.when(F.col("op") == "PUT", F.col("value")).alias("value"), (F.col("op") == "PUT").alias("live")))
    rows = log.withColumn("w", change).withColumn("part", F.floor(F.col("seq") / span))
    inside = Window.partitionBy("key", "part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.where(F.col("w").isNotNull()).groupBy("key", "part").agg(F.max_by("w", "seq").alias("w"))
    parts = rows.select("key", "part").distinct().join(ends, ["key", "part"], "left")
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select("key", "part", F.last("w", ignorenulls=True).over(before).alias("start"))
    seen = rows.withColumn("seen", F.last("w", ignorenulls=True).over(inside)).where(F.col("op") == "GET").join(carried, ["key", "part"])
    got = F.coalesce("seen", "start")
    return seen.select("seq", "key", F.coalesce(got["live"], F.lit(False)).alias("hit"), F.when(got["live"], got["value"]).alias("value"))


def counters(log: DataFrame, resets: Column, sets: Column, adds: Column) -> DataFrame:
    """Running value of a counter per key: sets starts it anew with the row's value, resets with 0, adds adds. Rows of
    adds come back with new_value. A stretch runs from a reset to the next."""
    order = Window.partitionBy("key").orderBy("seq")
    rows = log.withColumn("stretch", F.sum(F.when(resets | sets, 1).otherwise(0)).over(order))
    run = Window.partitionBy("key", "stretch").orderBy("seq")
    delta = F.when(sets | adds, F.col("value")).otherwise(F.lit(0).cast("bigint"))
    return rows.withColumn("new_value", F.sum(delta).over(run)).where(adds).select("seq", "key", "new_value")


def compare_exchange(log: DataFrame) -> DataFrame:
    """Compare-and-swap in order of seq, per key: rows (seq, key, expected, desired). The swap happens where the current
    value is the one expected; an absent row matches an empty expectation (null). Each result depends on the one before,
    so a key's swaps are folded in order: an array fold, inside the engine."""
    steps = F.sort_array(F.collect_list(F.struct("seq", "expected", "desired")))
    zero = F.struct(F.lit(None).cast("bigint").alias("current"), F.lit(0).cast("bigint").alias("done"), F.lit(0).cast("bigint").alias("failed"))

    def step(acc: Column, x: Column) -> Column:
        fits = acc["current"].eqNullSafe(x["expected"])
        return F.struct(F.when(fits, x["desired"]).otherwise(acc["current"]).alias("current"), (acc["done"] + fits.cast("bigint")).alias("done"), (acc["failed"] + (~fits).cast("bigint")).alias("failed"))

    folded = log.groupBy("key").agg(F.aggregate(steps, zero, step).alias("s"))
    return folded.select("key", F.col("s.current").alias("value"), F.col("s.done").alias("exchanged"), F.col("s.failed").alias("failed"))


def apply_changes(base: DataFrame, changes: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """base with the last change of each key laid over it: columns that the change gives (non-null) win, type "delete"
    removes, new keys come in. changes: key, order columns, type, columns."""
    last = changes.groupBy(key).agg(F.max_by(F.struct(F.col("type"), *columns), F.struct(*order)).alias("c"))
    both = base.join(last, key, "full")
    return both.where(F.coalesce(F.col("c.type") != "delete", F.lit(True))).select(key, *(F.coalesce(F.col(f"c.{c}"), base[c]).alias(c) for c in columns))


def neighbours(rows: DataFrame, key: str, by: list[str] | None = None) -> DataFrame:
    """prev_key and next_key of each row in key order (of each group of by)."""
    order = Window.partitionBy(*(by or [])).orderBy(key)
    return rows.withColumns({"prev_key": F.lag(key).over(order), "next_key": F.lead(key).over(order)})


def admit(log: DataFrame, capacity: int, partitions: int) -> DataFrame:
    """Admission to partitions of limited capacity: a put of `size` bytes is taken where the partition's payload stays
    within capacity, deletes free. What was refused does not count, so each answer depends on those before; every
    partition is an ordered fold of its own, read as a stream of sorted rows and held as a dictionary of its live keys."""
    rows = log.where(F.col("op") != "GET").withColumn("part", F.pmod(F.col("key"), F.lit(partitions))).select("part", "seq", "key", "op", "size")

    def fold(batches):
        import pandas as pd

        part, used, live = None, 0, {}
        for df in batches:
            out = []
            for p, seq, key, op, size in df.itertuples(index=False):
                if p != part:
                    part, used, live = p, 0, {}
                if op == "DELETE":
                    gone = live.pop(key, None)
                    used -= gone or 0
                    out.append((p, seq, key, "kNotFound" if gone is None else "kOk", used))
                elif used - live.get(key, 0) + size > capacity:
                    out.append((p, seq, key, "kOutOfMemory", used))
                else:
                    used += size - live.get(key, 0)
                    live[key] = size
                    out.append((p, seq, key, "kOk", used))
            yield pd.DataFrame(out, columns=["part", "seq", "key", "status", "used"])

    return rows.repartition("part").sortWithinPartitions("part", "seq").mapInPandas(fold, "part long, seq long, key long, status string, used long")
