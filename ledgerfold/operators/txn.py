"""Commit decisions as dataflow over an access log: rows (txn, epoch, key, kind), kind "R" or "W"."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MODES = ("si", "reorder", "strict")


def reservations(log: DataFrame) -> DataFrame:
    """The smallest transaction that reads, and that writes, each key of an epoch."""
    smallest = lambda kind: F.min(F.when(F.col("kind") == kind, F.col("txn")))
    return log.groupBy("epoch", "key").agg(smallest("R").alias("first_read"), smallest("W").alias("first_write"))


def conflicts(log: DataFrame) -> DataFrame:
    """Per transaction: raw (reads a key a smaller one writes), war (writes a key a smaller one reads), waw, and whether
    it only reads. Two shuffles: by (epoch, key), by (epoch, txn); a hot key is summed up before the first."""
    flags = {
        "raw": (F.col("kind") == "R") & (F.col("first_write") < F.col("txn")),
        "war": (F.col("kind") == "W") & (F.col("first_read") < F.col("txn")),
        "waw": (F.col("kind") == "W") & (F.col("first_write") < F.col("txn")),
    }
    marked = log.join(reservations(log), ["epoch", "key"])
    any_of = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    return marked.groupBy("epoch", "txn").agg(*(any_of(c).alias(n) for n, c in flags.items()), any_of(F.col("kind") == "W").alias("writes"))


def commits(log: DataFrame, mode: str, read_only_commits: bool = True) -> DataFrame:
    """Deterministic batch commit. A write after a smaller transaction's write aborts in every mode; then "si" commits,
    "reorder" commits unless both raw and war hold, "strict" unless raw does. Transactions without writes commit where
    read_only_commits is set."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    fine = {"si": F.lit(True), "reorder": ~(F.col("raw") & F.col("war")), "strict": ~F.col("raw")}[mode]
    ok = ~F.col("waw") & fine
    return conflicts(log).withColumn("committed", (~F.col("writes") | ok) if read_only_commits else ok)


def rounds(log: DataFrame, mode: str, most: int, keep) -> tuple[DataFrame, int]:
    """Aborted transactions lead the next batch. Runs up to `most` rounds over one epoch's log; keep writes a table and
    reads it again, which cuts the lineage. Gives txn and the round it committed in (null: none), and the rounds run."""
    done, rest = None, log
    for k in range(1, most + 1):
        decided = keep(commits(rest, mode).select("txn", "committed"))
        won = decided.where("committed").select("txn", F.lit(k).alias("round"))
        done = won if done is None else done.unionByName(won)
        lost = decided.where("not committed").select("txn")
        if lost.isEmpty():
            break
        rest = keep(rest.join(lost, "txn", "left_semi"))
    return log.select("txn").distinct().join(done, "txn", "left"), k


def stale_reads(log: DataFrame, delay: int, writes: Column) -> DataFrame:
    """Version check at commit: a read at seq commits at seq + delay; it is stale where the same key was written in
    between. The last write up to the commit decides, found by one as-of pass: reads (at commit time) and writes are
    sorted together by key."""
    w = log.where(writes).select("key", F.col("seq").alias("at"), F.col("seq").alias("written"), F.lit(None).cast("bigint").alias("read_at"))
    r = log.where(~writes).select("key", (F.col("seq") + delay).alias("at"), F.lit(None).cast("bigint").alias("written"), F.col("seq").alias("read_at"))
    order = Window.partitionBy("key").orderBy(F.col("at"), F.col("read_at").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    seen = r.unionByName(w).withColumn("last_write", F.last("written", ignorenulls=True).over(order)).where(F.col("read_at").isNotNull())
    return seen.select(F.col("read_at").alias("seq"), "key", F.coalesce(F.col("last_write") > F.col("read_at"), F.lit(False)).alias("stale"))


def overlapping_locks(holds: DataFrame, width: int) -> DataFrame:
    """Pairs of lock holds on one key that overlap in time and conflict (one of them exclusive). holds: txn, key, start,
    end (exclusive, at most start + width), exclusive. Time is cut into buckets of `width`: a hold lies in two at most,
    and a pair is found in the bucket where its later one starts. An equi-join, no inequality join over a key."""
    bucket = lambda c: F.floor(F.col(c) / width)
    held = holds.withColumn("b", F.explode(F.sequence(bucket("start"), F.floor((F.col("end") - 1) / width))))
    later = holds.withColumn("b", bucket("start"))
    a = held.select("key", "b", *(F.col(c).alias(f"{c}1") for c in ("txn", "start", "end", "exclusive")))
    b = later.select("key", "b", *(F.col(c).alias(f"{c}2") for c in ("txn", "start", "end", "exclusive")))
    earlier = (F.col("start1") < F.col("start2")) | ((F.col("start1") == F.col("start2")) & (F.col("txn1") < F.col("txn2")))
    return a.join(b, ["key", "b"]).where(earlier & (F.col("end1") > F.col("start2")) & (F.col("exclusive1") | F.col("exclusive2"))).select("key", "txn1", "txn2")


def leases(log: DataFrame, lease: int, writes: Column) -> DataFrame:
    """Lease rule: a read at version wts (the last write before it) is valid to wts + lease; at its commit time (its own
    seq + lease / 2) it is renewed where needed, and the renewal fails if the key has been written since."""
    order = Window.partitionBy("key").orderBy("seq")
    wts = F.coalesce(F.last(F.when(writes, F.col("seq")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.first(F.when(writes, F.col("seq")), ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    rows = log.withColumns({"wts": wts, "next_write": after}).where(~writes)
    commit = F.col("seq") + lease // 2
    renews = commit > F.col("wts") + lease
    return rows.select("seq", "key", "wts", renews.alias("renewed"), (renews & F.coalesce(F.col("next_write") <= commit, F.lit(False))).alias("failed"))


def ordered_locks(log: DataFrame) -> DataFrame:
    """Ordered locking: within an epoch transactions ask for their keys in order of txn; one that is denied any waits
    for the next batch and holds nothing. Who gets a key depends on the grants before, so each epoch is folded in order.
    log: epoch, txn, key, kind. Gives epoch, txn, granted."""
    asks = log.groupBy("epoch", "txn").agg(F.collect_set(F.when(F.col("kind") == "W", F.col("key"))).alias("w"), F.collect_set(F.when(F.col("kind") == "R", F.col("key"))).alias("r"))

    def fold(batches):
        import pandas as pd

        epoch, readers, writers = None, set(), set()
        for df in batches:
            out = []
            for e, txn, w, r in df.itertuples(index=False):
                if e != epoch:
                    epoch, readers, writers = e, set(), set()
                w, r = set(w), set(r)
                ok = not (w & (readers | writers)) and not (r & writers)
                if ok:
                    writers |= w
                    readers |= r
                out.append((e, txn, ok))
            yield pd.DataFrame(out, columns=["epoch", "txn", "granted"])

    return asks.repartition("epoch").sortWithinPartitions("epoch", "txn").select("epoch", "txn", "w", "r").mapInPandas(fold, "epoch long, txn long, granted boolean")


def epochs(log: DataFrame, ts: str, seconds: int) -> DataFrame:
    """Group commit: an epoch is a tumbling window; all its transactions become durable at its last one's time."""
    return log.groupBy(F.window(ts, f"{seconds} seconds").alias("w")).agg(F.count("*").alias("txns"), F.max(ts).alias("flushed")).select(F.col("w.start").alias("epoch_start"), "txns", "flushed")


def commit_ids(log: DataFrame) -> DataFrame:
    """Commit id of a transaction: above the largest version it read or wrote. log: txn, read_version, write_version."""
    return log.groupBy("txn").agg((F.greatest(F.coalesce(F.max("read_version"), F.lit(0)), F.coalesce(F.max("write_version"), F.lit(0))) + 1).alias("commit_id"))
