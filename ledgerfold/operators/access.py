"""Point, range and top-k access, set-at-a-time: a batch of probes is one join, never a loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def get(rows: DataFrame, probes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Every probe with the columns of its row and a status: kOk or kNotFound."""
    found = probes.join(rows.select(key, *columns).withColumn("found", F.lit(True)), key, "left")
    return found.withColumn("status", F.when(F.col("found"), "kOk").otherwise("kNotFound")).drop("found")


def contains(rows: DataFrame, probes: DataFrame, key: str) -> DataFrame:
    return probes.join(rows, key, "left_semi")


def missing(rows: DataFrame, probes: DataFrame, key: str) -> DataFrame:
    return probes.join(rows, key, "left_anti")


def between(key: str, low=None, high=None, low_closed: bool = True, high_closed: bool = True) -> Column:
    """An interval of keys with open or closed ends, pushed down to the scan."""
    out = F.lit(True)
    if low is not None:
        out = out & (F.col(key) >= low if low_closed else F.col(key) > low)
    if high is not None:
        out = out & (F.col(key) <= high if high_closed else F.col(key) < high)
    return out


def scan(rows: DataFrame, key: str, start, limit: int) -> DataFrame:
    """The first `limit` rows from start on. A limit of 0 gives nothing."""
    return rows.where(F.col(key) >= start).orderBy(key).limit(limit)


def scan_table(rows: DataFrame, key: str, low, high, limit: int = 0) -> DataFrame:
    """Rows of a closed interval in order; a limit of 0 is none."""
    out = rows.where(between(key, low, high)).orderBy(key)
    return out.limit(limit) if limit else out


def scan_each(rows: DataFrame, key: str, probes: DataFrame, start: str, limit: int) -> DataFrame:
    """For every probe the first `limit` rows with key >= start.

    Distinct keys get dense ranks (by range-partitioned runs: the rank inside a run plus the sizes of the runs before),
    so "the next k keys" is an equi-join on ranks, not an inequality join over all rows."""
    ranked = dense_rank(rows.select(key).distinct(), key)
    # the rank a probe starts at: probes and keys sorted together, the next key's rank carried back
    both = ranked.select(F.col(key).alias("k"), F.col("rank"), F.lit(None).cast("bigint").alias("probe")).unionByName(
        probes.select(F.col(start).alias("k"), F.lit(None).cast("bigint").alias("rank"), F.col("probe").cast("bigint").alias("probe"))
    )
    n = ranked.agg(F.max("rank").alias("n"))
    run = F.floor(F.col("k") / 1024)
    both = both.withColumn("run", run)
    inside = Window.partitionBy("run").orderBy(F.col("k"), F.col("rank").isNotNull()).rowsBetween(0, Window.unboundedFollowing)
    firsts = ranked.groupBy(F.floor(F.col(key) / 1024).alias("run")).agg(F.min("rank").alias("first"))
    runs = both.select("run").distinct().join(firsts, "run", "left")
    later = Window.orderBy("run").rowsBetween(1, Window.unboundedFollowing)
    runs = runs.select("run", F.first("first", ignorenulls=True).over(later).alias("after"))
    at = both.withColumn("here", F.first("rank", ignorenulls=True).over(inside)).where(F.col("probe").isNotNull()).join(runs, "run").select("probe", F.coalesce("here", "after").alias("from"))
    wanted = at.crossJoin(F.broadcast(n)).where(F.col("from").isNotNull()).select("probe", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + (limit - 1), F.col("n")))).alias("rank"))
    return wanted.join(ranked, "rank").select("probe", key, F.col("rank"))


def dense_rank(keys: DataFrame, key: str, span: int = 1024) -> DataFrame:
    """Ranks of distinct whole-number keys, 0 first. Runs of `span` keys rank on their own; only their sizes meet."""
    runs = keys.withColumn("run", F.floor(F.col(key) / span))
    sizes = runs.groupBy("run").agg(F.count("*").alias("size"))
    starts = sizes.select("run", (F.sum("size").over(Window.orderBy("run")) - F.col("size")).alias("start"))
    own = F.row_number().over(Window.partitionBy("run").orderBy(key)) - 1
    return runs.withColumn("own", own).join(starts, "run").select(key, (F.col("start") + F.col("own")).alias("rank"))


def next_key(rows: DataFrame, key: str, high) -> DataFrame:
    """The first key beyond a scanned range, which a phantom guard also locks."""
    return rows.where(F.col(key) > high).agg(F.min(key).alias("next_key"))


def top_by(rows: DataFrame, group: list[str], order: list[Column], k: int = 1) -> DataFrame:
    """The first k rows of each group (a group limit is pushed before the shuffle)."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("place") <= k)


def middle(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """The row at place (n - 1) / 2 of each group."""
    w = Window.partitionBy(*group)
    placed = rows.withColumns({"place": F.row_number().over(w.orderBy(*order)), "n": F.count("*").over(w)})
    return placed.where(F.col("place") == F.floor((F.col("n") - 1) / 2) + 1).drop("place", "n")


def first_gap(keys: DataFrame, key: str) -> DataFrame:
    """gap_at: the first missing key after each key whose successor isn't there."""
    after = F.lead(key).over(Window.partitionBy(F.floor(F.col(key) / 65536)).orderBy(key))
    # inside a stretch the next key tells; at a stretch's end the first key of the next one does
    ends = keys.groupBy(F.floor(F.col(key) / 65536).alias("stretch")).agg(F.min(key).alias("low"))
    rows = keys.withColumn("stretch", F.floor(F.col(key) / 65536)).withColumn("after", after)
    nexts = ends.select((F.col("stretch") - 1).alias("stretch"), F.col("low").alias("next_low"))
    rows = rows.join(nexts, "stretch", "left")
    last = keys.agg(F.max(key).alias("last"))
    rows = rows.crossJoin(F.broadcast(last)).withColumn("after", F.coalesce("after", "next_low"))
    return rows.where((F.col(key) < F.col("last")) & ((F.col("after") > F.col(key) + 1) | F.col("after").isNull())).select((F.col(key) + 1).alias("gap_at"))
