"""Where rows live: partitioners, promotion to a shared tier, eviction and coherence models, latency accounting."""

from __future__ import annotations

from collections import OrderedDict, deque
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- partitioners: pid, number of nodes -> master and replicas as columns ---


def by_range(key: str | Column, size: int) -> Column:
    return F.floor((F.col(key) if isinstance(key, str) else key) / size)


def round_robin(key: str | Column, partitions: int) -> Column:
    return F.pmod(F.col(key) if isinstance(key, str) else key, F.lit(partitions))


def hashed(pid: Column, nodes: int, copies: int) -> tuple[Column, Column]:
    """Master pid mod nodes; the copies sit on it and the nodes after it, with wrap."""
    master = F.pmod(pid, F.lit(nodes))
    return master, F.transform(F.sequence(F.lit(0), F.lit(copies - 1)), lambda i: F.pmod(master + i, F.lit(nodes)))


def halves(pid: Column, nodes: int) -> tuple[Column, Column]:
    """The first half of the nodes is primary, the second its backup."""
    half = nodes // 2
    master = F.pmod(pid, F.lit(half))
    return master, F.array(master, master + half)


def primary_backup(pid: Column, nodes: int) -> tuple[Column, Column]:
    return F.lit(0).cast("bigint"), F.array(F.lit(0).cast("bigint"), F.lit(1).cast("bigint"))


def star_s(pid: Column, nodes: int) -> tuple[Column, Column]:
    """Master pid mod nodes; the other copy is on node 0, or, where that is the master, on pid mod (nodes - 1) + 1."""
    master = F.pmod(pid, F.lit(nodes))
    return master, F.array(master, F.when(master == 0, F.pmod(pid, F.lit(nodes - 1)) + 1).otherwise(F.lit(0).cast("bigint")))


def star_c(pid: Column, nodes: int) -> tuple[Column, Column]:
    zero = F.lit(0).cast("bigint")
    return zero, F.array(zero, F.pmod(pid, F.lit(nodes - 1)) + 1)


def grouped(pid: Column, nodes: int, group: int) -> tuple[Column, Column]:
    """Nodes form replica groups; in each the copy is at pid mod group from its start."""
    first = F.pmod(pid, F.lit(group))
    return first, F.transform(F.sequence(F.lit(0), F.lit(nodes // group - 1)), lambda i: first + i * group)


PARTITIONERS: dict[str, Callable[[Column, int], tuple[Column, Column]]] = {
    **{f"hash{n if n > 1 else ''}": (lambda pid, nodes, n=n: hashed(pid, nodes, n)) for n in range(1, 9)},
    "hpb": halves,
    "pb": primary_backup,
    "star_s": star_s,
    "star_c": star_c,
    "groups": lambda pid, nodes: grouped(pid, nodes, max(1, nodes // 2)),
}


def placed(rows: DataFrame, pid: Column, scheme: str, nodes: int) -> DataFrame:
    master, replicas = PARTITIONERS[scheme](pid, nodes)
    return rows.withColumns({"master": master, "replicas": replicas})


def even_split(parts: DataFrame, total: int, of: int) -> DataFrame:
    """start and size of part p of `of`, over total rows: the first total mod of parts get one more."""
    base, extra = divmod(total, of)
    return parts.withColumns({"start": F.lit(base) * F.col("p") + F.least("p", F.lit(extra)), "size": F.lit(base) + F.when(F.col("p") < extra, 1).otherwise(0)})


# --- promotion and coherence ---


def promotions(log: DataFrame) -> DataFrame:
    """Per key, when it first became shared: the first access by another node than its owner, an insert by another node
    excepted. log: seq, key, node, owner, op, exists (whether the key was there before)."""
    moves = (F.col("node") != F.col("owner")) & ~((F.col("op") == "PUT") & ~F.col("exists"))
    return log.groupBy("key").agg(F.min(F.when(moves, F.col("seq"))).alias("promoted_at"), F.count("*").alias("accesses"))


def strict_violations(log: DataFrame) -> DataFrame:
    """Under strict mode every other access of another node than the owner is refused; puts are not."""
    status = F.when((F.col("node") != F.col("owner")) & (F.col("op") != "PUT"), "kOwnerViolation").otherwise("kOk")
    return log.withColumn("status", status).groupBy("op", "status").agg(F.count("*").alias("n"))


def coherence_hits(log: DataFrame, variant: str = "write_through") -> DataFrame:
    """Whether a host's read finds its cached copy valid. log: seq, row, host, write (boolean).

    write_through: the host has touched the row since the last write (a write leaves only the writer's copy).
    no_shared_read: a read that misses takes the copy from all others too, so the last toucher must be the same host.
    non_temporal: never; always_coherent: always."""
    reads = ~F.col("write")
    if variant in ("non_temporal", "always_coherent"):
        return log.where(reads).select("seq", "row", "host", F.lit(variant == "always_coherent").alias("hit"))
    past = lambda *by: Window.partitionBy(*by).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    if variant == "no_shared_read":
        hit = F.lag("host").over(Window.partitionBy("row").orderBy("seq")) == F.col("host")
        return log.withColumn("hit", F.coalesce(hit, F.lit(False))).where(reads).select("seq", "row", "host", "hit")
    seen = log.withColumns({"own": F.max("seq").over(past("row", "host")), "written": F.max(F.when(F.col("write"), F.col("seq"))).over(past("row"))})
    hit = F.coalesce(F.col("own") >= F.coalesce("written", F.lit(-1)), F.lit(False))
    return seen.where(reads).select("seq", "row", "host", hit.alias("hit"))


def latency(log: DataFrame, costs: dict[str, int], line: int = 64) -> DataFrame:
    """Charged time by class of access: cache lines touched (at least one) times the class's cost. log: kind, bytes."""
    lines = F.greatest(F.lit(1).cast("bigint"), F.ceil(F.col("bytes") / line))
    cost = F.coalesce(*(F.when(F.col("kind") == k, F.lit(v)) for k, v in costs.items()), F.lit(0))
    return log.groupBy("kind").agg(F.sum(lines).alias("lines"), F.sum(lines * cost).alias("ns"))


def fixed_rate_hits(log: DataFrame, group: str, order: str, rate: int, of: int = 10_000) -> DataFrame:
    """The i-th access of a group hits where i mod `of` is below the rate (of `of`)."""
    i = F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1
    return log.withColumn("hit", F.pmod(i, F.lit(of)) < rate)


# --- eviction policies: each partition is an ordered fold, as every eviction depends on those before ---


class Lru:
    def __init__(self, capacity: int):
        self.capacity, self.rows = capacity, OrderedDict()

    def access(self, key, size: int) -> tuple[bool, int]:
        """Whether it was there, and how many rows had to go."""
        hit, gone = key in self.rows, 0
        self.rows[key] = size
        self.rows.move_to_end(key)
        while sum(self.rows.values()) > self.capacity and len(self.rows) > 1:
            self.rows.popitem(last=False)
            gone += 1
        return hit, gone


class Fifo(Lru):
    def access(self, key, size: int) -> tuple[bool, int]:
        hit, gone = key in self.rows, 0
        self.rows.setdefault(key, size)
        while sum(self.rows.values()) > self.capacity and len(self.rows) > 1:
            self.rows.popitem(last=False)
            gone += 1
        return hit, gone


class Clock:
    """Second chance: an access sets a row's mark, the sweeping hand clears marks and takes the first row without."""

    def __init__(self, capacity: int):
        self.capacity, self.ring, self.mark, self.size, self.used = capacity, deque(), {}, {}, 0

    def access(self, key, size: int) -> tuple[bool, int]:
        hit, gone = key in self.size, 0
        self.mark[key] = True
        if not hit:
            self.ring.append(key)
            self.size[key] = size
            self.used += size
        while self.used > self.capacity and len(self.ring) > 1:
            oldest = self.ring[0]
            if self.mark[oldest] or oldest == key:
                self.mark[oldest] = False
                self.ring.rotate(-1)
                if oldest == key and not any(self.mark[k] for k in self.ring) and len(self.ring) == 1:
                    break
                continue
            self.ring.popleft()
            self.used -= self.size.pop(oldest)
            del self.mark[oldest]
            gone += 1
        return hit, gone


class Eager(Lru):
    """Everything that can go goes at once: only the row at hand stays."""

    def access(self, key, size: int) -> tuple[bool, int]:
        hit, gone = key in self.rows, len(self.rows) - (key in self.rows)
        self.rows = OrderedDict({key: size})
        return hit, gone


class Never(Lru):
    def access(self, key, size: int) -> tuple[bool, int]:
        hit = key in self.rows
        self.rows[key] = size
        return hit, 0


POLICIES = {"lru": Lru, "fifo": Fifo, "clock": Clock, "eager": Eager, "never": Never}


def evictions(log: DataFrame, policy: str, capacity: int) -> DataFrame:
    """hit and evicted (rows that had to go) of each access. log: part, seq, key, size. Rows come sorted to the fold in
    batches, and it holds no more than a partition's cached rows."""
    make = POLICIES[policy]

    def fold(batches):
        import pandas as pd

        part, cache = None, None
        for df in batches:
            out = []
            for p, seq, key, size in df.itertuples(index=False):
                if p != part:
                    part, cache = p, make(capacity)
                out.append((p, seq, key, *cache.access(key, size)))
            yield pd.DataFrame(out, columns=["part", "seq", "key", "hit", "evicted"])

    return log.select("part", "seq", "key", "size").repartition("part").sortWithinPartitions("part", "seq").mapInPandas(fold, "part long, seq long, key long, hit boolean, evicted long")
