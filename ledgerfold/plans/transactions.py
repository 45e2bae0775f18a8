"""Queries of commit decisions, isolation rules and run statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics, oplog, txn
from ..operators.oplog import events_log, table
from .registry import ACCESS, query


def writes():
    return F.col("event_type").isin("purchase", "signup", "error")


def access_log(spark, d):
    """Every event is a transaction; its first key is the user, the second one (a read) a neighbour's."""
    e = table(spark, d, "events").select(F.col("event_id").alias("txn"), F.floor(F.col("event_id") / 100).alias("epoch"), F.col("user_id").alias("key"), F.when(writes(), "W").otherwise("R").alias("kind"))
    return e


#: A log whose transactions have two accesses: the event's own and a read of the next user.
TWO_KEYS = "acc AS (SELECT txn, epoch, key, kind FROM access UNION ALL SELECT txn, epoch, (key + 1) % 150 AS key, 'R' AS kind FROM access)"
RESERVED = "res AS (SELECT epoch, key, min(txn) FILTER (kind = 'R') AS first_read, min(txn) FILTER (kind = 'W') AS first_write FROM acc GROUP BY epoch, key)"
FLAGS = "f AS (SELECT a.epoch, a.txn, coalesce(bool_or(a.kind = 'R' AND r.first_write < a.txn), false) AS raw, coalesce(bool_or(a.kind = 'W' AND r.first_read < a.txn), false) AS war, coalesce(bool_or(a.kind = 'W' AND r.first_write < a.txn), false) AS waw, bool_or(a.kind = 'W') AS writes FROM acc a JOIN res r USING (epoch, key) GROUP BY a.epoch, a.txn)"
TWO = f"WITH {ACCESS}, {TWO_KEYS}, {RESERVED}, {FLAGS}"
ONE = f"WITH {ACCESS}, acc AS (SELECT * FROM access), {RESERVED}, {FLAGS}"


def two_keys(spark, d):
    log = access_log(spark, d)
    return log.unionByName(log.select("txn", "epoch", ((F.col("key") + 1) % 150).alias("key"), F.lit("R").alias("kind")))


@query("aria_reservations", f"{TWO} SELECT * FROM res")
def aria_reservations(spark, d):
    return txn.reservations(two_keys(spark, d))


@query("aria_conflicts", f"{TWO} SELECT * FROM f")
def aria_conflicts(spark, d):
    return txn.conflicts(two_keys(spark, d))


def _mode(mode, fine):
    @query(f"aria_commit_{mode}", f"{TWO} SELECT epoch, count(*) AS txns, count(*) FILTER (NOT writes OR (NOT waw AND {fine})) AS committed FROM f GROUP BY epoch")
    def run(spark, d):
        return txn.commits(two_keys(spark, d), mode).groupBy("epoch").agg(F.count("*").alias("txns"), F.count(F.when(F.col("committed"), 1)).alias("committed"))

    return run


_mode("si", "true")
_mode("reorder", "NOT (raw AND war)")
_mode("strict", "NOT raw")


@query("aria_one_key", f"{ONE} SELECT count(*) FILTER (raw) AS raw, count(*) FILTER (war) AS war, count(*) FILTER (waw) AS waw, count(*) FILTER (NOT waw AND NOT (raw AND war)) AS committed FROM f")
def aria_one_key(spark, d):
    out = txn.commits(access_log(spark, d), "reorder", read_only_commits=False)
    return out.agg(*(F.count(F.when(F.col(c), 1)).alias(c) for c in ("raw", "war", "waw", "committed")))


@query("aria_readonly_fastpath", f"{TWO} SELECT writes, count(*) AS txns, count(*) FILTER (NOT writes OR (NOT waw AND NOT raw)) AS committed FROM f GROUP BY writes")
def aria_readonly_fastpath(spark, d):
    return txn.commits(two_keys(spark, d), "strict").groupBy("writes").agg(F.count("*").alias("txns"), F.count(F.when(F.col("committed"), 1)).alias("committed"))


@query("silo_validation", "WITH e AS (SELECT event_id AS seq, user_id AS key, event_type IN ('purchase', 'signup', 'error') AS w FROM events) SELECT seq, key, EXISTS (SELECT 1 FROM e b WHERE b.key = a.key AND b.w AND b.seq > a.seq AND b.seq <= a.seq + 100) AS stale FROM e a WHERE NOT w")
def silo_validation(spark, d):
    return txn.stale_reads(events_log(spark, d), 100, writes())


@query("lock_overlap_conflicts", "WITH h AS (SELECT event_id AS txn, user_id AS key, event_id AS s, event_id + 40 AS e, event_type IN ('purchase', 'signup', 'error') AS x FROM events) SELECT a.key, a.txn AS txn1, b.txn AS txn2 FROM h a JOIN h b ON a.key = b.key AND a.txn < b.txn AND a.e > b.s AND (a.x OR b.x)")
def lock_overlap_conflicts(spark, d):
    log = events_log(spark, d)
    holds = log.select(F.col("seq").alias("txn"), "key", F.col("seq").alias("start"), (F.col("seq") + 40).alias("end"), writes().alias("exclusive"))
    return txn.overlapping_locks(holds, 64)


@query("no_wait_aborts", "WITH h AS (SELECT event_id AS txn, user_id AS key, event_id AS s, event_id + 40 AS e, event_type IN ('purchase', 'signup', 'error') AS x FROM events), p AS (SELECT DISTINCT b.txn FROM h a JOIN h b ON a.key = b.key AND a.txn < b.txn AND a.e > b.s AND (a.x OR b.x)) SELECT x AS exclusive, count(*) AS holds, count(p.txn) AS denied FROM h LEFT JOIN p USING (txn) GROUP BY x")
def no_wait_aborts(spark, d):
    log = events_log(spark, d)
    holds = log.select(F.col("seq").alias("txn"), "key", F.col("seq").alias("start"), (F.col("seq") + 40).alias("end"), writes().alias("exclusive"))
    denied = txn.overlapping_locks(holds, 64).select(F.col("txn2").alias("txn")).distinct().withColumn("d", F.lit(1))
    return holds.join(denied, "txn", "left").groupBy("exclusive").agg(F.count("*").alias("holds"), F.count("d").alias("denied"))


@query("sundial_lease", "WITH e AS (SELECT event_id AS seq, user_id AS key, event_type IN ('purchase', 'signup', 'error') AS w FROM events), s AS (SELECT *, coalesce(max(CASE WHEN w THEN seq END) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS wts, min(CASE WHEN w THEN seq END) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM e) SELECT seq, key, wts, seq + 100 > wts + 200 AS renewed, seq + 100 > wts + 200 AND coalesce(nxt <= seq + 100, false) AS failed FROM s WHERE NOT w")
def sundial_lease(spark, d):
    return txn.leases(events_log(spark, d), 200, writes())


@query("calvin_grant")
def calvin_grant(spark, d):
    return txn.ordered_locks(two_keys(spark, d)).groupBy("epoch").agg(F.count("*").alias("txns"), F.count(F.when(F.col("granted"), 1)).alias("granted"))


@query("star_phase_split", f"WITH {ACCESS}, {TWO_KEYS}, p AS (SELECT epoch, txn, count(DISTINCT key % 8) AS parts FROM acc GROUP BY 1, 2) SELECT epoch, count(*) FILTER (parts > 1) AS cross_partition, count(*) FILTER (parts = 1) AS single_partition FROM p GROUP BY epoch")
def star_phase_split(spark, d):
    parts = two_keys(spark, d).groupBy("epoch", "txn").agg(F.countDistinct(F.col("key") % 8).alias("parts"))
    return parts.groupBy("epoch").agg(F.count(F.when(F.col("parts") > 1, 1)).alias("cross_partition"), F.count(F.when(F.col("parts") == 1, 1)).alias("single_partition"))


@query("granule_sets", f"WITH {ACCESS}, {TWO_KEYS} SELECT epoch, count(DISTINCT key % 8) AS partitions, count(DISTINCT key // 10) AS granules FROM acc GROUP BY epoch")
def granule_sets(spark, d):
    return two_keys(spark, d).groupBy("epoch").agg(F.countDistinct(F.col("key") % 8).alias("partitions"), F.countDistinct(F.floor(F.col("key") / 10)).alias("granules"))


@query("group_commit_epochs", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS epoch_start, count(*) AS txns, max(ts) AS flushed FROM events GROUP BY 1")
def group_commit_epochs(spark, d):
    return txn.epochs(table(spark, d, "events"), "ts", 3600)


@query("commit_latency", "WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS e, max(ts) AS f FROM events GROUP BY 1), l AS (SELECT x.event_type, datediff('microsecond', x.ts, w.f) AS us FROM events x JOIN w ON time_bucket(INTERVAL 1 HOUR, x.ts) = w.e) SELECT event_type, quantile_disc(us, 0.5) AS p50, quantile_disc(us, 0.75) AS p75, quantile_disc(us, 0.95) AS p95, quantile_disc(us, 0.99) AS p99 FROM l GROUP BY event_type")
def commit_latency(spark, d):
    events = table(spark, d, "events")
    flushed = txn.epochs(events, "ts", 3600)
    waits = events.withColumn("epoch_start", F.date_trunc("hour", "ts").cast("timestamp_ntz")).join(flushed, "epoch_start")
    us = (F.unix_micros(F.col("flushed").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))).alias("us")
    return metrics.nearest_rank(waits.select("event_type", us), "us", [50, 75, 95, 99], ["event_type"])


@query("min_max_tid", "SELECT event_id // 10 AS txn, greatest(coalesce(max(CASE WHEN event_type IN ('view', 'click') THEN user_id END), 0), coalesce(max(CASE WHEN event_type NOT IN ('view', 'click') THEN user_id END), 0)) + 1 AS commit_id FROM events GROUP BY 1")
def min_max_tid(spark, d):
    e = table(spark, d, "events")
    reads = F.col("event_type").isin("view", "click")
    log = e.select(F.floor(F.col("event_id") / 10).alias("txn"), F.when(reads, F.col("user_id")).alias("read_version"), F.when(~reads, F.col("user_id")).alias("write_version"))
    return txn.commit_ids(log)


# --- statistics ---


@query("percentile_nearest_rank", "SELECT event_type, quantile_disc(v, 0.5) AS p50, quantile_disc(v, 0.75) AS p75, quantile_disc(v, 0.95) AS p95, quantile_disc(v, 0.99) AS p99 FROM (SELECT event_type, cast(round(value * 100) AS BIGINT) AS v FROM events) GROUP BY event_type")
def percentile_nearest_rank(spark, d):
    return metrics.nearest_rank(events_log(spark, d), "value", [50, 75, 95, 99], ["event_type"])


@query("percentile_floor", "WITH s AS (SELECT event_type, list(cast(round(value * 100) AS BIGINT) ORDER BY cast(round(value * 100) AS BIGINT)) AS v FROM events GROUP BY 1) SELECT event_type, v[50 * (len(v) - 1) // 100 + 1] AS p50, v[99 * (len(v) - 1) // 100 + 1] AS p99 FROM s")
def percentile_floor(spark, d):
    return metrics.floor_rank(events_log(spark, d), "value", [50, 99], ["event_type"])


@query("cdf_points", "WITH c AS (SELECT v AS value, count(*) AS c FROM (SELECT cast(round(value * 100) AS BIGINT) AS v FROM events) GROUP BY 1), p AS (SELECT value, c, cast(sum(c) OVER (ORDER BY value) AS BIGINT) AS place, cast(sum(c) OVER () AS BIGINT) AS n FROM c) SELECT value, place, n FROM p WHERE place // greatest(1, cast(floor(n * 0.99 / 100) AS BIGINT)) > (place - c) // greatest(1, cast(floor(n * 0.99 / 100) AS BIGINT)) AND place <= n * 0.99")
def cdf_points(spark, d):
    return metrics.cdf(events_log(spark, d), "value", 100)


@query("throughput_per_tick", "SELECT time_bucket(INTERVAL 6 HOUR, ts) AS second, count(*) FILTER (event_type <> 'error') AS commits, count(*) FILTER (event_type = 'error') AS aborts FROM events GROUP BY 1")
def throughput_per_tick(spark, d):
    return metrics.per_second(table(spark, d, "events"), "ts", {"commits": F.col("event_type") != "error", "aborts": F.col("event_type") == "error"}, 6 * 3600)


@query("throughput_trimmed", "SELECT cast(sum(n) AS BIGINT) AS total, cast(sum(n) AS DOUBLE) / 20 AS average FROM (SELECT datediff('day', DATE '2024-01-01', cast(ts AS DATE)) AS tick, count(*) FILTER (event_type <> 'error') AS n FROM events GROUP BY 1) WHERE tick > 5 AND tick <= 25")
def throughput_trimmed(spark, d):
    tick = F.datediff(F.col("ts").cast("date"), F.to_date(F.lit("2024-01-01")))
    ticks = table(spark, d, "events").groupBy(tick.alias("tick")).agg(F.count(F.when(F.col("event_type") != "error", 1)).alias("n"))
    return metrics.trimmed_average(ticks, "tick", "n", 5, 25)


@query("abort_rate", "SELECT user_id % 10 AS worker, count(*) AS txns, round(100.0 * count(*) FILTER (event_type = 'error') / nullif(count(*), 0), 6) AS abort_percent FROM events GROUP BY 1")
def abort_rate(spark, d):
    rate = metrics.ratio(F.count(F.when(F.col("event_type") == "error", 1)), F.count("*"))
    return table(spark, d, "events").groupBy((F.col("user_id") % 10).alias("worker")).agg(F.count("*").alias("txns"), F.round(rate, 6).alias("abort_percent"))


@query("moving_average", "SELECT event_id, cast(floor(sum(v) OVER w / (count(v) OVER w + 1)) AS BIGINT) AS average FROM (SELECT event_id, user_id % 10 AS worker, cast(round(value) AS BIGINT) AS v FROM events) WINDOW w AS (PARTITION BY worker ORDER BY event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)")
def moving_average(spark, d):
    rows = table(spark, d, "events").select("event_id", (F.col("user_id") % 10).alias("worker"), F.round("value").cast("bigint").alias("v"))
    return metrics.moving_average(rows, "v", "event_id", ["worker"], 50).select("event_id", "average")


@query("placement_mode", "WITH c AS (SELECT c_nationkey, c_custkey % 4 AS node, count(*) AS c FROM customer GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c DESC, node) AS i, sum(c) OVER (PARTITION BY c_nationkey) AS pages FROM c) SELECT c_nationkey, node AS dominant, cast(pages - c AS BIGINT) AS misplaced, cast(pages AS BIGINT) AS pages FROM r WHERE i = 1")
def placement_mode(spark, d):
    rows = table(spark, d, "customer").select("c_nationkey", (F.col("c_custkey") % 4).alias("node"))
    return metrics.dominant(rows, ["c_nationkey"], "node")


@query("message_stats", "SELECT event_type AS type, count(*) AS messages, cast(sum(length(props)) AS BIGINT) AS bytes FROM events GROUP BY 1")
def message_stats(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("type")).agg(F.count("*").alias("messages"), F.sum(F.octet_length("props")).cast("bigint").alias("bytes"))


KINDS = ["click", "error", "purchase", "signup", "view"]
PIVOT = "SELECT user_id % 10 AS x, " + ", ".join(f"count(*) FILTER (event_type = '{k}') AS {k}" for k in KINDS) + " FROM events GROUP BY 1"


@query("result_pivot", PIVOT)
def result_pivot(spark, d):
    long = table(spark, d, "events").groupBy((F.col("user_id") % 10).alias("x"), "event_type").agg(F.count("*").alias("n"))
    return metrics.matrix(long, "x", "event_type", "n", KINDS).fillna(0)


@query("result_transpose", "SELECT user_id % 10 AS x, event_type AS series, count(*) AS value FROM events GROUP BY 1, 2")
def result_transpose(spark, d):
    return metrics.transposed(result_pivot(spark, d), "x", KINDS).where("value > 0")


@query("result_concat", f"SELECT p.*, b.baseline, greatest(p.click, p.error, p.purchase, p.signup, p.view) AS top, cast(ceil(greatest(p.click, p.error, p.purchase, p.signup, p.view) / 100.0) * 100 AS BIGINT) AS axis FROM ({PIVOT}) p JOIN (SELECT user_id % 10 AS x, count(DISTINCT user_id) AS baseline FROM events GROUP BY 1) b USING (x)")
def result_concat(spark, d):
    baseline = table(spark, d, "events").groupBy((F.col("user_id") % 10).alias("x")).agg(F.countDistinct("user_id").alias("baseline"))
    top = F.greatest(*KINDS)
    return result_pivot(spark, d).join(baseline, "x").withColumns({"top": top, "axis": (F.ceil(top / 100) * 100).cast("bigint")})


@query("versions_of_key", "SELECT user_id AS key, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS version FROM events WHERE event_type IN ('purchase', 'signup')")
def versions_of_key(spark, d):
    from pyspark.sql import Window

    puts = events_log(spark, d).where("op = 'PUT'")
    return puts.select("key", "seq", F.row_number().over(Window.partitionBy("key").orderBy("seq")).cast("bigint").alias("version"))


@query("capacity_running_sum", "SELECT event_id, cast(sum(v) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS used, sum(v) OVER (PARTITION BY user_id ORDER BY event_id) > 100000 AS over_budget FROM (SELECT event_id, user_id, cast(round(value * 100) AS BIGINT) AS v FROM events)")
def capacity_running_sum(spark, d):
    from pyspark.sql import Window

    used = F.sum(oplog.cents("value")).over(Window.partitionBy("user_id").orderBy("event_id"))
    return table(spark, d, "events").select("event_id", used.alias("used"), (used > 100000).alias("over_budget"))
