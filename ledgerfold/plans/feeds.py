"""Queries of sources and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators.oplog import events_log, table
from ..shipping import shared_folder
from ..sources import generators, runlog, trace
from ..streaming import oplog_stream
from .registry import ACCESS, LOG, query
from .transactions import writes


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share."""
    return f"{shared_folder(spark)}/ledgerfold/{name}-{uuid.uuid4().hex}"


def trace_lines(spark, d):
    log = events_log(spark, d)
    key = F.concat(F.lit("k"), F.col("key").cast("string"))
    return log.select(F.col("seq").alias("line_no"), F.when(F.col("seq") % 50 == 0, F.lit("# a comment")).when(F.col("seq") % 50 == 1, F.concat(trace.line(F.col("op"), key, F.col("value")), F.lit(" x"))).otherwise(trace.line(F.col("op"), key, F.col("value"))).alias("value"))


@query("trace_parse", f"WITH {LOG} SELECT seq AS line_no, op, 'k' || key AS key, value AS len, CASE WHEN seq % 50 = 1 THEN 'tail' END AS error FROM oplog WHERE seq % 50 <> 0")
def trace_parse(spark, d):
    return trace.parse(trace_lines(spark, d))


@query("trace_order_check", "SELECT event_id FROM (SELECT event_id, user_id, lag(user_id) OVER (PARTITION BY event_id // 20 ORDER BY event_id) AS before FROM events) WHERE user_id <= before")
def trace_order_check(spark, d):
    rows = table(spark, d, "events").select("event_id", "user_id", F.floor(F.col("event_id") / 20).alias("scan"))
    return trace.in_order(rows, ["scan"], "event_id", "user_id").select("event_id")


@query("trace_scans", f"""WITH {LOG}, life AS (SELECT key, value, seq AS born, op, lead(seq) OVER (PARTITION BY key ORDER BY seq) AS gone FROM oplog WHERE op <> 'GET'),
s AS (SELECT seq, key AS start FROM oplog WHERE event_type = 'view'),
r AS (SELECT s.seq, s.start, l.key, l.value, row_number() OVER (PARTITION BY s.seq ORDER BY l.key) AS place FROM s JOIN life l ON l.op = 'PUT' AND l.born < s.seq AND (l.gone IS NULL OR l.gone >= s.seq) AND l.key >= s.start)
SELECT seq, start, place, key, value FROM r WHERE place <= 10""")
def trace_scans(spark, d):
    log = events_log(spark, d)
    scans = log.where("event_type = 'view'").select("seq", F.col("key").alias("start"))
    return trace.scans_as_of(log, scans, 10, 1024)


@query("log_parse", "SELECT event_id AS line, cast(event_id % 997 AS DOUBLE) AS commits, CASE WHEN event_id % 10 = 0 THEN NULL ELSE round(value, 2) END AS latency FROM events WHERE event_type <> 'error'")
def log_parse(spark, d):
    e = table(spark, d, "events")
    text = F.concat_ws(" ", F.lit(" I0101 worker"), F.when(F.col("event_type") != "error", "total_commit:").otherwise("retry:"), (F.col("event_id") % 997).cast("string"), F.lit("p99"), F.when(F.col("event_id") % 10 == 0, "n/a").otherwise(F.round("value", 2).cast("string")))
    return runlog.figures(e.select(F.col("event_id").alias("line"), text.alias("value")), "total_commit:", {"commits": 3, "latency": 5})


@query("generated_tables", "SELECT * FROM (VALUES ('customer', 600), ('district', 20), ('history', 600), ('item', 500), ('new_order', 180), ('orders', 600), ('stock', 1000), ('warehouse', 2)) t(name, n)")
def generated_tables(spark, d):
    made = generators.order_entry(spark, 2, 30, 500)
    out = None
    for name in ("customer", "district", "history", "item", "new_order", "orders", "stock", "warehouse"):
        one = made[name].agg(F.count("*").cast("int").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("generated_trace")
def generated_trace(spark, d):
    return generators.trace(spark, 10_000, 1_000, {"GET": 0.5, "PUT": 0.4, "SCAN": 0.1}).groupBy("op").agg(F.count("*").alias("n"), F.countDistinct("key").alias("keys"))


@query("stream_epoch_counts", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS epoch_start, count(*) AS txns FROM events GROUP BY 1")
def stream_epoch_counts(spark, d):
    out, state = scratch(spark, "epochs"), scratch(spark, "state")
    counts = oplog_stream.epoch_counts(oplog_stream.events(spark, f"{d}/events.parquet"), 3600, "60 days")
    oplog_stream.run_once(counts, out, state, "update")
    rows = spark.read.parquet(out)
    return rows.groupBy(F.col("epoch_start").cast("timestamp_ntz").alias("epoch_start")).agg(F.max_by("txns", "batch").alias("txns"))


@query("stream_commits", f"WITH {ACCESS}, acc AS (SELECT * FROM access), res AS (SELECT epoch, key, min(txn) FILTER (kind = 'R') AS r, min(txn) FILTER (kind = 'W') AS w FROM acc GROUP BY epoch, key) SELECT a.epoch, count(*) AS txns, count(*) FILTER (kind = 'R' OR coalesce(w >= txn, true)) AS committed FROM acc a JOIN res USING (epoch, key) GROUP BY a.epoch")
def stream_commits(spark, d):
    out, state = scratch(spark, "commits"), scratch(spark, "state")

    def to_log(batch):
        return batch.select(F.col("event_id").alias("txn"), F.floor(F.col("event_id") / 100).alias("epoch"), F.col("user_id").alias("key"), F.when(writes(), "W").otherwise("R").alias("kind"))

    oplog_stream.commit_in_batches(oplog_stream.events(spark, f"{d}/events.parquet"), to_log, out, state)
    return spark.read.parquet(out).groupBy("epoch").agg(F.count("*").alias("txns"), F.count(F.when(F.col("committed"), 1)).alias("committed"))


@query("stream_placement")
def stream_placement(spark, d):
    out, state = scratch(spark, "placement"), scratch(spark, "state")
    stream = oplog_stream.events(spark, f"{d}/events.parquet")
    op = F.when(F.col("event_type") == "purchase", "PUT").when(F.col("event_type") == "error", "DELETE").when(F.col("event_type") == "signup", "MOVE_OUT").otherwise("GET")
    ops = stream.select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), (F.col("event_id") % 4).alias("node"), (F.col("user_id") % 4).alias("owner"), op.alias("op"))
    oplog_stream.run_once(oplog_stream.placements(ops), out, state, "update")
    return spark.read.parquet(out).groupBy("key").agg(*(F.max_by(c, "batch").alias(c) for c in ("shared", "moved_in", "moved_out")))
