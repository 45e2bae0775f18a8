"""Smaller computations of the catalogue: keys, versions, roll-back, replay, accounting."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import txn
from ..operators.oplog import cents, events_log, table
from .registry import ACCESS, LOG, query
from .transactions import FLAGS, RESERVED, TWO_KEYS, two_keys, writes


@query("three_way_compare", "SELECT o_orderkey, sign(cast(CASE WHEN (o_custkey, o_orderstatus) < (700, 'O') THEN -1 WHEN (o_custkey, o_orderstatus) = (700, 'O') THEN 0 ELSE 1 END AS INTEGER)) AS cmp FROM orders")
def three_way_compare(spark, d):
    """Composite keys compare column by column."""
    key = F.struct("o_custkey", "o_orderstatus")
    probe = F.struct(F.lit(700).cast("bigint").alias("o_custkey"), F.lit("O").alias("o_orderstatus"))
    return table(spark, d, "orders").select("o_orderkey", F.when(key < probe, -1).when(key == probe, 0).otherwise(1).cast("tinyint").alias("cmp"))


@query("multi_key_sort", "SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment, c_custkey) AS place FROM customer")
def multi_key_sort(spark, d):
    order = Window.partitionBy("c_nationkey").orderBy("c_mktsegment", "c_custkey")
    return table(spark, d, "customer").select("c_custkey", F.row_number().over(order).cast("bigint").alias("place"))


@query("district_permutation", "SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY (c_custkey * 7919 + 7) % 10007, c_custkey) AS o_id FROM customer")
def district_permutation(spark, d):
    """A permutation of each district's customers that depends on nothing but the seed."""
    order = Window.partitionBy("c_nationkey").orderBy((F.col("c_custkey") * 7919 + 7) % 10007, "c_custkey")
    return table(spark, d, "customer").select("c_nationkey", "c_custkey", F.row_number().over(order).cast("bigint").alias("o_id"))


@query("epoch_versions", "SELECT event_id, (event_id // 100) * 4294967296 + (event_id % 100) AS version, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place FROM events")
def epoch_versions(spark, d):
    """Epoch in the high 32 bits, place in the epoch in the low ones; ordering by it is ordering by both."""
    version = F.shiftleft(F.floor(F.col("event_id") / 100), 32) + F.col("event_id") % 100
    rows = table(spark, d, "events").select("event_id", "user_id", version.alias("version"))
    return rows.select("event_id", "version", F.row_number().over(Window.partitionBy("user_id").orderBy("version")).cast("bigint").alias("place"))


@query("round_robin_parts", "SELECT event_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) % 10 AS part FROM events")
def round_robin_parts(spark, d):
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    return table(spark, d, "events").select("event_id", (place % 10).cast("bigint").alias("part"))


@query("repeated_keys_in_txn", "SELECT event_id // 10 AS txn, count(*) - count(DISTINCT user_id) AS repeated FROM events GROUP BY 1 HAVING count(*) > count(DISTINCT user_id)")
def repeated_keys_in_txn(spark, d):
    out = table(spark, d, "events").groupBy(F.floor(F.col("event_id") / 10).alias("txn")).agg((F.count("*") - F.countDistinct("user_id")).alias("repeated"))
    return out.where("repeated > 0")


@query("rollback_filtered_state", f"WITH {ACCESS}, {TWO_KEYS}, {RESERVED}, {FLAGS}, ok AS (SELECT txn FROM f WHERE NOT writes OR (NOT waw AND NOT (raw AND war))) SELECT user_id AS key, arg_max(cast(round(value * 100) AS BIGINT), event_id) AS value, count(*) AS writes FROM events WHERE event_type IN ('purchase', 'signup') AND event_id IN (SELECT txn FROM ok) GROUP BY 1")
def rollback_filtered_state(spark, d):
    """State after roll-back: changes of aborted transactions never come to be."""
    won = txn.commits(two_keys(spark, d), "reorder").where("committed").select(F.col("txn").alias("event_id"))
    changes = table(spark, d, "events").where(F.col("event_type").isin("purchase", "signup")).join(won, "event_id", "left_semi")
    return changes.groupBy(F.col("user_id").alias("key")).agg(F.max_by(cents("value"), "event_id").alias("value"), F.count("*").alias("writes"))


@query("command_replay", "SELECT user_id % 16 AS granule, cast(sum(CASE event_type WHEN 'purchase' THEN 3 WHEN 'signup' THEN 5 ELSE 0 END * (event_id % 7)) AS BIGINT) AS state, max(event_id) AS replayed_to FROM events GROUP BY 1")
def command_replay(spark, d):
    """Commands run again from their logged inputs, granule by granule."""
    step = F.when(F.col("event_type") == "purchase", 3).when(F.col("event_type") == "signup", 5).otherwise(0) * (F.col("event_id") % 7)
    return table(spark, d, "events").groupBy((F.col("user_id") % 16).alias("granule")).agg(F.sum(step).alias("state"), F.max("event_id").alias("replayed_to"))


@query("retired_bytes", f"WITH {LOG}, g AS (SELECT key, seq, op, length(cast(value AS VARCHAR)) + 16 AS slot, lag(op) OVER (PARTITION BY key ORDER BY seq) AS before FROM oplog WHERE op <> 'GET') SELECT key % 8 AS part, count(*) AS deletes, cast(sum(slot) AS BIGINT) AS retired FROM g WHERE op = 'DELETE' AND before = 'PUT' GROUP BY 1")
def retired_bytes(spark, d):
    """Bytes that deletes leave to be reclaimed."""
    changes = events_log(spark, d).where("op <> 'GET'").withColumn("before", F.lag("op").over(Window.partitionBy("key").orderBy("seq")))
    slot = F.octet_length(F.col("value").cast("string")) + 16
    return changes.where("op = 'DELETE' and before = 'PUT'").groupBy((F.col("key") % 8).alias("part")).agg(F.count("*").alias("deletes"), F.sum(slot).cast("bigint").alias("retired"))


@query("lock_success_ratio", f"WITH {ACCESS}, {TWO_KEYS}, {RESERVED} SELECT epoch, count(*) AS asked, count(*) FILTER (kind = 'R' OR first_write >= txn) AS granted FROM acc JOIN res USING (epoch, key) GROUP BY epoch")
def lock_success_ratio(spark, d):
    log = two_keys(spark, d)
    asks = log.join(txn.reservations(log), ["epoch", "key"])
    ok = (F.col("kind") == "R") | (F.col("first_write") >= F.col("txn"))
    return asks.groupBy("epoch").agg(F.count("*").alias("asked"), F.count(F.when(ok, 1)).alias("granted"))


@query("average_with_bias", "SELECT event_type, round(sum(cast(round(value * 100) AS BIGINT)) / (count(*) + 0.1), 4) AS average FROM events GROUP BY 1")
def average_with_bias(spark, d):
    """The mean as the run reports give it: over the number of samples and a tenth."""
    return events_log(spark, d).groupBy("event_type").agg(F.round(F.sum("value") / (F.count("*") + F.lit(0.1).cast("double")), 4).alias("average"))


@query("memory_by_class", "SELECT event_type AS class, cast(sum(length(props)) AS BIGINT) AS bytes, cast(sum(CASE WHEN user_id % 3 = 0 THEN length(props) ELSE 0 END) AS BIGINT) AS coherent_bytes FROM events GROUP BY 1")
def memory_by_class(spark, d):
    size = F.octet_length("props")
    return table(spark, d, "events").groupBy(F.col("event_type").alias("class")).agg(F.sum(size).cast("bigint").alias("bytes"), F.sum(F.when(F.col("user_id") % 3 == 0, size).otherwise(0)).cast("bigint").alias("coherent_bytes"))


@query("delta_columns", "SELECT c_custkey, cast(round(c_acctbal * 100) AS BIGINT) AS balance FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal < 0")
def delta_columns(spark, d):
    """What replication sends of a row: its key and the columns that change. Filter and columns reach the scan."""
    return table(spark, d, "customer").where("c_mktsegment = 'BUILDING' and c_acctbal < 0").select("c_custkey", cents("c_acctbal").alias("balance"))


@query("fixed_width_keys", "SELECT event_id, lpad(cast(event_id AS VARCHAR), 8, '0') AS key8, lpad(cast(user_id AS VARCHAR), 15, '0') AS key15 FROM events")
def fixed_width_keys(spark, d):
    return table(spark, d, "events").select("event_id", scalar.zero_padded(F.col("event_id"), 8).alias("key8"), scalar.zero_padded(F.col("user_id"), 15).alias("key15"))


@query("commit_outcomes", "SELECT CASE WHEN event_type = 'error' THEN 'ABORT_NORETRY' WHEN event_id % 17 = 0 THEN 'ABORT' ELSE 'COMMIT' END AS outcome, count(*) AS n, count(*) FILTER (event_type IN ('purchase', 'signup', 'error')) AS writers FROM events GROUP BY 1")
def commit_outcomes(spark, d):
    outcome = F.when(F.col("event_type") == "error", "ABORT_NORETRY").when(F.col("event_id") % 17 == 0, "ABORT").otherwise("COMMIT")
    return table(spark, d, "events").groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"), F.count(F.when(writes(), 1)).alias("writers"))


@query("item_semi_join", "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49) AND p_size < 20")
def item_semi_join(spark, d):
    big = table(spark, d, "lineitem").where("l_quantity >= 49").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, d, "part").where("p_size < 20").select("p_partkey").join(big, "p_partkey", "left_semi")
