"""Synthetic tables of the four workloads, by projections over ranges: any size, in parallel, the same for a seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar

ITEMS, DISTRICTS, CUSTOMERS = 100_000, 10, 3_000


def noise(*parts: Column, seed: int = 0) -> Column:
    """A number from 0 to 1 that depends on the parts alone, so any row can be made again."""
    return F.pmod(F.xxhash64(*parts, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)


def between(low: int, high: int, *parts: Column, seed: int = 0) -> Column:
    return (F.floor(noise(*parts, seed=seed) * (high - low + 1)) + low).cast("bigint")


def letters(size: int, *parts: Column, seed: int = 0) -> Column:
    return F.left(F.repeat(F.sha2(F.concat_ws("-", *(p.cast("string") for p in parts), F.lit(str(seed))), 256), F.lit(size // 64 + 1)), F.lit(size))


def order_entry(spark: SparkSession, warehouses: int, customers: int = CUSTOMERS, items: int = ITEMS, seed: int = 7) -> dict[str, DataFrame]:
    """warehouse, district, customer, history, new_order, orders, order_line, item and stock."""
    c = F.col
    warehouse = spark.range(1, warehouses + 1).select(c("id").cast("int").alias("w_id"), letters(10, c("id"), seed=seed).alias("w_name"), (between(0, 2000, c("id"), seed=seed) / 10000).alias("w_tax"), F.lit(30000.0).alias("w_ytd"))
    district = spark.range(warehouses * DISTRICTS).select((F.floor(c("id") / DISTRICTS) + 1).cast("int").alias("d_w_id"), (c("id") % DISTRICTS + 1).cast("int").alias("d_id"), (between(0, 2000, c("id"), seed=seed + 1) / 10000).alias("d_tax"), F.lit(3000.0).alias("d_ytd"), F.lit(customers + 1).alias("d_next_o_id"))
    n = customers
    key = spark.range(warehouses * DISTRICTS * n).select("id", (F.floor(c("id") / (DISTRICTS * n)) + 1).cast("int").alias("w"), (F.floor(c("id") / n) % DISTRICTS + 1).cast("int").alias("d"), (c("id") % n + 1).cast("int").alias("k"))
    bad = noise(c("id"), seed=seed + 2) < 0.1
    number = F.when(c("k") <= 1000, c("k") - 1).otherwise(scalar.nurand(between(0, 255, c("id"), seed=seed + 3), between(0, 999, c("id"), seed=seed + 4), 0, 999))
    customer = key.select(c("w").alias("c_w_id"), c("d").alias("c_d_id"), c("k").alias("c_id"), letters(16, c("id"), seed=seed).alias("c_first"), F.lit("OE").alias("c_middle"), scalar.last_name(number).alias("c_last"), F.when(bad, "BC").otherwise("GC").alias("c_credit"), (between(0, 5000, c("id"), seed=seed + 5) / 10000).alias("c_discount"), F.lit(-10.0).alias("c_balance"), F.lit(10.0).alias("c_ytd_payment"), F.lit(1).alias("c_payment_cnt"), F.lit(0).alias("c_delivery_cnt"), letters(300, c("id"), seed=seed + 6).alias("c_data"))
    history = key.select(c("w").alias("h_w_id"), c("d").alias("h_d_id"), c("w").alias("h_c_w_id"), c("d").alias("h_c_d_id"), c("k").alias("h_c_id"), F.lit(10.0).alias("h_amount"))
    # the permutation of a district's customers over its orders: an affine map, one to one as its factor has no common divisor
    step = next(s for s in range(n // 3 + 1, n + 2) if _coprime(s, n))
    orders = key.select(c("w").alias("o_w_id"), c("d").alias("o_d_id"), c("k").alias("o_id"), ((c("k") * step + c("w") * 31 + c("d") * 7) % n + 1).cast("int").alias("o_c_id"), F.when(c("k") <= n * 7 // 10, between(1, 10, c("id"), seed=seed + 7)).otherwise(F.lit(0)).cast("int").alias("o_carrier_id"), between(5, 15, c("id"), seed=seed + 8).cast("int").alias("o_ol_cnt"))
    new_order = orders.where(c("o_id") > n * 7 // 10).select(c("o_w_id").alias("no_w_id"), c("o_d_id").alias("no_d_id"), c("o_id").alias("no_o_id"))
    line = orders.withColumn("ol_number", F.explode(F.sequence(F.lit(1), c("o_ol_cnt"))))
    mark = [c("o_w_id"), c("o_d_id"), c("o_id"), c("ol_number")]
    delivered = c("o_id") <= n * 7 // 10
    order_line = line.select(c("o_w_id").alias("ol_w_id"), c("o_d_id").alias("ol_d_id"), c("o_id").alias("ol_o_id"), "ol_number", between(1, items, *mark, seed=seed + 9).cast("int").alias("ol_i_id"), c("o_w_id").alias("ol_supply_w_id"), F.lit(5).alias("ol_quantity"), F.when(delivered, F.lit(0.0)).otherwise(between(1, 999999, *mark, seed=seed + 10) / 100).alias("ol_amount"))
    original = lambda k: F.when(noise(*k, seed=seed + 11) < 0.1, F.concat(letters(20, *k, seed=seed), F.lit("ORIGINAL"))).otherwise(letters(40, *k, seed=seed))
    item = spark.range(1, items + 1).select(c("id").cast("int").alias("i_id"), between(1, 10000, c("id"), seed=seed + 12).cast("int").alias("i_im_id"), letters(20, c("id"), seed=seed + 13).alias("i_name"), (between(100, 10000, c("id"), seed=seed + 14) / 100).alias("i_price"), original([c("id")]).alias("i_data"))
    stock = spark.range(warehouses * items).select((F.floor(c("id") / items) + 1).cast("int").alias("s_w_id"), (c("id") % items + 1).cast("int").alias("s_i_id"), between(10, 100, c("id"), seed=seed + 15).cast("int").alias("s_quantity"), F.lit(0.0).alias("s_ytd"), F.lit(0).alias("s_order_cnt"), F.lit(0).alias("s_remote_cnt"), original([c("id"), F.lit(1)]).alias("s_data"))
    return {"warehouse": warehouse, "district": district, "customer": customer, "history": history, "orders": orders, "new_order": new_order, "order_line": order_line, "item": item, "stock": stock}


def _coprime(a: int, b: int) -> bool:
    while b:
        a, b = b, a % b
    return a == 1


def key_value(spark: SparkSession, keys: int, seed: int = 7) -> DataFrame:
    """Ten fields of 100 characters."""
    return spark.range(keys).select(F.col("id").cast("int").alias("y_key"), *(letters(100, F.col("id"), F.lit(k), seed=seed).alias(f"y_f{k:02d}") for k in range(1, 11)))


def bank(spark: SparkSession, accounts: int) -> dict[str, DataFrame]:
    rows = spark.range(accounts).select(F.col("id").alias("account_id"), F.lit(1e9).alias("balance"))
    return {"savings": rows, "checking": rows}


def subscribers(spark: SparkSession, n: int, seed: int = 7) -> dict[str, DataFrame]:
    """subscriber, its index by number, and four kinds of access each."""
    c = F.col("id")
    subscriber = spark.range(n).select(c.alias("s_id"), scalar.zero_padded(c, 15).alias("sub_nbr"), between(0, (1 << 32) - 1, c, seed=seed).alias("msc_location"), between(0, (1 << 32) - 1, c, seed=seed + 1).alias("vlr_location"))
    access = spark.range(n).select(c.alias("s_id"), F.explode(F.sequence(F.lit(1), F.lit(4))).alias("ai_type"))
    access = access.withColumn("data_1", between(0, 255, F.col("s_id"), F.col("ai_type"), seed=seed + 2))
    return {"subscriber": subscriber, "sec_subscriber": subscriber.select("sub_nbr", "s_id"), "access_info": access}


def trace(spark: SparkSession, operations: int, keys: int, mix: dict[str, float], theta: float = 0.7, seed: int = 7) -> DataFrame:
    """A trace with skewed keys: seq, op, key and len; mix gives the share of each operation."""
    u, op, so_far = noise(F.col("id"), seed=seed), F.lit(None).cast("string"), 0.0
    for name, share in reversed(list(mix.items())):
        so_far += share
        op = F.when(u >= 1 - so_far, F.lit(name)).otherwise(op) if name == list(mix)[-1] else F.when((u >= 1 - so_far) & op.isNull(), F.lit(name)).otherwise(op)
    key = F.concat(F.lit("user"), scalar.zero_padded(scalar.zipf(noise(F.col("id"), seed=seed + 1), keys, theta), 10))
    return spark.range(operations).select(F.col("id").alias("seq"), F.coalesce(op, F.lit(next(iter(mix)))).alias("op"), key.alias("key"), F.lit(100).alias("len"))
