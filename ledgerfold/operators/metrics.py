"""Statistics and reports over samples, counters and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest_rank(rows: DataFrame, value: str, percents: list[int], by: list[str] | None = None) -> DataFrame:
    """Percentiles at index ceil(p n / 100) - 1 of the sorted samples, whole numbers."""
    cols = [F.expr(f"percentile_disc({p / 100}) WITHIN GROUP (ORDER BY {value})").cast("bigint").alias(f"p{p}") for p in percents]
    return rows.groupBy(*(by or [])).agg(*cols)


def floor_rank(rows: DataFrame, value: str, percents: list[int], by: list[str]) -> DataFrame:
    """Percentiles at index floor(p (n - 1) / 100). Places come from counts of the distinct values, so a group's samples
    are never gathered in one row."""
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*by)
    placed = counts.withColumns({"upto": F.sum("c").over(w.orderBy(value)), "n": F.sum("c").over(w)})
    at = lambda p: F.floor(F.lit(p) * (F.col("n") - 1) / 100) + 1
    return placed.groupBy(*by).agg(*(F.min(F.when(F.col("upto") >= at(p), F.col(value))).alias(f"p{p}") for p in percents))


def cdf(rows: DataFrame, value: str, points: int, below: float = 0.99) -> DataFrame:
    """About `points` evenly strided points (value, place, n) of the distribution below a quantile."""
    n = rows.agg(F.count("*").alias("n"))
    counts = rows.groupBy(value).agg(F.count("*").alias("c"))
    run = F.floor(F.col(value) / 4096)
    sizes = counts.groupBy(run.alias("run")).agg(F.sum("c").alias("s"))
    before = sizes.select("run", (F.sum("s").over(Window.orderBy("run")) - F.col("s")).alias("before"))
    placed = counts.withColumn("run", run).withColumn("inside", F.sum("c").over(Window.partitionBy("run").orderBy(value))).join(before, "run")
    placed = placed.select(value, (F.col("before") + F.col("inside")).alias("place"), "c").crossJoin(F.broadcast(n))
    stride = F.greatest(F.lit(1).cast("bigint"), F.floor(F.col("n") * below / points))
    crosses = F.floor(F.col("place") / stride) > F.floor((F.col("place") - F.col("c")) / stride)
    return placed.where(crosses & (F.col("place") <= F.col("n") * below)).select(value, "place", "n")


def per_second(log: DataFrame, ts: str, counters: dict[str, Column], seconds: int = 1) -> DataFrame:
    return log.groupBy(F.window(ts, f"{seconds} seconds").alias("w")).agg(*(F.count(F.when(c, 1)).alias(n) for n, c in counters.items())).select(F.col("w.start").alias("second"), *counters)


def trimmed_average(ticks: DataFrame, tick: str, value: str, warm_up: int, run: int) -> DataFrame:
    """Mean of a counter over the ticks after the warm-up, up to the end of the run."""
    return ticks.where((F.col(tick) > warm_up) & (F.col(tick) <= run)).agg(F.sum(value).alias("total"), (F.sum(value) / F.lit(run - warm_up)).alias("average"))


def ratio(a: Column, b: Column) -> Column:
    """a in percent of b; null where b is 0."""
    return 100.0 * a / F.nullif(b, F.lit(0))


def moving_average(rows: DataFrame, value: str, order: str, by: list[str], size: int) -> DataFrame:
    """Sum of the last `size` samples over their number plus one, in whole numbers."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(-(size - 1), 0)
    return rows.withColumn("average", F.floor(F.sum(value).over(w) / (F.count(value).over(w) + 1)))


def dominant(rows: DataFrame, by: list[str], node: str) -> DataFrame:
    """The node most rows are on (the least one of equals), and how many rows are elsewhere."""
    counts = rows.groupBy(*by, node).agg(F.count("*").alias("c"))
    return counts.groupBy(*by).agg(F.max_by(node, F.struct(F.col("c"), -F.col(node))).alias("dominant"), (F.sum("c") - F.max("c")).alias("misplaced"), F.sum("c").alias("pages"))


def matrix(long: DataFrame, x: str, series: str, value: str, names: list[str]) -> DataFrame:
    """A result matrix: one column for each series."""
    return long.groupBy(x).pivot(series, names).agg(F.first(value))


def transposed(wide: DataFrame, x: str, names: list[str]) -> DataFrame:
    return wide.unpivot(x, names, "series", "value")
