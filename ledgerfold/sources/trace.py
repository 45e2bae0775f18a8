"""Operation traces: text lines `OP KEY_LEN LEN KEY`, and their replay."""

from __future__ import annotations

from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import written

#: Operation, two numbers, then the key right after the second one, of as many bytes as the first says.
LINE = r"^\s*(\S+)\s+(\d+)\s+(\d+)[ \t]*(.*)$"


def parse(lines: DataFrame, value: str = "value") -> DataFrame:
    """lines (line_no and value) as line_no, op, key, len and error. Blank lines and comments are left out. A line that
    isn't of the form, a key shorter than said, or something after it gives an error, not a failure."""
    text = F.col(value)
    part = lambda k: F.regexp_extract(text, LINE, k)
    rows = lines.where((F.trim(text) != "") & ~F.startswith(F.ltrim(text), F.lit("#")))
    rest, size = part(4), F.expr(f"try_cast(regexp_extract({value}, r'{LINE}', 2) AS INT)")
    key = F.substring(rest, F.lit(1), F.coalesce(size, F.lit(0)))
    after = F.trim(F.substring(rest, F.coalesce(size, F.lit(0)) + 1, F.length(rest)))
    error = F.when(part(1) == "", "form").when(size.isNull() | (F.length(key) < size), "key").when(after != "", "tail")
    return rows.select("line_no", part(1).alias("op"), key.alias("key"), F.expr(f"try_cast(regexp_extract({value}, r'{LINE}', 3) AS BIGINT)").alias("len"), error.alias("error"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """A trace file. A trace has one order, so its lines are numbered as they stand: byte order of the one file, by
    partition and place in it."""
    lines = spark.read.text(path)
    return parse(lines.withColumn("line_no", F.monotonically_increasing_id()))


def in_order(keys: DataFrame, group: list[str], order: str, key: str) -> DataFrame:
    """Rows whose key is not above the one before it: what a sorted scan must not give."""
    before = F.lag(key).over(Window.partitionBy(*group).orderBy(order))
    return keys.withColumn("before", before).where(F.col(key) <= F.col("before"))


def scans_as_of(log: DataFrame, scans: DataFrame, limit: int, width: int) -> DataFrame:
    """What scans see: seq and start in, the first `limit` live keys from start at that point out.

    Keys are cut into stretches of `width`; each is an ordered fold of its own, read as a stream of sorted rows, that
    holds its live keys. A scan that its stretch can't fill goes on one level up, where the stretches are `width` times as
    long: to the first keys after its stretch. There a change counts only if it moves what is among the first `limit`
    keys of the stretch below, which is all that a scan from before that stretch can see. So a row goes through as many
    levels at most as the keys' range has digits to the base `width`, and no fold holds more than limit * width keys."""
    change = log.where(F.col("op").isin("PUT", "DELETE") & F.col("key").isNotNull() & F.col("seq").isNotNull())
    asked = scans.where(F.col("seq").isNotNull() & F.col("start").isNotNull())
    # kind: 0 a scan (it sees what was before its seq), 1 a delete, 2 a put
    none = F.lit(None).cast("bigint")
    rows = change.select(F.col("seq").cast("bigint").alias("seq"), F.when(F.col("op") == "PUT", 2).otherwise(1).alias("kind"), F.col("key").cast("bigint").alias("key"), F.col("value").cast("bigint").alias("value"), none.alias("start"), none.alias("need"))
    rows = rows.unionByName(asked.select(F.col("seq").cast("bigint").alias("seq"), F.lit(0).alias("kind"), F.col("start").cast("bigint").alias("key"), none.alias("value"), F.col("start").cast("bigint").alias("start"), F.lit(limit).cast("bigint").alias("need")))
    ends = rows.agg(F.min("key").alias("low"), F.max("key").alias("high")).first()
    low, high, span, found = ends["low"] or 0, ends["high"] or 0, max(2, width), None
    while True:
        top = high - low < span
        made = _scanned(rows, low, span, limit, top)
        made = made if top else written(made, "scans")
        seen = made.where("kind = 3").select("seq", "start", "key", "value")
        found = seen if found is None else found.unionByName(seen)
        if top:
            break
        rows, span = made.where("kind < 3"), span * max(2, width)
    place = F.row_number().over(Window.partitionBy("seq").orderBy("key"))
    return found.withColumn("place", place).where(F.col("place") <= limit).select("seq", "start", "place", "key", "value")


def _scanned(rows: DataFrame, low: int, span: int, limit: int, top: bool) -> DataFrame:
    """One level: rows of kind 3 are what scans see; the others are the rows of the next level."""
    fields = pa.schema([("seq", pa.int64()), ("kind", pa.int32()), ("key", pa.int64()), ("value", pa.int64()), ("start", pa.int64()), ("need", pa.int64())])

    def fold(batches):
        part, keys, values = None, [], {}
        for batch in batches:
            out = []
            for own, seq, kind, key, value, start, need in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != part:
                    part, keys, values = own, [], {}
                at = bisect_left(keys, key)
                if kind == 0:
                    got = keys[at : at + need]
                    out += [(seq, 3, k, values[k], start, None) for k in got]
                    if not top and len(got) < need:
                        out.append((seq, 0, low + (own + 1) * span, None, start, need - len(got)))
                    continue
                here = at < len(keys) and keys[at] == key
                if kind == 2:
                    values[key] = value
                    if not here:
                        keys.insert(at, key)
                        if not top and at < limit < len(keys):
                            out.append((seq, 1, keys[limit], None, None, None))
                    if not top and at < limit:
                        out.append((seq, 2, key, value, None, None))
                elif here:
                    del keys[at], values[key]
                    if not top and at < limit:
                        out.append((seq, 1, key, None, None, None))
                        if len(keys) >= limit:
                            out.append((seq, 2, keys[limit - 1], values[keys[limit - 1]], None, None))
            for k in range(0, len(out), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out[k : k + 10_000]), fields, strict=True)], schema=fields)

    parted = rows.withColumn("part", F.expr(f"(key - ({low})) div {span}")).select("part", "seq", "kind", "key", "value", "start", "need")
    parted = parted.repartition("part").sortWithinPartitions("part", "seq", "kind")
    return parted.mapInArrow(fold, "seq long, kind int, key long, value long, start long, need long")


def line(op: Column, key: Column, size: Column) -> Column:
    """A trace line; keys must not begin with a digit, which would be read as part of the length before them."""
    return F.concat_ws(" ", op, F.octet_length(key).cast("string"), size.cast("string"), key)
