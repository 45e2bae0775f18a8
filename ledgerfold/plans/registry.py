"""Queries by name, each with the SQL that says the same over the same tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from ..shipping import to_workers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Events as an operation log, and the state it folds to.
LOG = """oplog AS (
  SELECT event_id AS seq, user_id AS key, cast(round(value * 100) AS BIGINT) AS value, event_type, ts,
         CASE WHEN event_type IN ('purchase', 'signup') THEN 'PUT' WHEN event_type = 'error' THEN 'DELETE' ELSE 'GET' END AS op
  FROM events)"""
STATE = f"""{LOG},
last_change AS (SELECT key, arg_max(op, seq) AS op, arg_max(value, seq) AS value, max(seq) AS seq FROM oplog WHERE op <> 'GET' GROUP BY key),
state AS (SELECT key, value, seq FROM last_change WHERE op = 'PUT')"""
ACCESS = """access AS (
  SELECT event_id AS txn, event_id // 100 AS epoch, user_id AS key,
         CASE WHEN event_type IN ('purchase', 'signup', 'error') THEN 'W' ELSE 'R' END AS kind
  FROM events)"""


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            to_workers(spark)
            return f(spark, sf_dir)

        QUERIES[name] = run
        if oracle:
            ORACLES[name] = oracle
        return f

    return register
