"""What the physical plans must and must not hold."""

import os

import pytest

from ledgerfold import plans

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
STREAMS = {n for n in plans.QUERIES if n.startswith("stream_")}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - STREAMS))
def test_no_pairs_of_all_rows(name, spark):
    assert "CartesianProduct" not in plan_of(plans.QUERIES[name](spark, DATA))


@pytest.mark.parametrize(("name", "pushed", "columns"), [("range_scan_closed", "GreaterThanOrEqual(o_orderkey,100)", "struct<o_orderkey:bigint,o_custkey:bigint>"), ("range_scan_open", "LessThan(o_orderkey,900)", "struct<o_orderkey:bigint,o_custkey:bigint>"), ("delta_columns", "EqualTo(c_mktsegment,BUILDING)", "struct<c_custkey:bigint,c_acctbal:double,c_mktsegment:string>")])
def test_filters_and_columns_reach_the_scan(name, pushed, columns, spark):
    plan = plan_of(plans.QUERIES[name](spark, DATA))
    assert pushed in plan and f"ReadSchema: {columns}" in plan


@pytest.mark.parametrize(("name", "exchanges"), [("kv_upsert_lww", 2), ("latest_order_per_customer", 1), ("aria_reservations", 1), ("payment_rollup", 3), ("percentile_nearest_rank", 1), ("part_round_robin", 1)])
def test_shuffles_are_as_few_as_needed(name, exchanges, spark):
    plan = plan_of(plans.QUERIES[name](spark, DATA))
    assert plan.count("Exchange hashpartitioning") <= exchanges


@pytest.mark.parametrize(("name", "scans"), [("kv_multi_get", 3), ("ycsb_rmw", 3), ("neworder_lines", 2), ("stock_rule", 2)])
def test_partitions_grow_with_the_rows(name, scans, spark, monkeypatch):
    """a task's memory does not grow with the input; neworder_lines reads its lines once."""
    from ledgerfold.operators import oplog

    monkeypatch.setattr(oplog, "ROWS_A_TASK", 10)
    df = plans.QUERIES[name](spark, DATA)
    rows = spark.read.parquet(f"{DATA}/{'lineitem' if name in ('neworder_lines', 'stock_rule') else 'events'}.parquet").count()
    plan = plan_of(df)
    assert f", {-(-rows // 10)}), REPARTITION_BY_NUM" in plan and plan.count("FileScan parquet") <= scans


@pytest.mark.parametrize("name", ["kv_multi_get", "ycsb_rmw", "neworder_lines", "stock_rule"])
def test_odd_rows_as_in_sql(name, spark, tmp_path):
    import duckdb

    con = duckdb.connect()
    con.execute(f"""CREATE TABLE events AS SELECT * FROM '{DATA}/events.parquet' UNION ALL BY NAME SELECT * REPLACE (-event_id * 7 AS event_id, CASE WHEN event_id % 5 > 0 THEN -user_id * 9 END AS user_id) FROM '{DATA}/events.parquet' WHERE event_id % 3 = 0
        UNION ALL BY NAME SELECT * FROM '{DATA}/events.parquet' WHERE event_id % 10 = 1 AND event_type = 'view'""")
    con.execute(f"CREATE TABLE customer AS SELECT * FROM '{DATA}/customer.parquet' UNION ALL BY NAME SELECT * REPLACE (-c_custkey AS c_custkey) FROM '{DATA}/customer.parquet'")
    con.execute(f"CREATE TABLE part AS SELECT * FROM '{DATA}/part.parquet' UNION ALL BY NAME SELECT * FROM '{DATA}/part.parquet' WHERE p_partkey % 4 = 0")
    con.execute(f"CREATE TABLE lineitem AS SELECT * REPLACE (CASE WHEN l_linenumber <> 2 THEN l_suppkey END AS l_suppkey, CASE WHEN l_linenumber <> 3 THEN l_quantity END AS l_quantity, CASE WHEN l_orderkey % 7 > 0 THEN l_partkey END AS l_partkey) FROM '{DATA}/lineitem.parquet'")
    for t in ("events", "customer", "part", "lineitem"):
        con.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    want = con.execute(plans.ORACLES[name])
    columns = [c[0] for c in want.description]
    got = plans.QUERIES[name](spark, str(tmp_path)).select(columns).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.fetchall()))


def test_registers_without_the_corpus_operators():
    import subprocess
    import sys
    from pathlib import Path

    code = "import sys; sys.modules['ledgerfold.llm'] = None\nimport __spark_entry__ as e\nassert len(e.queries()) > 100 and not any(q.startswith('op1_') for q in e.queries()) and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parents[1])
