import pytest
from pyspark.sql import functions as F

from ledgerfold.functions import scalar
from ledgerfold.sources import config, generators, runlog, tables, trace
from ledgerfold.streaming import oplog_stream


def test_trace_file(spark, tmp_path):
    path = tmp_path / "t.txt"
    path.write_text("# head\n\nPUT 5 3 alpha\nGET 5 0alpha\nSCAN 1 10 a\nDELETE 5 0 alpha tail\nGET 9 0 short\nnonsense\n")
    got = [(r["op"], r["key"], r["len"], r["error"]) for r in trace.read(spark, str(path)).orderBy("line_no").collect()]
    assert got == [("PUT", "alpha", 3, None), ("GET", "alpha", 0, None), ("SCAN", "a", 10, None), ("DELETE", "alpha", 0, "tail"), ("GET", "short", 0, "key"), ("", "", None, "form")]


def test_config(spark, tmp_path):
    path = tmp_path / "c.jsonc"
    path.write_text('{ // sizes\n "nodes": 2, /* all */ "partitions": 16, "costs": {"a//b": 3} }')
    got = config.load(spark, str(path))
    assert (got.nodes, got.partitions, got.costs) == (2, 16, {"a//b": 3})
    for bad in ('{"nodes": 0}', '{"what": 1}', '{"nodes": 9, "partitions": 8}', '{"cache_model": "magic"}', '{"hit_rate": 10001}', '{"index_bytes": 99999999999}'):
        with pytest.raises(ValueError):
            config.parse(bad)


def test_run_log(spark):
    lines = spark.createDataFrame([(1, "  a b total_commit: 17 x"), (2, "other 5"), (3, "a b total_commit: n/a")], "n int, value string")
    assert [(r["n"], r["commits"]) for r in runlog.figures(lines, "total_commit:", {"commits": 3}).orderBy("n").collect()] == [(1, 17.0), (3, None)]


def test_checkpoint_and_attach(spark, tmp_path):
    state = spark.range(5)
    tables.checkpoint(state, str(tmp_path), 1, "a")
    assert tables.attach(spark, str(tmp_path), 1, "a").count() == 5
    with pytest.raises(ValueError):
        tables.attach(spark, str(tmp_path), 1, "b")
    state.write.parquet(f"{tmp_path}/version=2/data")
    with pytest.raises(ValueError):
        tables.attach(spark, str(tmp_path), 2, "a")


def test_reports(spark, tmp_path):
    row = spark.createDataFrame([(3, 4)], "commits long, aborts long")
    assert sorted(r["value"] for r in tables.statistics(row, "run").collect()) == ["run.aborts=4.0", "run.commits=3.0"]
    tables.write_csv(row, str(tmp_path / "m"))
    assert tables.read_csv(spark, str(tmp_path / "m"), "commits long, aborts long", ["aborts"]).first()["aborts"] == 4
    tables.append_log(spark.createDataFrame([(0, 1), (1, 2)], "epoch long, seq long"), str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2


def test_loader_invariants(spark):
    made = generators.order_entry(spark, 2, 50, 200)
    assert made["orders"].select("o_w_id", "o_d_id", "o_c_id").distinct().count() == made["orders"].count() == 2 * 10 * 50
    low, high = made["orders"].agg(F.min("o_ol_cnt"), F.max("o_ol_cnt")).first()
    assert low >= 5 and high <= 15
    first = made["new_order"].groupBy("no_w_id", "no_d_id").agg(F.min("no_o_id").alias("m"), F.count("*").alias("n")).select("m", "n").distinct().collect()
    assert [tuple(r) for r in first] == [(36, 15)]
    lines = made["order_line"].groupBy("ol_w_id", "ol_d_id", "ol_o_id").agg(F.count("*").alias("n"))
    both = lines.join(made["orders"], (lines.ol_w_id == F.col("o_w_id")) & (lines.ol_d_id == F.col("o_d_id")) & (lines.ol_o_id == F.col("o_id")))
    assert both.where("n <> o_ol_cnt").count() == 0 and both.count() == 1000
    share = made["item"].where(F.contains("i_data", F.lit("ORIGINAL"))).count() / 200
    assert 0.02 < share < 0.25
    assert generators.key_value(spark, 10).select(F.length("y_f01")).first()[0] == 100
    assert generators.subscribers(spark, 5)["access_info"].count() == 20
    assert generators.bank(spark, 3)["savings"].count() == 3


def fnv(data: bytes) -> int:
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 % (1 << 64)
    return h


def test_hashes(spark):
    texts = ["", "a", "foobar", "käse", None]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(scalar.fnv1a64("t")).collect()]
    assert [None if g is None else g % (1 << 64) for g in got] == [None if t is None else fnv(t.encode()) for t in texts]
    part = spark.createDataFrame([("foobar",), ("x",)], "t string").select("t", scalar.stable_partition(F.col("t"), 7).alias("p")).collect()
    assert {r["t"]: r["p"] for r in part} == {t: fnv(t.encode()) % 7 for t in ("foobar", "x")}
    assert spark.range(1).select(scalar.splitmix64("id")).first()[0] % (1 << 64) == 0xE220A8397B1DCDAF
    assert spark.range(1).select(scalar.lcg48("id")).first()[0] == 0xB
    names = spark.createDataFrame([(0,), (371,), (999,)], "n long").select(scalar.last_name(F.col("n"))).collect()
    assert [r[0] for r in names] == ["BARBARBAR", "PRICALLYOUGHT", "EINGEINGEING"]
    assert spark.range(36, 37).select(scalar.base36(F.col("id"), 4)).first()[0] == "0010"


def test_zipf_is_skewed_and_in_range(spark):
    keys = spark.range(5000).select(scalar.zipf((F.col("id") + 0.5) / 5000.0, 100, 0.7).alias("k"))
    counts = {r["k"]: r["count"] for r in keys.groupBy("k").count().collect()}
    assert min(counts) == 0 and max(counts) <= 99 and counts[0] > counts[1] > counts[50]


def test_placement_stream_by_hand(spark, tmp_path):
    rows = [(7, 0, 0, 0, "PUT"), (7, 1, 1, 0, "GET"), (7, 2, 1, 0, "PUT"), (7, 3, 0, 0, "MOVE_OUT"), (8, 4, 1, 0, "PUT"), (8, 5, 1, 0, "GET"), (8, 6, 0, 0, "GET")]
    src = str(tmp_path / "in")
    spark.createDataFrame(rows, "key long, seq long, node long, owner long, op string").write.parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    oplog_stream.run_once(oplog_stream.placements(stream), str(tmp_path / "out"), str(tmp_path / "state"), "update")
    got = {r["key"]: (r["shared"], r["moved_in"], r["moved_out"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    # a first insert by another node stays private; its own read promotes the row
    assert got == {7: (False, 1, 1), 8: (True, 1, 0)}


def test_scans_as_of_a_time(spark):
    """through several levels of stretches against brute force; long lives cost nothing."""
    import random

    rng = random.Random(3)
    log = [(10**9 * i, rng.randrange(-300, 300) if i < 800 else rng.randrange(-300, 20), rng.choice(["PUT", "PUT", "DELETE"]) if i < 400 else rng.choice(["PUT", "DELETE", "DELETE"]), rng.choice([None, i])) for i in range(1500)]
    scans = [(10**9 * rng.randrange(1510) + rng.choice([0, 1]), rng.randrange(-310, 310)) for _ in range(200)]
    scans = list(dict(scans).items())
    want = set()
    for seq, start in scans:
        live = {}
        for s, key, op, value in log:
            if s < seq:
                live.pop(key, None)
                if op == "PUT":
                    live[key] = value
        want |= {(seq, start, i + 1, k, live[k]) for i, k in enumerate(sorted(k for k in live if k >= start)[:10])}
    frames = spark.createDataFrame([*log, (5, None, "PUT", 1)], "seq long, key long, op string, value long"), spark.createDataFrame([*scans, (7, None)], "seq long, start long")
    for width in (1024, 8, 3):
        assert {tuple(r) for r in trace.scans_as_of(*frames, 10, width).select("seq", "start", "place", "key", "value").collect()} == want
