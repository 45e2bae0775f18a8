"""What SQL cannot say is held against a plain sequential interpreter; hand-made cases beside it."""

import random
from collections import OrderedDict

import pytest
from pyspark.sql import functions as F

from ledgerfold.operators import access, oplog, placement, txn


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_compare_exchange_follows_a_sequential_reader(spark):
    rng = random.Random(1)
    rows = [(k, s, rng.choice([None, 0, 1, 2]), rng.choice([0, 1, 2])) for s in range(400) for k in [rng.randrange(5)]]
    state, done, failed = {}, {}, {}
    for k, _, expected, desired in rows:
        if state.get(k) == expected:
            state[k] = desired
            done[k] = done.get(k, 0) + 1
        else:
            failed[k] = failed.get(k, 0) + 1
    got = {r["key"]: (r["value"], r["exchanged"], r["failed"]) for r in oplog.compare_exchange(frame(spark, rows, "key long, seq long, expected long, desired long")).collect()}
    assert got == {k: (state.get(k), done.get(k, 0), failed.get(k, 0)) for k in {r[0] for r in rows}}


def test_admission(spark):
    rng = random.Random(2)
    rows = [(s, rng.randrange(40), rng.choice(["PUT", "PUT", "DELETE", "GET"]), rng.randrange(10, 60)) for s in range(600)]
    want, live = [], {}
    for s, k, op, size in rows:
        part = live.setdefault(k % 4, {})
        if op == "GET":
            continue
        if op == "DELETE":
            want.append((s, "kOk" if part.pop(k, None) is not None else "kNotFound"))
        elif sum(part.values()) - part.get(k, 0) + size > 200:
            want.append((s, "kOutOfMemory"))
        else:
            part[k] = size
            want.append((s, "kOk"))
    got = oplog.admit(frame(spark, rows, "seq long, key long, op string, size long"), 200, 4)
    assert sorted((r["seq"], r["status"]) for r in got.collect()) == want
    assert got.agg(F.max("used")).first()[0] <= 200


def lru_misses(keys, capacity):
    cache, hits = OrderedDict(), 0
    for k in keys:
        hits += k in cache
        cache[k] = True
        cache.move_to_end(k)
        if len(cache) > capacity:
            cache.popitem(last=False)
    return hits


@pytest.mark.parametrize(("capacity", "hits"), [(1, 0), (2, 1)])
def test_lru_of_two_lines(spark, capacity, hits):
    rows = [(0, i, k, 1) for i, k in enumerate([1, 2, 1])]
    got = placement.evictions(frame(spark, rows, "part long, seq long, key long, size long"), "lru", capacity)
    assert got.where("hit").count() == hits


@pytest.mark.parametrize("policy", list(placement.POLICIES))
def test_policies_stay_within_capacity(spark, policy):
    rng = random.Random(3)
    rows = [(rng.randrange(3), i, rng.randrange(30), 10) for i in range(500)]
    got = placement.evictions(frame(spark, rows, "part long, seq long, key long, size long"), policy, 80).orderBy("part", "seq").collect()
    for part in range(3):
        mine = [r for r in got if r["part"] == part]
        inserted, gone = sum(not r["hit"] for r in mine), sum(r["evicted"] for r in mine)
        if policy == "never":
            assert gone == 0 and inserted == len({r["key"] for r in mine})
        else:
            assert 0 < inserted - gone <= 8
        if policy == "lru":
            assert sum(r["hit"] for r in mine) == lru_misses([r["key"] for r in mine], 8)


def test_clock_gives_a_second_chance():
    clock = placement.Clock(2)
    for key in "ab":
        clock.access(key, 1)
    assert clock.access("c", 1) == (False, 1) and "a" not in clock.size  # all marks were set: the hand clears and takes the first
    clock.access("b", 1)
    clock.access("d", 1)
    assert "b" in clock.size and "c" not in clock.size


def test_ordered_locks_are_greedy_by_transaction(spark):
    rows = [(0, 1, 5, "W"), (0, 2, 5, "R"), (0, 2, 6, "W"), (0, 3, 6, "W"), (0, 4, 7, "R"), (0, 5, 7, "R"), (0, 6, 7, "W"), (1, 7, 5, "W")]
    got = {r["txn"]: r["granted"] for r in txn.ordered_locks(frame(spark, rows, "epoch long, txn long, key long, kind string")).collect()}
    assert got == {1: True, 2: False, 3: True, 4: True, 5: True, 6: False, 7: True}


def test_batch_commit_by_hand(spark):
    # 1 writes a; 2 reads a, writes b; 3 reads b, writes a; 4 only reads
    rows = [(1, "a", "W"), (2, "a", "R"), (2, "b", "W"), (3, "b", "R"), (3, "a", "W"), (4, "a", "R")]
    log = frame(spark, rows, "txn long, key string, kind string").withColumn("epoch", F.lit(0))
    flags = {r["txn"]: (r["raw"], r["war"], r["waw"]) for r in txn.conflicts(log).collect()}
    assert flags == {1: (False, False, False), 2: (True, False, False), 3: (True, True, True), 4: (True, False, False)}
    won = lambda mode: {r["txn"] for r in txn.commits(log, mode).where("committed").collect()}
    assert won("si") == {1, 2, 4} and won("reorder") == {1, 2, 4} and won("strict") == {1, 4}
    with pytest.raises(ValueError):
        txn.commits(log, "none")


def test_aborted_transactions_lead_the_next_round(spark, tmp_path):
    rows = [(t, "a", "W") for t in (1, 2, 3)]
    log = frame(spark, rows, "txn long, key string, kind string").withColumn("epoch", F.lit(0))
    n = iter(range(100))

    def keep(df):
        path = str(tmp_path / str(next(n)))
        df.write.parquet(path)
        return spark.read.parquet(path)

    out, ran = txn.rounds(log, "reorder", 5, keep)
    assert {r["txn"]: r["round"] for r in out.collect()} == {1: 1, 2: 2, 3: 3} and ran == 3


def test_scan_limit_zero_means_two_things(spark):
    rows = spark.range(10).withColumnRenamed("id", "k")
    assert access.scan(rows, "k", 3, 0).count() == 0
    assert access.scan_table(rows, "k", 3, 7, 0).count() == 5


def test_as_of_with_a_hot_key(spark):
    rng = random.Random(5)
    rows = [(s, 0 if rng.random() < 0.6 else rng.randrange(4), rng.choice(["PUT", "GET", "GET", "DELETE"]), s) for s in range(3000)]
    live, want = {}, {}
    for s, k, op, v in rows:
        if op == "GET":
            want[s] = live.get(k)
        elif op == "PUT":
            live[k] = v
        else:
            live.pop(k, None)
    log = frame(spark, rows, "seq long, key long, op string, value long")
    for span in (7, 64, 100_000):
        got = {r["seq"]: (r["value"] if r["hit"] else None) for r in oplog.as_of(log, span).collect()}
        assert got == want


@pytest.mark.parametrize("variant", ["write_through", "no_shared_read", "non_temporal", "always_coherent"])
def test_coherence_variants(spark, variant):
    rng = random.Random(6)
    rows = [(s, rng.randrange(3), rng.randrange(3), rng.random() < 0.3) for s in range(500)]
    valid, want = {}, {}
    for s, row, host, write in rows:
        have = valid.setdefault(row, set())
        if write:
            valid[row] = {host}
            continue
        hit = {"non_temporal": False, "always_coherent": True}.get(variant, host in have)
        want[s] = hit
        if variant == "no_shared_read" and not hit:
            valid[row] = {host}
        else:
            have.add(host)
    got = {r["seq"]: r["hit"] for r in placement.coherence_hits(frame(spark, rows, "seq long, row long, host long, write boolean"), variant).collect()}
    assert got == want
