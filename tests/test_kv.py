from ledgerfold.operators.kv import COLUMNS, Store


def batch(spark, rows):
    return spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "n long, key string, op string, value string")


def test_store_by_hand(spark, tmp_path):
    store = Store(spark.createDataFrame([], COLUMNS))
    store, status = store.apply(batch(spark, [("alpha", "PUT", "one"), ("child", "PUT", "process"), ("gone", "DELETE", None), ("", "PUT", "x"), ("big", "PUT", "x" * 5000)]))
    assert {r["key"]: r["status"] for r in status.collect()} == {"alpha": "kOk", "child": "kOk", "gone": "kNotFound", "": "kInvalidArgument", "big": "kInvalidArgument"}
    assert [tuple(r) for r in store.scan("a", 10).collect()] == [("alpha", "one"), ("child", "process")] and store.scan("a", 0).count() == 0
    store, status = store.apply(batch(spark, [("alpha", "DELETE", None), ("alpha", "DELETE", None), ("alpha", "PUT", "two"), ("count", "PUT", "5")]))
    assert [r["status"] for r in status.orderBy("n").collect()] == ["kOk", "kNotFound", "kOk", "kOk"]
    got = {r["key"]: (r["status"], r["value"]) for r in store.get(spark.createDataFrame([("alpha",), ("none",)], "key string")).collect()}
    assert got == {"alpha": ("kOk", "two"), "none": ("kNotFound", None)}
    more = spark.createDataFrame([(0, "count", 3), (1, "new", 2), (2, "count", -1), (3, "child", 1)], "n long, key string, delta long")
    assert [(r["status"], r["new_value"]) for r in store.increment(more).orderBy("n").collect()] == [("kOk", 8), ("kOk", 2), ("kOk", 7), ("kInvalidArgument", None)]
    again = store.checkpoint(str(tmp_path), "c")
    assert again.log.count() == 3 and again.memory().first().asDict() == {"rows": 3, "payload_bytes": 5 + 3 + 5 + 7 + 5 + 1}
    again, _ = again.apply(batch(spark, [("child", "DELETE", None)]))
    assert [r["key"] for r in again.scan("", 9).collect()] == ["alpha", "count"]
    assert again.placed().where("partition between 0 and 7 and owner between 0 and 1").count() == 2
