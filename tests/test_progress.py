import random

from quirefold.streaming import progress as P


def test_log_equals_a_map(spark):
    rng, rows, want = random.Random(11), [], {}
    for run in range(25):
        db = {}
        for k in range(rng.randint(1, 14)):
            seq, path, to = run * 100 + k, f"{run}-{rng.randint(0, 2)}", f"{run}-{rng.randint(0, 2)}"
            op = rng.choice(["save", "save", "rename", "rename", "delete"])
            if op == "save":
                db[path] = (float(seq), seq)
            elif op == "delete":
                db.pop(path, None)
            elif path in db:
                db[to] = db[path]
                del db[path]
            rows.append((seq, op, path, to, float(seq), seq))
        want |= db
    got = P.apply_log(spark.createDataFrame(rows, "seq long, op string, path string, new_path string, scroll double, ts_ms long"))
    assert {r.path: (r.scroll, r.ts_ms) for r in got.collect()} == want


def test_stored_states(spark):
    text = P.state_file([("a", 0.5, 3), ("b", 1.0, 4)])
    files = spark.createDataFrame([(text,), ("not json",), (None,)], "value string")
    assert sorted(map(tuple, P.load(files).collect())) == [("a", 0.5, 3), ("b", 1.0, 4)]


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    schema = "path string, scroll double, ts_ms long"
    table, check = f"file://{tmp_path}/table", f"file://{tmp_path}/check"
    for rows in ([("a", 0.12345, 1), ("b", 2.0, 1)], [("a", 3.0, 2), ("c", float("nan"), 2)], [("a", 3.0, 2)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))
        P.track(spark.readStream.schema(schema).parquet(str(src)), table, check, every=None).awaitTermination()
    assert sorted(map(tuple, P.current(spark, table).collect())) == [("a", 3.0, 2), ("b", 2.0, 1)]
    assert P.lookup(P.current(spark, table), spark.createDataFrame([("z",)], "path string")).first().scroll is None


def test_stream_of_a_log_equals_a_map(spark, tmp_path):
    """Renames and deletes of one batch meet states of another; old snapshots go."""
    rng, db, seq = random.Random(4), {}, 0
    schema = "seq long, op string, path string, new_path string, scroll double, ts_ms long"
    table, src = f"file://{tmp_path}/table", str(tmp_path / "in")
    for _ in range(4):
        rows = []
        for _ in range(12):
            op, path, to = rng.choice(["save", "save", "rename", "delete"]), f"p{rng.randint(0, 4)}", f"p{rng.randint(0, 4)}"
            if op == "save":
                db[path] = (float(seq), seq)
            elif op == "delete":
                db.pop(path, None)
            elif path in db:
                db[to] = db[path]
                del db[path]
            rows.append((seq, op, path, to, float(seq), seq))
            seq += 1
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        P.track_log(spark.readStream.schema(schema).parquet(src), table, f"file://{tmp_path}/check", every=None).awaitTermination()
        assert {r.path: (r.scroll, r.ts_ms) for r in P.current(spark, table).collect()} == db
    assert len(P._numbers(spark, table)) <= P.KEPT


def test_stream_of_nothing(spark, tmp_path):
    spark.createDataFrame([], P.STATE).write.parquet(str(tmp_path / "in"))
    P.track(spark.readStream.schema(P.STATE).parquet(str(tmp_path / "in")), f"file://{tmp_path}/t", f"file://{tmp_path}/c", every=None).awaitTermination()
    assert P.current(spark, f"file://{tmp_path}/t").collect() == []
