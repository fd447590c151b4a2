"""Sliding failures, state merged on read, runs of one time."""

import os
import random
from datetime import datetime, timedelta


from plazamill.streaming import state

T0 = datetime(2026, 1, 1)


def fed(spark, tmp_path, batches, schema):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    order = sorted(os.listdir(tmp_path / "in"))
    assert order
    return spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def collected(frame, tmp_path, mode):
    held = []
    q = frame.writeStream.outputMode(mode).foreachBatch(lambda b, e: held.extend(map(tuple, b.collect()))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(200)
    return held


def test_sliding_failures_are_every_window(spark, tmp_path):
    r = random.Random(3)
    times = sorted((r.randrange(0, 4000), r.choice("abc")) for _ in range(90))
    batches = [[(k, T0 + timedelta(seconds=t)) for t, k in times[i : i + 30]] for i in (0, 30, 60)]
    stream = fed(spark, tmp_path, batches, "k string, ts timestamp")
    got = sorted((k, t.timestamp(), n) for k, t, n in collected(state.sliding_failures(stream, "ts", "k", seconds=600, limit=5), tmp_path, "append"))
    rows = [(k, (T0 + timedelta(seconds=t)).timestamp()) for t, k in times]
    seen, want = {}, []
    for k, t in rows:
        mine = seen.setdefault(k, [])
        mine.append(t)
        n = sum(t - 600 < x <= t for x in mine)
        if n >= 5:
            want.append((k, t, n))
    same_time = {k for k, t in rows if sum(x == (k, t) for x in rows) > 1}
    assert [x for x in got if x[0] not in same_time] == sorted(x for x in want if x[0] not in same_time) and want


def test_a_burst_across_an_edge_counts(spark, tmp_path):
    batches = [[("x", T0 + timedelta(seconds=s)) for s in (590, 595, 599)], [("x", T0 + timedelta(seconds=s)) for s in (601, 605)], [("x", T0 + timedelta(seconds=1300)), (None, T0), ("y", None)]]
    got = collected(state.sliding_failures(fed(spark, tmp_path, batches, "k string, ts timestamp"), "ts", "k"), tmp_path, "append")
    assert [(k, (t - T0).seconds if t.tzinfo is None else t, n) for k, t, n in got] == [("x", 605, 5)]


def size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet"))


def test_merged_state_is_the_rewritten_state(spark, tmp_path):
    r = random.Random(4)
    schema = "k long, a string, n long"
    batches = [[(i, f"a{i}", i) for i in range(400)]] + [[(r.randrange(420), r.choice([None, "x", "y"]), r.choice([None, 7, 8])) for _ in range(5)] for _ in range(5)]
    batches = [list({row[0]: row for row in b}.values()) for b in batches]
    seen = []
    stream = fed(spark, tmp_path, batches, schema)
    path = str(tmp_path / "state")
    like = spark.createDataFrame([], schema)
    q = state.delta_merged(stream, path, "k", ["a", "n"], str(tmp_path / "cp"), buckets=4, compact_every=4, after=lambda b, e: seen.append(b.count()))
    q.awaitTermination(300)
    want, order = {}, []
    for d in sorted(os.listdir(f"{path}/delta")):
        rows = {x["k"]: (x["a"], x["n"]) for x in spark.read.parquet(f"{path}/delta/{d}").collect()}
        order.append(len(rows))
        for k, (a, n) in rows.items():
            old = want.get(k, (None, None))
            want[k] = (a if a is not None else old[0], n if n is not None else old[1])
    assert sorted(order) == sorted(map(len, batches)) and seen == order
    got = {x["k"]: (x["a"], x["n"]) for x in state.merged_state(spark, path, "k", like).collect()}
    assert got == want and os.listdir(f"{path}/base") == ["version=000000000004"]
    assert {x["k"]: (x["a"], x["n"]) for x in state.merged_state(spark, path, "k", like, version=6).collect()} == want
    sizes = [size(f"{path}/delta/{d}") for d in sorted(os.listdir(f"{path}/delta"))]
    large = order.index(400)
    assert all(s < sizes[large] / 1.5 for i, s in enumerate(sizes) if i != large)


def test_a_retried_batch_changes_nothing(spark, tmp_path):
    schema = "k long, a string"
    path, like = str(tmp_path / "state"), spark.createDataFrame([], schema)
    for turn in range(2):  # the second run has no checkpoint, so it writes the same versions again
        stream = fed(spark, tmp_path, [[(1, "x"), (2, None)]], schema) if not turn else spark.readStream.schema(like.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        state.delta_merged(stream, path, "k", ["a"], str(tmp_path / f"cp{turn}"), buckets=2).awaitTermination(200)
    assert sorted(map(tuple, state.merged_state(spark, path, "k", like).collect())) == [(1, "x"), (2, None)]


def test_runs_of_one_time(spark, tmp_path):
    at = T0 + timedelta(days=1)
    rows = [[(1, at, True, 0, False, 10), (1, at, True, 0, False, 11), (2, None, True, 0, False, 12), (2, at, True, 0, False, 13)], [(1, at, True, 0, False, 11), (1, at, True, 0, False, 14), (2, at, True, 1, False, 15)]]
    schema = "institucion_id long, evaluated_at timestamp, extracted boolean, found int, bypass boolean, id long"
    held = collected(state.zero_streaks(fed(spark, tmp_path, rows, schema)).select("institucion_id", "ceros"), tmp_path, "update")
    assert dict(held) == {1: 3, 2: 0}
