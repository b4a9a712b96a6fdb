import datetime as dt

import pytest
from pyspark.sql import functions as F

from graphloom.operators import heat
from graphloom.streaming import stateful, watch

T0 = dt.datetime(2024, 1, 1)
AT = "path string, at timestamp"


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def put(spark, rows, schema, folder, name):
    """One file, and so one micro-batch."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/batch={name}")


def stream(spark, schema, folder):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def bursts_by_hand(events, wait):
    out = []
    for path in {p for p, _ in events}:
        first, n = None, 0
        for t in sorted(t for p, t in events if p == path):
            if first is not None and t <= first + wait:
                n += 1
            else:
                if first is not None:
                    out.append((path, first, n))
                first, n = t, 1
        out.append((path, first, n))
    return sorted(out)


def test_bursts_over_batches_and_a_restart(spark, tmp_path):
    waves = [
        [("a", 0), ("a", 4), ("b", 1), ("a", 11)],
        [("a", 10), ("a", 9.5), ("b", 11), ("c", 12), (None, 13)],  # some of them late, but not too late
        [("a", 30), ("b", 11.000001), ("a", 20)],
        [("a", 41), ("b", 60), ("b", 61)],
        [("", 10_000)],  # moves the watermark on
    ]
    got = lambda: sorted((r.path, (r.first - T0).total_seconds(), r.events) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    for k, wave in enumerate(waves):  # every wave starts the query again from its checkpoint
        put(spark, [(p, at(t)) for p, t in wave], AT, tmp_path / "in", k)
        found = stateful.bursts(stream(spark, AT, tmp_path / "in"), 10, "25 seconds")
        stateful.start(found, str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination(120)
    events = [(p, float(t)) for wave in waves[:-1] for p, t in wave if p]
    assert got() == bursts_by_hand(events, 10)
    whole = watch.debounced(spark.createDataFrame(events, "path string, at double"), 10)
    assert got() == sorted((r.path, r.first, r.events) for r in whole.collect())


def test_bursts_in_one_run_of_many_batches(spark, tmp_path):
    events = [(f"p{k % 7}", float((k * 37) % 500)) for k in range(400)]
    for k in range(4):
        put(spark, [(p, at(t)) for p, t in events[k::4]], AT, tmp_path / "in", k)
    put(spark, [("", at(100_000))], AT, tmp_path / "in", "z")
    found = stateful.bursts(stream(spark, AT, tmp_path / "in"), 15, "600 seconds")
    stateful.start(found, str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination(120)
    got = sorted((r.path, (r.first - T0).total_seconds(), r.events) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == bursts_by_hand(events, 15)


def test_paths_share_state_and_timers(spark, tmp_path, monkeypatch):
    """The keys of the state are as many as the shares, not as the paths; each path still has its own bursts."""
    monkeypatch.setattr(stateful, "SHARES", 3)
    events = [(f"p{k % 50}", float((k * 37) % 500)) for k in range(600)] + [("p\x00é", 3.0), ("", 4.0)]
    for k in range(2):
        put(spark, [(p, at(t)) for p, t in events[k::2]], AT, tmp_path / "in", k)
    put(spark, [("z", at(100_000))], AT, tmp_path / "in", "z")
    found = stateful.bursts(stream(spark, AT, tmp_path / "in"), 15, "600 seconds")
    run = stateful.start(found, str(tmp_path / "out"), str(tmp_path / "ckpt"))
    run.awaitTermination(120)
    got = sorted((r.path, (r.first - T0).total_seconds(), r.events) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == bursts_by_hand(events, 15)
    assert max(op["customMetrics"].get("numRegisteredTimers", 0) for p in run.recentProgress for op in p["stateOperators"]) <= 2 * 3


def test_changes_by_the_clock(spark, tmp_path):
    put(spark, [("a", at(0)), ("a", at(1)), ("b", at(1))], AT, tmp_path / "in", 0)
    found = stateful.quiet_changes(stream(spark, AT, tmp_path / "in"), 0.5)
    run = found.writeStream.format("memory").queryName("quiet").option("checkpointLocation", str(tmp_path / "ckpt")).outputMode("append").trigger(processingTime="1 second").start()
    try:
        for _ in range(60):
            run.awaitTermination(1)
            if spark.table("quiet").count() >= 2:
                break
        assert sorted((r.path, r.events) for r in spark.table("quiet").collect()) == [("a", 2), ("b", 1)]
    finally:
        run.stop()


def test_summaries_are_due_by_count_change_and_time(spark, tmp_path):
    counts = "namespace string, n bigint, at timestamp"
    waves = [[("n", 2, at(0)), ("m", 5, at(0))], [("n", 3, at(60)), ("m", 5, at(60))], [("m", 6, at(120)), ("n", 3, at(100))], [("m", 6, at(1000))], [("", 0, at(4000))]]
    for k, wave in enumerate(waves):
        put(spark, wave, counts, tmp_path / "in", k)
        due = stateful.summaries_due(stream(spark, counts, tmp_path / "in"))
        stateful.start(due, str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination(120)
    got = sorted((r.namespace, (r["at"] - T0).total_seconds(), r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    # at 120 m is up by a fifth; after half an hour of no change both are made again, and again
    assert got == [("m", 0, 5), ("m", 120, 6), ("m", 1920, 6), ("m", 3720, 6), ("n", 60, 3), ("n", 1860, 3), ("n", 3660, 3)]


def heat_by_hand(rows, to):
    out = {}
    for a, b, r in sorted(rows, key=lambda x: x[2]):
        w, hits, last = out.get((a, b), (0.0, 0, None))
        for _ in range(last or 0, r if last is not None else 0):
            w = max(0.05, w * 0.95)
        out[(a, b)] = (w + (1 - w) * 0.1, hits + 1, r)
    done = {}
    for k, (w, hits, last) in out.items():
        for _ in range(last, to):
            w = max(0.05, w * 0.95)
        done[k] = (round(w, 9), hits)
    return done


def test_heat_writes_what_it_touches(spark, tmp_path):
    schema = "namespace string, a string, b string, round bigint"
    waves = [[("x", "y", 0), ("x", "y", 0), ("x", "z", 0), ("u", "v", 0)], [("x", "y", 3)], [("x", "y", 3), ("x", "z", 90), ("x", "y", 4)]]
    sizes = []
    for k, wave in enumerate(waves):
        put(spark, [(None, a, b, r) for a, b, r in wave], schema, tmp_path / "in", k)
        changes = stateful.heat_changes(stream(spark, schema, tmp_path / "in"))
        stateful.start(changes, str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination(120)
        sizes.append(spark.read.parquet(str(tmp_path / "out")).count())
    assert sizes == [3, 4, 6]  # a row for each pair of a batch, not for the whole table
    changes = spark.read.parquet(str(tmp_path / "out"))
    rows = [(a, b, r) for wave in waves for a, b, r in wave]
    for to in (90, 100):
        got = {(r.a, r.b): (round(r.weight, 9), r.hits) for r in stateful.heat_at(changes, to).collect()}
        assert got == heat_by_hand(rows, to)
    own = {(r.a, r.b): r.weight for r in stateful.heat_at(changes).collect()}
    assert own[("u", "v")] == pytest.approx(0.1) and own[("x", "z")] == pytest.approx(0.05 + 0.95 * 0.1)
    alone = spark.createDataFrame([("", "p", "q", 0.5, 3, "")], "namespace string, a string, b string, weight double, hits int, last string")
    lazy = stateful.heat_at(alone.withColumn("round", F.lit(2).cast("bigint")), 7).first()
    assert lazy.weight == pytest.approx(heat.decay(alone, 5).first().weight)
