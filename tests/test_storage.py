import os

from pyspark.sql import functions as F

from graphloom import storage


def test_scope_deletes_what_was_made_inside(spark):
    before = storage.materialize(spark.range(3), "kept")
    with storage.scratch_scope(spark):
        inside = storage.materialize(spark.range(5), "gone")
        assert inside.count() == 5
    assert before.count() == 3 and not os.path.exists(inside._graphloom_path.removeprefix("file://"))
    storage.discard(before)
    assert not os.path.exists(before._graphloom_path.removeprefix("file://"))


def test_broadcast_is_bounded_by_rows_and_bytes(spark, monkeypatch):
    table = storage.materialize(spark.range(1000).withColumn("t", F.expr("repeat(uuid(), 20)")), "sized")
    hinted = lambda rows: "ResolvedHint" in str(storage.broadcast_if_small(table, rows)._jdf.queryExecution().analyzed())
    assert hinted(1000) and not hinted(999)
    monkeypatch.setattr(storage, "BROADCAST_BYTES", 1000)
    assert not hinted(1000)
