import json

from pyspark.sql import functions as F

from graphloom.client import Client
from graphloom.functions.vectors import HashEmbedder
from graphloom.operators import graph, heat
from graphloom.streaming import watch


def test_heat_stream_equals_batch(spark, tmp_path):
    rows = [("", a, b, str(i)) for i, (a, b) in enumerate([("x", "y"), ("x", "y"), ("x", "z"), ("x", "y")])]
    df = spark.createDataFrame(rows, "namespace string, a string, b string, last string")
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    table = watch.Table(spark, "namespace string, a string, b string, weight double, hits int, last string")
    watch.heat_updates(watch.read_stream(spark, str(tmp_path / "in"), df.schema, 1), table, str(tmp_path / "c")).awaitTermination()
    got = {(r.a, r.b): (r.hits, round(r.weight, 9)) for r in table.read().collect()}
    assert got == {(r.a, r.b): (r.hits, round(r.weight, 9)) for r in heat.accumulate(df).collect()}
    counted = watch.pair_counts(watch.read_stream(spark, str(tmp_path / "in"), df.schema))
    q = counted.writeStream.outputMode("complete").format("memory").queryName("pair_counts").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("pair_counts").where("b = 'y'").first().hits == 3


def test_source_changes(spark, nodes_of, tmp_path):
    n = nodes_of([{"id": "a", "source": ("a.py", [0, 0], "1")}, {"id": "b", "edges": [("a", "calls")]}, {"id": "c", "source": ("c.py", [0, 0], "3")}])
    for i, rec in enumerate([{"path": "a.py", "hash": "2"}, {"path": "c.py", "hash": "3"}]):
        (tmp_path / f"{i}.json").write_text(json.dumps(rec))
    seen = []

    def act(hit, spread, number):
        seen.append((sorted(r.id for r in hit.collect()), sorted(r.id for r in spread.collect())))
        fresh, store = watch.reindex(n, spark.createDataFrame([], "node_id string, embedding array<float>, summary_hash string, model string, updated_at timestamp, status string"), hit,
                                     lambda df: df.select(F.col("id").alias("node_id"), F.array(F.lit(1.0).cast("float")).alias("embedding"), F.lit("h").alias("summary_hash"), F.lit("m").alias("model"),
                                                          F.lit(None).cast("timestamp").alias("updated_at"), F.lit("active").alias("status")))
        assert fresh.where("id = 'a'").first().source.hash == "2" and store.count() == 1

    s = watch.read_stream(spark, str(tmp_path), "path string, hash string", format="json")
    watch.source_changes(s, lambda: n, lambda: graph.edges_of(n), act, str(tmp_path / "c"), trigger=None).awaitTermination()
    assert seen == [(["a"], ["a", "b"])]
    assert [r.id for r in watch.after_write(graph.edges_of(n), spark.createDataFrame([("a",)], "id string")).collect()] == ["b"]


def test_summary_schedule_and_reload(spark, tmp_path):
    state = watch.Table(spark, "namespace string, last_n long, last_at string")
    fired, loads = [], []
    for k, counts in enumerate([[("n", 2), ("m", 5)], [("n", 3), ("m", 5)], [("m", 6)]]):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(json.dumps({"namespace": a, "n": b}) for a, b in counts))
        s = watch.read_stream(spark, str(tmp_path / "in"), "namespace string, n long", format="json")
        watch.summary_schedule(s, state, lambda due, i: fired.append(sorted(r.namespace for r in due.collect())), str(tmp_path / "c"), "2024-01-01T00:00:00Z").awaitTermination()
    assert fired == [["m"], ["n"], ["m"]]
    s = watch.read_stream(spark, str(tmp_path / "in"), "namespace string, n long", format="json")
    watch.vault_reload(s, lambda: "graph", lambda g, i: loads.append(g), str(tmp_path / "c2"), None).awaitTermination()
    assert loads == ["graph"]
    clock = [0.0]
    snap = watch.Snapshot(lambda: spark.range(3), 60, lambda: clock[0])
    first = snap.get()
    assert snap.get() is first
    clock[0] = 61
    assert snap.get() is not first
    snap.drop()


def test_client(spark, nodes_of):
    emb = spark.createDataFrame([], "node_id string, embedding array<float>, summary_hash string, model string, updated_at timestamp, status string")
    c = Client(nodes_of([]), emb, embedder=HashEmbedder(), now="2024-01-01T00:00:00Z")
    assert 'nodes="0"' in c.query("anything").first().xml
    c.write(nodes_of([{"id": "auth/login", "summary": "login of users", "edges": [("auth/token", "calls")], "tags": ["sec"]}, {"id": "auth/token", "summary": "signs tokens"}, {"id": "ui/button", "summary": "draws a button", "type": "class"}]))
    assert c.search("login of users", 1).first().node_id == "auth/login" and c.by_tag("sec").count() == 1 and c.by_type("class").first().id == "ui/button"
    assert "<node " in c.query("login of users").first().xml and c.stats().first().nodes == 3
    assert {r.id for r in c.neighbors("auth/token").collect()} == {"auth/login"} and c.orphans().first().id == "ui/button"
    assert {r.value for r in c.values().where("kind = 'tag'").collect()} == {"sec"} and c.by_namespace("default").count() == 3
    c.tag_matching("signs tokens", "crypto", 1)
    assert c.get("auth/token").first().tags == ["crypto"]
    files = spark.createDataFrame([], "path string, hash string")
    assert c.detail("auth/login", files).first().out_degree == 1 and c.verify(files).count() == 0
    assert {r.action for r in c.classify(nodes_of([{"id": "x", "summary": "login of users", "tags": ["sec"]}])).collect()} == {"noop"}
    c.command("/link ui/button auth/login references")
    assert c.orphans().count() == 0
    c.undo()
    c.delete("ui/button")
    assert c.search("draws a button", 5).where("node_id = 'ui/button'").count() == 0
    assert c.suggestions(5).count() >= 0
    entries = spark.createDataFrame([("q", "auth/login"), ("q", "auth/token")], "query_id string, id string")
    assert c.record(entries).first().hits == 1 and c.record(entries).first().hits == 2
