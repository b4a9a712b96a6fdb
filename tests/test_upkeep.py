import pytest
from pyspark.sql import functions as F

from graphloom.functions.vectors import HashEmbedder, embed_column
from graphloom.operators import evals, upkeep

STORE = "node_id string, embedding array<float>, summary_hash string, model string, updated_at timestamp, status string"


def test_arguments_and_paths(spark):
    upkeep.check_args({"id": "x", "tags": []})
    with pytest.raises(ValueError, match="did you mean 'summary'"):
        upkeep.check_args({"sumary": "x"})
    df = spark.createDataFrame([("a/./b.py",), ("../x",), ("a/../../x",), ("/abs",), ("a/../b",)], "p string")
    assert [r.v for r in df.select(upkeep.source_path("p", "/root/").alias("v")).collect()] == ["/root/a/b.py", "../x", "a/../../x", "/abs", "/root/b"]


def test_reembed(spark, nodes_of):
    n = nodes_of([{"id": "a", "summary": "one"}, {"id": "b", "summary": ""}, {"id": "c", "status": "superseded"}])
    embed = lambda text: embed_column(text, HashEmbedder())
    store = upkeep.reembed(n, spark.createDataFrame([("z", [1.0], "h", "mock", None, "active")], STORE), embed, "mock", "2024-01-01T00:00:00Z")
    assert {r.node_id for r in store.collect()} == {"a", "b", "z"}
    texts = {r.node_id: r.text for r in upkeep.embedding_texts(n).collect()}
    assert texts == {"a": "one", "b": "b"}
    edited = n.withColumn("summary", F.when(F.col("id") == "a", "two").otherwise(F.col("summary")))
    again = {r.node_id: r.updated_at.year for r in upkeep.reembed(edited, store, embed, "mock", "2025-01-01T00:00:00Z").collect() if r.updated_at}
    assert again == {"a": 2025, "b": 2024}
    assert {r.node_id for r in upkeep.reembed(n, store, embed, "mock", "2025-01-01T00:00:00Z", force=True).collect()} == {"a", "b"}
    with pytest.raises(ValueError):
        upkeep.reembed(n, store, embed, "other", "2025-01-01T00:00:00Z", guard=True)
    assert upkeep.has_status(store)


def test_catalog_views(spark):
    routes = spark.createDataFrame([("a", "/a"), ("b", "/b")], "vault_id string, path string")
    asked = spark.createDataFrame([("b",), ("c",)], "vault_id string")
    for table in (routes, upkeep.route_map(routes)):
        assert {r.vault_id: r.path for r in upkeep.routes_of(table, asked).collect()} == {"b": "/b", "c": None}
    bridges = spark.createDataFrame([("x", "y", "v", "w"), ("y", "x", "w", "v"), ("x", "y", "", "")], "source string, target string, source_vault_id string, target_vault_id string")
    assert upkeep.bridge_list(bridges).count() == 2
    projects = spark.createDataFrame([("p", "v", "/p"), ("q", "w", "/q")], "project_id string, vault_id string, path string")
    state = spark.createDataFrame([("p", True, False, True)], "project_id string, active boolean, editable boolean, materialized boolean")
    nodes = spark.createDataFrame([("v",), ("v",)], "vault_id string")
    assert sorted(tuple(r)[3:] for r in upkeep.project_status(projects, state, nodes).collect()) == [(False, False, False, 0), (True, False, True, 2)]


def test_evals(spark, tmp_path):
    rows = [("hybrid", 5.0, 4), ("hybrid", 4.0, 6), ("plain", 4.0, 8)]
    df = spark.createDataFrame(rows, "condition string, quality double, turns int")
    out = evals.condition_averages(df, ("quality", "turns"))
    assert {(r.condition, r.metric): r.value for r in out.collect()} == {("hybrid", "quality"): 4.5, ("hybrid", "turns"): 5.0, ("plain", "quality"): 4.0, ("plain", "turns"): 8.0}
    assert "| hybrid | quality | 4.5000 |" in evals.markdown(out) and len(evals.as_json(out)) == 4
    runs = spark.createDataFrame([("r", True, 900, 100, 30, 5), ("r", False, 100, 300, 3, 5)], "repo string, hit boolean, baseline_tokens int, tokens int, baseline_calls int, calls int")
    assert tuple(evals.repo_totals(runs).first()) == ("r", 2, 0.5, 2.5) and tuple(evals.targets(runs).first()) == (True, True)
    (tmp_path / "q.jsonl").write_text('{"id": "1"}\n{"id": "2"}\n')
    q = evals.load(spark, str(tmp_path / "q.jsonl"), "id string")
    assert [r.id for r in evals.pending(q, q.where("id = '1'")).collect()] == ["2"]
    s = spark.createDataFrame([("First part. Second.",)], "t string").select(evals.sentences(F.col("t")).alias("s")).first().s
    assert s == "First part."
    assert round(spark.createDataFrame([(5, 4, 3)], "a int, b int, c int").select(evals.judge_average("a", "b", "c").alias("j")).first().j, 6) == 4


def test_hits_of_cut_words_and_short_items(spark):
    from graphloom.operators import evals

    docs = [(1, "all the cats sat on a mat"), (2, "hello world"), (3, "x hello  world y and more of it all here now"), (4, None), (5, "short"), (6, "and more of it all here nowhere else"), (7, "")]
    items = [(1, "the cat"), (2, "hello"), (3, "ello wor"), (4, "and more of it all here now"), (5, "hello  world"), (6, ""), (7, None), (8, "d more of it al"), (9, "sat on a mat"), (10, " the ")]
    df = lambda rows, c: spark.createDataFrame(rows, f"{c} bigint, text string")
    want = {(i, d) for i, t in items for d, h in docs if t and h and t in h}
    for inline in (10_000, 0):
        evals.INLINE_KEYS, old = inline, evals.INLINE_KEYS
        try:
            got = [(r.item_id, r.doc_id) for r in evals.hits(df(items, "item_id"), df(docs, "doc_id")).collect()]
        finally:
            evals.INLINE_KEYS = old
        assert set(got) == want and len(got) == len(want)
    assert evals.hits(df([], "item_id"), df(docs, "doc_id")).count() == 0


def test_feed_and_debounce(spark):
    from graphloom.streaming import watch

    feed, heard = watch.Feed(), []
    stop = feed.subscribe(lambda v, k: heard.append((v, k)))
    feed.publish()
    feed.publish("heat")
    stop()
    assert feed.publish() == 3 and heard == [(1, "graph"), (2, "heat")]
    events = spark.createDataFrame([("a", t) for t in (0.0, 1.5, 2.0, 2.5, 4.6, 9.0)] + [("b", 1.0)], "path string, at double")
    got = sorted((r.path, r.first, r.events) for r in watch.debounced(events, 2.0).collect())
    assert got == [("a", 0.0, 3), ("a", 2.5, 1), ("a", 4.6, 1), ("a", 9.0, 1), ("b", 1.0, 1)]


def test_unparsed_scripts_mask_patterns():
    from graphloom.sources.source_tree import mask_patterns

    for text, left in (("a = /[}/]{2}/g;", "a =           ;"), ("x / y / z", "x / y / z"), ("// /{/", "// /{/"), ("'/{/'", "'/{/'"), ("return /}/", "return    "), ("f(/{/)", "f(   )")):
        assert mask_patterns(text) == left
