"""Work that grows no faster than the tables: what is moved, kept or built at once."""

import numpy as np
import pandas as pd
import pytest
import yaml
from pyspark.sql import functions as F

from graphloom import storage
from graphloom.functions import vectors
from graphloom.operators import components, federation, graph, metric, mutations, retrieval
from graphloom.plans import catalog, edits
from graphloom.plans.views import Views
from graphloom.sources import source_tree, vault
from graphloom.storage import materialize

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_orphans_compare_each_id_once(spark):
    nodes = spark.createDataFrame([(i,) for i in ("a", "b", "c", "d", None)], "id string")
    edges = spark.createDataFrame([("a", "b")] * 50 + [("a", None), (None, "c"), ("x", "a")], "src string, dst string")
    out = graph.orphans(nodes, edges)
    assert sorted(str(r.id) for r in out.collect()) == ["None", "d"]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join LeftAnti") == 1


def test_vectors_leave_by_batches_and_hashes_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(vectors, "GRAMS", 50)
    one, free = vectors.HashEmbedder(), vectors.HashEmbedder()
    texts = [f"text {i} of many {i * i}" for i in range(60)]
    for t in texts:
        assert (one.embed_one(t) == free.embed_one(t)).all() and len(one._grams) <= 50
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts + [None])], "i int, t string").select("i", vectors.embed_column("t", batch=8).alias("e")).orderBy("i").collect()
    assert all(pd.Series(r.e).round(6).tolist() == pd.Series(one.embed_one(t or "").tolist()).round(6).tolist() for r, t in zip(got, texts + [None]))


def test_packing_numbers_no_list(spark):
    assert "Window" not in plan(catalog.QUERIES["compact_first_fit"](spark, SF))


def test_refused_runs_make_no_condition(spark, nodes_of, monkeypatch):
    n = nodes_of([{"id": f"n{i}"} for i in range(20)])
    monkeypatch.setattr(mutations, "tag", lambda *a: pytest.fail("built"))
    monkeypatch.setattr(mutations, "delete", lambda *a: pytest.fail("built"))
    for command, ids in (("/tag x", tuple(f"n{i}" for i in range(11))), ("/delete " + " ".join(f"n{i}" for i in range(11)), ())):
        with pytest.raises(RuntimeError):
            mutations.Curator(n, "now").run(command, ids)


def test_few_dangling_edges_are_found_where_edges_lie(spark):
    edges = materialize(spark.range(2_000).selectExpr("'n' || id AS src", "'n' || (id + 1) AS dst", "'reads' AS relation").unionByName(
        spark.createDataFrame([("n1", "@far/x", "reads"), ("n1", None, "reads")], "src string, dst string, relation string")), "edges")
    out = graph.dangling(edges, spark.range(2_000).selectExpr("'n' || id AS id"))
    assert [tuple(r) for r in out.collect()] == [("n1999", "n2000", "reads")]
    assert "hashpartitioning" not in plan(out) and "BroadcastHashJoin" in plan(out)


def test_client_reads_written_nodes(spark, monkeypatch):
    made = []
    real = edits.Client
    monkeypatch.setattr(edits, "Client", lambda nodes, *a, **k: made.append(nodes) or real(nodes, *a, **k))
    assert catalog.QUERIES["client_verbs"](spark, SF).count() == 1
    assert getattr(made[0], "_graphloom_path", None)  # edge lists are gathered once, not by every verb


def test_lists_of_some_nodes_are_those_of_all(spark):
    v = Views(spark, SF)
    some = v.nodes.where("namespace = 'geo'")
    got = {r.id: r.edges for r in v.full(some, v.pairs.where("src LIKE 'nation/%' OR src LIKE 'region/%'")).collect()}
    listed = v.edges.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("ord", F.col("dst").alias("target"), "relation"))).alias("e"))
    want = {r.src: [(e.target, e.relation) for e in r.e] for r in listed.collect()}
    assert len(got) == 30 and all([(e.target, e.relation) for e in edges] == want.get(i, []) for i, edges in got.items())


@pytest.mark.parametrize("chunk", [8, 300, 1 << 20])
def test_components_are_joined_where_edges_lie(spark, chunk):
    step = [(f"{i}", f"{i + k}") for k in (1, 2) for i in range(0, 400, 4) for _ in range(3)] + [(f"p{i}", f"p{i + 1}") for i in range(60)] + [("é", "z"), ("z", "~"), ("x", None), ("y", "y")]
    edges = spark.createDataFrame(step, "src string, dst string").repartition(3)
    got = sorted(map(tuple, components.contracted_components(edges, chunk=chunk).collect()))
    assert got == sorted(map(tuple, components.connected_components(edges).collect())) and len(got) == 364


def test_component_sizes_shuffle_no_edges(spark, monkeypatch):
    monkeypatch.setattr(components, "connected_components", lambda *a: pytest.fail("stars over all edges"))
    nodes = spark.createDataFrame([(i,) for i in "abcdef"] + [(None,)], "id string")
    edges = spark.createDataFrame([("a", "b"), ("b", "gone"), ("gone", "c"), ("d", "c"), ("e", None)] * 2, "src string, dst string")
    got = {r.id: (r.component, r.size) for r in graph.component_sizes(nodes, edges).collect()}
    assert got == {"a": ("a", 2), "b": ("a", 2), "c": ("c", 2), "d": ("c", 2), "e": ("e", 1), "f": ("f", 1)}


def test_namespace_views_drop_far_edges_at_the_scan(spark):
    out = catalog.QUERIES["namespace_view"](spark, SF)
    assert "IN (customer,orders)" in plan(out) and out.count() > 100
    nodes = spark.createDataFrame([("a/1",), ("b",), (None,)], "id string")
    edges = spark.createDataFrame([("a/1", "b"), ("a/2", "b"), ("c/1", "b"), (None, "b")], "src string, dst string")
    assert sorted(r.src for r in graph.below(edges, nodes, "src", "dst").collect()) == ["a/1", "a/2"]


def test_bridges_judge_targets_without_namespace_once(spark, nodes_of, monkeypatch):
    monkeypatch.setattr(graph, "HEADS", 1)  # no segment says anything
    rows = [{"id": "p", "namespace": "m", "edges": [("n/q", "calls"), ("n/none", "calls"), ("q", "calls"), ("p", "reads")]}, {"id": "q", "namespace": "n"}]
    want = {("q", "bridge"), ("n/none", "behavioral"), ("p", "behavioral")}
    for most in (1, 1_024):
        monkeypatch.setattr(graph, "HEADS", most)
        out = federation.bridge_view(nodes_of(rows), graph.edges_of(nodes_of(rows)))
        assert out.count() == 4 and {(r.target, r["class"]) for r in out.collect()} == want
    assert plan(out).count("regexp_replace") == 0


@pytest.mark.parametrize("how", ["inner", "left"])
def test_first_segments_say_the_value(spark, how):
    nodes = spark.createDataFrame([("a/1", "x"), ("a/2", "x"), ("b/1", "x"), ("b/2", "y"), ("c/1", None), ("d/1", "z"), ("e", "w")], "id string, v string")
    edges = spark.createDataFrame([(f"s{i}", d) for i, d in enumerate(["a/1", "a/2", "b/1", "b/2", "c/1", "d/1", "d/9", "e", "f/1", None, "a/1"])], "src string, dst string")
    got = graph.attach(edges, nodes, "dst", "v", "dst_v", how=how)
    want = edges.join(nodes.toDF("dst", "dst_v"), "dst", how).select("src", "dst", "dst_v")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    sure = graph.attach(edges.where("dst LIKE 'a/%'"), nodes, "dst", "v", "dst_v", how=how)
    assert "hashpartitioning" not in plan(sure) and "SortMergeJoin" not in plan(sure) and sure.count() == 3


def test_heat_may_repeat_and_is_not_shuffled(spark, nodes_of):
    rows = [{"id": "a", "edges": [("b", "calls"), ("c", "calls")]}, {"id": "b"}, {"id": "c"}]
    n, entry = nodes_of(rows), spark.createDataFrame([("a",)], "id string")
    heat = spark.createDataFrame([("a", "c", 0.5)] * 3 + [("a", "b", 0.1), ("a", "b", 0.2)], "a string, b string, weight double")
    got = [r.id for r in retrieval.traverse(n, graph.edges_of(n), entry, heat, 1).orderBy("ord").collect()]
    assert got == ["a", "c", "b"]


def test_merges_are_dealt_to_small_parts(spark):
    rows = spark.createDataFrame([("a", "b"), ("a", "b"), ("a", None), (None, None), (None, None)], "src string, dst string")
    assert "REPARTITION_BY_NUM" not in plan(storage.distinct_rows(rows, rows, size=1))  # of unknown size
    out = storage.distinct_rows(rows, stored := materialize(rows, "rows"), size=storage.file_bytes(stored) // 9)
    assert "REPARTITION_BY_NUM" in plan(out) and sorted(map(str, out.collect())) == sorted(map(str, rows.distinct().collect()))


def test_blocks_of_a_ball_are_few(spark):
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(300, 4)))], "id long, v array<double>").withColumn("name", F.col("id").cast("string"))
    saved = metric.CELL_ROWS, metric.BLOCK_ROWS
    metric.CELL_ROWS, metric.BLOCK_ROWS = 20, 100  # as 15 blocks of 20 and more would be
    try:
        out = metric._members(rows, None, 100.0).agg(F.max("j").alias("j"), F.count("*").alias("n")).first()
    finally:
        metric.CELL_ROWS, metric.BLOCK_ROWS = saved
    assert out["j"] == metric.LEAST_BLOCKS - 1


def test_entities_leave_a_worker_by_parts(spark, monkeypatch):
    text = "package p\n\n" + "\n".join(f"func f{i}() {{\n}}\n" for i in range(300))
    files = [(f"a/f{i}.go", bytearray(text.encode())) for i in range(12)]
    run = []
    stub = type("Files", (), {"select": lambda self, *c: self, "mapInPandas": lambda self, f, schema: run.append(f)})()
    source_tree.entities(stub)
    frames = list(run[0]([pd.DataFrame(files, columns=["path", "content"])]))
    assert sum(map(len, frames)) == 12 * 301 and max(map(len, frames)) < source_tree.ENTITY_ROWS + 301


def test_frontmatter_is_read_by_the_fast_parser():
    text = "id: a/b\nlines: [1, 2]\nsummary: 'é ☃'\nat: 2024-01-01\nnone: null\nyes: true\n"
    assert vault.load_yaml(text) == yaml.safe_load(text) and vault.load_yaml("") is None
    for bad in ("a: [", "!!python/object:os.system {}", "a: b: c"):
        with pytest.raises(yaml.YAMLError):
            vault.load_yaml(bad)
