import random
from collections import deque

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from graphloom.operators import graph
from graphloom.operators.components import connected_components

EDGE = "src string, dst string, relation string, class string, ord long"
FEW = settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))


def edges(spark, pairs, relation="calls"):
    kind = "structural" if relation == "contains" else "behavioral"
    return spark.createDataFrame([(a, b, relation, kind, i) for i, (a, b) in enumerate(pairs)], EDGE)


def ids(df, c="id"):
    return sorted(r[c] for r in df.select(c).collect())


def test_edges_and_class(nodes_of):
    n = nodes_of([{"id": "a", "edges": [("b", "contains"), ("c", "odd")]}, {"id": "b"}])
    assert [tuple(r) for r in graph.edges_of(n).orderBy("ord").collect()] == [("a", "b", "contains", "structural", 0), ("a", "c", "odd", "behavioral", 1)]
    assert ids(graph.orphans(n, graph.edges_of(n))) == []
    assert ids(graph.dangling(graph.edges_of(n), n), "dst") == ["c"]


@FEW
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), max_size=20), st.integers(0, 4), st.sampled_from(["out", "in", "both"]))
def test_bfs_like_a_queue(spark, pairs, depth, direction):
    e = edges(spark, [(str(a), str(b)) for a, b in pairs])
    step = {}
    for a, b in pairs:
        if direction in ("out", "both"):
            step.setdefault(a, set()).add(b)
        if direction in ("in", "both"):
            step.setdefault(b, set()).add(a)
    seen, queue = {0: 0}, deque([0])
    while queue:
        x = queue.popleft()
        for y in step.get(x, ()):
            if y not in seen and seen[x] < depth:
                seen[y] = seen[x] + 1
                queue.append(y)
    got = graph.bfs(e, spark.createDataFrame([("0",)], "id string"), depth, direction)
    assert {r["id"]: r["depth"] for r in got.collect()} == {str(k): v for k, v in seen.items()}


def test_components_of_random_graphs(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)]
    parent = {x: x for p in pairs for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    assert got == {x: find(x) for x in parent if any(a != b and x in (a, b) for a, b in pairs)}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_cycles(spark, nodes_of):
    e = edges(spark, [("a", "b"), ("b", "c"), ("x", "a")], "contains")
    c = spark.createDataFrame([("c", "a"), ("a", "c"), ("a", "a")], "src string, dst string")
    assert {(r.src, r.dst): r.cycle for r in graph.would_cycle(e, c).collect()} == {("c", "a"): True, ("a", "c"): False, ("a", "a"): True}
    ring = edges(spark, [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("z", "a")], "contains")
    n = nodes_of([{"id": i} for i in "abcdz"])
    assert ids(graph.cycle_residual(n, ring)) == ["a", "b", "c", "d"]  # what is downstream of a cycle is reported too
    with pytest.raises(ValueError):
        graph.add_edge(e, "c", "a", "contains")
    assert graph.add_edge(e, "c", "a", "calls").count() == 4


def test_changes(spark, nodes_of):
    n = nodes_of([{"id": "a", "edges": [("b", "calls")]}, {"id": "b", "edges": [("a", "calls")]}])
    new = nodes_of([{"id": "a", "edges": []}])
    assert {(r.src, r.dst) for r in graph.edges_of(graph.upsert(n, new)).collect()} == {("b", "a")}
    with pytest.raises(ValueError):
        graph.insert(n, new)
    left, e = graph.remove(n, graph.edges_of(n), spark.createDataFrame([("a",)], "id string"))
    assert ids(left) == ["b"] and e.count() == 0
    old = graph.supersede(n, "b", nodes_of([{"id": "c"}])).where("id = 'b'").first()
    assert (old.status, old.superseded_by, old.valid_until) == ("superseded", "c", "")
    twice = edges(spark, [("a", "b"), ("a", "c"), ("a", "b")])
    assert [r.ord for r in graph.remove_edge(twice, "a", "b").orderBy("ord").collect()] == [1, 2]


def test_lookups(spark, nodes_of):
    n = nodes_of([{"id": "ns1/x"}, {"id": "ns2/x"}, {"id": "y"}, {"id": "z", "context": "é" * 1500}])
    spaces = spark.createDataFrame([("ns2",), ("ns1",)], "name string")
    asked = spark.createDataFrame([("x",), ("y",), ("nope",)], "id string")
    assert {r.asked: r.id for r in graph.resolve_ids(n, asked, spaces).collect()} == {"x": "ns1/x", "y": "y", "nope": None}
    shown = {r.id: r.context for r in graph.to_client(n, graph.edges_of(n)).collect()}
    assert shown["z"].endswith("(context truncated)") and len(shown["z"].encode()) <= 2030
    assert graph.capped(n.select("id"), 2).count() == 3 and graph.capped(n.select("id"), 4).count() == 4
    dated = nodes_of([{"id": "p", "valid_until": "2020-01-01T00:00:00Z"}, {"id": "q", "valid_from": "2021-01-01T00:00:00Z"}, {"id": "r"}])
    assert ids(graph.as_of(dated, "2020-06-01T00:00:00Z")) == ["r"]
    dup = nodes_of([{"id": "a", "file_path": "b.md", "summary": "second"}, {"id": "a", "file_path": "a.md", "summary": "first"}])
    assert graph.latest(dup).first().summary == "first"


def test_walks_through_missing(spark, nodes_of):
    e = edges(spark, [("a", "gone"), ("gone", "b"), ("c", "a")])
    n = nodes_of([{"id": i} for i in "abc"])
    assert ids(graph.neighbors(n, e, "a", 2)) == ["b"]
    assert ids(graph.neighbors_both(n, e, "a", 2)) == ["b", "c"]
    assert ids(graph.highlight(e, "a")) == ["c", "gone"] and ids(graph.inbound_sources(e, "a")) == ["c"]
    sizes = {r.id: r.size for r in graph.component_sizes(n, e).collect()}
    assert sizes == {"a": 2, "c": 2, "b": 1}
    d = {r.id: (r.out_degree, r.in_degree) for r in graph.degrees(n, e).select(F.col("*")).collect()}
    assert d == {"a": (1, 1), "b": (0, 1), "c": (1, 0)}


def test_components_join_the_whole_graph(spark):
    from graphloom.plans.views import Views

    v = Views(spark, "/root/testdata/sf0.001")
    root = {r.id: r.id for r in v.nodes.select("id").collect()}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for e in v.pairs.select("src", "dst").collect():
        if e.src in root and e.dst in root:
            a, b = find(e.src), find(e.dst)
            root[max(a, b)] = min(a, b)
    want = {i: find(i) for i in root}
    got = {r.id: (r.component, r.size) for r in entry.queries()["components"](spark, v.sf_dir).collect()}
    sizes = list(want.values())
    assert got == {i: (c, sizes.count(c)) for i, c in want.items()} and max(s for _, s in got.values()) > 1000


def test_pairs_cycles_and_heat_of_all_rows(spark):
    from graphloom.plans.views import Views

    q, v = entry.queries(), Views(spark, "/root/testdata/sf0.001")
    x = {r.vec_id: r.embedding for r in v.table("embeddings").collect()}
    cos = lambda a, b: sum(s * t for s, t in zip(a, b)) / (sum(s * s for s in a) * sum(t * t for t in b)) ** 0.5
    got = {(r.a, r.b): r.cosine for r in q["cosine_pairs"](spark, v.sf_dir).collect()}
    assert got == pytest.approx({(i, i + 1): cos(x[i], x[i + 1]) for i in x if i + 1 in x}, abs=2e-6)
    nation = {r.n_nationkey: r.n_regionkey for r in v.table("nation").collect()}
    want = {(f"customer/{r.c_custkey}", f"region/{r.c_custkey % 5}", nation[r.c_nationkey] == r.c_custkey % 5) for r in v.table("customer").collect()}
    out = q["cycle_candidates"](spark, v.sf_dir).collect()
    assert {(r.src, r.dst, r.cycle) for r in out} == want and len(out) == len(want) > 40
    edges = sorted((r.src, r.dst, r.relation) for r in v.pairs.collect())
    heat = sorted((r.src, r.dst, r.relation, r.heat) for r in q["heat_edges"](spark, v.sf_dir).collect())
    assert heat == [(*e, 0.5 if e[2] == "associated" else 0.0) for e in edges]


def test_would_cycle_searches_from_either_side(spark):
    rng = random.Random(4)
    edges = [(f"n{rng.randrange(12)}", f"n{rng.randrange(12)}", "contains", "structural", i) for i in range(14)]
    reach = {f"n{i}": {f"n{i}"} for i in range(12)}
    for _ in range(12):
        for s, d, *_rest in edges:
            for k in reach:
                reach[k] |= {d} if s in reach[k] else set()
    few, many = ["n1", "n5"], [f"n{i}" for i in range(12)]
    for pairs in ([(s, d) for s in few for d in many], [(s, d) for s in many for d in few]):
        out = graph.would_cycle(spark.createDataFrame(edges, EDGE), spark.createDataFrame(pairs, "src string, dst string")).collect()
        assert {(r.src, r.dst): r.cycle for r in out} == {(s, d): s in reach[d] for s, d in pairs}
