import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import graph, scc

EDGE = "src string, dst string"


def reach_of(edges):
    """Every vertex with all that it reaches, itself included."""
    out = {}
    for s, d in edges:
        out.setdefault(s, set()).add(d)
        out.setdefault(d, set())
    full = {}
    for v in out:
        seen, todo = {v}, [v]
        while todo:
            for w in out[todo.pop()]:
                if w not in seen:
                    seen.add(w)
                    todo.append(w)
        full[v] = seen
    return full


def labels_of(edges):
    reach = reach_of(edges)
    own = {v: min(w for w in reach[v] if v in reach[w]) for v in reach}
    steps = {(own[s], own[d]) for s, d in edges if own[s] != own[d]}
    level = {}

    def longest(v):
        if v not in level:
            level[v] = max((longest(s) + 1 for s, d in steps if d == v), default=0)
        return level[v]

    return {v: (own[v], longest(own[v])) for v in reach}


def many_graphs():
    """Random graphs of all densities, paths, rings and both together, as one table."""
    rng, edges = random.Random(4), []
    for g in range(60):
        n = rng.randint(2, 14)
        name = lambda i, g=g: f"{g:02}/{i:02}"
        for _ in range(rng.randint(1, 2 * n)):
            edges.append((name(rng.randrange(n)), name(rng.randrange(n))))
    ring = [f"r{i}" for i in range(9)]
    edges += list(zip(ring, ring[1:] + ring[:1]))
    tail = [f"t{i}" for i in range(12)]  # into a ring and out of it again
    edges += list(zip(tail, tail[1:])) + [("t7", "t3"), ("t11", "x"), ("t11", "y"), ("x", "z"), ("y", "z"), ("self", "self")]
    return edges


@pytest.fixture(scope="module")
def condensed(spark):
    return scc.condense(spark.createDataFrame(many_graphs(), EDGE))


def test_components_and_levels_against_search(spark, condensed):
    edges = many_graphs()
    assert {r.id: (r.scc, r.level) for r in condensed.nodes.collect()} == labels_of([e for e in edges if e[0] != e[1]])


def test_components_of_repeated_and_missing_edges(spark):
    edges = many_graphs()
    df = spark.createDataFrame(edges + edges[:50] + [(None, "a"), ("a", None)], EDGE)
    want = labels_of([e for e in edges if e[0] != e[1]])
    assert {r.id: r.scc for r in scc.components(df).collect()} == {v: s for v, (s, _) in want.items()}
    assert scc.condense(df.limit(0)).nodes.count() == 0 and scc.components(df.where("src = dst")).count() == 0


def test_reachability_of_all_pairs(spark, condensed):
    edges = many_graphs()
    reach = reach_of(edges)
    rng = random.Random(6)
    ids = sorted(reach)
    pairs = [(a, b) for a in ids for b in ids if a[:2] == b[:2] or rng.random() < 0.01] + [("?", "?"), ("?", ids[0]), (ids[0], "?")]
    out = scc.reaches(condensed, spark.createDataFrame(pairs * 2, "a string, b string")).collect()
    assert len(out) == len(set(pairs))
    assert {(r.a, r.b) for r in out if r.reached} == {(a, b) for a, b in pairs if a == b or b in reach.get(a, ())}


def test_downstream(spark, condensed):
    edges = many_graphs()
    reach = reach_of(edges)
    starts = random.Random(2).sample(sorted(reach), 12)
    out = scc.downstream(condensed, spark.createDataFrame([(s,) for s in starts + starts + ["?"]], "id string"))
    assert sorted(r.id for r in out.collect()) == sorted(set().union(*(reach[s] for s in starts)) - {"self"} | ({"self"} & set(starts)))


@pytest.fixture()
def written(monkeypatch):
    from graphloom import storage

    made, whole = [], storage.materialize

    def count(df, label, *rest):
        made.append(label)
        return whole(df, label, *rest)

    monkeypatch.setattr(scc, "materialize", count)
    return made


def test_a_long_chain_takes_few_rounds(spark, written):
    n = 10_000
    chain = spark.range(n - 1).select(F.format_string("%05d", "id").alias("src"), F.format_string("%05d", F.col("id") + 1).alias("dst"))
    nodes = scc.condense(chain).nodes
    assert nodes.where("cast(id AS int) = level AND scc = id").count() == n
    assert len(written) < 80  # doubling, where peeling would write ten thousand tables


def test_many_candidates_at_once(spark, written):
    n = 2_000
    chain = spark.range(n - 1).select(F.format_string("%05d", "id").alias("src"), F.format_string("%05d", F.col("id") + 1).alias("dst"), F.lit("contains").alias("relation"))
    fork = spark.range(0, n, 50).select(F.format_string("%05d", "id").alias("src"), F.format_string("leaf%05d", "id").alias("dst"), F.lit("imports").alias("relation"))
    candidates = [(f"{(7 * i) % n:05}", f"{(11 * i + 3) % n:05}") for i in range(9_000)] + [(f"leaf{50 * i:05}", f"{(77 * i) % n:05}") for i in range(60)] + [(f"{i:05}", f"leaf{i:05}") for i in range(0, n, 50)]
    out = graph.would_cycle(chain.unionByName(fork), spark.createDataFrame(candidates, EDGE)).collect()
    assert len(out) == len(candidates)
    for r in out:
        src, dst = int(r.src[-5:]), int(r.dst[-5:])
        assert r.cycle == (dst <= src if not r.dst.startswith("leaf") else r.src == r.dst), r
    assert "search-seen" in written and not any(label == "bfs" for label in written)


def test_what_is_downstream_of_a_cycle_on_long_paths(spark, nodes_of, monkeypatch):
    """Peeling loses patience on a long path; components find the same."""
    chain = [(f"c{i:03}", f"c{i + 1:03}") for i in range(40)]
    edges = chain + [("x", "y"), ("y", "x"), ("y", "d0"), ("d0", "d1"), ("d1", "c038"), ("self", "self"), ("self", "s1")]
    names = sorted({v for e in edges for v in e})
    nodes = spark.createDataFrame([(v,) for v in names], "id string")
    df = spark.createDataFrame([(*e, "contains") for e in edges], "src string, dst string, relation string")
    for patience in (1, 10**6):
        monkeypatch.setattr(graph, "PATIENCE", patience)
        got = sorted(r.id for r in graph.cycle_residual(nodes, df).collect())
        assert got == ["c038", "c039", "c040", "d0", "d1", "s1", "self", "x", "y"]


@pytest.mark.parametrize("chunk", [3, 50])
def test_paths_over_chunks(spark, chunk):
    """Rings and paths that lie in one chunk and in several, with repeated edges and without."""
    edges = many_graphs()
    edges += [(f"q{i:03}", f"q{(i + 1) % 300:03}") for i in range(300)] + [(f"s{i:03}", f"s{i + 1:03}") for i in range(200)] + [("s200", "s050")]
    want = labels_of([e for e in edges if e[0] != e[1]])
    df = spark.createDataFrame(edges if chunk == 3 else sorted(set(edges)), EDGE).coalesce(2)
    rows = scc.condense(df, chunk).nodes.collect()
    assert {r.id: (r.scc, r.level) for r in rows} == want and len(rows) == len(want)


def test_paths_are_not_written_once_a_round(spark, monkeypatch):
    """Edges that lie together are joined there; of each vertex few rows are written, however long its path."""
    from graphloom import storage

    made, whole = [], storage.materialize
    monkeypatch.setattr(scc, "materialize", lambda df, label, *rest: made.append(whole(df, label, *rest)) or made[-1])
    n = 4_096
    chain = spark.range(0, n - 1, 1, 2).select(F.format_string("%05d", "id").alias("src"), F.format_string("%05d", F.col("id") + 1).alias("dst"))
    assert scc.condense(chain).nodes.where("cast(id AS int) = level").count() == n
    assert sum(df.count() for df in made) < 6 * n
