import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.operators import metric

ROWS = "vec_id bigint, embedding array<float>, other int"


def clustered(n, dim, seed=1, spread=0.05):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(40, dim))
    x = centres[rng.integers(0, 40, n)] + rng.normal(size=(n, dim)) * spread
    return x.astype(np.float32)


def table(spark, x, odd=()):
    return spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)] + [(10_000 + i, v, 2) for i, v in enumerate(odd)], ROWS).repartition(3)


ODD = [None, [], [None, 1.0], [float("nan")] * 2, [1.0, 2.0, 3.0]]


def scores(x, y):
    x, y = x.astype(np.float64), y.astype(np.float64)
    return 1 / (1 + np.sqrt(((x[:, None] - y) ** 2).sum(-1)))


def linked(x, least):
    near = scores(x, x) >= least
    np.fill_diagonal(near, False)
    root = np.arange(len(x))
    while True:
        new = np.minimum(root, np.where(near, root, len(x)).min(1))
        if (new == root).all():
            return {i: (int(near[i].sum()), int(root[i])) for i in range(len(x))}
        root = new


@pytest.mark.parametrize(("cell", "dim", "least"), [(8_192, 6, 0.86), (60, 6, 0.86), (60, 3, 0.5), (8_192, 8, 0.2), (60, 2, 0.99)])
def test_links_against_all_pairs(spark, monkeypatch, cell, dim, least):
    monkeypatch.setattr(metric, "CELL_ROWS", cell)
    monkeypatch.setattr(metric, "COPY_COST", 5.0)
    x = clustered(700, dim)
    x[600:] = x[:100]  # copies, and one vector a hundred times
    x[500:600] = x[7]
    got = metric.links(table(spark, x, ODD), least).collect()
    assert {r.id: (r.n_links, r.class_id) for r in got if r.id < 10_000} == linked(x, least)
    assert sorted((r.id, r.n_links, r.class_id) for r in got if r.id >= 10_000) == [(10_000 + i, 0, 10_000 + i) for i in range(len(ODD))]
    assert metric.links(table(spark, x).limit(0), least).count() == 0


@pytest.mark.parametrize(("cell", "k", "above"), [(8_192, 2, True), (60, None, False), (60, 3, False)])
def test_neighbours_against_all_pairs(spark, monkeypatch, cell, k, above):
    monkeypatch.setattr(metric, "CELL_ROWS", cell)
    monkeypatch.setattr(metric, "COPY_COST", 5.0)
    x, q = clustered(600, 6), np.concatenate([clustered(80, 6)[:60], clustered(30, 6, seed=9)])
    x[500:] = x[3]
    rows = table(spark, x, ODD).select(F.concat(F.lit("n"), F.format_string("%06d", "vec_id")).alias("node_id"), "embedding")
    asks = table(spark, q, ODD).select(F.col("vec_id").alias("query_id"), "embedding")
    got = metric.neighbours(rows, asks, 0.85, k, above).collect()
    s, want = scores(q, x), []
    for i in range(len(q)):
        best = sorted(((-s[i, j], f"n{j:06}") for j in range(len(x)) if (s[i, j] > 0.85 if above else s[i, j] >= 0.85)))[:k]
        want += [(i, name, round(-v, 9), rank + 1) for rank, (v, name) in enumerate(best)]
    # of one odd vector (three numbers) there is an equal one among the rows
    mine = sorted((r.query_id, r.node_id, round(r.score, 9), r["rank"]) for r in got if r.query_id < 10_000)
    assert mine == sorted(want)
    assert [(r.query_id, r.node_id) for r in got if r.query_id >= 10_000] == [(10_004, "n010004")]


def test_few_distances_on_clustered_vectors(spark):
    x = clustered(6_000, 16, spread=0.02)
    count = spark.sparkContext.accumulator(0)
    got = metric.links(table(spark, x), 0.9, count=count)
    assert got.where("n_links > 0").count() > 5_000
    assert count.value < 6_000**2 / 8


def test_a_dense_ball_is_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(metric, "CELL_ROWS", 50)
    x = np.random.default_rng(2).normal(size=(300, 4)).astype(np.float32) * 0.01
    got = metric.links(table(spark, x), 0.5).collect()
    assert {(r.n_links, r.class_id) for r in got} == {(299, 0)}


def test_planes_bound_distances():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 5))
    pivots = metric.farthest_first(x[:100], 12)
    home, _, reached = metric.cells_of(x, pivots, 0.7)
    near = ((x[:, None] - x) ** 2).sum(-1) <= 0.49
    for a, b in zip(*np.nonzero(near)):
        assert reached[a, home[b]] and reached[b, home[a]]
    assert reached.mean() < 0.8 and len(np.unique(pivots, axis=0)) == 12
    assert len(metric.farthest_first(np.ones((5, 3)), 4)) == 1
