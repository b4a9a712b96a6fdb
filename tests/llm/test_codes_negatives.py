import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.llm import hard_negatives, vector_codes

SCHEMA = "vec_id bigint, embedding array<float>, label int, code string, score bigint, shard int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, y, "clash", 1, 2) for i, v, y in rows], SCHEMA).repartition(5)


def odd_rows(dim):
    nan, inf = float("nan"), float("inf")
    return [(9001, None, 1), (9002, [], 1), (9003, [nan] + [0.5] * (dim - 1), 2), (9004, [None] + [0.5] * (dim - 1), 2), (9005, [inf] + [0.5] * (dim - 1), 3), (9006, [1e30] * dim, 3)]


def codes_by_hand(rows, parts, entries, rounds):
    """rows: (id, vector, label) that take part, in order of ids."""
    x = [[math.floor(256 * float(np.float32(c))) for c in v] for _, v, _ in rows]
    w = len(x[0]) // parts
    cut = lambda v, p: v[p * w : (p + 1) * w]
    far = lambda a, b: sum((i - j) ** 2 for i, j in zip(a, b))
    books = [[cut(v, p) for v in x[:entries]] for p in range(parts)]
    near = lambda v, p: min((far(cut(v, p), b), e) for e, b in enumerate(books[p]))
    for _ in range(rounds):
        own = [[near(v, p)[1] for v in x] for p in range(parts)]
        for p in range(parts):
            groups = {e: [cut(v, p) for v, o in zip(x, own[p]) if o == e] for e in set(own[p])}
            for e, g in groups.items():
                books[p][e] = [sum(c) // len(g) for c in zip(*g)]
    out = [[near(v, p) for p in range(parts)] for v in x]
    errors = [sum(d for d, _ in o) for o in out]
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    by = {}
    for (_, _, y), e in zip(rows, errors):
        by[y] = by.get(y, 0) + e
    return sorted((i, "".join(f"{e:02x}" for _, e in o), err, by[y], sha) for (i, _, y), o, err in zip(rows, out, errors))


def test_codes_against_loops(spark):
    rng = np.random.default_rng(3)
    rows = [(i * 3 - 50, rng.normal(size=32).astype(np.float32).tolist(), None if i % 9 == 0 else i % 4) for i in range(300)]
    rows += [(5000 + i, [0.25] * 32, 1) for i in range(150)]  # a hot label of equal vectors: ties
    rows += [(7000, [0.0] * 32, 2)]
    got = vector_codes.compress(table(spark, rows + odd_rows(32) + [(8000, [0.5] * 16, 1)]))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect())) == codes_by_hand(sorted(rows), 16, 64, 2)


def test_codes_of_few_and_no_rows(spark):
    few = [(2, [0.1] * 16, None), (1, [-0.1] * 16, 5), (2, [0.1] * 16, None)]
    got = sorted(map(tuple, vector_codes.compress(table(spark, few)).collect()))
    assert [g[:4] for g in got] == [(1, "00" * 16, 0, 0), (2, "01" * 16, 0, 0), (2, "01" * 16, 0, 0)]
    assert vector_codes.compress(table(spark, few).limit(0)).count() == 0
    assert vector_codes.compress(table(spark, odd_rows(16))).count() == 0
    none = vector_codes.compress(table(spark, [(None, [0.5] * 16, 1), (4, [0.25] * 16, 1)]), entries=1, rounds=0).collect()
    assert {(r.vec_id, r.error) for r in none} == {(4, 0), (None, 16 * 64**2)}
    with pytest.raises(ValueError):
        vector_codes.compress(table(spark, few), entries=257)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(-3, 3), min_size=2, max_size=2), min_size=1, max_size=30), st.integers(1, 9))
def test_nearest_entry_is_the_first_of_equals(points, k):
    x = np.array(points, np.int64)
    index, error = vector_codes.nearest_entry(x, x[:k])
    want = [min((int(((p - b) ** 2).sum()), e) for e, b in enumerate(x[:k])) for p in x]
    assert list(zip(error.tolist(), index.tolist())) == want


def mined_by_hand(rows, asks):
    x = {i: (np.array([math.floor(256 * float(np.float32(c))) for c in v], object), y) for i, v, y in rows}
    out = []
    for a in filter(asks, x):
        scored = sorted((-int(x[a][0] @ v), i, y == x[a][1]) for i, (v, y) in x.items() if i != a)
        for p, pid, _ in [s for s in scored if s[2]][:5]:
            good = [(i, -s) for s, i, same in scored if not same and 80 * -p <= 100 * -s <= 100 * -p]
            out += [(a, pid, r + 1, i, -p, s) for r, (i, s) in enumerate(good[:5])]
    return sorted(out)


def clustered(rng, n, dim):
    """Vectors of a few directions with much variance, so that leading components say something; many equal ones."""
    centres = rng.normal(size=(6, dim)) * np.linspace(2, 0.1, dim)
    rows = [(i, (centres[i % 6] + rng.normal(size=dim) * 0.2).astype(np.float32).tolist(), int(rng.integers(0, 4)) if i % 3 else 1) for i in range(n)]
    return rows + [(n + i, rows[i % 5][1], i % 2) for i in range(60)] + [(n + 60, [0.0] * dim, 1)]


@pytest.mark.parametrize("dim", [48, 6])
def test_negatives_against_loops(spark, monkeypatch, dim):
    monkeypatch.setattr(hard_negatives, "LEAST_SHARD", 100)
    monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", 7)
    rows = clustered(np.random.default_rng(8), 500, dim)
    odd = odd_rows(dim) + [(9100, rows[0][1], None), (None, rows[0][1], 1), (9200, [0.5] * (dim + 1), 1)]
    got = hard_negatives.mine(table(spark, rows + odd), F.col("vec_id") % 20 == 0, F.col("label"))
    assert sorted(map(tuple, got.collect())) == mined_by_hand(rows, lambda i: i % 20 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_negatives_of_few_repeated_and_no_rows(spark):
    one = [1.0, 0.0]
    rows = [(100, one, 1), (100, one, 1), (1, one, 1), (2, [0.9, 0.0], 2), (2, [0.8, 0.0], 3), (3, [0.5, 0.0], 2)]
    got = hard_negatives.mine(table(spark, rows), F.col("vec_id") % 100 == 0, F.col("label")).collect()
    assert [(r.anchor_id, r.positive_id, r.rank, r.negative_id) for r in got] == [(100, 1, 1, 2)]
    assert got[0].negative_score == 256 * math.floor(256 * float(np.float32(0.9)))
    assert hard_negatives.mine(table(spark, rows).limit(0), F.col("vec_id") % 100 == 0, F.col("label")).count() == 0
    below = [(100, one, 1), (1, [-1.0, 0.0], 1), (2, [-0.9, 0.0], 2)]  # of a score below zero nothing is in range
    assert hard_negatives.mine(table(spark, below), F.col("vec_id") == 100, F.col("label")).count() == 0


def test_leading_components_discard_most_rows():
    rng = np.random.default_rng(5)
    rows = clustered(rng, 4000, 64)
    x = vector_codes.whole(np.array([v for _, v, _ in rows]))
    axes = np.linalg.eigh(x.T.astype(float) @ x)[1][:, ::-1]
    shard = hard_negatives.Shard(np.arange(len(x)), np.zeros(len(x), np.int64), x, axes)
    low, high, later = shard.bounds(x[:3])
    exact = x[:3] @ x.T
    assert (low <= exact).all() and (exact <= high).all()
    kth = np.sort(low, axis=1)[:, -5]
    assert (high >= kth[:, None]).mean() < 0.4  # after 8 of 64 components
    for level in range(len(shard.levels)):
        lo, hi = later(0, np.arange(len(x)), level)
        assert (lo <= exact[0]).all() and (exact[0] <= hi).all()
