import random

from graphloom.operators.containment import implements

ROW = "package string, id string, method string"


def test_methods_in_any_file_of_a_package(spark):
    rng = random.Random(3)
    methods = [f"m{i}" for i in range(12)]
    wants = {(p, f"{p}.I{i}"): set(rng.sample(methods, rng.randint(1, 4))) for p in ("a", "b") for i in range(30)}
    has = {(p, f"{p}.T{i}"): set(rng.sample(methods, rng.randint(0, 9))) for p in ("a", "b") for i in range(40)}
    wants[("a", "a.Rare")] = {"m1", "none has it"}
    rows = lambda sets: [(p, i, m) for (p, i), s in sets.items() for m in s]
    interfaces = spark.createDataFrame(rows(wants) * 2 + [("a", "a.I0", None), ("a", None, "m1"), (None, "loose.I", "m1")], ROW).repartition(4)
    types = spark.createDataFrame(rows(has) + [(None, "loose.T", "m1"), (None, "loose.U", "m2")], ROW).repartition(4)
    got = implements(interfaces, types)
    want = {(t, i) for (p, i), w in wants.items() for (q, t), h in has.items() if p == q and w <= h} | {("loose.T", "loose.I")}
    assert sorted((r.src, r.dst) for r in got.collect()) == sorted(want) and {r.relation for r in got.collect()} == {"implements"}
    assert implements(interfaces.limit(0), types).count() == 0 and implements(interfaces, types.limit(0)).count() == 0


def test_pairs_that_fail_are_not_stored(spark, monkeypatch):
    """All interfaces and types of one package share a method, and nothing else: what is written grows with the rows, not with the pairs."""
    from graphloom.operators import containment

    kept = []
    written = containment.materialize
    monkeypatch.setattr(containment, "materialize", lambda df, label: kept.append(written(df, label)) or kept[-1])
    n = 200
    rows = lambda kind: spark.range(n).selectExpr("'p' AS package", f"'{kind}' || id AS id", f"explode(array('all', '{kind}' || id)) AS method")
    also = spark.createDataFrame([("p", f"T{i}", "I7") for i in range(n)], ROW)
    got = containment.implements(rows("I"), rows("T").unionByName(also))
    assert sorted((r.src, r.dst) for r in got.collect()) == sorted((f"T{i}", "I7") for i in range(n))
    assert max(t.count() for t in kept) <= 4 * n


def test_many_methods_share_bits(spark, monkeypatch):
    from graphloom.operators import containment

    monkeypatch.setattr(containment, "WIDE", 64)
    rng = random.Random(4)
    methods = {"a": [f"m{i}" for i in range(300)], "b": [f"m{i}" for i in range(20)]}
    # ids are in both packages, so that a pair may be found twice
    wants = {(p, f"I{i}"): set(rng.sample(methods[p], rng.randint(1, 3))) for p in methods for i in range(25)}
    has = {(p, f"T{i}"): set(rng.sample(methods[p], len(methods[p]) * (i % 4 + 1) // 5)) for p in methods for i in range(25)}
    rows = lambda sets: spark.createDataFrame([(p, i, m) for (p, i), s in sets.items() for m in sorted(s)], ROW)
    got = containment.implements(rows(wants), rows(has)).collect()
    assert sorted((r.src, r.dst) for r in got) == sorted({(t, i) for (p, i), w in wants.items() for (q, t), h in has.items() if p == q and w <= h})


def _joined(plan):
    """The most rows that a join of an executed plan has put out."""
    if plan.nodeName() == "AdaptiveSparkPlan":
        return _joined(plan.executedPlan())
    own = plan.metrics().get("numOutputRows").get().value() if "Join" in plan.nodeName() else 0
    below = plan.children()
    return max([own, *(_joined(below.apply(i)) for i in range(below.size())), *([_joined(plan.plan())] if "QueryStage" in plan.nodeName() else [])])


def test_equal_sets_meet_once(spark):
    n = 400
    rows = lambda kind: spark.range(n).selectExpr("'p' AS package", f"'{kind}' || id AS id", "explode(array('a', 'b', 'c')) AS method")
    got = implements(rows("I"), rows("T"))
    assert {(r.src, r.dst) for r in got.collect()} == {(f"T{i}", f"I{k}") for i in range(n) for k in range(n)}
    assert 0 < _joined(got._jdf.queryExecution().executedPlan()) <= n


def test_blocks_too_large_to_broadcast(spark, monkeypatch):
    from graphloom.operators import containment

    rng = random.Random(5)
    methods = [f"m{i}" for i in range(90)]
    sizes = [1, 2, 4, 5, 8, 9, 40, 70]  # also beyond the methods that are looked up without a lambda
    has = {(p, f"T{i}"): set(rng.sample(methods, 88)) if i % 3 else {"m1", "m2"} for p in ("a", "b") for i in range(120)}
    wants = {(p, f"{p * (i % 2)}I{i}"): set(rng.sample(methods, sizes[i % 8])) if i % 4 else {"m1"} for p in ("a", "b") for i in range(160)}
    rows = lambda sets: spark.createDataFrame([(p, i, m) for (p, i), s in sets.items() for m in sorted(s)], ROW)
    want = sorted({(t, i) for (p, i), w in wants.items() for (q, t), h in has.items() if p == q and w <= h})
    assert sorted((r.src, r.dst) for r in containment.implements(rows(wants), rows(has)).collect()) == want
    monkeypatch.setattr(containment, "broadcast_if_small", lambda df: df)
    monkeypatch.setattr(containment, "PAIRS", 5_000)
    monkeypatch.setattr(containment, "BUCKET", 16)
    assert sorted((r.src, r.dst) for r in containment.implements(rows(wants), rows(has)).collect()) == want
