import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from graphloom.functions import vectors
from graphloom.functions.vectors import HashEmbedder
from graphloom.operators import graph, heat, retrieval

EMB = "node_id string, embedding array<float>, model string, status string, vault_id string"


def store(spark, rows):
    return spark.createDataFrame([(i, v, m, s, "") for i, v, m, s in rows], EMB)


def ask(spark, *vs):
    return spark.createDataFrame([(f"q{i}", v) for i, v in enumerate(vs)], "query_id string, embedding array<float>")


def test_distance_and_codec(spark):
    df = spark.createDataFrame([([3.0, 0.0], [0.0, 4.0]), ([1.0], [1.0, 2.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    rows = df.select(vectors.l2_distance(F.col("a"), F.col("b")).alias("d"), vectors.cosine(F.col("a"), F.col("b")).alias("c")).collect()
    assert [r.d for r in rows] == [5.0, float("inf"), pytest.approx(2**0.5)] and [r.c for r in rows] == [0.0, 0.0, 0.0]
    back = df.select(vectors.decode_blob(vectors.encode_blob(F.col("a"))).alias("a")).collect()
    assert [r.a for r in back] == [[3.0, 0.0], [1.0], [0.0, 0.0]]
    assert spark.createDataFrame([(b"123",)], "b binary").select(vectors.decode_blob("b").alias("v")).first().v is None


def test_hash_embedder():
    e = HashEmbedder()
    v = e.embed_one("login handler")
    assert v.dtype == np.float32 and len(v) == 1536 and abs(np.linalg.norm(v) - 1) < 1e-6
    assert e.embed_one("")[0] == 1 and (e.embed_one("login handler") == v).all()
    near, far = e.embed_one("login handlers"), e.embed_one("xyzzy")
    assert np.dot(v, near) > np.dot(v, far)
    assert vectors.make_embedder("none").model == "mock" and vectors.make_embedder("x", {"x": lambda: 1 / 0}).model == "mock"


def test_search_guards_and_filters(spark):
    rows = [("a", [0.0, 0.0], "m", "active"), ("b", [1.0, 0.0], "m", "superseded"), ("c", [0.0, 2.0], "m", ""), ("d", [0.0, 0.0], "other", "active"), ("e", [1.0], "m", "active")]
    s, q = store(spark, rows), ask(spark, [0.0, 0.0])
    hits = lambda df: [r.node_id for r in df.orderBy("rank").collect()]
    assert hits(retrieval.search(s, q, 5, model="m")) == ["a", "b", "c"]
    assert hits(retrieval.search(s, q, 5, model="m", only_active=True)) == ["a", "c"]
    assert hits(retrieval.search(s, q, 1)) == ["a"]  # ties go to the smaller id
    for bad in (s, s.where("model = 'm'")):
        with pytest.raises(ValueError):
            retrieval.search(bad, q, 5, model="m", strict=True)
    many = store(spark, [(f"n{i:02d}", [0.0, 0.0], "m", "active") for i in range(15)])
    assert retrieval.find_similar(many, q, 0.5, "m").count() == 10
    assert retrieval.search(s.limit(0), q, 5).count() == 0


def test_federation_qualifies_and_dedupes(spark):
    rows = [(f"n{i}", [float(i), 0.0], "m", "active") for i in range(8)]
    s = store(spark, rows).withColumn("vault_id", F.when(F.col("node_id") < "n4", "").otherwise("far"))
    got = retrieval.federated(s, ask(spark, [0.0, 0.0])).orderBy("rank").collect()
    assert [r.node_id for r in got] == ["n0", "n1", "n2", "n3", "@far/n4", "@far/n5", "@far/n6"]


def chain(nodes_of):
    return nodes_of([
        {"id": "e", "edges": [("u", "references"), ("h", "calls"), ("gone", "calls"), ("old", "calls")], "context": "<code> & \"x\""}, {"id": "u", "edges": [("deep", "calls")]},
        {"id": "h", "source": ("src/h.py", [3, 9], "x"), "edges": [("deep", "calls"), ("e", "calls")]}, {"id": "deep"}, {"id": "old", "status": "superseded", "edges": [("behind", "calls")]}, {"id": "behind"},
    ])


def test_traversal_order(spark, nodes_of):
    n = chain(nodes_of)
    e = graph.edges_of(n)
    hot = spark.createDataFrame([("e", "h", 0.8)], "a string, b string, weight double")
    start = spark.createDataFrame([("e",), ("missing",)], "id string")
    order = lambda df: [(r.id, r.depth) for r in df.orderBy("ord").collect()]
    assert order(retrieval.traverse(n, e, start, hot)) == [("e", 0), ("h", 1), ("u", 1), ("deep", 2)]
    assert order(retrieval.traverse(n, e, start))[:2] == [("e", 0), ("u", 1)]  # edge order without heat
    assert "behind" not in dict(order(retrieval.traverse(n, e, start, depth=5)))  # superseded nodes block
    assert "behind" in dict(order(retrieval.traverse(n, e, start, depth=5, include_inactive=True)))
    assert order(retrieval.traverse(n, e, start, mode="deep")) == order(retrieval.traverse(n, e, start))


def test_document(spark, nodes_of):
    n = chain(nodes_of)
    e = graph.edges_of(n)
    sub = retrieval.traverse(n, e, spark.createDataFrame([("e",)], "id string"))
    packed = retrieval.pack(retrieval.render(sub, n, e), 4096)
    doc = retrieval.document(packed).first()
    assert '<node id="e" type="function" depth="0" status="active">' in doc.xml
    assert "&lt;code&gt; &amp; &#34;x&#34;" in doc.xml and '<source path="src/h.py" lines="3-9"/>' in doc.xml
    assert doc.xml.index("<node ") < doc.xml.index("<node_compact") and doc.nodes == 4 and doc.tokens == len(doc.xml.encode()) // 4
    tight = retrieval.document(retrieval.pack(retrieval.render(sub, n, e), 60)).first()
    assert "<truncated>" in tight.xml and "e" in tight.truncated


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(0, 300), min_size=1, max_size=15), st.integers(0, 200))
def test_first_fit_is_a_fold(spark, sizes, budget):
    used, want, room = 0, [], max(4 * budget, 120) - 120
    for n in sizes:
        want.append(used + n <= room)
        used += n if want[-1] else 0
    parts = spark.createDataFrame([(0, i, "x" * n) for i, n in enumerate(sizes)], "query_id int, ord int, part string")
    assert [r.included for r in retrieval.pack(parts, budget).orderBy("ord").collect()] == want


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from("abcde"), max_size=5), max_size=12))
def test_heat_closed_form(spark, reads):
    weights = {}
    for ids in reads:
        s = sorted(set(ids))
        for i, a in enumerate(s):
            for b in s[i + 1 :]:
                w, n = weights.get((a, b), (0.0, 0))
                weights[a, b] = (min(1.0, w + (1 - w) * 0.1), n + 1)
    rows = [(q, n) for q, ids in enumerate(reads) for n in ids]
    got = heat.accumulate(heat.pairs(spark.createDataFrame(rows, "query_id int, node_id string"))).collect()
    assert {(r.a, r.b): r.hits for r in got} == {k: n for k, (_, n) in weights.items()}
    assert all(abs(r.weight - weights[r.a, r.b][0]) < 1e-12 for r in got)


def test_heat_rest(spark):
    h = spark.createDataFrame([("", "a", "b", 0.9, 3, ""), ("", "b", "c", 0.055, 1, "")], "namespace string, a string, b string, weight double, hits int, last string")
    assert heat.decay(h, 1000).agg(F.min("weight")).first()[0] == 0.05
    assert heat.promoted(h).count() == 1 and heat.promotion_edges(h).first().relation == "associated"
    only = spark.createDataFrame([("c",)], "id string")
    assert heat.touching(h, only).count() == 1 and heat.visible(h, only).count() == 0
    assert heat.weight_of(h, "b", "a") == 0.9 and heat.weight_of(h, "a", "z") == 0.0
    assert {r.id: round(r.heat, 3) for r in heat.overlay(h).collect()} == {"b": 1.0, "a": 0.942, "c": 0.058}
    again = heat.merge(h, spark.createDataFrame([("", "a", "b", 1, "t")], "namespace string, a string, b string, hits int, last string")).where("a = 'a'").first()
    assert (round(again.weight, 6), again.hits, again.last) == (0.91, 4, "t")


@pytest.mark.parametrize("few", [4096, 30])
def test_searches_of_every_vector(spark, monkeypatch, few):
    """Queries that travel with the tasks, and queries that stream past dealt rows."""
    from graphloom.plans.views import Views

    monkeypatch.setattr(retrieval, "FEW_QUERIES", few)
    v = Views(spark, "/root/testdata/sf0.001")
    q = v.vectors(1)
    odd = spark.createDataFrame([("odd", 9000, [1.0], "m0", "active", 3, "v0"), ("none", 9001, None, "m0", "active", 3, "v0")], "node_id string, vec_id bigint, embedding array<float>, model string, status string, label int, vault_id string")
    emb = v.embeddings.select("node_id", "vec_id", "embedding", "model", "status", "label", "vault_id").unionByName(odd)
    rows = sorted((r.vec_id, r.node_id, r.status, r.model, r.vault_id, r.label, np.array(r.embedding, float)) for r in v.embeddings.collect())
    score = {(a[0], b[0]): 1 / (1 + np.sqrt(((a[6] - b[6]) ** 2).sum())) for a in rows for b in rows}

    def best(keep, k, group=lambda r: 0, least=0.0):
        out = {}
        for a in rows:
            for g in {group(r) for r in rows}:
                hits = sorted((-score[a[0], b[0]], b[1]) for b in rows if group(b) == g and keep(b) and score[a[0], b[0]] >= least)
                out |= {(a[0], h[1]): (-h[0], n + 1) for n, h in enumerate(hits[:k])}
        return out

    def close(df, want):
        found = {(r.query_id, r.node_id): (r.score, r["rank"]) for r in df.collect()}
        return found.keys() == want.keys() and all(abs(found[k][0] - want[k][0]) < 1e-9 and found[k][1] == want[k][1] for k in want)

    assert close(retrieval.search(emb, q, 5), best(lambda r: True, 5))
    assert close(retrieval.search(emb, q, 5, model="m0", only_active=True), best(lambda r: r[2] == "active" and r[3] == "m0", 5))
    assert close(retrieval.find_similar(emb, q, 0.45), best(lambda r: r[2] == "active", 10, least=0.45))
    assert close(retrieval.search(emb, q, 3, by=["vault_id"]), best(lambda r: True, 3, lambda r: r[4]))
    assert retrieval.search(emb, q.limit(0), 5).count() == 0


def test_pack_folds_long_lists_in_steps(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(g, i, "x" * int(rng.choice([1, 5, 40, 300, 900]))) for g in ("a", "b", None) for i in range(400)]
    want = {}
    for g in ("a", "b", None):
        used = 0
        for _, i, part in (r for r in rows if r[0] == g):
            want[g, i] = used + len(part) <= 1000 * 4 - 120
            used += len(part) if want[g, i] else 0
    for step in (1000, 7):
        monkeypatch.setattr(retrieval, "STRETCH_ROWS", step)
        out = retrieval.pack(spark.createDataFrame(rows, "query_id string, ord int, part string"), 1000).collect()
        got = {(r.query_id, r.ord): r.included for r in out}
        assert {k: v for k, v in got.items() if k[0]} == {k: v for k, v in want.items() if k[0]} and len(out) == len(rows)


def test_duplicates_find_pairs_of_any_ids(spark):
    from graphloom.plans.views import Views

    sf = "/root/testdata/sf0.001"
    x = {r.node_id: np.array(r.embedding, float) for r in Views(spark, sf).embeddings.collect()}
    want = {}
    for a, p in x.items():
        for s, b in sorted((-1 / (1 + np.sqrt(((p - q) ** 2).sum())), b) for b, q in x.items())[:2]:
            if b != a and -s > 0.46:
                want[min(a, b), max(a, b)] = -s
    got = {(r.a, r.b): r.score for r in entry.queries()["duplicates"](spark, sf).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-5 for k in got)
    assert any(min(int(i[4:]) for i in k) >= 20 for k in got)


def test_pack_fills_long_lists_at_once(spark, monkeypatch):
    from graphloom import storage

    made = []
    whole = storage.materialize
    monkeypatch.setattr(retrieval, "materialize", lambda df, label, *rest: made.append(label) or whole(df, label, *rest))
    n = 600_000
    size = F.when(F.col("id") % 9973 == 0, 1).when(F.col("id") % 1000 == 7, 0).otherwise(F.pmod(F.xxhash64("id"), F.lit(900)) + 2).cast("int")
    parts = spark.range(n).select(F.when(F.col("id") % 3 == 0, "big").otherwise("other").alias("query_id"), F.col("id").alias("ord"), F.repeat(F.lit("x"), size).alias("part"))
    out = retrieval.pack(parts, 4096).where("included").groupBy("query_id").agg(F.sort_array(F.collect_list("ord")).alias("taken")).collect()
    sizes = parts.select("ord", F.length("part").alias("n")).orderBy("ord").toPandas()["n"].to_numpy()
    for r in out:
        used, want = 0, []
        for i in range(n):
            if (i % 3 == 0) == (r.query_id == "big") and used + sizes[i] <= 4096 * 4 - 120:
                used += sizes[i]
                want.append(i)
        assert r.taken == want
    assert len(out) == 2 and made == ["pack", "pack-taken"]


def test_parts_that_cannot_fit_go_early():
    import pyarrow as pa

    rng = np.random.default_rng(7)
    for room in (100, 1000):
        n = rng.integers(0, 60, 3000)
        batches = [pa.table({"q": ["a"] * 3000, "ord": np.arange(3000), "bytes": pa.array(n, pa.int32())}).to_batches(max_chunksize=700)]
        kept = set(np.concatenate([b.column("ord").to_numpy() for b in retrieval._may_fit(room)(batches[0])]).tolist())
        used, taken = 0, set()
        for i, b in enumerate(n):
            if used + b <= room:
                used += b
                taken.add(i)
        assert taken <= kept and len(kept) < 3000 * (0.1 if room == 100 else 0.4)


@pytest.mark.parametrize("few", [4096, 1])
def test_every_vault_is_asked_with_its_own_model(spark, monkeypatch, few):
    monkeypatch.setattr(retrieval, "FEW_QUERIES", few)

    class Letters:
        def __init__(self, model, letters):
            self.model, self.letters, self.dimension = model, letters, len(letters)

        def embed(self, texts):
            return [np.array([t.count(c) for c in self.letters], np.float32) for t in texts]

    models = {"small": Letters("small", "ab"), "large": Letters("large", "abcd"), "same": Letters("same", "dcba")}
    texts = {f"{v}{i}": "a" * (i % 3) + "b" * (i % 4) + "c" * (i % 2) + "d" * (i % 5) for v in "xyzw" for i in range(12)}
    own = {"x": "small", "y": "large", "z": "same", "w": "unknown"}
    rows = [(k, models[own[k[0]]].embed([t])[0].tolist() if own[k[0]] in models else [1.0, 1.0], own[k[0]], "active", k[0]) for k, t in texts.items()]
    store = spark.createDataFrame(rows, "node_id string, embedding array<float>, model string, status string, vault_id string")
    asked = spark.createDataFrame([("q1", "aabbdd"), ("q2", "c"), ("q3", None)], "query_id string, text string")
    q = retrieval.query_vectors(asked, [*own.values()], models)
    assert q.count() == 9
    got = retrieval.federated(store, q, "x", limit=100).collect()
    want = []
    for name, text in (("q1", "aabbdd"), ("q2", "c"), ("q3", "")):
        for v in "xyz":
            e = models[own[v]]
            a = e.embed([text])[0]
            best = sorted((-1 / (1 + float(np.sqrt(((e.embed([t])[0] - a) ** 2).sum()))), k) for k, t in texts.items() if k[0] == v)[: 5 if v == "x" else 3]
            want += [(name, k if v == "x" else f"@{v}/{k}", round(-s, 6)) for s, k in best]
    assert sorted((r.query_id, r.node_id, round(r.score, 6)) for r in got) == sorted(want)
    assert retrieval.query_vectors(asked, ["unknown"], models).count() == 0
