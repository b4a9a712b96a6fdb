import hashlib

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from graphloom.functions import text as tx
from graphloom.operators import classify, graph, integrity, mutations


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "s string").select(f("s").alias("v")).first().v


def test_texts(spark):
    assert one(spark, "see [[a/b]] and [[c]] [[a/b]]", tx.wikilinks) == ["a/b", "c"]
    assert one(spark, 'a"\\\n', tx.quote) == '"a\\"\\\\\\n"'
    assert one(spark, "one\n\ntwo\n## Next\nx", tx.body_summary) == "one\n\ntwo"
    assert one(spark, "x\n## Context\n\ncode\n\n## More\ny", lambda c: tx.body_section(c, "Context")).strip() == "code"
    for bad in ("", "/a", "a//b", "a/../b", ".x/a", "a/.b", "x" * 513, None):
        assert not one(spark, bad, tx.valid_id)
    assert one(spark, "a/b-c", tx.valid_id)
    for url in ("https://me:pw@Host.com/A/B.git", "git@host.com:A/B.git", "ssh://git@HOST.com/A/B/", "host.com/A/B"):
        assert one(spark, url, tx.canonical_url) == "host.com/A/B"
    assert one(spark, "ééé", lambda c: tx.cut_utf8(c, 3)) == "é" and one(spark, "éé", tx.token_estimate) == 1
    assert [one(spark, s, tx.slug) for s in ("My  Project!", "--", "Été 2")] == ["my-project", "project", "été-2"]
    assert [one(spark, s, tx.secret_key) for s in ("OPENAI_API_KEY", "auth_token", "token_budget", "path")] == [True, True, False, False]
    assert one(spark, "sk-" + "a" * 20, tx.secret_value) and not one(spark, "sk-short", tx.secret_value)
    assert one(spark, "```json\n{}\n```", tx.strip_fence) == "{}" and one(spark, " a, ,b ", tx.csv_list) == ["a", "b"]
    assert [one(spark, s, tx.infer_type) for s in ("auth/handler", "user_model", "pkg/x", "the_api", "a_test", "z")] == ["function", "type", "package", "api", "test", "concept"]


def test_integrity_issues(spark, nodes_of):
    n = nodes_of([
        {"id": "a", "edges": [("gone", "contains"), ("lib", "imports"), ("@far/x", "calls")], "source": ("a.py", [0, 0], "h1")}, {"id": "b", "source": ("b.py", [0, 0], "h2")},
        {"id": "c", "status": "superseded"}, {"id": "d", "status": "superseded", "superseded_by": "nobody"}, {"id": "e", "valid_from": "2024-02-01T00:00:00Z", "valid_until": "2024-01-01T00:00:00Z"},
        {"id": "f", "edges": [("g", "contains")]}, {"id": "g", "edges": [("f", "contains")]}, {"id": "h", "valid_from": "2024-01-01T00:00:00Z", "valid_until": "2024-01-01T00:00:00Z"},
    ])
    files = spark.createDataFrame([("a.py", "other")], "path string, hash string")
    got = sorted((r.node_id, r.issue_type, r.severity) for r in integrity.integrity(n, files=files).collect())
    assert got == [
        ("a", "dangling_edge", "error"), ("a", "dangling_edge", "info"), ("a", "hash_mismatch", "warning"), ("b", "missing_source", "warning"), ("c", "hash_mismatch", "warning"),
        ("d", "dangling_edge", "warning"), ("e", "hash_mismatch", "warning"), ("f", "structural_cycle", "error"),
    ]
    subset = n.where("id = 'f'")
    assert integrity.integrity(subset, known=n).where("issue_type = 'dangling_edge'").count() == 0
    both = integrity.verify(n, files).where("node_id = 'a'").select("issue_type").collect()
    assert {"hash_mismatch", "stale"} <= {r.issue_type for r in both}
    assert {r.severity: r.n for r in integrity.issue_counts(integrity.integrity(n)).collect()}["error"] == 2


def test_staleness(spark, nodes_of):
    n = nodes_of([{"id": "a", "source": ("a", [0, 0], "1"), "edges": []}, {"id": "b", "source": ("b", [2, 3], "2"), "edges": [("a", "calls")]}, {"id": "c", "edges": [("b", "calls")]}, {"id": "d", "source": ("gone", [0, 0], "9")}])
    files = spark.createDataFrame([("a", 0, 0, "changed"), ("b", 2, 3, "2"), ("b", 0, 0, "whole")], "path string, first int, last int, hash string")
    assert {r.id: r.is_stale for r in integrity.staleness(n, files).collect()} == {"a": True, "b": False, "c": False}
    hit = integrity.changed(n, files)
    assert {r.id: r.current_hash for r in hit.collect()} == {"a": "changed", "d": ""}
    spread = integrity.propagate_stale(graph.edges_of(n), hit, 1)
    assert {r.id: r.reason for r in spread.collect()} == {"a": "source_changed", "d": "source_changed", "b": "dependency_changed:a"}


def test_suggestions(spark, nodes_of):
    n = nodes_of([{"id": "lone", "summary": ""}, {"id": "api_x", "type": ""}, {"id": "p", "edges": [("q", "calls")]}, {"id": "q"}, {"id": "s", "source": ("f", [0, 0], "1"), "edges": [("p", "calls")]}])
    emb = spark.createDataFrame([("p", [0.0], "m", "active"), ("q", [0.01], "m", "active"), ("lone", [9.0], "m", "active")], "node_id string, embedding array<float>, model string, status string")
    vec = emb.select(F.col("node_id").alias("query_id"), "embedding")
    files = spark.createDataFrame([("f", "2")], "path string, hash string")
    found = integrity.suggestions(n, files, emb, vec, "m")
    page = integrity.ranked(found)
    rows = [(r.severity, r.type, tuple(r.node_ids)) for r in page.collect()]
    assert rows[0] == ("error", "stale", ("s",)) and rows[1] == ("warning", "duplicate", ("p", "q"))
    assert sorted(t for _, t, _ in rows) == ["disconnected", "disconnected", "duplicate", "missing_summary", "orphan", "orphan", "stale", "untyped"]
    assert [r.suggestion_id for r in integrity.ranked(found, 2, 3).collect()] == [r.suggestion_id for r in page.collect()][2:5]
    assert integrity.ranked(found, 100).count() == 0
    fix = {r.type: r.fix for r in page.collect()}
    assert fix["untyped"].args["suggested_type"] == "api" and fix["stale"].auto


def test_doctors(spark, nodes_of):
    spaces = spark.createDataFrame([("default", "default"), ("x", "y")], "name string, folder string")
    bridges = spark.createDataFrame([("default", "nowhere", ["calls"])], "source string, target string, allowed_relations array<string>")
    got = {(r.subject, r.issue) for r in integrity.namespace_doctor(nodes_of([{"id": "a", "namespace": "z"}]), spaces, bridges).collect()}
    assert got == {("z", "no_manifest"), ("y", "name_mismatch"), ("nowhere", "unknown_bridge_endpoint")}
    columns = "project_id string, path string, exists boolean, is_directory boolean, metadata string, meta_project_id string, meta_warren_id string, vault_id string, model string, schema_current boolean"
    projects = spark.createDataFrame([("p", "p", True, True, "m", "p", "c", "v", "m1", True), ("q", "/q", True, True, "m", "x", "d", "v", "m2", False), ("r", "r", False, False, None, None, None, None, None, True), ("s", "s", True, False, None, None, None, None, None, True)], columns)
    got = {(r.subject, r.code) for r in integrity.catalog_doctor("c", projects, bridges).collect()}
    assert got == {("q", "absolute_project_path"), ("q", "project_id_mismatch"), ("q", "warren_id_mismatch"), ("q", "duplicate_vault_id"), ("q", "schema_stale"), ("q", "model_skew"), ("r", "project_missing"), ("s", "project_not_directory"),
                   ("default", "bridge_source_missing"), ("nowhere", "bridge_target_missing")}
    mounts = spark.createDataFrame([("c", "p", "here", True, True, False), ("c", "q", "v", True, False, False), ("d", "q", "v", True, False, True)], "catalog string, project_id string, vault_id string, active boolean, editable boolean, materialized boolean")
    places = spark.createDataFrame([("here", "/there")], "vault_id string, path string")
    got = {(r.subject, r.code) for r in integrity.workspace_doctor("here", mounts, spark.createDataFrame([("d", False)], "catalog string, reachable boolean"), places, "/here").collect()}
    assert got == {("p", "self_identity"), ("p", "self_alias_mount"), ("p", "self_alias_editable"), ("v", "vault_id_collision_workspace"), ("d", "warren_unreachable"), ("here", "local_route_mismatch")}
    vaults = spark.createDataFrame([("v", "", None)], "vault_id string, path string, config_vault_id string")
    cross = spark.createDataFrame([("a", "b", "v", "w")], "source string, target string, source_vault_id string, target_vault_id string")
    assert {r.problem for r in integrity.bridge_health(cross, vaults).collect()} == {"unreachable"}


def test_classifier(spark, nodes_of):
    n = nodes_of([{"id": i} for i in ("old", "new/child", "mid", "low")])
    hits = spark.createDataFrame([
        ("new", "new/child", 0.99), ("new", "old", 0.85), ("same", "same", 1.0), ("same", "mid", 0.66), ("dup", "old", 0.96), ("none", "ghost", 0.99), ("weak", "low", 0.62),
    ], "query_id string, node_id string, score double")
    asked = spark.createDataFrame([(q,) for q in ("new", "same", "dup", "none", "weak", "unseen")], "query_id string")
    got = {r.query_id: (r.action, r.target) for r in classify.by_threshold(hits, n, asked).collect()}
    assert got == {"new": ("update", "old"), "same": ("supersede", "mid"), "dup": ("noop", "old"), "none": ("add", None), "weak": ("add", None), "unseen": ("add", None)}
    emb = spark.createDataFrame([("old", [0.0, 0.0], "m", "active")], "node_id string, embedding array<float>, model string, status string")
    new = spark.createDataFrame([("n1", [0.0, 0.1]), ("n2", None)], "query_id string, embedding array<float>")
    said = classify.classify(new, n, emb, "m", judge=lambda q: {"action": "update", "target": "old", "confidence": 0.7})
    assert {r.query_id: (r.action, r.target) for r in said.collect()} == {"n1": ("update", "old"), "n2": ("add", None)}
    broken = classify.classify(new, n, emb, "m", judge=lambda q: 1 / 0)
    assert {r.query_id: (r.action, r.score) for r in broken.collect()}["n1"] == ("add", 0.1)
    assert {r.query_id: r.action for r in classify.classify(new, n, emb, "m").collect()} == {"n1": "update", "n2": "add"}


def test_contribution(spark, nodes_of):
    source = nodes_of([{"id": "same"}, {"id": "edited", "summary": "new"}, {"id": "fresh"}, {"id": "better"}])
    target = nodes_of([{"id": "same"}, {"id": "edited", "summary": "old", "valid_from": "T0"}, {"id": "worse"}])
    said = spark.createDataFrame([("better", "supersede", "worse")], "query_id string, action string, target string")
    plan = classify.contribution(source, target, said)
    assert {r.id: r.action for r in plan.collect()} == {"same": "noop", "edited": "update", "fresh": "add", "better": "supersede"}
    out = {r.id: r for r in classify.apply_contribution(source, target, plan, "T1").collect()}
    assert out["edited"].valid_from == "T0" and out["edited"].summary == "new" and out["fresh"].valid_from == "T1"
    assert (out["worse"].status, out["worse"].superseded_by) == ("superseded", "better") and len(out) == 5
    counts = classify.action_counts(plan).first()
    assert (counts.added, counts.updated, counts.superseded, counts.noop, counts.total) == (1, 1, 1, 1, 4)


def test_curation(spark, nodes_of):
    n = nodes_of([{"id": "a", "edges": [("b", "calls")], "tags": ["t"]}, {"id": "b", "edges": [("a", "calls"), ("c", "reads")], "tags": ["u", "t"]}, {"id": "c", "edges": [("b", "calls"), ("a", "calls")]}, *({"id": f"x{i}"} for i in range(9))])
    get = lambda df, i: df.where(F.col("id") == i).first()
    merged = mutations.merge(n, "a", "b", "now")
    assert [tuple(e) for e in get(merged, "a").edges] == [("b", "calls"), ("c", "reads")] and get(merged, "a").tags == ["t", "u"]
    assert [tuple(e) for e in get(merged, "c").edges] == [("a", "calls")] and get(merged, "b").superseded_by == "a"
    assert get(mutations.unlink(n, "b", "a"), "b").edges[0].target == "c"
    with pytest.raises(ValueError):
        mutations.link(mutations.link(n, "a", "c", "contains"), "c", "a", "contains")
    assert mutations.tokenize('/tag "two words" x') == ["/tag", "two words", "x"]
    c = mutations.Curator(n, "now")
    c.run('/tag "big one"', ("a",))
    c.run("/untag t", ("a",))
    assert get(c.nodes, "a").tags == ["big one"]
    c.run("/type class", ("a",))
    c.run("/delete x1")
    assert get(c.nodes, "x1").status == "superseded" and get(c.undo(), "x1").status == "active"
    c.run("/link a x2 references")
    assert c.run("/verify").count() >= 0
    with pytest.raises(RuntimeError):
        c.run("/tag q", tuple(f"x{i}" for i in range(9)))
    with pytest.raises(ValueError):
        c.run("/nothing")


def test_writes(spark, nodes_of):
    n = nodes_of([{"id": "ns/a", "tags": ["keep"], "valid_from": "T0", "status": "superseded"}])
    new = nodes_of([{"id": "a", "edges": [("b", "calls"), ("@v/x", "calls")], "tags": []}, {"id": "ns/c"}])
    out, report = mutations.write(n, new, "T1", "ns")
    rows = {r.id: r for r in out.collect()}
    assert rows["ns/a"].tags == ["keep"] and rows["ns/a"].valid_from is None and rows["ns/a"].status == "active"
    assert [e.target for e in rows["ns/a"].edges] == ["ns/b", "@v/x"] and rows["ns/c"].valid_from == "T1"
    assert {r.id: r.result for r in report.collect()} == {"ns/a": "updated", "ns/c": "created"}
    emb = "node_id string, embedding array<float>, summary_hash string, model string, updated_at timestamp, status string"
    s = spark.createDataFrame([("a", [0.0], "h", "m", None, "superseded")], emb)
    fresh = spark.createDataFrame([("a", [1.0], "h2", "m", None, None)], emb)
    assert mutations.upsert_embeddings(s, fresh).first().status == "active"
    assert mutations.upsert_embeddings(s, fresh, keep_status=True).first().status == "superseded"
    with pytest.raises(ValueError):
        mutations.upsert_embeddings(s, fresh.withColumn("model", F.lit("z")), checked=True)
    with pytest.raises(ValueError):
        mutations.upsert_embeddings(s, fresh, dimension=3)
    stale = mutations.stale_embeddings(s, spark.createDataFrame([("a", "h2"), ("z", "h")], "node_id string, hash string"))
    assert {r.node_id for r in stale.collect()} == {"a", "z"}
    gone = mutations.retire_embeddings(fresh.withColumn("status", F.lit("active")), spark.createDataFrame([("a",)], "id string"))
    assert gone.first().status == "superseded"
    text, embed = mutations.patch(n, "ns/a", tags=["z"])
    assert not embed and text.first().tags == ["z"] and mutations.patch(n, "ns/a", summary="s")[1]
    log = mutations.snapshots(n, spark.createDataFrame([("ns/a",), ("later",)], "id string"), "s", 1)
    assert {r.id: r.existed for r in log.collect()} == {"ns/a": True, "later": False}
    changed, _ = mutations.patch(n, "ns/a", summary="changed")
    assert mutations.restore(changed, log).first().summary == "about ns/a"


def test_embed_texts_cut_long_texts_at_whole_characters(spark, tmp_path):
    texts = ["short", "x" * 6000, "x" * 6001, "x" * 5999 + "é tail", "x" * 5998 + "é tail", "x" * 5998 + "😀" * 9, "é" * 4000, "x" * 5997 + "\ufffd and more", "", None]
    rows = [(i, t, "en", "web") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.cut, r.digest) for r in entry.queries()["embed_texts"](spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        body = (t or "").encode()[:6000].decode(errors="ignore")
        text = "en en web" + ("\n\n" + body if t else "")
        assert got[i] == (None if t is None else len(t.encode()) > 6000, hashlib.sha256(text.encode()).hexdigest()), i


def test_suggestions_have_all_kinds(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    for t in "region nation customer supplier part orders lineitem benchmark".split():
        (tmp_path / f"{t}.parquet").symlink_to(f"{sf}/{t}.parquet")
    docs = [(i, f"text {i}", "" if i == 6 else "en", "web") for i in range(1, 9)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    vecs = [(i, 0, [float(i // 2), 0.0]) for i in range(2, 9)]  # 2 and 3, 4 and 5, 6 and 7 are alike
    spark.createDataFrame(vecs, "vec_id bigint, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    out = entry.queries()["suggestions_ranked"](spark, str(tmp_path)).collect()
    by = {}
    for r in out:
        if r.node_ids.startswith("doc/"):
            by.setdefault(r.type, set()).add(r.node_ids)
    live = {1, 2, 3, 4, 6, 7, 8}  # each fifth is superseded
    assert by["disconnected"] == {"doc/1,doc/2", "doc/7,doc/8", "doc/3", "doc/4", "doc/6"}
    assert by["stale"] == {f"doc/{i}" for i in live if i % 2}
    assert by["duplicate"] >= {"doc/2,doc/3", "doc/6,doc/7"}
    assert by["untyped"] == {"doc/6"} and by["missing_summary"] == {"doc/4", "doc/6", "doc/8"}
    assert "orphan" not in by
    assert {"disconnected", "missing_summary"} <= {r.type for r in out} and len(out) == len({r.suggestion_id for r in out})


def test_small_components_by_brute_force(spark, nodes_of):
    import random

    rng = random.Random(6)
    some = [f"n{i:02d}" for i in range(40)]
    edges = [(rng.choice(some), rng.choice([*some, "gone"]), "reads", "behavioral", i) for i in range(24)] + [("n01", "n01", "reads", "behavioral", 0)] * 2
    edges += [("p1", "p2", "reads", "behavioral", 0), ("p2", "p1", "calls", "behavioral", 0), ("q2", "q1", "calls", "behavioral", 0), ("q2", "gone", "calls", "behavioral", 1)]
    names = [*some, "p1", "p2", "q1", "q2"]
    live = nodes_of([{"id": n} for n in names])
    got = {tuple(r.node_ids) for r in integrity.small_components(live, spark.createDataFrame(edges, "src string, dst string, relation string, class string, ord int")).collect()}
    group = {n: {n} for n in names}
    for a, b, *_ in edges:
        if b in group:
            whole = group[a] | group[b]
            for n in whole:
                group[n] = whole
    assert got == {tuple(sorted(g)) for g in group.values() if len(g) < 3} and any(len(g) == 2 for g in got)


def test_doctors_and_model_replies():
    from graphloom.operators import classify

    add = {"action": "add", "target": None, "confidence": 0.1}
    for text in ("", "no", "{", "[1]", '{"action": 5}', '{"action": "merge"}', '{"action": "add", "confidence": "x"}', "null"):
        got = classify.parse_reply(text)
        assert {k: got[k] for k in add} == add, text
    assert classify.parse_reply('x {"action": "SUPERSEDE", "target_node_id": "a", "confidence": 0.7} y')["target"] == "a"
    assert "No similar existing nodes found." in classify.prompt({"id": "a"}, [])
    asked = classify.prompt({"id": "a"}, [{"node_id": f"c{i}", "score": 0.5} for i in range(9)])
    assert "[3] ID: c2" in asked and "c3" not in asked


def test_classify_with_a_model(spark, nodes_of):
    from graphloom.operators import classify

    nodes = nodes_of([{"id": "old", "summary": "old one"}])
    emb = spark.createDataFrame([("old", [1.0, 0.0], "h", "m", "active")], "node_id string, embedding array<float>, summary_hash string, model string, status string")
    new = spark.createDataFrame([("x", [1.0, 0.0], "class", "new one"), ("y", [0.0, -9.0], "class", "far")], "query_id string, embedding array<float>, type string, summary string")

    def ask(text):
        assert "Summary: new one" in text and "ID: old" in text
        return '```{"action": "UPDATE", "target_node_id": "old", "confidence": 0.8}```'

    out = {r.query_id: (r.action, r.target, r.score) for r in classify.classify(new, nodes, emb, judge=classify.model_judge(ask)).collect()}
    assert out == {"x": ("update", "old", 0.8), "y": ("add", None, 1.0)}


@pytest.mark.parametrize("chunk", [1, 7, 10**6])
def test_edges_are_reduced_to_nodes_where_they_lie(spark, nodes_of, monkeypatch, chunk):
    """Of many edges between few nodes a row for each node and chunk is written; a node's second neighbour may lie in another chunk."""
    made, whole = {}, integrity.materialize
    monkeypatch.setattr(integrity, "materialize", lambda df, label, *rest: made.setdefault(label, whole(df, label, *rest)))
    names = [f"n{i}" for i in range(12)] + ["a", "b", "c", "d", "e", "f"]
    edges = [(f"n{i % 12}", f"n{(i * 5 + 1) % 12}") for i in range(300)] + [("a", "b"), ("b", "a"), ("c", "d"), ("d", "e"), ("f", "f"), ("f", "gone"), ("gone", "a")] * 3
    df = spark.createDataFrame(edges, "src string, dst string").coalesce(1)
    got = sorted(r.node_ids for r in integrity.small_components(nodes_of([{"id": n} for n in names]), df, chunk).collect())
    assert got == [["a", "b"], ["f"]]
    if chunk == 10**6:
        assert made["neighbours"].count() <= 4 * 17
