"""Registered queries over changes: upserts, curation commands, undo, upkeep, catalogs and their checks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from graphloom.client import Client
from graphloom.operators import catalogs, classify, federation, graph, heat, integrity, mutations, retrieval, upkeep
from graphloom.plans.catalog import _HEAT as HEAT
from graphloom.plans.catalog import _TOP, _VEC, _doc_nodes, _heat, _scored, query, search_query
from graphloom.plans.catalog import _doc_files as doc_files
from graphloom.plans.views import GRAPH
from graphloom.plans.views import text_of as s
from graphloom.schema import blank
from graphloom.storage import materialize, scratch_path
from graphloom.streaming import watch

NOW = "2024-06-01T00:00:00Z"


# Graph changes


@query(GRAPH + " SELECT id, status FROM g_nodes")
def all_nodes(v):
    return v.nodes.select("id", "status")


@query(GRAPH + """ SELECT id, type, namespace FROM g_nodes WHERE id NOT LIKE 'part/%' UNION ALL SELECT 'part/' || (p_partkey + 3), 'type', 'new' FROM part UNION ALL SELECT 'part/' || p_partkey, 'concept', 'supply' FROM part WHERE p_partkey < 3""")
def upsert_nodes(v):
    """Most parts are replaced, three are new, three stay."""
    new = v.table("part").select(F.concat(F.lit("part/"), F.col("p_partkey") + 3).alias("id"), F.lit("type").alias("type"), F.lit("new").alias("namespace"))
    nodes = v.nodes.select("id", "type", "namespace")
    return graph.upsert(nodes, new).select("id", "type", "namespace")


@query(GRAPH + """ SELECT src, dst, relation, ord::BIGINT AS ord FROM g_edges WHERE NOT (src = 'nation/3' AND ord = (SELECT min(ord) FROM g_edges WHERE src = 'nation/3' AND dst = (SELECT min(dst) FROM g_edges WHERE src = 'nation/3')))
    UNION ALL SELECT 'region/0', 'part/5', 'contains', (SELECT max(ord) + 1 FROM g_edges WHERE src = 'region/0')""")
def edge_changes(v):
    """A structural edge is added after the check for cycles, and the first edge between two nodes removed."""
    first = v.pairs.where("src = 'nation/3'").agg(F.min("dst")).first()[0]
    out = graph.add_edge(v.edges.select("src", "dst", "relation", "class", "ord"), "region/0", "part/5", "contains")
    return graph.remove_edge(out, "nation/3", first).select("src", "dst", "relation", F.col("ord").cast("bigint").alias("ord"))


@query("SELECT 'customer/' || c_custkey || ' -contains-> region/' || n_regionkey || ' closes a structural cycle' AS problem FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey = 3")
def edge_refused(v):
    """An edge that would close a structural cycle is refused."""
    row = v.table("customer").where("c_custkey = 3").join(v.table("nation"), F.col("c_nationkey") == F.col("n_nationkey")).first()
    try:
        graph.add_edge(v.edges, "customer/3", f"region/{row['n_regionkey']}", "contains")
    except ValueError as e:
        return v.spark.createDataFrame([(str(e),)], "problem string")
    return v.spark.createDataFrame([], "problem string")


@query(GRAPH + """ SELECT id, CASE WHEN id = 'part/3' THEN 'superseded' ELSE status END AS status, CASE WHEN id = 'part/3' THEN 'part/next' ELSE superseded_by END AS superseded_by, summary FROM g_nodes UNION ALL SELECT 'part/next', 'active', '', 'next'""")
def supersede_node(v):
    nodes = v.nodes.select("id", "status", "superseded_by", "summary")
    new = v.spark.createDataFrame([("part/next", "active", "", "next")], nodes.schema)
    return graph.supersede(nodes, "part/3", new)


@query(GRAPH + """, q AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'nation/' || (doc_id % 25) WHEN 1 THEN doc_id::VARCHAR ELSE 'none/' || doc_id END AS asked FROM documents)
    SELECT DISTINCT asked, coalesce((SELECT min(id) FROM g_nodes n WHERE n.id = asked), (SELECT min(id) FROM g_nodes n WHERE n.id IN ('customer/' || asked, 'part/' || asked))) AS id FROM q""")
def resolve_ids(v):
    """An id itself, else the one below the first namespace that has it."""
    d = F.col("doc_id")
    asked = v.table("documents").select(F.when(d % 3 == 0, F.concat(F.lit("nation/"), d % 25)).when(d % 3 == 1, d.cast("string")).otherwise(F.concat(F.lit("none/"), d)).alias("id"))
    return graph.resolve_ids(v.nodes, asked, v.spark.createDataFrame([("part",), ("customer",)], "name string"))


@query(GRAPH + """, l AS (SELECT 'tag' AS list, id FROM g_nodes WHERE status IN ('', 'active') AND list_contains(tags, 'BUILDING') UNION ALL SELECT 'type', id FROM g_nodes WHERE status IN ('', 'active') AND type = 'class'
        UNION ALL SELECT 'namespace', id FROM g_nodes WHERE status IN ('', 'active') AND namespace = 'geo')
    SELECT list, id FROM l QUALIFY row_number() OVER (PARTITION BY list ORDER BY id) <= 500 UNION ALL SELECT list, '... truncated at 500' FROM l GROUP BY 1 HAVING count(*) > 500""")
def capped_lists(v):
    """Nodes by tag, type and namespace, 500 at most and a row that says so."""
    c = Client(v.nodes, v.embeddings)
    parts = [df.select(F.lit(name).alias("list"), "id") for name, df in (("tag", c.by_tag("BUILDING")), ("type", c.by_type("class")), ("namespace", c.by_namespace("geo")))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(GRAPH + """ SELECT n.id, n.type, (SELECT count(*) FROM g_edges WHERE src = n.id) AS out_degree, (SELECT count(*) FROM g_edges WHERE dst = n.id) AS in_degree, false AS is_stale FROM g_nodes n WHERE n.id = 'nation/7'""")
def node_detail(v):
    """A node by its name below the namespace, with degrees and staleness."""
    c = Client(v.full_nodes, v.embeddings, namespace="nation")
    files = v.spark.createDataFrame([], "path string, hash string")
    return c.detail("7", files).select("id", "type", "out_degree", "in_degree", "is_stale")


@query(GRAPH + """ SELECT 'nation/7' AS id, (SELECT count(*) FROM g_edges WHERE src = 'nation/7') AS edges, 'part/5' AS neighbor, (SELECT count(DISTINCT CASE WHEN src = 'part/5' THEN dst ELSE src END) FROM g_edges WHERE src = 'part/5' OR dst = 'part/5') AS around,
    (SELECT count(*) FROM g_nodes WHERE status IN ('', 'active')) AS live""")
def client_verbs(v):
    """The facade: a node with its edges, neighbours, and counts."""
    c = Client(materialize(v.full_nodes, "client"), v.embeddings)  # every verb reads it
    one = c.get("nation/7").select("id", F.size("edges").cast("bigint").alias("edges"))
    near = c.neighbors("part/5", 1).where("id NOT LIKE '...%'").agg(F.count("*").alias("around"))
    return one.join(near.select(F.lit("nation/7").alias("id"), F.lit("part/5").alias("neighbor"), "around"), "id").join(c.stats().select(F.lit("nation/7").alias("id"), F.col("nodes").alias("live")), "id")


# Writes


@query("""SELECT 'src/doc/' || doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'updated' ELSE 'created' END AS result, CASE WHEN doc_id % 2 = 0 THEN 'fresh' WHEN doc_id % 3 = 0 THEN lang END AS tags, 'src/' || source AS target,
    CASE WHEN doc_id % 3 = 0 THEN NULL ELSE '2024-06-01T00:00:00Z' END AS valid_from, 'active' AS status FROM documents""")
def context_write(v):
    """Nodes written below a namespace: some update, tags stay where none are given."""
    n = F.substring("id", 5, 20).cast("long")
    base = _doc_nodes(v).withColumn("source", F.col("source"))
    new = base.withColumn("tags", F.when(n % 2 == 0, F.array(F.lit("fresh"))).otherwise(F.array().cast("array<string>")))
    old = base.where(n % 3 == 0).withColumn("id", F.concat(F.lit("src/"), "id"))
    nodes, report = mutations.write(old, new, NOW, "src")
    out = nodes.join(report, "id")
    return out.select("id", "result", F.when(F.size(F.coalesce("tags", F.array().cast("array<string>"))) > 0, F.array_join("tags", ",")).alias("tags"), F.col("edges")[0]["target"].alias("target"), "valid_from", "status")


@query("SELECT 'doc/' || doc_id AS id, CASE WHEN doc_id = 7 THEN 'patched' WHEN doc_id % 4 = 0 THEN '' ELSE lang END AS summary, CASE WHEN doc_id = 7 THEN 'a,b' ELSE lang END AS tags, true AS embed, false AS embed_tags FROM documents")
def patch_node(v):
    """Partial updates; only texts ask for a new vector."""
    out, embed = mutations.patch(_doc_nodes(v), "doc/7", summary="patched")
    out, again = mutations.patch(out, "doc/7", tags=["a", "b"])
    return out.select("id", "summary", F.array_join("tags", ",").alias("tags"), F.lit(embed).alias("embed"), F.lit(again).alias("embed_tags"))


@query("""SELECT 'doc/' || doc_id AS id, CASE WHEN doc_id = 3 THEN source || '>reads,doc/9>calls' WHEN doc_id = 6 THEN 'doc/7>extends' ELSE source || CASE WHEN doc_id % 2 = 0 THEN '>references' ELSE '>reads' END END AS edges FROM documents""")
def link_unlink(v):
    nodes = mutations.link(_doc_nodes(v), "doc/3", "doc/9", "calls")
    nodes = mutations.link(mutations.link(nodes, "doc/3", "doc/9", "calls"), "doc/6", "doc/7", "extends")
    first = v.table("documents").where("doc_id = 6").first()["source"]
    nodes = mutations.unlink(nodes, "doc/6", first)
    return nodes.select("id", F.array_join(F.transform("edges", lambda e: F.concat(e["target"], F.lit(">"), e["relation"])), ",").alias("edges"))


@query(GRAPH + " SELECT id, array_to_string(list_filter(tags, lambda t: t <> 'place' AND t <> 'bench'), ',') AS tags FROM g_nodes")
def untag_nodes(v):
    return mutations.untag(v.nodes, F.lit(True), "place", "bench").select("id", F.array_join("tags", ",").alias("tags"))


@search_query(_VEC + """, g AS (SELECT DISTINCT node_id FROM d WHERE label <> 9 AND vault = 'v1' QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, node_id) <= 5)
    SELECT e.node_id AS id, CASE WHEN e.node_id IN (SELECT node_id FROM g) THEN 'old,found' ELSE 'old' END AS tags FROM e""")
def tag_by_query(v, q):
    """What the searches find in a namespace is tagged."""
    hits = retrieval.search(v.embeddings.where("vault_id = 'v1'"), q, 5, only_active=True)
    nodes = v.embeddings.select(F.col("node_id").alias("id"), F.col("vault_id").alias("namespace"), F.array(F.lit("old")).alias("tags"))
    return mutations.tag_hits(nodes, hits, "found", namespace="v1")[0].select("id", F.array_join("tags", ",").alias("tags"))


@query("""SELECT 'doc/' || doc_id AS id, CASE WHEN doc_id IN (4, 8) THEN 'superseded' WHEN doc_id % 5 = 0 THEN 'superseded' ELSE 'active' END AS status, CASE WHEN doc_id IN (1, 2) THEN 'class' ELSE lang END AS type,
    lang || CASE WHEN doc_id IN (1, 2) THEN ',seen' ELSE '' END AS tags FROM documents""")
def command_dispatch(v):
    """Slash commands on a selection; the last one is undone."""
    c = mutations.Curator(_doc_nodes(v), NOW, allow_bulk=True)
    c.run('/tag seen', ("doc/1", "doc/2"))
    c.run("/type class", ("doc/1", "doc/2"))
    c.run("/delete doc/4 doc/8")
    c.run("/untag seen", ("doc/1",))
    return c.undo().select("id", "status", "type", F.array_join("tags", ",").alias("tags"))


@query("""SELECT n AS changed, greatest(5, (SELECT count(*) FROM documents WHERE doc_id % 5 <> 0) // 2) AS allowed, n > greatest(5, (SELECT count(*) FROM documents WHERE doc_id % 5 <> 0) // 2) AS refused
    FROM (SELECT 3 AS n UNION ALL SELECT (SELECT count(*) FROM documents) - 1)""")
def bulk_guard(v):
    """Runs that change more than half of the active nodes are refused."""
    nodes = materialize(_doc_nodes(v), "bulk")
    total = nodes.count()
    allowed = mutations.bulk_limit(nodes.where("status = 'active'").count())
    rows = []
    for n in (3, total - 1):
        try:
            mutations.Curator(nodes, NOW).run("/tag x", tuple(f"doc/{i}" for i in range(n)))
            rows.append((n, allowed, False))
        except RuntimeError:
            rows.append((n, allowed, True))
    return v.spark.createDataFrame(rows, "changed bigint, allowed bigint, refused boolean")


@query("""SELECT 'doc/' || doc_id AS id, lang AS type, sha256(text) AS digest, 's' AS session FROM documents""")
def undo_restore(v):
    """Pre-images of a third of the nodes and of one that was not there; after a change they are put back."""
    nodes = _doc_nodes(v)
    third = F.substring("id", 5, 20).cast("long") % 3 == 0
    ids = nodes.where(third).select("id").unionByName(v.spark.createDataFrame([("doc/new",)], "id string"))
    entry = materialize(mutations.snapshots(nodes, ids, "s", 1), "undo")
    changed = nodes.withColumns({"type": F.when(third, "changed").otherwise(F.col("type")), "context": F.when(third, "").otherwise(F.col("context"))})
    made = changed.unionByName(changed.where("id = 'doc/1'").withColumn("id", F.lit("doc/new")))
    return mutations.restore(made, entry).select("id", "type", F.sha2("context", 256).alias("digest"), F.lit("s").alias("session"))


@query("""SELECT 'doc/' || doc_id AS id, doc_id >= 0 AS existed FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT 'doc/new', false""")
def undo_images(v):
    nodes = _doc_nodes(v)
    ids = nodes.where(F.substring("id", 5, 20).cast("long") % 3 == 0).select("id").unionByName(v.spark.createDataFrame([("doc/new",)], "id string"))
    return mutations.snapshots(nodes, ids, "s", 1).select("id", "existed")


@query(GRAPH + " SELECT id FROM (SELECT 'part/5' AS id UNION SELECT src FROM g_edges WHERE dst = 'part/5' UNION SELECT 'nation/1')")
def affected_ids(v):
    one = lambda i: v.spark.createDataFrame([(i,)], "id string")
    return mutations.affected(v.pairs, one("part/5"), one("nation/1"))


# Verification and staleness


@query("""SELECT 'doc/' || doc_id AS node_id, 'dangling_edge' AS issue_type, CASE WHEN doc_id % 2 = 0 THEN 'info' ELSE 'error' END AS severity FROM documents
    UNION ALL SELECT 'doc/' || doc_id, 'missing_source', 'warning' FROM documents WHERE doc_id % 10 = 0
    UNION ALL SELECT 'doc/' || doc_id, 'hash_mismatch', 'warning' FROM documents WHERE doc_id % 2 <> 0
    UNION ALL SELECT 'doc/' || doc_id, 'hash_mismatch', 'warning' FROM documents WHERE doc_id % 25 = 0
    UNION ALL SELECT 'doc/' || doc_id, 'hash_mismatch', 'warning' FROM documents WHERE doc_id % 5 = 0 AND doc_id % 25 <> 0
    UNION ALL SELECT 'doc/' || doc_id, 'stale', 'warning' FROM documents WHERE doc_id % 2 <> 0 AND doc_id % 10 <> 0""")
def verify_all(v):
    """Integrity and staleness together: a changed source is named by both."""
    return integrity.verify(_doc_nodes(v), doc_files(v)).select("node_id", "issue_type", "severity")


@query("""SELECT 'doc/' || doc_id AS node_id, 'dangling_edge' AS issue_type FROM documents WHERE doc_id % 3 = 0 AND doc_id % 7 <> 0 UNION ALL SELECT 'doc/' || doc_id, 'hash_mismatch' FROM documents WHERE doc_id % 3 = 0 AND doc_id % 25 = 0
    UNION ALL SELECT 'doc/' || doc_id, 'hash_mismatch' FROM documents WHERE doc_id % 3 = 0 AND doc_id % 5 = 0 AND doc_id % 25 <> 0""")
def scoped_integrity(v):
    """A subset of the nodes against the ids of all: what leads out of the subset is fine."""
    n = F.substring("id", 5, 20).cast("long")
    target = F.when(n % 7 == 0, F.concat(F.lit("doc/"), n)).otherwise("nowhere")
    nodes = _doc_nodes(v).withColumn("edges", F.array(F.struct(target.alias("target"), F.lit("reads").alias("relation"))))
    return integrity.integrity(nodes.where(n % 3 == 0), nodes).select("node_id", "issue_type")


@query("""SELECT 'doc/' || doc_id AS id, CASE WHEN doc_id % 5 <> 0 AND doc_id % 2 <> 0 THEN sha256(text) WHEN doc_id % 2 = 0 THEN sha256(text) ELSE '0' END AS hash,
    CASE WHEN doc_id % 5 <> 0 AND doc_id % 2 <> 0 THEN 'new' ELSE 'old' END AS model FROM documents""")
def reindex_changed(v):
    """Changed sources: their hashes are refreshed and their nodes embedded again."""
    nodes = _doc_nodes(v)
    hit = materialize(integrity.changed(nodes, doc_files(v)), "hit")
    row = lambda df, model: df.select(F.col("id").alias("node_id"), F.array(F.lit(1.0).cast("float")).alias("embedding"), s("").alias("summary_hash"), F.lit(model).alias("model"),
                                      F.lit("2024-01-01").cast("timestamp").alias("updated_at"), F.lit("active").alias("status"))
    out, store = watch.reindex(nodes, row(nodes, "old"), hit, lambda n: row(n, "new"))
    return out.join(store.select(F.col("node_id").alias("id"), "model"), "id").select("id", F.col("source.hash").alias("hash"), "model")


@query(GRAPH + " SELECT DISTINCT src AS id, 'dependency_changed:supplier/1' AS reason FROM g_edges WHERE dst = 'supplier/1'")
def after_write(v):
    """Neighbours to index again after a write."""
    return watch.after_write(v.pairs, v.spark.createDataFrame([("supplier/1",)], "id string")).select("id", "reason")


@query("""SELECT 'doc/' || doc_id AS id, 0 AS depth FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 2 <> 0 AND doc_id % 10 <> 0
    UNION ALL SELECT 'user/' || doc_id, 1 FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 2 <> 0 AND doc_id % 10 <> 0""")
def source_watch(v):
    """Changed files as a stream: the nodes on them and what depends on those."""
    path = scratch_path(v.spark, "watched")
    files = doc_files(v)
    files.write.parquet(path)
    edges = v.table("documents").select(F.concat(F.lit("user/"), "doc_id").alias("src"), F.concat(F.lit("doc/"), "doc_id").alias("dst"))
    out = watch.Table(v.spark, "id string, depth int")

    def act(hit, stale, number):
        out.write(out.read().unionByName(stale.select("id", "depth")).distinct(), number)

    stream = watch.read_stream(v.spark, path, files.schema, 1000)
    watch.source_changes(stream, lambda: _doc_nodes(v), lambda: edges, act, scratch_path(v.spark, "ckpt"), trigger=None).awaitTermination()
    return out.read()


@query("""SELECT 1 AS reloads, count(*) AS nodes FROM documents""")
def vault_reload(v):
    """Changes of node files make the vault be loaded again; other files do not. Subscribers hear of the version."""
    path, heard, loaded = scratch_path(v.spark, "vault-events"), [], []
    v.table("pages").select(F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("a/"), "page_id", F.lit(".md"))).when(F.col("page_id") % 3 == 1, "_heat/x.md").otherwise("a/b.txt").alias("path")).coalesce(1).write.parquet(path)
    feed = watch.Feed()
    feed.subscribe(lambda version, kind: heard.append(version))

    def publish(df, number):
        loaded.append(df.count())
        feed.publish("reload")

    watch.vault_reload(watch.read_stream(v.spark, path, "path string"), lambda: _doc_nodes(v), publish, scratch_path(v.spark, "ckpt"), trigger=None).awaitTermination()
    return v.spark.createDataFrame([(heard[-1] if heard else 0, loaded[-1] if loaded else 0)], "reloads int, nodes bigint")


@query("""WITH RECURSIVE e AS (SELECT user_id, epoch(ts) AS t0, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
    b AS (SELECT user_id, k, t0 AS first FROM e WHERE k = 1 UNION ALL SELECT e.user_id, e.k, CASE WHEN e.t0 <= b.first + 86400 THEN b.first ELSE e.t0 END FROM b JOIN e ON e.user_id = b.user_id AND e.k = b.k + 1)
    SELECT 'u' || user_id AS path, first, count(*)::INT AS events FROM b GROUP BY ALL""")
def debounced_events(v):
    """Bursts by a timer of a day that the first event of a user starts."""
    e = v.table("events").select(F.concat(F.lit("u"), "user_id").alias("path"), F.unix_micros(F.col("ts").cast("timestamp")).alias("m"))
    return watch.debounced(e.select("path", (F.col("m") / 1e6).alias("at")), 86400)


@query("SELECT count(*) AS n, 2 AS loads FROM documents")
def cached_graph(v):
    """A cached table is read again after its time, not before."""
    clock, loads = [0.0], []

    def load():
        loads.append(1)
        return v.table("documents").select("doc_id")

    snap = watch.Snapshot(load, 60.0, lambda: clock[0])
    snap.get()
    clock[0] = 59.0
    snap.get()
    clock[0] = 61.0
    out = snap.get().agg(F.count("*").alias("n")).select("n", F.lit(len(loads)).alias("loads"))
    out = materialize(out, "cached")
    snap.drop()
    return out


# Suggestions and reports


@query(GRAPH + """, e AS (SELECT count(*) AS edges FROM g_edges)
    SELECT count(*) AS nodes, max(e.edges) AS edges, (SELECT count(*) FROM embeddings) AS embeddings, (SELECT count(*) FROM region) AS heat_pairs, (SELECT count(*) FROM nation) AS stale, count(DISTINCT namespace) AS namespaces, count_if(status IN ('', 'active'))::BIGINT AS active
    FROM g_nodes, e""")
def status_report(v):
    return federation.status_report(v.nodes, v.pairs, v.embeddings, v.table("region"), v.table("nation"))


@query(HEAT + " SELECT coalesce((SELECT round(w, 6) FROM h WHERE a = 'click' AND b = 'view'), 0.0)::DOUBLE AS weight, 0.0::DOUBLE AS none, (SELECT count(*) FROM h) AS pairs")
def pair_weight(v):
    h = materialize(_heat(v), "heat")
    row = (round(heat.weight_of(h, "view", "click"), 6), float(heat.weight_of(h, "view", "nothing")), h.count())
    return v.spark.createDataFrame([row], "weight double, none double, pairs bigint")


@query("""WITH u AS (SELECT CASE WHEN source = 'src1' THEN 'default' ELSE source END AS name FROM documents GROUP BY 1)
    SELECT name AS subject, 'no_manifest' AS issue FROM u WHERE name <> 'default' AND name <> 'src2' UNION ALL SELECT 'folder', 'name_mismatch' UNION ALL SELECT 'n' || n_nationkey, 'unknown_bridge_endpoint' FROM nation""")
def namespace_doctor(v):
    nodes = v.table("documents").select(F.when(F.col("source") == "src1", "").otherwise(F.col("source")).alias("namespace"))
    names = v.spark.createDataFrame([("default", "default"), ("src2", "folder")], "name string, folder string")
    bridges = v.table("nation").select(F.concat(F.lit("n"), "n_nationkey").alias("source"), F.lit("default").alias("target"))
    return integrity.namespace_doctor(nodes, names, bridges)


def _projects(v):
    k = F.col("page_id")
    return v.table("pages").select(
        F.concat(F.lit("p"), k).alias("project_id"), F.when(k % 13 == 0, F.concat(F.lit("/abs/"), k)).otherwise(F.concat(F.lit("projects/"), k)).alias("path"), (k % 7 != 0).alias("exists"), (k % 11 != 0).alias("is_directory"),
        F.when(k % 5 == 0, s(None)).otherwise("read").alias("metadata"), F.when(k % 17 == 0, "other").otherwise(F.concat(F.lit("p"), k)).alias("meta_project_id"), F.when(k % 19 == 0, "other").otherwise("c").alias("meta_warren_id"),
        F.concat(F.lit("v"), F.expr("page_id div 2")).alias("vault_id"), F.when(k % 3 == 0, s(None)).otherwise(F.when(k % 23 == 0, "m1").otherwise("m0")).alias("model"), (k % 4 != 0).alias("schema_current"), k.alias("k"),
    )


@query("""WITH p AS (SELECT page_id AS k, 'p' || page_id AS id, page_id % 7 <> 0 AS ex, page_id % 11 <> 0 AS dir FROM pages), t AS (SELECT * FROM p WHERE ex AND dir), r AS (SELECT * FROM t WHERE k % 5 <> 0),
    f AS (SELECT CASE WHEN k % 23 = 0 THEN 'm1' ELSE 'm0' END AS m, id FROM t WHERE k % 3 <> 0)
    SELECT 'c' AS subject, 'lockfile_not_ignored' AS code, 'info' AS severity UNION ALL SELECT 'c', 'materialized_cache_in_warren', 'warning' UNION ALL SELECT id, 'absolute_project_path', 'warning' FROM p WHERE k % 13 = 0
    UNION ALL SELECT id, 'project_missing', 'error' FROM p WHERE NOT ex UNION ALL SELECT id, 'project_not_directory', 'error' FROM p WHERE ex AND NOT dir UNION ALL SELECT id, 'metadata_unreadable', 'warning' FROM t WHERE k % 5 = 0
    UNION ALL SELECT id, 'project_id_mismatch', 'error' FROM r WHERE k % 17 = 0 UNION ALL SELECT id, 'warren_id_mismatch', 'error' FROM r WHERE k % 19 = 0
    UNION ALL SELECT id, 'duplicate_vault_id', 'error' FROM (SELECT id, row_number() OVER (PARTITION BY k // 2 ORDER BY id) AS n FROM r) WHERE n > 1 UNION ALL SELECT id, 'embeddings_missing', 'warning' FROM t WHERE k % 3 = 0
    UNION ALL SELECT id, 'schema_stale', 'warning' FROM t WHERE k % 3 <> 0 AND k % 4 = 0 UNION ALL SELECT id, 'model_skew', 'warning' FROM f WHERE m <> (SELECT min_by(m, id) FROM f)
    UNION ALL SELECT 'x' || k, 'bridge_source_missing', 'error' FROM p WHERE k % 9 = 0 UNION ALL SELECT 'y' || k, 'bridge_target_missing', 'error' FROM p WHERE k % 8 = 0""")
def catalog_doctor(v):
    p = _projects(v)
    k = F.col("k")
    bridges = p.select(F.when(k % 9 == 0, F.concat(F.lit("x"), k)).otherwise(F.col("project_id")).alias("source"), F.when(k % 8 == 0, F.concat(F.lit("y"), k)).otherwise(F.col("project_id")).alias("target"))
    return integrity.catalog_doctor("c", p, bridges, ignored=False, cache_inside=True)


@query("""WITH m AS (SELECT page_id AS k, 'p' || page_id AS id, CASE WHEN page_id % 6 = 0 THEN 'here' ELSE 'v' || (page_id // 2) END AS vault, page_id % 4 <> 0 AS active FROM pages)
    SELECT id AS subject, 'self_identity' AS code, 'info' AS severity FROM m WHERE vault = 'here' UNION ALL SELECT id, 'self_alias_mount', 'warning' FROM m WHERE vault = 'here' AND active
    UNION ALL SELECT id, 'self_alias_editable', 'warning' FROM m WHERE vault = 'here' AND k % 5 = 0 UNION ALL SELECT id, 'self_alias_materialized', 'warning' FROM m WHERE vault = 'here' AND k % 7 = 0
    UNION ALL SELECT vault, 'vault_id_collision_workspace', 'error' FROM m WHERE active AND vault <> 'here' GROUP BY 1 HAVING count(*) > 1
    UNION ALL SELECT 'c1', 'warren_unreachable', 'warning' UNION ALL SELECT 'here', 'local_route_mismatch', 'warning'""")
def workspace_doctor(v):
    k = F.col("page_id")
    mounts = v.table("pages").select(F.lit("c").alias("catalog"), F.concat(F.lit("p"), k).alias("project_id"), F.when(k % 6 == 0, "here").otherwise(F.concat(F.lit("v"), F.expr("page_id div 2"))).alias("vault_id"), (k % 4 != 0).alias("active"),
                                     (k % 5 == 0).alias("editable"), (k % 7 == 0).alias("materialized"))
    catalogs_ = v.spark.createDataFrame([("c", True), ("c1", False)], "catalog string, reachable boolean")
    routes = v.spark.createDataFrame([("here", "/elsewhere"), ("v1", "/x")], "vault_id string, path string")
    return integrity.workspace_doctor("here", mounts, catalogs_, routes, "/here")


@query("""SELECT 'n' || s_nationkey AS source, 'r' || s_suppkey AS target, 'v' || s_suppkey AS vault_id, CASE s_suppkey % 4 WHEN 0 THEN 'unreachable' WHEN 1 THEN 'config_error' ELSE 'id_mismatch' END AS problem FROM supplier WHERE s_suppkey % 4 <> 3""")
def bridge_health(v):
    k = F.col("s_suppkey")
    sup = v.table("supplier").select(k.alias("k"), F.concat(F.lit("n"), "s_nationkey").alias("source"), F.concat(F.lit("r"), k).alias("target"), F.concat(F.lit("v"), k).alias("vault"))
    bridges = sup.select("source", "target", F.lit("home").alias("source_vault_id"), F.col("vault").alias("target_vault_id"))
    m = F.col("k") % 4
    vaults = sup.select(F.col("vault").alias("vault_id"), F.when(m == 0, "").otherwise("/p").alias("path"), F.when(m == 1, s(None)).when(m == 2, "other").otherwise(F.col("vault")).alias("config_vault_id"))
    home = v.spark.createDataFrame([("home", "/h", "home")], "vault_id string, path string, config_vault_id string")
    return integrity.bridge_health(bridges, vaults.unionByName(home))


@query("""SELECT n_nationkey, CASE n_nationkey % 6 WHEN 0 THEN 'missing' WHEN 1 THEN 'diverged' WHEN 2 THEN 'behind by ' || n_nationkey WHEN 3 THEN 'ahead by ' || n_nationkey WHEN 4 THEN n_nationkey || ' pending' ELSE 'fresh' END AS note FROM nation""")
def freshness_notes(v):
    k, m = F.col("n_nationkey"), F.col("n_nationkey") % 6
    n = lambda cond: F.when(cond, k).otherwise(0)
    state = F.when(m == 0, "missing").otherwise("ok")
    return v.table("nation").select("n_nationkey", integrity.freshness_note(state, n(m.isin(1, 3)), n(m.isin(1, 2)), n(m == 4)).alias("note"))


# Several graphs


@query("""SELECT 'x' || s_suppkey AS src, 'y' || s_suppkey AS dst, 'reads' AS relation, CASE WHEN s_nationkey % 3 = 0 THEN 'no_bridge' ELSE 'relation_not_allowed' END AS problem FROM supplier WHERE s_nationkey <> 0 AND s_nationkey % 3 <> 1""")
def vault_policy(v):
    """Edges between vaults without a bridge, or with a relation that the first bridge does not allow."""
    k = F.col("s_nationkey")
    edges = v.table("supplier").select(F.concat(F.lit("x"), "s_suppkey").alias("src"), F.concat(F.lit("y"), "s_suppkey").alias("dst"), F.lit("reads").alias("relation"), F.lit("v0").alias("src_vault"), F.concat(F.lit("v"), k).alias("dst_vault"))
    n = v.table("nation").select(F.col("n_nationkey").alias("k")).where("k % 3 <> 0")
    first = n.select(F.concat(F.lit("v"), "k").alias("source_vault_id"), F.lit("v0").alias("target_vault_id"), F.when(F.col("k") % 3 == 1, F.array(F.lit("reads"))).otherwise(F.array(F.lit("calls"))).alias("allowed_relations"), F.lit(0).alias("ord"))
    second = first.withColumns({"allowed_relations": F.array(F.lit("reads")), "ord": F.lit(1)})
    return federation.vault_violations(edges, first.unionByName(second)).select("src", "dst", "relation", "problem")


@query(GRAPH + """, g AS (SELECT id FROM g_nodes WHERE namespace = 'geo')
    SELECT '@far/' || g.id AS src, '@far/' || e.dst AS dst, e.relation FROM g_edges e JOIN g ON g.id = e.src UNION ALL SELECT e.src, e.dst, e.relation FROM g_edges e JOIN g ON g.id = e.src UNION ALL SELECT '@far/new', 'nation/1', 'reads'""")
def combined_vaults(v):
    """Two vaults as one graph: remote ids are qualified, and what points back is local."""
    geo = materialize(v.nodes.where("namespace = 'geo'"), "geo")
    nodes = materialize(v.full(geo, graph.near(v.pairs, materialize(geo.select("id"), "geo-ids"), "src")), "vault")
    new = nodes.limit(1).withColumns({"id": F.lit("new"), "edges": F.array(F.struct(F.lit("@home/nation/1").alias("target"), F.lit("reads").alias("relation")))})
    return federation.combined({"home": nodes, "far": nodes.unionByName(new)}, "home")[1].select("src", "dst", "relation")


_CROSS = "source string, target string, allowed_relations array<string>, source_vault_id string, target_vault_id string"


@query("""SELECT DISTINCT least(a, b) AS lo, greatest(a, b) AS hi, 'cross' AS kind FROM (SELECT 'v' || s_nationkey AS a, 'v' || (s_suppkey % 3) AS b FROM supplier) UNION ALL SELECT 'l' || s_suppkey, 'm', 'local' FROM supplier""")
def bridges_listed(v):
    """Bridges between vaults, which both list, once; those inside a vault each."""
    k = F.col("s_suppkey")
    sup = v.table("supplier").select(k.alias("k"), F.concat(F.lit("v"), "s_nationkey").alias("a"), F.concat(F.lit("v"), k % 3).alias("b"))
    cross = sup.select(F.col("a").alias("source"), F.col("b").alias("target"), F.array(F.lit("reads")).alias("allowed_relations"), F.col("a").alias("source_vault_id"), F.col("b").alias("target_vault_id"))
    back = cross.select(F.col("target").alias("source"), F.col("source").alias("target"), "allowed_relations", F.col("target_vault_id").alias("source_vault_id"), F.col("source_vault_id").alias("target_vault_id"))
    local = sup.select(F.concat(F.lit("l"), "k").alias("source"), F.lit("m").alias("target"), F.array(F.lit("reads")).alias("allowed_relations"), s("").alias("source_vault_id"), s("").alias("target_vault_id"))
    out = upkeep.bridge_list(cross.unionByName(back).unionByName(local))
    is_cross = F.col("source_vault_id") != ""
    return out.select(F.when(is_cross, F.least("source", "target")).otherwise(F.col("source")).alias("lo"), F.when(is_cross, F.greatest("source", "target")).otherwise(F.col("target")).alias("hi"), F.when(is_cross, "cross").otherwise("local").alias("kind"))


@query("""SELECT 'p' || n_nationkey AS project_id, n_nationkey % 2 = 0 AS active, n_nationkey % 4 = 0 AS editable, false AS materialized, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS nodes FROM nation""")
def project_listing(v):
    k = F.col("n_nationkey")
    projects = v.table("nation").select(F.concat(F.lit("p"), k).alias("project_id"), F.concat(F.lit("v"), k).alias("vault_id"), F.lit("/p").alias("path"))
    state = v.table("nation").where("n_nationkey % 2 = 0").select(F.concat(F.lit("p"), k).alias("project_id"), F.lit(True).alias("active"), (k % 4 == 0).alias("editable"), F.lit(None).cast("boolean").alias("materialized"))
    nodes = v.table("supplier").select(F.concat(F.lit("v"), "s_nationkey").alias("vault_id"))
    return upkeep.project_status(projects, state, nodes).select("project_id", "active", "editable", "materialized", "nodes")


@query("""SELECT string_agg(id, ',' ORDER BY id) AS ids, count(*)::INT AS reasons, min(reason) AS first FROM (SELECT 'p' || n_nationkey AS id, 'region ' || n_regionkey AS reason FROM nation)""")
def skipped_projects(v):
    skipped = v.table("nation").select(F.concat(F.lit("p"), "n_nationkey").alias("id"), F.concat(F.lit("region "), "n_regionkey").alias("reason"))
    out = federation.skip_reasons(skipped)
    return out.select(F.array_join("ids", ",").alias("ids"), F.size("reasons").alias("reasons"), F.array_min(F.map_values("reasons")).alias("first"))


def _links(v):
    k = F.col("n_nationkey")
    n = v.table("nation")
    links = n.select(F.concat(F.lit("t"), k).alias("target"), F.when(k % 3 == 0, "edit").when(k % 3 == 1, "live").otherwise("link").alias("mode"))
    at = lambda cond, a, b: n.where(cond).select(F.concat(F.lit("t"), k).alias(a), F.concat(F.lit("v"), k).alias("v"), F.concat(F.lit(b), k).alias("path"))
    mounts = at("n_nationkey % 4 = 0", "project_id", "/m/").select("project_id", F.col("v").alias("vault_id"), "path", F.lit(True).alias("active"), F.lit(True).alias("editable"))
    routes = at("n_nationkey % 2 = 0", "vault_id", "/r/").select("vault_id", "path")
    cached = at("n_nationkey % 5 = 0", "project_id", "/c/").select("project_id", F.col("v").alias("vault_id"), "path")
    return federation.resolve_links(links, mounts, routes, cached)


_LINKS = """WITH r AS (SELECT n_nationkey AS k, CASE WHEN k % 4 = 0 THEN '/m/' || k WHEN k % 3 = 1 AND k % 2 = 0 THEN '/r/' || k WHEN k % 3 = 2 AND k % 5 = 0 THEN '/c/' || k END AS path,
    CASE WHEN k % 4 = 0 THEN 'v' || k WHEN k % 3 = 1 THEN 't' || k WHEN k % 3 = 2 THEN CASE WHEN k % 5 = 0 THEN 'v' || k ELSE 't' || k END END AS vault_id FROM nation)"""


@query(_LINKS + " SELECT 't' || k AS target, vault_id, path, CASE WHEN path IS NULL THEN 'missing' ELSE 'ok' END AS state FROM r")
def resolve_links(v):
    return _links(v).select("target", "vault_id", "path", "state")


@query(_LINKS + " SELECT DISTINCT vault_id FROM r WHERE vault_id IS NOT NULL AND vault_id <> 'v4'")
def linked_vaults(v):
    return federation.linked_vaults(_links(v), "v4")


@query("""SELECT 's' || a AS source, 't' || a AS target, (a + 1000000 * k)::BIGINT AS ord FROM (SELECT n_nationkey AS a, 0 AS k FROM nation UNION ALL SELECT r_regionkey, 1 FROM region UNION ALL SELECT s_suppkey, 2 FROM supplier)""")
def composed_bridges(v):
    part = lambda t, c: v.table(t).select(F.concat(F.lit("s"), c).alias("source"), F.concat(F.lit("t"), c).alias("target"), F.col(c).cast("bigint").alias("ord"))
    return federation.composed_bridges(part("nation", "n_nationkey"), part("region", "r_regionkey"), part("supplier", "s_suppkey"))


@query("SELECT 'p' || s_suppkey AS project_id FROM supplier WHERE s_suppkey NOT IN (SELECT n_nationkey FROM nation)")
def cached_only(v):
    p = lambda t, c: v.table(t).select(F.concat(F.lit("p"), c).alias("project_id"))
    return federation.cached_only(p("supplier", "s_suppkey"), p("nation", "n_nationkey"))


@query("""SELECT 'v' || s_suppkey AS vault_id, CASE WHEN s_suppkey % 3 = 0 THEN '/r/' || s_suppkey END AS path FROM supplier""")
def routes_listed(v):
    k = F.col("s_suppkey")
    rows = v.table("supplier").select(F.concat(F.lit("v"), k).alias("vault_id"), F.concat(F.lit("/r/"), k).alias("path"), k.alias("k"))
    return upkeep.routes_of(upkeep.route_map(rows.where("k % 3 = 0").select("vault_id", "path")), rows.select("vault_id"))


# Verbs of catalogs


@query("""SELECT 'create' AS verb, name, CASE WHEN name LIKE '%/%' THEN 'invalid_name' WHEN name LIKE 'src%' THEN 'exists' ELSE 'created' END AS result FROM (SELECT DISTINCT source AS name FROM documents UNION SELECT 'n' || n_nationkey FROM nation UNION SELECT 'a/b')
    UNION ALL SELECT 'update', 'n' || n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'updated' ELSE 'no_such_namespace' END FROM nation
    UNION ALL SELECT 'remove', name, CASE WHEN name = 'default' THEN 'default_stays' WHEN name LIKE 'n%' THEN CASE WHEN name = 'none' THEN 'no_such_namespace' ELSE 'removed' END WHEN name = 'src1' THEN 'removed' ELSE 'has_nodes' END
        FROM (SELECT DISTINCT source AS name FROM documents UNION SELECT 'n' || n_nationkey FROM nation WHERE n_nationkey % 2 = 0 UNION SELECT 'default' UNION SELECT 'none')""")
def namespace_verbs(v):
    """Namespaces are created once, updated where they are, and removed unless they have nodes."""
    src = v.table("documents").select(F.col("source").alias("name")).distinct()
    nation = v.table("nation").select(F.concat(F.lit("n"), "n_nationkey").alias("name"), F.col("n_nationkey").alias("k"))
    at = lambda df: df.select("name", F.lit("/x").alias("root_path"))
    odd = v.spark.createDataFrame([("a/b",)], "name string")
    _, created = catalogs.create_namespaces(at(src), at(src.unionByName(nation.select("name")).unionByName(odd)))
    table = at(src).unionByName(at(nation.where("k % 2 = 0")))
    _, updated = catalogs.update_namespaces(table, nation.select("name", F.lit("/y").alias("root_path")))
    asked = src.unionByName(nation.where("k % 2 = 0").select("name")).unionByName(v.spark.createDataFrame([("default",), ("none",)], "name string"))
    _, removed = catalogs.remove_namespaces(table, asked.withColumn("force", F.col("name") == "src1"), v.table("documents").select(F.col("source").alias("namespace")))
    said = [df.select(F.lit(verb).alias("verb"), "name", "result") for verb, df in (("create", created), ("update", updated), ("remove", removed))]
    return said[0].unionByName(said[1]).unionByName(said[2])


@query("""WITH p AS (SELECT s_suppkey AS k, 'p' || s_suppkey AS id FROM supplier)
    SELECT 'project' AS kind, CASE WHEN k % 7 = 0 THEN 'q' || k ELSE id END AS a, CASE WHEN k % 3 = 0 THEN 'locked' ELSE 'open' END AS b FROM p WHERE k % 5 <> 0 UNION ALL SELECT 'project', 'new', 'open'
    UNION ALL SELECT 'bridge', CASE WHEN k % 7 = 0 THEN 'q' || k ELSE id END, CASE WHEN (k + 1) % 7 = 0 AND k + 1 IN (SELECT k FROM p) THEN 'q' || (k + 1) ELSE 'p' || (k + 1) END FROM p WHERE k % 5 <> 0 AND NOT ((k + 1) % 5 = 0 AND k + 1 IN (SELECT k FROM p))""")
def project_verbs(v):
    """Projects are removed with their bridges, renamed with their bridges, added and locked."""
    k = F.col("s_suppkey")
    p = v.table("supplier").select(F.concat(F.lit("p"), k).alias("project_id"), F.concat(F.lit("/p/"), k).alias("path"), F.lit(False).alias("readonly"), k.alias("k"))
    projects = p.drop("k")
    bridges = p.select(F.col("project_id").alias("source"), F.concat(F.lit("p"), F.col("k") + 1).alias("target"), F.array(F.lit("reads")).alias("allowed_relations"))
    projects, bridges, _ = catalogs.remove_projects(projects, bridges, p.where("k % 5 = 0").select("project_id"))
    projects, bridges, _ = catalogs.rename_projects(projects, bridges, p.where("k % 7 = 0").select("project_id", F.concat(F.lit("q"), "k").alias("new_id")))
    lock = p.where("k % 3 = 0").select(F.when(F.col("k") % 7 == 0, F.concat(F.lit("q"), "k")).otherwise(F.col("project_id")).alias("project_id"), F.lit(True).alias("readonly"))
    projects, _ = catalogs.set_readonly(projects, lock)
    more = v.spark.createDataFrame([("new", "/new", False), ("p1", "/again", False), ("other", "/p/1", False)], "project_id string, path string, readonly boolean")
    projects, _ = catalogs.add_projects(projects, more)
    ends = bridges.where("target <> 'p0'").select(F.lit("bridge").alias("kind"), F.col("source").alias("a"), F.col("target").alias("b"))
    return projects.select(F.lit("project").alias("kind"), F.col("project_id").alias("a"), F.when(F.col("readonly"), "locked").otherwise("open").alias("b")).unionByName(ends)


@query("""SELECT 'p' || k AS project_id, CASE verb WHEN 'mount' THEN CASE WHEN known THEN 'mount' ELSE 'no_such_project' END WHEN 'edit' THEN CASE WHEN NOT known THEN 'no_such_project' WHEN k % 2 = 0 THEN 'read_only' WHEN k % 5 = 0 THEN 'self_alias' WHEN k % 6 = 3 THEN 'materialized' ELSE 'edit' END
    ELSE CASE WHEN k % 6 = 3 THEN 'unmounted' ELSE 'not_mounted' END END AS result
    FROM (SELECT s_suppkey AS k, s_suppkey % 11 <> 0 AS known, CASE s_suppkey % 3 WHEN 0 THEN CASE WHEN s_suppkey % 4 = 3 THEN 'edit' ELSE 'unmount' END WHEN 1 THEN 'mount' ELSE 'edit' END AS verb FROM supplier)""")
def mount_verbs(v):
    """Mounts and edits with their guards: unknown, read-only, the workspace itself, copies."""
    k = F.col("k")
    p = v.table("supplier").select(F.concat(F.lit("p"), "s_suppkey").alias("project_id"), F.col("s_suppkey").alias("k"))
    projects = p.where("k % 11 <> 0").select("project_id", F.when(k % 5 == 0, "here").otherwise(F.concat(F.lit("v"), k)).alias("vault_id"), (k % 2 == 0).alias("readonly"))
    state = p.where("k % 6 = 3").select("project_id", F.lit(True).alias("active"), F.lit(False).alias("editable"), F.lit(True).alias("materialized"))
    verb = F.when(k % 3 == 0, F.when(k % 4 == 3, "edit").otherwise("unmount")).when(k % 3 == 1, "mount").otherwise("edit")
    return catalogs.mount(state, p.select("project_id", verb.alias("verb")), projects, "here")[1]


@query("""SELECT 'bridge' AS kind, 'n' || n_nationkey AS a, 'r' || n_regionkey AS b, CASE WHEN n_nationkey % 2 = 0 THEN 'calls,reads' ELSE 'reads' END AS c FROM nation WHERE n_nationkey % 5 <> 0
    UNION ALL SELECT 'bridge', 'r0', 'r1', 'calls' UNION ALL SELECT 'link', 't' || n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'live' ELSE 'edit' END, '' FROM nation WHERE n_nationkey % 3 <> 0
    UNION ALL SELECT 'den', 'd' || n_nationkey, CASE WHEN n_nationkey % 4 = 2 THEN '/moved/' || n_nationkey ELSE '/d/' || n_nationkey END, '' FROM nation WHERE n_nationkey % 4 <> 1 OR n_nationkey % 3 = 0 UNION ALL SELECT 'den', 'fresh', '/fresh', ''""")
def den_verbs(v):
    """Dens: bridges merged and removed, links set and removed, dens made, moved and destroyed."""
    k = F.col("n_nationkey")
    n = v.table("nation").select(k.alias("k"), F.concat(F.lit("n"), k).alias("a"), F.concat(F.lit("r"), "n_regionkey").alias("b"))
    bridges = n.select(F.col("a").alias("source"), F.col("b").alias("target"), F.array(F.lit("reads")).alias("allowed_relations"))
    known = n.select(F.col("a").alias("id")).unionByName(n.select(F.col("b").alias("id")))
    one = v.spark.createDataFrame([("r0", "r1", ["calls"]), ("r1", "r1", ["calls"]), ("r1", "none", ["calls"])], bridges.schema)
    back = n.where("k % 2 = 0").select(F.col("b").alias("source"), F.col("a").alias("target"), F.array(F.lit("calls")).alias("allowed_relations"))
    bridges, _ = catalogs.add_bridges(bridges, back.unionByName(one), known)
    bridges, _ = catalogs.remove_bridges(bridges, n.where("k % 5 = 0").select(F.col("a").alias("source"), F.col("b").alias("target"), F.array().cast("array<string>").alias("relations")))
    links = n.select(F.concat(F.lit("t"), "k").alias("target"), F.lit("edit").alias("mode"))
    links, _ = catalogs.add_links(links, n.where("k % 2 = 0").select(F.concat(F.lit("t"), "k").alias("target"), F.lit("live").alias("mode")))
    links, _ = catalogs.remove_links(links, n.where("k % 3 = 0").select(F.concat(F.lit("t"), "k").alias("target")))
    dens = n.select(F.concat(F.lit("d"), "k").alias("den_id"), F.concat(F.lit("/d/"), "k").alias("path"), F.when(F.col("k") % 3 == 0, 1).otherwise(0).alias("vaults"))
    verbs = n.where("k % 4 in (1, 2)").select(F.concat(F.lit("d"), "k").alias("den_id"), F.when(F.col("k") % 4 == 1, "destroy").otherwise("relocate").alias("verb"), F.concat(F.lit("/moved/"), "k").alias("path"))
    more = v.spark.createDataFrame([("fresh", "create", "/fresh"), ("d0", "create", "/again"), ("bad/id", "adopt", "/b"), ("late", "adopt", "/d/3")], "den_id string, verb string, path string")
    dens, _ = catalogs.change_dens(dens, verbs.unionByName(more))
    parts = [bridges.select(F.lit("bridge").alias("kind"), F.col("source").alias("a"), F.col("target").alias("b"), F.array_join(F.array_sort("allowed_relations"), ",").alias("c")),
             links.select(F.lit("link").alias("kind"), F.col("target").alias("a"), F.col("mode").alias("b"), s("").alias("c")), dens.select(F.lit("den").alias("kind"), F.col("den_id").alias("a"), F.col("path").alias("b"), s("").alias("c"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# Search and rendering


@search_query(_VEC + """, h AS (SELECT query_id, node_id, s FROM d WHERE vault = 'v0' QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, node_id) <= 10),
    o AS (SELECT query_id, '@' || vault || '/' || node_id AS node_id, s FROM d WHERE vault <> 'v0' QUALIFY row_number() OVER (PARTITION BY query_id, vault ORDER BY s DESC, node_id) <= 10),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, node_id)::INT AS rank FROM (SELECT * FROM h UNION ALL SELECT * FROM o) QUALIFY rank <= 10)
    SELECT query_id, r.node_id, round(s, 6) AS score, rank FROM r JOIN e ON r.node_id IN (e.node_id, '@' || e.vault || '/' || e.node_id) AND (e.vault = 'v0') = (r.node_id NOT LIKE '@%') WHERE e.label % 2 = 0""")
def api_search(v, q):
    """The web search: superseded rows too, other vaults, the limit before the namespace."""
    e = v.embeddings
    name = F.when(F.col("vault_id") == "v0", F.col("node_id")).otherwise(F.concat(F.lit("@"), "vault_id", F.lit("/"), "node_id"))
    nodes = e.select(name.alias("id"), F.lit("t").alias("type"), s("").alias("summary"), F.concat(F.lit("ns"), F.col("label") % 2).alias("namespace"))
    out = retrieval.api_search(e.where("vault_id = 'v0'"), q, nodes, 10, "ns0", others=e.where("vault_id <> 'v0'"))
    return _scored(out).select("query_id", "node_id", "score", "rank")


@search_query(_VEC + _TOP.format(where="WHERE label <> 9 AND model = 'm1'", k=20))
def code_search(v, q):
    """The search of the programmable client: twenty active rows."""
    return _scored(retrieval.search(v.embeddings, q, 20, model="m1", only_active=True))


@query(GRAPH + """ SELECT 'nation/3' AS id, sha256('  <node id="nation/3" type="module" depth="0" status="active">' || chr(10) || '    <summary>' || (SELECT summary FROM g_nodes WHERE id = 'nation/3') || '</summary>' || chr(10) || '    <edges>' || chr(10)
        || (SELECT string_agg('      <edge target="' || dst || '" relation="' || relation || '"/>' || chr(10), '' ORDER BY ord) FROM g_edges WHERE src = 'nation/3') || '    </edges>' || chr(10) || '    <context language="">a &lt; b &amp; &#34;c&#34;</context>' || chr(10) || '  </node>' || chr(10)) AS digest
    UNION ALL SELECT dst, sha256('  <node_compact id="' || dst || '" type="' || type || '" depth="1" status="active">' || chr(10) || '    <summary>' || n.summary || '</summary>' || chr(10) || '    <source path="' || dst || '.py" lines="1-9"/>' || chr(10) || '  </node_compact>' || chr(10))
        FROM g_edges JOIN g_nodes n ON n.id = dst WHERE src = 'nation/3'""")
def rendered_parts(v):
    """An entry in full, and what it leads to in short."""
    source = F.struct(F.concat("id", F.lit(".py")).alias("path"), F.array(F.lit(1), F.lit(9)).alias("lines"), s("").alias("hash"))
    nodes = v.nodes.withColumns({"context": F.lit('a < b & "c"'), "source": source})
    sub = retrieval.traverse(nodes, v.pairs, v.spark.createDataFrame([("nation/3",)], "id string"), depth=1)
    return retrieval.render(sub, nodes, v.pairs).select("id", F.sha2("part", 256).alias("digest"))


@query("""WITH d AS (SELECT lang AS q, doc_id AS ord, 'doc/' || doc_id AS id, repeat('p', (doc_id % 50)::INT + 1) || chr(10) AS part, doc_id % 2 = 0 AS whole, doc_id % 3 <> 0 AS inc FROM documents),
    g AS (SELECT q, coalesce(string_agg(part, '' ORDER BY ord) FILTER (WHERE inc AND whole), '') || coalesce(string_agg(part, '' ORDER BY ord) FILTER (WHERE inc AND NOT whole), '') AS body, count_if(inc)::BIGINT AS n,
        coalesce(string_agg('    <node_ref id="' || id || '" reason="budget"/>' || chr(10), '' ORDER BY ord) FILTER (WHERE NOT inc), '') AS refs FROM d GROUP BY 1),
    x AS (SELECT q, n, '<context_result tokens="' || (strlen(body) // 4) || '" nodes="' || n || '">' || chr(10) || body || CASE WHEN refs <> '' THEN '  <truncated>' || chr(10) || refs || '  </truncated>' || chr(10) ELSE '' END || '</context_result>' AS xml FROM g)
    SELECT q AS query_id, sha256(xml) AS digest, (strlen(xml) // 4)::INT AS tokens, n AS nodes FROM x""")
def result_documents(v):
    """Full parts, short parts, and references to what did not fit."""
    d = F.col("doc_id")
    packed = v.table("documents").select(F.col("lang").alias("query_id"), d.alias("ord"), F.concat(F.lit("doc/"), d).alias("id"), F.concat(F.expr("repeat('p', int(doc_id % 50) + 1)"), F.lit("\n")).alias("part"),
                                         F.when(d % 2 == 0, "full").otherwise("compact").alias("kind"), (d % 3 != 0).alias("included"))
    return retrieval.document(packed).select("query_id", F.sha2("xml", 256).alias("digest"), "tokens", "nodes")


@query("""SELECT '<context_result tokens="0" nodes="0">' || chr(10) || '</context_result>' AS xml, 0::BIGINT AS nodes""")
def empty_result(v):
    """A search over an empty store."""
    c = Client(v.full_nodes, v.spark.createDataFrame([], "node_id string, embedding array<float>, summary_hash string, model string, updated_at timestamp, status string"))
    return c.query("anything").select("xml", F.col("nodes").cast("bigint").alias("nodes"))


@query(GRAPH + """, l AS (SELECT dst AS id FROM g_edges WHERE src = 'region/1') SELECT mode, id, depth FROM (SELECT 'region/1' AS id, 0 AS depth UNION ALL SELECT id, 1 FROM l), (SELECT unnest(['adjacency', 'deep']) AS mode)""")
def traverse_modes(v):
    """The mode of a traversal is accepted and has no effect."""
    one = v.spark.createDataFrame([("region/1",)], "id string")
    out = [retrieval.traverse(v.nodes, v.pairs, one, depth=1, mode=m).select(F.lit(m).alias("mode"), "id", "depth") for m in ("adjacency", "deep")]
    return out[0].unionByName(out[1])


@query("""SELECT 'doc/' || doc_id AS id, doc_id % 4 AS kind, CASE doc_id % 4 WHEN 0 THEN 'update' WHEN 1 THEN 'add' WHEN 2 THEN 'add' ELSE 'noop' END AS action, CASE WHEN doc_id % 4 IN (1, 2) THEN 0.1 ELSE 0.9 END::DOUBLE AS confidence,
    CASE doc_id % 4 WHEN 0 THEN 'x/' || doc_id WHEN 3 THEN NULL END AS target, sha256('Incoming node:' || chr(10) || '  ID: doc/' || doc_id || chr(10) || '  Type: ' || lang || chr(10) || '  Summary: ' || source || chr(10) || '  Context: ' || repeat('c', 500) || chr(10) || chr(10)
    || 'Similar existing nodes:' || chr(10) || '  [1] ID: x/1' || chr(10) || '      Summary: one' || chr(10) || '      Similarity score: 0.9000' || chr(10) || chr(10) || 'Classify the operation and respond with only valid JSON.') AS prompt FROM documents""")
def model_classification(v):
    """Prompts to a language model, and its answers: fenced, broken, of another action, with words around."""

    @F.pandas_udf("struct<prompt:string,action:string,confidence:double,target:string>")
    def judged(ids: pd.Series, langs: pd.Series, sources: pd.Series) -> pd.DataFrame:
        rows = []
        for i, lang, source in zip(ids, langs, sources):
            asked = classify.prompt({"id": f"doc/{i}", "type": lang, "summary": source, "context": "c" * 700}, [{"node_id": "x/1", "summary": "one", "score": 0.9}])
            reply = {0: f'```json\n{{"action": "UPDATE", "target_node_id": "x/{i}", "confidence": 0.9}}\n```', 1: "I cannot say", 2: '{"action": "merge", "confidence": 1}', 3: 'So: {"action": "noop", "confidence": 0.9} it is'}[i % 4]
            got = classify.parse_reply(reply)
            rows.append((asked, got["action"], got["confidence"], got["target"]))
        return pd.DataFrame(rows, columns=["prompt", "action", "confidence", "target"])

    d = v.table("documents")
    out = d.select("doc_id", judged("doc_id", "lang", "source").alias("x"))
    return out.select(F.concat(F.lit("doc/"), "doc_id").alias("id"), (F.col("doc_id") % 4).alias("kind"), "x.action", "x.confidence", "x.target", F.sha2("x.prompt", 256).alias("prompt"))


@query("""SELECT 'doc/' || doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN CASE WHEN doc_id % 7 = 0 THEN 'superseded' ELSE 'active' END ELSE 'active' END AS status, CASE WHEN doc_id % 3 = 1 THEN sha256(text) ELSE sha256(text) END AS digest FROM documents WHERE doc_id % 5 <> 0 AND NOT (doc_id % 3 = 0 AND doc_id % 7 = 0)
    UNION ALL SELECT 'doc/' || doc_id, 'active', sha256(text) FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 3 = 0 AND doc_id % 7 = 0
    UNION ALL SELECT 'doc/' || doc_id, CASE WHEN doc_id % 7 = 0 THEN 'superseded' ELSE 'active' END, CASE WHEN doc_id % 3 = 1 THEN sha256('other') ELSE sha256(text) END FROM documents WHERE doc_id % 5 = 0 AND doc_id % 3 < 2""")
def contribute_apply(v):
    """The plan of a contribution carried out."""
    source = _doc_nodes(v)
    n = F.substring("id", 5, 20).cast("long")
    target = source.where(n % 3 < 2).withColumn("context", F.when(n % 3 == 1, "other").otherwise(F.col("context"))).withColumn("status", F.when(n % 7 == 0, "superseded").otherwise("active"))
    plan = materialize(classify.contribution(source, target), "plan")
    out = classify.apply_contribution(source, target, plan, NOW)
    return out.select("id", "status", F.sha2(blank(F.col("context")), 256).alias("digest"))
