"""Further registered queries: federation, extraction, embedding upkeep and views."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import text as tx
from graphloom.functions import vectors
from graphloom.operators import classify, federation, graph, heat, integrity, mutations, retrieval, upkeep
from graphloom.plans.catalog import _HEAT, _VEC, _doc_files, _doc_nodes, _heat, _scored, query, search_query
from graphloom.plans.views import GRAPH
from graphloom.sources import source_tree


@query(GRAPH + " SELECT e.src, e.dst, e.relation, CASE WHEN e.relation = 'associated' THEN 0.5 ELSE 0.0 END::DOUBLE AS heat FROM g_edges e")
def heat_edges(v):
    pairs = v.pairs.where("relation = 'associated'").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.lit(0.5).alias("weight"))
    return heat.with_heat(v.pairs.select("src", "dst", "relation"), pairs)


@query(_HEAT + " SELECT a, b, round(w, 6) AS weight FROM h WHERE w >= 0.06 AND (a IN ('click', 'view') OR b IN ('click', 'view'))")
def heat_touching(v):
    ids = v.spark.createDataFrame([("click",), ("view",)], "id string")
    return heat.visible(_heat(v), ids).select("a", "b", F.round("weight", 6).alias("weight"))


@query(GRAPH + " SELECT DISTINCT CASE WHEN src = 'nation/3' THEN dst ELSE src END AS id FROM g_edges WHERE src = 'nation/3' OR dst = 'nation/3'")
def highlight(v):
    return graph.highlight(v.pairs, "nation/3")


@query(GRAPH + " SELECT DISTINCT src AS id FROM g_edges WHERE dst = 'part/5'")
def inbound_sources(v):
    return graph.inbound_sources(v.pairs, "part/5")


@query(GRAPH + " SELECT src, dst, relation FROM g_edges WHERE src IN ('nation/1', 'part/5') OR dst IN ('nation/1', 'part/5')")
def adjacency(v):
    ids = v.spark.createDataFrame([("nation/1",), ("part/5",)], "id string")
    return graph.adjacent(v.pairs, ids, "both").select("src", "dst", "relation")


@query(GRAPH + """ SELECT id FROM g_nodes WHERE id NOT LIKE 'customer/%5'""")
def hard_delete(v):
    return mutations.hard_delete(v.nodes, v.nodes.where("id LIKE 'customer/%5'")).select("id")


@query(GRAPH + """ SELECT src, dst, relation FROM g_edges WHERE NOT (src LIKE 'customer/%5' OR dst LIKE 'customer/%5')""")
def remove_cascade(v):
    gone = v.nodes.where("id LIKE 'customer/%5'").select("id")
    return graph.remove(v.nodes, v.pairs, gone)[1].select("src", "dst", "relation")


@query(GRAPH + " SELECT id, CASE WHEN id LIKE 'part/%7' AND status IN ('', 'active') THEN 'superseded' ELSE status END AS status FROM g_nodes")
def soft_delete(v):
    nodes = v.nodes.withColumn("valid_until", F.lit(""))
    return mutations.delete(nodes, F.col("id").rlike("^part/.*7$"), "2024-01-01T00:00:00Z").select("id", "status")


@search_query(_VEC + """ SELECT query_id, e.node_id AS node_id, round(s, 6) AS score, e.vec_id AS vec_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, e.node_id)::INT AS rank
    FROM d JOIN e ON e.node_id = d.node_id QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, e.node_id) <= 3""")
def hits_to_nodes(v, q):
    hits = _scored(retrieval.search(v.embeddings, q, 3))
    return hits.join(v.embeddings.select("node_id", "vec_id"), "node_id").select("query_id", "node_id", "score", "vec_id", "rank")


@query("SELECT count(*) AS n, string_agg(DISTINCT 'm' || (label % 2), ',' ORDER BY 'm' || (label % 2)) AS models, max(len(embedding))::INT AS dim, count_if(label % 2 <> 0)::BIGINT AS mismatched FROM embeddings")
def store_report(v):
    return vectors.store_report(v.embeddings, "m0").withColumn("models", F.array_join("models", ","))


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.v, b.v), 6) AS cosine FROM e a JOIN e b ON b.vec_id = a.vec_id + 1""")
def cosine_pairs(v):
    e = v.table("embeddings")
    a = e.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x"), (F.col("vec_id") + 1).alias("b"))
    both = a.join(e.select(F.col("vec_id").alias("b"), F.col("embedding").alias("y")), "b")
    return both.select("a", "b", F.round(vectors.cosine(F.col("x"), F.col("y")), 6).alias("cosine"))


@query("""SELECT 'doc/' || doc_id AS node_id FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 3 <> 1""")
def embedding_stale(v):
    texts = upkeep.embedding_texts(_doc_nodes(v))
    n = F.substring("node_id", 5, 20).cast("long")
    store = texts.where(n % 3 < 2).select("node_id", F.when(n % 3 == 1, F.col("hash")).otherwise("old").alias("summary_hash"))
    return mutations.stale_embeddings(store, texts.select("node_id", "hash"))


@query(r"""SELECT ref, ref <> '' AND strlen(ref) <= 512 AND NOT contains(ref, '..') AND NOT starts_with(ref, '/') AND NOT regexp_matches(ref, '(^|/)\.') AND NOT contains(ref, '//') AND NOT ends_with(ref, '/') AS valid FROM (
    SELECT CASE page_id % 7 WHEN 0 THEN '' WHEN 1 THEN '/a' || page_id WHEN 2 THEN 'a/../' || page_id WHEN 3 THEN 'a//' || page_id WHEN 4 THEN '.x/' || page_id WHEN 5 THEN repeat('y', 510) || page_id ELSE 'ok/' || page_id END AS ref FROM pages)""")
def id_validation(v):
    i, m = F.col("page_id").cast("string"), F.col("page_id") % 7
    ref = F.when(m == 0, "").when(m == 1, F.concat(F.lit("/a"), i)).when(m == 2, F.concat(F.lit("a/../"), i)).when(m == 3, F.concat(F.lit("a//"), i)).when(m == 4, F.concat(F.lit(".x/"), i)).when(
        m == 5, F.concat(F.lit("y" * 510), i)).otherwise(F.concat(F.lit("ok/"), i))
    out = v.table("pages").select(ref.alias("ref"))
    return out.select("ref", tx.valid_id("ref").alias("valid"))


@query(GRAPH + """ SELECT src, s.namespace AS src_ns, split_part(dst, '/', 1) AS dst_ns, regexp_replace(dst, '^[^/]*/', '') AS node, relation FROM g_edges JOIN g_nodes s ON s.id = src
    WHERE split_part(dst, '/', 1) IN ('part', 'supplier', 'sales') AND split_part(dst, '/', 1) <> s.namespace""")
def cross_namespace(v):
    spaces = v.spark.createDataFrame([("part",), ("supplier",), ("sales",)], "name string")
    return federation.cross_namespace(v.pairs, v.nodes, spaces)


@query("""WITH r AS (SELECT 'v' || s_suppkey AS vault_id, '/r/' || s_suppkey AS path FROM supplier WHERE s_suppkey % 2 = 0), m AS (SELECT 'v' || s_suppkey AS vault_id, '/m/' || s_suppkey AS path FROM supplier WHERE s_suppkey % 3 = 0 AND s_suppkey % 5 <> 0)
    SELECT coalesce(r.vault_id, m.vault_id) AS vault_id, coalesce(m.path, r.path) AS path, coalesce(m.path <> r.path, false) AS conflict FROM r FULL JOIN m ON r.vault_id = m.vault_id""")
def route_overlay(v):
    k = F.col("s_suppkey")
    s = v.table("supplier").select(F.concat(F.lit("v"), k).alias("vault_id"), k.alias("k"))
    routes = s.where("k % 2 = 0").select("vault_id", F.concat(F.lit("/r/"), "k").alias("path"))
    mounts = s.where("k % 3 = 0").select("vault_id", F.concat(F.lit("/m/"), "k").alias("path"), F.lit(True).alias("available"), (F.col("k") % 5 == 0).alias("is_alias"))
    return federation.route_overlay(routes, mounts)


@query("""SELECT 'v' || s_suppkey AS vault_id, CASE WHEN s_suppkey % 2 = 0 THEN '/link' WHEN s_suppkey % 3 = 0 THEN '/route' ELSE '/bridge' END AS path FROM supplier""")
def vault_precedence(v):
    k = F.col("s_suppkey")
    s = v.table("supplier").select(F.concat(F.lit("v"), k).alias("vault_id"), k.alias("k"))
    at = lambda cond, p: s.where(cond).select("vault_id", F.lit(p).alias("path"))
    return federation.vault_paths(at("k % 2 = 0", "/link"), at("k % 3 = 0", "/route"), at("true", "/bridge"))


@query("""SELECT 'p' || n_nationkey AS project_id, '/p' || n_nationkey AS path, 'v' || n_nationkey AS vault_id, n_nationkey % 2 = 0 AS active, n_nationkey % 4 = 0 AND n_nationkey % 3 <> 0 AS editable,
    n_nationkey % 4 = 0 OR n_nationkey % 5 = 0 AS available, n_nationkey = 7 AS is_alias FROM nation""")
def active_mounts(v):
    k = F.col("n_nationkey")
    n = v.table("nation").select(F.concat(F.lit("p"), k).alias("project_id"), F.concat(F.lit("/p"), k).alias("path"), F.concat(F.lit("v"), k).alias("vault_id"), k.alias("k"))
    projects = n.select("project_id", "path", (F.col("k") % 3 == 0).alias("readonly"))
    state = n.select("project_id", (F.col("k") % 2 == 0).alias("active"), (F.col("k") % 4 == 0).alias("editable"), (F.col("k") % 5 == 0).alias("materialized"))
    return federation.active_mounts(projects, n.select("project_id", "vault_id"), state, "v7")


@query("""WITH b AS (SELECT 'v' || a.n_nationkey AS x, 'v' || b.n_nationkey AS y, 'r' || ((a.n_nationkey + b.n_nationkey) % 3) AS r FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey WHERE a.n_nationkey % 5 > 0 AND b.n_nationkey % 5 > 0)
    SELECT least(x, y) AS lo, greatest(x, y) AS hi, string_agg(DISTINCT r, ',' ORDER BY r) AS relations FROM b GROUP BY ALL""")
def runtime_bridges(v):
    n = v.table("nation")
    k = F.col("n_nationkey")
    mounts = n.select(F.lit("c").alias("catalog"), F.concat(F.lit("p"), k).alias("project_id"), F.concat(F.lit("v"), k).alias("vault_id"), (k % 5 > 0).alias("active"), F.lit(True).alias("available"))
    a, b = n.select(k.alias("a"), "n_regionkey"), n.select(k.alias("b"), "n_regionkey")
    links = a.join(b, "n_regionkey").where("a <> b").select(
        F.lit("c").alias("catalog"), F.concat(F.lit("p"), "a").alias("source"), F.concat(F.lit("p"), "b").alias("target"), F.array(F.concat(F.lit("r"), (F.col("a") + F.col("b")) % 3)).alias("allowed_relations"), (F.col("a") * 100 + F.col("b")).alias("ord")
    )
    return federation.runtime_bridges(mounts, links).select("lo", "hi", F.array_join(F.array_sort("allowed_relations"), ",").alias("relations"))


@query("""SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'catalog_url' WHEN 1 THEN 'checkout_vault' ELSE 'none' END AS via, CASE page_id % 3 WHEN 0 THEN 'v' || page_id WHEN 1 THEN 'c' || page_id END AS vault_id FROM pages""")
def resolve_references(v):
    i, m = F.col("page_id").cast("string"), F.col("page_id") % 3
    p = v.table("pages")
    refs = p.select("page_id", F.when(m == 0, F.concat(F.lit("git@H.org:r/"), i, F.lit(".git"))).otherwise("").alias("url"), F.when(m == 1, F.concat(F.lit("/co/"), i)).otherwise("").alias("path"))
    projects = p.select(F.concat(F.lit("p"), i).alias("project_id"), F.concat(F.lit("https://h.org/r/"), i).alias("source_url"), F.concat(F.lit("v"), i).alias("vault_id"), F.lit(0).alias("ord"))
    checkouts = p.select(F.concat(F.lit("/co/"), i).alias("path"), F.concat(F.lit("c"), i).alias("vault_id"))
    return federation.resolve_references(refs, projects, checkouts).select("page_id", "via", "vault_id")


@query(GRAPH + " SELECT id FROM g_nodes WHERE type IN ('class', 'concept') AND list_has_any(tags, ['n3', 'size7', 'BUILDING'])")
def visible_nodes(v):
    return federation.visible_nodes(v.nodes, ["class", "concept"], ["n3", "size7", "BUILDING"]).select("id")


@query(GRAPH + " SELECT id FROM g_nodes WHERE status IN ('', 'active') AND contains(lower(id), '12') ORDER BY id LIMIT 3")
def did_you_mean(v):
    return federation.did_you_mean(v.nodes, "missing/12")


@query(GRAPH + """, i AS (SELECT namespace, '- [[' || id || ']] (' || type || ')' || chr(10) AS item, row_number() OVER (PARTITION BY namespace ORDER BY id) AS k, count(*) OVER (PARTITION BY namespace) AS n
        FROM g_nodes WHERE status IN ('', 'active')),
    f AS (SELECT namespace, k, 'Summary of namespace ' || namespace || ' with ' || n || ' nodes.' || chr(10) || chr(10) || item AS text FROM i WHERE k = 1
        UNION ALL SELECT i.namespace, i.k, CASE WHEN strlen(text) > 500 THEN text ELSE text || i.item END FROM f JOIN i ON i.namespace = f.namespace AND i.k = f.k + 1 WHERE f.k < 80)
    SELECT namespace, max_by(text, k) AS text FROM f GROUP BY 1""")
def template_summary(v):
    return federation.template_summary(v.nodes)


@query(GRAPH + " SELECT n.id, n.type, count(e.dst) AS targets FROM g_nodes n LEFT JOIN g_edges e ON e.src = n.id WHERE n.status IN ('', 'active') GROUP BY ALL")
def summary_input(v):
    return federation.summary_input(v.nodes, v.edges).select("id", "type", F.size("targets").cast("bigint").alias("targets"))


@query("""SELECT CASE WHEN doc_id % 2 = 0 THEN 'info' ELSE 'error' END AS severity, count(*) AS n FROM documents GROUP BY 1 UNION ALL
    SELECT 'warning', (count_if(doc_id % 10 = 0) + count_if(doc_id % 2 <> 0) + count_if(doc_id % 25 = 0) + count_if(doc_id % 5 = 0 AND doc_id % 25 <> 0))::BIGINT FROM documents""")
def issue_counts(v):
    return integrity.issue_counts(integrity.integrity(_doc_nodes(v), files=_doc_files(v)))


@query("""SELECT 'doc/' || doc_id AS id, CASE WHEN doc_id % 5 = 0 THEN 'update' WHEN doc_id % 2 = 0 THEN 'skip' WHEN doc_id % 3 = 0 THEN 'add' ELSE 'update' END AS action FROM documents WHERE doc_id % 10 <> 0""")
def incremental_run(v):
    old = _doc_nodes(v).where("NOT (substring(id, 5, 20) % 2 <> 0 AND substring(id, 5, 20) % 3 = 0 AND substring(id, 5, 20) % 5 <> 0)")
    found = _doc_files(v).select(F.concat(F.lit("doc/"), F.substring("path", 5, 20)).alias("id"), F.struct(F.col("path"), F.array(F.lit(0), F.lit(0)).alias("lines"), F.col("hash")).alias("source"))
    return source_tree.incremental(found, old).select("id", "action")


@query("""SELECT count_if(doc_id % 4 = 0)::BIGINT AS added, count_if(doc_id % 4 = 1)::BIGINT AS updated, count_if(doc_id % 4 = 2)::BIGINT AS superseded, count_if(doc_id % 4 = 3)::BIGINT AS noop, 0::BIGINT AS skipped, 0::BIGINT AS errors, count(*) AS total FROM documents""")
def action_counts(v):
    n = F.col("doc_id") % 4
    return classify.action_counts(v.table("documents").select(F.when(n == 0, "add").when(n == 1, "update").when(n == 2, "supersede").otherwise("noop").alias("action")))


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'update' WHEN 1 THEN 'read_only' WHEN 2 THEN 'unknown_mount' ELSE 'no_such_node' END AS verdict FROM pages""")
def mounted_writes(v):
    i, m = F.col("page_id").cast("string"), F.col("page_id") % 4
    p = v.table("pages")
    writes = p.select("page_id", F.concat(F.lit("@"), F.when(m == 1, "ro").when(m == 2, "none").otherwise("rw"), F.lit("/n/"), i).alias("id"))
    mounts = v.spark.createDataFrame([("rw", True, True), ("ro", True, False)], "vault_id string, active boolean, editable boolean")
    nodes = p.where("page_id % 4 = 0").select(F.lit("rw").alias("vault_id"), F.concat(F.lit("n/"), i).alias("id"))
    return upkeep.mounted_writes(writes, mounts, nodes).select("page_id", "verdict")


@query("""SELECT conv_id, turn, len(regexp_extract_all(body, '(?s)```[A-Za-z]*\n(.*?)```'))::INT AS blocks FROM (SELECT conv_id, turn, text || CASE WHEN turn % 2 = 0 THEN chr(10) || '```py' || chr(10) || 'x' || chr(10) || '```' ELSE '' END AS body FROM conversations)""")
def code_blocks(v):
    body = F.concat("text", F.when(F.col("turn") % 2 == 0, "\n```py\nx\n```").otherwise(""))
    return v.table("conversations").select("conv_id", "turn", F.size(tx.code_blocks(body)).alias("blocks"))
