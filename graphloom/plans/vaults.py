"""Registered queries over vault files, stores, configuration and evaluation files."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from graphloom.functions import text as tx
from graphloom.functions import vectors
from graphloom.operators import evals, graph, integrity, mutations, upkeep
from graphloom.plans.catalog import _HEAT as HEAT
from graphloom.plans.catalog import _doc_files as doc_files
from graphloom.plans.catalog import _doc_nodes, _heat, query
from graphloom.plans.views import text_of as s
from graphloom.schema import clamp_budget, clamp_depth, clamp_limit, clamp_neighbors, normal_namespace
from graphloom.sources import source_tree, vault
from graphloom.storage import scratch_path

# Node files made of documents: some without frontmatter, one kind without its end, some without id, and some that share one.
_FILES = """WITH f AS (SELECT doc_id, lang, source, n_chars, 'doc/' || doc_id || '.md' AS file_path,
        CASE doc_id % 10 WHEN 2 THEN 'doc/' || doc_id WHEN 3 THEN 'doc/shared' ELSE 'doc/' || doc_id END AS id,
        CASE WHEN doc_id % 5 = 0 THEN 'superseded' ELSE 'active' END AS status FROM documents WHERE doc_id % 20 NOT IN (0, 1)),
    n AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY id ORDER BY file_path) = 1)"""


def _files(v):
    d, m = F.col("doc_id"), F.col("doc_id") % 10
    head = F.concat(
        F.when(m == 2, "").when(m == 3, "id: doc/shared\n").otherwise(F.concat(F.lit("id: doc/"), d, F.lit("\n"))), F.lit("type: "), F.col("lang"), F.lit("\nnamespace: "), F.col("source"),
        F.when(d % 5 == 0, "\nstatus: superseded").otherwise("\nstatus: active"), F.lit("\ntags: ["), F.col("lang"), F.lit(", t"), d % 3, F.lit("]\nsource:\n  path: src/"), d,
        F.lit(".py\n  lines: [1, "), F.col("n_chars"), F.lit("]\nedges:\n- target: doc/"), d + 1, F.lit("\n  relation: calls\n- {target: x, relation: reads}\n"),
    )
    body = F.concat(F.lit("\n  About "), F.col("source"), F.lit(".\n\n## Relationships\n\n- **calls** [[x]]\n\n## Context\n\nof "), d, F.lit(" chars\n\nand more\n\n## Notes\n\nrest\n"))
    text = F.when(d % 20 == 0, F.lit("no frontmatter")).when(d % 20 == 1, F.concat(F.lit("---\n"), head)).otherwise(F.concat(F.lit("\n---\n"), head, F.lit("--- \n"), body))
    return v.table("documents").select(F.concat(F.lit("doc/"), d, F.lit(".md")).alias("rel"), text.alias("text"))


@query(_FILES + """ SELECT id, lang AS type, source AS namespace, status, 'About ' || source || '.' AS summary, 'of ' || doc_id || ' chars' || chr(10) || chr(10) || 'and more' AS context, lang || ',t' || (doc_id % 3) AS tags,
    2 AS edges, 'doc/' || (doc_id + 1) AS target, 'src/' || doc_id || '.py' AS path, n_chars::INT AS last, file_path FROM n""")
def vault_scan(v):
    out = vault.parse_files(_files(v))
    return out.select("id", "type", "namespace", "status", "summary", "context", F.array_join("tags", ",").alias("tags"), F.size("edges").alias("edges"), F.col("edges")[0]["target"].alias("target"),
                      F.col("source.path").alias("path"), F.col("source.lines")[1].alias("last"), "file_path")


@query(_FILES + " SELECT id, lang AS type, source AS namespace, status, lang || ',t' || (doc_id % 3) AS tags, file_path FROM n")
def vault_metadata(v):
    return vault.metadata(vault.parse_files(_files(v))).withColumn("tags", F.array_join("tags", ","))


@query(_FILES + " SELECT id, file_path FROM n WHERE status = 'active'")
def vault_active(v):
    return graph.active(vault.metadata(vault.parse_files(_files(v)))).select("id", "file_path")


@query(_FILES + " SELECT id, source AS namespace, file_path FROM n WHERE id IN ('doc/shared', 'doc/17')")
def vault_point_read(v):
    nodes = vault.parse_files(_files(v))
    return nodes.where(F.col("id").isin("doc/shared", "doc/17")).select("id", "namespace", "file_path")


@query("""SELECT 'doc/' || doc_id || '.md' AS file_path, CASE WHEN doc_id % 20 = 0 THEN 'no frontmatter' ELSE 'frontmatter does not end' END AS error FROM documents WHERE doc_id % 20 IN (0, 1)""")
def vault_errors(v):
    return vault.parse_files(_files(v), with_errors=True)


def _plain_nodes(v):
    """Document nodes with short texts, as files show them."""
    return _doc_nodes(v).withColumns({"valid_from": s(""), "valid_until": s(""), "context": F.concat(F.lit("of "), "namespace"), "tags": F.array("type", F.lit("kept"))})


@query("""SELECT 'doc/' || doc_id AS id, sha256('---' || chr(10) || 'id: doc/' || doc_id || chr(10) || 'type: ' || lang || chr(10) || 'namespace: ' || source || chr(10) || 'status: ' || CASE WHEN doc_id % 5 = 0 THEN 'superseded' ELSE 'active' END || chr(10)
    || 'source:' || chr(10) || '  path: ' || CASE WHEN doc_id % 10 = 0 THEN 'gone/' ELSE 'src/' END || doc_id || chr(10) || '  lines:' || chr(10) || '  - 0' || chr(10) || '  - 0' || chr(10) || '  hash: '
    || CASE WHEN doc_id % 2 = 0 THEN 'h' || doc_id ELSE '''0''' END || chr(10) || 'edges:' || chr(10) || '- target: ' || source || chr(10) || '  relation: ' || CASE WHEN doc_id % 2 = 0 THEN 'references' ELSE 'reads' END || chr(10)
    || 'tags:' || chr(10) || '- ' || lang || chr(10) || '- kept' || chr(10) || '---' || chr(10) || CASE WHEN doc_id % 4 = 0 THEN '' ELSE chr(10) || lang || chr(10) END
    || chr(10) || '## Relationships' || chr(10) || chr(10) || '- **' || CASE WHEN doc_id % 2 = 0 THEN 'references' ELSE 'reads' END || '** [[' || source || ']]' || chr(10)
    || chr(10) || '## Context' || chr(10) || chr(10) || 'of ' || source || chr(10)) AS digest FROM documents""")
def node_render(v):
    n = F.substring("id", 5, 20).cast("long")
    nodes = _plain_nodes(v).withColumn("source", F.col("source").withField("hash", F.when(n % 2 == 0, F.concat(F.lit("h"), n)).otherwise("0")))
    return vault.rendered(nodes).select("id", F.sha2("text", 256).alias("digest"))


@query("SELECT 'nation/' || n_nationkey AS id, 'module' AS type, n_name AS summary, 'in region/' || n_regionkey AS context, 'region/' || n_regionkey AS target FROM nation")
def vault_round_trip(v):
    """Nodes written as files and read again."""
    nation = v.table("nation").select(F.concat(F.lit("nation/"), "n_nationkey").alias("id"), F.col("n_name").alias("_name"), F.concat(F.lit("region/"), "n_regionkey").alias("_region"))
    nodes = _doc_nodes(v).limit(0).unionByName(nation.select("id", F.lit("module").alias("type"), F.col("_name").alias("summary"), F.concat(F.lit("in "), "_region").alias("context"), F.array(
        F.struct(F.col("_region").alias("target"), F.lit("reads").alias("relation"))).alias("edges")), allowMissingColumns=True)
    path = scratch_path(v.spark, "vault")
    vault.write_vault(nodes, path)
    return vault.read_written(v.spark, path).select("id", "type", "summary", "context", F.col("edges")[0]["target"].alias("target"))


@query(HEAT + " SELECT a, b, hits, round(w, 6) AS weight, (row_number() OVER (ORDER BY round(w, 9) DESC, a, b) - 1)::INT AS ord FROM h")
def heat_files(v):
    """Heat saved hottest first, and loaded again."""
    rows = _heat(v).select(F.lit("all").alias("namespace"), "a", "b", F.round("weight", 9).alias("weight"), "hits", s("").alias("last"))
    return vault.heat_rows(vault.heat_files(rows)).select("a", "b", "hits", F.round("weight", 6).alias("weight"), "ord")


@query(HEAT + " SELECT a, b FROM h WHERE a > 'c'")
def heat_startup(v):
    """At start-up the pairs of one namespace are loaded."""
    rows = _heat(v).select(F.when(F.col("a") > "c", "own").otherwise("other").alias("namespace"), "a", "b", "weight", "hits", s("").alias("last"))
    return vault.heat_rows(vault.heat_files(rows).where("namespace = 'own'")).select("a", "b")


@query("SELECT doc_id, source AS namespace, 'n' || n_chars AS node_count, 'All of ' || lang || '.' AS body FROM documents")
def summary_files(v):
    d = v.table("documents")

    @F.pandas_udf("struct<namespace:string,node_count:string,body:string>")
    def both_ways(name: pd.Series, n: pd.Series, body: pd.Series) -> pd.DataFrame:
        out = [vault.parse_summary(vault.render_summary({"namespace": a, "node_count": f"n{c}"}, b)) for a, c, b in zip(name, n, body)]
        return pd.DataFrame([{**head, "body": text} for head, text in out])

    return d.select("doc_id", both_ways("source", "n_chars", F.concat(F.lit(" All of "), "lang", F.lit(".\n"))).alias("x")).select("doc_id", "x.*")


@query("""SELECT page_id, 'v' || page_id AS vault_id, (CASE WHEN page_id % 3 = 0 THEN 4096 ELSE page_id + 100 END)::INT AS budget, page_id % 2 = 0 AS custom, false AS leaks FROM pages""")
def config_files(v):
    """Configurations read and written without secrets."""
    i = F.col("page_id")
    text = F.concat(F.lit("---\nversion: '1'\nvault_id: v"), i, F.lit("\nopenai_api_key: sk-1\ntoken_budget: "), F.when(i % 3 == 0, 0).otherwise(i + 100), F.when(i % 2 == 0, "\ncustom: x").otherwise(""), F.lit("\n---\n"))

    @F.pandas_udf("struct<vault_id:string,budget:int,custom:boolean,leaks:boolean>")
    def read(texts: pd.Series) -> pd.DataFrame:
        got = [vault.parse_config(t) for t in texts]
        safe = [vault.render_config(c, secrets=False) for c in got]
        again = [vault.parse_config(t) for t in safe]
        return pd.DataFrame({"vault_id": [c.vault_id for c in again], "budget": [c.effective_budget for c in again], "custom": ["custom" in c.extra for c in again], "leaks": ["sk-1" in t for t in safe]})

    return v.table("pages").select("page_id", read(text).alias("x")).select("page_id", "x.*")


@query("SELECT s_suppkey, 'n' || s_nationkey AS source, 'n' || (s_suppkey % 5) AS target, 'calls,reads' AS relations, s_name AS name FROM supplier")
def manifest_files(v):
    """Manifests (namespaces, bridges, catalogs) written and read; a bridge is an edge."""
    k = v.table("supplier").select("s_suppkey", "s_name", F.concat(F.lit("n"), "s_nationkey").alias("source"), F.concat(F.lit("n"), F.col("s_suppkey") % 5).alias("target"))

    @F.pandas_udf("struct<source:string,target:string,relations:string,name:string>")
    def both_ways(a: pd.Series, b: pd.Series, name: pd.Series) -> pd.DataFrame:
        texts = [vault.render_manifest(name=n, source=x, target=y, allowed_relations=["calls", "reads"], created=None) for x, y, n in zip(a, b, name)]
        return pd.DataFrame([{"source": m["source"], "target": m["target"], "relations": ",".join(m["allowed_relations"]), "name": m["name"]} for m in map(vault.parse_manifest, texts)])

    return k.select("s_suppkey", both_ways("source", "target", "s_name").alias("x")).select("s_suppkey", "x.*")


_BRIDGES = "source string, target string, allowed_relations array<string>, source_vault_id string, target_vault_id string, ord int"


@query("""SELECT 'n' || n_nationkey AS source, 'n' || n_regionkey AS target, 'reads' AS relations FROM nation UNION ALL SELECT 'here', 'there', 'calls' UNION ALL SELECT 'there', 'here', 'calls'""")
def bridge_both_sides(v):
    old = v.table("nation").select(F.concat(F.lit("n"), "n_nationkey").alias("source"), F.concat(F.lit("n"), "n_regionkey").alias("target"), F.array(F.lit("reads")).alias("allowed_relations"), s("").alias("source_vault_id"),
                                   s("").alias("target_vault_id"), F.lit(0).alias("ord"))
    return vault.both_sides(v.spark.createDataFrame([], _BRIDGES).unionByName(old), "here", "there", ["calls"]).select("source", "target", F.array_join("allowed_relations", ",").alias("relations"))


@query("""SELECT 'v' || s_suppkey AS vault_id, CASE WHEN s_suppkey % 2 = 0 THEN '/new/' ELSE '/old/' END || s_suppkey AS path FROM supplier WHERE s_suppkey % 3 <> 0
    UNION ALL SELECT 'w' || s_suppkey, '/new/' || s_suppkey FROM supplier WHERE s_suppkey % 4 = 0""")
def route_table(v):
    """Routes set by key, some dropped, some ensured."""
    k = F.col("s_suppkey")
    rows = v.table("supplier").select(F.concat(F.lit("v"), k).alias("vault_id"), F.concat(F.lit("/old/"), k).alias("path"), k.alias("k"))
    new = rows.where("k % 2 = 0").select("vault_id", F.concat(F.lit("/new/"), "k").alias("path"))
    out = vault.drop_rows(vault.put_rows(rows.select("vault_id", "path"), new, ["vault_id"]), rows.where("k % 3 = 0").select("vault_id"))
    more = rows.where("k % 4 = 0").select(F.concat(F.lit("w"), "k").alias("vault_id"), F.concat(F.lit("/new/"), "k").alias("path"))
    there = rows.where("k % 3 <> 0").select("vault_id", F.lit("/never").alias("path"))
    return vault.ensure_rows(out, more.unionByName(there), ["vault_id"])


@query("SELECT 'doc/' || doc_id AS id, lang AS type FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 10 <> 0")
def vault_copy(v):
    """A filtered copy of a vault, read back."""
    path = scratch_path(v.spark, "copy")
    nodes = graph.active(_doc_nodes(v)).where(~F.col("source.path").startswith("gone/")).withColumn("id", F.concat("id", F.lit(".md")))
    vault.materialize_copy(nodes.select("id", "type"), path)
    return v.spark.read.parquet(path)


@query(r"""SELECT p AS path, sha256(c) AS hash FROM (SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'src/a' || page_id || '.py' WHEN 1 THEN 'x/node_modules/' || page_id || '.js' WHEN 2 THEN 'logs/' || page_id || '.log' WHEN 3 THEN 'a/.git/' || page_id
    WHEN 4 THEN 'build/' || page_id || '/o.c' ELSE 'a/b/' || page_id || '.go' END AS p, coalesce(html, '') AS c FROM pages) WHERE page_id % 6 IN (0, 5) AND page_id % 5 <> 0""")
def source_scan(v):
    """Files that no rule ignores and that are text: one in five has a NUL."""
    i, m = F.col("page_id").cast("string"), F.col("page_id") % 6
    path = F.when(m == 0, F.concat(F.lit("src/a"), i, F.lit(".py"))).when(m == 1, F.concat(F.lit("x/node_modules/"), i, F.lit(".js"))).when(m == 2, F.concat(F.lit("logs/"), i, F.lit(".log"))).when(
        m == 3, F.concat(F.lit("a/.git/"), i)).when(m == 4, F.concat(F.lit("build/"), i, F.lit("/o.c"))).otherwise(F.concat(F.lit("a/b/"), i, F.lit(".go")))
    content = F.concat(F.when(F.col("page_id") % 5 == 0, F.lit(b"ELF\x00")).otherwise(F.lit(b"")), F.encode(F.coalesce("html", F.lit("")), "UTF-8"))
    return source_tree.kept_files(v.table("pages").select(path.alias("path"), content.alias("content")), ["build/"]).select("path", "hash")


@query("""SELECT 'doc/' || doc_id AS path, 2 AS first, 4 AS last, sha256(CASE WHEN len(l) < 2 THEN '' ELSE array_to_string(l[2:4], chr(10)) || CASE WHEN len(l) > 4 THEN chr(10) ELSE '' END END) AS hash
    FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) UNION ALL SELECT 'doc/' || doc_id, 0, 0, sha256(text) FROM documents""")
def source_hashes(v):
    """Hashes of whole files and of their lines 2 to 4 with their ends."""
    d = v.table("documents").where("text is not null")
    files = d.select(F.concat(F.lit("doc/"), "doc_id").alias("path"), F.encode("text", "UTF-8").alias("content"))
    spans = lambda a, b: files.select("path", F.lit(a).alias("first"), F.lit(b).alias("last"))
    return source_tree.line_hashes(files, spans(2, 4).unionByName(spans(0, 0)))


@query("""SELECT page_id, CASE page_id % 5 WHEN 0 THEN '/root/src/' || page_id WHEN 1 THEN '/abs/' || page_id WHEN 2 THEN '../up/' || page_id WHEN 3 THEN '/root/b/' || page_id ELSE 'a/../../x' END AS path FROM pages""")
def source_paths(v):
    i, m = F.col("page_id").cast("string"), F.col("page_id") % 5
    raw = F.when(m == 0, F.concat(F.lit("./src/"), i)).when(m == 1, F.concat(F.lit("/abs/"), i)).when(m == 2, F.concat(F.lit("../up/"), i)).when(m == 3, F.concat(F.lit("a/../b//"), i)).otherwise("a/../../x")
    return v.table("pages").select("page_id", upkeep.source_path(raw, "/root/").alias("path"))


@query("SELECT id, name FROM (SELECT item_id AS id, 'q' || item_id AS name FROM benchmark) WHERE id % 3 <> 0")
def eval_pending(v):
    """Questions written as JSON lines and loaded; those with a result in the checkpoint are done."""
    path = scratch_path(v.spark, "questions")
    b = v.table("benchmark")
    b.select(F.col("item_id").alias("id"), F.concat(F.lit("q"), "item_id").alias("name")).write.json(path + ".jsonl")
    return evals.pending(evals.load(v.spark, path + ".jsonl", "id bigint, name string"), b.where("item_id % 3 = 0").select(F.col("item_id").alias("id")))


@query("""WITH t AS (SELECT lang AS condition, count(*) AS n, sum(length(text))::BIGINT AS chars FROM documents GROUP BY 1)
    SELECT '{"condition":"' || condition || '","metric":"' || metric || '","value":' || value || '.0}' AS line FROM (SELECT condition, 'chars' AS metric, chars AS value FROM t UNION ALL SELECT condition, 'n', n FROM t)""")
def eval_report(v):
    totals = v.table("documents").groupBy(F.col("lang").alias("condition")).agg(F.count("*").cast("double").alias("n"), F.sum(F.length("text")).cast("bigint").cast("double").alias("chars"))
    lines = totals.unpivot("condition", ["n", "chars"], "metric", "value").withColumn("value", F.col("value").cast("decimal(20,1)"))
    return evals.json_lines(lines)


@query("""SELECT doc_id, (correctness + completeness + specificity) / 3 AS judged FROM (SELECT doc_id, doc_id % 5 + 1.0::DOUBLE AS correctness, doc_id % 3 + 1.0::DOUBLE AS completeness, 2.0::DOUBLE AS specificity FROM documents)""")
def judge_averages(v):
    d = F.col("doc_id")
    scores = v.table("documents").select("doc_id", (d % 5 + 1.0).alias("correctness"), (d % 3 + 1.0).alias("completeness"), F.lit(2.0).alias("specificity"))
    return scores.select("doc_id", evals.judge_average("correctness", "completeness", "specificity").alias("judged"))


@query(r"""SELECT doc_id, left(trim(regexp_extract(t, '^\s*((?s:.)+?[.!?])(?:\s|$)', 1)), 300) AS sentence FROM (SELECT doc_id, 'In ' || lang || ' of ' || source || ' it says ' || repeat('x', doc_id % 400) || '. And ' || n_chars || ' more!' AS t FROM documents)""")
def seed_sentences(v):
    """The sentence that sums up a seeded file."""
    text = F.concat(F.lit("In "), "lang", F.lit(" of "), "source", F.lit(" it says "), F.expr("repeat('x', int(doc_id % 400))"), F.lit(". And "), "n_chars", F.lit(" more!"))
    return v.table("documents").select("doc_id", evals.sentences(text).alias("sentence"))


# Stores


@query("SELECT vec_id, len(embedding)::INT AS dim, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 5) AS total, (4 * len(embedding))::INT AS bytes FROM embeddings")
def blob_codec(v):
    blob = vectors.encode_blob("embedding")
    out = v.table("embeddings").select("vec_id", blob.alias("blob")).select("vec_id", "blob", vectors.decode_blob("blob").alias("back"))
    total = F.aggregate("back", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return out.select("vec_id", F.size("back").alias("dim"), F.round(total, 5).alias("total"), F.octet_length("blob").alias("bytes"))


@query("SELECT 'm' || (label % 2) AS model, true AS has_status, count(*) AS n, (label % 2 <> 0) AS other FROM embeddings GROUP BY label % 2")
def store_open(v):
    """A store opened for reading: whether it has the status column, and its rows by model."""
    e = v.embeddings
    return e.groupBy("model").agg(F.count("*").alias("n")).select("model", F.lit(upkeep.has_status(e)).alias("has_status"), "n", (F.col("model") != "m0").alias("other"))


@query("""SELECT 'doc/' || doc_id AS node_id, CASE WHEN doc_id % 3 = 0 THEN 'kept' ELSE 'm2' END AS model, doc_id % 3 <> 0 AS fresh FROM documents WHERE doc_id % 5 <> 0""")
def reembed_changed(v):
    """Nodes whose text changed are embedded again; the rest keeps its rows."""
    nodes = _doc_nodes(v)
    texts = upkeep.embedding_texts(nodes)
    n = F.substring("node_id", 5, 20).cast("long")
    store = texts.where(n % 3 < 2).select("node_id", F.array(F.lit(0.0).cast("float")).alias("embedding"), F.when(n % 3 == 0, F.col("hash")).otherwise("old").alias("summary_hash"), F.lit("kept").alias("model"),
                                          F.lit("2024-01-01").cast("timestamp").alias("updated_at"), F.lit("active").alias("status"))
    out = upkeep.reembed(nodes, store, lambda t: F.array(F.length(t).cast("float")), "m2", "2024-01-02")
    return out.select("node_id", "model", (F.col("embedding")[0] > 0).alias("fresh"))


@query("SELECT count(*) AS n, 1536 AS dim, count(*) AS unit FROM documents")
def batch_embed(v):
    """The vectors of the hashing embedder, made in batches: of the right length, and of length one."""
    e = v.table("documents").select(vectors.embed_column(F.concat("lang", F.lit(" "), "source"), vectors.make_embedder("mock")).alias("e"))
    norm = F.sqrt(F.aggregate("e", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return e.select(F.size("e").alias("dim"), norm.alias("n")).agg(F.count("*").alias("n"), F.max("dim").alias("dim"), F.count_if(F.abs(F.col("n") - 1) < 1e-5).alias("unit"))


@query("SELECT DISTINCT lang, true AS same FROM documents")
def embedder_fallback(v):
    """A provider that cannot be made falls back to the hashing embedder."""

    def broken():
        raise RuntimeError("no credentials")

    mine, other = vectors.HashEmbedder(), vectors.make_embedder("openai", {"openai": broken})
    both = v.table("documents").select("lang").distinct().select("lang", vectors.embed_column(F.col("lang"), mine).alias("a"), vectors.embed_column(F.col("lang"), other).alias("b"))
    return both.select("lang", (F.col("a") == F.col("b")).alias("same"))


# Texts


@query("""WITH t AS (SELECT doc_id, lang, source, text, strlen(left(text, 6000)) AS b, length(left(text, 6000)) AS m FROM documents),
    c AS (SELECT doc_id, lang, source, strlen(text) > 6000 AS cut, CASE WHEN strlen(text) <= 6000 THEN text ELSE left(text, list_max(list_filter(range(greatest(0, m - (b - 6000)), 6001), lambda k: strlen(left(text, k)) <= 6000))::BIGINT) END AS body FROM t)
    SELECT doc_id, cut, sha256(lang || ' ' || lang || ' ' || source || CASE WHEN body = '' THEN '' ELSE chr(10) || chr(10) || body END) AS digest FROM c""")
def embed_texts(v):
    """The text of every document to embed; the context is cut at 6000 bytes, between characters."""
    text = tx.embed_text("lang", "text", F.array("lang", "source"))
    return v.table("documents").select("doc_id", (F.octet_length("text") > 6000).alias("cut"), F.sha2(text, 256).alias("digest"))


@query("""WITH t AS (SELECT doc_id, text, strlen(left(text, 2000)) AS b, length(left(text, 2000)) AS m FROM documents)
    SELECT 'doc/' || doc_id AS id, sha256(CASE WHEN strlen(text) <= 2000 THEN text ELSE left(text, list_max(list_filter(range(greatest(0, m - (b - 2000)), 2001), lambda k: strlen(left(text, k)) <= 2000))::BIGINT) || chr(10) || '... (context truncated)' END) AS digest,
        1 AS edges FROM t""")
def client_nodes(v):
    """Nodes as the client shows them."""
    nodes = _doc_nodes(v)
    return graph.to_client(nodes, graph.edges_of(nodes)).select("id", F.sha2("context", 256).alias("digest"), F.size("edges").alias("edges"))


@query("""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'n/' || page_id ELSE '@v' || (page_id % 3) || '/n/' || page_id END AS name, '@' || CASE WHEN page_id % 2 = 0 THEN 'w' ELSE 'here' END || '/t' AS target,
    page_id % 4 < 2 AS nested, 'a' || (page_id % 7) || '--b' AS key FROM pages""")
def id_forms(v):
    """Qualified ids, targets rewritten for their vault, ids below ids, keys of bridges."""
    i = F.col("page_id")
    name = tx.qualified(F.when(i % 3 == 0, "").otherwise(F.concat(F.lit("v"), i % 3)), F.concat(F.lit("n/"), i))
    target = tx.rewrite_target(F.when(i % 2 == 0, "@w/t").otherwise("t"), F.lit("here"))
    a, b = F.concat(F.lit("x/"), i), F.when(i % 4 == 0, F.concat(F.lit("x/"), i, F.lit("/y"))).when(i % 4 == 1, "x").when(i % 4 == 2, F.concat(F.lit("x/"), i, F.lit("y"))).otherwise("z")
    return v.table("pages").select("page_id", name.alias("name"), target.alias("target"), tx.hierarchical(a, b).alias("nested"), tx.bridge_key(F.lit("b"), F.concat(F.lit("a"), i % 7)).alias("key"))


@query("""SELECT page_id, page_id % 5 IN (0, 1, 2) AS by_key, page_id % 3 = 0 AS by_value FROM pages""")
def secret_rules(v):
    m, n = F.col("page_id") % 5, F.col("page_id") % 3
    key = F.when(m == 0, "OPENAI_API_KEY").when(m == 1, "client_secret").when(m == 2, "refresh_token").when(m == 3, "token_budget").otherwise("namespace")
    value = F.when(n == 0, F.concat(F.lit("sk-"), F.lpad("page_id", 20, "0"))).when(n == 1, "sk-short").otherwise(F.lpad("page_id", 30, "0"))
    return v.table("pages").select("page_id", tx.secret_key(key).alias("by_key"), tx.secret_value(value).alias("by_value"))


@query("""SELECT p_partkey, CASE WHEN p_size BETWEEN 0 AND 10 THEN p_size ELSE 2 END::INT AS depth, CASE WHEN x <= 0 THEN 4096 WHEN x > 100000 THEN 100000 ELSE x END::INT AS budget,
    CASE WHEN y BETWEEN 1 AND 100 THEN y ELSE 10 END::INT AS search, CASE WHEN y BETWEEN 1 AND 200 THEN y ELSE 20 END::INT AS suggest, greatest(1, least(5, p_size))::INT AS hops
    FROM (SELECT *, (p_size - 5) * 5000 AS x, (p_size - 3) * 10 AS y FROM part)""")
def clamped_arguments(v):
    @F.pandas_udf("struct<depth:int,budget:int,search:int,suggest:int,hops:int>")
    def clamped(size: pd.Series) -> pd.DataFrame:
        rows = [(clamp_depth(n), clamp_budget((n - 5) * 5000), clamp_limit((n - 3) * 10), clamp_limit((n - 3) * 10, "suggestions"), clamp_neighbors(n)) for n in size.tolist()]
        return pd.DataFrame(rows, columns=["depth", "budget", "search", "suggest", "hops"])

    return v.table("part").select("p_partkey", clamped("p_size").alias("x")).select("p_partkey", "x.*")


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'unknown argument ''sumary''; did you mean ''summary''?' WHEN 2 THEN 'unknown argument ''tag''; did you mean ''tags''?' ELSE 'unknown argument ''zzz''' END AS problem FROM pages""")
def write_arguments(v):
    def said(name: str) -> str:
        try:
            upkeep.check_args({"id": 1, name: 2})
        except ValueError as e:
            return str(e)
        return ""

    @F.pandas_udf("string")
    def checked(names: pd.Series) -> pd.Series:
        return names.map(said)

    m = F.col("page_id") % 4
    return v.table("pages").select("page_id", checked(F.when(m == 0, "summary").when(m == 1, "sumary").when(m == 2, "tag").otherwise("zzz")).alias("problem"))


@query("""SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 4 ELSE 3 END::INT AS words, CASE WHEN turn % 2 = 0 THEN 'a b ' || role ELSE role END AS last FROM conversations""")
def command_words(v):
    @F.pandas_udf("array<string>")
    def words(lines: pd.Series) -> pd.Series:
        return lines.map(mutations.tokenize)

    line = F.when(F.col("turn") % 2 == 0, F.concat(F.lit('/link x  y "a b '), "role", F.lit('"'))).otherwise(F.concat(F.lit("/tag x "), "role"))
    out = v.table("conversations").select("conv_id", "turn", words(line).alias("w"))
    return out.select("conv_id", "turn", F.size("w").alias("words"), F.element_at("w", -1).alias("last"))


@query("SELECT CASE WHEN source = 'src1' THEN 'default' ELSE source END AS namespace, count(*) AS n FROM documents GROUP BY 1")
def namespace_match(v):
    d = v.table("documents").select(F.when(F.col("source") == "src1", "").otherwise(F.col("source")).alias("namespace"))
    return d.groupBy(normal_namespace().alias("namespace")).agg(F.count("*").alias("n"))


@query("""SELECT 'doc/' || doc_id AS id, CASE WHEN doc_id % 10 = 0 THEN '' ELSE sha256(text) END AS current_hash FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 2 <> 0""")
def changed_sources(v):
    """Active nodes whose source hash is out of date."""
    return integrity.changed(_doc_nodes(v), doc_files(v))
