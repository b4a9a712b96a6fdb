"""Registered queries over joins by distance, components and levels, keyed streams, the vault source and undo logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators import containment, graph, heat, metric, retrieval, scc, undo, versions
from graphloom.plans.catalog import _doc_nodes, _scored, query
from graphloom.plans.views import text_of as s
from graphloom.schema import is_active
from graphloom.sources import datasource
from graphloom.storage import materialize, scratch_path
from graphloom.streaming import stateful

LINKED = 0.47  # of vectors without clusters a few hundred pairs are as close

# A graph with cycles (some customers lead back to their nation) and long paths (the orders of a customer one after another).
_CHAINED = """WITH RECURSIVE base AS (SELECT DISTINCT src, dst FROM (
        SELECT 'region/' || n_regionkey AS src, 'nation/' || n_nationkey AS dst FROM nation
        UNION ALL SELECT 'nation/' || c_nationkey, 'customer/' || c_custkey FROM customer
        UNION ALL SELECT 'customer/' || c_custkey, 'nation/' || c_nationkey FROM customer WHERE c_custkey % 50 = 3
        UNION ALL SELECT 'customer/' || o_custkey, 'orders/' || min(o_orderkey) FROM orders GROUP BY o_custkey
        UNION ALL SELECT 'orders/' || o_orderkey, 'orders/' || lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) FROM orders) WHERE dst IS NOT NULL),
    reach AS (SELECT src AS root, dst AS id FROM base UNION SELECT root, base.dst FROM reach JOIN base ON base.src = reach.id)"""


def _chained(v) -> DataFrame:
    key = lambda kind, c: F.concat(F.lit(f"{kind}/"), c)
    orders = v.table("orders")
    later = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    parts = [
        v.table("nation").select(key("region", "n_regionkey").alias("src"), key("nation", "n_nationkey").alias("dst")),
        v.table("customer").select(key("nation", "c_nationkey"), key("customer", "c_custkey")),
        v.table("customer").where("c_custkey % 50 = 3").select(key("customer", "c_custkey"), key("nation", "c_nationkey")),
        orders.groupBy("o_custkey").agg(F.min("o_orderkey").alias("o")).select(key("customer", "o_custkey"), key("orders", "o")),
        orders.select(key("orders", "o_orderkey"), key("orders", later)).toDF("a", "b").where("b IS NOT NULL"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@query(_CHAINED + """, mutual AS MATERIALIZED (SELECT a.root, a.id FROM reach a JOIN reach b ON a.root = b.id AND a.id = b.root),
    ids AS MATERIALIZED (SELECT src AS id FROM base UNION SELECT dst FROM base),
    own AS MATERIALIZED (SELECT ids.id, least(ids.id, min(mutual.id)) AS scc FROM ids LEFT JOIN mutual ON mutual.root = ids.id GROUP BY ids.id),
    near AS MATERIALIZED (SELECT own.scc AS a, base.dst FROM base JOIN own ON own.id = base.src),
    cond AS MATERIALIZED (SELECT DISTINCT near.a, own.scc AS b FROM near JOIN own ON own.id = near.dst WHERE near.a <> own.scc),
    lev AS (SELECT DISTINCT scc AS id, 0 AS level FROM own UNION SELECT cond.b, level + 1 FROM lev JOIN cond ON cond.a = lev.id)
    SELECT own.id, own.scc, max(lev.level)::BIGINT AS level FROM own JOIN lev ON lev.id = own.scc GROUP BY ALL""")
def scc_levels(v):
    """Strongly connected components and their topological levels."""
    return scc.condense(_chained(v)).nodes.select("id", "scc", "level")


@query(_CHAINED + """, c AS (SELECT 'orders/' || o_orderkey AS src, 'customer/' || (o_orderkey % (SELECT max(c_custkey) FROM customer) + 1) AS dst FROM orders
        UNION ALL SELECT 'orders/' || o_orderkey, 'customer/' || o_custkey FROM orders)
    SELECT c.src, c.dst, r.id IS NOT NULL AS cycle FROM c LEFT JOIN reach r ON r.root = c.dst AND r.id = c.src""")
def cycle_batch(v):
    """Two candidate edges for every order: to its own customer, and to another one."""
    last = v.table("customer").agg(F.max("c_custkey").alias("last"))
    name = lambda c: F.concat(F.lit("customer/"), c)
    orders = v.table("orders").select(F.concat(F.lit("orders/"), "o_orderkey").alias("src"), "o_orderkey", "o_custkey").join(F.broadcast(last))
    candidates = orders.select("src", name(F.col("o_orderkey") % F.col("last") + 1).alias("dst")).unionByName(orders.select("src", name("o_custkey").alias("dst")))
    return graph.would_cycle(_chained(v).withColumn("relation", F.lit("contains")), candidates)


@query(f"""WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
    near AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a, v b WHERE a.vec_id <> b.vec_id AND 1 / (1 + list_distance(a.e, b.e)) >= {LINKED}),
    reach AS (SELECT vec_id AS root, vec_id AS id FROM v UNION SELECT root, near.b FROM reach JOIN near ON near.a = reach.id)
    SELECT v.vec_id AS id, (SELECT count(*) FROM near WHERE near.a = v.vec_id) AS n_links, (SELECT min(reach.id) FROM reach WHERE reach.root = v.vec_id) AS class_id FROM v""")
def vector_links(v):
    """All vectors with all: how many are alike, and the class of each."""
    return metric.links(v.table("embeddings"), LINKED)


@query(f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)
    SELECT a.vec_id AS query_id, 'vec/' || b.vec_id AS node_id, round(1 / (1 + list_distance(a.e, b.e)), 6) AS score,
        row_number() OVER (PARTITION BY a.vec_id ORDER BY 1 / (1 + list_distance(a.e, b.e)) DESC, 'vec/' || b.vec_id)::INT AS rank
    FROM v a, v b WHERE a.vec_id % 50 = 0 AND 1 / (1 + list_distance(a.e, b.e)) >= {LINKED}""")
def vector_range(v):
    """All vectors within a distance of every fiftieth."""
    return _scored(metric.neighbours(v.embeddings, v.vectors(50), LINKED))


@query("""WITH e AS (SELECT vec_id, 'vec/' || vec_id AS node_id, label, 'v' || (label % 3) AS vault, CASE WHEN label % 3 = 2 THEN embedding[:32] ELSE embedding END::DOUBLE[] AS v FROM embeddings),
    q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 = 0 UNION ALL SELECT vec_id, embedding[:32]::DOUBLE[] FROM embeddings WHERE vec_id % 50 = 0),
    d AS (SELECT query_id, node_id, vault, 1 / (1 + list_distance(q.v, e.v)) AS s FROM q JOIN e ON len(q.v) = len(e.v) WHERE label <> 9),
    g AS (SELECT *, row_number() OVER (PARTITION BY query_id, vault ORDER BY s DESC, node_id) AS r FROM d),
    h AS (SELECT query_id, CASE WHEN vault = 'v0' THEN node_id ELSE '@' || vault || '/' || node_id END AS node_id, s FROM g WHERE r <= CASE WHEN vault = 'v0' THEN 5 ELSE 3 END)
    SELECT query_id, node_id, round(s, 6) AS score, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, node_id)::INT AS r FROM h) WHERE r <= 10""")
def federated_models(v):
    """Vaults of two models and two dimensions, each asked with a vector of its own model."""
    small = F.col("label") % 3 == 2
    store = v.embeddings.withColumns({"model": F.when(small, "half").otherwise("full"), "embedding": F.when(small, F.slice("embedding", 1, 32)).otherwise(F.col("embedding"))})
    q = v.vectors(50)
    both = q.select("query_id", F.lit("full").alias("model"), "embedding").unionByName(q.select("query_id", F.lit("half").alias("model"), F.slice("embedding", 1, 32).alias("embedding")))
    return _scored(retrieval.federated(store, both, "v0")).select("query_id", "node_id", "score", "rank")


# Streams


def _in_files(rows: DataFrame, column: str, parts: int = 4) -> str:
    """A folder that holds the rows in files, one after another in the order of a column: one micro-batch each."""
    path = scratch_path(rows.sparkSession, "batches")
    low, high = rows.agg(F.min(column), F.max(column)).first()
    step = (high - low) / parts
    for k in range(parts):
        some = rows.where((F.col(column) >= low + k * step) & (F.lit(k == parts - 1) | (F.col(column) < low + (k + 1) * step)))
        some.coalesce(1).write.mode("append").parquet(f"{path}/part={k}")
    return path


def _stream(spark, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


@query("""WITH RECURSIVE e AS (SELECT user_id, epoch(ts) AS t0, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
    b AS (SELECT user_id, k, t0 AS first FROM e WHERE k = 1 UNION ALL SELECT e.user_id, e.k, CASE WHEN e.t0 <= b.first + 86400 THEN b.first ELSE e.t0 END FROM b JOIN e ON e.user_id = b.user_id AND e.k = b.k + 1)
    SELECT 'u' || user_id AS path, first, count(*) AS events FROM b GROUP BY ALL""")
def burst_stream(v):
    """Bursts of a user's events, from a stream of several micro-batches with a timer for each user."""
    events = v.table("events").select(F.concat(F.lit("u"), "user_id").alias("path"), F.col("ts").cast("timestamp").alias("at"), F.unix_micros(F.col("ts").cast("timestamp")).alias("m"))
    path, schema = _in_files(events, "m"), "path string, at timestamp, m bigint"
    # an end mark lets the watermark pass the last bursts; its own stays open
    v.spark.sql("SELECT '' AS path, timestamp'2100-01-01' AS at, 0L AS m").coalesce(1).write.parquet(f"{path}/part=end")
    out = scratch_path(v.spark, "bursts")
    stateful.start(stateful.bursts(_stream(v.spark, path, schema), 86_400), out, scratch_path(v.spark, "ckpt")).awaitTermination()
    found = v.spark.read.schema("path string, first timestamp, events bigint").parquet(out)
    return found.select("path", (F.unix_micros("first") / 1e6).alias("first"), "events")


@query("""WITH RECURSIVE a AS (SELECT DISTINCT user_id::VARCHAR || '@' || ts::DATE::VARCHAR AS q, ts::DATE AS day, event_type AS n FROM events),
    p AS (SELECT x.n AS a, y.n AS b, (x.day - (SELECT min(day) FROM a))::BIGINT AS round, count(*) AS n FROM a x JOIN a y ON x.q = y.q AND x.n < y.n GROUP BY ALL),
    k AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY round) AS k FROM p),
    f AS (SELECT a, b, k, round, 1 - pow(0.9, n) AS w, n AS hits FROM k WHERE k = 1
        UNION ALL SELECT k.a, k.b, k.k, k.round, 1 - (1 - greatest(0.05, f.w * pow(0.95, k.round - f.round))) * pow(0.9, k.n), f.hits + k.n FROM f JOIN k ON k.a = f.a AND k.b = f.b AND k.k = f.k + 1),
    last AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY k DESC) = 1), top AS (SELECT max(round) + 5 AS top FROM p)
    SELECT a, b, hits::BIGINT AS hits, round(greatest(0.05, w * pow(0.95, top - round)), 6) AS weight FROM last, top""")
def heat_rounds(v):
    """Co-access weights as keyed state, with a round of decay each day; asked five days after the last."""
    day = F.to_date(F.split("query_id", "@")[1])
    pairs = heat.pairs(v.access).withColumn("day", day)
    first = pairs.sparkSession.createDataFrame([tuple(v.access.agg(F.min(day), F.max(day)).first())], "low date, high date")
    rows = pairs.join(F.broadcast(first)).select(F.lit("").alias("namespace"), "a", "b", F.datediff("day", "low").cast("bigint").alias("round"))
    rows = materialize(rows, "heat-rounds")
    out = scratch_path(v.spark, "heat-changes")
    stream = _stream(v.spark, _in_files(rows, "round", 3), rows.schema)
    stateful.start(stateful.heat_changes(stream), out, scratch_path(v.spark, "ckpt")).awaitTermination()
    top = rows.agg(F.max("round")).first()[0]
    now = stateful.heat_at(v.spark.read.schema(stateful.HEAT).parquet(out), top + 5)
    return now.select("a", "b", "hits", F.round("weight", 6).alias("weight"))


# Files and logs


@query("""SELECT 'doc/' || doc_id AS id, lang AS type, source AS namespace, CASE WHEN doc_id % 4 = 0 THEN '' ELSE lang END AS summary, 'of ' || source AS context, lang || ',kept' AS tags
    FROM documents WHERE doc_id % 5 <> 0 AND lang IN ('en', 'fr')""")
def vault_source(v):
    """Every document as a node file, written and read by tasks; status and type are filtered in the files."""
    nodes = _doc_nodes(v).withColumns({"valid_from": s(""), "valid_until": s(""), "context": F.concat(F.lit("of "), "namespace"), "tags": F.array("type", F.lit("kept"))})
    path = scratch_path(v.spark, "vault")
    datasource.write(nodes, path)
    got = datasource.read(v.spark, path).where("status = 'active' AND type IN ('en', 'fr')")
    return got.where(is_active()).select("id", "type", "namespace", "summary", "context", F.array_join("tags", ",").alias("tags"))


_UNDO = """WITH RECURSIVE t AS (SELECT conv_id AS session, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS seq FROM conversations),
    log AS (SELECT session, seq, CASE WHEN seq % 5 = 3 THEN 'pop' WHEN seq % 7 = 4 THEN 'pop_id' WHEN seq % 7 = 6 THEN 'pop_latest' ELSE 'push' END AS op FROM t),
    e AS (SELECT session, seq, op, CASE op WHEN 'push' THEN 'e' || seq WHEN 'pop_id' THEN 'e' || (seq - 2) WHEN 'pop_latest' THEN 'e' || (seq - 1) END AS entry FROM log),
    r AS (SELECT session, 0::BIGINT AS seq, NULL::VARCHAR AS op, NULL::VARCHAR AS entry, NULL::VARCHAR AS found, false AS refused, []::VARCHAR[] AS stack FROM (SELECT DISTINCT session FROM e)
        UNION ALL SELECT e.session, e.seq, e.op, e.entry,
            CASE WHEN e.op = 'pop' THEN r.stack[-1] WHEN e.op = 'pop_id' AND list_contains(r.stack, e.entry) THEN e.entry WHEN e.op = 'pop_latest' AND r.stack[-1] = e.entry THEN e.entry END,
            e.op = 'pop_latest' AND len(r.stack) > 0 AND r.stack[-1] <> e.entry,
            CASE WHEN e.op = 'push' THEN list_append(r.stack, e.entry)[-3:] WHEN e.op = 'pop' OR e.op = 'pop_latest' AND r.stack[-1] = e.entry THEN r.stack[:-2]
                WHEN e.op = 'pop_id' THEN list_filter(r.stack, lambda x: x <> e.entry) ELSE r.stack END
        FROM r JOIN e ON e.session = r.session AND e.seq = r.seq + 1)"""


@query(_UNDO + " SELECT session::VARCHAR AS session, seq, op, entry, found, refused FROM r WHERE op <> 'push'")
def undo_replay(v):
    """The turns of conversations as an undo log, replayed on stacks of at most three entries."""
    seq = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("bigint")
    log = v.table("conversations").select(F.col("conv_id").alias("session"), seq.alias("seq"))
    op = F.when(F.col("seq") % 5 == 3, "pop").when(F.col("seq") % 7 == 4, "pop_id").when(F.col("seq") % 7 == 6, "pop_latest").otherwise("push")
    back = F.when(op == "push", F.col("seq")).when(op == "pop_id", F.col("seq") - 2).when(op == "pop_latest", F.col("seq") - 1)
    results, _ = undo.replay(log.withColumns({"op": op, "entry": F.concat(F.lit("e"), back)}), 3)
    return results


@query("""WITH c AS (SELECT c_custkey AS k FROM customer)
    SELECT 1 AS version, 'customer/' || k AS id, k AS n FROM c
    UNION ALL SELECT 2, 'customer/' || k, CASE WHEN k % 3 = 0 THEN -k ELSE k END FROM c WHERE k % 3 = 0 OR k % 10 <> 0
    UNION ALL SELECT 3, 'customer/' || k, CASE WHEN k % 3 = 0 THEN -k WHEN k % 7 = 1 THEN k + 1000000 ELSE k END FROM c WHERE k % 3 = 0 OR k % 10 <> 0
    UNION ALL SELECT 4, 'customer/' || k, CASE WHEN k % 7 = 1 AND k % 3 <> 0 AND k % 10 <> 0 THEN k + 1000000 ELSE k END FROM c""")
def versioned_edits(v):
    """A table of all customers, changed by two writers at once, of whom one is refused at first, and a revert."""
    table = versions.VersionedTable(v.spark, scratch_path(v.spark, "versions"), "id string, n bigint")
    k = F.col("c_custkey")
    row = lambda rule, n: v.table("customer").where(rule).select(F.concat(F.lit("customer/"), k).alias("id"), n.alias("n"))
    table.commit(row("true", k))
    table.commit(row("c_custkey % 3 = 0", -k), row("c_custkey % 10 = 0", k))
    try:
        table.commit(row("c_custkey % 6 = 0", k), base=1)
    except versions.Conflict:
        table.commit(row("c_custkey % 7 = 1 AND c_custkey % 3 <> 0 AND c_custkey % 10 <> 0", k + 1_000_000), base=1)
    table.revert(2)
    out = None
    for version in range(1, 5):
        part = table.read(version).select(F.lit(version).alias("version"), "id", "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("""WITH m AS (SELECT c_nationkey AS nation, c_custkey, l_orderkey, 'm' || (l_partkey % 200) AS method FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey),
    t AS (SELECT nation, c_custkey, list(DISTINCT method) AS has FROM m GROUP BY ALL), i AS (SELECT nation, l_orderkey, list(DISTINCT method) AS wants FROM m GROUP BY ALL)
    SELECT 'type/' || c_custkey AS src, 'interface/' || l_orderkey AS dst, 'implements' AS relation FROM i JOIN t ON t.nation = i.nation WHERE list_has_all(t.has, i.wants)""")
def interface_edges(v):
    """Interfaces and types of a package by their methods: an order's parts, and all that a customer ordered."""
    owners = v.table("orders").join(v.table("customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_custkey", "c_nationkey")
    lines = v.table("lineitem").select("l_orderkey", (F.col("l_partkey") % 200).alias("part")).join(owners, F.col("l_orderkey") == F.col("o_orderkey"))
    lines = materialize(lines.select("c_nationkey", "c_custkey", "l_orderkey", "part"), "lines")
    method = F.concat(F.lit("m"), "part")
    part = lambda kind, c: lines.select(F.col("c_nationkey").alias("package"), F.concat(F.lit(kind), c).alias("id"), method.alias("method"))
    return containment.implements(part("interface/", "l_orderkey"), part("type/", "c_custkey"))
