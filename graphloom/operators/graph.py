"""Typed directed multigraphs as DataFrames of nodes and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators import scc
from graphloom.operators.components import contracted_components, ends
from graphloom.schema import LIST_CAP, STRUCTURAL_RELATIONS, blank, edge_class, is_active
from graphloom.storage import broadcast_if_small, discard, materialize

NEAR_BYTES = 2 << 20  # files of ids that are sent to a scan
HEADS = 1_024  # first segments of ids that are told apart
FEW_ROOTS = 63  # vertices that are searched from by themselves
PEELED, PATIENCE = 0.1, 8  # of a layer's edges; layers that take a smaller share before components are looked for


def edges_of(nodes: DataFrame) -> DataFrame:
    """(src, dst, relation, class, ord): one row per entry of the nodes' edge lists."""
    out = nodes.select(F.col("id").alias("src"), F.posexplode("edges").alias("ord", "e"))
    return out.select("src", F.col("e.target").alias("dst"), F.col("e.relation").alias("relation"), edge_class(F.col("e.relation")).alias("class"), "ord")


def active(nodes: DataFrame) -> DataFrame:
    return nodes.where(is_active())


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key: the first in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def near(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``table`` whose ``key`` is among ``ids`` (a written table with that one column, or ``id``). Few
    ids are sent to the scan as a semi join, which the planner moves below unions and projections."""
    ids = ids.toDF(key)
    return table.join(broadcast_if_small(ids, size=NEAR_BYTES), key, "left_semi")


def adjacent(edges: DataFrame, ids: DataFrame, direction: str = "out") -> DataFrame:
    """Edges that leave (out), enter (in) or touch (both) the given ids."""
    parts = []
    if direction in ("out", "both"):
        parts.append(edges.join(ids.select(F.col("id").alias("src")).distinct(), "src", "left_semi"))
    if direction in ("in", "both"):
        parts.append(edges.join(ids.select(F.col("id").alias("dst")).distinct(), "dst", "left_semi").select(edges.columns))
    out = parts[0].select(edges.columns)
    return out.unionByName(parts[1]).distinct() if len(parts) > 1 else out


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, out_degree, in_degree, degree); repeated and dangling edges count."""
    ends = edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(
        edges.select(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i"))
    )
    sums = ends.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
    out = nodes.select("id").join(sums, "id", "left").fillna(0, ["out_degree", "in_degree"])
    return out.withColumn("degree", F.col("out_degree") + F.col("in_degree"))


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that no edge leaves or enters."""
    return nodes.join(ends(edges).distinct(), "id", "left_anti")  # an id once for each task


def dangling(edges: DataFrame, known: DataFrame) -> DataFrame:
    """Edges to ids that are not known; targets in other vaults cannot be judged."""
    local = edges.where(~F.col("dst").startswith("@"))
    # targets are judged once each, and edges stay where they are if few are missing
    missing = local.select("dst").distinct().join(known.select(F.col("id").alias("dst")), "dst", "left_anti")
    return local.join(broadcast_if_small(materialize(missing, "missing")), "dst", "left_semi").select(edges.columns)


def within(edges: DataFrame, view: DataFrame) -> DataFrame:
    """Edges with both ends in the view."""
    ids = view.select("id")
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(
        ids.withColumnRenamed("id", "dst"), "dst", "left_semi"
    ).select(edges.columns)


def _head(column: str) -> Column:
    return F.substring_index(column, "/", 1)


def below(edges: DataFrame, ids: DataFrame, *columns: str) -> DataFrame:
    """Edges with ends below first segments that ids (id) have, for a join with the ids: the others cannot meet them.
    The segments reach the scan as a condition, unless there are many."""
    heads = [r[0] for r in ids.where("id IS NOT NULL").select(_head("id")).distinct().limit(HEADS + 1).collect()]
    for c in columns if len(heads) <= HEADS else ():
        edges = edges.where(_head(c).isin(heads))
    return edges


def attach(edges: DataFrame, nodes: DataFrame, column: str, value: str, name: str, ends: DataFrame | None = None, how: str = "inner") -> DataFrame:
    """Edges with the ``value`` of the node (id, value; ids are unique) at ``column`` as ``name``; how: inner or left.

    Where all nodes below a first segment have one value and none is missing, the segment says it and edges are not
    shuffled; what is missing is asked once for each id. ``ends`` is a table of the same edges, repeats allowed, that costs less to read."""
    own, ends = nodes.select("id", F.col(value).alias(name)), edges if ends is None else ends
    same = own.where("id IS NOT NULL").groupBy(_head("id").alias("_head")).agg(F.min(name).alias("lo"), F.max(name).alias("hi"), (F.count(name) == F.count("*")).alias("full"))
    heads = same.limit(HEADS + 1).collect()
    sure = {r["_head"]: r["lo"] for r in heads if r["full"] and r["lo"] == r["hi"]} if len(heads) <= HEADS else {}
    joined = lambda e: e.join(own.withColumnRenamed("id", column), column, how).select(*edges.columns, name)
    if sure:
        asked = ends.where(_head(column).isin(list(sure))).select(F.col(column).alias("id")).distinct()
        for r in asked.join(own, "id", "left_anti").select(_head("id")).distinct().collect():
            del sure[r[0]]
    if not sure:
        return joined(edges)
    decided = F.coalesce(_head(column).isin(list(sure)), F.lit(False))
    told = edges.sparkSession.createDataFrame(list(sure.items()), f"_head string, {name} {own.schema[name].dataType.simpleString()}")
    out = edges.where(decided).withColumn("_head", _head(column)).join(F.broadcast(told), "_head").select(*edges.columns, name)
    return out if ends.where(~decided).select(column).isEmpty() else out.unionByName(joined(edges.where(~decided)))


def _steps(edges: DataFrame, direction: str) -> DataFrame:
    out = edges.select("src", "dst")
    if direction == "in":
        return out.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    if direction == "both":
        return out.unionAll(out.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return out


def bfs(edges: DataFrame, seeds: DataFrame, depth: int | None, direction: str = "out", by: list[str] | None = None) -> DataFrame:
    """(by..., id, depth) of all ids within ``depth`` steps of the seeds (any number if None).

    Seeds have ``id`` and, for many searches at once, the columns ``by``. Each level joins the
    frontier with the edges, drops what was visited and is written out, so that lineage stays
    flat; the loop ends with an empty frontier."""
    by = by or []
    steps = _steps(edges, direction)
    front = materialize(seeds.select(*by, "id").distinct().withColumn("depth", F.lit(0)), "bfs")
    seen, level = front, 0
    while depth is None or level < depth:
        level += 1
        step = front.select(*by, F.col("id").alias("src")).join(near(steps, front.select("id"), "src"), "src")
        step = step.select(*by, F.col("dst").alias("id")).distinct().join(seen, [*by, "id"], "left_anti")
        front = materialize(step.withColumn("depth", F.lit(level)), "bfs")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def neighbors(nodes: DataFrame, edges: DataFrame, start: str, depth: int) -> DataFrame:
    """Existing nodes within ``depth`` out-steps, without the start; missing ones are walked through."""
    spark = nodes.sparkSession
    found = bfs(edges, spark.createDataFrame([(start,)], "id string"), depth).where(F.col("id") != start)
    return nodes.join(found, "id")


def neighbors_both(nodes: DataFrame, edges: DataFrame, start: str, depth: int, cap: int = LIST_CAP) -> DataFrame:
    """Nodes within ``depth`` steps in either direction, at most ``cap``, nearest first."""
    spark = nodes.sparkSession
    found = bfs(edges, spark.createDataFrame([(start,)], "id string"), depth, "both").where(F.col("id") != start)
    return capped(nodes.select("id").join(found, "id").orderBy("depth", "id"), cap)


def capped(df: DataFrame, cap: int = LIST_CAP, column: str = "id") -> DataFrame:
    """At most ``cap`` rows, and one more that says so where there were more."""
    if df.limit(cap + 1).count() <= cap:
        return df
    mark = df.sparkSession.createDataFrame([(f"... truncated at {cap}",)], f"{column} string")
    return df.limit(cap).unionByName(mark, allowMissingColumns=True)


def highlight(edges: DataFrame, id_: str) -> DataFrame:
    """Ids one step away, in either direction."""
    out = edges.where(F.col("src") == id_).select(F.col("dst").alias("id"))
    return out.union(edges.where(F.col("dst") == id_).select(F.col("src").alias("id"))).distinct()


def inbound_sources(edges: DataFrame, id_: str) -> DataFrame:
    return edges.where(F.col("dst") == id_).select(F.col("src").alias("id")).distinct()


def would_cycle(edges: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates (src, dst) with ``cycle``: whether structural edges lead from dst back to src.

    Where few vertices stand on one side, one search from them answers all. Otherwise components, paths and levels of
    the structural graph answer most candidates, and the rest is searched for together."""
    structural = edges.where(F.col("relation").isin(*STRUCTURAL_RELATIONS))
    pairs = materialize(candidates.select("src", "dst").distinct(), "cycle-pairs")
    ends = {c: pairs.select(c).distinct().limit(FEW_ROOTS + 1).count() for c in ("dst", "src")}
    root, goal, way = ("dst", "src", "out") if ends["dst"] <= ends["src"] else ("src", "dst", "in")
    if ends[root] <= FEW_ROOTS:
        reach = bfs(structural, pairs.select(F.col(root).alias("id"), F.col(root).alias("root")), None, way, ["root"])
        found = pairs.join(reach.select(F.col("root").alias(root), F.col("id").alias(goal)), ["src", "dst"]).withColumn("cycle", F.lit(True))
    else:
        found = scc.reaches(scc.condense(structural), pairs.select(F.col("dst").alias("a"), F.col("src").alias("b")))
        found = found.select(F.col("b").alias("src"), F.col("a").alias("dst"), F.col("reached").alias("cycle"))
    return candidates.join(found, ["src", "dst"], "left").withColumn("cycle", F.coalesce("cycle", F.lit(False)))


def cycle_residual(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Ids left when nodes without structural in-edges are peeled off again and again: the members
    of cycles and everything downstream of them. Edges to unknown nodes are ignored.

    Layers are peeled, with patience for a few that take only a small share of the edges; what is left by then (long
    paths) is solved by components, so that rounds do not follow the longest path."""
    live = materialize(within(edges.where(F.col("relation").isin(*STRUCTURAL_RELATIONS)), nodes).select("src", "dst").distinct(), "kahn")
    n, patience = live.count(), PATIENCE
    while n:
        before, live = live, materialize(live.join(live.select(F.col("dst").alias("src")).distinct(), "src", "left_semi"), "kahn")
        discard(before)
        m = live.count()
        if m == n:
            return live.select(F.col("dst").alias("id")).distinct()
        patience -= n - m < PEELED * n
        n = m
        if not patience:
            break
    if not n:
        return live.select(F.col("dst").alias("id"))
    graph = scc.condense(live)
    large = graph.nodes.groupBy("scc").count().where("count > 1").select("scc")
    looped = live.where("src = dst").select(F.col("src").alias("id"))
    rings = materialize(graph.nodes.join(large, "scc", "left_semi").select("id").unionByName(looped).distinct(), "kahn-rings")
    return scc.downstream(graph, rings).unionByName(looped).distinct()


def component_sizes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component, size) over undirected edges inside the node set; lone nodes are components.

    Ends that are no nodes are looked for among the vertices, which are fewer than edges; only if there are any is it done again without their edges."""
    ends, own = edges.select("src", "dst"), nodes.select("id", F.lit(True).alias("known"))
    out = materialize(own.join(contracted_components(ends), "id", "full_outer"), "components")
    missing = materialize(out.where("known IS NULL").select("id"), "missing")
    if not missing.isEmpty():
        for c in ("src", "dst"):
            ends = ends.join(broadcast_if_small(missing.toDF(c)), c, "left_anti")
        out = materialize(own.join(contracted_components(ends), "id", "left"), "components")
    out = out.select("id", F.coalesce("component", "id").alias("component")).where("component IS NOT NULL")
    sizes = materialize(out.groupBy("component").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
    return out.join(broadcast_if_small(sizes), "component", "left").select("id", "component", F.coalesce("size", F.lit(1).cast("bigint")).alias("size"))


# Changes give new tables; nothing is updated in place.


def upsert(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """New rows replace those with their id, with their edge lists; edges of others stay."""
    return nodes.join(new.select("id"), "id", "left_anti").select(nodes.columns).unionByName(new.select(nodes.columns))


def insert(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """Like upsert, but an id that exists (or comes twice) is an error."""
    clash = nodes.select("id").unionAll(new.select("id")).join(new.select("id").distinct(), "id", "left_semi").groupBy("id").count().where("count > 1")
    if bad := clash.limit(1).collect():
        raise ValueError(f"node {bad[0]['id']!r} exists")
    return nodes.unionByName(new.select(nodes.columns))


def remove(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without the ids and what touches them."""
    kept = edges.join(ids.select(F.col("id").alias("src")), "src", "left_anti").join(ids.select(F.col("id").alias("dst")), "dst", "left_anti")
    return nodes.join(ids.select("id"), "id", "left_anti"), kept.select(edges.columns)


def add_edge(edges: DataFrame, src: str, dst: str, relation: str) -> DataFrame:
    """A structural edge that would close a cycle is an error."""
    spark = edges.sparkSession
    if relation in STRUCTURAL_RELATIONS:
        if src == dst or would_cycle(edges, spark.createDataFrame([(src, dst)], "src string, dst string")).first()["cycle"]:
            raise ValueError(f"{src} -{relation}-> {dst} closes a structural cycle")
    last = edges.where(F.col("src") == src).agg(F.coalesce(F.max("ord") + 1, F.lit(0))).first()[0]
    kind = "structural" if relation in STRUCTURAL_RELATIONS else "behavioral"
    return edges.unionByName(spark.createDataFrame([(src, dst, relation, kind, last)], edges.select("src", "dst", "relation", "class", "ord").schema))


def remove_edge(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """Without the first edge from src to dst."""
    at = edges.where((F.col("src") == src) & (F.col("dst") == dst)).agg(F.min("ord")).first()[0]
    return edges if at is None else edges.where(~((F.col("src") == src) & (F.col("ord") == at)))


def supersede(nodes: DataFrame, old_id: str, new: DataFrame) -> DataFrame:
    """Mark a node as superseded by another, which is put in."""
    by = new.first()["id"]
    hit = F.col("id") == old_id
    marked = nodes.withColumn("status", F.when(hit, "superseded").otherwise(F.col("status"))).withColumn(
        "superseded_by", F.when(hit, by).otherwise(F.col("superseded_by"))
    )
    return upsert(marked, new)


def latest(nodes: DataFrame, *order: Column) -> DataFrame:
    """One row per id, the first in the order; of files with one id the first path stays."""
    return first_by(nodes, ["id"], *(order or (F.col("file_path"),)))


def as_of(nodes: DataFrame, moment: str) -> DataFrame:
    """Nodes valid at a time: from <= moment < until, open where missing or unreadable."""
    start, end, at = F.try_to_timestamp("valid_from"), F.try_to_timestamp("valid_until"), F.lit(moment).cast("timestamp")
    return nodes.where(F.coalesce(start <= at, F.lit(True)) & F.coalesce(end > at, F.lit(True)))


def resolve_ids(nodes: DataFrame, asked: DataFrame, namespaces: DataFrame) -> DataFrame:
    """(asked, id): the id itself if it exists, else the first namespace/id by name of the namespace."""
    wanted = asked.select(F.col("id").alias("asked")).distinct()
    exact = wanted.join(nodes.select(F.col("id").alias("asked"), "id"), "asked").select("asked", "id", F.lit("").alias("ns"))
    # an id below a namespace is found by what follows the namespace
    below = nodes.where(F.col("id").contains("/")).select("id", F.substring_index("id", "/", 1).alias("ns"), F.regexp_replace("id", "^[^/]*/", "").alias("asked"))
    below = below.join(namespaces.select(F.col("name").alias("ns")).distinct(), "ns", "left_semi").join(wanted, "asked", "left_semi")
    found = first_by(exact.unionByName(below), ["asked"], F.col("ns")).select("asked", "id")
    return wanted.join(found, "asked", "left")


def to_client(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """What the client shows of a node: long contexts cut at 2000 bytes, its out-edges."""
    from graphloom.functions.text import cut_utf8

    long = F.octet_length(blank(F.col("context"))) > 2000
    out = edges.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list(F.struct("ord", "dst", "relation"))).alias("out"))
    return nodes.join(out, "id", "left").select(
        "id", "type", "namespace", "status", "summary", F.when(long, F.concat(cut_utf8("context", 2000), F.lit("\n... (context truncated)"))).otherwise(blank(F.col("context"))).alias("context"),
        "tags", F.transform(F.coalesce("out", F.array()), lambda e: F.struct(e["dst"].alias("target"), e["relation"].alias("relation"))).alias("edges"),
    )
