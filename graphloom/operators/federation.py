"""Namespaces, bridges, vaults and catalogs: policies and lookups as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import canonical_url, qualified, rewrite_target, vault_prefix
from graphloom.operators.graph import attach, below, degrees, edges_of, first_by
from graphloom.schema import blank, is_active, normal_namespace
from graphloom.storage import broadcast_if_small, materialize

# Projections and counts by namespace


def namespace_counts(nodes: DataFrame, manifests: DataFrame | None = None) -> DataFrame:
    """(namespace, n) of active nodes, with zero rows for manifests without nodes; an empty graph has default: 0."""
    out = nodes.where(is_active()).groupBy(normal_namespace().alias("namespace")).agg(F.count("*").alias("n"))
    if manifests is not None:
        out = out.join(manifests.select(F.col("name").alias("namespace")).distinct(), "namespace", "full_outer").fillna(0, ["n"])
    if out.isEmpty():
        return nodes.sparkSession.createDataFrame([("default", 0)], "namespace string, n bigint")
    return out


def status_breakdown(nodes: DataFrame) -> DataFrame:
    s = F.when(F.col("status").isin("superseded", "archived"), F.col("status")).otherwise("active")
    return nodes.groupBy(s.alias("status")).agg(F.count("*").alias("n"))


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: active nodes, their out-edges, sorted namespaces."""
    live = nodes.where(is_active())
    n = live.agg(F.count("*").alias("nodes"), F.array_sort(F.collect_set(normal_namespace())).alias("namespaces"))
    e = edges.join(live.select(F.col("id").alias("src")), "src", "left_semi").agg(F.count("*").alias("edges"))
    return n.crossJoin(e).select("nodes", "edges", "namespaces")


def status_report(nodes: DataFrame, edges: DataFrame, embeddings: DataFrame, heat: DataFrame, stale: DataFrame) -> DataFrame:
    """One row with the counts of a vault; every part is a one-row aggregate."""
    one = lambda df, c: df.agg(F.count("*").alias(c))
    out = one(nodes, "nodes")
    for df, c in ((edges, "edges"), (embeddings, "embeddings"), (heat, "heat_pairs"), (stale, "stale")):
        out = out.crossJoin(one(df, c))
    return out.crossJoin(nodes.agg(F.count_distinct(normal_namespace()).alias("namespaces"))).crossJoin(nodes.agg(F.count_if(is_active()).alias("active")))


def distinct_values(nodes: DataFrame) -> DataFrame:
    """(kind, value): tags, types and namespaces in use."""
    live = nodes.where(is_active())
    parts = [
        live.select(F.lit("tag").alias("kind"), F.explode("tags").alias("value")), live.select(F.lit("type"), "type"),
        live.select(F.lit("namespace"), normal_namespace()),
    ]
    out = parts[0].union(parts[1]).union(parts[2])
    return out.where(blank(F.col("value")) != "").distinct()


def namespace_view(nodes: DataFrame, edges: DataFrame, namespace: str) -> tuple[DataFrame, DataFrame]:
    """Active nodes of a namespace with their degrees, and the edges inside it."""
    view = nodes.where(is_active() & (normal_namespace() == namespace))
    inside = below(edges, view, "src", "dst").join(view.select(F.col("id").alias("src")), "src", "left_semi").join(view.select(F.col("id").alias("dst")), "dst", "left_semi")
    return view.join(degrees(view, edges), "id"), inside.select(edges.columns)


def bridge_view(nodes: DataFrame, edges: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """(source, target, relation, class) of all edges of active nodes; those that lead into another
    namespace are bridges, also if the target is written as namespace/id. Dangling edges stay. ``ends``: as in ``attach``."""
    live = nodes.where(is_active()).select("id", blank(F.col("namespace")).alias("ns"))
    ends = edges if ends is None else ends
    out = attach(attach(edges, live, "src", "ns", "src_ns", ends), live, "dst", "ns", "dst_ns", ends, "left")
    # targets that are no ids but would be without their namespace: few, and judged once each
    spaces = materialize(live.select(F.col("ns").alias("head")).distinct(), "namespaces")
    named = ends.where(F.col("dst").contains("/")).withColumn("head", F.substring_index("dst", "/", 1)).join(broadcast_if_small(spaces), "head", "left_semi")
    lost = named.select("dst").distinct().join(live.select(F.col("id").alias("dst")), "dst", "left_anti")
    cuts = lost.withColumn("cut", F.regexp_replace("dst", "^[^/]*/", "")).join(live.select(F.col("id").alias("cut")), "cut", "left_semi")
    out = out.join(broadcast_if_small(materialize(cuts.select("dst", "cut"), "cuts")), "dst", "left")
    strip, over = F.col("cut").isNotNull(), (F.col("dst_ns") != "") & (F.col("dst_ns") != F.col("src_ns"))
    return out.select(
        F.col("src").alias("source"), F.coalesce("cut", "dst").alias("target"), "relation",
        F.when(strip | F.coalesce(over, F.lit(False)), "bridge").otherwise(F.col("class")).alias("class"),
    )


# Policies


def qualified_ids(refs: DataFrame, namespaces: DataFrame, current: str, column: str = "ref") -> DataFrame:
    """Add (vault, namespace, node): '@v/n' names a vault; else a first segment that is another known
    namespace is one."""
    p = vault_prefix(column)
    head = F.substring_index(column, "/", 1)
    known = namespaces.select(F.col("name").alias("_head")).distinct().withColumn("_known", F.lit(True))
    out = refs.withColumn("_v", p["vault"]).withColumn("_head", head).join(known, "_head", "left")
    is_ns = F.coalesce("_known", F.lit(False)) & F.col(column).contains("/") & (F.col("_head") != current) & (F.col("_v") == "")
    rest = F.when(F.col("_v") != "", vault_prefix(column)["rest"]).when(is_ns, F.regexp_replace(column, "^[^/]*/", "")).otherwise(F.col(column))
    return out.select(*refs.columns, F.col("_v").alias("vault"), F.when(F.col("_v") != "", "").when(is_ns, F.col("_head")).otherwise(current).alias("namespace"), rest.alias("node"))


def cross_namespace(edges: DataFrame, nodes: DataFrame, namespaces: DataFrame) -> DataFrame:
    """(src, src_ns, dst_ns, node, relation) of edges whose target names another namespace than the source's."""
    src = nodes.select(F.col("id").alias("src"), normal_namespace().alias("src_ns"))
    known = namespaces.select(F.col("name").alias("dst_ns")).distinct()
    out = edges.join(src, "src").withColumn("dst_ns", F.when(F.col("dst").contains("/"), F.substring_index("dst", "/", 1)))
    out = out.join(known, "dst_ns", "left_semi").where("dst_ns <> src_ns")
    return out.select("src", "src_ns", "dst_ns", F.regexp_replace("dst", "^[^/]*/", "").alias("node"), "relation")


def violations(edges: DataFrame, bridges: DataFrame, source: str = "src_ns", target: str = "dst_ns", ends: tuple = ("source", "target")) -> DataFrame:
    """Edges between two namespaces (or vaults) without a bridge, or with a relation that the first
    bridge between them, in either direction, does not allow."""
    b = bridges.select(F.least(*ends).alias("_lo"), F.greatest(*ends).alias("_hi"), "allowed_relations", F.col("ord") if "ord" in bridges.columns else F.lit(0).alias("ord"))
    b = first_by(b, ["_lo", "_hi"], F.col("ord")).drop("ord")
    over = edges.where(F.col(source) != F.col(target)).withColumn("_lo", F.least(source, target)).withColumn("_hi", F.greatest(source, target))
    out = over.join(b, ["_lo", "_hi"], "left")
    problem = F.when(F.col("allowed_relations").isNull(), "no_bridge").when(~F.array_contains("allowed_relations", F.col("relation")), "relation_not_allowed")
    return out.withColumn("problem", problem).where("problem is not null").select(*edges.columns, "problem")


def vault_violations(edges: DataFrame, bridges: DataFrame) -> DataFrame:
    return violations(edges, bridges, "src_vault", "dst_vault", ("source_vault_id", "target_vault_id"))


def unique_bridges(bridges: DataFrame) -> DataFrame:
    """One row per direction with the sorted union of relations."""
    return bridges.groupBy("source", "target").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("allowed_relations")))).alias("allowed_relations"))


def runtime_bridges(mounts: DataFrame, bridges: DataFrame) -> DataFrame:
    """(lo, hi, allowed_relations) between vaults of active mounts, relations in order of first mention.

    mounts: catalog, project_id, vault_id, active, available; bridges: catalog, source, target, allowed_relations, ord."""
    live = mounts.where("active and available").where(blank(F.col("vault_id")) != "")
    end = lambda side: live.select("catalog", F.col("project_id").alias(side), F.col("vault_id").alias(f"{side}_vault"))
    both = bridges.join(end("source"), ["catalog", "source"]).join(end("target"), ["catalog", "target"]).where("source_vault <> target_vault")
    each = both.select(F.least("source_vault", "target_vault").alias("lo"), F.greatest("source_vault", "target_vault").alias("hi"), "ord", F.posexplode("allowed_relations").alias("pos", "relation"))
    first = each.groupBy("lo", "hi", "relation").agg(F.min(F.struct("ord", "pos")).alias("at"))
    return first.groupBy("lo", "hi").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "relation"))), lambda x: x["relation"]).alias("allowed_relations"))


def composed_bridges(*sets: DataFrame) -> DataFrame:
    """Union of bridge sets in order of precedence."""
    out = None
    for k, b in enumerate(sets):
        b = b.withColumn("ord", F.coalesce(F.col("ord") if "ord" in b.columns else F.lit(0), F.lit(0)) + k * 1_000_000)
        out = b if out is None else out.unionByName(b, allowMissingColumns=True)
    return out


# Several graphs as one


def _moved_to(vault: str):
    return lambda e: e.withField("target", rewrite_target(e["target"], F.lit(vault)))


def combined(vaults: dict[str, DataFrame], local: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of all vaults under qualified ids; '@local/x' and x are one in the local vault."""
    nodes = None
    for vault, df in vaults.items():
        v = "" if vault == local else vault
        part = df.withColumn("vault_id", F.lit(vault)).withColumn("id", qualified(F.lit(v), "id"))
        if vault != local:
            part = part.withColumn("edges", F.transform("edges", _moved_to(vault)))
        nodes = part if nodes is None else nodes.unionByName(part)
    edges = edges_of(nodes)
    back = f"@{local}/"
    return nodes, edges.withColumn("dst", F.when(F.col("dst").startswith(back), F.substring("dst", len(back) + 1, 1 << 20)).otherwise(F.col("dst")))


def vault_paths(*sources: DataFrame) -> DataFrame:
    """(vault_id, path): the first source that names a vault wins (links, then routes, then bridges)."""
    out = None
    for k, s in enumerate(sources):
        part = s.select("vault_id", "path").withColumn("precedence", F.lit(k))
        out = part if out is None else out.unionByName(part)
    return first_by(out.where(blank(F.col("path")) != ""), ["vault_id"], F.col("precedence"), F.col("path")).select("vault_id", "path")


def route_overlay(routes: DataFrame, mounts: DataFrame) -> DataFrame:
    """(vault_id, path, conflict): routes with available mounts that are not aliases on top."""
    m = mounts.where("available and not is_alias").select("vault_id", F.col("path").alias("mount"))
    both = routes.select("vault_id", F.col("path").alias("route")).join(m, "vault_id", "full_outer")
    return both.select("vault_id", F.coalesce("mount", "route").alias("path"), F.coalesce(F.col("mount") != F.col("route"), F.lit(False)).alias("conflict"))


def vault_collisions(claims: DataFrame) -> DataFrame:
    """(vault_id, claimants) of ids that more than one project claims."""
    return claims.where(blank(F.col("vault_id")) != "").groupBy("vault_id").agg(F.array_sort(F.collect_set("project_id")).alias("claimants")).where(F.size("claimants") > 1)


def vault_claims(local: DataFrame, catalogs: DataFrame) -> DataFrame:
    """Claims on vault ids, the local one first, then by catalog and project."""
    out = local.select("vault_id", F.lit("").alias("catalog"), "project_id").unionByName(catalogs.select("vault_id", "catalog", "project_id"))
    return out.withColumn("claim", F.row_number().over(Window.partitionBy("vault_id").orderBy("catalog", "project_id")))


def model_skew(embeddings: DataFrame, project: str = "project_id") -> DataFrame:
    """(project, models, skewed): projects whose set of models differs from the first project's."""
    sets = embeddings.groupBy(project).agg(F.array_sort(F.collect_set("model")).alias("models"))
    first = sets.agg(F.min_by("models", project).alias("first"))
    return sets.crossJoin(F.broadcast(first)).select(project, "models", (F.col("models") != F.col("first")).alias("skewed"))


def resolve_references(refs: DataFrame, projects: DataFrame, checkouts: DataFrame) -> DataFrame:
    """Add (via, project_id, vault_id): a catalog project with the same canonical URL, else the vault
    in the checkout, else none. projects: project_id, source_url, vault_id, ord; checkouts: path, vault_id."""
    p = projects.select(canonical_url("source_url").alias("_u"), "project_id", F.col("vault_id").alias("_pv"), "ord").where("_u <> ''")
    p = first_by(p, ["_u"], F.col("ord"), F.col("project_id")).drop("ord")
    c = checkouts.select(F.col("path").alias("_path"), F.col("vault_id").alias("_cv")).where(blank(F.col("vault_id")) != "")
    out = refs.withColumn("_u", canonical_url("url")).join(p, "_u", "left").join(c, F.col("path") == F.col("_path"), "left")
    via = F.when(F.col("project_id").isNotNull(), "catalog_url").when(F.col("_cv").isNotNull(), "checkout_vault").otherwise("none")
    return out.select(*refs.columns, via.alias("via"), "project_id", F.when(F.col("project_id").isNotNull(), F.col("_pv")).otherwise(F.col("_cv")).alias("vault_id"))


def resolve_links(links: DataFrame, mounts: DataFrame, routes: DataFrame, cached: DataFrame) -> DataFrame:
    """Add (vault_id, path, state) to links by mode: edit through an active mount, live through a
    route, link through a cached project; an editable mount of the target always wins."""
    m = mounts.where("active and editable").select(F.col("project_id").alias("target"), F.col("vault_id").alias("m_vault"), F.col("path").alias("m_path"))
    r = routes.select(F.col("vault_id").alias("target"), F.col("path").alias("r_path"))
    c = cached.select(F.col("project_id").alias("target"), F.col("vault_id").alias("c_vault"), F.col("path").alias("c_path"))
    out = links.join(m, "target", "left").join(r, "target", "left").join(c, "target", "left")
    mode = F.col("mode")
    path = F.coalesce("m_path", F.when(mode == "live", F.col("r_path")).when(mode == "link", F.col("c_path")))
    vault = F.coalesce("m_vault", F.when(mode == "live", F.col("target")).when(mode == "link", F.coalesce("c_vault", "target")))
    return out.select(*links.columns, vault.alias("vault_id"), path.alias("path"), F.when(path.isNull(), "missing").otherwise("ok").alias("state"))


def linked_vaults(resolved: DataFrame, local: str) -> DataFrame:
    return resolved.where(F.col("vault_id").isNotNull() & (F.col("vault_id") != local)).select("vault_id").distinct().orderBy("vault_id")


def active_mounts(projects: DataFrame, metadata: DataFrame, state: DataFrame, local: str) -> DataFrame:
    """Projects of the catalog that the workspace has active, with their vault ids; the local vault's own
    project is an alias."""
    out = projects.join(metadata.select("project_id", "vault_id"), "project_id", "left").join(state, "project_id", "left")
    flag = lambda c: F.coalesce(c, F.lit(False))
    return out.select(
        "project_id", "path", "vault_id", flag("active").alias("active"), (flag("editable") & ~flag("readonly")).alias("editable"),
        (flag("materialized") | flag("editable")).alias("available"), F.coalesce(F.col("vault_id") == local, F.lit(False)).alias("is_alias"),
    )


def cached_only(cache: DataFrame, projects: DataFrame) -> DataFrame:
    """Materialized projects that the catalog no longer names."""
    return cache.join(projects.select("project_id"), "project_id", "left_anti")


def skip_reasons(skipped: DataFrame) -> DataFrame:
    """One row: skipped ids in order and a map of reasons."""
    return skipped.agg(F.array_sort(F.collect_set("id")).alias("ids"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("id", "reason")))).alias("reasons"))


# Grouping


def primary_tags(nodes: DataFrame) -> DataFrame:
    """(id, tag): of a node's tags the one with the fewest members, the first on a tie."""
    each = nodes.select("id", F.posexplode("tags").alias("ord", "tag"))
    sizes = each.groupBy("tag").agg(F.count("*").alias("n"))
    return first_by(each.join(sizes, "tag"), ["id"], F.col("n"), F.col("ord")).select("id", "tag")


def visible_nodes(nodes: DataFrame, types: list[str] | None, tags: list[str] | None) -> DataFrame:
    """UI filter: type in the set, and any tag in the set (no set: no filter)."""
    out = nodes if types is None else nodes.where(F.col("type").isin(*types))
    return out if tags is None else out.where(F.arrays_overlap("tags", F.array(*map(F.lit, tags))))


def visible_edges(edges: DataFrame, shown: DataFrame, classes: list[str]) -> DataFrame:
    from graphloom.operators.graph import within

    return within(edges.where(F.col("class").isin(*classes)), shown)


def did_you_mean(nodes: DataFrame, asked: str, n: int = 3) -> DataFrame:
    last = asked.rstrip("/").rsplit("/", 1)[-1].lower()
    return nodes.where(is_active() & F.lower("id").contains(last)).select("id").orderBy("id").limit(n)


def summary_input(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, type, summary, targets) of active nodes."""
    out = edges.groupBy(F.col("src").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "dst"))), lambda e: e["dst"]).alias("targets"))
    return nodes.where(is_active()).select("id", "type", "summary").join(out, "id", "left").withColumn("targets", F.coalesce("targets", F.array().cast("array<string>")))


def template_summary(nodes: DataFrame, by: str = "namespace", limit: int = 500) -> DataFrame:
    """(by, text): a heading with the number of nodes, then a line per node in order of id, appended while
    the text is no longer than the limit. An id takes a line of nine bytes at least, so that the first few are enough."""
    item = F.concat(F.lit("- [["), "id", F.lit("]] ("), blank(F.col("type")), F.lit(")\n"))
    live = nodes.where(is_active()).select(by, "id", item.alias("item"))
    first = live.withColumn("_k", F.row_number().over(Window.partitionBy(by).orderBy("id"))).where(F.col("_k") <= limit // 9 + 2)
    rows = first.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("id", "item"))).alias("items"))
    rows = rows.join(live.groupBy(by).agg(F.count("*").alias("n")), by)
    head = F.concat(F.lit("Summary of namespace "), by, F.lit(" with "), F.col("n").cast("string"), F.lit(" nodes.\n\n"))
    step = lambda s, x: F.when(F.octet_length(s) > limit, s).otherwise(F.concat(s, x["item"]))
    return rows.select(by, F.aggregate("items", head, step).alias("text"))


def summary_due(counts: DataFrame, now: Column | None = None, least: int = 3, change: float = 0.2, every: int = 1800) -> DataFrame:
    """Namespaces whose summary is to be made: at least three nodes, and the first time, or a change of
    a fifth, or half an hour. counts: namespace, n, last_n, last_at."""
    now = F.current_timestamp() if now is None else now
    age = now.cast("timestamp").cast("long") - F.col("last_at").cast("timestamp").cast("long")
    moved = F.abs(F.col("n") - F.col("last_n")) / F.greatest(F.col("last_n"), F.lit(1))
    return counts.where((F.col("n") >= least) & (F.col("last_at").isNull() | (moved >= change) | (age >= every)))
