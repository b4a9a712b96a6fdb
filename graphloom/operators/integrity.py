"""Integrity issues, staleness and quality suggestions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import content_hash, infer_type, suggestion_id
from graphloom.operators.components import CHUNK_ROWS, only_neighbours
from graphloom.operators.federation import model_skew
from graphloom.operators.graph import active, bfs, cycle_residual, dangling, edges_of, first_by, orphans
from graphloom.operators.metric import neighbours
from graphloom.schema import EXTERNAL_RELATIONS, SUPERSEDED, blank, severity_rank
from graphloom.storage import broadcast_if_small, materialize

ISSUE = ("node_id", "issue_type", "message", "severity")
DUPLICATE_SCORE = 0.95
SMALL_COMPONENT = 3


def node_hashes(nodes: DataFrame) -> DataFrame:
    return nodes.select("id", content_hash("summary", "context", "edges").alias("content_hash"))


def source_states(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """(id, path, stored_hash, current_hash, exists, is_stale) of nodes with a source path.

    ``files`` has (path, hash) and, for nodes on line ranges, (first, last) of the range hashed."""
    want = nodes.where(blank(F.col("source.path")) != "").select(
        "id", F.col("source.path").alias("path"), blank(F.col("source.hash")).alias("stored_hash"),
        F.coalesce(F.try_element_at("source.lines", F.lit(1)), F.lit(0)).alias("first"), F.coalesce(F.try_element_at("source.lines", F.lit(2)), F.lit(0)).alias("last"),
    )
    if "first" not in files.columns:
        files = files.withColumns({"first": F.lit(0), "last": F.lit(0)})
    have = files.select("path", "first", "last", F.col("hash").alias("current_hash"))
    exists = files.select("path").distinct().withColumn("exists", F.lit(True))
    out = want.join(have, ["path", "first", "last"], "left").join(exists, "path", "left")
    stale = F.col("current_hash").isNotNull() & (F.col("current_hash") != F.col("stored_hash"))
    return out.select("id", "path", "stored_hash", "current_hash", F.coalesce("exists", F.lit(False)).alias("exists"), stale.alias("is_stale"))


def staleness(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """(id, is_stale): nodes without a source are fresh; those whose file is gone are left out."""
    bare = nodes.where(blank(F.col("source.path")) == "").select("id", F.lit(False).alias("is_stale"))
    return bare.unionByName(source_states(nodes, files).where("current_hash is not null").select("id", "is_stale"))


def changed(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """(id, current_hash) of active nodes whose stored source hash is out of date ('' if the file is gone)."""
    states = source_states(active(nodes), files).where("stored_hash <> ''")
    return states.where(F.coalesce("current_hash", F.lit("")) != F.col("stored_hash")).select("id", F.coalesce("current_hash", F.lit("")).alias("current_hash"))


def propagate_stale(edges: DataFrame, origins: DataFrame, depth: int) -> DataFrame:
    """(id, depth, origin, reason): changed ids, and what depends on them over in-edges; the first
    visit counts, of equally near origins the smaller."""
    seeds = origins.select("id", F.col("id").alias("origin")).distinct()
    reached = bfs(edges, seeds, max(depth, 0), "in", ["origin"])
    first = first_by(reached, ["id"], F.col("depth"), F.col("origin"))
    reason = F.when(F.col("depth") == 0, "source_changed").otherwise(F.concat(F.lit("dependency_changed:"), "origin"))
    return first.select("id", "depth", "origin", reason.alias("reason"))


def _issue(df: DataFrame, kind: str, message: Column, severity: Column | str, id_: str = "id") -> DataFrame:
    severity = F.lit(severity) if isinstance(severity, str) else severity
    return df.select(F.col(id_).alias("node_id"), F.lit(kind).alias("issue_type"), message.alias("message"), severity.alias("severity"))


def integrity(nodes: DataFrame, known: DataFrame | None = None, files: DataFrame | None = None) -> DataFrame:
    """All issues of a set of nodes; targets are looked up in ``known`` (the nodes themselves by default)."""
    known = nodes if known is None else known
    edges = edges_of(nodes)
    external = F.col("relation").isin(*EXTERNAL_RELATIONS)
    said = F.when(external, F.format_string('edge targets unindexed symbol "%s" (relation: %s)', "dst", "relation")).otherwise(
        F.format_string('edge targets unknown node "%s" (relation: %s)', "dst", "relation")
    )
    parts = [_issue(dangling(edges, known), "dangling_edge", said, F.when(external, "info").otherwise("error"), "src")]
    if files is not None:
        states = source_states(nodes, files)
        parts.append(_issue(states.where("not exists"), "missing_source", F.format_string('source file "%s" does not exist', "path"), "warning"))
        parts.append(_issue(states.where("is_stale and stored_hash <> ''"), "hash_mismatch", F.format_string(
            "source hash mismatch: stored=%s current=%s", F.substring("stored_hash", 1, 12), F.substring("current_hash", 1, 12)), "warning"))
    ring = cycle_residual(nodes, edges)
    first = ring.agg(F.min("id").alias("id"), F.count("*").alias("n")).where("n > 0")
    parts.append(_issue(first, "structural_cycle", F.format_string("structural cycle: %d nodes in or behind it", "n"), "error"))
    lost = nodes.where(blank(F.col("superseded_by")) != "").join(known.select(F.col("id").alias("superseded_by")), "superseded_by", "left_anti")
    parts.append(_issue(lost, "dangling_edge", F.format_string('superseded_by references unknown node "%s"', "superseded_by"), "warning"))
    late = nodes.where(F.try_to_timestamp("valid_until") < F.try_to_timestamp("valid_from"))
    parts.append(_issue(late, "hash_mismatch", F.format_string('valid_until "%s" is before valid_from "%s"', "valid_until", "valid_from"), "warning"))
    bare = nodes.where((F.col("status") == SUPERSEDED) & (blank(F.col("superseded_by")) == "") & (blank(F.col("valid_until")) == ""))
    parts.append(_issue(bare, "hash_mismatch", F.lit("node has status=superseded but no superseded_by or valid_until set"), "warning"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def verify(nodes: DataFrame, files: DataFrame, check: str = "all", known: DataFrame | None = None) -> DataFrame:
    """Issues of ``integrity``, ``staleness`` or both."""
    parts = []
    if check in ("integrity", "all"):
        parts.append(integrity(nodes, known, files))
    if check in ("staleness", "all"):
        parts.append(_issue(source_states(nodes, files).where("is_stale"), "stale", F.lit("source changed since it was recorded"), "warning"))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def issue_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("severity").agg(F.count("*").alias("n"))


def small_components(live: DataFrame, edges: DataFrame, chunk: int = CHUNK_ROWS) -> DataFrame:
    """(node_ids): connected components of one or two nodes. They show in the neighbours of their members: none, or
    one that has no other; so no search over the graph is needed.

    Edges are reduced where they lie once both ends are known, a chunk at a time, to a row for each node. Neighbours are compared by
    hashes first, and those of the few nodes that seem to have one only by their ids."""
    ids = live.select("id")
    inside = edges.select("src", "dst").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").join(ids.withColumnRenamed("id", "src"), "src", "left_semi")
    seen = materialize(only_neighbours(inside, chunk), "neighbours")
    hashed = F.xxhash64("other")
    alike = F.max(F.col("other").isNull().cast("int")).alias("many"), F.min(hashed).alias("low"), F.max(hashed).alias("high")
    degree = materialize(seen.groupBy("id").agg(*alike).select("id", ((F.col("many") == 0) & (F.col("low") == F.col("high"))).alias("one")), "degrees")
    alone = ids.join(degree.select("id"), "id", "left_anti").select(F.array("id").alias("node_ids"))
    some = seen.join(broadcast_if_small(materialize(degree.where("one").select("id"), "one-neighbour")), "id", "left_semi")
    one = materialize(some.groupBy("id").agg(F.min("other").alias("other"), F.max("other").alias("high")).where("other = high").select("id", "other"), "one-other")
    two = one.join(one.select(F.col("id").alias("other"), F.col("other").alias("id")), ["id", "other"]).where("id < other")
    return alone.unionByName(two.select(F.array("id", "other").alias("node_ids")))


def _suggest(df: DataFrame, kind: str, severity: str, message: Column, command: Column, args: Column | None = None, auto: bool = False, order: int = 0) -> DataFrame:
    none = F.create_map().cast("map<string,string>")
    return df.select(
        suggestion_id(kind, "node_ids").alias("suggestion_id"), F.lit(kind).alias("type"), F.lit(severity).alias("severity"), "node_ids", message.alias("message"),
        F.struct(command.alias("command"), F.lit(auto).alias("auto"), (none if args is None else args).alias("args")).alias("fix"), F.lit(order).alias("source_ord"),
    )


def duplicates(nodes: DataFrame, embeddings: DataFrame, vectors: DataFrame, model: str | None = None, least: float = DUPLICATE_SCORE) -> DataFrame:
    """(a, b, score): nodes whose summary vector (``vectors``: query_id, embedding) has another node among its two
    nearest rows, above the score. Rows and vectors that cannot be as near do not meet."""
    rows = embeddings if model is None else embeddings.where(F.col("model") == model)
    hits = neighbours(rows, vectors, least, 2, above=True).where(F.col("node_id") != F.col("query_id"))
    pairs = hits.select(F.least("query_id", "node_id").alias("a"), F.greatest("query_id", "node_id").alias("b"), "score")
    return pairs.groupBy("a", "b").agg(F.max("score").alias("score"))


def suggestions(nodes: DataFrame, files: DataFrame | None = None, embeddings: DataFrame | None = None, vectors: DataFrame | None = None,
                model: str | None = None, disconnected: bool = True, edges: DataFrame | None = None) -> DataFrame:
    """All suggestions on active nodes, each id once; small components can be left out. ``edges`` may be a table in
    place of the nodes' lists."""
    live = active(nodes)
    edges = materialize((edges_of(nodes) if edges is None else edges).select("src", "dst"), "edges")  # read by several parts
    lone = lambda df: df.withColumn("node_ids", F.array("id"))
    say = F.format_string
    parts = [
        _suggest(lone(orphans(live, edges)), "orphan", "warning", say('Node "%s" has no edges', "id"), say("/delete %s", "id"), order=1),
        _suggest(lone(live.where(blank(F.col("summary")) == "")), "missing_summary", "info", say('Node "%s" has no summary', "id"), say("/edit %s", "id"),
                 F.create_map(F.lit("field"), F.lit("summary")), order=2),
    ]
    if embeddings is not None and vectors is not None:
        twins = duplicates(live, embeddings, vectors, model).withColumn("node_ids", F.array("a", "b"))
        parts.append(_suggest(twins, "duplicate", "warning", say('Nodes "%s" and "%s" look alike (similarity: %.3f)', "a", "b", "score"), say("/merge %s %s", "a", "b"), order=3))
    if files is not None:
        old = lone(source_states(live, files).where("is_stale"))
        parts.append(_suggest(old, "stale", "error", say('Node "%s" has a stale source reference', "id"), say("/verify %s", "id"), F.create_map(F.lit("action"), F.lit("re-index")), True, 4))
    bare = lone(live.where(blank(F.col("type")) == "")).withColumn("guess", infer_type("id"))
    parts.append(_suggest(bare, "untyped", "warning", say('Node "%s" has no type', "id"), say("/type %s", "guess"),
                          F.create_map(F.lit("node_id"), F.col("id"), F.lit("suggested_type"), F.col("guess")), order=5))
    if disconnected and len(live.select("id").head(SMALL_COMPONENT)) == SMALL_COMPONENT:
        small = small_components(live, edges)
        parts.append(_suggest(small, "disconnected", "info", say("Small disconnected subgraph with %d node(s)", F.size("node_ids")), F.lit("/link"),
                              F.create_map(F.lit("node_ids"), F.array_join("node_ids", ",")), order=6))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return first_by(out, ["suggestion_id"], F.col("source_ord"))


def ranked(found: DataFrame, offset: int = 0, limit: int = 0) -> DataFrame:
    """A page of suggestions: by severity, more nodes first, then source and id; limit 0 is all."""
    out = found.orderBy(severity_rank(), F.desc(F.size("node_ids")), "source_ord", "suggestion_id").drop("source_ord")
    out = out.offset(offset) if offset else out
    return out.limit(limit) if limit else out


def page(df: DataFrame, order: list, offset: int = 0, limit: int = 0) -> DataFrame:
    out = df.orderBy(*order).offset(offset)
    return out.limit(limit) if limit else out


def namespace_doctor(nodes: DataFrame, namespaces: DataFrame, bridges: DataFrame) -> DataFrame:
    """(subject, issue): namespaces without manifest, names that differ from their folder, bridges to unknown ends."""
    used = nodes.select(F.when(blank(F.col("namespace")) == "", "default").otherwise(F.col("namespace")).alias("name")).distinct()
    known = namespaces.select("name")
    parts = [used.join(known, "name", "left_anti").select(F.col("name").alias("subject"), F.lit("no_manifest").alias("issue"))]
    if "folder" in namespaces.columns:
        parts.append(namespaces.where("name <> folder").select(F.col("folder").alias("subject"), F.lit("name_mismatch").alias("issue")))
    ends = bridges.select(F.explode(F.array("source", "target")).alias("name")).distinct()
    parts.append(ends.join(known, "name", "left_anti").select(F.col("name").alias("subject"), F.lit("unknown_bridge_endpoint").alias("issue")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def catalog_doctor(catalog: str, projects: DataFrame, bridges: DataFrame, ignored: bool = True, cache_inside: bool = False) -> DataFrame:
    """(subject, code, severity): problems of a catalog of projects.

    projects: project_id, path, and what was found there: exists, is_directory, metadata (read, or null where it cannot
    be), meta_project_id, meta_warren_id, vault_id, model (null without embeddings), schema_current; bridges: source, target. A project whose
    folder is missing or no folder is not looked into."""
    tell = lambda df, code, severity, c="project_id": df.select(F.col(c).cast("string").alias("subject"), F.lit(code).alias("code"), F.lit(severity).alias("severity"))
    there = projects.where("exists AND is_directory")
    read = there.where(F.col("metadata").isNotNull())
    owners = read.where(blank(F.col("vault_id")) != "").groupBy("vault_id").agg(F.min("project_id").alias("owner"), F.count("*").alias("n")).where("n > 1")
    again = read.join(owners, "vault_id").where("project_id <> owner")
    known = projects.select("project_id")
    ends = lambda side: bridges.join(known.withColumnRenamed("project_id", side), side, "left_anti")
    skewed = model_skew(there.where("model is not null").select("project_id", "model")).where("skewed")
    one = projects.sparkSession.createDataFrame([(catalog,)], "project_id string")
    parts = [
        tell(one.where(F.lit(not ignored)), "lockfile_not_ignored", "info"), tell(one.where(F.lit(cache_inside)), "materialized_cache_in_warren", "warning"),
        tell(projects.where(F.col("path").startswith("/")), "absolute_project_path", "warning"), tell(projects.where("NOT exists"), "project_missing", "error"),
        tell(projects.where("exists AND NOT is_directory"), "project_not_directory", "error"), tell(there.where(F.col("metadata").isNull()), "metadata_unreadable", "warning"),
        tell(read.where("meta_project_id <> project_id"), "project_id_mismatch", "error"), tell(read.where(F.col("meta_warren_id") != catalog), "warren_id_mismatch", "error"),
        tell(again, "duplicate_vault_id", "error"), tell(there.where("model is null"), "embeddings_missing", "warning"),
        tell(there.where("model is not null AND NOT schema_current"), "schema_stale", "warning"), tell(skewed, "model_skew", "warning"),
        tell(ends("source"), "bridge_source_missing", "error", "source"), tell(ends("target"), "bridge_target_missing", "error", "target"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def workspace_doctor(local: str, mounts: DataFrame, catalogs: DataFrame, routes: DataFrame, here: str) -> DataFrame:
    """(subject, code, severity): problems of a workspace.

    mounts: catalog, project_id, vault_id, active, editable, materialized; catalogs: catalog, reachable; routes: vault_id, path;
    ``local`` is the workspace's vault id and ``here`` its path. A project with the local vault id is the workspace
    itself: no mount, edit or copy of it makes sense."""
    tell = lambda df, code, severity, c="project_id": df.select(F.col(c).cast("string").alias("subject"), F.lit(code).alias("code"), F.lit(severity).alias("severity"))
    own = mounts.where(F.col("vault_id") == local)
    rest = mounts.where(blank(F.col("vault_id")) != "").where(F.col("vault_id") != local).where("active")
    twice = rest.groupBy("vault_id").agg(F.count_distinct(F.struct("catalog", "project_id")).alias("n")).where("n > 1")
    parts = [
        tell(own, "self_identity", "info"), tell(own.where("active"), "self_alias_mount", "warning"), tell(own.where("editable"), "self_alias_editable", "warning"),
        tell(own.where("materialized"), "self_alias_materialized", "warning"), tell(twice, "vault_id_collision_workspace", "error", "vault_id"),
        tell(catalogs.where("NOT reachable"), "warren_unreachable", "warning", "catalog"), tell(routes.where((F.col("vault_id") == local) & (F.col("path") != here)), "local_route_mismatch", "warning", "vault_id"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def bridge_health(bridges: DataFrame, vaults: DataFrame) -> DataFrame:
    """(source, target, vault_id, problem) for cross-vault bridges whose vault has no path, no readable config or another id."""
    ends = bridges.where(blank(F.col("target_vault_id")) != "").select("source", "target", F.explode(F.array("source_vault_id", "target_vault_id")).alias("vault_id"))
    both = ends.join(vaults.select("vault_id", "path", "config_vault_id"), "vault_id", "left")
    problem = F.when(blank(F.col("path")) == "", "unreachable").when(F.col("config_vault_id").isNull(), "config_error").when(F.col("config_vault_id") != F.col("vault_id"), "id_mismatch")
    return both.withColumn("problem", problem).where("problem is not null").select("source", "target", "vault_id", "problem")


def freshness_note(state: Column, ahead: Column, behind: Column, pending: Column) -> Column:
    """Label of a link from supplied counters."""
    return (
        F.when(state == "missing", "missing").when((ahead > 0) & (behind > 0), "diverged").when(behind > 0, F.concat(F.lit("behind by "), behind.cast("string")))
        .when(ahead > 0, F.concat(F.lit("ahead by "), ahead.cast("string"))).when(pending > 0, F.concat(pending.cast("string"), F.lit(" pending"))).otherwise("fresh")
    )


