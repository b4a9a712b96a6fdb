"""Changes to small tables (namespaces, projects, bridges, mounts, links), with the guards of their verbs.

Every function takes a table of requests and returns the new table and a report: one row per request with
``result``, which is what was done or why not. Requests are judged against the table as it was."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.schema import DEFAULT_NAMESPACE, blank, normal_namespace


def _found(requests: DataFrame, table: DataFrame, keys: list[str], flag: str = "_there") -> DataFrame:
    return requests.join(table.select(*keys).distinct().withColumn(flag, F.lit(True)), keys, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def _plain_name(c: Column) -> Column:
    """A simple name: no separators, parents, blanks at the ends, leading dot or underscore."""
    return (blank(c) != "") & (F.trim(c) == c) & ~c.contains("/") & ~c.contains("\\") & ~c.contains("..") & ~c.startswith(".") & ~c.startswith("_")


# Namespaces: name, root_path


def create_namespaces(table: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A namespace that is there stays as it is."""
    said = _found(requests.dropDuplicates(["name"]), table, ["name"])
    said = said.withColumn("result", F.when(~_plain_name(F.col("name")), "invalid_name").when(F.col("_there"), "exists").otherwise("created"))
    new = said.where("result = 'created'").select(table.columns)
    return table.unionByName(new), said.select("name", "result")


def update_namespaces(table: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    said = _found(requests.dropDuplicates(["name"]), table, ["name"])
    said = said.withColumn("result", F.when(~_plain_name(F.col("name")), "invalid_name").when(~F.col("_there"), "no_such_namespace").otherwise("updated"))
    new = said.where("result = 'updated'").select("name", F.col("root_path").alias("_root"), F.lit(True).alias("_set"))
    out = table.join(new, "name", "left").withColumn("root_path", F.when(F.col("_set"), F.col("_root")).otherwise(F.col("root_path")))
    return out.select(table.columns), said.select("name", "result")


def remove_namespaces(table: DataFrame, requests: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """requests: name, force. The default namespace stays, and one with nodes only goes by force; its nodes stay."""
    n = nodes.groupBy(normal_namespace().alias("name")).agg(F.count("*").alias("_nodes"))
    said = _found(requests.dropDuplicates(["name"]), table, ["name"]).join(n, "name", "left")
    result = (
        F.when(F.col("name") == DEFAULT_NAMESPACE, "default_stays").when(~_plain_name(F.col("name")), "invalid_name").when(~F.col("_there"), "no_such_namespace")
        .when((F.coalesce("_nodes", F.lit(0)) > 0) & ~F.col("force"), "has_nodes").otherwise("removed")
    )
    said = said.withColumn("result", result)
    return table.join(said.where("result = 'removed'").select("name"), "name", "left_anti").select(table.columns), said.select("name", "result")


# Projects: project_id, path, readonly; bridges: source, target, allowed_relations


def add_projects(table: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Neither an id nor a path is given twice."""
    said = _found(_found(requests.dropDuplicates(["project_id"]), table, ["project_id"]), table, ["path"], "_path")
    said = said.withColumn("result", F.when(blank(F.col("project_id")) == "", "invalid_id").when(F.col("_there"), "exists").when(F.col("_path"), "path_taken").otherwise("added"))
    return table.unionByName(said.where("result = 'added'").select(table.columns)), said.select("project_id", "result")


def remove_projects(table: DataFrame, bridges: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(projects, bridges, report): the bridges of a removed project go with it."""
    said = _found(requests.dropDuplicates(["project_id"]), table, ["project_id"])
    said = said.withColumn("result", F.when(F.col("_there"), "removed").otherwise("no_such_project"))
    gone = said.where("_there").select("project_id")
    kept = bridges
    for side in ("source", "target"):
        kept = kept.join(gone.withColumnRenamed("project_id", side), side, "left_anti")
    return table.join(gone, "project_id", "left_anti").select(table.columns), kept.select(bridges.columns), said.select("project_id", "result")


def rename_projects(table: DataFrame, bridges: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """requests: project_id, new_id. (projects, bridges, report): bridges follow; an id that is taken is refused."""
    taken = _found(requests.dropDuplicates(["project_id"]), table, ["project_id"])
    taken = _found(taken, table.select(F.col("project_id").alias("new_id")), ["new_id"], "_taken")
    result = F.when(F.col("new_id") == F.col("project_id"), "same_id").when(F.col("_taken"), "exists").when(~F.col("_there"), "no_such_project").otherwise("renamed")
    said = taken.withColumn("result", result)
    moves = said.where("result = 'renamed'").select(F.col("project_id").alias("_old"), F.col("new_id").alias("_new"))

    def moved(df: DataFrame, c: str) -> DataFrame:
        return df.join(moves, df[c] == moves["_old"], "left").withColumn(c, F.coalesce("_new", c)).drop("_old", "_new")

    return moved(table, "project_id").select(table.columns), moved(moved(bridges, "source"), "target").select(bridges.columns), said.select("project_id", "result")


def set_readonly(table: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """requests: project_id, readonly."""
    said = _found(requests.dropDuplicates(["project_id"]), table, ["project_id"]).withColumn("result", F.when(F.col("_there"), "set").otherwise("no_such_project"))
    new = said.where("_there").select("project_id", F.col("readonly").alias("_ro"))
    out = table.join(new, "project_id", "left").withColumn("readonly", F.coalesce("_ro", "readonly"))
    return out.select(table.columns), said.select("project_id", "result")


def add_bridges(bridges: DataFrame, requests: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ends must differ and be known (``known``: id); a bridge that is there, in either direction, gets the relations that
    it has not, and keeps its direction."""
    lo, hi = F.least("source", "target").alias("_lo"), F.greatest("source", "target").alias("_hi")
    have = bridges.select(lo, hi).distinct()
    said = _found(requests.dropDuplicates(["source", "target"]).withColumn("_lo", F.least("source", "target")).withColumn("_hi", F.greatest("source", "target")), have, ["_lo", "_hi"])
    for side in ("source", "target"):
        said = _found(said, known.select(F.col("id").alias(side)), [side], f"_{side}")
    result = F.when(F.col("source") == F.col("target"), "same_ends").when(~F.col("_source"), "no_such_source").when(~F.col("_target"), "no_such_target").when(F.col("_there"), "merged").otherwise("added")
    said = said.withColumn("result", result)
    more = said.where("result = 'merged'").groupBy("_lo", "_hi").agg(F.array_distinct(F.flatten(F.collect_list("allowed_relations"))).alias("_more"))
    out = bridges.withColumn("_lo", F.least("source", "target")).withColumn("_hi", F.greatest("source", "target")).join(more, ["_lo", "_hi"], "left")
    out = out.withColumn("allowed_relations", F.when(F.col("_more").isNotNull(), F.array_union("allowed_relations", "_more")).otherwise(F.col("allowed_relations")))
    return out.select(bridges.columns).unionByName(said.where("result = 'added'").select(bridges.columns)), said.select("source", "target", "result")


def remove_bridges(bridges: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """requests: source, target, relations. Without relations the bridge goes; otherwise these, and the bridge when none is left."""
    said = _found(requests.dropDuplicates(["source", "target"]), bridges, ["source", "target"]).withColumn("result", F.when(F.col("_there"), "removed").otherwise("no_such_bridge"))
    cut = said.where("_there").select("source", "target", F.coalesce("relations", F.array().cast("array<string>")).alias("_cut"))
    out = bridges.join(cut, ["source", "target"], "left")
    left = F.when(F.col("_cut").isNull(), F.col("allowed_relations")).when(F.size("_cut") == 0, F.array().cast("array<string>")).otherwise(F.array_except("allowed_relations", "_cut"))
    out = out.withColumn("allowed_relations", left).where(F.col("_cut").isNull() | (F.size("allowed_relations") > 0))
    return out.select(bridges.columns), said.select("source", "target", "result")


# Mounts: project_id, active, editable, materialized


def mount(state: DataFrame, requests: DataFrame, projects: DataFrame, local: str) -> tuple[DataFrame, DataFrame]:
    """requests: project_id, verb (mount, materialize, edit, lock, unmount). projects: project_id, vault_id, readonly. A copy never syncs
    edits back, so that a project is editable or materialized; the workspace's own project is neither."""
    p = projects.select("project_id", "vault_id", "readonly", F.lit(True).alias("_known"))
    s = state.select("project_id", "active", "editable", "materialized")
    said = requests.dropDuplicates(["project_id"]).join(p, "project_id", "left").join(s, "project_id", "left")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    own, verb = F.coalesce(F.col("vault_id") == local, F.lit(False)), F.col("verb")
    result = (
        F.when((verb == "unmount") & ~flag("active"), "not_mounted").when(verb == "unmount", "unmounted").when(F.col("_known").isNull(), "no_such_project")
        .when((verb == "edit") & flag("readonly"), "read_only").when(verb.isin("materialize", "edit") & own, "self_alias")
        .when((verb == "materialize") & flag("editable"), "editable").when((verb == "edit") & flag("materialized"), "materialized").otherwise(verb)
    )
    said = said.withColumn("result", result)
    done = said.where(F.col("result").isin("mount", "materialize", "edit", "lock", "unmounted"))
    new = done.where("result <> 'unmounted'").select(
        "project_id", F.lit(True).alias("active"), F.when(verb == "edit", True).when(verb == "lock", False).otherwise(flag("editable")).alias("editable"),
        F.when(verb == "materialize", True).otherwise(flag("materialized")).alias("materialized"),
    )
    return state.join(done.select("project_id"), "project_id", "left_anti").select(new.columns).unionByName(new), said.select("project_id", "result")


# Links of a den: target, mode


def add_links(links: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A link that is there gets the new mode."""
    said = _found(requests.dropDuplicates(["target"]), links, ["target"]).withColumn("result", F.when(F.col("_there"), "updated").otherwise("added"))
    return links.join(said.select("target"), "target", "left_anti").select(links.columns).unionByName(said.select(links.columns)), said.select("target", "result")


def remove_links(links: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    said = _found(requests.dropDuplicates(["target"]), links, ["target"]).withColumn("result", F.when(F.col("_there"), "removed").otherwise("no_such_link"))
    return links.join(said.select("target"), "target", "left_anti").select(links.columns), said.select("target", "result")


# Dens: den_id, path, vaults


def change_dens(dens: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """requests: den_id, verb (create, adopt, relocate, destroy), path. An id is made once, a path belongs to one den, and only a
    den without vaults is destroyed."""
    there = dens.select("den_id", F.col("vaults").alias("_vaults"), F.lit(True).alias("_there"))
    used = dens.select(F.col("path"), F.col("den_id").alias("_owner"))
    said = requests.dropDuplicates(["den_id"]).join(there, "den_id", "left").join(used, "path", "left")
    new, known = F.col("verb").isin("create", "adopt"), F.coalesce("_there", F.lit(False))
    taken = F.col("_owner").isNotNull() & (F.col("_owner") != F.col("den_id"))
    result = (
        F.when(~_plain_name(F.col("den_id")), "invalid_id").when(new & known, "exists").when(~new & ~known, "no_such_den").when((F.col("verb") != "destroy") & taken, "path_taken")
        .when((F.col("verb") == "destroy") & (F.col("_vaults") > 0), "has_vaults").otherwise(F.col("verb"))
    )
    said = said.withColumn("result", result)
    made = said.where(F.col("result").isin("create", "adopt")).select("den_id", "path", F.lit(0).cast("int").alias("vaults"))
    moved = said.where("result = 'relocate'").select("den_id", F.col("path").alias("_to"))
    gone = said.where("result = 'destroy'").select("den_id")
    out = dens.join(gone, "den_id", "left_anti").join(moved, "den_id", "left").withColumn("path", F.coalesce("_to", "path"))
    return out.select("den_id", "path", "vaults").unionByName(made), said.select("den_id", "result")
