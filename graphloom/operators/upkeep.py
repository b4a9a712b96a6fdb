"""Policies for writes to mounted graphs, embedding upkeep, and checks of arguments and paths."""

from __future__ import annotations

import difflib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import embed_text, vault_prefix
from graphloom.operators.mutations import stale_embeddings, upsert_embeddings
from graphloom.schema import blank, is_active

WRITE_ARGS = ("id", "type", "namespace", "summary", "context", "edges", "tags", "source")


def check_args(given: dict, known: tuple[str, ...] = WRITE_ARGS) -> None:
    """Unknown argument names are errors, with the nearest known name."""
    for name in given:
        if name not in known:
            near = difflib.get_close_matches(name, known, 1)
            raise ValueError(f"unknown argument {name!r}" + (f"; did you mean {near[0]!r}?" if near else ""))


def source_path(path: str | Column, root: str) -> Column:
    """A relative path below the root; absolute ones, and those that would leave the root, stay as they are."""
    p = F.col(path) if isinstance(path, str) else path
    if not root:
        return p
    parts = F.filter(F.split(p, "/"), lambda x: ~x.isin("", "."))
    # a stack of names; null once '..' goes above the root
    step = lambda s, x: F.when(s.isNull(), s).when(x != "..", F.concat(s, F.array(x))).when(F.size(s) > 0, F.slice(s, 1, F.size(s) - 1))
    inside = F.aggregate(parts, F.array().cast("array<string>"), step)
    return F.when(p.startswith("/") | inside.isNull(), p).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), F.array_join(inside, "/")))


def mounted_writes(writes: DataFrame, mounts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Add ``verdict`` to writes of '@vault/id' rows: only updates of nodes that are there, in active
    and editable mounts; anything unknown or read-only is refused."""
    p = vault_prefix("id")
    m = mounts.select(F.col("vault_id").alias("_v"), (F.col("active") & F.col("editable")).alias("_ok")).groupBy("_v").agg(F.max("_ok").alias("_ok"))
    n = nodes.select(F.col("vault_id").alias("_v"), F.col("id").alias("_id"), F.lit(True).alias("_there"))
    out = writes.withColumns({"_v": p["vault"], "_id": p["rest"]}).join(m, "_v", "left").join(n, ["_v", "_id"], "left")
    verdict = F.when(F.col("_ok").isNull(), "unknown_mount").when(~F.col("_ok"), "read_only").when(F.col("_there").isNull(), "no_such_node").otherwise("update")
    return out.select(*writes.columns, verdict.alias("verdict"))


def has_status(embeddings: DataFrame) -> bool:
    return "status" in embeddings.columns


def embedding_texts(nodes: DataFrame) -> DataFrame:
    """(node_id, text, hash) of active nodes; the id stands for an empty text."""
    text = embed_text("summary", "context")
    text = F.when(text == "", F.col("id")).otherwise(text)
    return nodes.where(is_active()).select(F.col("id").alias("node_id"), text.alias("text"), F.sha2(text, 256).alias("hash"))


def reembed(nodes: DataFrame, store: DataFrame, embed: Callable[[Column], Column], model: str, now: str, force: bool = False, guard: bool = False) -> DataFrame:
    """The store with every node embedded whose text changed (all of them, and nothing else kept, with
    ``force``). ``guard`` refuses a store that holds another model."""
    if guard and not store.where(F.col("model") != model).isEmpty():
        raise ValueError("the store holds another model")
    texts = embedding_texts(nodes)
    wanted = texts if force else texts.join(stale_embeddings(store, texts.select("node_id", "hash")), "node_id", "left_semi")
    fresh = wanted.select(
        "node_id", embed(F.col("text")).alias("embedding"), F.col("hash").alias("summary_hash"), F.lit(model).alias("model"), F.lit(now).cast("timestamp").alias("updated_at"), F.lit("active").alias("status")
    )
    return upsert_embeddings(store.limit(0) if force else store, fresh)


def routes_of(routes: DataFrame, asked: DataFrame) -> DataFrame:
    """(vault_id, path) for asked ids, null where no route is known; routes may be a table or one row with a map."""
    if "path" not in routes.columns:
        routes = routes.select(F.explode("routes").alias("vault_id", "path"))
    return asked.select("vault_id").join(routes.select("vault_id", "path"), "vault_id", "left")


def route_map(routes: DataFrame) -> DataFrame:
    """One row: the routes as a map."""
    return routes.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("vault_id", "path")))).alias("routes"))


def project_status(projects: DataFrame, state: DataFrame, nodes: DataFrame) -> DataFrame:
    """Catalog listing with state and node counts."""
    n = nodes.groupBy(F.col("vault_id")).agg(F.count("*").alias("nodes"))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    out = projects.join(state, "project_id", "left").join(n, "vault_id", "left")
    return out.select("project_id", "vault_id", "path", flag("active"), flag("editable"), flag("materialized"), F.coalesce("nodes", F.lit(0)).alias("nodes"))


def bridge_list(bridges: DataFrame) -> DataFrame:
    """Bridges with cross-vault ones, which both vaults list, once."""
    cross = (blank(F.col("source_vault_id")) != "") & (blank(F.col("target_vault_id")) != "")
    lo, hi = F.least("source_vault_id", "target_vault_id"), F.greatest("source_vault_id", "target_vault_id")
    key = F.when(cross, F.concat_ws("|", lo, hi)).otherwise(F.concat_ws("|", "source", "target", blank(F.col("target_vault_id"))))
    return bridges.withColumn("_k", key).groupBy("_k").agg(F.min_by(F.struct(*bridges.columns), F.struct("source", "target")).alias("b")).select("b.*")
