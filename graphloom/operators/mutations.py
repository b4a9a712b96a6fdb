"""Writes, curation commands and undo; every change gives new tables."""

from __future__ import annotations

import shlex
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.graph import edges_of, upsert, would_cycle
from graphloom.schema import ACTIVE, CURATOR_TYPES, RELATIONS, STRUCTURAL_RELATIONS, SUPERSEDED, is_active, normal_namespace
from graphloom.storage import broadcast_if_small, distinct_rows, materialize

UNDO_CAP, MUTATION_CAP, BULK_LEAST = 50, 50, 5

_LIST = "array<string>"


def _where(hit: Column, name: str, value) -> Column:
    return F.when(hit, value).otherwise(F.col(name)).alias(name)


def _change(nodes: DataFrame, hit: Column, **values) -> DataFrame:
    return nodes.select(*[_where(hit, c, values[c]) if c in values else F.col(c) for c in nodes.columns])


def tag(nodes: DataFrame, ids: Column, *tags: str) -> DataFrame:
    """Append tags that are not there yet, keeping order."""
    have = F.coalesce("tags", F.array().cast(_LIST))
    return _change(nodes, ids, tags=F.array_union(have, F.array(*map(F.lit, tags))))


def untag(nodes: DataFrame, ids: Column, *tags: str) -> DataFrame:
    return _change(nodes, ids, tags=F.filter("tags", lambda t: ~t.isin(*tags)))


def set_type(nodes: DataFrame, ids: Column, kind: str) -> DataFrame:
    if kind not in CURATOR_TYPES:
        raise ValueError(f"unknown type {kind!r}")
    return _change(nodes, ids, type=F.lit(kind))


def tag_hits(nodes: DataFrame, hits: DataFrame, *tags: str, namespace: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, ids): what a search found (``hits``: node_id) gets the tags; ids that have them count as well."""
    found = nodes.where(normal_namespace() == namespace) if namespace else nodes
    found = found.join(hits.select(F.col("node_id").alias("id")).distinct(), "id", "left_semi").select("id")
    marked = nodes.join(found.withColumn("_hit", F.lit(True)), "id", "left")
    return tag(marked, F.coalesce("_hit", F.lit(False)), *tags).select(nodes.columns), found


def delete(nodes: DataFrame, ids: Column, now: str, by: str | None = None) -> DataFrame:
    """Soft: active nodes become superseded as of now."""
    hit = ids & is_active()
    return _change(nodes, hit, status=F.lit(SUPERSEDED), valid_until=F.lit(now), superseded_by=F.lit(by) if by else F.col("superseded_by"))


def retire_embeddings(embeddings: DataFrame, ids: DataFrame) -> DataFrame:
    """Take rows of deleted nodes out of active searches (the delete tool does, the curation command does not)."""
    gone = ids.select(F.col("id").alias("node_id"), F.lit(True).alias("gone")).distinct()
    out = embeddings.join(gone, "node_id", "left")
    return out.withColumn("status", F.when(F.col("gone"), SUPERSEDED).otherwise(F.col("status"))).select(embeddings.columns)


def hard_delete(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    return nodes.join(ids.select("id"), "id", "left_anti")


def merge(nodes: DataFrame, a: str, b: str, now: str) -> DataFrame:
    """Merge b into a: a gets b's edges (but none to a that b had) and tags, edges of others to b go
    to a without doubling, b is superseded by a. An edge of a to b stays."""
    kind = "array<struct<target:string,relation:string>>"
    row = nodes.where(F.col("id") == b).select("edges", "tags").first()
    if row is None or nodes.where(F.col("id") == a).isEmpty():
        raise ValueError("both nodes must exist")
    pairs = [e for e in (row["edges"] or []) if e["target"] != a]
    more = F.array(*[F.struct(F.lit(e["target"]).alias("target"), F.lit(e["relation"]).alias("relation")) for e in pairs]).cast(kind)
    tags = F.array(*map(F.lit, row["tags"] or [])).cast(_LIST)
    own = F.coalesce("edges", F.array().cast(kind))
    turned = F.array_distinct(F.transform(own, lambda e: F.struct(F.when(e["target"] == b, a).otherwise(e["target"]).alias("target"), e["relation"].alias("relation"))))
    is_a, is_b = F.col("id") == a, F.col("id") == b
    inbound = ~is_a & ~is_b & F.exists(own, lambda e: e["target"] == b)
    edges = F.when(is_a, F.array_union(own, more)).when(inbound, turned).otherwise(F.col("edges"))
    out = nodes.withColumn("edges", edges).withColumn("tags", F.when(is_a, F.array_union(F.coalesce("tags", F.array().cast(_LIST)), tags)).otherwise(F.col("tags")))
    return _change(out, is_b, status=F.lit(SUPERSEDED), superseded_by=F.lit(a), valid_until=F.lit(now)).select(nodes.columns)


def merge_edges(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Many merges at once on an edge table: ends that are ``b`` of a pair become its ``a``; self loops
    that this makes go, equal edges are one."""
    m = materialize(pairs.select(F.col("b").alias("k"), F.col("a").alias("to")), "merges")  # a few of the ids: edges stay where they are
    to = lambda k, v: broadcast_if_small(m.toDF(k, v))
    out = edges.select("src", "dst", "relation").join(to("src", "s"), "src", "left").join(to("dst", "d"), "dst", "left")
    moved = F.col("s").isNotNull() | F.col("d").isNotNull()
    out = out.select(F.coalesce("s", "src").alias("src"), F.coalesce("d", "dst").alias("dst"), "relation", moved.alias("moved"))
    return distinct_rows(out.where(~(F.col("moved") & (F.col("src") == F.col("dst")))).select("src", "dst", "relation"), edges)


def link(nodes: DataFrame, src: str, dst: str, relation: str) -> DataFrame:
    """Add an edge; a structural one must not close a cycle. An edge that is there is not doubled."""
    if relation not in RELATIONS:
        raise ValueError(f"unknown relation {relation!r}")
    if relation in STRUCTURAL_RELATIONS:
        pair = nodes.sparkSession.createDataFrame([(src, dst)], "src string, dst string")
        if src == dst or would_cycle(edges_of(nodes), pair).first()["cycle"]:
            raise ValueError("the edge closes a structural cycle")
    new = F.array(F.struct(F.lit(dst).alias("target"), F.lit(relation).alias("relation")))
    return _change(nodes, F.col("id") == src, edges=F.when(F.col("edges").isNull(), new).otherwise(F.array_union("edges", new)))


def unlink(nodes: DataFrame, src: str, dst: str) -> DataFrame:
    """Remove the first edge from src to dst."""
    at = F.array_position(F.transform("edges", lambda e: e["target"]), dst).cast("int")
    cut = F.filter("edges", lambda e, i: i + 1 != at)
    return _change(nodes, (F.col("id") == src) & (at > 0), edges=cut)


def write(nodes: DataFrame, new: DataFrame, now: str, namespace: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Write nodes: ids and local targets get the namespace as prefix, edges are those given, tags stay
    if none are given, valid_from is set on new ids only. Returns (nodes, id and status per row)."""
    if namespace:
        lead = lambda c: F.when(c.startswith("@") | c.startswith(f"{namespace}/"), c).otherwise(F.concat(F.lit(f"{namespace}/"), c))
        new = new.withColumn("id", lead(F.col("id"))).withColumn(
            "edges", F.transform("edges", lambda e: F.struct(lead(e["target"]).alias("target"), e["relation"].alias("relation")))
        )
    old = nodes.select("id", F.col("tags").alias("old_tags"), F.lit(True).alias("known"))
    both = new.join(old, "id", "left")
    fresh = F.col("known").isNull()
    both = both.withColumn("tags", F.when(F.size(F.coalesce("tags", F.array().cast(_LIST))) == 0, F.col("old_tags")).otherwise(F.col("tags")))
    both = both.withColumn("valid_from", F.when(fresh, F.lit(now))).withColumn("status", F.lit(ACTIVE))
    report = both.select("id", F.when(fresh, "created").otherwise("updated").alias("result"))
    return upsert(nodes, both.select(nodes.columns)), report


def patch(nodes: DataFrame, id_: str, **fields) -> tuple[DataFrame, bool]:
    """Partial update of summary, context or tags; True if the node must be embedded again."""
    values = {k: (F.array(*map(F.lit, v)).cast(_LIST) if k == "tags" else F.lit(v)) for k, v in fields.items() if k in ("summary", "context", "tags")}
    return _change(nodes, F.col("id") == id_, **values), bool({"summary", "context"} & values.keys())


def upsert_embeddings(store: DataFrame, new: DataFrame, dimension: int | None = None, checked: bool = False, keep_status: bool = False) -> DataFrame:
    """Latest row wins. ``checked`` refuses a second model; ``keep_status`` leaves an old status as it
    was (a superseded row stays hidden), by default a rewritten row is active."""
    if dimension and not new.where(F.size("embedding") != dimension).isEmpty():
        raise ValueError(f"vectors must have {dimension} components")
    if checked and store.select("model").union(new.select("model")).distinct().limit(2).count() > 1:
        raise ValueError("the store would mix models")
    fresh = new.drop("status").join(store.select("node_id", F.col("status").alias("status")), "node_id", "left") if keep_status else new
    fresh = fresh.withColumn("status", F.coalesce("status", F.lit(ACTIVE)))
    return store.join(new.select("node_id"), "node_id", "left_anti").select(store.columns).unionByName(fresh.select(store.columns))


def stale_embeddings(store: DataFrame, hashes: DataFrame) -> DataFrame:
    """Ids whose stored summary hash is missing or differs (hashes: node_id, hash)."""
    both = hashes.join(store.select("node_id", "summary_hash"), "node_id", "left")
    return both.where(~F.col("hash").eqNullSafe(F.col("summary_hash"))).select("node_id")


def bulk_limit(active: int) -> int:
    """Distinct nodes that one run may change unless bulk changes are allowed."""
    return max(BULK_LEAST, active // 2)


def snapshots(nodes: DataFrame, ids: DataFrame, session: str, seq: int) -> DataFrame:
    """Pre-images for undo; ids that do not exist yet have existed = false."""
    image = nodes.select("id", F.to_json(F.struct(*nodes.columns)).alias("image"))
    return ids.select("id").distinct().join(image, "id", "left").select(
        F.lit(session).alias("session"), F.lit(seq).alias("seq"), "id", F.col("image").isNotNull().alias("existed"), "image"
    )


def undo_stack(log: DataFrame, cap: int = UNDO_CAP) -> DataFrame:
    """The last entries of every session, newest first."""
    w = Window.partitionBy("session").orderBy(F.desc("seq"))
    return log.withColumn("depth", F.row_number().over(w)).where(F.col("depth") <= cap)


def undo_depth(log: DataFrame) -> DataFrame:
    return log.groupBy("session").agg(F.least(F.count_distinct("seq"), F.lit(UNDO_CAP)).alias("depth"))


def restore(nodes: DataFrame, entry: DataFrame) -> DataFrame:
    """Put back the pre-images of one undo entry."""
    back = entry.where("existed").select(F.from_json("image", nodes.schema).alias("n")).select("n.*")
    return nodes.join(entry.select("id"), "id", "left_anti").select(nodes.columns).unionByName(back.select(nodes.columns))


def affected(edges: DataFrame, args: DataFrame, selection: DataFrame | None = None) -> DataFrame:
    """Ids that a command touches: arguments, selection, and sources of edges into the arguments."""
    out = args.select("id").union(edges.join(args.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id")))
    return (out.union(selection.select("id")) if selection is not None else out).distinct()


def tokenize(command: str) -> list[str]:
    """Words of a command line; double quotes hold words together."""
    lexer = shlex.shlex(command, posix=True)
    lexer.whitespace_split, lexer.quotes, lexer.commenters, lexer.escape = True, '"', "", ""
    return list(lexer)


_NAMED = {"/delete": None, "/merge": 2, "/link": 1, "/unlink": 1}  # how many arguments are ids that a command changes
_VERBS = {"/tag", "/untag", "/type", *_NAMED}


@dataclass
class Curator:
    """Slash commands over a graph, with undo and the guard on bulk changes."""

    nodes: DataFrame
    now: str
    session: str = "default"
    allow_bulk: bool = False
    log: list[tuple[DataFrame, str]] = field(default_factory=list)
    touched: set[str] = field(default_factory=set)

    def run(self, command: str, selection: tuple[str, ...] = ()) -> DataFrame:
        """Apply /tag, /untag, /type, /merge, /delete, /link, /unlink; /verify returns the issues."""
        verb, *args = tokenize(command)
        if verb == "/verify":
            from graphloom.operators.integrity import integrity

            return integrity(self.nodes)
        ids = set(selection) | set(args[: _NAMED.get(verb, 0)])
        n = self.nodes
        # before a condition is made of the ids: of too many nodes there is none
        if verb in _VERBS and len(self.log) < MUTATION_CAP and not self.allow_bulk and len(self.touched | ids) > bulk_limit(n.where(is_active()).count()):
            self.touched |= ids
            raise RuntimeError("too many nodes for one run without allow_bulk")
        match verb:
            case "/tag":
                new = tag(n, F.col("id").isin(*ids), *args)
            case "/untag":
                new = untag(n, F.col("id").isin(*ids), *args)
            case "/type":
                new = set_type(n, F.col("id").isin(*ids), args[0])
            case "/delete":
                new = delete(n, F.col("id").isin(*ids), self.now)
            case "/merge":
                new = merge(n, args[0], args[1], self.now)
            case "/link":
                new = link(n, args[0], args[1], args[2] if len(args) > 2 else "references")
            case "/unlink":
                new = unlink(n, args[0], args[1])
            case _:
                raise ValueError(f"unknown command {verb!r}")
        self.touched |= ids
        if len(self.log) >= MUTATION_CAP:
            raise RuntimeError(f"more than {MUTATION_CAP} changes in one run")
        self.log.append((n, command))
        self.log = self.log[-UNDO_CAP:]
        self.nodes = new
        return new

    def undo(self) -> DataFrame:
        if not self.log:
            raise RuntimeError("nothing to undo")
        self.nodes, _ = self.log.pop()
        return self.nodes


