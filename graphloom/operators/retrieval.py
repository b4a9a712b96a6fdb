"""Exact nearest neighbours, heat-ordered traversal, and packing into a token budget."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import escape_html, qualified, quote, token_estimate
from graphloom.functions.vectors import Embedder, embed_column
from graphloom.operators.graph import first_by, near
from graphloom.schema import blank, is_active, normal_namespace
from graphloom.storage import broadcast_if_small, compact, file_bytes, materialize

FEW_BYTES = 64 << 10  # files of a frontier whose edges are put in order in one task
FEW_QUERIES = 4_096  # query vectors that travel with the tasks; more stream past dealt rows
FEW_QUERY_BYTES = 32 << 20  # of their vectors
SCAN_BLOCK = 128  # query vectors whose distances to a block of rows are held at once
SHARD_ROWS = 65_536
SIMILAR_CAP = 10


class _Block:
    """Rows to be searched: a matrix, ids, and the rows of every group ``by``."""

    def __init__(self, frame: pd.DataFrame, by: list[str]):
        self.X = _vectors(frame["embedding"])
        self.names = frame["node_id"].to_numpy()
        self.square = (self.X**2).sum(1)
        self.groups = [(key if isinstance(key, tuple) else (key,), at) for key, at in frame.groupby(by, sort=False).indices.items()] if by else [((), np.arange(len(frame)))]

    def best(self, ids: list, vectors: np.ndarray, keep: int | None, least: float | None, by: list[str]) -> pd.DataFrame:
        """The best rows of every group for each query, ties to the smaller id.

        Squared distances by a matrix product, whose rounding ``slack`` covers, only choose the rows to score."""
        out: list[tuple] = []
        for start in range(0, len(ids), SCAN_BLOCK):
            Q = vectors[start : start + SCAN_BLOCK]
            own = (Q**2).sum(1)
            far = self.square + own[:, None] - 2 * Q @ self.X.T
            for qid, q, norm, d in zip(ids[start : start + SCAN_BLOCK], Q, own, far):
                slack = 1e-9 * (1 + norm + self.square.max())
                for key, rows in self.groups:
                    near = rows
                    if keep is not None and len(rows) > keep:  # not below the last of the best, ties and odd numbers included
                        near = rows[~(d[rows] > np.partition(d[rows], keep - 1)[keep - 1] + slack)]
                    if least is not None and least > 0:
                        near = near[~(d[near] > max(1 / least - 1, 0) ** 2 + slack)]
                    score = 1 / (1 + np.sqrt(((self.X[near] - q) ** 2).sum(1)))
                    if least is not None:
                        near, score = near[score >= least], score[score >= least]
                    if keep is not None and len(near) > keep:
                        top = np.lexsort((self.names[near], -score))[:keep]
                        near, score = near[top], score[top]
                    if len(near):
                        out.append((key, qid, near, score))
        sizes = [len(o[2]) for o in out]
        frame = pd.DataFrame({c: np.repeat(np.array([o[0][i] for o in out], object), sizes) for i, c in enumerate(by)})
        frame["query_id"] = np.repeat(np.array([o[1] for o in out], object), sizes)
        frame["node_id"] = np.concatenate([self.names[o[2]] for o in out]) if out else np.zeros(0, object)
        frame["score"] = np.concatenate([o[3] for o in out]) if out else np.zeros(0)
        return frame


def _vectors(column) -> np.ndarray:
    return np.array([np.asarray(v, np.float64) for v in column])


def _scan(asked: dict, keep: int | None, least: float | None, by: list[str]):
    """Score the rows where they lie, against the queries that came with the task: of each model (or none) and width."""

    def run(batches):
        for batch in batches:
            batch = batch[batch["embedding"].notna()]
            width = batch["embedding"].map(len)
            for (model, dim), (ids, vectors) in asked.items():
                rows = batch[(width == dim) & ((batch["matched"] == model) if model is not None else True)]
                if len(rows):
                    yield _Block(rows, by).best(ids, vectors, keep, least, by)

    return run


def _stream(keep: int | None, least: float | None, by: list[str]):
    """Rows come by shard, model and length, first those to be searched, then the queries, which stream by."""

    def run(batches):
        key, held, block = None, [], None
        for batch in batches:
            for (shard, model, dim, asks), part in batch.groupby(["shard", "matched", "dim", "asks"], sort=True):
                if (shard, model, dim) != key:
                    key, held, block = (shard, model, dim), [], None
                if not asks:
                    held.append(part)
                elif held or block:
                    if block is None:
                        block, held = _Block(pd.concat(held), by), []
                    yield block.best(part["query_id"].tolist(), _vectors(part["embedding"]), keep, least, by)

    return run


def search(
    embeddings: DataFrame, queries: DataFrame, k: int | None = 10, least: float | None = None, model: str | None = None,
    only_active: bool = False, by: list[str] | None = None, strict: bool = False,
) -> DataFrame:
    """(by..., query_id, node_id, score, rank): the ``k`` best rows per query (and group ``by``),
    score 1 / (1 + L2), ties to the smaller id; with ``least`` only scores from there on.

    Queries with a ``model`` meet rows of that model only, so that one question can have a vector for each model
    (``query_vectors``); its best rows are then those of all of them. Few queries travel with the tasks, and rows are scored
    where they lie. Many (by number or bytes) are dealt: the rows go once to shards of about 65536, and every query streams past
    each shard, in blocks. Either way only each part's best rows are shuffled. ``strict`` raises on a row of another model or
    dimension; otherwise other models are left out."""
    by = by or []
    spark = embeddings.sparkSession
    if strict and model is not None and not embeddings.where(F.col("model") != model).isEmpty():
        raise ValueError(f"the store holds rows of other models than {model!r}")
    rows = embeddings.where(is_active()) if only_active else embeddings
    rows = rows.where(F.col("model") == model) if model is not None else rows
    keyed = "model" in queries.columns
    matched = (F.coalesce("model", F.lit("")) if keyed else F.lit("")).alias("matched")
    rows = rows.withColumn("matched", matched)
    asked = queries.where(F.size("embedding") > 0).select("query_id", "embedding", matched)
    if strict:
        widths = [r[0] for r in asked.select(F.size("embedding")).distinct().limit(2).collect()]
        if len(widths) > 1 or widths and not rows.where(F.size("embedding") != widths[0]).isEmpty():
            raise ValueError(f"the store holds vectors of other dimensions than {widths}")
    types = dict(embeddings.dtypes)
    kind = dict(queries.dtypes)["query_id"]
    schema = ", ".join([f"{c} {types[c]}" for c in by] + [f"query_id {kind}", f"node_id {types['node_id']}", "score double"])
    extent = asked.agg(F.count("*"), F.sum(8 * F.size("embedding"))).first()
    if extent[0] <= FEW_QUERIES and (extent[1] or 0) <= FEW_QUERY_BYTES:
        sets: dict = {}
        for r in asked.collect():
            sets.setdefault((r["matched"] if keyed else None, len(r["embedding"])), []).append(r)
        sets = {key: ([r["query_id"] for r in some], _vectors(r["embedding"] for r in some)) for key, some in sorted(sets.items(), key=str)}
        out = rows.select(*by, "node_id", "embedding", "matched").mapInPandas(_scan(sets, k, least, by), schema) if sets else spark.createDataFrame([], schema)
    else:
        n = rows.count()
        shards = max(1, -(-n // SHARD_ROWS), min(spark.sparkContext.defaultParallelism, n // 2048))
        none = [F.lit(None).cast(types[c]).alias(c) for c in by]
        store = rows.where(F.size("embedding") > 0).select(
            *by, "node_id", F.lit(None).cast(kind).alias("query_id"), "embedding", "matched", F.lit(False).alias("asks"), F.pmod(F.xxhash64("node_id"), F.lit(shards)).cast("int").alias("shard"))
        every = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
        asking = asked.select(*none, F.lit(None).cast(types["node_id"]).alias("node_id"), "query_id", "embedding", "matched", F.lit(True).alias("asks"), every.alias("shard"))
        dealt = store.unionByName(asking).withColumn("dim", F.size("embedding"))
        dealt = dealt.repartitionById(shards, "shard").sortWithinPartitions("shard", "matched", "dim", "asks")
        out = dealt.mapInPandas(_stream(k, least, by), schema)
    w = Window.partitionBy(*by, "query_id").orderBy(F.desc("score"), "node_id")
    ranked = out.withColumn("rank", F.row_number().over(w))
    return ranked.where(F.col("rank") <= k) if k is not None else ranked


def query_vectors(texts: DataFrame, models: list[str], embedders: Mapping[str, Embedder]) -> DataFrame:
    """(query_id, model, embedding): every text (query_id, text) with a vector of each distinct model.

    A vault that was embedded with a model is asked with that model's vector. ``embedders`` has one per model; models without
    one get no vector, so that their vaults are left out instead of being asked in a space that is not theirs."""
    out = None
    for name in sorted(set(models) & set(embedders)):
        part = texts.select("query_id", F.lit(name).alias("model"), embed_column(F.coalesce("text", F.lit("")), embedders[name]).alias("embedding"))
        out = part if out is None else out.unionByName(part)
    return texts.select("query_id", F.lit("").alias("model"), F.array().cast("array<float>").alias("embedding")).limit(0) if out is None else out


def find_similar(embeddings: DataFrame, queries: DataFrame, least: float, model: str | None = None) -> DataFrame:
    """Active rows from a score on, at most ten."""
    return search(embeddings, queries, SIMILAR_CAP, least, model, only_active=True)


def dedupe_rank(hits: DataFrame, limit: int = 10) -> DataFrame:
    """Best hit per query and id, best first, at most ``limit``."""
    best = first_by(hits, ["query_id", "node_id"], F.desc("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "node_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def federated(embeddings: DataFrame, queries: DataFrame, local: str = "", k_local: int = 5, k_remote: int = 3, limit: int = 10,
              model: str | None = None, only_active: bool = True) -> DataFrame:
    """Five hits of the local vault and three of every other, remote ids qualified, best ten by query.

    Vaults of several models are asked with ``query_vectors``: each with the vector of its own model."""
    hits = search(embeddings, queries, max(k_local, k_remote), model=model, only_active=only_active, by=["vault_id"])
    here = F.col("vault_id") == local
    hits = hits.where(F.col("rank") <= F.when(here, k_local).otherwise(k_remote))
    named = hits.withColumn("node_id", F.when(here, F.col("node_id")).otherwise(qualified("vault_id", "node_id")))
    return dedupe_rank(named.drop("rank"), limit)


def api_search(embeddings: DataFrame, queries: DataFrame, nodes: DataFrame, limit: int = 10, namespace: str | None = None,
               model: str | None = None, others: DataFrame | None = None) -> DataFrame:
    """(query_id, node_id, score, rank, type, summary, namespace): the best rows of the store, superseded ones
    included, and of other vaults (``others``: an embedding table with vault_id, ids qualified), each id once. The limit comes before
    the namespace, so that a filtered answer may be shorter; hits without a node are left out."""
    hits = search(embeddings, queries, limit, model=model).drop("rank")
    if others is not None:
        more = search(others, queries, limit, model=model, by=["vault_id"])
        hits = hits.unionByName(more.withColumn("node_id", qualified("vault_id", "node_id")).drop("rank", "vault_id"))
    best = dedupe_rank(hits, limit)
    found = best.join(nodes.select(F.col("id").alias("node_id"), "type", "summary", "namespace"), "node_id")
    if namespace:
        found = found.where(normal_namespace() == namespace)
    return found.select("query_id", "node_id", "score", "rank", "type", "summary", "namespace")


def _warm(found: DataFrame, heat: DataFrame) -> DataFrame:
    """Arrivals with the heat of the pair they came over (its largest, if it repeats). They are few: the heat table is cut to their
    pairs where it lies, so that it is never shuffled whole."""
    keyed = found.withColumn("a", F.least("src", "id")).withColumn("b", F.greatest("src", "id"))
    few = broadcast_if_small(materialize(keyed.select("a", "b").distinct(), "arrived"))
    near = heat.join(few, ["a", "b"], "left_semi").groupBy("a", "b").agg(F.max("weight").alias("heat"))
    return keyed.join(near, ["a", "b"], "left").drop("a", "b").withColumn("heat", F.coalesce("heat", F.lit(0.0)))


def _leaving(front: DataFrame, edges: DataFrame) -> DataFrame:
    """The edges that leave the frontier, with the ``parent``'s place and the position in its list: that of
    the table, or (for a table without) by relation and target."""
    ids = front.select("query_id", F.col("id").alias("src"), F.col("place").alias("parent"))
    own = near(edges, ids.select("src"), "src")
    own = (own.repartition(1) if file_bytes(front) <= FEW_BYTES else own).join(ids, "src")
    if "ord" in edges.columns:
        return own.select("query_id", "src", "dst", "parent", "ord")
    listed = Window.partitionBy("query_id", "src").orderBy("relation", "dst")
    return own.select("query_id", "src", "dst", "parent", (F.row_number().over(listed) - 1).alias("ord"))


def traverse(nodes: DataFrame, edges: DataFrame, entries: DataFrame, heat: DataFrame | None = None, depth: int = 2,
             include_inactive: bool = False, mode: str = "adjacency") -> DataFrame:
    """(query_id, id, depth, is_entry, ord): nodes reached from the entries along out-edges.

    The first arrival sets the depth. Within a level, hotter arrivals come first, then the order of
    the parent and its edges; ``ord`` numbers the result, entries first. Inactive nodes are not
    emitted and not walked through (unless included); missing targets neither. ``mode`` is accepted
    and has no effect. Edges need no ``ord``: only those that leave a frontier are put in order, and the
    frontier reaches their scan as a semi join.

    A node's place in its level is an array that sorts like the order: its coolness, its parent's place and the
    position of the edge. So a level is an aggregate without a window; only the result is numbered."""
    usable = nodes if include_inactive else nodes.where(is_active())
    ids = usable.select("id")
    if "query_id" not in entries.columns:
        entries = entries.withColumn("query_id", F.lit(0))
    rank = F.col("rank") if "rank" in entries.columns else F.lit(0)
    w = Window.partitionBy("query_id")
    asked = compact(materialize(entries.select("query_id", "id", rank.alias("r")).groupBy("query_id", "id").agg(F.min("r").alias("r")), "entries"))
    front = near(ids, asked.select("id"), "id").distinct().join(asked, "id")
    place = F.array(F.row_number().over(w.orderBy("r", "id")).cast("double"))
    front = compact(materialize(front.select("query_id", "id", F.lit(0).alias("depth"), place.alias("place")), "traverse"))
    seen = front
    for level in range(1, depth + 1):
        found = _leaving(front, edges).withColumnRenamed("dst", "id").join(seen.select("query_id", "id"), ["query_id", "id"], "left_anti")
        found = found.groupBy("query_id", "id").agg(F.min(F.struct("parent", "ord", "src")).alias("first"))
        found = compact(materialize(found.select("query_id", "id", "first.*"), "arrivals"))
        found = found.join(near(ids, found.select("id"), "id"), "id", "left_semi")
        found = found.withColumn("heat", F.lit(0.0)) if heat is None else _warm(found, heat)
        place = F.concat(F.array(-F.col("heat")), "parent", F.array(F.col("ord").cast("double")))
        front = compact(materialize(found.select("query_id", "id", F.lit(level).alias("depth"), place.alias("place")), "traverse"))
        seen = seen.unionByName(front)
        if level < depth and front.isEmpty():
            break
    order = w.orderBy("depth", "place", "id")
    return seen.select("query_id", "id", "depth", (F.col("depth") == 0).alias("is_entry"), F.row_number().over(order).alias("ord"))


def _tag(name: str, text: Column) -> Column:
    return F.concat(F.lit(f"    <{name}>"), escape_html(text), F.lit(f"</{name}>\n"))


def render(sub: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``sub`` with ``part`` and ``kind``: full elements for entries, compact ones for the rest."""
    sub = compact(materialize(sub, "found"))
    own = near(edges, sub.where("is_entry").select("id"), "src")
    if "ord" not in edges.columns:
        own = own.withColumn("ord", F.row_number().over(Window.partitionBy("src").orderBy("relation", "dst")))
    lists = own.withColumn("line", F.concat(F.lit("      <edge target="), quote("dst"), F.lit(" relation="), quote("relation"), F.lit("/>\n")))
    lists = lists.groupBy(F.col("src").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), "").alias("listed"))
    full = sub.join(near(nodes.drop("ord"), sub.select("id"), "id"), "id").join(lists, "id", "left")
    open_ = lambda tag: F.concat(
        F.lit(f"  <{tag} id="), quote("id"), F.lit(" type="), quote("type"), F.lit(' depth="'), F.col("depth").cast("string"), F.lit('" status='),
        quote(F.when(blank(F.col("status")) == "", "active").otherwise(F.col("status"))), F.lit(">\n"), _tag("summary", F.col("summary")),
        F.when(blank(F.col("superseded_by")) != "", _tag("superseded_by", F.col("superseded_by"))).otherwise(""),
    )
    context = F.when(blank(F.col("context")) != "", F.concat(F.lit('    <context language="">'), escape_html("context"), F.lit("</context>\n"))).otherwise("")
    listed = F.when(F.col("listed").isNotNull(), F.concat(F.lit("    <edges>\n"), "listed", F.lit("    </edges>\n"))).otherwise("")
    first, last = F.coalesce(F.try_element_at("source.lines", F.lit(1)), F.lit(0)), F.coalesce(F.try_element_at("source.lines", F.lit(2)), F.lit(0))
    span = F.when((first != 0) | (last != 0), F.concat(F.lit(' lines="'), first.cast("string"), F.lit("-"), last.cast("string"), F.lit('"'))).otherwise("")
    source = F.when(blank(F.col("source.path")) != "", F.concat(F.lit("    <source path="), quote("source.path"), span, F.lit("/>\n"))).otherwise("")
    part = F.when(F.col("is_entry"), F.concat(open_("node"), listed, context, F.lit("  </node>\n"))).otherwise(
        F.concat(open_("node_compact"), source, F.lit("  </node_compact>\n"))
    )
    return full.select(*sub.columns, part.alias("part"), F.when(F.col("is_entry"), "full").otherwise("compact").alias("kind"))


STRETCH_ROWS = 100_000  # parts of a stretch of the lists


def _runs(batches):
    """Arrow batches (list, ord, bytes) cut where the list changes, each with whether a list begins with it."""
    key = object()
    for batch in batches:
        names = batch.column(0).to_pylist()
        edges = [i for i in range(len(names)) if i == 0 or names[i] != names[i - 1]] + [len(names)]
        for s, e in zip(edges, edges[1:]):
            if e > s:
                yield names[s] != key, batch.slice(s, e - s)
                key = names[s]


def _may_fit(room: int):
    """Drop the parts of a stretch of a list that cannot be included.

    Room only shrinks, so a part is included only if every earlier one of at most its size is too: those must fit with
    it. Sums of earlier parts up to 64 sizes bound that from below."""

    def run(batches):
        sums = sizes = None
        for new, part in _runs(batches):
            n = part.column("bytes").to_numpy().astype(np.int64)
            if new or sums is None:
                sizes = np.unique(np.quantile(n, np.linspace(0, 1, 64), method="lower"))
                sums = np.zeros(len(sizes), np.int64)
            level = np.searchsorted(sizes, n, "right") - 1  # the largest of the sizes that is not above it
            good = np.ones(len(n), bool)
            for k, size in enumerate(sizes):
                before = sums[k] + np.cumsum(np.where(n <= size, n, 0))
                here = level == k
                good[here] = before[here] - np.where(n[here] <= size, n[here], 0) + n[here] <= room
                sums[k] = before[-1]
            if good.any():
                yield part.filter(pa.array(good))

    return run


def _fill(room: int):
    """First fit over the parts of each list in order."""

    def run(batches):
        used = 0
        for new, part in _runs(batches):
            used = 0 if new else used
            taken = []
            for i, n in enumerate(part.column("bytes").to_pylist()):
                if used + n <= room:
                    used += n
                    taken.append(i)
            if taken:
                yield part.take(pa.array(taken)).select([0, 1])

    return run


def pack(parts: DataFrame, budget: int, reserve: int = 120, by: str = "query_id") -> DataFrame:
    """``parts`` with ``bytes`` and ``included``: first fit in the order of ``ord``. A part too large is
    skipped and later ones may still fit, so this is a fold, not a running sum.

    It runs over (ord, bytes) only; texts stay out. Long lists are cut into stretches first, each of which drops the parts
    that cannot be included whatever came before, in parallel; the few that are left are then filled in, list by list."""
    room = max(budget * 4, reserve) - reserve
    sized = parts.withColumn("bytes", F.octet_length("part").cast("int"))
    rest = materialize(sized.where(F.col("bytes") <= room).select(by, F.col("ord").cast("bigint").alias("ord"), "bytes"), "pack")
    kind = dict(parts.dtypes)[by]
    stretches = -(-rest.count() // STRETCH_ROWS)
    if stretches > 1:
        some = rest.repartitionByRange(stretches, by, "ord").sortWithinPartitions(by, "ord")
        rest = some.mapInArrow(_may_fit(room), f"{by} {kind}, ord bigint, bytes int")
    taken = rest.repartition(by).sortWithinPartitions(by, "ord").mapInArrow(_fill(room), f"{by} {kind}, ord bigint")
    taken = materialize(taken.select(F.col(by).alias("_by"), F.col("ord").alias("_ord"), F.lit(True).alias("_in")), "pack-taken")
    both = sized.join(broadcast_if_small(taken), F.col(by).eqNullSafe(F.col("_by")) & (F.col("ord") == F.col("_ord")), "left")
    return both.withColumn("included", F.coalesce("_in", F.lit(False))).drop("_by", "_ord", "_in")


EMPTY = '<context_result tokens="0" nodes="0">\n</context_result>'


def document(packed: DataFrame, by: str = "query_id") -> DataFrame:
    """(query_id, xml, tokens, nodes, truncated): full parts, compact parts, then what did not fit."""
    pick = lambda cond, value: F.transform(
        F.array_sort(F.collect_list(F.when(cond, F.struct("ord", value)))), lambda x: x[value]
    )
    grouped = packed.groupBy(by).agg(
        F.array_join(pick(F.col("included") & (F.col("kind") == "full"), "part"), "").alias("full"),
        F.array_join(pick(F.col("included") & (F.col("kind") == "compact"), "part"), "").alias("compact"),
        pick(~F.col("included"), "id").alias("truncated"), F.count_if("included").alias("nodes"),
    )
    refs = F.array_join(F.transform("truncated", lambda i: F.concat(F.lit("    <node_ref id="), quote(i), F.lit(' reason="budget"/>\n'))), "")
    body = F.concat("full", "compact")
    xml = F.concat(
        F.lit('<context_result tokens="'), token_estimate(body).cast("string"), F.lit('" nodes="'), F.col("nodes").cast("string"), F.lit('">\n'), body,
        F.when(F.size("truncated") > 0, F.concat(F.lit("  <truncated>\n"), refs, F.lit("  </truncated>\n"))).otherwise(""), F.lit("</context_result>"),
    )
    return grouped.select(by, xml.alias("xml"), token_estimate(xml).alias("tokens"), "nodes", "truncated")


def context_query(nodes: DataFrame, edges: DataFrame, embeddings: DataFrame, query: DataFrame, heat: DataFrame | None = None, k: int = 5,
                  depth: int = 2, budget: int = 4096, include_superseded: bool = False, model: str | None = None) -> DataFrame:
    """(query_id, ord, id, depth, kind, bytes, included): search, expand, pack."""
    hits = search(embeddings, query, k, model=model, only_active=not include_superseded)
    sub = traverse(nodes, edges, hits.select("query_id", F.col("node_id").alias("id"), "rank"), heat, depth, include_superseded)
    return pack(compact(materialize(render(sub, nodes, edges), "parts")), budget)  # read twice


def co_access(entries: DataFrame) -> DataFrame:
    """(query_id, node_id) rows that a query feeds back into the heat statistics."""
    return entries.select("query_id", F.col("id").alias("node_id"))


