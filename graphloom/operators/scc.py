"""Strongly connected components, topological levels, and batches of questions whether an edge closes a cycle.

Long unbranched paths are one vertex first, joined where their edges lie and then by doubling pointers, so that rounds follow the branching of a
graph instead of its longest path. All tables are edges or labels; nothing is kept by pair of vertices."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.components import CHUNK_BYTES, CHUNK_ROWS
from graphloom.storage import broadcast_if_small, discard, materialize

TRIM = 0.1  # trimming goes on while a round takes away at least this share of the edges
BITS = 63  # questions that are searched together, one bit each


def _plain(edges: DataFrame) -> DataFrame:
    """Distinct edges between different known ids."""
    return edges.where(F.col("src") != F.col("dst")).select("src", "dst").distinct()


def _once(edges: DataFrame) -> DataFrame:
    """Distinct edges between different known ids, as a table. Without repeats the rows stay where they lie: different
    hashes, as many as rows, are the proof."""
    some = materialize(edges.where(F.col("src") != F.col("dst")).select("src", "dst"), "scc-edges")
    if some.select(F.xxhash64("src", "dst")).distinct().count() == some.count():
        return some
    return materialize(some.distinct(), "scc-edges")


def _chains(most: int):
    """Unbranched edges (src, dst, n), a chunk at a time, as (id, at, pos): the first vertex of the chunk that leads to each
    target, and how far. Edges of a ring that lies in the chunk stay as they are."""

    def chain(held):
        ids = pa.concat_arrays([b.column(0) for b in held] + [b.column(1) for b in held]).dictionary_encode()
        ends, n = ids.indices.to_numpy(), np.concatenate([b.column(2).to_numpy() for b in held])
        a, b, size = ends[: len(n)], ends[len(n) :], len(ids.dictionary)
        at, pos, root = np.arange(size), np.zeros(size, np.int64), np.ones(size, bool)
        at[b], pos[b], root[b] = a, n, False
        for _ in range(size.bit_length()):
            if root[at].all():
                break
            at, pos = at[at], pos + pos[at]
        good = root[at[b]]
        names = lambda i: ids.dictionary.take(pa.array(i))
        out = pa.table({"id": names(b), "at": names(np.where(good, at[b], a)), "pos": np.where(good, pos[b], n)})
        return out.to_batches(max_chunksize=1 << 16)

    def run(batches):
        held, rows, size = [], 0, 0
        for batch in batches:
            held.append(batch)
            rows, size = rows + batch.num_rows, size + batch.nbytes
            if rows >= most or size >= CHUNK_BYTES:
                yield from chain(held)
                held, rows, size = [], 0, 0
        if rows:
            yield from chain(held)

    return run


def _doubled(links: DataFrame) -> DataFrame:
    """(id, path, pos, ring) of pointers (id, at, pos): where each chain of them begins, and how far that is; or the smallest
    id of a ring.

    Each round doubles how far a vertex sees back; those that see the beginning are not written again."""
    open_ = links.withColumn("low", F.least("id", "at"))
    n, done = links.count(), links.limit(0).withColumn("low", F.col("id"))
    for _ in range(math.ceil(math.log2(n + 1)) + 1 if n else 0):
        ahead = done.unionByName(open_).select(F.col("id").alias("at"), F.col("at").alias("at2"), F.col("pos").alias("pos2"), F.col("low").alias("low2"))
        step = open_.join(ahead, "at", "left").select("id", F.coalesce("at2", "at").alias("at"), (F.col("pos") + F.coalesce("pos2", F.lit(0))).alias("pos"),
                                                      F.least("low", "low2").alias("low"), F.col("at2").isNull().alias("ended"))
        step = materialize(step, "paths-doubled")
        done, open_ = done.unionByName(step.where("ended").drop("ended")), step.where("NOT ended").drop("ended")
        if open_.isEmpty():
            break
    none = F.lit(None).cast("string")
    return done.select("id", F.col("at").alias("path"), "pos", none.alias("ring")).unionByName(open_.select("id", none.alias("path"), "pos", F.col("low").alias("ring")))


def _walks(links: DataFrame, chunk: int) -> DataFrame:
    """(id, path, pos, ring) of every target of unbranched edges (src, dst, n): the first vertex of its path and the way
    from there, or a mark of the ring that it lies on.

    Edges are joined where they lie, a chunk at a time; the first vertices of chunks that others lead to are a smaller
    graph of the same kind. Where chunks do not make it smaller, pointers are doubled."""
    local = materialize(links.select("src", "dst", "n").mapInArrow(_chains(chunk), "id string, at string, pos bigint"), "paths")
    heads = materialize(local.select(F.col("at").alias("id")).distinct(), "paths-heads")
    over = materialize(local.join(broadcast_if_small(heads), "id", "left_semi").select(F.col("at").alias("src"), F.col("id").alias("dst"), F.col("pos").alias("n")), "paths-over")
    n, m = local.count(), over.count()
    if not m:
        return local.select("id", F.col("at").alias("path"), "pos", F.lit(None).cast("string").alias("ring"))
    if m > n / 2:
        return _doubled(local)
    rest = _walks(over.coalesce(1) if m <= chunk else over, chunk).select(F.col("id").alias("at"), "path", F.col("pos").alias("off"), "ring")
    far = local.join(broadcast_if_small(materialize(rest, "paths-rest")), "at", "left")
    path = F.when(F.col("ring").isNull(), F.coalesce("path", "at"))
    return materialize(far.select("id", path.alias("path"), (F.col("pos") + F.coalesce("off", F.lit(0))).alias("pos"), "ring"), "paths-done")


def _paths(edges: DataFrame, chunk: int = CHUNK_ROWS) -> tuple[DataFrame, DataFrame]:
    """Distinct edges (src, dst, n) as walks (id, path, pos, ring) of the targets of unbranched ones, and the other edges.

    An edge is unbranched if nothing else leaves its source or enters its target; a path is named by its first vertex. The
    others lead from the end of a path to the beginning of one, or to vertices on none."""
    many = [materialize(edges.groupBy(c).count().where("count > 1").select(c, F.lit(True).alias(f"{c}_many")), "paths-many") for c in ("src", "dst")]
    marked = edges.join(broadcast_if_small(many[0]), "src", "left").join(broadcast_if_small(many[1]), "dst", "left")
    single = F.col("src_many").isNull() & F.col("dst_many").isNull()
    return _walks(marked.where(single), chunk), materialize(marked.where(~single).select("src", "dst", "n"), "paths-between")


def _highest(edges: DataFrame) -> DataFrame:
    """(id, top): the largest id that reaches each vertex, itself included.

    A round takes the tops of the vertices before, and then the top of the top, so that tops spread by doubling."""
    ids = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    now = materialize(ids.withColumn("top", F.col("id")), "tops")
    while True:
        come = edges.join(now.withColumnRenamed("id", "src"), "src").groupBy("dst").agg(F.max("top").alias("more"))
        step = now.join(come.withColumnRenamed("dst", "id"), "id", "left").select("id", F.greatest("top", "more").alias("new"), F.col("top").alias("old"))
        step = materialize(step, "tops")
        jump = step.select(F.col("id").alias("new"), F.col("new").alias("more"))
        after = materialize(step.join(jump, "new", "left").select("id", F.greatest("new", "more").alias("top"), (F.greatest("new", "more") != F.col("old")).alias("moved")), "tops")
        discard(now)
        discard(step)
        now = after
        if now.where("moved").isEmpty():
            return now.drop("moved")


def _cores(edges: DataFrame) -> DataFrame:
    """(id, core) of the vertices in components of two or more; ``core`` is the largest id of each.

    Vertices that nothing enters or leaves are trimmed. Then every vertex gets the largest id that reaches it; those of one such
    id that reach it back are its component. What is left are edges within a colour, between vertices not placed."""
    found = []
    live = materialize(_plain(edges), "scc")
    n = live.count()
    while n:
        while n:
            kept = live.join(live.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
            kept = materialize(kept.join(live.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"), "scc")
            discard(live)
            live, before, n = kept, n, kept.count()
            if before - n < TRIM * before:
                break
        if not n:
            break
        colour = _highest(live)
        same = live.join(colour.select(F.col("id").alias("src"), "top"), "src").join(colour.select(F.col("id").alias("dst"), F.col("top").alias("top2")), "dst").where("top = top2")
        same = materialize(same.select("src", "dst"), "scc-colour")
        if same.isEmpty():
            break
        back = _highest(same.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).withColumnRenamed("top", "reaches")
        core = materialize(back.join(colour, "id").where("reaches = top").select("id", F.col("top").alias("core")), "scc-core")
        found.append(core.join(core.groupBy("core").count().where("count > 1").select("core"), "core", "left_semi").select("id", "core"))
        rest = same.join(core.select(F.col("id").alias("src")), "src", "left_anti").join(core.select(F.col("id").alias("dst")), "dst", "left_anti")
        discard(live)
        live = materialize(rest.select("src", "dst"), "scc")
        n = live.count()
    if not found:
        return materialize(edges.select(F.col("src").alias("id"), F.col("src").alias("core")).limit(0), "scc-none")
    return materialize(reduce(DataFrame.unionByName, found), "scc-found")


@dataclass
class _Short:
    """A graph by its unbranched paths: ``inner`` (id, path, pos) are the vertices after the first one of each, ``rings``
    (id, scc) those on rings of their own, ``tops`` (id, length, scc) the other ones, with what is known of their path and, if it lies
    in a component of several, that one; ``edges`` (src, dst) lie between tops."""

    inner: DataFrame
    rings: DataFrame
    tops: DataFrame
    edges: DataFrame


def _shortened(edges: DataFrame, chunk: int) -> _Short:
    walks, between = _paths(_once(edges).withColumn("n", F.lit(1).cast("bigint")), chunk)
    inner, round_ = walks.where("ring IS NULL").select("id", "path", "pos"), walks.where("ring IS NOT NULL")
    least = round_.groupBy("ring").agg(F.min("id").alias("scc"))
    rings = materialize(round_.join(least, "ring").select("id", "scc"), "scc-rings")
    between = between.join(inner.select(F.col("id").alias("src"), "path"), "src", "left").select(F.coalesce("path", "src").alias("src"), "dst")
    short = materialize(between.distinct(), "scc-short")
    length = materialize(inner.groupBy(F.col("path").alias("id")).agg(F.max("pos").alias("length")), "scc-lengths")
    core = _cores(short)
    looped = short.where("src = dst").select(F.col("src").alias("id"), F.col("src").alias("core")).distinct()
    core = materialize(core.unionByName(looped.join(core, "id", "left_anti")), "scc-core")  # a path whose end leads to its beginning
    ahead = broadcast_if_small(core.select(F.col("id").alias("path"), "core"))
    least = core.unionByName(inner.join(ahead, "path").select("id", "core")).groupBy("core").agg(F.min("id").alias("scc"))
    core = broadcast_if_small(materialize(core.join(least, "core").select("id", "scc"), "scc-named"))
    ids = length.select("id").union(short.select(F.explode(F.array("src", "dst")))).distinct()
    tops = materialize(ids.join(length, "id", "left").join(core, "id", "left"), "scc-tops")
    return _Short(inner, rings, tops, short)


def components(edges: DataFrame, chunk: int = CHUNK_ROWS) -> DataFrame:
    """(id, scc) of every vertex of the edges: ``scc`` is the smallest id of its strongly connected component.

    Repeated edges count once; self loops and edges with a null end are ignored."""
    short = _shortened(edges, chunk)
    named = broadcast_if_small(materialize(short.tops.where("scc IS NOT NULL").select(F.col("id").alias("path"), "scc"), "scc-named"))
    inner = short.inner.join(named, "path", "left").select("id", F.coalesce("scc", "id").alias("scc"))
    out = inner.unionByName(short.tops.select("id", F.coalesce("scc", "id").alias("scc"))).unionByName(short.rings)
    return materialize(out, "scc-done")


def _levels(edges: DataFrame) -> DataFrame:
    """(id, level) of the vertices of an acyclic graph (src, dst, steps): the longest way to them.

    Each round takes the vertices that nothing unresolved enters."""
    live = materialize(edges.groupBy("src", "dst").agg(F.max("steps").alias("steps")), "levels")
    zero = live.select(F.col("src").alias("id")).distinct().join(live.select(F.col("dst").alias("id")).distinct(), "id", "left_anti")
    ready = materialize(zero.withColumn("level", F.lit(0).cast("bigint")), "levels-ready")
    waiting = materialize(ready.limit(0), "levels-waiting")
    done = [ready]
    while not live.isEmpty():
        sent = live.join(ready.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id"), (F.col("level") + F.col("steps")).alias("level"))
        known = materialize(waiting.unionByName(sent).groupBy("id").agg(F.max("level").alias("level")), "levels-known")
        rest = materialize(live.join(ready.select(F.col("id").alias("src")), "src", "left_anti").select("src", "dst", "steps"), "levels")
        held = rest.select(F.col("dst").alias("id")).distinct()
        ready = materialize(known.join(held, "id", "left_anti"), "levels-ready")
        discard(waiting)
        discard(live)
        waiting, live = materialize(known.join(held, "id", "left_semi"), "levels-waiting"), rest
        discard(known)
        done.append(ready)
    return reduce(DataFrame.unionByName, done)


@dataclass
class Condensation:
    """A graph by its components: ``nodes`` (id, scc, path, pos, level), and ``steps`` (src, dst, steps) between paths.

    A component lies on a path (unbranched, by itself if need be) at a position; ``level`` is the length of the longest way to
    it. From a to b there is a way only if a's level is lower; on one path the positions decide."""

    nodes: DataFrame
    steps: DataFrame


def condense(edges: DataFrame, chunk: int = CHUNK_ROWS) -> Condensation:
    """Components, their paths and levels, for the edges (src, dst).

    Paths are shortened first; what comes after knows their tops only: a path is in a component as a whole or not at all."""
    short = _shortened(edges, chunk)
    tops = short.tops
    end = lambda c: tops.select(F.col("id").alias(c), F.coalesce("scc", "id").alias(f"{c}_name"), F.when(F.col("scc").isNull(), F.col("length")).alias(f"{c}_length"))
    joined = short.edges.join(end("src"), "src").join(end("dst"), "dst").where("src_name <> dst_name")
    joined = joined.groupBy(F.col("src_name").alias("src"), F.col("dst_name").alias("dst")).agg((F.coalesce(F.max("src_length"), F.lit(0)) + 1).alias("n"))
    walks, between = _paths(materialize(joined, "condense-edges"), chunk)
    walks = walks.select(F.col("id").alias("name"), F.col("path").alias("to"), F.col("pos").alias("off"))
    steps = between.join(walks, between.src == walks.name, "left").select(F.coalesce("to", "src").alias("src"), "dst", (F.coalesce("off", F.lit(0)) + F.col("n")).alias("steps"))
    steps = materialize(steps.distinct(), "condense-steps")
    level = _levels(steps).withColumnRenamed("id", "to")
    found = tops.withColumn("name", F.coalesce("scc", "id")).join(walks, "name", "left").withColumn("to", F.coalesce("to", "name")).join(level, "to", "left")
    found = materialize(found.select("id", "scc", "to", F.coalesce("off", F.lit(0)).alias("off"), F.coalesce("level", F.lit(0)).alias("level")), "condense-tops")
    ahead = found.withColumnRenamed("id", "path")
    # a component of several is one place of its path
    inner = short.inner.join(broadcast_if_small(ahead), "path").select("id", F.coalesce("scc", "id").alias("scc"), "to", "level", (F.col("off") + F.when(F.col("scc").isNull(), F.col("pos")).otherwise(0)).alias("off"))
    own = found.select("id", F.coalesce("scc", "id").alias("scc"), "to", "level", "off")
    nothing = F.lit(0).cast("bigint")
    rings = short.rings.select("id", "scc", F.col("scc").alias("to"), nothing.alias("level"), nothing.alias("off"))
    nodes = inner.unionByName(own).unionByName(rings)
    nodes = nodes.select("id", "scc", F.col("to").alias("path"), F.col("off").alias("pos"), (F.col("level") + F.col("off")).alias("level"))
    return Condensation(materialize(nodes, "condense-nodes"), steps)


def _searched(pairs: DataFrame, steps: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b, limit) for which steps lead from a to b; levels up to ``limit`` are of interest.

    Starts share searches, BITS at a time, each as a bit of a mask: (block, id, mask) is what is kept, and each
    round sends on only new bits."""
    starts = pairs.groupBy("a").agg(F.max("limit").alias("limit"))
    blocks = max(1, -(-starts.count() // (BITS * 3 // 4)))
    # a block that is too full for its bits is two
    start = starts.withColumn("deal", F.pmod(F.xxhash64("a"), F.lit(blocks)))
    slot = F.row_number().over(Window.partitionBy("deal").orderBy("limit", "a")) - 1
    start = start.select("a", "limit", F.struct("deal", F.floor(slot / BITS).alias("part")).alias("block"), (slot % BITS).alias("bit"))
    start = materialize(start.withColumn("mask", F.expr("shiftleft(1L, cast(bit AS int))")), "search-starts")
    limits = start.groupBy("block").agg(F.max("limit").alias("limit"))
    front = materialize(start.groupBy("block", F.col("a").alias("id")).agg(F.bit_or("mask").alias("mask")), "search")
    seen = front
    while not front.isEmpty():
        went = front.join(steps, front.id == steps.src).select("block", F.col("dst").alias("id"), "mask", F.col("level"))
        went = went.join(broadcast_if_small(limits, 100_000), "block").where("level <= limit").groupBy("block", "id").agg(F.bit_or("mask").alias("mask"))
        old = seen.select("block", "id", F.col("mask").alias("old"))
        new = went.join(old, ["block", "id"], "left").withColumn("mask", F.col("mask").bitwiseAND(F.bitwise_not(F.coalesce("old", F.lit(0).cast("bigint")))))
        front = materialize(new.where("mask <> 0").select("block", "id", "mask"), "search")
        seen = materialize(seen.unionByName(front).groupBy("block", "id").agg(F.bit_or("mask").alias("mask")), "search-seen")
    asked = pairs.select("a", "b").join(start.select("a", "block", F.col("mask").alias("own")), "a")
    return asked.join(seen.withColumnRenamed("id", "b"), ["block", "b"]).where(F.col("mask").bitwiseAND(F.col("own")) != 0).select("a", "b").distinct()


def downstream(graph: Condensation, ids: DataFrame) -> DataFrame:
    """(id) of everything that ways from ``ids`` (id) lead to, themselves and their components included.

    Rounds follow the steps between paths; along a path positions decide."""
    first = graph.nodes.join(ids.select("id").distinct(), "id", "left_semi").groupBy("path").agg(F.min("pos").alias("pos"))
    first = materialize(first, "downstream-first")
    front = materialize(first.select(F.col("path").alias("src")).join(graph.steps, "src").select(F.col("dst").alias("src")).distinct(), "downstream")
    whole = front
    while not front.isEmpty():
        front = materialize(front.join(graph.steps, "src").select(F.col("dst").alias("src")).distinct().join(whole, "src", "left_anti"), "downstream")
        whole = whole.unionByName(front)
    part = graph.nodes.join(first.withColumnRenamed("pos", "from"), "path").where("pos >= from").select("id")
    return part.union(graph.nodes.join(whole.withColumnRenamed("src", "path"), "path", "left_semi").select("id")).distinct()


def reaches(graph: Condensation, pairs: DataFrame) -> DataFrame:
    """The distinct pairs (a, b) with ``reached``: whether a way (of any length, none included) leads from a to b.

    Labels decide most: the same component, the same path, or a level that is not higher. Only the others are
    searched for, all at once, among paths up to the level of their targets."""
    asked = pairs.select("a", "b").distinct()
    end = lambda c: graph.nodes.select(F.col("id").alias(c), *[F.col(x).alias(f"{c}_{x}") for x in ("scc", "path", "pos", "level")])
    known = asked.join(end("a"), "a", "left").join(end("b"), "b", "left")
    one = (F.col("a") == F.col("b")) | (F.col("a_scc") == F.col("b_scc"))
    along = F.col("a_path") == F.col("b_path")
    sure = F.when(one, True).when(F.col("a_level").isNull() | F.col("b_level").isNull(), False).when(along, F.col("a_pos") <= F.col("b_pos"))
    known = materialize(known.withColumn("sure", sure.when(F.col("a_level") >= F.col("b_level") - F.col("b_pos"), False)), "reach-known")
    open_ = known.where("sure IS NULL").select(F.col("a_path").alias("a"), F.col("b_path").alias("b"), (F.col("b_level") - F.col("b_pos")).alias("limit")).distinct()
    open_ = materialize(open_, "reach-open")
    heads = graph.nodes.where("pos = 0").select(F.col("path").alias("dst"), "level").distinct()
    levelled = materialize(graph.steps.select("src", "dst").join(heads, "dst"), "reach-steps")
    yes = _searched(open_, levelled).select(F.col("a").alias("a_path"), F.col("b").alias("b_path"), F.lit(True).alias("way"))
    return known.join(yes, ["a_path", "b_path"], "left").select("a", "b", F.coalesce("sure", "way", F.lit(False)).alias("reached"))
