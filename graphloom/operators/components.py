"""Connected components by alternating large-star and small-star rewrites, and where edges lie."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.storage import broadcast_if_small, discard, materialize

CHUNK_ROWS, CHUNK_BYTES = 1 << 20, 64 << 20  # edges that are joined at once where they lie


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(id, component) for every vertex that has an edge to another one; component is its smallest id.

    Edges are undirected; self loops, nulls and repeats are ignored. Each round replaces the
    edges by stars around local minima and cuts lineage in the shared folder; the number of
    rounds grows with the logarithm of the longest path.
    """
    u, v = F.col(src), F.col(dst)
    now = materialize(
        edges.where(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct(), "cc"
    )
    mark = _signature(now)
    while mark[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = materialize(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "cc")
        again = _signature(after)
        discard(now)
        now = after
        if again == mark:
            break
        mark = again
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)


def _least(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest of ``n`` places that each one reaches over the edges between ``a`` and ``b``."""
    root = np.arange(n)
    while True:
        new, ra, rb = root.copy(), root[a], root[b]
        low = np.minimum(root[ra], root[rb])
        for at in (ra, rb, a, b):
            np.minimum.at(new, at, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def chunked(work, most: int):
    """A function of batches of edges that gives ``work`` a chunk of them at a time."""

    def run(batches):
        held, rows, size = [], 0, 0
        for batch in batches:
            held.append(batch)
            rows, size = rows + batch.num_rows, size + batch.nbytes
            if rows >= most or size >= CHUNK_BYTES:
                yield from work(held)
                held, rows, size = [], 0, 0
        if rows:
            yield from work(held)

    return run


def ends(edges: DataFrame, chunk: int = CHUNK_ROWS) -> DataFrame:
    """(id) of all ends of edges (src, dst), each once for every chunk of edges that lie together."""

    def once(held):
        ids = pa.concat_arrays([b.column(c) for b in held for c in (0, 1)]).unique()
        return pa.table({"id": ids}).to_batches(max_chunksize=1 << 16)

    return edges.select("src", "dst").mapInArrow(chunked(once, chunk), "id string")


def only_neighbours(edges: DataFrame, chunk: int = CHUNK_ROWS) -> DataFrame:
    """(id, other) of the vertices of edges (src, dst) between different ids, for every chunk of edges that lie together: its
    neighbour there if it has one only, else null."""

    def found(held):
        ids = pa.concat_arrays([b.column(0) for b in held] + [b.column(1) for b in held]).dictionary_encode()
        both = ids.indices.to_numpy().reshape(2, -1)
        both = both[:, both[0] != both[1]]
        here, there = both.ravel(), both[::-1].ravel()
        one, many = np.full(len(ids.dictionary), -1), np.zeros(len(ids.dictionary), bool)
        one[here] = there
        many[here[one[here] != there]] = True
        at = np.flatnonzero(one >= 0)
        out = pa.table({"id": ids.dictionary.take(pa.array(at)), "other": ids.dictionary.take(pa.array(one[at], mask=many[at]))})
        return out.to_batches(max_chunksize=1 << 16)

    return edges.select("src", "dst").mapInArrow(chunked(found, chunk), "id string, other string")


def _stars(most: int):
    """Edges (u, r), a chunk at a time, as the vertices of the chunk with the smallest id that each reaches within it."""

    def star(held):
        ids = pa.concat_arrays([b.column(0) for b in held] + [b.column(1) for b in held]).dictionary_encode()
        order = pc.sort_indices(ids.dictionary)
        place = np.empty(len(order), np.int64)
        place[order.to_numpy()] = np.arange(len(order))
        ends = place[ids.indices.to_numpy()]
        names, half = ids.dictionary.take(order), len(ends) // 2
        out = pa.table({"u": names, "r": names.take(pa.array(_least(len(names), ends[:half], ends[half:])))})
        return out.to_batches(max_chunksize=1 << 16)

    return chunked(star, most)


def contracted_components(edges: DataFrame, src: str = "src", dst: str = "dst", chunk: int = CHUNK_ROWS) -> DataFrame:
    """Like ``connected_components``, for far more edges than vertices: edges are not shuffled.

    Each chunk of edges sends on its vertices with the smallest id that each reaches within the chunk. Vertices of several
    chunks link these ids, which are a smaller graph of the same kind; where chunks do not make it smaller, stars go on."""
    kind = edges.schema[src].dataType.simpleString()
    now = edges.where(F.col(src) != F.col(dst)).select(F.col(src).alias("u"), F.col(dst).alias("r"))
    homes, n, labels = [], None, None
    while True:
        parts = now.mapInArrow(_stars(chunk), f"u {kind}, r {kind}").withColumn("before", F.lag("r").over(Window.partitionBy("u").orderBy("r")))
        parts = materialize(parts, "cc-parts")
        homes.append(parts.where("before IS NULL").select(F.col("u").alias("id"), "r"))
        now, before = parts.where("before <> r").select(F.col("before").alias("u"), "r"), n
        n = now.count()
        if before is not None and n > before / 2:
            labels = connected_components(now, "u", "r")
            break
        if not n:
            break
        if n <= chunk:
            now = now.coalesce(1)
    for home in reversed(homes):
        if labels is None:
            labels = home.withColumnRenamed("r", "component")
        else:
            moved = materialize(labels.where("id <> component").withColumnRenamed("id", "r"), "cc-moved")
            labels = home.join(broadcast_if_small(moved), "r", "left").select("id", F.coalesce("component", "r").alias("component"))
    return labels
