"""Near duplicates of embeddings by E8 lattice hashing in several tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.blocks import chunks, paired_blocks, slices
from graphloom.llm.vectors import component_type, stack, usable
from graphloom.operators.components import connected_components
from graphloom.storage import broadcast_if_small, materialize

TABLES = 5
SCALE = 3.0  # lattice units for a unit vector; the lattice has packing radius 0.71
BLOCK = 2_000  # rows of a cell that are compared in one task
SKETCH_BITS = 256  # signs of random projections
SPARE = 6.0  # standard errors by which the signs of a linked pair may differ more often than expected


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest points of D8 (integers with an even sum): round, and on an odd sum round the
    coordinate with the largest error the other way."""
    r = np.rint(x)
    err = x - r
    worst = np.abs(err).argmax(1)
    odd = np.flatnonzero(r.sum(1) % 2 != 0)
    w = worst[odd]
    r[odd, w] += np.where(err[odd, w] >= 0, 1.0, -1.0)
    return r


def decode_e8(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Doubled coordinates of the nearest E8 point, and of the nearest one of the other coset.

    E8 is D8 together with D8 shifted by (1/2, ..., 1/2)."""
    a, b = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    da, db = ((x - a) ** 2).sum(1), ((x - b) ** 2).sum(1)
    first = (da <= db)[:, None]
    return np.where(first, 2 * a, 2 * b).astype(np.int64), np.where(first, 2 * b, 2 * a).astype(np.int64)


def _pack(points: np.ndarray) -> np.ndarray:
    """One number for each point, wrapped to 64 bits: points that fall together only cost comparisons."""
    return ((points + 128) * (np.int64(257) ** np.arange(7, -1, -1, dtype=np.int64))).sum(1)


def cells(vectors: np.ndarray, tables: int, scale: float, seed: int = 11) -> np.ndarray:
    """The four cells (home, then the probed ones) of every vector in every table: rows x tables x 4.

    A table projects to two times eight dimensions and decodes both parts; its cells are pairs of
    lattice points, and the probes take the nearest point of the other coset in one part or both."""
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    d = unit.shape[1]
    out = np.empty((len(unit), tables, 4), np.int64)
    mix = np.int64(0x9E3779B97F4A7C15 - (1 << 64))
    for t in range(tables):
        rng = np.random.default_rng([seed, t, d])
        basis = np.linalg.qr(rng.standard_normal((max(d, 16), 16)))[0][:d]
        y = unit @ basis * scale + rng.random(16)
        (a, a2), (b, b2) = ([_pack(p) for p in decode_e8(y[:, s : s + 8])] for s in (0, 8))
        out[:, t] = np.stack([a * mix + b, a2 * mix + b, a * mix + b2, a2 * mix + b2], axis=1)
    return out


def sketches(vectors: np.ndarray, seed: int = 12) -> np.ndarray:
    """Signs of random projections, packed: rows x bytes."""
    rng = np.random.default_rng([seed, vectors.shape[1]])
    return np.packbits(vectors @ rng.standard_normal((vectors.shape[1], SKETCH_BITS)) > 0, axis=1)


def most_signs(cut: float) -> int:
    """Signs in which the sketches of a linked pair can be expected to differ, and SPARE standard errors more."""
    p = float(np.arccos(cut) / np.pi)
    return int(np.ceil(SKETCH_BITS * p + SPARE * np.sqrt(SKETCH_BITS * p * (1 - p))))


def _keyed(tables: int, scale: float, kind: str):
    def run(batches):
        for batch in batches:
            batch = batch.assign(dim=[len(v) for v in batch["v"]])
            for dim, part in batch.groupby("dim"):
                X = stack(part["v"])
                yield pd.DataFrame({
                    "id": part["id"], "label": part["label"], "copies": part["copies"], "dim": int(dim),
                    "vec": [x.tobytes() for x in X.astype(kind)], "sketch": [x.tobytes() for x in sketches(X)], "cells": list(cells(X, tables, scale).reshape(len(X), -1)),
                })

    return run


def _flag(cut: float):
    """Ids that have a plausible partner in their cell (or pair of its blocks), by their sketches."""
    most = most_signs(cut)

    def run(batches):
        for columns, table, edges in chunks(batches, ("label", "dim", "t", "cell", "i", "j")):
            n, sizes = table.num_rows, np.diff(edges)
            bits = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint64).reshape(n, -1)
            block, found = table["block"].to_numpy(), np.zeros(n, bool)
            group = np.repeat(np.arange(len(sizes)), sizes)
            cross = columns["i"][edges[:-1]] != columns["j"][edges[:-1]]
            group[cross[group]] = -1 - np.flatnonzero(cross[group])  # these are compared below
            for lag in range(1, int(sizes[~cross].max(initial=0))):
                a = np.flatnonzero(group[lag:] == group[:-lag])
                near = np.bitwise_count(bits[a] ^ bits[a + lag]).sum(1) <= most
                found[a[near]] = True
                found[a[near] + lag] = True
            for k in np.flatnonzero(cross):
                rows = np.arange(edges[k], edges[k + 1])
                left, right = (rows[block[rows] == columns[c][edges[k]]] for c in ("i", "j"))
                for x in left:
                    near = np.bitwise_count(bits[right] ^ bits[x]).sum(1) <= most
                    found[right[near]] = True
                    found[x] |= near.any()
            yield pa.RecordBatch.from_arrays([pa.array(table["id"].to_numpy()[found], pa.int64())], ["id"])

    return run


def _pairs(a, b, same: bool, cut: float, t: int, cell: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of linked pairs between two blocks that first meet in table ``t``, and there in this
    cell as the smallest that they share."""
    x, y = np.nonzero(a["u"] @ b["u"].T >= cut - 1e-9)
    if same:
        x, y = x[x < y], y[x < y]
    exact = np.einsum("ij,ij->i", a["x"][x], b["x"][y]) / (a["n"][x] * b["n"][y])
    x, y = x[exact >= cut], y[exact >= cut]
    ca, cb = a["cells"][x], b["cells"][y]
    shared = (ca[:, : t + 1, :, None] == cb[:, : t + 1, None, :]).any(3)
    least = np.where(shared[:, t], ca[:, t], np.iinfo(np.int64).max).min(1)
    here = ~shared[:, :t].any((1, 2)) & (least == cell)
    return x[here], y[here]


def _compare(rows: dict, cut: float, t: int, cell: int, i: int, j: int):
    """Links within one cell (or pair of its blocks): (id, root, links) for each linked row, a copy
    of a vector being a link."""
    left = {k: v[rows["block"] == i] for k, v in rows.items()}
    right = left if i == j else {k: v[rows["block"] == j] for k, v in rows.items()}
    x, y = _pairs(left, right, i == j, cut, t, cell)
    if not len(x):
        return None
    a, b = left["id"][x], right["id"][y]
    ids, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    p, q = inverse[: len(a)], inverse[len(a) :]
    root = np.arange(len(ids))
    while True:
        low = np.minimum(root[p], root[q])
        new = root.copy()
        np.minimum.at(new, p, low)
        np.minimum.at(new, q, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    others = np.concatenate([right["copies"][y], left["copies"][x]])
    return ids, ids[root], np.bincount(inverse, others, len(ids)).astype(np.int64)


def _link(cut: float, kind: str, tables: int):
    def run(batches):
        for columns, table, s, e in slices(batches, ("label", "dim", "t", "cell", "i", "j")):
            if e - s < 2:
                continue
            part = table.slice(s, e - s)
            x = np.frombuffer(b"".join(part["vec"].to_pylist()), kind).reshape(e - s, -1).astype(np.float64)
            n = np.linalg.norm(x, axis=1)
            rows = {"x": x, "n": n, "u": x / n[:, None]} | {k: part[k].to_numpy() for k in ("id", "block", "copies")}
            rows["cells"] = part["cells"].combine_chunks().flatten().to_numpy().reshape(e - s, tables, 4)
            got = _compare(rows, cut, *(int(columns[k][s]) for k in ("t", "cell", "i", "j")))
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(g, pa.int64()) for g in got], ["id", "root", "links"])

    return run


def near_duplicates(
    df: DataFrame, cut: float = 0.98, id_col: str = "vec_id", vector: str = "embedding",
    label_col: str = "label", tables: int = TABLES, scale: float = SCALE,
) -> DataFrame:
    """One row per vector: (vec_id, n_links, component_id, kept), links being pairs with equal labels
    and a cosine of at least ``cut`` that share a cell, home or probed, in some table.

    Rows with equal label and vector are one first, with their number; they link with one another.
    To cells that hold two rows go sketches of 256 signs first, and the vectors only of rows that then have a
    plausible partner there (a linked pair is ruled out less than once in a million). A pair is counted only in
    the first table and cell where it meets, so links are summed without listing pairs; a cell
    sends on one star per component of its links. A cell of more than 2000 rows is cut into blocks and every two blocks are
    compared in a task of their own. Vectors that are null, empty, zero or not finite, and rows
    without label or id link with nothing (a null id is its own null component). Of rows that repeat
    an id the one with the smallest label and vector takes part; all of them get its result. An empty
    table gives no rows.
    """
    base = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("bigint").alias("label"), F.col(vector).alias("v"))
    kind = component_type(df, vector)
    live = base.where(F.col("id").isNotNull() & F.col("label").isNotNull() & usable("v"))
    twice = materialize(live.groupBy("id").count().where("count > 1").select("id"), "lattice-twice")
    if not twice.isEmpty():
        one = live.join(twice, "id").groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.label", "r.v")
        live = live.join(twice, "id", "left_anti").unionByName(one)
    # two hashes and the length stand for the vector, so that only numbers are grouped
    same = ["label", "k1", "k2", "dim"]
    hashed = live.select("id", "label", F.xxhash64("v").alias("k1"), F.hash("v").alias("k2"), F.size("v").alias("dim"))
    equal = hashed.groupBy(*same).agg(F.min("id").alias("first"), F.count("*").alias("copies")).where("copies > 1")
    equal = materialize(equal, "lattice-equal")
    star = hashed.join(broadcast_if_small(equal, 300_000), same).select("id", "first", "copies")
    star = materialize(star, "lattice-star")  # every row that has an equal one, with the first of them
    later = star.where("id <> first").select("id")
    firsts = star.where("id = first").select("id", "copies")
    ones = live.join(broadcast_if_small(materialize(later, "lattice-later"), 1_000_000), "id", "left_anti")
    ones = ones.join(broadcast_if_small(materialize(firsts, "lattice-firsts"), 300_000), "id", "left")
    ones = ones.withColumn("copies", F.coalesce("copies", F.lit(1)).cast("bigint"))
    keyed = materialize(
        ones.mapInPandas(_keyed(tables, scale, kind), "id bigint, label bigint, copies bigint, dim int, vec binary, sketch binary, cells array<bigint>"),
        "lattice-keys",
    )
    cell = ["label", "dim", "t", "cell"]
    order = [*cell, "i", "j"]

    def placed(rows: DataFrame) -> DataFrame:
        """The rows' places in cells that hold two of them, a large cell cut into pairs of blocks."""
        spots = rows.select("id", "label", "dim", F.posexplode("cells").alias("p", "cell")).select("id", "label", "dim", F.expr("p div 4").cast("int").alias("t"), "cell")
        shared = materialize(spots.groupBy(*cell).count().where("count > 1").select(*cell), "lattice-cells")
        return paired_blocks(spots.join(shared, cell, "left_semi"), cell, F.col("id"), BLOCK, "lattice-hot")

    def dealt(spots: DataFrame, rows: DataFrame, *columns: str) -> DataFrame:
        wide = spots.join(rows.select("id", *columns), "id").select(*order, "block", "id", *columns)
        return wide.repartition(*order).sortWithinPartitions(*order)

    # by sketches first: only rows with a plausible partner take their vectors along
    flagged = materialize(dealt(placed(keyed), keyed, "sketch").mapInArrow(_flag(cut), "id bigint").distinct(), "lattice-flagged")
    some = materialize(keyed.join(flagged, "id", "left_semi").drop("sketch"), "lattice-some")
    links = materialize(
        dealt(placed(some), some, "copies", "vec", "cells").mapInArrow(_link(cut, kind, tables), "id bigint, root bigint, links bigint"),
        "lattice-links",
    )
    groups = connected_components(links, "id", "root").withColumnRenamed("id", "first")
    # the first of equal rows stands for all of them; each links with the others too
    counts = links.groupBy(F.col("id").alias("first")).agg(F.sum("links").alias("n_links")).join(groups, "first", "left")
    counts = materialize(counts, "lattice-counts")
    alone = counts.join(firsts.withColumnRenamed("id", "first"), "first", "left_anti").select(F.col("first").alias("id"), "first", F.lit(1).cast("bigint").alias("copies"))
    known = star.unionByName(alone).join(broadcast_if_small(counts, 300_000), "first", "left")
    known = known.select("id", (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "first").alias("component"))
    known = materialize(known, "lattice-groups")
    out = base.select("id").join(broadcast_if_small(known, 1_000_000), "id", "left")
    component = F.coalesce("component", "id")
    return out.select(
        F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"),
    )
