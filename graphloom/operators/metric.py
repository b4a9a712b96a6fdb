"""Exact joins of vectors by distance: pivots cut the space into cells, and bounds keep rows out of the
cells that they cannot reach.

A row lies in the cell of its nearest pivot. All points of another cell lie beyond the plane halfway between the two
pivots, so a row meets that cell only if the plane is within the radius (the triangle inequality for Euclidean
distance). Within a cell, distances to the pivot bound distances between rows in the same way."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.components import connected_components
from graphloom.storage import broadcast_if_small, materialize

SAMPLE_ROWS = 4_096  # rows that pivots are chosen from; results do not depend on the choice
PIVOTS = 512  # cells of the first cut, at most
SPLIT = 32  # cells that a large cell is cut into
CELL_ROWS = 8_192  # members of a cell from which it is cut again
PIVOT_BYTES = 32 << 20  # of all pivots of the second cut, which travel with the tasks
BLOCK_ROWS, LEAST_BLOCKS = 32_768, 5  # rows of a large cell's block, of which there are some for all cores to have work
BLOCK = 1_024  # rows that are compared at once
COPY_COST = 400.0  # of sending a row to one more cell, in comparisons


def radius_of(least: float) -> float:
    """The distance at which the score 1 / (1 + distance) is ``least``."""
    return max(1 / least - 1, 0.0)


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x**2).sum(1)[:, None] + (y**2).sum(1) - 2 * x @ y.T


def farthest_first(x: np.ndarray, k: int) -> np.ndarray:
    """At most ``k`` rows: each the one farthest from all before it, the first the farthest from the mean."""
    chosen = [int(((x - x.mean(0)) ** 2).sum(1).argmax())]
    far = ((x - x[chosen[0]]) ** 2).sum(1)
    while len(chosen) < k and far.max() > 1e-9 * (1 + (x**2).sum(1).max()):
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(1))
    return x[chosen]


def cells_of(x: np.ndarray, pivots: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The cell of each row, its distance to that cell's pivot, and which cells hold points within the radius."""
    far = squares(x, pivots)
    home = far.argmin(1)
    least = far[np.arange(len(x)), home]
    apart = np.sqrt(np.maximum(squares(pivots, pivots), 0))[home]
    apart[np.arange(len(x)), home] = np.inf
    scale = (x**2).sum(1)[:, None] + (pivots**2).sum(1)
    # how far the plane between the pivots is, less what rounding may have added
    gap = (far - least[:, None] - 1e-12 * scale) / (2 * apart)
    return home, np.sqrt(np.maximum(least, 0)), gap <= radius * (1 + 1e-9)


def choose_pivots(sample: np.ndarray, n: int, radius: float, most: int = PIVOTS) -> np.ndarray:
    """Pivots for ``n`` rows of which ``sample`` is one: as many as make comparisons and copies cheapest."""
    pivots = farthest_first(sample, min(most, max(1, n // 64)))
    best, cost, grow, k = pivots[:1], np.inf, n / len(sample), 1
    while True:
        home, _, reached = cells_of(sample, pivots[:k], radius)
        inner = np.bincount(home, minlength=k) * grow
        outer = (reached & (np.arange(k) < home[:, None])).sum(0) * grow
        now = (inner * (inner / 2 + outer)).sum() + COPY_COST * outer.sum() + n * k
        if now < cost:
            best, cost = pivots[:k], now
        if k == len(pivots):
            return best
        k = min(2 * k, len(pivots))


def _place(pivots: dict[tuple[int, int], np.ndarray], radius: float, split: int, itself: bool):
    """Members (id, v, inner, cell) of cells that are cut, in their new cells.

    An inner row is an inner one of its own cell; where rows are joined with one another (``itself``) it is also an outer
    one of those before it that it reaches, so that every two rows of different cells meet once. Outer rows go wherever they reach."""

    def run(batches):
        for batch in batches:
            for (dim, cell), part in batch.groupby(["dim", "cell"], sort=False):
                own = pivots[(int(dim), int(cell))]
                home, _, reached = cells_of(np.stack(part["v"].to_numpy()), own, radius)
                inner = part["inner"].to_numpy(bool)
                number = np.arange(len(own))
                goes = reached & (~inner[:, None] | (itself & (number <= home[:, None])))
                goes[inner, home[inner]] = True
                row, at = np.nonzero(goes)
                out = part.iloc[row].copy()
                out["inner"] = inner[row] & (at == home[row])
                out["cell"] = int(cell) * split + at + 1
                yield out

    return run


def _pivots_of(radius: float, sizes: dict):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        dim, cell = int(frame["dim"].iloc[0]), int(frame["cell"].iloc[0])
        chosen = choose_pivots(np.stack(frame["v"].to_numpy()), sizes[(dim, cell)], radius, SPLIT)
        return pd.DataFrame({"dim": dim, "cell": cell, "p": list(chosen)})

    return run


def _cut(members: DataFrame, radius: float, itself: bool) -> DataFrame:
    """Cells over CELL_ROWS in up to SPLIT cells each, by pivots from samples of their own."""
    sizes = materialize(members.groupBy("dim", "cell").count(), "metric-sizes")
    hot = sizes.where(F.col("count") > CELL_ROWS)
    room = PIVOT_BYTES // (8 * SPLIT)
    large = hot.orderBy(F.desc("count"), "dim", "cell").limit(4_096).collect()
    known: dict[tuple[int, int], int] = {}
    for r in large:
        room -= r["dim"]
        if room > 0:
            known[(r["dim"], r["cell"])] = r["count"]
    if not known:
        return members
    keys = F.broadcast(members.sparkSession.createDataFrame([(*k, n) for k, n in known.items()], "dim int, cell bigint, n bigint"))
    some = members.join(keys, ["dim", "cell"]).where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < F.lit(1 << 20) * 512 / F.col("n") + 1)
    chosen = some.select("dim", "cell", "v").groupBy("dim", "cell").applyInPandas(_pivots_of(radius, known), "dim int, cell bigint, p array<double>").toPandas()
    pivots = {k: np.stack(g["p"].to_numpy()) for k, g in chosen.groupby(["dim", "cell"])}
    keys = F.broadcast(members.sparkSession.createDataFrame([(int(d), int(c)) for d, c in pivots], "dim int, cell bigint"))
    stay = members.join(keys, ["dim", "cell"], "left_anti")
    cut = members.join(keys, ["dim", "cell"], "left_semi").select(members.columns)
    return stay.select(members.columns).unionByName(cut.mapInPandas(_place(pivots, radius, PIVOTS + 1, itself), members.schema))


def _members(rows: DataFrame, asking: DataFrame | None, radius: float) -> DataFrame:
    """Rows (id, v, ...) and the queries that ask them as members of cells of a bounded size, large ones in blocks.

    Columns: dim, cell, i, j, block, id, v, inner and what else the rows have."""
    pool = rows.withColumn("inner", F.lit(True))
    if asking is not None:
        pool = pool.unionByName(asking.withColumn("inner", F.lit(False)))
    pool = materialize(pool.withColumns({"dim": F.size("v"), "cell": F.lit(0).cast("bigint")}), "metric-rows")
    counts = {r["dim"]: r["n"] for r in pool.where("inner").groupBy("dim").agg(F.count("*").alias("n")).collect()}
    pool = pool.where(F.col("dim").isin(*counts)) if counts else pool.limit(0)
    pivots = {}
    for dim, n in counts.items():
        some = pool.where(F.col("inner") & (F.col("dim") == dim) & (F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < F.lit(1.5 * SAMPLE_ROWS * (1 << 20) / n)))
        sample = some.select("v").limit(2 * SAMPLE_ROWS).toPandas()["v"]
        x = np.stack(sample.to_numpy()) if len(sample) else np.zeros((1, dim))
        pivots[(dim, 0)] = choose_pivots(x, n, radius)
    members = materialize(pool.mapInPandas(_place(pivots, radius, 1, asking is None), pool.schema), "metric-members")
    members = materialize(_cut(members, radius, asking is None), "metric-cells")
    # what is still large (a ball of rows that all reach each other) is cut by hash; every two blocks meet
    large = members.groupBy("dim", "cell").count().where(F.col("count") > CELL_ROWS)
    # a row is copied to every block, so blocks are as large as a task can hold
    blocks = F.greatest(F.ceil(F.col("count") / BLOCK_ROWS), F.least(F.ceil(F.col("count") / (CELL_ROWS / 2)), F.lit(LEAST_BLOCKS)))
    large = materialize(large.select("dim", "cell", blocks.cast("int").alias("blocks")), "metric-large")
    out = members.join(broadcast_if_small(large, 100_000), ["dim", "cell"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    out = out.withColumn("block", F.pmod(F.xxhash64("id", "inner"), F.col("blocks")).cast("int"))
    out = out.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    out = out.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("blocks", "other")
    key = ["dim", "cell", "i", "j"]
    return out.repartition(*key).sortWithinPartitions(*key)


def _groups(batches):
    """Frames of whole groups; rows come sorted by group, which may span batches."""
    key, held = None, []
    for batch in batches:
        for k, part in batch.groupby(["dim", "cell", "i", "j"], sort=True):
            if k != key and held:
                yield key, pd.concat(held)
                held = []
            key = k
            held.append(part)
    if held:
        yield key, pd.concat(held)


def near_pairs(x: np.ndarray, y: np.ndarray, radius: float):
    """Yield (a, b, distances, compared): places in ``x`` and ``y`` within the radius, block by block.

    Both are sorted by distance to one point; only rows whose distances differ by at most the radius can be near."""
    mid = y.mean(0) if len(y) else 0.0
    dx, dy = (np.sqrt(((m - mid) ** 2).sum(1)) for m in (x, y))
    ox, oy = np.argsort(dx, kind="stable"), np.argsort(dy, kind="stable")
    dx, dy = dx[ox], dy[oy]
    slack = 1e-9 * (1 + (dx[-1:].max(initial=0) + dy[-1:].max(initial=0)))
    for s in range(0, len(x), BLOCK):
        rows = ox[s : s + BLOCK]
        lo = np.searchsorted(dy, dx[s] - radius - slack)
        hi = np.searchsorted(dy, dx[min(s + BLOCK, len(x)) - 1] + radius + slack, "right")
        for t in range(lo, hi, BLOCK):
            cols = oy[t : min(t + BLOCK, hi)]
            far = squares(x[rows], y[cols])
            scale = (x[rows] ** 2).sum(1).max() + (y[cols] ** 2).sum(1).max()
            a, b = np.nonzero(far <= radius**2 + 1e-9 * (1 + scale))
            a, b = rows[a], cols[b]
            yield a, b, np.sqrt(((x[a] - y[b]) ** 2).sum(1)), len(rows) * len(cols)


def _neighbours(keep: Callable[[np.ndarray], np.ndarray], radius: float, k: int | None, count):
    def run(batches):
        for (_, _, i, j), frame in _groups(batches):
            rows, asks = frame[frame["inner"]], frame[~frame["inner"]]
            sides = [(rows, asks)] if i == j else [(rows[rows["block"] == i], asks[asks["block"] == j]), (rows[rows["block"] == j], asks[asks["block"] == i])]
            for r, q in sides:
                if not len(r) or not len(q):
                    continue
                found = []
                for a, b, d, compared in near_pairs(np.stack(q["v"].to_numpy()), np.stack(r["v"].to_numpy()), radius):
                    count.add(compared)
                    score = 1 / (1 + d)
                    good = keep(score)
                    found.append((a[good], b[good], score[good]))
                a, b, score = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
                out = pd.DataFrame({"query_id": q["name"].to_numpy()[a], "node_id": r["name"].to_numpy()[b], "score": score})
                if k is not None and len(out):  # with all rows of the last score, so that ties are left to the end
                    out = out[out.groupby("query_id")["score"].rank("min", ascending=False) <= k]
                yield out

    return run


def neighbours(embeddings: DataFrame, queries: DataFrame, least: float, k: int | None = None, above: bool = False, count=None) -> DataFrame:
    """(query_id, node_id, score, rank): for each query the ``k`` best rows (all, if None) with a score 1 / (1 + L2) of
    at least (or ``above``) ``least``, ties to the smaller id.

    Rows (node_id, embedding) lie in one cell each, queries (query_id, embedding) go to all cells that they reach. Only the best ``k`` of a cell
    are sent on. Vectors that are null, empty or hold nulls take no part; those of different lengths do not meet.
    ``count`` (an accumulator) gets the number of distances computed."""
    types = {**dict(embeddings.dtypes), **dict(queries.dtypes)}
    sound = lambda df: df.where((F.size("embedding") > 0) & ~F.exists("embedding", lambda c: c.isNull() | F.isnan(c)))
    v = F.col("embedding").cast("array<double>").alias("v")
    named = lambda df, c: sound(df).where(F.col(c).isNotNull()).select(F.xxhash64(c).alias("id"), F.col(c).cast("string").alias("name"), v)
    rows, asking = named(embeddings, "node_id"), named(queries, "query_id")
    radius = radius_of(least)
    keep = (lambda s: s > least) if above else (lambda s: s >= least)
    found = _members(rows, asking, radius).mapInPandas(
        _neighbours(keep, radius * (1 + 1e-9) + 1e-12, k, count or _Nothing()), "query_id string, node_id string, score double"
    ).withColumns({c: F.col(c).cast(types[c]) for c in ("query_id", "node_id")})
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "node_id")
    ranked = found.withColumn("rank", F.row_number().over(w))
    return ranked.where(F.col("rank") <= k) if k is not None else ranked


class _Nothing:
    def add(self, n: int) -> None:
        pass


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest place that each of ``n`` places reaches over the pairs."""
    root = np.arange(n)
    while True:
        new = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _linked(keep: Callable[[np.ndarray], np.ndarray], radius: float, count):
    """Per row with links in a cell: its smallest linked id there, and how many rows it links with."""

    def run(batches):
        for (_, _, i, j), frame in _groups(batches):
            frame = frame.sort_values("id", kind="stable")
            x, ids = np.stack(frame["v"].to_numpy()), frame["id"].to_numpy()
            inner, copies, block = frame["inner"].to_numpy(bool), frame["copies"].to_numpy(), frame["block"].to_numpy()
            left = np.flatnonzero(inner)
            links, pairs = np.zeros(len(x), np.int64), []
            for a, b, d, compared in near_pairs(x[left], x, radius):
                count.add(compared)
                a = left[a]
                # two inner rows are seen from both sides; of two blocks only pairs across are new
                good = keep(1 / (1 + d)) & (a != b) & (~inner[b] | (a < b)) & ((i == j) | (block[a] != block[b]))
                a, b = a[good], b[good]
                np.add.at(links, a, copies[b])
                np.add.at(links, b, copies[a])
                pairs.append((a, b))
                if sum(len(p[0]) for p in pairs) > 1 << 20:  # as many links as say the same
                    a, b = (np.concatenate(c) for c in zip(*pairs))
                    root = _roots(len(x), a, b)
                    pairs = [(np.flatnonzero(root != np.arange(len(x))), root[root != np.arange(len(x))])]
            a, b = (np.concatenate(c) for c in zip(*pairs)) if pairs else (np.zeros(0, int), np.zeros(0, int))
            some = np.flatnonzero(links)
            yield pd.DataFrame({"id": ids[some], "root": ids[_roots(len(x), a, b)[some]], "links": links[some]})

    return run


def links(rows: DataFrame, least: float, id_col: str = "vec_id", vector: str = "embedding", count=None) -> DataFrame:
    """(id, n_links, class_id) for each row: how many other rows have a score 1 / (1 + L2) of at least ``least`` with it,
    and the smallest id that it reaches over such links.

    Equal vectors are one row with a number first, so copies are never paired. Links are summed within
    cells, each of which sends on a star per group instead of its pairs. Vectors that are null, empty or hold nulls
    link with nothing; ids are numbers and unique. ``count`` gets the number of distances computed."""
    base = rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    live = base.where((F.size("v") > 0) & ~F.exists("v", lambda c: c.isNull() | F.isnan(c)) & F.col("id").isNotNull())
    keys = ["k1", "k2", "dim"]
    keyed = live.select("id", F.xxhash64("v").alias("k1"), F.hash("v").alias("k2"), F.size("v").alias("dim"))
    firsts = materialize(keyed.groupBy(*keys).agg(F.min("id").alias("first"), F.count("*").alias("copies")), "metric-equal")
    one = live.join(firsts.select(F.col("first").alias("id"), "copies"), "id")
    radius = radius_of(least)
    found = _members(one, None, radius).mapInPandas(_linked(lambda s: s >= least, radius * (1 + 1e-9) + 1e-12, count or _Nothing()), "id bigint, root bigint, links bigint")
    found = materialize(found, "metric-links")
    groups = connected_components(found, "id", "root")
    sums = found.groupBy("id").agg(F.sum("links").alias("links")).join(groups, "id", "left")
    sums = materialize(firsts.join(sums.withColumnRenamed("id", "first"), "first", "left"), "metric-sums")
    member = keyed.join(sums, keys).select("id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "first").alias("class_id"))
    return base.select("id").join(member, "id", "left").select("id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("class_id", "id").alias("class_id"))
