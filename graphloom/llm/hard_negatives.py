"""Hard negatives by exact inner products, with early discards along principal components."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.vector_codes import exact_rows, whole
from graphloom.storage import materialize

POSITIVES = 5
NEGATIVES = 5
LOW, HIGH = 80, 100  # of a positive's score, in hundredths: the range of its negatives
SHARD_ROWS = 65_536
LEAST_SHARD, FEW_SHARDS = 2_048, 32  # small tables still are dealt to up to 32 tasks
ANCHOR_BLOCK = 64  # anchors of a shard that are held against its rows together
LEADING = (8, 16, 32)  # numbers of leading components after which rows are discarded


def _moments(batches):
    """A task's sum of outer products, a row per dimension and component."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for dim, part in batch.groupby(batch["v"].map(len)):
            x = whole(np.stack(part["v"].to_numpy())).astype(np.float64)
            held[dim] = held.get(dim, 0) + x.T @ x
    for dim, m in held.items():
        yield pd.DataFrame({"dim": dim, "i": np.arange(dim), "m": list(m)})


def _add(frame: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"dim": frame["dim"].iloc[:1], "i": frame["i"].iloc[:1], "m": [np.sum(np.stack(frame["m"].to_numpy()), axis=0)]})


def rotations(rows: DataFrame) -> dict[int, np.ndarray]:
    """For each dimension the principal axes of all its rows as columns, those of most variance first.

    Tasks send one matrix, whose rows are added up by a grouped shuffle; dim * dim numbers reach the driver."""
    made = rows.select("v").mapInPandas(_moments, "dim int, i int, m array<double>").groupBy("dim", "i").applyInPandas(_add, "dim int, i int, m array<double>")
    out = {}
    for dim, part in made.toPandas().groupby("dim"):
        m = np.stack(part.sort_values("i")["m"].to_numpy())
        out[int(dim)] = np.ascontiguousarray(np.linalg.eigh(m)[1][:, ::-1])
    return out


class Shard:
    """Integer vectors, rotated to principal axes, with the norms of what each number of leading components leaves."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, axes: np.ndarray):
        self.ids, self.labels, self.x, self.axes = ids, labels, x, axes
        self.levels = [m for m in LEADING if m < x.shape[1]]
        self.y, self.rest, self.norm = self.turn(x)

    def turn(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        y = x.astype(np.float64) @ self.axes
        return y, [np.linalg.norm(y[:, m:], axis=1) for m in self.levels], np.linalg.norm(y, axis=1)

    def bounds(self, asked: np.ndarray):
        """For a block of anchors: the first level's bounds for all rows, and a function that gives a later
        level's bounds (lower, upper) of some rows for one anchor.

        An inner product is the partial product of the leading components and a remainder, which the norms
        of the remainders bound (Cauchy-Schwarz); ``slack`` covers the rounding of rotation and sums."""
        z, rest, norm = self.turn(asked)
        unit = 64 * self.x.shape[1] * np.finfo(np.float64).eps

        def later(a: int, rows: np.ndarray, level: int):
            m = self.levels[level]
            mid = self.y[rows, :m] @ z[a, :m]
            wide = self.rest[level][rows] * rest[level][a] + unit * norm[a] * self.norm[rows] + 1
            return mid - wide, mid + wide

        if not self.levels:  # short vectors are not worth a bound
            wide = np.full((len(asked), len(self.x)), np.inf)
            return -wide, wide, later
        m = self.levels[0]
        mid = z[:, :m] @ self.y[:, :m].T
        wide = rest[0][:, None] * self.rest[0] + unit * norm[:, None] * self.norm + 1
        return mid - wide, mid + wide, later


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        some = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        return some[np.lexsort((ids[some], -scores[some]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def _top(shard: Shard, q: np.ndarray, a: int, rows: np.ndarray, low: np.ndarray, high: np.ndarray, later, ranges: list[tuple[int, int]], k: int):
    """For each range of scores (lowest, highest; both included) the ``k`` best of ``rows``: [(rows, scores)].

    ``low`` and ``high`` bound the scores of ``rows``. Rows that can be in no range any more go after each
    level. Once ``k`` rows surely lie in a range, rows below all of them are discarded for it too."""
    floors = [lo for lo, _ in ranges]
    ceiling = max(hi for _, hi in ranges)
    for level in range(len(shard.levels) + 1):
        if level:
            low, high = later(a, rows, level) if level < len(shard.levels) else (low, high)
        for i, (lo, hi) in enumerate(ranges):
            sure = low[(low >= lo) & (high <= hi)]
            if len(sure) >= k:
                floors[i] = max(floors[i], np.partition(sure, len(sure) - k)[len(sure) - k])
        good = (high >= min(floors)) & (low <= ceiling)
        rows, low, high = rows[good], low[good], high[good]
        if level >= len(shard.levels) - 1:
            break
    exact = shard.x[rows] @ q
    out = []
    for lo, hi in ranges:
        at = np.flatnonzero((exact >= lo) & (exact <= hi))
        at = at[_best(shard.ids[rows[at]], exact[at], k)]
        out.append((rows[at], exact[at]))
    return out


LEAST = -(2**62)  # below every score


def _positives(shard: Shard, asks: pd.DataFrame, q: np.ndarray, k: int):
    low, high, later = shard.bounds(q)
    for a, (aid, label) in enumerate(zip(asks["id"], asks["label"])):
        rows = np.flatnonzero((shard.labels == label) & (shard.ids != aid))
        [(found, scores)] = _top(shard, q[a], a, rows, low[a, rows], high[a, rows], later, [(LEAST, -LEAST)], k)
        yield aid, shard.ids[found], scores, np.zeros(len(found), np.int64)


def _negatives(low: int, high: int):
    def find(shard: Shard, asks: pd.DataFrame, q: np.ndarray, k: int):
        least, most, later = shard.bounds(q)
        for a, (aid, label, scores) in enumerate(zip(asks["id"], asks["label"], asks["scores"])):
            wanted = [int(p) for p in scores]
            ranges = [(-(-low * p // 100), high * p // 100) for p in wanted]  # Python's whole numbers have no bound
            rows = np.flatnonzero(shard.labels != label)
            for p, (found, got) in zip(wanted, _top(shard, q[a], a, rows, least[a, rows], most[a, rows], later, ranges, k)):
                yield aid, shard.ids[found], got, np.full(len(found), p)

    return find


def _search(find, k: int, axes: dict[int, np.ndarray]):
    """Rows come by shard and length, first those that are searched, then the anchors, which stream by in blocks."""

    def run(batches):
        key, held, shard = None, [], None
        for batch in batches:
            for (number, dim, asked), part in batch.groupby(["shard", "dim", "asked"], sort=True):
                if (number, dim) != key:
                    key, held, shard = (number, dim), [], None
                if not asked:
                    held.append((part["id"].to_numpy(np.int64), part["label"].to_numpy(np.int64), whole(np.stack(part["v"].to_numpy()))))
                    continue
                if shard is None:
                    if not held:
                        continue
                    shard, held = Shard(*(np.concatenate(x) for x in zip(*held)), axes[dim]), []
                for s in range(0, len(part), ANCHOR_BLOCK):
                    some = part.iloc[s : s + ANCHOR_BLOCK]
                    got = list(find(shard, some, whole(np.stack(some["v"].to_numpy())), k))
                    columns = [np.concatenate([np.full(len(g[1]), g[0]) for g in got]), *(np.concatenate([g[i] for g in got]) for i in (1, 2, 3))]
                    yield pd.DataFrame(dict(zip(("anchor_id", "id", "score", "positive_score"), columns)))

    return run


def mine(
    df: DataFrame, asks: Column, label: Column, positives: int = POSITIVES, negatives: int = NEGATIVES,
    low: int = LOW, high: int = HIGH, id_col: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows where ``asks``.

    Components become floor(256 x); a score is an integer inner product, higher first, ties to the smaller id.
    An anchor's positives are its best other rows of the same ``label``; for each, the best rows of other labels are
    returned whose score is ``low`` to ``high`` hundredths of the positive's. A positive without such rows has none
    in the result.

    Rows are dealt by hash to shards, whatever their labels; anchors (a stated share of the rows) stream past each
    shard in blocks. There, bounds from leading principal components discard rows early, and integer products
    verify what is left, so results depend neither on the shards nor on the axes. Each shard sends on its best few.
    Rows with a null id or label, and vectors that are null, empty or hold null or non-finite components take no part; neither do
    components too large for 64-bit scores (370,000 at 64 dimensions). Vectors of different lengths do not
    meet. Zero vectors take part. Of rows that repeat an id the one with the smallest label and vector
    takes part. Other columns are ignored; an empty table gives no rows.
    """
    base = df.select(
        F.col(id_col).cast("bigint").alias("id"), label.cast("bigint").alias("label"), F.col(vector).alias("v"), F.coalesce(asks, F.lit(False)).alias("asks")
    )
    rows = base.where(F.col("id").isNotNull() & F.col("label").isNotNull() & exact_rows("v"))
    twice = materialize(rows.groupBy("id").count().where("count > 1").select("id"), "negatives-twice")
    if not twice.isEmpty():
        one = rows.join(twice, "id").groupBy("id").agg(F.min(F.struct("label", "v", "asks")).alias("r")).select("id", "r.*")
        rows = rows.join(twice, "id", "left_anti").unionByName(one)
    rows = rows.withColumn("dim", F.size("v"))
    n = rows.count()
    shards = max(min(FEW_SHARDS, math.ceil(n / LEAST_SHARD)), math.ceil(n / SHARD_ROWS), 1)
    axes = rotations(rows)
    none = F.lit(None).cast("array<bigint>")
    index = rows.select("id", "label", "v", "dim", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), F.lit(False).alias("asked"), none.alias("scores"))
    anchors = rows.where("asks").select("id", "label", "v", "dim")
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")

    def found(asked: DataFrame, find, k: int) -> DataFrame:
        dealt = index.unionByName(asked).repartitionById(shards, "shard").sortWithinPartitions("shard", "dim", "asked")
        return dealt.mapInPandas(_search(find, k, axes), "anchor_id bigint, id bigint, score bigint, positive_score bigint")

    def best(kind: DataFrame, k: int, *by: str) -> DataFrame:
        order = Window.partitionBy("anchor_id", *by).orderBy(F.desc("score"), "id")
        return kind.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    pairs = best(found(anchors.select("*", everywhere, F.lit(True).alias("asked"), none.alias("scores")), _positives, positives), positives)
    pairs = materialize(pairs.select("anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "negatives-positives")
    # of a negative score a larger share is less: then no row fits
    fits = F.col("positive_score") * F.lit(low).cast("decimal(9,0)") <= F.col("positive_score") * F.lit(high).cast("decimal(9,0)")
    wanted = pairs.where(fits).groupBy(F.col("anchor_id").alias("id")).agg(F.collect_set("positive_score").alias("scores"))
    asked = anchors.join(wanted, "id").select("id", "label", "v", "dim", everywhere, F.lit(True).alias("asked"), "scores")
    out = best(found(asked, _negatives(low, high), negatives), negatives, "positive_score")
    out = pairs.join(out, ["anchor_id", "positive_score"])
    return out.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
