"""Nearest neighbours by a hash-prefix forest: sorted long hash strings in every tree."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.vectors import stack, usable
from graphloom.storage import materialize

TREES = 256
BITS = 48
EFFORT = 10.0  # rows that a query scores among n: this times n to the power 2/3
SHARD_ROWS = 65_536  # rows of one forest: about 300 MB at 64 dimensions
LEAST_SHARD, FEW_SHARDS = 2_048, 8  # small tables too are dealt to up to eight shards; the rows decide, not the cores
QUERY_ROWS = 512  # queries of a shard that are answered together


def planes(dim: int, trees: int, bits: int, seed: int = 7) -> np.ndarray:
    """The hyperplanes of all trees, the same ones for every shard; those of a tree are orthogonal as far
    as the dimension goes, so that their bits depend less on one another."""
    rng, out = np.random.default_rng([seed, dim]), []
    for _ in range(trees):
        left = bits
        while left > 0:
            out.append(np.linalg.qr(rng.standard_normal((dim + 1, dim + 1)))[0][:, :left])
            left -= dim + 1
    return np.concatenate(out, axis=1).astype(np.float32)


class Forest:
    """``trees`` sorted arrays of ``bits``-bit hash strings (signs of random projections)."""

    def __init__(self, vectors: np.ndarray, trees: int, bits: int):
        self.vectors, self.trees, self.bits = vectors, trees, bits
        # a further coordinate that makes all norms equal turns inner products into angles
        norms = np.einsum("ij,ij->i", vectors, vectors)
        extra = np.sqrt(np.maximum(norms.max(initial=0.0) - norms, 0.0))
        self.planes = planes(vectors.shape[1], trees, bits)
        hashes = self._hash(vectors, extra)
        self.order = np.argsort(hashes, axis=1, kind="stable").astype(np.int32)
        self.strings = np.take_along_axis(hashes, self.order, axis=1)

    def _hash(self, vectors: np.ndarray, extra: np.ndarray) -> np.ndarray:
        """Hash strings as numbers, a row per tree."""
        out = np.empty((self.trees, len(vectors)), np.int64)
        weight = np.int64(1) << np.arange(self.bits - 1, -1, -1)
        for s in range(0, len(vectors), 4096):
            full = np.column_stack([vectors[s : s + 4096], extra[s : s + 4096]]).astype(np.float32)
            for t in range(self.trees):
                out[t, s : s + 4096] = (full @ self.planes[:, t * self.bits : (t + 1) * self.bits] > 0) @ weight
        return out

    def candidates(self, queries: np.ndarray, least: int):
        """Yield for each query the numbers of at least ``least`` rows (all, if there are fewer).

        Every tree is descended to its longest matching prefix; from there all trees ascend
        level by level together until the rows under the shared prefixes are enough."""
        n, least = len(self.vectors), min(least, len(self.vectors))
        hashes = self._hash(queries, np.zeros(len(queries)))
        # rows under a prefix are under every shorter one too: bisection finds the level
        level, short = np.zeros(len(queries), np.int64), np.full(len(queries), self.bits + 1)
        while (short - level > 1).any():
            middle = (level + short) // 2
            lo, hi = self._ranges(hashes, middle)
            good = (hi - lo).sum(0) >= least
            level, short = np.where(good, middle, level), np.where(good, short, middle)
        # one row may be under several trees' prefixes: then a level more is needed, and as a rule no other
        ranges = [self._ranges(hashes, np.maximum(level - up, 0)) for up in (0, 1)]
        flat_order, base = self.order.ravel(), np.arange(self.trees, dtype=np.int64) * n
        eighths = np.array_split(np.arange(self.trees), 8)
        seen = np.zeros(n, bool)
        for at in range(len(queries)):
            up = 0
            while True:
                a, b = (x[:, at] for x in ranges[up]) if up < 2 else (x[:, 0] for x in self._ranges(hashes[:, at : at + 1], level[at : at + 1] - up))
                seen[:] = False
                for some in eighths:  # of the last level only what is needed
                    size = b[some] - a[some]
                    seen[flat_order[np.repeat(a[some] + base[some] - np.cumsum(size) + size, size) + np.arange(size.sum())]] = True
                    if np.count_nonzero(seen) >= least:
                        break
                found = np.flatnonzero(seen)
                if len(found) >= least:
                    break
                up += 1
            yield found

    def _ranges(self, hashes: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every tree and query the range of rows that share ``level`` leading bits."""
        shift = self.bits - level
        low = (hashes >> shift) << shift
        high = low + (np.int64(1) << shift)
        return tuple(np.array([s.searchsorted(x) for s, x in zip(self.strings, ends)]) for ends in (low, high))


def _answer(forest: Forest, ids: np.ndarray, qids: np.ndarray, queries: np.ndarray, k: int, least: int) -> pa.RecordBatch:
    """The best ``k`` of each query among its candidates, which alone are scored."""
    out = [], [], []
    for qid, q, found in zip(qids, queries, forest.candidates(queries, least)):
        found = found[ids[found] != qid]
        score = np.einsum("ij,j->i", forest.vectors[found], q)
        if len(found) > k:
            good = np.flatnonzero(score >= np.partition(score, len(found) - k)[len(found) - k])
            found, score = found[good], score[good]
        best = np.lexsort((ids[found], -score))[:k]
        out[0].append(np.full(len(best), qid))
        out[1].append(ids[found][best])
        out[2].append(score[best])
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["query_id", "vec_id", "score"])


def share(n: int, effort: float = EFFORT) -> float:
    """Share of ``n`` rows that a query scores: it falls with the cube root of the rows."""
    return min(1.0, effort * max(1, n) ** (-1 / 3))


def _search(k: int, effort: float, shards: int, trees: int, bits: int):
    """Rows come by shard and length, first those of the index, then the queries, which stream by."""

    def run(batches):
        key, held, forest, ids, least = None, [], None, None, 0
        for batch in batches:
            frame = batch.to_pandas()
            for (shard, dim, asks), part in frame.groupby(["shard", "dim", "asks"], sort=True):
                if (shard, dim) != key:
                    key, held, forest = (shard, dim), [], None
                if not asks:
                    held.append((part["id"].to_numpy(np.int64), stack(part["v"])))
                    continue
                if forest is None:
                    if not held:
                        continue
                    ids = np.concatenate([x for x, _ in held])
                    forest = Forest(np.concatenate([x for _, x in held]), trees, bits)
                    held = []
                    # shards are dealt by hash, so that each is a sample of all rows
                    least = math.ceil(share(len(ids) * shards, effort) * len(ids)) + k + 1
                for s in range(0, len(part), QUERY_ROWS):
                    some = part.iloc[s : s + QUERY_ROWS]
                    yield _answer(forest, ids, some["id"].to_numpy(np.int64), stack(some["v"]), k, least)

    return run


def nearest(
    df: DataFrame, asks: Column, k: int = 20, effort: float = EFFORT, id_col: str = "vec_id",
    vector: str = "embedding", trees: int = TREES, bits: int = BITS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where ``asks``, the ``k`` rows found with the
    largest inner products, nearest first, ties to the smaller id, itself left out.

    The rows are dealt by hash into shards with a forest each and are sent once. The queries visit
    every shard, stream past its forest, and score only the rows that the forest gives them:
    ``share(n)`` of all, which falls with the rows (raise ``effort`` for more recall, lower it where
    vectors cluster; recall is measured in the tests and the README). The k best of every shard meet
    by query. Vectors that are null, empty, zero or not finite, and rows without id take no part;
    vectors of other lengths are no candidates; an empty table gives no rows. Repeated rows are
    candidates each, but rows with the id of the query are not.
    """
    rows = df.where(F.col(id_col).isNotNull() & usable(vector)).select(
        F.col(id_col).cast("bigint").alias("id"), F.col(vector).alias("v"), F.size(vector).alias("dim"), F.coalesce(asks, F.lit(False)).alias("asks")
    )
    n = rows.count()
    shards = max(1, math.ceil(n / SHARD_ROWS), min(FEW_SHARDS, n // LEAST_SHARD))
    index = rows.select("id", "v", "dim", F.lit(False).alias("asks"), F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"))
    asked = rows.where("asks").select("id", "v", "dim", "asks", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    dealt = index.unionByName(asked).repartitionById(shards, "shard").sortWithinPartitions("shard", "dim", "asks")
    found = dealt.mapInArrow(_search(k, effort, shards, trees, bits), "query_id bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        materialize(found, "forest").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
