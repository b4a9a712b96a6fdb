"""Sharding by extendible hashing, in DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.storage import broadcast_if_small, materialize

HASH_BITS = 60  # fifteen hex digits of an MD5, so that they fit a bigint
STEP_BITS = 8
BROADCAST_ROWS = 200_000


def shard(
    df: DataFrame, key: str, size: Column, limit: int, prefix: str = "shard_"
) -> DataFrame:
    """Add the shard of every row, so that every shard has at most ``limit`` bytes.

    The directory is indexed by the leading bits of a hash of ``key``. A bucket splits on
    another bit only while it is over the limit; ``{prefix}depth`` is its number of bits and
    ``{prefix}prefix`` their value. Rows with one hash cannot be split by bits: where they alone
    exceed the limit they go to overflow pages (``{prefix}page`` from 0) of the same bucket, so
    only a single row larger than the limit leaves a shard over it. A null key hashes like
    the empty string, a null size counts 0; an empty table gives an empty result.
    Repeated rows each count. Columns of ``df`` that begin with ``prefix`` are an error.

    Each pass aggregates bytes at eight more bits for the buckets still open, rolls the
    histogram (small) up to every depth and closes the shallowest fitting ancestors.
    """
    if clash := [c for c in df.columns if c.startswith(prefix)]:
        raise ValueError(f"columns {clash} begin with {prefix!r}")
    digest = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")))
    h, b = f"{prefix}hash", f"{prefix}bytes"
    rows = df.withColumn(h, F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")).withColumn(
        b, F.coalesce(size.cast("bigint"), F.lit(0).cast("bigint"))
    )
    narrow = rows.select(h, b)
    total = narrow.agg(F.sum(b)).first()[0] or 0
    bits = min(20, max(1, math.ceil(math.log2(max(total, 1) / limit)) + 3 if total > limit else 1))
    low, still, segments = 0, None, []
    while True:
        high = min(HASH_BITS, low + bits)
        live = narrow.withColumn("p", F.shiftright(h, HASH_BITS - high))
        if still is not None:
            was = broadcast_if_small(still, BROADCAST_ROWS)
            live = live.withColumn("o", F.shiftright("p", high - low)).join(was, "o", "left_semi")
        hist = materialize(
            live.groupBy("p").agg(F.sum(b).alias("n"), F.min(h).alias("lo"), F.max(h).alias("hi")), "shard-hist"
        )
        up = hist.withColumn("depth", F.explode(F.sequence(F.lit(low), F.lit(high)))).withColumn(
            "q", F.expr(f"shiftright(p, {high} - depth)")
        )
        sizes = up.groupBy("depth", "q").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        fits = (F.col("n") <= limit) | (F.col("lo") == F.col("hi"))
        closed = up.select("p", "depth", "q").join(sizes.where(fits), ["depth", "q"])
        if still is not None:  # the buckets of the last pass are known to be too large
            closed = closed.where(F.col("depth") > low)
        closed = closed.groupBy("p").agg(F.min_by(F.struct("depth", "q", "n"), "depth").alias("leaf"))
        leaf = closed.select(
            F.col("p").alias(f"{prefix}p"), F.col("leaf.depth").alias(f"{prefix}depth"),
            F.col("leaf.q").alias(f"{prefix}prefix"), F.col("leaf.n").alias(f"{prefix}n"),
        )
        segments.append((high, materialize(leaf, "shard-dir")))
        still = materialize(sizes.where((F.col("depth") == high) & ~fits).select(F.col("q").alias("o")), "shard-open")
        if high == HASH_BITS or still.isEmpty():
            break
        low, bits = high, STEP_BITS
    out = None
    for high, segment in segments:
        at = rows.withColumn(f"{prefix}p", F.shiftright(h, HASH_BITS - high))
        part = at.join(broadcast_if_small(segment, BROADCAST_ROWS), f"{prefix}p")
        out = part if out is None else out.unionByName(part)
    page, held = f"{prefix}page", F.col(f"{prefix}n")
    extra = [f"{prefix}p", f"{prefix}n", h]
    if all(s.where(held > limit).isEmpty() for _, s in segments):
        return out.withColumn(page, F.lit(0).cast("bigint")).drop(*extra)
    whole = out.where(held <= limit).withColumn(page, F.lit(0).cast("bigint")).drop(*extra)
    return whole.unionByName(_pages(out.where(held > limit), prefix, limit).drop(*extra))


def _pages(over: DataFrame, prefix: str, limit: int) -> DataFrame:
    """Number the overflow pages of buckets that no bit can split.

    A row above half the limit is a page of its own. The others go, as they are stored,
    to pages by the half limits that their running sum passes, so that no page is over the limit
    and all but the last of a part are half full. Running sums are made within the parts of a
    written table, whose pages are then numbered one part after another: no bucket is one task."""
    b, page, part, row = f"{prefix}bytes", f"{prefix}page", f"{prefix}part", f"{prefix}row"
    bucket = [f"{prefix}depth", f"{prefix}prefix"]
    over = over.withColumn(part, F.spark_partition_id()).withColumn(row, F.monotonically_increasing_id())
    over = materialize(over, "shard-over")
    half = max(1, limit // 2)
    big = F.col(b) > half
    mine = Window.partitionBy(*bucket, part, big).orderBy(row)
    before = F.coalesce(F.sum(b).over(mine.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    local = F.when(big, F.row_number().over(mine) - 1).otherwise(F.floor(before / half)).cast("bigint")
    local = over.withColumn(page, local).withColumn(f"{prefix}big", big)
    keys = [*bucket, part, f"{prefix}big"]
    used = local.groupBy(*keys).agg((F.max(page) + 1).alias("_pages"))
    earlier = Window.partitionBy(*bucket).orderBy(f"{prefix}big", part).rowsBetween(Window.unboundedPreceding, -1)
    first = used.select(*keys, F.coalesce(F.sum("_pages").over(earlier), F.lit(0)).alias(f"{prefix}first"))
    numbered = local.join(first, keys).withColumn(page, F.col(page) + F.col(f"{prefix}first"))
    return numbered.drop(part, row, f"{prefix}big", f"{prefix}first")


def write_shards(df: DataFrame, path: str, prefix: str = "shard_") -> None:
    """Write the rows of ``shard`` as one folder for each shard."""
    keys = [f"{prefix}depth", f"{prefix}prefix", f"{prefix}page"]
    df.repartition(*keys).write.partitionBy(*keys).parquet(path)
