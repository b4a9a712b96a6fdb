"""Shared scratch space, lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_BYTES = 32 << 20  # of a table's files (or of the planner's estimate) that is sent to every executor
SPREAD_BYTES = 64 << 20  # of a scan, for each core, from which it is not looked at

PART_BYTES = 8 << 20  # of packed files, by the planner's estimate, that one part of a shuffle holds
MOST_PARTS = 20_000

_scopes: list[list[str]] = []


def scratch_root(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``, which all executors share. Where it is unset, a
    session on one machine uses a temporary folder; a cluster is an error, as its nodes share none."""
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir") or spark.conf.get("graphloom.scratch", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
        root = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("graphloom.scratch", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    path = f"{scratch_root(spark)}/graphloom/{label}-{uuid.uuid4().hex[:12]}"
    if _scopes:
        _scopes[-1].append(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, if it is there."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextlib.contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Delete at the end all scratch tables made inside: for work whose result is stored by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            delete(spark, path)


def materialize(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._graphloom_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files behind a ``materialize`` result that nothing reads any more."""
    path = getattr(df, "_graphloom_path", None)
    if path:
        delete(df.sparkSession, path)


def file_bytes(df: DataFrame) -> int:
    """The planner's estimate of a result: for a written table the size of its files."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt to all cores if it is a small scan of fewer partitions (one file, say): for work that costs far
    more than moving its rows. A scan of some size has a partition for every core and stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if file_bytes(df) > cores * SPREAD_BYTES or df._jdf.queryExecution().toRdd().getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def distinct_rows(df: DataFrame, source: DataFrame, size: int | None = None) -> DataFrame:
    """``df.distinct()`` of rows that are nearly so, made of those of ``source`` one by one. Many are dealt first, to as many
    parts as keep the table of a task small."""
    parts = -(-file_bytes(source) // (size or PART_BYTES))
    known = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) < parts <= MOST_PARTS  # rows of no file have no estimate
    return df.repartition(parts, *df.columns).distinct() if known else df.distinct()


def compact(df: DataFrame, size: int = 1 << 20) -> DataFrame:
    """A written table of at most ``size`` bytes as one partition, so that what follows needs no exchange."""
    return df.coalesce(1) if file_bytes(df) <= size else df


def broadcast_if_small(df: DataFrame, rows: int | None = None, size: int | None = None) -> DataFrame:
    """Hint a broadcast only if ``df`` (cheap to count: a materialized table) has at most ``rows`` rows, and
    at most ``size`` (or BROADCAST_BYTES) bytes by its files. Without ``rows`` only the bytes are looked at.

    Beyond that the join stays a shuffle join, which AQE may split where keys are skewed.
    """
    if file_bytes(df) > (BROADCAST_BYTES if size is None else size):
        return df
    return F.broadcast(df) if rows is None or df.limit(rows + 1).count() <= rows else df
