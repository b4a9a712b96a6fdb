"""Bounded samples of labelled rows, for fitting classifiers."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.storage import materialize

SAMPLE_TEXT = 200_000  # characters of a text that a model is fitted on; longer ones are left out whole
SAMPLE_BYTES = 64 << 20  # of all texts that a model is fitted on


def in_training(key: Column) -> Column:
    """The training folds: a CRC-32 of the id as text that is not 2 modulo 4."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit(""))), F.lit(4)) != 2


def held_out(key: Column) -> Column:
    return ~in_training(key)


def hashed_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """At most ``rows`` rows: those with the smallest hashes of ``key``, the same ones every time.

    ``df`` must be narrow (ids and labels); a threshold on the hash keeps the sort small."""
    n = df.count()
    order = F.xxhash64(F.col(key))
    if n > rows:
        # 2 ** 63 * (2 * share - 1) is the quantile of a uniform 64-bit hash
        share = min(1.0, (1.2 * rows + 8 * rows**0.5) / n)
        df = df.where(order.cast("double") <= 2.0**63 * (2 * share - 1))
    return materialize(df.orderBy(order, key).limit(rows), "sample")


def fit_on_sample(labelled: DataFrame, sample: DataFrame, key: str, fit: Callable[[list, list], Any]) -> Any:
    """``fit(texts, labels)`` for the keys of a ``sample``; ``labelled`` has (key, y, t).

    There is one row per key (the smallest label, then the smallest text, where rows repeat a key), in the order
    of keys. Texts count whole or not at all: those beyond SAMPLE_TEXT characters do not, and of the keys in the order of
    their hashes as many do as have SAMPLE_BYTES of text together. The fit runs in a task, which that bounds; the
    driver only sees lengths and the model."""
    some = labelled.where(F.col("t").isNull() | (F.length("t") <= SAMPLE_TEXT)).select(key, "y", "t").join(F.broadcast(sample), key)
    one = some.groupBy(key).agg(F.min(F.struct("y", "t")).alias("r"))
    one = materialize(one.select(key, "r.y", "r.t", F.xxhash64(F.col(key)).alias("order")), "sample-texts")
    sizes = one.select("order", F.coalesce(F.octet_length("t"), F.lit(0)).alias("n")).toPandas().sort_values("order")
    fits = sizes[sizes["n"].cumsum() <= SAMPLE_BYTES]
    if len(fits) < len(sizes):
        one = one.where(F.col("order") <= (int(fits["order"].max()) if len(fits) else -(2**63)))

    def run(batches):
        rows = sorted(((k, t, y) for b in batches for k, t, y in zip(b["key"], b["t"], b["y"])), key=lambda r: r[0])
        yield pd.DataFrame({"model": [cloudpickle.dumps(fit([t for _, t, _ in rows], [y for _, _, y in rows]))]})

    rows = one.select(F.col(key).alias("key"), "t", "y").repartition(1).mapInPandas(run, "model binary").collect()
    return cloudpickle.loads(rows[0]["model"]) if rows else fit([], [])
