"""Groups of sorted Arrow batches, and blocks for groups too large for one task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.storage import broadcast_if_small, materialize


def chunks(batches, keys: tuple[str, ...]):
    """(columns of keys as arrays, table, edges): tables of whole groups of rows with equal keys, and where
    the groups start (and the last one ends).

    Rows must come sorted by the keys; a group may span batches. Null keys are not expected."""

    def cut(table: pa.Table):
        columns = {k: table[k].to_numpy() for k in keys}
        change = np.zeros(table.num_rows, bool)
        for k in keys:
            change[1:] |= columns[k][1:] != columns[k][:-1]
        return columns, table, np.concatenate([[0], np.flatnonzero(change), [table.num_rows]])

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table]).combine_chunks()
        same = np.ones(table.num_rows, bool)
        for k in keys:
            column = table[k].to_numpy()
            same &= column == column[-1]
        at = table.num_rows - int(np.argmin(same[::-1])) if not same.all() else 0
        if at:
            yield cut(table.slice(0, at).combine_chunks())
        held = table.slice(at)
    if held is not None:
        yield cut(held.combine_chunks())


def slices(batches, keys: tuple[str, ...]):
    """(columns of keys as arrays, table, start, end) of every group of rows with equal keys."""
    for columns, table, edges in chunks(batches, keys):
        for s, e in zip(edges[:-1], edges[1:]):
            yield columns, table, int(s), int(e)


def paired_blocks(rows: DataFrame, cell: list[str], id_: Column, size: int, label: str, counts: DataFrame | None = None) -> DataFrame:
    """Rows with (i, j, block): a cell of more than ``size`` rows is cut by hash into blocks of about half
    that, and a row goes to every pair of blocks with its own; other cells are one block.

    ``counts`` gives the rows to count cells by, where that is narrower than ``rows``."""
    hot = (rows if counts is None else counts).groupBy(*cell).count().where(F.col("count") > size)
    hot = materialize(hot.select(*cell, F.ceil(F.col("count") / (size / 2)).cast("int").alias("blocks")), label)
    out = rows.join(broadcast_if_small(hot, 100_000), cell, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    out = out.withColumn("block", F.pmod(F.xxhash64(id_), F.col("blocks")).cast("int"))
    out = out.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return out.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other", "blocks")
