"""Product codes of vectors: integer codebooks, refined in rounds over all rows."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.vectors import finite
from graphloom.storage import broadcast_if_small, materialize

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
BLOCK = 8_192  # rows whose distances to one codebook are held at once
SQUARES = 2.0**61  # bound on what is summed for one row: everything then fits 64 bits


def whole(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) in double precision, as 64-bit integers."""
    return np.floor(x.astype(np.float64) * scale).astype(np.int64)


def exact_rows(vector: str, scale: int = SCALE) -> Column:
    """True for finite vectors whose integers have squared distances that fit 64 bits."""
    v = F.col(vector)
    most = F.sqrt(F.lit(SQUARES) / (4 * F.greatest(F.size(v), F.lit(1)))) / scale - 1
    return finite(vector) & F.coalesce(F.forall(v, lambda x: F.abs(x.cast("double")) < most), F.lit(False))


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    """A column of lists of ``dim`` numbers as integers, a row each."""
    return whole(lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))


def nearest_entry(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry (the first of equals) and its squared distance, for each row.

    |x - b|^2 = |x|^2 - 2 x.b + |b|^2, all in exact 64-bit integers; |x|^2 is the same for all entries."""
    index, error = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
    norms = np.einsum("ij,ij->i", book, book)
    for s in range(0, len(x), BLOCK):
        part = x[s : s + BLOCK]
        far = norms - 2 * (part @ book.T)
        at = far.argmin(1)
        index[s : s + BLOCK] = at
        error[s : s + BLOCK] = far[np.arange(len(part)), at] + np.einsum("ij,ij->i", part, part)
    return index, error


def _sums(books, dim: int):
    """What one task's rows add to each entry: (part, entry, position, total, n)."""

    def run(batches):
        parts, entries, width = books.value.shape
        totals, counts = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("v"), dim)
            for p in range(parts):
                own = x[:, p * width : (p + 1) * width]
                index, _ = nearest_entry(own, books.value[p])
                order = np.argsort(index, kind="stable")
                used, starts = np.unique(index[order], return_index=True)
                totals[p, used] += np.add.reduceat(own[order], starts, axis=0)
                counts[p] += np.bincount(index, minlength=entries)
        p, e = np.nonzero(counts)
        cell = [np.repeat(a, width) for a in (p, e)]
        at = np.tile(np.arange(width), len(p))
        columns = [*cell, at, totals[p, e].ravel(), np.repeat(counts[p, e], width)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["part", "entry", "position", "total", "n"])

    return run


def _codes(books, dim: int):
    def run(batches):
        parts, entries, width = books.value.shape
        digits = np.array([f"{i:02x}" for i in range(entries)])
        for batch in batches:
            x = _matrix(batch.column("v"), dim)
            error, text = np.zeros(len(x), np.int64), np.full(len(x), "", object)
            for p in range(parts):
                index, far = nearest_entry(x[:, p * width : (p + 1) * width], books.value[p])
                error += far
                text = text + digits[index].astype(object)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"), pa.array(text, pa.string()), pa.array(error, pa.int64())], ["id", "label", "code", "error"]
            )

    return run


def compress(
    df: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id",
    vector: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256), a row per vector that takes part.

    Components become floor(256 x); a vector is cut into ``parts`` equal parts. Codebooks start as the parts of
    the ``entries`` smallest ids, and each round replaces an entry by the mean (rounded down) of the parts nearest
    to it; entries that are nearest to none stay. ``code`` has two hex digits a part; ``error`` is
    the sum of squared distances, ``label_error`` its sum over equal labels (null labels are one).

    The codebooks (parts * entries rows, whatever the table) are broadcast; tasks send one sum per entry, which
    a grouped shuffle merges each round. All arithmetic is in 64-bit integers.
    Vectors that are null, empty or hold null or non-finite components take no part; neither do those of another
    length than that of the smallest id that takes part, of a length that ``parts`` does not divide, or with
    components so large that squared distances leave 64 bits (370,000 at 64 dimensions). Zero vectors do.
    A null id is larger than every other; rows that repeat an id all take part (ties by label, then vector).
    Other columns are ignored; an empty table gives no rows.
    """
    if entries > 256 or entries < 1:
        raise ValueError("two hex digits hold 1 to 256 entries")
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).alias("label"), F.col(vector).alias("v"))
    rows = rows.where(exact_rows("v") & (F.size("v") % parts == 0))
    order = [F.asc_nulls_last("id"), "label", "v"]
    head = rows.orderBy(*order).limit(1).select(F.size("v").alias("dim")).collect()
    dim = head[0]["dim"] if head else parts
    rows = rows.where(F.size("v") == dim)
    seeds = [r["v"] for r in rows.orderBy(*order).limit(entries).select("v").collect()]
    width = dim // parts
    first = whole(np.array(seeds, np.float64).reshape(-1, parts, width))
    books = np.ascontiguousarray(first.transpose(1, 0, 2)) if len(seeds) else np.zeros((parts, 1, width), np.int64)
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(books)
        some = rows.select("v").mapInArrow(_sums(sent, dim), "part bigint, entry bigint, position bigint, total bigint, n bigint")
        merged = some.groupBy("part", "entry", "position").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()
        books = books.copy()
        for r in merged:  # at most parts * entries * width numbers
            books[r["part"], r["entry"], r["position"]] = r["total"] // r["n"]
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    kind = df.schema[label_col].dataType.simpleString()
    coded = rows.mapInArrow(_codes(spark.sparkContext.broadcast(books), dim), f"id bigint, label {kind}, code string, error bigint")
    coded = materialize(coded, "codes")
    label_errors = materialize(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "code-errors")
    out = coded.alias("c").join(broadcast_if_small(label_errors, 300_000).alias("e"), F.col("c.label").eqNullSafe(F.col("e.label")))
    return out.select(F.col("c.id").alias("vec_id"), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
