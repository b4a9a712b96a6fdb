"""Packing of documents into sequences of several permitted lengths, by best fit."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.storage import materialize

CAPACITIES = (512, 1024, 2048, 4096)
CHARS_PER_TOKEN = 4  # estimate, for texts that are not tokenized yet
OVERHEAD = 16  # cost of a sequence beside its tokens
SIXTEENTH = 16  # the size of new bins is chosen anew after each such part of the pieces of a length

SCHEMA = (
    "sequence_id bigint, capacity int, used int, token_offset int, doc_id bigint, piece int, tokens int, "
    "char_start bigint, char_end bigint"
)


class Planner:
    """Best fit, longest first, over counts of lengths instead of pieces: pieces of one length are alike,
    and so are bins with the same size and contents. A run says where some pieces of a length go.

    Bins are numbered from 0 and lie in ranges with equal size and free space; the range with the least free space that
    still takes a piece comes first, as it does piece by piece, where a bin that took one is the
    tightest for the next."""

    def __init__(self, counts: dict[int, int], capacities=CAPACITIES, overhead: int = OVERHEAD):
        self.capacities, self.overhead = sorted(capacities), overhead
        self.left, self.free = sum(n * c for n, c in counts.items()), 0  # tokens to come, free space in open bins
        self.mask, self.by_space = 0, {}  # a bit per free space, and the ranges (first bin, bins, capacity) with it
        self.bins = 0
        self.runs: list[tuple[int, int, int, int, int, int]] = []  # tokens, first piece, pieces, first bin, pieces per bin, offset
        self.final: list[tuple[int, int, int, int]] = []  # first bin, bins, capacity, used
        for need in sorted(counts, reverse=True):
            self._place(need, counts[need])
        for space, ranges in self.by_space.items():
            self.final += [(b, n, self.shrunk(c - space), c - space) for b, n, c in ranges]
        self.final.sort()

    def _shelve(self, first: int, bins: int, capacity: int, space: int) -> None:
        self.by_space.setdefault(space, []).append((first, bins, capacity))
        self.mask |= 1 << space

    def shrunk(self, used: int) -> int:
        """The least capacity that holds the contents of a bin."""
        return next(c for c in self.capacities if c >= used)

    def cheapest(self, need: int) -> int:
        """Capacity with the least cost per token that it is going to hold: of its free space the
        part counts as filled that the tokens to come can fill beside all other free space."""
        best = None
        for c in self.capacities:
            if c >= need:
                spare = c - need
                fill = min(1.0, (self.left - need) / (self.free + spare)) if spare else 0.0
                cost = (c + self.overhead) / (need + spare * max(0.0, fill))
                if best is None or cost < best[0] - 1e-12:
                    best = (cost, c)
        return best[1]

    def _fill(self, need: int, at: int, count: int, first: int, bins: int, capacity: int, space: int) -> int:
        """Put up to ``count`` pieces into a range of bins; returns how many went in."""
        each = space // need
        whole = min(bins, count // each)
        rest = count - whole * each if whole < bins else 0
        if whole:
            self.runs.append((need, at, whole * each, first, each, capacity - space))
            self._shelve(first, whole, capacity, space - each * need)
        if rest:
            self.runs.append((need, at + whole * each, rest, first + whole, each, capacity - space))
            self._shelve(first + whole, 1, capacity, space - rest * need)
            whole += 1
        if whole < bins:
            self._shelve(first + whole, bins - whole, capacity, space)
        placed = min(count, bins * each)
        self.left -= placed * need
        self.free -= placed * need
        return placed

    def _place(self, need: int, count: int) -> None:
        done = 0
        while done < count:
            fit = self.mask >> need
            if not fit:
                break
            space = need + (fit & -fit).bit_length() - 1
            ranges = self.by_space[space]
            first, bins, capacity = ranges.pop()
            if not ranges:
                del self.by_space[space]
                self.mask ^= 1 << space
            done += self._fill(need, done, count - done, first, bins, capacity, space)
        step = max(1, -(-(count - done) // SIXTEENTH))
        while done < count:
            capacity = self.cheapest(need)
            some = min(step, count - done)
            bins = -(-some // (capacity // need))
            self.free += bins * capacity
            done += self._fill(need, done, min(count - done, bins * (capacity // need)), self.bins, bins, capacity, capacity)
            self.bins += bins


def _assign(runs: list[tuple], final: list[tuple]):
    """Look up every (tokens, number) of a batch in the plan."""
    table = np.array(sorted(runs), np.int64).reshape(-1, 6)
    ends = np.array(final, np.int64).reshape(-1, 4)
    key = (table[:, 0] << 44) + table[:, 1]

    def run(batches):
        for b in batches:
            n, number = b["tokens"].to_numpy().astype(np.int64), b["number"].to_numpy()
            at = np.searchsorted(key, (n << 44) + number, side="right") - 1
            inside, each = number - table[at, 1], table[at, 4]
            bin_ = table[at, 3] + inside // each
            end = ends[np.searchsorted(ends[:, 0], bin_, side="right") - 1]
            new = [pa.array(bin_), *[pa.array(x.astype(np.int32)) for x in (end[:, 2], end[:, 3], table[at, 5] + inside % each * n)]]
            old = ["doc_id", "piece", "tokens", "char_start", "char_end"]
            yield pa.RecordBatch.from_arrays([*new, *[b[c] for c in old]], ["sequence_id", "capacity", "used", "token_offset", *old])

    return run


def pack(
    docs: DataFrame, capacities=CAPACITIES, overhead: int = OVERHEAD, key: str = "doc_id", text: str = "text",
    chars_per_token: int = CHARS_PER_TOKEN,
) -> DataFrame:
    """One row per piece of a document: its sequence, that sequence's capacity and contents, the
    token offset in it, and the span of characters.

    Texts longer than the largest capacity are cut into whole pieces of that size and a rest. All
    pieces are packed together, longest first: into the open bin that they fill best, or else a new
    one of the least-cost capacity; at the end every bin shrinks to the least capacity that holds its
    contents. The packing is planned over the counts of lengths, at most ``max(capacities)`` numbers,
    and the pieces of a length, numbered as they are stored, take its places. Tokens are
    estimated as characters over ``chars_per_token``, rounded up. Null and empty texts give no row; a
    null id is packed as such; repeated rows are packed each. Extra columns are ignored."""
    span = max(capacities) * chars_per_token
    chars = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.length(text).cast("bigint").alias("n")).where("n > 0")
    pieces = chars.select(
        "doc_id", "n", F.explode(F.sequence(F.lit(0), ((F.col("n") - 1) / span).cast("int"))).alias("piece")
    )
    start = F.col("piece").cast("bigint") * span
    pieces = pieces.select("doc_id", "piece", start.alias("char_start"), F.least(start + span, "n").alias("char_end"))
    pieces = pieces.withColumn("tokens", F.ceil((F.col("char_end") - F.col("char_start")) / chars_per_token).cast("int"))
    # written, so that a task that is run again finds the same parts and numbers
    pieces = materialize(pieces.withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id()), "pack-pieces")
    counts = materialize(pieces.groupBy("tokens", "part").agg(F.count("*").alias("c")), "pack-counts")
    lengths = {r["tokens"]: r["c"] for r in counts.groupBy("tokens").agg(F.sum("c").alias("c")).collect()}  # at most max(capacities)
    plan = Planner(lengths, capacities, overhead)
    earlier = Window.partitionBy("tokens").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offset = counts.select("tokens", "part", F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy("part", "tokens").orderBy("row"))
    numbered = pieces.withColumn("inside", inside).join(offset, ["part", "tokens"])
    numbered = numbered.select("doc_id", "piece", "char_start", "char_end", "tokens", (F.col("offset") + F.col("inside") - 1).alias("number"))
    return numbered.mapInArrow(_assign(plan.runs, plan.final), SCHEMA)
