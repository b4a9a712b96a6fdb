"""Replay of undo stacks from a log of their events, in parallel within a session too.

A chunk of a session's log can be replayed without what came before: entries pushed in the chunk lie on top, so an event
meets an older entry only once they are gone (or asks for an id that is not among them). Such events stay open, in
their order, and so do the entries that are left at the end: together they are a shorter log of the same kind, which
is replayed again, until one chunk holds all of a session."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.mutations import UNDO_CAP
from graphloom.storage import discard, materialize

PUSH, POP, POP_ID, POP_LATEST = "push", "pop", "pop_id", "pop_latest"
CUT = "cut"  # of an open log: entries below the chunk beyond ``room`` were pushed out
CHUNK_ROWS = 50_000
SHRINK = 0.9  # a round that leaves a larger share open is the last; then each session is one chunk

_LOG = "session string, ord bigint, sub int, op string, entry string, room int, seq bigint, done boolean, found string, refused boolean"


class _Chunk:
    """The events of one session in a row; ``whole``: nothing came before."""

    def __init__(self, session: str, cap: int, whole: bool):
        self.session, self.cap, self.whole = session, cap, whole
        self.own: list[tuple[str, int]] = []
        self.out: list[tuple] = []
        self.told = cap  # room that is left to what lies below, as far as it was said

    def _open(self, row) -> None:
        self.out.append((self.session, row.ord, row.sub, row.op, row.entry, row.room, row.seq, False, None, None))

    def _done(self, row, found: str | None, refused: bool = False) -> None:
        self.out.append((self.session, row.ord, row.sub, row.op, row.entry, row.room, row.seq, True, found, refused))

    def event(self, row) -> None:
        ids = [e for e, _ in self.own]
        if row.op == PUSH:
            self.own.append((row.entry, row.seq))
            if len(self.own) > self.cap:
                del self.own[0]
            room = self.cap - len(self.own)
            if room < self.told and not self.whole:  # the oldest of what lies below must go
                self.told = room
                self.out.append((self.session, row.ord, row.sub, CUT, None, room, row.seq, False, None, None))
        elif row.op == CUT:
            keep = min(len(self.own), row.room)
            own = self.own
            self.own = own[len(own) - keep :]
            if not self.whole and row.room - keep < self.told:
                self.told = row.room - keep
                self.out.append((self.session, row.ord, row.sub, CUT, None, row.room - keep, row.seq, False, None, None))
        elif row.op == POP_ID:
            if row.entry in ids:
                del self.own[ids.index(row.entry)]
                self._done(row, row.entry)
            elif self.whole:
                self._done(row, None)
            else:
                self._open(row)
        elif self.own:
            if row.op == POP or ids[-1] == row.entry:
                self._done(row, self.own.pop()[0])
            else:
                self._done(row, None, True)
        elif self.whole:
            self._done(row, None)
        else:
            self._open(row)

    def end(self, last: int, sub: int) -> list[tuple]:
        """Rows of the chunk: what was decided, and the shorter log, the entries that are left after all open events."""
        return self.out + [(self.session, last, sub + 1 + i, PUSH, e, 0, seq, False, None, None) for i, (e, seq) in enumerate(self.own)]


def _replay(cap: int, whole: bool):
    def run(batches):
        chunk, last = None, (0, 0)
        for batch in batches:
            rows: list[tuple] = []
            for row in batch.itertuples(index=False):
                if chunk is None or row.session != chunk.session:
                    if chunk:
                        rows += chunk.end(*last)
                    chunk = _Chunk(row.session, cap, whole)
                chunk.event(row)
                last = row.ord, row.sub
            rows += chunk.out if chunk else []
            if chunk:
                chunk.out = []
            yield _frame(rows)
        if chunk:
            yield _frame(chunk.end(*last))

    return run


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = [c.split()[0] for c in _LOG.split(", ")]
    frame = pd.DataFrame(rows, columns=names, dtype=object)
    return frame.where(frame.notna(), None)


def replay(log: DataFrame, cap: int = UNDO_CAP) -> tuple[DataFrame, DataFrame]:
    """(results, stacks) of a log (session, seq, op, entry) with the events push, pop, pop_id and pop_latest.

    results: (session, seq, op, entry, found, refused) for every event that pops: ``found`` is the entry that it removed, null if
    none; ``refused`` says that pop_latest met another entry on top. stacks: (session, depth, entry, seq), the entries
    that are left, newest first. A push beyond ``cap`` entries drops the oldest.

    Events are in the order of seq, which a session has once each; so are entries. Events of a session are cut into
    chunks of CHUNK_ROWS by their order, whatever its size. Rows without session, seq or a known event are left out."""
    known = F.col("op").isin(PUSH, POP, POP_ID, POP_LATEST) & F.col("session").isNotNull() & F.col("seq").isNotNull()
    seq = F.col("seq").cast("bigint")
    open_ = log.where(known).select(
        F.col("session").cast("string").alias("session"), seq.alias("ord"), F.lit(0).alias("sub"), "op", F.col("entry").cast("string").alias("entry"), F.lit(0).alias("room"), seq.alias("seq"),
    )
    open_ = materialize(open_, "undo-log")
    n, decided = open_.count(), []
    while True:
        chunks = max(1, -(-n // CHUNK_ROWS))
        if chunks > 1:
            dealt = open_.repartitionByRange(chunks, "session", "ord")  # entries left by a chunk share an ord, and stay together
        else:
            dealt = open_.repartition("session")
        step = dealt.sortWithinPartitions("session", "ord", "sub").mapInPandas(_replay(cap, chunks == 1), _LOG)
        step = materialize(step, "undo-step")
        decided.append(step.where("done"))
        discard(open_)
        open_ = step.where("NOT done").drop("done", "found", "refused")
        if chunks == 1:
            break
        before, n = n, open_.count()
        if n > SHRINK * before:  # what is left hardly meets within chunks: one task for each session, which streams
            n = 1
    out = decided[0]
    for d in decided[1:]:
        out = out.unionByName(d)
    left = open_.where(F.col("op") == PUSH).groupBy("session").agg(F.sort_array(F.collect_list(F.struct("sub", "entry", "seq")), asc=False).alias("e"))  # at most ``cap``
    stacks = left.select("session", F.posexplode("e").alias("i", "x")).select("session", (F.col("i") + 1).alias("depth"), F.col("x.entry").alias("entry"), F.col("x.seq").alias("seq"))
    return out.select("session", "seq", "op", "entry", "found", "refused"), stacks
