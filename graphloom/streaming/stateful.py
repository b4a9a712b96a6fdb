"""Streams with state by key and timers: debounced changes, summary schedules, and co-access weights.

State lives in the state store, so a micro-batch reads and writes the keys that it touches, and a query that starts
again from its checkpoint goes on where it was."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from graphloom.operators.heat import DECAY_FLOOR, DECAY_RATE, LEARNING_RATE

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SECOND = 1_000_000
SHARES = 512  # of the paths whose bursts are waited for together


def with_state(grouped, processor: StatefulProcessor, schema: str, time: str, spark: SparkSession) -> DataFrame:
    """Apply a processor; its kind of state needs RocksDB as the session's state store."""
    if spark.conf.get(PROVIDER, "") != ROCKSDB:
        spark.conf.set(PROVIDER, ROCKSDB)
    return grouped.transformWithStateInPandas(processor, schema, "Append", time)


def _micros(times: pd.Series) -> np.ndarray:
    return times.to_numpy().astype("datetime64[us]").astype(np.int64)


def _stamp(micros) -> np.ndarray:
    return np.asarray(micros, np.int64).astype("datetime64[us]")


class _Bursts(StatefulProcessor):
    """The events of a path wait until the watermark has passed the end of their burst.

    A key is a share of the paths, so that calls and timers are few however many paths there are. State: what each micro-batch
    brought that waits (paths, how many times each has, the times), and the first of all times, whose timer later events do not restart."""

    def __init__(self, wait: int):
        self.wait = wait

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting, self.first = handle.getListState("waiting", "paths array<string>, sizes binary, times binary"), handle.getValueState("first", "at long")

    def _due(self, first):
        return (first + self.wait) // 1000 + 1  # a timer has milliseconds; an event at the very end still counts

    @staticmethod
    def _entry(paths: np.ndarray, sizes: np.ndarray, times: np.ndarray) -> tuple:
        return paths.tolist(), sizes.astype(np.int64).tobytes(), times.tobytes()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows))
        new = _micros(frame["at"])
        codes, paths = pd.factorize(frame["path"])
        self.waiting.appendValue(self._entry(np.asarray(paths, object), np.bincount(codes, minlength=len(paths)), new[np.argsort(codes, kind="stable")]))
        old = self.first.get()[0] if self.first.exists() else None
        first = int(new.min()) if old is None else min(old, int(new.min()))
        if first != old:  # the first event, or one before it that came late
            if old is not None:
                self.handle.deleteTimer(self._due(old))
            self.first.update((first,))
            self.handle.registerTimer(self._due(first))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = list(self.waiting.get())
        names, paths = pd.factorize(np.array([p for e in held for p in e[0]], object))
        codes = np.repeat(names, np.concatenate([np.frombuffer(e[1], np.int64) for e in held]))
        times = np.concatenate([np.frombuffer(e[2], np.int64) for e in held])
        order = np.lexsort((times, codes))
        codes, times = codes[order], times[order]
        ends, due = np.cumsum(np.bincount(codes, minlength=len(paths))), self._due(times) <= timerValues.getCurrentWatermarkInMs()
        out, stay, at = [], np.zeros(len(times), bool), 0
        for code, end in enumerate(ends.tolist()):
            while at < end and due[at]:
                n = int(np.searchsorted(times[at:end], times[at] + self.wait, "right"))
                out.append((code, times[at], n))
                at += n
            stay[at:end], at = True, end
        if stay.any():
            codes, times = codes[stay], times[stay]
            some, sizes = np.unique(codes, return_counts=True)
            self.waiting.put([self._entry(paths[some], sizes, times)])
            self.first.update((int(times.min()),))
            self.handle.registerTimer(self._due(int(times.min())))
        else:  # nothing stays of paths that are quiet
            self.waiting.clear()
            self.first.clear()
        if out:
            code, first, n = zip(*out)
            yield pd.DataFrame({"path": paths[list(code)], "first": _stamp(first), "events": n})

    def close(self) -> None:
        pass


def bursts(events: DataFrame, wait: float, delay: str = "0 seconds") -> DataFrame:
    """(path, first, events): bursts of a stream of events (path, at: timestamp), each given out once when its time is over.

    The first event of a path starts a timer of ``wait`` seconds that later events do not restart; the burst takes in
    all events until then. Times are those of the events: the watermark follows the latest one by ``delay``, and events that come
    later than that are dropped. Equal to ``watch.debounced`` on the same events, but for bursts that are still open. Paths share
    state and timers, in SHARES shares."""
    share = F.pmod(F.xxhash64("path"), F.lit(SHARES)).alias("share")
    timed = events.where(F.col("path").isNotNull() & F.col("at").isNotNull()).select(share, "path", "at").withWatermark("at", delay)
    return with_state(timed.groupBy("share"), _Bursts(int(wait * SECOND)), "path string, first timestamp, events long", "EventTime", events.sparkSession)


class _Quiet(StatefulProcessor):
    """Debounce by the clock: the first change of a key starts a timer, and the key is given out when it ends.

    The state has a time to live besides, so that a key whose timer was lost does not stay for ever."""

    def __init__(self, wait_ms: int, live_ms: int):
        self.wait, self.live = wait_ms, live_ms

    def init(self, handle) -> None:
        self.handle, self.seen = handle, handle.getValueState("seen", "first long, events long", self.live)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, now = sum(map(len, rows)), timerValues.getCurrentProcessingTimeInMs()
        if self.seen.exists():
            first, before = self.seen.get()
            self.seen.update((first, before + n))
        else:
            self.seen.update((now, n))
            self.handle.registerTimer(now + self.wait)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.seen.exists():
            first, n = self.seen.get()
            self.seen.clear()
            yield pd.DataFrame({"path": [key[0]], "first": _stamp([first * 1000]), "events": [n]})

    def close(self) -> None:
        pass


def quiet_changes(changes: DataFrame, wait: float, live: float = 3600.0) -> DataFrame:
    """(path, first, events): changed paths of a running stream, each ``wait`` seconds by the clock after its first change."""
    some = changes.where(F.col("path").isNotNull()).select("path")
    return with_state(some.groupBy("path"), _Quiet(int(wait * 1000), int(live * 1000)), "path string, first timestamp, events long", "ProcessingTime", changes.sparkSession)


class _Schedule(StatefulProcessor):
    """When a key's summary is due, by counts of its nodes; state: what the last summary counted and when, and the latest count."""

    def __init__(self, least: int, change: float, every: int):
        self.least, self.change, self.every = least, change, every

    def init(self, handle) -> None:
        self.handle, self.state = handle, handle.getValueState("last", "last_n long, last_at long, n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows))
        last_n, last_at, _ = self.state.get() if self.state.exists() else (None, None, None)
        fired, was = [], last_at
        for at, n in sorted(zip(_micros(frame["at"]).tolist(), frame["n"].tolist())):
            due = last_at is None or abs(n - last_n) / max(last_n, 1) >= self.change or at - last_at >= self.every
            if n >= self.least and due:
                last_n, last_at = n, at
                fired.append((n, at))
        self.state.update((last_n, last_at, n))
        if last_at != was:
            if was is not None:
                self.handle.deleteTimer((was + self.every) // 1000 + 1)
            self.handle.registerTimer((last_at + self.every) // 1000 + 1)
        if fired:
            yield pd.DataFrame({"namespace": [key[0]] * len(fired), "n": [n for n, _ in fired], "at": _stamp([a for _, a in fired])})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Nothing came for a while: the summary is made again, with the latest count, as often as the time went by."""
        if not self.state.exists():
            return
        _, at, n = self.state.get()
        fired = []
        while at is not None and (at + self.every) // 1000 + 1 <= timerValues.getCurrentWatermarkInMs():
            at += self.every
            fired.append(at)
        if fired and n >= self.least:
            self.state.update((n, at, n))
            self.handle.registerTimer((at + self.every) // 1000 + 1)
            yield pd.DataFrame({"namespace": [key[0]] * len(fired), "n": [n] * len(fired), "at": _stamp(fired)})

    def close(self) -> None:
        pass


def summaries_due(counts: DataFrame, least: int = 3, change: float = 0.2, every: int = 1800, delay: str = "0 seconds") -> DataFrame:
    """(namespace, n, at): when summaries are to be made, from a stream of counts (namespace, n, at: timestamp).

    A summary is due at a count of at least ``least`` the first time, on a change by a fifth, and ``every`` seconds after the last
    one, for which a timer stands if no count comes."""
    timed = counts.where(F.col("n").isNotNull() & F.col("at").isNotNull()).select("namespace", F.col("n").cast("bigint"), "at").withWatermark("at", delay)
    return with_state(timed.groupBy("namespace"), _Schedule(least, change, every * SECOND), "namespace string, n long, at timestamp", "EventTime", counts.sparkSession)


class _Heat(StatefulProcessor):
    """The weight of a pair; decay is applied when it is touched again, for all rounds that went by."""

    def __init__(self, rate: float, decay: float, floor: float):
        self.rate, self.decay, self.floor = rate, decay, floor

    def init(self, handle) -> None:
        self.state = handle.getValueState("heat", "weight double, hits long, round long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        weight, hits, last = self.state.get() if self.state.exists() else (0.0, 0, None)
        touched = pd.concat(list(rows)).groupby("round").size()
        for round_, n in touched.sort_index().items():
            if last is not None and round_ > last:
                weight = max(self.floor, weight * self.decay ** (round_ - last))
            weight, hits = min(1.0, 1 - (1 - weight) * (1 - self.rate) ** n), hits + int(n)
            last = int(round_) if last is None else max(last, int(round_))
        self.state.update((float(weight), hits, last))
        yield pd.DataFrame({"namespace": [key[0]], "a": [key[1]], "b": [key[2]], "weight": [float(weight)], "hits": [hits], "round": [last]})

    def close(self) -> None:
        pass


HEAT = "namespace string, a string, b string, weight double, hits long, round long"


def heat_changes(pairs: DataFrame, rate: float = LEARNING_RATE, decay: float = DECAY_RATE, floor: float = DECAY_FLOOR) -> DataFrame:
    """A row (namespace, a, b, weight, hits, round) for every pair that a micro-batch touches, from a stream of co-accesses
    (namespace, a, b, round: the number of decay rounds so far).

    The weight is that at the row's round; ``heat_at`` brings it to a later one. Rounds of a pair should not go
    back: an access of an earlier round counts as one of the last."""
    some = pairs.select(F.coalesce("namespace", F.lit("")).alias("namespace"), "a", "b", F.col("round").cast("bigint").alias("round")).where("a IS NOT NULL AND b IS NOT NULL AND round IS NOT NULL")
    return with_state(some.groupBy("namespace", "a", "b"), _Heat(rate, decay, floor), HEAT, "None", pairs.sparkSession)


def start(changes: DataFrame, path: str, checkpoint: str, trigger: str | None = None):
    """Write a stream of changes to a folder, exactly once: what is there by now, or every ``trigger``."""
    w = changes.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
    return (w.trigger(processingTime=trigger) if trigger else w.trigger(availableNow=True)).start(path)


def heat_at(changes: DataFrame, round_: int | Column | None = None, decay: float = DECAY_RATE, floor: float = DECAY_FLOOR) -> DataFrame:
    """(namespace, a, b, weight, hits, round): the latest change of each pair, decayed to a round (None: its own)."""
    last = changes.groupBy("namespace", "a", "b").agg(F.max(F.struct("hits", "round", "weight")).alias("r")).select("namespace", "a", "b", "r.*")
    if round_ is None:
        return last.select("namespace", "a", "b", "weight", "hits", "round")
    to = round_ if isinstance(round_, Column) else F.lit(round_)
    gone = F.greatest(to - F.col("round"), F.lit(0))
    weight = F.when(gone > 0, F.greatest(F.lit(floor), F.col("weight") * F.pow(F.lit(decay), gone))).otherwise(F.col("weight"))
    return last.select("namespace", "a", "b", weight.alias("weight"), "hits", F.greatest("round", to).alias("round"))
