"""Structured Streaming over file sources: co-access, change propagation and summary schedules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.federation import summary_due
from graphloom.operators.heat import LEARNING_RATE, merge
from graphloom.operators.integrity import changed, propagate_stale
from graphloom.operators.mutations import upsert_embeddings
from graphloom.storage import materialize, scratch_path

DEBOUNCE = "2 seconds"


def read_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 64, format: str = "parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(format).load(path)


def run(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, trigger: str | None = None):
    """Start a query on micro-batches: what is there by now, or every ``trigger``, which also debounces."""
    w = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=trigger) if trigger else w.trigger(availableNow=True)).start()


class Table:
    """A table that micro-batches replace: each version is a folder, the latest one is current.

    A version is named by its batch, so that a batch that runs again writes the same one."""

    def __init__(self, spark: SparkSession, schema, root: str | None = None):
        self.spark, self.schema = spark, schema
        self.root = root or scratch_path(spark, "stream")
        self.version = -1

    def read(self, before: int | None = None) -> DataFrame:
        version = self.version if before is None else before
        return self.spark.createDataFrame([], self.schema) if version < 0 else self.spark.read.schema(self.schema).parquet(f"{self.root}/v={version}")

    def write(self, df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.root}/v={batch}")
        self.version = batch


def heat_updates(access: DataFrame, table: Table, checkpoint: str, rate: float = LEARNING_RATE, pairs: Callable | None = None, trigger: str | None = None):
    """Keep co-access weights up to date from a stream of pairs (namespace, a, b, last)."""

    def each(batch: DataFrame, number: int) -> None:
        new = (pairs(batch) if pairs else batch).groupBy("namespace", "a", "b").agg(F.count("*").cast("int").alias("hits"), F.max("last").alias("last"))
        table.write(merge(table.read(number - 1 if number else -1), new, rate), number)

    return run(access, each, checkpoint, trigger)


def pair_counts(pairs: DataFrame) -> DataFrame:
    """Running counts by pair, for a sink in update or complete mode; weights follow in closed form."""
    hits = pairs.groupBy("namespace", "a", "b").agg(F.count("*").alias("hits"))
    return hits.withColumn("weight", F.least(F.lit(1.0), 1 - F.pow(F.lit(1 - LEARNING_RATE), F.col("hits"))))


class Feed:
    """A counter of changes with subscribers, which hear of every version once."""

    def __init__(self):
        self.version, self.subscribers = 0, []

    def subscribe(self, hear: Callable[[int, str], None]) -> Callable[[], None]:
        """Returns the function that ends the subscription."""
        self.subscribers.append(hear)
        return lambda: self.subscribers.remove(hear)

    def publish(self, kind: str = "graph") -> int:
        self.version += 1
        for hear in list(self.subscribers):
            hear(self.version, kind)
        return self.version


def is_node_file(path: Column) -> Column:
    """Markdown files outside hidden and underscore folders; what else changes in a vault is no node."""
    parts = F.split(path, "/")
    return path.endswith(".md") & ~F.exists(parts, lambda p: p.startswith(".") | p.startswith("_"))


def debounced(events: DataFrame, wait: float) -> DataFrame:
    """(path, first, events): bursts of events (path, at in seconds) by the rule of a timer that the first event starts
    and later ones do not restart. A burst takes in all events up to ``wait`` seconds after its first."""
    spots = events.groupBy("path").agg(F.array_sort(F.collect_list(F.col("at").cast("double"))).alias("at"))  # the events of one file
    none = F.array().cast("array<struct<first:double,events:int>>")
    step = lambda s, t: F.when(
        (F.size(s) > 0) & (t <= F.element_at(s, -1)["first"] + wait),
        F.concat(F.slice(s, 1, F.size(s) - 1), F.array(F.struct(F.element_at(s, -1)["first"].alias("first"), (F.element_at(s, -1)["events"] + 1).cast("int").alias("events")))),
    ).otherwise(F.concat(s, F.array(F.struct(t.alias("first"), F.lit(1).alias("events")))))
    # element_at of an empty array is an error even where its branch is not taken
    guarded = lambda s, t: F.when(F.size(s) == 0, F.array(F.struct(t.alias("first"), F.lit(1).alias("events")))).otherwise(step(s, t))
    return spots.select("path", F.explode(F.aggregate("at", none, guarded)).alias("b")).select("path", "b.first", "b.events")


def source_changes(files: DataFrame, nodes: Callable[[], DataFrame], edges: Callable[[], DataFrame], act: Callable[[DataFrame, DataFrame, int], None], checkpoint: str,
                   depth: int = 3, trigger: str | None = DEBOUNCE):
    """On changed files (path, hash): find nodes with an old hash, what depends on them, and act on both."""

    def each(batch: DataFrame, number: int) -> None:
        n = nodes().join(batch.select(F.col("path").alias("_p")).distinct(), F.col("source.path") == F.col("_p"), "left_semi")
        hit = materialize(changed(n, batch), "stream-changed")
        if not hit.isEmpty():
            act(hit, propagate_stale(edges(), hit, depth), number)

    return run(files, each, checkpoint, trigger)


def reindex(nodes: DataFrame, store: DataFrame, hit: DataFrame, embed: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Refresh source hashes (cleared for missing files) and embed the changed nodes again."""
    h = hit.select("id", F.col("current_hash").alias("_h"))
    out = nodes.join(h, "id", "left")
    out = out.withColumn("source", F.when(F.col("_h").isNotNull(), F.col("source").withField("hash", F.col("_h"))).otherwise(F.col("source"))).select(nodes.columns)
    return out, upsert_embeddings(store, embed(out.join(hit.select("id"), "id", "left_semi")))


def after_write(edges: DataFrame, written: DataFrame) -> DataFrame:
    """Neighbours to index again after a write: one step over in-edges."""
    return propagate_stale(edges, written, 1).where("depth = 1")


def vault_reload(files: DataFrame, load: Callable[[], DataFrame], publish: Callable[[DataFrame, int], None], checkpoint: str, trigger: str | None = "1 second"):
    """On any change of node files (path) load the vault again and swap the published view."""

    def each(batch: DataFrame, number: int) -> None:
        touched = batch.where(is_node_file(F.col("path"))) if "path" in batch.columns else batch
        if not touched.isEmpty():
            publish(load(), number)

    return run(files, each, checkpoint, trigger)


def summary_schedule(counts: DataFrame, state: Table, fire: Callable[[DataFrame, int], None], checkpoint: str, now: str | None = None, trigger: str | None = None):
    """From a stream of (namespace, n): namespaces whose summary is due are handed on, and remembered."""

    def each(batch: DataFrame, number: int) -> None:
        new = batch.groupBy("namespace").agg(F.max("n").alias("n"))
        old = state.read(number - 1 if number else -1)
        at = F.lit(now).cast("timestamp") if now else F.current_timestamp()
        due = materialize(summary_due(new.join(old, "namespace", "left"), at).select("namespace", "n"), "due")
        if not due.isEmpty():
            fire(due, number)
        done = due.select("namespace", F.col("n").alias("last_n"), at.cast("string").alias("last_at"))
        state.write(old.join(done, "namespace", "left_anti").unionByName(done), number)

    return run(counts, each, checkpoint, trigger)


class Snapshot:
    """A cached table that is read again after a while; the old copy is let go."""

    def __init__(self, load: Callable[[], DataFrame], ttl: float = 60.0, clock: Callable[[], float] | None = None):
        import time

        self.load, self.ttl, self.clock = load, ttl, clock or time.monotonic
        self.df, self.at = None, 0.0

    def get(self) -> DataFrame:
        if self.df is None or self.clock() - self.at > self.ttl:
            self.drop()
            self.df, self.at = self.load().persist(), self.clock()
        return self.df

    def drop(self) -> None:
        if self.df is not None:
            self.df.unpersist()
        self.df = None
