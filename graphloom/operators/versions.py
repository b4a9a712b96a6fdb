"""Tables of immutable versions: optimistic commits that are refused on conflict, reads of any version, and reverts.

A commit writes the rows it changes as Parquet, then claims the next number by creating its manifest, which only one
writer can. A writer that finds the number taken compares the keys it touched with those of the commits in between: without a
common one it claims the next number, otherwise it is refused. Reading merges the changes since the last whole snapshot."""

from __future__ import annotations

import json
import os
import time
import uuid
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from graphloom.storage import broadcast_if_small, delete

GONE = "_gone"
SAID = 20  # keys that a refusal names


class Conflict(Exception):
    """Another commit touched the same keys since the version that this one was based on."""

    def __init__(self, version: int, keys: list):
        super().__init__(f"version {version} touched {', '.join(map(str, keys))}")
        self.version, self.keys = version, keys


@dataclass
class Manifest:
    """One version: where its rows are, whether they are the whole table, and what made it."""

    version: int
    data: str
    whole: bool
    note: str
    at: float
    base: int


class VersionedTable:
    """A table (rows with a ``key``, which is unique) in a folder that all writers share."""

    def __init__(self, spark: SparkSession, root: str, schema, key: str = "id", clock: Callable[[], float] = time.time):
        self.spark, self.root, self.key, self.clock = spark, root.rstrip("/"), key, clock
        self.schema = spark.createDataFrame([], schema).schema
        self.columns = self.schema.fieldNames()

    # the log

    def _fs(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def _name(self, version: int) -> str:
        return f"{self.root}/_log/{version:020}.json"

    def _create(self, path: str, text: str) -> bool:
        """Create a file that no other writer has created; False if one has."""
        fs, where = self._fs(path)
        fs.mkdirs(where.getParent())
        uri = fs.makeQualified(where).toUri()
        if uri.getScheme() == "file":  # the local file system's own exclusive creation is no single step in Hadoop
            try:
                with os.fdopen(os.open(uri.getPath(), os.O_CREAT | os.O_EXCL | os.O_WRONLY), "w") as f:
                    f.write(text)
                return True
            except FileExistsError:
                return False
        try:
            out = fs.create(where, False)
        except Exception as e:  # noqa: BLE001
            if "FileAlreadyExists" in str(e):
                return False
            raise
        out.write(text.encode())
        out.close()
        return True

    def manifests(self) -> list[Manifest]:
        """All versions that are kept, oldest first."""
        fs, where = self._fs(f"{self.root}/_log")
        if not fs.exists(where):
            return []
        names = sorted(s.getPath().toString() for s in fs.listStatus(where) if s.getPath().getName().endswith(".json"))
        if not names:
            return []
        rows = self.spark.read.text(names, wholetext=True).collect()
        return sorted((Manifest(**json.loads(r[0])) for r in rows if r[0]), key=lambda m: m.version)

    def head(self) -> int:
        """The latest version, 0 before the first commit."""
        fs, where = self._fs(f"{self.root}/_log")
        if not fs.exists(where):
            return 0
        return max((int(s.getPath().getName()[:20]) for s in fs.listStatus(where) if s.getPath().getName().endswith(".json")), default=0)

    # reading

    def _stored(self) -> StructType:
        return StructType([*self.schema.fields, StructField(GONE, BooleanType())])

    def read(self, version: int | None = None) -> DataFrame:
        """The table as of a version (None: the latest); ValueError if it is not kept."""
        log = self.manifests()
        if version is None:
            version = log[-1].version if log else 0
        if version == 0:
            return self.spark.createDataFrame([], self.schema)
        kept = [m for m in log if m.version <= version]
        start = max((i for i, m in enumerate(kept) if m.whole), default=None)
        if not kept or kept[-1].version != version or start is None:
            raise ValueError(f"version {version} is not kept")
        parts = [self.spark.read.schema(self._stored()).parquet(m.data).withColumn("_v", F.lit(m.version)) for m in kept[start:]]
        if len(parts) == 1:
            return parts[0].where(f"NOT {GONE}").select(self.columns)
        # only keys that a later change touches meet; the rest of the snapshot is read as it is
        later = reduce(DataFrame.unionByName, parts[1:])
        last = later.groupBy(self.key).agg(F.max_by(F.struct(*self.columns, GONE), "_v").alias("r")).select("r.*")
        keys = last.select(self.key)
        old = parts[0].where(f"NOT {GONE}").join(broadcast_if_small(keys, size=8 << 20), self.key, "left_anti")
        return old.select(self.columns).unionByName(last.where(f"NOT {GONE}").select(self.columns))

    def touched(self, version: int) -> DataFrame:
        """The keys that one commit wrote or removed."""
        [m] = [m for m in self.manifests() if m.version == version]
        return self.spark.read.schema(self._stored()).parquet(m.data).select(self.key)

    # writing

    def commit(self, upserts: DataFrame | None = None, removals: DataFrame | None = None, base: int | None = None, note: str = "") -> int:
        """Write changed rows and removed keys on top of what ``base`` held (None: the latest), and return the new version.

        Raises Conflict if a commit since ``base`` touched one of the keys; then nothing is changed. A key that is both
        written and removed is written; of rows that repeat a key one is kept."""
        base = self.head() if base is None else base
        rows = None
        if upserts is not None:
            rows = upserts.select(self.columns).where(F.col(self.key).isNotNull()).dropDuplicates([self.key]).withColumn(GONE, F.lit(False))
        if removals is not None:
            gone = removals.select(self.key).where(F.col(self.key).isNotNull()).distinct().withColumn(GONE, F.lit(True))
            gone = gone if rows is None else gone.join(rows.select(self.key), self.key, "left_anti")
            rows = gone.select(*[F.col(c) if c == self.key else F.lit(None).cast(self.schema[c].dataType).alias(c) for c in self.columns], GONE) if rows is None else rows.unionByName(gone, allowMissingColumns=True)
        if rows is None:
            raise ValueError("a commit needs rows or removals")
        return self._claim(rows, base, base == 0, note)

    def _claim(self, rows: DataFrame, base: int, whole: bool, note: str) -> int:
        data = f"{self.root}/data/{uuid.uuid4().hex}"
        rows.select(*self.columns, GONE).write.parquet(data)
        mine = self.spark.read.schema(self._stored()).parquet(data).select(self.key)
        seen = base
        try:
            while True:
                for m in self.manifests():
                    if m.version > seen:
                        theirs = self.spark.read.schema(self._stored()).parquet(m.data)
                        # a snapshot says nothing new; a first table touches all its keys
                        both = [] if m.note == "snapshot" else [r[0] for r in mine.join(theirs.select(self.key), self.key, "left_semi").limit(SAID).collect()]
                        if both:
                            raise Conflict(m.version, sorted(both))
                        seen, whole = m.version, False
                version = seen + 1
                if self._create(self._name(version), json.dumps(asdict(Manifest(version, data, whole, note, self.clock(), base)))):
                    return version
        except Conflict:
            delete(self.spark, data)
            raise

    def revert(self, version: int, note: str = "") -> int:
        """Undo one commit by another: its keys get back what they held before. Refused if a later commit touched one of them."""
        keys = self.touched(version)
        before = self.read(version - 1).join(keys, self.key, "left_semi")
        return self.commit(before, keys, base=version, note=note or f"revert {version}")

    def snapshot(self) -> int:
        """Write the latest version whole, so that reads need no earlier change; a commit meanwhile makes it start again."""
        while True:
            at = self.head()
            data = f"{self.root}/data/{uuid.uuid4().hex}"
            self.read(at).withColumn(GONE, F.lit(False)).write.parquet(data)
            if self._create(self._name(at + 1), json.dumps(asdict(Manifest(at + 1, data, True, "snapshot", self.clock(), at)))):
                return at + 1
            delete(self.spark, data)

    def expire(self, keep: int = 1, older: float = 0.0) -> list[int]:
        """Forget versions before the last ``keep`` that are older than so many seconds; of what the others need nothing goes."""
        log = self.manifests()
        first = min((m.version for m in log[-keep:]), default=0)
        start = max((m.version for m in log if m.whole and m.version <= first), default=0)
        old = [m for m in log if m.version < start and self.clock() - m.at >= older]
        for m in old:  # the manifest goes first: what it names is never half there
            delete(self.spark, self._name(m.version))
            delete(self.spark, m.data)
        return [m.version for m in old]


class VersionCache:
    """Tables of several vaults in memory: each is looked at again after ``ttl`` seconds, loaded anew if it has another version
    by then, and the one that was not used for longest goes when there are more than ``most``."""

    def __init__(self, open_: Callable[[str], VersionedTable], ttl: float = 60.0, most: int = 16, clock: Callable[[], float] = time.monotonic):
        self.open, self.ttl, self.most, self.clock = open_, ttl, most, clock
        self.held: OrderedDict[str, tuple[int, DataFrame, float]] = OrderedDict()

    def get(self, name: str) -> DataFrame:
        now, known = self.clock(), self.held.get(name)
        if known is not None and now - known[2] <= self.ttl:
            self.held.move_to_end(name)
            return known[1]
        table = self.open(name)
        version = table.head()
        if known is None or known[0] != version:
            self.drop(name)
            known = (version, table.read(version).persist(), now)
        self.held[name] = (known[0], known[1], now)
        self.held.move_to_end(name)
        while len(self.held) > self.most:
            self.drop(next(iter(self.held)))
        return known[1]

    def drop(self, name: str) -> None:
        """Let one go, so that the next use loads it again."""
        if name in self.held:
            self.held.pop(name)[1].unpersist()

    def refresh(self) -> list[str]:
        """Names of the tables that have another version by now; they are loaded at their next use."""
        old = [n for n, (version, _, _) in self.held.items() if self.open(n).head() != version]
        for n in old:
            self.drop(n)
        return old
