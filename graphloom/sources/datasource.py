"""Vaults as a data source: ``spark.read.format("vault")``, ``df.write.format("vault")`` and ``spark.readStream``.

Files are reached through Arrow's file systems, by the tasks; the driver lists and renames only. Call ``register`` once a
session. Options: ``path`` (folder or URI), ``vault_id``, ``layout`` ("ids": every node is in <id>.md, as the writer
makes it, so that an id names its file; "free": ids may differ from paths), ``files_per_partition``."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, IsNotNull, WriterCommitMessage,
)
from pyspark.sql.types import StructType

from graphloom.functions.text import id_is_valid
from graphloom.schema import NODES
from graphloom.sources.vault import load_yaml, parse_node, render_node, split_frontmatter

PUSHED = ("id", "type", "namespace", "status")  # columns whose filters are decided by the frontmatter
STAGING = "_staging"  # readers skip folders that begin so
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and let filters reach it."""
    spark.dataSource.register(VaultSource)
    spark.conf.set(PUSHDOWN, "true")


def _open(path: str) -> tuple[fs.FileSystem, str]:
    where, root = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + posixpath.abspath(path))
    return where, root.rstrip("/")


def _rel(root: str, path: str) -> str:
    return path[len(root) + 1 :]


def is_node_path(rel: str) -> bool:
    return rel.endswith(".md") and not any(p.startswith((".", "_")) for p in rel.split("/"))


def _listed(where: fs.FileSystem, root: str) -> list[fs.FileInfo]:
    """Node files in the order of their paths."""
    found = where.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    return sorted((f for f in found if f.is_file and is_node_path(_rel(root, f.path))), key=lambda f: f.path)


def _text(where: fs.FileSystem, path: str) -> str:
    with where.open_input_stream(path) as f:
        return f.read().decode("utf-8", "replace")


def _row(node: dict, vault_id: str | None) -> tuple:
    source = node["source"]
    plain = node | {"source": (source["path"], source["lines"], source["hash"]), "edges": [(e["target"], e["relation"]) for e in node["edges"]], "vault_id": vault_id}
    return tuple(plain[f] for f in NODES.fieldNames())


@dataclass
class Files(InputPartition):
    """Paths below the root that one task reads."""

    paths: tuple[str, ...]


def _nodes(path: str, files: Files, vault_id: str | None, wanted: dict[str, frozenset]) -> Iterator[tuple]:
    """The nodes of some files; a file whose frontmatter a filter refuses is not parsed further, and broken ones are skipped."""
    where, root = _open(path)
    for rel in files.paths:
        try:
            text = _text(where, f"{root}/{rel}")
            if wanted:
                head = load_yaml(split_frontmatter(text)[0]) or {}
                own = {k: str(head.get(k) or "") for k in wanted}
                if "id" in own:
                    own["id"] = own["id"] or rel.removesuffix(".md")
                if any(own[k] not in v for k, v in wanted.items()):
                    continue
            node = parse_node(text, rel)
        except FileNotFoundError:  # gone since it was listed
            continue
        except Exception:  # noqa: BLE001  malformed files must not end the scan
            continue
        if id_is_valid(node["id"]):
            yield _row(node, vault_id)


class VaultReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.vault_id = options["path"], options.get("vault_id")
        self.by_id, self.step = options.get("layout", "free") == "ids", int(options.get("files_per_partition", 256))
        self.wanted: dict[str, frozenset] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Take equality filters on the columns of the frontmatter; Spark applies the others."""
        for f in filters:
            if isinstance(f, IsNotNull) and len(f.attribute) == 1 and f.attribute[0] in PUSHED:
                continue  # these are never null
            values = frozenset([f.value]) if isinstance(f, EqualTo) else frozenset(f.value) if isinstance(f, In) else None
            if values is None or len(f.attribute) != 1 or f.attribute[0] not in PUSHED or not all(isinstance(v, str) for v in values):
                yield f
            else:
                known = self.wanted.get(f.attribute[0])
                self.wanted[f.attribute[0]] = values if known is None else known & values

    def partitions(self) -> Sequence[Files]:
        where, root = _open(self.path)
        if self.by_id and "id" in self.wanted:
            paths = [f"{i}.md" for i in sorted(self.wanted["id"]) if id_is_valid(i)]
        else:
            paths = [_rel(root, f.path) for f in _listed(where, root)]
        return [Files(tuple(paths[s : s + self.step])) for s in range(0, len(paths), self.step)] or [Files(())]

    def read(self, partition: Files) -> Iterator[tuple]:
        return _nodes(self.path, partition, self.vault_id, self.wanted)


@dataclass
class Staged(WriterCommitMessage):
    """What one task has written: a folder of its own, with as many files."""

    folder: str
    files: int


class VaultWriter(DataSourceWriter):
    """Tasks write below a staging folder, each in a folder of its own. Only the driver's commit moves files to their
    places, and only those of tasks that ended well; what failed or was run twice goes with the staging folder.

    Appending replaces nodes of the same id; overwriting also removes the others."""

    def __init__(self, options: dict, fields: list[str], overwrite: bool):
        self.path, self.fields, self.overwrite = options["path"], fields, overwrite
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator) -> Staged:
        where, root = _open(self.path)
        folder, n, made = f"{STAGING}/{self.job}/{uuid.uuid4().hex}", 0, set()
        for row in iterator:
            node = row.asDict(recursive=True)
            if not id_is_valid(node.get("id")):
                continue
            at = f"{root}/{folder}/{node['id']}.md"
            if (parent := posixpath.dirname(at)) not in made:
                where.create_dir(parent, recursive=True)
                made.add(parent)
            with where.open_output_stream(at) as f:
                f.write(render_node(node).encode())
            n += 1
        return Staged(folder, n)

    def _clean(self, where: fs.FileSystem, root: str) -> None:
        if where.get_file_info(f"{root}/{STAGING}/{self.job}").type != fs.FileType.NotFound:
            where.delete_dir(f"{root}/{STAGING}/{self.job}")
        if not where.get_file_info(fs.FileSelector(f"{root}/{STAGING}", allow_not_found=True)) and where.get_file_info(f"{root}/{STAGING}").type != fs.FileType.NotFound:
            where.delete_dir(f"{root}/{STAGING}")

    def commit(self, messages: list) -> None:
        where, root = _open(self.path)
        moves = {}
        for m in messages:
            if m is not None and m.files:
                base = f"{root}/{m.folder}"
                for f in where.get_file_info(fs.FileSelector(base, recursive=True)):
                    if f.is_file:
                        moves[f"{root}/{_rel(base, f.path)}"] = f.path
        old = [f.path for f in _listed(where, root)] if self.overwrite else []
        for parent in sorted({posixpath.dirname(to) for to in moves}):
            where.create_dir(parent, recursive=True)
        with ThreadPoolExecutor(16) as pool:  # a rename each, which replaces a node's file at once
            list(pool.map(lambda x: where.move(x[1], x[0]), moves.items()))
            list(pool.map(where.delete_file, [p for p in old if p not in moves]))
        self._clean(where, root)

    def abort(self, messages: list) -> None:
        self._clean(*_open(self.path))


class VaultStream(DataSourceStreamReader):
    """Node files that are new or changed since an offset: the time of change and the path of the last one given out.

    A file that comes with a time before the offset (moved in from elsewhere) is not seen, and removals are not."""

    def __init__(self, options: dict):
        self.path, self.vault_id, self.step = options["path"], options.get("vault_id"), int(options.get("files_per_partition", 256))

    def _changes(self) -> list[tuple[int, str]]:
        where, root = _open(self.path)
        return sorted((f.mtime_ns, _rel(root, f.path)) for f in _listed(where, root))

    def initialOffset(self) -> dict:
        return {"at": -1, "path": ""}

    def latestOffset(self) -> dict:
        found = self._changes()
        return {"at": found[-1][0], "path": found[-1][1]} if found else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> Sequence[Files]:
        low, high = (start["at"], start["path"]), (end["at"], end["path"])
        paths = [rel for at, rel in self._changes() if low < (at, rel) <= high]
        return [Files(tuple(paths[s : s + self.step])) for s in range(0, len(paths), self.step)]

    def read(self, partition: Files) -> Iterator[tuple]:
        return _nodes(self.path, partition, self.vault_id, {})


class VaultSource(DataSource):
    """Nodes in markdown files."""

    @classmethod
    def name(cls) -> str:
        return "vault"

    def schema(self) -> StructType:
        return NODES

    def reader(self, schema: StructType) -> VaultReader:
        return VaultReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> VaultWriter:
        return VaultWriter(self.options, schema.fieldNames(), overwrite)

    def streamReader(self, schema: StructType) -> VaultStream:
        return VaultStream(self.options)


def read(spark: SparkSession, path: str, **options) -> DataFrame:
    register(spark)
    return spark.read.format("vault").options(**options).load(path)


def write(nodes: DataFrame, path: str, mode: str = "append") -> None:
    register(nodes.sparkSession)
    nodes.write.format("vault").mode(mode).save(path)


def changes(spark: SparkSession, path: str, **options) -> DataFrame:
    """A stream of the nodes whose files are new or changed."""
    register(spark)
    return spark.readStream.format("vault").options(**options).load(path)
