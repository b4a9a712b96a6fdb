"""Vaults of markdown nodes: reading and writing through Spark's readers and writers."""

from __future__ import annotations

import json
import re
from dataclasses import asdict

import pandas as pd
import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import id_from_path, valid_id
from graphloom.operators.graph import latest
from graphloom.schema import NODES, VaultConfig, is_active
from graphloom.storage import spread

_META = "id string, type string, namespace string, status string, tags array<string>, file_path string"


def load_yaml(text: str):
    """As ``yaml.safe_load``, by the C parser where PyYAML has it: it takes a tenth of the time."""
    return yaml.load(text, Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader))  # noqa: S506  both are safe


def split_frontmatter(text: str) -> tuple[str, str]:
    """(yaml, body). The first line must be the delimiter; blanks before it are skipped."""
    lines = text.lstrip("﻿ \t\r\n").split("\n")
    mark = lambda s: s.rstrip(" \t\r") == "---"
    if not lines or not mark(lines[0]):
        raise ValueError("no frontmatter")
    for i, line in enumerate(lines[1:], 1):
        if mark(line):
            return "\n".join(lines[1:i]), "\n".join(lines[i + 1 :])
    raise ValueError("frontmatter does not end")


def summary_of(body: str) -> str:
    at = ("\n" + body).find("\n## ")
    return (body if at < 0 else body[: max(0, at - 1)]).strip()


def section_of(body: str, title: str) -> str:
    at = body.find(f"## {title}")
    if at < 0:
        return ""
    rest = body[at + len(title) + 3 :]
    end = rest.find("\n## ")
    return (rest if end < 0 else rest[:end]).strip()


def _text(v) -> str:
    return "" if v is None else v.isoformat().replace("+00:00", "Z") if hasattr(v, "isoformat") else str(v)


def parse_node(text: str, rel: str) -> dict:
    """One node from a file; a missing id comes from the path. Raises on broken files."""
    head, body = split_frontmatter(text)
    f = load_yaml(head) or {}
    source = f.get("source") or {}
    return {
        "id": _text(f.get("id")) or re.sub(r"\.md$", "", rel),
        **{k: _text(f.get(k)) for k in ("type", "namespace", "status", "valid_from", "valid_until", "superseded_by")},
        "source": {"path": _text(source.get("path")), "lines": [int(x) for x in (source.get("lines") or [0, 0])], "hash": _text(source.get("hash"))},
        "edges": [{"target": _text(e.get("target")), "relation": _text(e.get("relation"))} for e in f.get("edges") or []],
        "tags": [str(t) for t in f.get("tags") or []], "summary": summary_of(body), "context": section_of(body, "Context"), "vault_id": None, "file_path": rel,
    }


def render_node(n: dict) -> str:
    """The file of one node; empty fields are left out."""
    head = {k: n.get(k) or "" for k in ("id", "type", "namespace", "status")}
    head |= {k: n[k] for k in ("valid_from", "valid_until", "superseded_by") if n.get(k)}
    source = n.get("source") or {}
    if source.get("path") or source.get("hash") or any(source.get("lines") or []):
        head["source"] = {"path": source.get("path") or "", "lines": list(source.get("lines") if source.get("lines") is not None else [0, 0]), "hash": source.get("hash") or ""}
    edges = [{"target": e["target"], "relation": e["relation"]} for e in (n.get("edges") if n.get("edges") is not None else [])]
    if edges:
        head["edges"] = edges
    if n.get("tags") is not None and len(n["tags"]):
        head["tags"] = list(n["tags"])
    parts = ["---\n", yaml.safe_dump(head, sort_keys=False, allow_unicode=True), "---\n"]
    if (n.get("summary") or "").strip():
        parts += ["\n", n["summary"].strip(), "\n"]
    if edges:
        parts += ["\n## Relationships\n\n", *[f"- **{e['relation']}** [[{e['target']}]]\n" for e in edges]]
    if (n.get("context") or "").strip():
        parts += ["\n## Context\n\n", n["context"].strip(), "\n"]
    return "".join(parts)


def _files(spark: SparkSession, root: str) -> DataFrame:
    """(rel, text) of node files: no hidden or underscore folders, no underscore files."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", True).load(root)
    base = re.sub(r"^file:/+", "/", root).rstrip("/")
    rel = F.regexp_replace(F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), "^" + re.escape(base) + "/", ""), "%20", " ")
    hidden = F.exists(F.split("rel", "/"), lambda p: p.startswith(".") | p.startswith("_"))
    return raw.select(rel.alias("rel"), F.make_valid_utf8(F.col("content").cast("string")).alias("text")).where(~hidden)


def parse_files(files: DataFrame, vault_id: str | None = None, with_errors: bool = False) -> DataFrame:
    """Nodes of node files (rel, text); broken files are dropped (or listed, with ``with_errors``), of files
    with one id the first by path stays."""

    def parse(batches):
        for batch in batches:
            rows = []
            for rel, text in zip(batch["rel"], batch["text"]):
                try:
                    rows.append(parse_node(text, rel) | {"error": None})
                except Exception as e:  # noqa: BLE001  malformed files must not end the scan
                    rows.append({"id": re.sub(r"\.md$", "", rel), "file_path": rel, "error": str(e)})
            if rows:
                frame = pd.DataFrame(rows, columns=[*NODES.fieldNames(), "error"]).astype(object)
                yield frame.where(frame.notna(), None)

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in NODES) + ", error string"
    out = spread(files.select("rel", "text")).mapInPandas(parse, fields)
    if with_errors:
        return out.where("error is not null").select("file_path", "error")
    good = latest(out.where("error is null").drop("error")).where(valid_id("id"))
    return good.withColumn("vault_id", F.lit(vault_id)) if vault_id else good


def read_vault(spark: SparkSession, root: str, vault_id: str | None = None, with_errors: bool = False) -> DataFrame:
    """Nodes of a vault on disk."""
    return parse_files(_files(spark, root), vault_id, with_errors)


def metadata(nodes: DataFrame) -> DataFrame:
    return nodes.select("id", "type", "namespace", "status", "tags", "file_path")


def read_metadata(spark: SparkSession, root: str) -> DataFrame:
    return metadata(read_vault(spark, root))


def read_active(spark: SparkSession, root: str) -> DataFrame:
    return read_metadata(spark, root).where(is_active())


def read_node(spark: SparkSession, root: str, id_: str) -> DataFrame:
    return read_vault(spark, root).where(F.col("id") == id_)


def rendered(nodes: DataFrame) -> DataFrame:
    """(id, text): nodes as files."""

    def run(batches):
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "text": [render_node(json.loads(x)) for x in batch["j"]]})

    return nodes.select("id", F.to_json(F.struct(*nodes.columns)).alias("j")).mapInPandas(run, "id string, text string")


def write_vault(nodes: DataFrame, path: str) -> None:
    """Node files below ``path``, a folder for each id.

    Spark's text sink writes them and commits whole tasks; ids partition the folder, so that a
    file holds one node. A vault that people edit is small; tables are written as Parquet."""
    good = nodes.where(valid_id("id"))
    rendered(good).withColumn("node", F.regexp_replace("id", "/", "%2F")).select("node", F.col("text").alias("value")).repartition("node").write.partitionBy("node").text(path)


def read_written(spark: SparkSession, path: str, with_errors: bool = False) -> DataFrame:
    """Nodes of a folder that ``write_vault`` made."""
    files = spark.read.text(path, wholetext=True)
    return parse_files(files.select(F.concat(F.regexp_replace(F.col("node").cast("string"), "%2F", "/"), F.lit(".md")).alias("rel"), F.col("value").alias("text")), with_errors=with_errors)


def write_files(nodes: DataFrame, root: str) -> int:
    """Export for people: <root>/<id>.md, each by temporary file and rename, on a file system that the
    driver sees. Rows stream to the driver one partition at a time."""
    import os

    n = 0
    for row in rendered(nodes.where(valid_id("id"))).toLocalIterator():
        at = os.path.join(root, row["id"] + ".md")
        os.makedirs(os.path.dirname(at), exist_ok=True)
        with open(at + ".tmp", "w", encoding="utf-8") as f:
            f.write(row["text"])
        os.replace(at + ".tmp", at)
        n += 1
    return n


# Small files beside the nodes. They are driver-side values, a few kilobytes each.


def loose_yaml(text: str) -> dict:
    """Yaml between the first two '---' marks, anywhere; {} without them."""
    if not text.startswith("---"):
        return {}
    end = text.find("---", 3)
    return (load_yaml(text[3:end]) or {}) if end >= 0 else {}


def _dump(head: dict, body: str = "") -> str:
    return "---\n" + yaml.safe_dump(head, sort_keys=False, allow_unicode=True) + "---\n" + body


def parse_config(text: str) -> VaultConfig:
    head = loose_yaml(text)
    known = {k: v for k, v in head.items() if k in VaultConfig.__dataclass_fields__ and v is not None and k != "extra"}
    return VaultConfig(**known, extra={k: v for k, v in head.items() if k not in known})


def render_config(config: VaultConfig, secrets: bool = True) -> str:
    """Config file; without secrets, keys that look like credentials are left out."""
    head = {k: v for k, v in asdict(config).items() if k != "extra" and v not in ("", 0)} | config.extra
    if not secrets:
        head = {k: v for k, v in head.items() if not re.search(r"api_key|secret|password|token(?!.*budget)", k, re.I)}
    return _dump(head)


def parse_heat(text: str, namespace: str) -> tuple[list[dict], dict]:
    """(pairs, settings) of a heat file."""
    head = loose_yaml(text)
    rows = [{"namespace": namespace, "a": p["a"], "b": p["b"], "weight": float(p.get("weight", 0)), "hits": int(p.get("hits", 0)), "last": _text(p.get("last"))} for p in head.get("pairs") or []]
    return rows, {k: v for k, v in head.items() if k != "pairs"}


def render_heat(rows: list[dict], namespace: str, settings: dict | None = None) -> str:
    """Heat file, hottest pairs first."""
    pairs = [{k: r[k] for k in ("a", "b", "weight", "hits", "last")} for r in sorted(rows, key=lambda r: (-r["weight"], r["a"], r["b"]))]
    return _dump({"namespace": namespace, **(settings or {}), "pairs": pairs}, f"\nHeat map for {namespace}.\n")


def heat_files(heat: DataFrame, settings: dict | None = None) -> DataFrame:
    """(namespace, text): the heat file of every namespace. A file is one namespace's by its nature, and is kept whole."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        name = group["namespace"].iloc[0]
        return pd.DataFrame({"namespace": [name], "text": [render_heat(group.to_dict("records"), name, settings)]})

    return heat.select("namespace", "a", "b", "weight", "hits", "last").groupBy("namespace").applyInPandas(run, "namespace string, text string")


def heat_rows(files: DataFrame) -> DataFrame:
    """(namespace, a, b, weight, hits, last, ord) of heat files, in the order of the file."""

    def run(batches):
        for batch in batches:
            rows = [{**r, "ord": i} for name, text in zip(batch["namespace"], batch["text"]) for i, r in enumerate(parse_heat(text, name)[0])]
            if rows:
                yield pd.DataFrame(rows)

    return files.select("namespace", "text").mapInPandas(run, "namespace string, a string, b string, weight double, hits int, last string, ord int")


def parse_summary(text: str) -> tuple[dict, str]:
    head = {}
    parts = text.split("---", 2)
    if len(parts) == 3:
        for line in parts[1].splitlines():
            key, sep, value = line.partition(":")
            if sep:
                head[key.strip()] = value.strip()
        return head, parts[2].strip()
    return head, text.strip()


def render_summary(head: dict, body: str) -> str:
    return "---\n" + "".join(f"{k}: {v}\n" for k, v in head.items()) + "---\n\n" + body.strip() + "\n"


def parse_manifest(text: str) -> dict:
    return loose_yaml(text)


def render_manifest(**fields) -> str:
    return _dump({k: v for k, v in fields.items() if v is not None})


def ensure_rows(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Append rows whose keys are not there: create a namespace, bridge, route or project once."""
    return table.unionByName(new.join(table.select(*keys), keys, "left_anti").dropDuplicates(keys), allowMissingColumns=True)


def put_rows(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Set rows by key (routes, projects, mounts)."""
    return table.join(new.select(*keys), keys, "left_anti").select(table.columns).unionByName(new, allowMissingColumns=True)


def drop_rows(table: DataFrame, keys: DataFrame) -> DataFrame:
    return table.join(keys, keys.columns, "left_anti")


def both_sides(bridges: DataFrame, local: str, remote: str, relations: list[str]) -> DataFrame:
    """A cross-vault bridge, written for both vaults."""
    rows = [(local, remote, relations, local, remote, 0), (remote, local, relations, remote, local, 0)]
    return ensure_rows(bridges, bridges.sparkSession.createDataFrame(rows, bridges.schema), ["source", "target"])


def materialize_copy(nodes: DataFrame, path: str) -> None:
    """A filtered copy of a vault as a cached table."""
    nodes.withColumn("id", id_from_path("id")).write.mode("overwrite").parquet(path)
