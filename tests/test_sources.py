import os

from pyspark.sql import functions as F

from graphloom.operators import federation, graph
from graphloom.schema import VaultConfig, clamp_budget, clamp_depth, clamp_limit
from graphloom.sources import source_tree, vault
from graphloom.sources.source_tree import GenericIndexer, GoIndexer, Ignore, ScriptIndexer

FULL = """---
id: auth/login
type: function
namespace: demo
status: active
source:
  path: src/login.go
  lines: [10, 20]
  hash: abc
edges:
  - {target: auth/token, relation: calls}
tags: [security]
unknown: dropped
---

Logs a user in.

## Relationships

- **calls** [[auth/token]]

## Context

func Login() {}
"""


def test_node_round_trip():
    n = vault.parse_node(FULL, "auth/login.md")
    assert (n["summary"], n["context"], n["source"]["lines"]) == ("Logs a user in.", "func Login() {}", [10, 20])
    assert vault.parse_node(vault.render_node(n), "auth/login.md") == n
    assert vault.parse_node("﻿---\ntype: x\n--- \nbody", "a/b.md")["id"] == "a/b"


def test_vault_scan(spark, tmp_path):
    files = {"auth/login.md": FULL, "copy.md": FULL, "_config.md": FULL, ".hidden/x.md": FULL, "_heat/y.md": FULL, "broken.md": "no frontmatter", "bare.md": "---\ntype: concept\n---\nText"}
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    n = vault.read_vault(spark, str(tmp_path), "v1")
    assert {(r.id, r.file_path, r.vault_id) for r in n.collect()} == {("auth/login", "auth/login.md", "v1"), ("bare", "bare.md", "v1")}
    assert [r.file_path for r in vault.read_vault(spark, str(tmp_path), with_errors=True).collect()] == ["broken.md"]
    assert vault.read_active(spark, str(tmp_path)).count() == 2 and vault.read_node(spark, str(tmp_path), "bare").first().summary == "Text"
    assert vault.write_files(n, str(tmp_path / "out")) == 2 and os.path.exists(tmp_path / "out/auth/login.md")
    again = vault.read_vault(spark, str(tmp_path / "out"))
    assert {(r.id, r.summary, r.context) for r in again.collect()} == {(r.id, r.summary, r.context) for r in n.collect()}
    vault.write_vault(n, str(tmp_path / "sink"))
    assert spark.read.text(str(tmp_path / "sink"), wholetext=True).count() == 2


def test_small_files():
    c = vault.parse_config("---\nversion: '2'\nvault_id: v\ntoken_budget: 0\napi_key: sk-1\n---\n")
    assert (c.vault_id, c.effective_budget, c.extra) == ("v", 4096, {"api_key": "sk-1"}) and "sk-1" not in vault.render_config(c, secrets=False)
    assert vault.parse_config(vault.render_config(VaultConfig(vault_id="w", token_budget=9))).token_budget == 9
    rows = [{"namespace": "n", "a": "x", "b": "y", "weight": w, "hits": 1, "last": "t"} for w in (0.1, 0.5)]
    back, head = vault.parse_heat(vault.render_heat(rows, "n", {"decay_rate": 0.95}), "n")
    assert [r["weight"] for r in back] == [0.5, 0.1] and head["decay_rate"] == 0.95 and vault.parse_heat("nothing", "n") == ([], {})
    assert vault.parse_summary(vault.render_summary({"namespace": "n"}, "All good.")) == ({"namespace": "n"}, "All good.")
    assert vault.parse_manifest(vault.render_manifest(name="n", root_path="."))["name"] == "n"
    assert [clamp_depth(11), clamp_depth(3), clamp_budget(0), clamp_budget(10**6), clamp_limit(0), clamp_limit(150, "suggestions")] == [2, 3, 4096, 100_000, 10, 150]


def test_manifest_tables(spark):
    t = spark.createDataFrame([("a", "p1")], "vault_id string, path string")
    new = spark.createDataFrame([("a", "p2"), ("b", "p3")], "vault_id string, path string")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(vault.ensure_rows(t, new, ["vault_id"])) == [("a", "p1"), ("b", "p3")] and rows(vault.put_rows(t, new, ["vault_id"])) == [("a", "p2"), ("b", "p3")]
    assert vault.drop_rows(t, new.select("vault_id")).count() == 0
    none = spark.createDataFrame([], "source string, target string, allowed_relations array<string>, source_vault_id string, target_vault_id string, ord int")
    assert vault.both_sides(none, "v", "w", ["calls"]).count() == 2


def test_ignore_rules():
    m = Ignore(["*.gen.go", "build/", "/top.txt", "docs/**", "**/tmp", "!docs/keep.md", "a/**/z.py", "# note", ""])
    out = lambda p: m.ignores_file(p)
    assert all(map(out, ["x.gen.go", "a/b.gen.go", "build/o.c", "x/build/o.c", "top.txt", "docs/a/b.md", "docs/keep.md", "p/tmp", "a/q/z.py", "a/z.py", "node_modules/x.js", ".git/c", "s/.env", "e.log", "x/.DS_Store"]))
    assert not any(map(out, ["x.go", "sub/top.txt", "b/z.py", "log"]))
    assert not Ignore(["!keep.log"]).ignores("keep.log") and Ignore([]).ignores("keep.log")


def test_generic_indexer():
    text = "# Payment rules\n\nimport os\nfrom ..core.models import A\nfrom . import b\nimport os\n\nclass X:\n    def go(self):\n        pass\n"
    e = GenericIndexer().index("app/pay/rules.py", text)[0]
    assert (e["id"], e["type"]) == ("app/pay/rules", "module") and e["summary"] == "Module rules — Payment rules — 1 functions, 1 classes"
    assert [x["target"] for x in e["edges"]] == ["os", "app/core/models", "app/pay"]
    assert GenericIndexer().index("a/x.yaml", "k: v")[0]["summary"] == "File x (YAML)"
    assert GenericIndexer.imports(".rb", ["require_relative '../b'", "require 'set'"], "l/a.rb") == ["b", "set"]
    assert source_tree.fnv1a("") == "cbf29ce484222325" and source_tree.fnv1a("a") == "af63dc4c8601ec8c"


def test_go_indexer():
    text = '''package auth

import (
	"fmt"
	tok "example.com/x/token"
)

// Store keeps users. And more.
type Store struct {
	Base
	name string
}

type Saver interface {
	Save(x int) error
}

func (s *Store) Save(x int) error {
	fmt.Println("}")
	return tok.Sign(check(x))
}

func check(x int) int { return len("a") }
'''
    got = {e["id"]: e for e in GoIndexer().index("auth/store.go", text)}
    assert set(got) == {"auth/store", "auth/store/Store", "auth/store/Saver", "auth/store/Store.Save", "auth/store/check"}
    calls = {x["target"] for x in got["auth/store/Store.Save"]["edges"]}
    assert {"example.com/x/token.Sign", "auth/store/check", "fmt.Println"} <= calls
    assert {(x["target"], x["relation"]) for x in got["auth/store/Store"]["edges"]} == {("auth/store/Base", "extends"), ("auth/store/Saver", "implements")}
    assert got["auth/store/Store"]["summary"] == "Store keeps users." and got["auth/store/Store.Save"]["source"]["lines"] == [18, 21]
    assert GoIndexer().index("x.go", "not go") == []


def test_script_indexer():
    text = '''import { a } from "./util";
const fs = require('fs');
export class Cat extends Animal implements Pet, Thing {
  async speak(x: string): void { if (x) { log("}"); } }
}
export interface Pet extends Base { name: string }
export function run(a) { return a; }
const go = async (x) => { return x; };
export type Id = string;
'''
    got = {e["id"]: e for e in ScriptIndexer().index("src/cat.ts", text)}
    assert set(got) == {"src/cat", *(f"src/cat/{n}" for n in ("Cat", "Cat.speak", "Pet", "run", "go", "Id"))}
    assert [x["target"] for x in got["src/cat"]["edges"] if x["relation"] == "imports"] == ["src/util", "fs"]
    assert {(x["target"], x["relation"]) for x in got["src/cat/Cat"]["edges"]} >= {("src/cat/Animal", "extends"), ("src/cat/Pet", "implements"), ("src/cat/Cat.speak", "contains")}


def test_tree_to_nodes(spark, tmp_path):
    for name, data in {"a.py": b"def f():\n  pass\n", "b.go": b"package b\n\nfunc B() {}\n", "bin.py": b"\x00\x01", "x.log": b"l", "vendor/v.py": b"x", "odd.zzz": b"q"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    files = source_tree.scan(spark, str(tmp_path))
    assert sorted(r.path for r in files.select("path").collect()) == ["a.py", "b.go", "odd.zzz"]
    n = source_tree.to_nodes(source_tree.entities(files), "ns", "T")
    assert sorted(r.id for r in n.collect()) == ["a", "b", "b/B"]
    assert {r.action for r in source_tree.incremental(source_tree.entities(files), n).collect()} == {"skip"}
    old = n.where("id <> 'b/B'").withColumn("source", F.when(F.col("id") == "a", F.col("source").withField("hash", F.lit("x"))).otherwise(F.col("source")))
    said = spark.createDataFrame([("b/B", "supersede", "a")], "query_id string, action string, target string")
    assert {r.id: r.action for r in source_tree.incremental(source_tree.entities(files), old, said).collect()} == {"a": "update", "b": "skip", "b/B": "add"}
    want = spark.createDataFrame([("a.py", 1, 2), ("a.py", 2, 2)], "path string, first int, last int")
    got = {(r.first, r.last): r.hash for r in source_tree.line_hashes(files, want).collect()}
    assert got[1, 2] == files.where("path = 'a.py'").first().hash and got[2, 2] != got[1, 2]


def test_federation(spark, nodes_of):
    here = nodes_of([{"id": "a", "edges": [("@far/b", "calls"), ("@here/c", "reads")]}, {"id": "c"}])
    far = nodes_of([{"id": "b", "edges": [("d", "calls")]}, {"id": "d"}])
    nodes, edges = federation.combined({"here": here, "far": far}, "here")
    assert {(r.src, r.dst) for r in edges.collect()} == {("a", "@far/b"), ("a", "c"), ("@far/b", "@far/d")}
    assert graph.dangling(edges, nodes).count() == 0
    e = spark.createDataFrame([("a", "b", "calls", "v", "w"), ("a", "c", "reads", "v", "w"), ("a", "d", "calls", "v", "z")], "src string, dst string, relation string, src_vault string, dst_vault string")
    b = spark.createDataFrame([("w", "v", ["calls"], 0), ("v", "w", ["reads"], 1)], "source_vault_id string, target_vault_id string, allowed_relations array<string>, ord int")
    assert {(r.dst, r.problem) for r in federation.vault_violations(e, b).collect()} == {("c", "relation_not_allowed"), ("d", "no_bridge")}
    n = nodes_of([{"id": "p", "namespace": "x", "edges": [("y/q", "calls"), ("r", "calls"), ("lost", "calls")]}, {"id": "q", "namespace": "y"}, {"id": "r", "namespace": "y"}])
    assert {(r.target, r["class"]) for r in federation.bridge_view(n, graph.edges_of(n)).collect()} == {("q", "bridge"), ("r", "bridge"), ("lost", "behavioral")}
    mounts = spark.createDataFrame([("k", "p", "vp", True, True), ("k", "q", "vq", True, True), ("k", "s", "vs", False, True)], "catalog string, project_id string, vault_id string, active boolean, available boolean")
    links = spark.createDataFrame([("k", "p", "q", ["reads", "calls"], 0), ("k", "q", "p", ["writes", "reads"], 1), ("k", "p", "s", ["calls"], 2)], "catalog string, source string, target string, allowed_relations array<string>, ord int")
    assert [(r.lo, r.hi, r.allowed_relations) for r in federation.runtime_bridges(mounts, links).collect()] == [("vp", "vq", ["reads", "calls", "writes"])]
    refs = spark.createDataFrame([("git@h.org:a/b.git", ""), ("", "/co"), ("x", "y")], "url string, path string")
    projects = spark.createDataFrame([("b", "https://H.org/a/b", "vb", 0)], "project_id string, source_url string, vault_id string, ord int")
    checkouts = spark.createDataFrame([("/co", "vc")], "path string, vault_id string")
    assert sorted((r.via, r.vault_id or "") for r in federation.resolve_references(refs, projects, checkouts).collect()) == [("catalog_url", "vb"), ("checkout_vault", "vc"), ("none", "")]
    paths = lambda *rows: spark.createDataFrame(list(rows), "vault_id string, path string")
    assert {r.vault_id: r.path for r in federation.vault_paths(paths(("a", "link")), paths(("a", "route"), ("b", "route"))).collect()} == {"a": "link", "b": "route"}
    m = spark.createDataFrame([("b", "mount", True, False), ("c", "alias", True, True)], "vault_id string, path string, available boolean, is_alias boolean")
    assert {r.vault_id: (r.path, r.conflict) for r in federation.route_overlay(paths(("b", "route")), m).collect()} == {"b": ("mount", True)}
    asked = spark.createDataFrame([("p", "edit"), ("live1", "live"), ("cached", "link"), ("gone", "edit")], "target string, mode string")
    mounted = spark.createDataFrame([("p", "vp", "/p", True, True)], "project_id string, vault_id string, path string, active boolean, editable boolean")
    cached = spark.createDataFrame([("cached", "vc", "/c")], "project_id string, vault_id string, path string")
    got = federation.resolve_links(asked, mounted, paths(("live1", "/l")), cached)
    assert {r.target: (r.vault_id, r.state) for r in got.collect()} == {"p": ("vp", "ok"), "live1": ("live1", "ok"), "cached": ("vc", "ok"), "gone": (None, "missing")}
    assert [r.vault_id for r in federation.linked_vaults(got, "vp").collect()] == ["live1", "vc"]
    assert federation.did_you_mean(n, "zz/R").first().id == "r" and federation.namespace_counts(n.limit(0)).first().namespace == "default"
    assert [r.text for r in federation.template_summary(nodes_of([{"id": f"n{i:03d}"} for i in range(90)])).collect()][0].startswith("Summary of namespace  with 90 nodes.\n\n- [[n000]] (function)\n- [[n001]]")
    meta = spark.createDataFrame([("p", "v1")], "project_id string, vault_id string")
    cat = spark.createDataFrame([("p", "/p", True)], "project_id string, path string, readonly boolean")
    ws = spark.createDataFrame([("p", True, True, False)], "project_id string, active boolean, editable boolean, materialized boolean")
    assert tuple(federation.active_mounts(cat, meta, ws, "v1").first())[3:] == (True, False, True, True)
    assert federation.vault_claims(meta, meta.withColumn("catalog", F.lit("k"))).where("claim = 1").first().catalog == ""
    assert federation.status_report(n, graph.edges_of(n), n, n, n).first().edges == 3
    assert federation.skip_reasons(spark.createDataFrame([("b", "gone")], "id string, reason string")).first().reasons == {"b": "gone"}
