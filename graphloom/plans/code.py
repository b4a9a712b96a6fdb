"""Registered queries over the extractors of source files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import text as tx
from graphloom.plans.catalog import query
from graphloom.sources import source_tree


def _sources(v, path: Column, text: Column) -> DataFrame:
    """A source file per page."""
    return v.table("pages").select(path.alias("path"), F.encode(text, "UTF-8").alias("content"))


def _edges(found: DataFrame) -> DataFrame:
    return found.select("id", F.explode("edges").alias("e")).select("id", F.col("e.target").alias("target"), F.col("e.relation").alias("relation"))


def _n() -> Column:
    return F.col("page_id")


@query(r"""WITH p AS (SELECT page_id AS i, page_id % 6 AS m FROM pages), t AS (
    SELECT 'a/b/f' || i AS id, unnest(['os', 'a/b/near' || i, 'a/up']) AS target FROM p WHERE m = 0 UNION ALL SELECT 'a/b/f' || i, unnest(['java.util.List', 'org.x' || i]) FROM p WHERE m = 1
    UNION ALL SELECT 'a/b/f' || i, unnest(['json', 'a/lib' || i]) FROM p WHERE m = 2 UNION ALL SELECT 'a/b/f' || i, unnest(['std::io', 'crate::x' || i]) FROM p WHERE m = 3
    UNION ALL SELECT 'a/b/f' || i, unnest(['stdio.h', 'x' || i || '.h']) FROM p WHERE m = 4) SELECT id, target, 'imports' AS relation FROM t""")
def import_extract(v):
    """Imports of Python, Java, Ruby, Rust, C and (none) SQL files, each once, relative ones resolved."""
    m, i = _n() % 6, _n().cast("string")
    ext = F.when(m == 0, ".py").when(m == 1, ".java").when(m == 2, ".rb").when(m == 3, ".rs").when(m == 4, ".c").otherwise(".sql")
    text = (
        F.when(m == 0, F.concat(F.lit("import os\nfrom .near"), i, F.lit(" import x\n  from ..up import y\nimport os\n")))
        .when(m == 1, F.concat(F.lit("package a;\nimport java.util.List;\nimport static org.x"), i, F.lit(";\n")))
        .when(m == 2, F.concat(F.lit("require 'json'\nrequire_relative '../lib"), i, F.lit("'\n")))
        .when(m == 3, F.concat(F.lit("use std::io;\n  use crate::x"), i, F.lit(";\n")))
        .when(m == 4, F.concat(F.lit('#include <stdio.h>\n# include "x'), i, F.lit('.h"\n#include <stdio.h>\n')))
        .otherwise("import nothing\n")
    )
    return _edges(source_tree.entities(_sources(v, F.concat(F.lit("a/b/f"), i, ext), text)))


@query(r"""WITH p AS (SELECT page_id AS i, page_id % 5 AS m, page_id % 3 AS f FROM pages),
    q AS (SELECT *, CASE m WHEN 0 THEN f + 1 WHEN 1 THEN f WHEN 2 THEN f + 1 WHEN 3 THEN f ELSE 0 END AS functions, CASE m WHEN 4 THEN 0 ELSE 1 END AS classes FROM p)
    SELECT 'src/f' || i AS id, CASE WHEN m = 4 THEN 'file' ELSE 'module' END AS type, CASE WHEN m = 4 THEN 'File' ELSE 'Module' END || ' f' || i || CASE m WHEN 0 THEN ' — says ' || i WHEN 1 THEN ' (Java)' WHEN 2 THEN ' — #!/usr/bin/ruby' WHEN 3 THEN ' — crate ' || i ELSE ' (YAML)' END
        || CASE WHEN functions > 0 AND classes > 0 THEN ' — ' || functions || ' functions, 1 classes' WHEN functions > 0 THEN ' — ' || functions || ' functions' WHEN classes > 0 THEN ' — 1 classes' ELSE '' END AS summary FROM q""")
def symbol_counts(v):
    """One entity per file: what its comment says, its language, and its functions and classes."""
    m, i, f = _n() % 5, _n().cast("string"), (_n() % 3).cast("int")
    ext = F.when(m == 0, ".py").when(m == 1, ".java").when(m == 2, ".rb").when(m == 3, ".rs").otherwise(".yaml")
    text = (
        F.when(m == 0, F.concat(F.lit("\n# says "), i, F.lit("\nclass A:\n"), F.repeat(F.lit("  def m(self):\n"), f), F.lit("def last(x):\n")))
        .when(m == 1, F.concat(F.lit("public class A {\n"), F.repeat(F.lit("  public int get() {\n  }\n"), f), F.lit("}\n")))
        .when(m == 2, F.concat(F.lit("#!/usr/bin/ruby\nclass A\n"), F.repeat(F.lit("  def m\n  end\n"), f + 1), F.lit("end\n")))
        .when(m == 3, F.concat(F.lit("//! crate "), i, F.lit("\npub struct A;\n"), F.repeat(F.lit("pub fn m() {}\n"), f)))
        .otherwise("a: 1\ndef: x\n")
    )
    return source_tree.entities(_sources(v, F.concat(F.lit("src/f"), i, ext), text)).select("id", "type", "summary")


_KINDS = (".py", ".kt", ".h", ".hpp", ".swift", ".php", ".lua", ".bash", ".R", ".sql", ".proto", ".yml", ".toml", ".css", ".md", ".unknown")
_NAMES = ("Python", "Kotlin", "C Header", "C++ Header", "Swift", "PHP", "Lua", "Bash", "R", "SQL", "Protocol Buffers", "YAML", "TOML", "CSS", "Markdown")


@query("""SELECT 'f' || page_id AS id, CASE WHEN page_id % 16 IN (10, 11, 12, 13, 14) THEN 'file' ELSE 'module' END AS type, CASE WHEN page_id % 16 IN (10, 11, 12, 13, 14) THEN 'File' ELSE 'Module' END || ' f' || page_id || ' (' ||
    """ + str(list(_NAMES)) + """[page_id % 16 + 1] || ')' AS summary, sha256('x = 1' || chr(10)) AS hash, 'ns' AS namespace, 'active' AS status, 'f' || page_id || '.md' AS file_path FROM pages WHERE page_id % 16 < 15""")
def language_table(v):
    """Files of many languages as nodes; those of unknown kinds give none."""
    ext = F.element_at(F.array(*map(F.lit, _KINDS)), (_n() % 16 + 1).cast("int"))
    found = source_tree.entities(_sources(v, F.concat(F.lit("f"), _n(), ext), F.lit("x = 1\n")))
    return source_tree.to_nodes(found, "ns", "2024-01-01").select("id", "type", "summary", F.col("source.hash").alias("hash"), "namespace", "status", "file_path")


def _go(v):
    i = _n().cast("string")
    text = F.concat(
        F.lit('package shop\n\nimport (\n\t"fmt"\n\tu "example.org/util'), i, F.lit('"\n)\n\n// Store keeps things. It has more.\ntype Store struct {\n\tBase\n\tname string\n}\n\ntype Base struct{}\n\n'
        'type Saver interface {\n\tSave(x int) error\n\tLoad() string\n}\n\ntype Closer interface {\n\tClose() error\n}\n\ntype Kind int\n\n// Save writes "{" to it.\nfunc (s *Store) Save(x int) error {\n\tfmt.Println("}", len(s.name))\n\tif x > 0 {\n\t\treturn helper(x)\n\t}\n\treturn nil\n}\n\n'
        'func (s *Store) Load() string {\n\treturn u.Read(s.name) // close(\n}\n\n'),
        F.when(_n() % 2 == 0, "func (s *Store) Close() error {\n\treturn nil\n}\n\n").otherwise(""), F.lit("func helper(x int) error {\n\treturn nil\n}\n"),
    )
    return source_tree.entities(_sources(v, F.concat(F.lit("pkg/f"), i, F.lit(".go")), text))


@query("""WITH p AS (SELECT page_id AS i, 'pkg/f' || page_id AS f, page_id % 2 = 0 AS even FROM pages), t AS (
    SELECT f AS id, unnest(['fmt', 'example.org/util' || i]) AS target, 'imports' AS relation FROM p
    UNION ALL SELECT f, f || '/' || unnest(['Store', 'Base', 'Saver', 'Closer', 'Kind', 'Store.Save', 'Store.Load', 'helper']), 'contains' FROM p UNION ALL SELECT f, f || '/Store.Close', 'contains' FROM p WHERE even
    UNION ALL SELECT f || '/Store', f || '/Base', 'extends' FROM p UNION ALL SELECT f || '/Store', f || '/Saver', 'implements' FROM p UNION ALL SELECT f || '/Store', f || '/Closer', 'implements' FROM p WHERE even
    UNION ALL SELECT f || '/Store.Save', unnest(['fmt.Println', f || '/helper']), 'calls' FROM p UNION ALL SELECT f || '/Store.Load', 'example.org/util' || i || '.Read', 'calls' FROM p) SELECT * FROM t""")
def go_edges(v):
    """Imports, members, calls, embedding, and interfaces whose methods a type has."""
    return _edges(_go(v))


@query("""SELECT 'pkg/f' || page_id || x.n AS id, x.t AS type, x.s AS summary, x.a AS first, x.b AS last FROM pages, (VALUES ('', 'file', '', 0, 0), ('/Store', 'type', 'Store keeps things.', 9, 12), ('/Base', 'type', 'Type Base', 14, 14), ('/Saver', 'interface', 'Interface Saver', 16, 19),
    ('/Closer', 'interface', 'Interface Closer', 21, 23), ('/Kind', 'type', 'Type Kind', 25, 25), ('/Store.Save', 'method', 'Save writes "{" to it.', 28, 34), ('/Store.Load', 'method', 'Method Store.Load', 36, 38)) x(n, t, s, a, b)
    UNION ALL SELECT 'pkg/f' || page_id || '/helper', 'function', 'Function helper', CASE WHEN page_id % 2 = 0 THEN 44 ELSE 40 END, CASE WHEN page_id % 2 = 0 THEN 46 ELSE 42 END FROM pages
    UNION ALL SELECT 'pkg/f' || page_id || '/Store.Close', 'method', 'Method Store.Close', 40, 42 FROM pages WHERE page_id % 2 = 0""")
def go_entities(v):
    """Files, functions, methods, types and interfaces, with their lines; strings and comments hold no braces."""
    at = lambda k: F.element_at("source.lines", k)
    return _go(v).select("id", "type", F.when(F.col("type") == "file", "").otherwise(F.col("summary")).alias("summary"), at(1).alias("first"), at(2).alias("last"))


def _script(v):
    i = _n().cast("string")
    text = F.concat(
        F.lit("import { a } from './lib/a"), i, F.lit("';\nimport x from 'pkg';\nconst y = require('../up');\n\nexport interface Shape extends Named {\n  area(): number;\n}\n\n"
        "export class Circle extends Round implements Shape, Named {\n  constructor(r) {\n    this.r = r;\n  }\n  area() {\n    if (/[{}]/.test('{')) {\n      return 1;\n    }\n    return 2; // }\n  }\n  static async make(n) {\n    return `}${n}`;\n  }\n}\n\n"
        "export function walk(t) {\n  return t / 2 / 1;\n}\n\nconst add = (p, q) => {\n  return p + q;\n};\n\nexport type Id = string;\n"),
    )
    return source_tree.entities(_sources(v, F.concat(F.lit("web/src/f"), i, F.when(_n() % 2 == 0, ".ts").otherwise(".jsx")), text))


@query("""WITH p AS (SELECT page_id AS i, 'web/src/f' || page_id AS f FROM pages), t AS (
    SELECT f AS id, unnest(['web/src/lib/a' || i, 'pkg', 'web/up']) AS target, 'imports' AS relation FROM p UNION ALL SELECT f, f || '/' || unnest(['Shape', 'Circle', 'walk', 'add', 'Id']), 'contains' FROM p
    UNION ALL SELECT f || '/Shape', f || '/Named', 'extends' FROM p UNION ALL SELECT f || '/Circle', f || '/Round', 'extends' FROM p UNION ALL SELECT f || '/Circle', f || '/' || unnest(['Shape', 'Named']), 'implements' FROM p
    UNION ALL SELECT f || '/Circle', f || '/Circle.' || unnest(['area', 'make']), 'contains' FROM p) SELECT * FROM t""")
def script_edges(v):
    """Imports, members and heritage of TypeScript and JavaScript; braces in strings, templates, comments and patterns do not count."""
    return _edges(_script(v))


@query("""SELECT 'web/src/f' || page_id || x.n AS id, x.t AS type, x.a AS first, x.b AS last FROM pages, (VALUES ('', 'module', 0, 0), ('/Shape', 'interface', 5, 7), ('/Circle', 'class', 9, 22), ('/Circle.area', 'method', 13, 18), ('/Circle.make', 'method', 19, 21),
    ('/walk', 'function', 24, 26), ('/add', 'function', 28, 30), ('/Id', 'type', 32, 32)) x(n, t, a, b)""")
def script_entities(v):
    at = lambda k: F.element_at("source.lines", k)
    return _script(v).select("id", "type", at(1).alias("first"), at(2).alias("last"))


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'project' WHEN 1 THEN 'über-' || page_id || '-x' WHEN 2 THEN 'a-b' ELSE repeat('y', 128) END AS slug FROM pages""")
def project_slugs(v):
    m = _n() % 4
    name = F.when(m == 0, " -- ").when(m == 1, F.concat(F.lit("Über "), _n(), F.lit("__X!"))).when(m == 2, "/A/B/").otherwise(F.repeat(F.lit("Y"), F.lit(200)))
    return v.table("pages").select("page_id", tx.slug(name).alias("slug"))


@query("SELECT page_id, 'a,b' || page_id AS items, 'x = 1' AS code FROM pages")
def texts_cut(v):
    """Lists between commas, and code without its fence."""
    fenced = F.concat(F.lit("```py\n"), F.lit("x = 1"), F.lit("\n```"))
    return v.table("pages").select("page_id", F.array_join(tx.csv_list(F.concat(F.lit(" a, ,b"), _n(), F.lit(", "))), ",").alias("items"), tx.strip_fence(fenced).alias("code"))
