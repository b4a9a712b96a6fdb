"""Source trees to graph entities: scanning with ignore rules, and extractors by language."""

from __future__ import annotations

import fnmatch
import hashlib
import posixpath
import re
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.schema import ENTITIES, is_active

# What is never read, and languages by extension.
IGNORED_DIRS = (".git", "node_modules", "vendor", "__pycache__")
IGNORED_FILES = (".DS_Store",)
IGNORED_EXTENSIONS = (".log", ".err", ".lock", ".tmp", ".bak", ".swp", ".swo", ".orig", ".rej")
LANGUAGES = {
    ".py": "Python", ".rb": "Ruby", ".java": "Java", ".c": "C", ".h": "C Header", ".cpp": "C++", ".hpp": "C++ Header", ".rs": "Rust",
    ".swift": "Swift", ".kt": "Kotlin", ".scala": "Scala", ".php": "PHP", ".lua": "Lua", ".sh": "Shell", ".bash": "Bash", ".zsh": "Zsh",
    ".r": "R", ".R": "R", ".sql": "SQL", ".proto": "Protocol Buffers", ".graphql": "GraphQL", ".yaml": "YAML", ".yml": "YAML",
    ".json": "JSON", ".toml": "TOML", ".xml": "XML", ".html": "HTML", ".css": "CSS", ".scss": "SCSS", ".less": "Less", ".md": "Markdown", ".txt": "Text",
}
PLAIN_FILES = (".proto", ".graphql", ".yaml", ".yml", ".json", ".toml", ".xml", ".html", ".css", ".scss", ".less", ".md", ".txt")
# Import and symbol patterns by language, applied line by line.
IMPORTS = {
    ".py": [r"^\s*import\s+(\S+)", r"^\s*from\s+(\S+)\s+import"],
    **dict.fromkeys((".java", ".kt", ".scala"), [r"^\s*import\s+(?:static\s+)?([A-Za-z0-9_.]+)"]),
    ".rb": [r"^\s*require\s+['\"]([^'\"]+)['\"]", r"^\s*require_relative\s+['\"]([^'\"]+)['\"]"],
    ".rs": [r"^\s*use\s+([A-Za-z0-9_:]+)"],
    **dict.fromkeys((".c", ".h", ".cpp", ".hpp"), [r"^\s*#\s*include\s+[<\"]([^>\"]+)[>\"]"]),
}
_JVM = (r"(?:public|private|protected)\s+(?:static\s+)?[\w<>\[\]]+\s+\w+\s*\(", r"(?:public|private|protected)?\s*(?:static\s+)?(?:abstract\s+)?class\s+\w+")
SYMBOLS = {
    ".py": (r"^\s*def\s+\w+\(", r"^\s*class\s+\w+"), **dict.fromkeys((".java", ".kt", ".scala"), _JVM), ".rb": (r"^\s*def\s+\w+", r"^\s*class\s+\w+"),
    ".rs": (r"^\s*(?:pub\s+)?fn\s+\w+\(", r"^\s*(?:(?:pub\s+)?struct|impl)\s+\w+"),
}
COMMENTS = ("///", "//!", "//", "##", "#!", "#", "--", ";")
CONTEXT_LINES = 100
PROBE = 512


class Ignore:
    """A subset of gitignore: later rules win, '!' keeps, a trailing slash is for folders, '**' spans folders."""

    def __init__(self, rules: list[str]):
        self.rules = []
        for raw in rules:
            rule = raw.strip()
            if rule and not rule.startswith("#"):
                keep = rule.startswith("!")
                rule = rule.removeprefix("!")
                self.rules.append((rule.removesuffix("/"), keep, rule.endswith("/")))

    @staticmethod
    def _glob(pattern: str, path: str) -> bool:
        """Shell pattern in which '*' and '?' do not cross slashes."""
        parts, names = pattern.split("/"), path.split("/")
        return len(parts) == len(names) and all(fnmatch.fnmatchcase(n, p.replace("[^", "[!")) for p, n in zip(parts, names))

    def _matches(self, pattern: str, path: str) -> bool:
        if "**" not in pattern:
            return self._glob(pattern.removeprefix("/"), path) if "/" in pattern else self._glob(pattern, posixpath.basename(path))
        pieces = pattern.split("**")
        if len(pieces) > 2:
            return all(p.strip("/") in path for p in pieces)
        head, tail = pieces[0].removesuffix("/"), pieces[1].removeprefix("/")
        below = not head or path.startswith(head + "/") or self._glob(head, path)
        if not below or not tail:
            return below
        names = path.removeprefix(head + "/").split("/") if head else path.split("/")
        return any(self._glob(tail, "/".join(names[i:])) for i in range(len(names)))

    def ignores(self, path: str, is_dir: bool = False) -> bool:
        base = posixpath.basename(path)
        if not is_dir and base in IGNORED_FILES or any(p in IGNORED_DIRS or (len(p) > 1 and p[0] == "." and p != "..") for p in path.split("/")):
            return True
        out = not is_dir and posixpath.splitext(base)[1].lower() in IGNORED_EXTENSIONS
        for pattern, keep, dirs in self.rules:
            if (is_dir or not dirs) and self._matches(pattern, path):
                out = not keep
        return out

    def ignores_file(self, path: str) -> bool:
        """The file or a folder above it is ignored."""
        parts = path.split("/")
        return any(self.ignores("/".join(parts[:i]), True) for i in range(1, len(parts))) or self.ignores(path)


def always_ignored(path: str):
    """Column form of what no rule can change, so that it filters before contents are read."""
    parts = F.split(path, "/")
    return F.exists(parts, lambda p: p.isin(*IGNORED_DIRS, *IGNORED_FILES) | (p.startswith(".") & (F.length(p) > 1) & (p != "..")))


def kept_files(files: DataFrame, rules: list[str] | None = None) -> DataFrame:
    """(path, content, hash) of the text files among ``files`` (path, content) that no rule ignores."""
    matcher = Ignore(rules or [])

    @F.pandas_udf("boolean")
    def kept(paths: pd.Series) -> pd.Series:
        return paths.map(lambda p: not matcher.ignores_file(p))

    files = files.where(~always_ignored("path")).where(kept("path"))
    binary = F.position(F.lit(b"\x00"), F.substring("content", 1, PROBE)) > 0
    return files.where(~binary).select("path", "content", F.sha2("content", 256).alias("hash"))


def scan(spark: SparkSession, root: str, rules: list[str] | None = None) -> DataFrame:
    """The text files of a tree on disk that no rule ignores."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = re.sub(r"^file:/+", "/", root).rstrip("/")
    return kept_files(raw.withColumn("path", F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), "^" + re.escape(base) + "/", "")), rules)


def source_hash(content: bytes, first: int = 0, last: int = 0) -> str:
    """SHA-256 of a file, or of its lines first to last with their terminators."""
    if first > 0:
        content = b"".join(content.splitlines(keepends=True)[first - 1 : last]) if b"\r" not in content else b"".join(x for x in re.findall(rb"[^\n]*\n|[^\n]+", content)[first - 1 : last])
    return hashlib.sha256(content).hexdigest()


def line_hashes(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """(path, first, last, hash) for wanted (path, first, last)."""

    @F.pandas_udf("string")
    def digest(content: pd.Series, first: pd.Series, last: pd.Series) -> pd.Series:
        return pd.Series([source_hash(c, int(a), int(b)) for c, a, b in zip(content, first, last)])

    return files.join(wanted.distinct(), "path").select("path", "first", "last", digest("content", "first", "last").alias("hash"))


def fnv1a(text: str) -> str:
    """64-bit FNV-1a of the UTF-8 bytes, in hex."""
    h = 0xCBF29CE484222325
    for b in text.encode():
        h = (h ^ b) * 0x100000001B3 % (1 << 64)
    return f"{h:016x}"


class Indexer(Protocol):
    extensions: tuple[str, ...]

    def index(self, path: str, text: str) -> list[dict]: ...


def _entity(id_, kind, name, summary, context, path, span, text, edges) -> dict:
    seen = {}
    for target, relation in edges:
        seen.setdefault((target, relation))
    return {
        "id": id_, "type": kind, "name": name, "summary": summary, "context": context,
        "source": {"path": path, "lines": list(span), "hash": source_hash(text.encode(), *span)}, "edges": [{"target": t, "relation": r} for t, r in seen],
    }


def _stem(path: str) -> str:
    return posixpath.splitext(path)[0]


class GenericIndexer:
    """One entity per file, with imports and symbol counts where the language is known."""

    extensions = tuple(LANGUAGES)

    @staticmethod
    def comment(lines: list[str]) -> str:
        """The shebang, or the first line of the comment at the top."""
        if lines and lines[0].startswith("#!"):
            return lines[0].strip()
        for line in map(str.strip, lines):
            if not line:
                continue
            mark = next((m for m in COMMENTS if line.startswith(m)), None)
            if mark is None:
                return ""
            said = line.removeprefix(mark).strip()
            if said:
                cut = said.encode()
                return said if len(cut) <= 120 else cut[:120].decode("utf-8", "ignore") + "..."
        return ""

    @staticmethod
    def imports(ext: str, lines: list[str], path: str) -> list[str]:
        folder, out = posixpath.dirname(path) or ".", {}
        for line in lines:
            for k, pattern in enumerate(IMPORTS.get(ext, ())):
                if m := re.match(pattern, line):
                    target = m[1]
                    if ext == ".py" and k == 1 and target.startswith("."):
                        module = target.lstrip(".")
                        base = folder
                        for _ in range(len(target) - len(module) - 1):
                            base = posixpath.dirname(base) or "."
                        inner = module.replace(".", "/")
                        target = base if not inner else inner if base == "." else f"{base}/{inner}"
                    elif ext == ".rb" and k == 1:
                        target = posixpath.normpath(posixpath.join(folder, target))
                    if target.strip():
                        out.setdefault(target.strip())
        return list(out)

    def index(self, path: str, text: str) -> list[dict]:
        ext = posixpath.splitext(path)[1]
        lines = text.split("\n")
        lines = lines[:-1] if lines and lines[-1] == "" else lines
        name = posixpath.basename(_stem(path))
        kind = "file" if ext in PLAIN_FILES else "module"
        functions, classes = (sum(1 for x in lines if re.search(p, x)) for p in SYMBOLS.get(ext, ("(?!)", "(?!)")))
        said = self.comment(lines)
        summary = f"{kind.capitalize()} {name} — {said}" if said else f"{kind.capitalize()} {name} ({LANGUAGES.get(ext, 'Text')})"
        counts = ", ".join(f"{n} {w}" for n, w in ((functions, "functions"), (classes, "classes")) if n)
        edges = [(t, "imports") for t in self.imports(ext, lines, path)]
        return [_entity(_stem(path), kind, name, summary + (f" — {counts}" if counts else ""), "\n".join(lines[:CONTEXT_LINES]), path, (0, 0), text, edges)]


def mask(text: str, quotes: str = "\"'`") -> str:
    """Text of equal length in which strings and comments are blanks, so that braces can be counted."""
    pattern = r"//[^\n]*|/\*.*?\*/" + "".join(rf"|{q}(?:\\.|[^{q}\\{'' if q == '`' else chr(92) + 'n'}])*{q}" for q in quotes)
    return re.sub(pattern, lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)


_LITERAL = re.compile(
    r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`"  # comments and strings stay as they are
    r"|((?:^|[=(,:;!&|?{}\[+\-*%<>~^]|\breturn|\btypeof|\bcase)[ \t]*)(/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*)", re.S | re.M,
)


def mask_patterns(text: str) -> str:
    """Script text of equal length in which regular expression literals are blanks. A slash starts one
    where no operand is before it."""
    return _LITERAL.sub(lambda m: m[0] if m[2] is None else m[1] + " " * len(m[2]), text)


def block_end(masked: str, at: int) -> int:
    """Position after the block that opens at or after ``at``; the end of the line without one."""
    line = masked.find("\n", at)
    start = masked.find("{", at)
    if start < 0 or (0 <= line < start and ";" in masked[at:line]):
        return len(masked) if line < 0 else line
    depth = 0
    for m in re.finditer(r"[{}]", masked[start:]):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return start + m.end()
    return len(masked)


def _span(text: str, start: int, end: int) -> tuple[int, int]:
    return text.count("\n", 0, start) + 1, text.count("\n", 0, max(start, end - 1)) + 1


class GoIndexer:
    """Go by brace matching (approximate: there is no Go parser here): file, functions, methods, types, interfaces."""

    extensions = (".go",)
    # Predeclared functions of the language, and words that come before a parenthesis.
    BUILTINS = frozenset((
        "append", "cap", "clear", "close", "complex", "copy", "delete", "imag", "len", "make", "max", "min", "new", "panic", "print", "println", "real", "recover",
    ))
    KEYWORDS = frozenset((
        "case", "chan", "defer", "for", "func", "go", "if", "interface", "map", "range", "return", "select", "struct", "switch", "type",
    ))

    def index(self, path: str, text: str) -> list[dict]:
        masked, base, out = mask(text), _stem(path), []
        package = re.search(r"^package\s+(\w+)", masked, re.M)
        if not package:
            return []
        block = "\n".join(re.findall(r"^import\s*\((.*?)^\)", text, re.S | re.M) + re.findall(r"^import\s+([^\n(]+)$", text, re.M))
        found = re.findall(r"(?:([\w.]+)\s+)?\"([^\"]+)\"", block)
        aliases = {a or p.rsplit("/", 1)[-1]: p for a, p in found}
        types = {m[1]: (m, m[2]) for m in re.finditer(r"^(?:type\s+|\t)(\w+)(?:\[[^\]]*\])?\s+(struct|interface)\b\s*\{", masked, re.M)}
        others = {m[1]: m for m in re.finditer(r"^type\s+(\w+)\s+(?!struct|interface)[^\n(]+$", masked, re.M)}
        methods: dict[str, set] = {}
        funcs = list(re.finditer(r"^func\s+(?:\(\s*(?:\w+\s+)?\*?(\w+)(?:\[[^\]]*\])?\s*\)\s*)?(\w+)", masked, re.M))
        for m in funcs:
            if m[1]:
                methods.setdefault(m[1], set()).add(m[2])
        body = lambda m: masked[m.end() : block_end(masked, m.end() - 1)]
        wants = {n: set(re.findall(r"^\s*(\w+)\s*\(", body(m), re.M)) for n, (m, k) in types.items() if k == "interface"}
        contains = []
        for m in funcs:
            end = block_end(masked, m.end())
            name = f"{m[1]}.{m[2]}" if m[1] else m[2]
            calls = []
            for c in re.finditer(r"(?:(\w+)\.)?(\w+)\(", masked[m.end() : end]):
                if c[2] in self.BUILTINS and not c[1] or c[2] in self.KEYWORDS:
                    continue
                where = f"{aliases[c[1]]}.{c[2]}" if c[1] in aliases else f"{base}/{c[1]}.{c[2]}" if c[1] else f"{base}/{c[2]}"
                if where != f"{base}/{name}":
                    calls.append((where, "calls"))
            doc = self._doc(text, m.start())
            kind = "method" if m[1] else "function"
            out.append(_entity(f"{base}/{name}", kind, name, doc or f"{kind.capitalize()} {name}", text[m.start() : end], path, _span(text, m.start(), end), text, calls))
            contains.append((f"{base}/{name}", "contains"))
        for name, (m, kind) in types.items():
            end = block_end(masked, m.end() - 1)
            edges = [(f"{base}/{e}", "extends") for e in re.findall(r"^\s+\*?([A-Z]\w*)\s*$", masked[m.end() : end], re.M)] if kind == "struct" else []
            if kind == "struct":
                edges += [(f"{base}/{i}", "implements") for i, need in wants.items() if need and need <= methods.get(name, set())]
            label = "interface" if kind == "interface" else "type"
            out.append(_entity(f"{base}/{name}", label, name, self._doc(text, m.start()) or f"{label.capitalize()} {name}", text[m.start() : end], path, _span(text, m.start(), end), text, edges))
            contains.append((f"{base}/{name}", "contains"))
        for name, m in others.items():
            out.append(_entity(f"{base}/{name}", "type", name, self._doc(text, m.start()) or f"Type {name}", m[0], path, _span(text, m.start(), m.end()), text, []))
            contains.append((f"{base}/{name}", "contains"))
        imports = [(p, "imports") for _, p in found]
        file = posixpath.basename(path)
        return [_entity(base, "file", file, f"Go file {file} in package {package[1]}", "", path, (0, 0), text, imports + contains), *out]

    @staticmethod
    def _doc(text: str, at: int) -> str:
        said = []
        for line in reversed(text[:at].rstrip("\n").split("\n")):
            if not line.startswith("//"):
                break
            said.append(line.removeprefix("//").strip())
        return re.split(r"(?<=[.!?])\s", " ".join(reversed(said)).strip())[0] if said else ""


class ScriptIndexer:
    """TypeScript and JavaScript: module, classes with methods, interfaces, functions, type aliases."""

    extensions = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")
    LEAD = r"^(?:export\s+)?(?:default\s+)?"
    # Words that come before a parenthesis without being methods.
    SKIP = frozenset(("if", "for", "while", "switch", "catch", "constructor", "return", "function", "new", "typeof", "await"))

    def index(self, path: str, text: str) -> list[dict]:
        base, out, contains = _stem(path), [], []
        masked = mask(mask_patterns(text))
        plain = re.sub(r"//[^\n]*|/\*.*?\*/", lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)
        imports = []
        for m in re.finditer(r"^\s*(?:import|export)\s+(?:[^;'\"]*?\sfrom\s+)?['\"]([^'\"]+)['\"]|^\s*(?:const|let|var|import)\s+\w+\s*=\s*require\s*\(\s*['\"]([^'\"]+)['\"]", plain, re.M):
            target = m[1] or m[2]
            if target.startswith("."):
                target = posixpath.normpath(posixpath.join(posixpath.dirname(path), re.sub(r"\.(tsx?|jsx?|mjs|cjs)$", "", target)))
            imports.append((target, "imports"))

        def add(m, name, kind, edges=(), end=None):
            end = block_end(masked, m.end() - 1) if end is None else end
            out.append(_entity(f"{base}/{name}", kind, name, f"{kind.capitalize()} {name}", text[m.start() : end], path, _span(text, m.start(), end), text, edges))
            contains.append((f"{base}/{name}", "contains"))
            return end

        names = lambda s: [x.strip() for x in (s or "").split(",") if x.strip()]
        for m in re.finditer(self.LEAD + r"(?:abstract\s+)?class\s+(\w+)(?:\s+extends\s+([\w.]+))?(?:\s+implements\s+([\w\s,]+))?\s*\{", masked, re.M):
            edges = [(f"{base}/{m[2]}", "extends")] if m[2] else []
            edges += [(f"{base}/{i}", "implements") for i in names(m[3])]
            end = block_end(masked, m.end() - 1)
            for k in re.finditer(r"^\s+(?:(?:public|private|protected|static|abstract|async|readonly|override|get|set)\s+)*(\w+)\s*[(<][^;{}]*\{", masked[m.end() : end], re.M):
                if k[1] not in self.SKIP:
                    at = m.end() + k.start()
                    stop = block_end(masked, m.end() + k.end() - 1)
                    name = f"{m[1]}.{k[1]}"
                    out.append(_entity(f"{base}/{name}", "method", name, f"Method {name}", text[at:stop].strip("\n"), path, _span(text, at + len(k[0]) - len(k[0].lstrip()), stop), text, []))
                    edges.append((f"{base}/{name}", "contains"))
            add(m, m[1], "class", edges, end)
        for m in re.finditer(self.LEAD + r"interface\s+(\w+)(?:\s+extends\s+([\w\s,]+))?\s*\{", masked, re.M):
            add(m, m[1], "interface", [(f"{base}/{i}", "extends") for i in names(m[2])])
        for m in re.finditer(self.LEAD + r"(?:async\s+)?function\s*\*?\s*(\w+)\s*[(<]", masked, re.M):
            add(m, m[1], "function")
        for m in re.finditer(r"^(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?\([^)]*\)\s*(?::\s*\S+\s*)?=>", masked, re.M):
            add(m, m[1], "function")
        for m in re.finditer(r"^(?:export\s+)?type\s+(\w+)\s*(?:<[^>]*>)?\s*=", masked, re.M):
            stop = masked.find(";", m.end())
            add(m, m[1], "type", end=stop + 1 if stop >= 0 else len(text))
        name = posixpath.basename(base)
        return [_entity(base, "module", name, f"Module {name}", "\n".join(text.split("\n")[:CONTEXT_LINES]), path, (0, 0), text, imports + contains), *out]


INDEXERS: tuple = (GoIndexer(), ScriptIndexer(), GenericIndexer())


def indexer_for(path: str, indexers=INDEXERS):
    ext = posixpath.splitext(path)[1]
    return next((x for x in indexers if ext in x.extensions), None)


ENTITY_ROWS = 1_024  # entities that a worker holds before it sends them on


def entities(files: DataFrame, indexers=INDEXERS) -> DataFrame:
    """Entities of files (path, content); files of unknown kinds and unreadable ones give none."""

    def run(batches):
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                indexer = indexer_for(path, indexers)
                if indexer is not None:
                    try:
                        rows += indexer.index(path, bytes(content).decode("utf-8", "replace"))
                    except Exception:  # noqa: BLE001, S112  one odd file must not end the run
                        continue
                if len(rows) >= ENTITY_ROWS:
                    yield pd.DataFrame(rows)
                    rows = []
            if rows:
                yield pd.DataFrame(rows)

    return files.select("path", "content").mapInPandas(run, ENTITIES)


def to_nodes(found: DataFrame, namespace: str, now: str) -> DataFrame:
    lit = lambda v: F.lit(v).cast("string")
    return found.select(
        "id", "type", lit(namespace).alias("namespace"), lit("active").alias("status"), lit(now).alias("valid_from"), lit("").alias("valid_until"), lit("").alias("superseded_by"),
        "source", "edges", F.array().cast("array<string>").alias("tags"), "summary", "context", lit(None).alias("vault_id"), F.concat("id", F.lit(".md")).alias("file_path"),
    )


def incremental(found: DataFrame, nodes: DataFrame, classified: DataFrame | None = None) -> DataFrame:
    """(id, action, target): unchanged active nodes are skipped, known ids updated, new ones go by
    ``classified`` (query_id, action, target) or are added; a supersede of an id of this run, of
    itself or of nothing is an add."""
    old = nodes.select("id", F.col("source.hash").alias("old_hash"), is_active().alias("live"))
    out = found.select("id", F.col("source.hash").alias("hash")).join(old, "id", "left")
    if classified is not None:
        said = classified.select(F.col("query_id").alias("id"), F.col("action").alias("said"), F.col("target"))
        here = found.select(F.col("id").alias("target"), F.lit(True).alias("in_run"))
        there = nodes.select(F.col("id").alias("target"), F.lit(True).alias("exists"))
        out = out.join(said.join(here, "target", "left").join(there, "target", "left"), "id", "left")
    else:
        out = out.withColumns({"said": F.lit("add"), "target": F.lit(None).cast("string"), "in_run": F.lit(None).cast("boolean"), "exists": F.lit(None).cast("boolean")})
    bad = F.col("in_run").isNotNull() | F.col("exists").isNull() | (F.col("target") == F.col("id"))
    fresh = F.when((F.col("said") == "supersede") & bad, "add").otherwise(F.coalesce("said", F.lit("add")))
    action = F.when(F.col("old_hash").isNull() & F.col("live").isNull(), fresh).when(F.col("live") & (F.col("hash") == F.col("old_hash")), "skip").otherwise("update")
    return out.select("id", action.alias("action"), F.when(action.isin("supersede", "noop"), F.col("target")).alias("target"))
