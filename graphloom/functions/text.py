"""Column expressions over ids, texts, URLs and hashes. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.schema import blank

MAX_ID_BYTES = 512


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def token_estimate(c: str | Column, ceil: bool = False) -> Column:
    """Bytes over four, rounded down (or up, as evaluations count)."""
    n = F.octet_length(blank(_c(c)))
    return F.floor((n + 3) / 4).cast("int") if ceil else F.floor(n / 4).cast("int")


def cut_bytes(c: str | Column, n: int) -> Column:
    """The first ``n`` bytes; a character cut in half becomes a replacement mark."""
    return F.make_valid_utf8(F.substring(F.encode(blank(_c(c)), "UTF-8"), 1, n).cast("string"))


def cut_utf8(c: str | Column, n: int) -> Column:
    """At most ``n`` bytes of whole characters: the cut goes back over bytes that continue a character."""
    whole = blank(_c(c))
    raw = F.encode(whole, "UTF-8")
    inside = lambda at: F.hex(F.substring(raw, at, 1)).between("80", "BF")
    end = F.when(~inside(n + 1), n).when(~inside(n), n - 1).when(~inside(n - 1), n - 2).otherwise(n - 3)
    return F.when(F.octet_length(whole) <= n, whole).otherwise(F.make_valid_utf8(F.substring(raw, F.lit(1), end).cast("string")))


def escape_html(c: str | Column) -> Column:
    out = blank(_c(c))
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def quote(c: str | Column) -> Column:
    """Double-quoted with backslash escapes."""
    out = blank(_c(c))
    for raw, safe in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return F.concat(F.lit('"'), out, F.lit('"'))


def wikilinks(c: str | Column) -> Column:
    """Targets of [[links]], in order, each once."""
    return F.array_distinct(F.regexp_extract_all(blank(_c(c)), F.lit(r"\[\[([^\]]+)\]\]"), F.lit(1)))


def body_summary(body: str | Column) -> Column:
    """Text before the first second-level heading."""
    return F.trim(F.regexp_extract(F.concat(F.lit("\n"), blank(_c(body))), r"(?s)^\n?(.*?)(?:\n## |$(?!\n))", 1))


def body_section(body: str | Column, title: str) -> Column:
    """Text below the heading, up to the next second-level heading."""
    at = F.instr(blank(_c(body)), f"## {title}")
    rest = F.substring(_c(body), at + len(title) + 3, F.length(_c(body)))
    return F.when(at > 0, F.trim(F.split_part(rest, F.lit("\n## "), F.lit(1)))).otherwise("")


def valid_id(c: str | Column) -> Column:
    """Not empty, at most 512 bytes, relative, without parents, NULs, empty or hidden components."""
    c = blank(_c(c))
    parts = F.split(c, "/")
    bad = F.exists(parts, lambda p: (p == "") | p.startswith("."))
    return (c != "") & (F.octet_length(c) <= MAX_ID_BYTES) & ~c.contains("..") & ~c.startswith("/") & ~c.contains("\x00") & ~bad


def id_is_valid(value: str | None) -> bool:
    """``valid_id`` for one value, in tasks that write or read a file of that name."""
    v = value or ""
    return bool(v) and len(v.encode()) <= MAX_ID_BYTES and ".." not in v and "\x00" not in v and not any(p == "" or p.startswith(".") for p in v.split("/"))


def id_from_path(path: str | Column) -> Column:
    return F.regexp_replace(_c(path), r"\.md$", "")


def vault_prefix(c: str | Column) -> Column:
    """struct(vault, rest): '@vault/rest'; anything else is local with an empty vault."""
    c = blank(_c(c))
    hit = c.rlike("^@[^/]+/")
    return F.struct(
        F.when(hit, F.regexp_extract(c, "^@([^/]+)/", 1)).otherwise("").alias("vault"),
        F.when(hit, F.regexp_replace(c, "^@[^/]+/", "")).otherwise(c).alias("rest"),
    )


def qualified(vault: str | Column, rest: str | Column) -> Column:
    """'@vault/rest', or just the rest where the vault is empty."""
    return F.when(blank(_c(vault)) == "", _c(rest)).otherwise(F.concat(F.lit("@"), _c(vault), F.lit("/"), _c(rest)))


def rewrite_target(target: str | Column, vault: str | Column) -> Column:
    """Prefix targets that name no vault with their own."""
    t = _c(target)
    return F.when(t.startswith("@"), t).otherwise(F.concat(F.lit("@"), _c(vault), F.lit("/"), t))


def hierarchical(a: str | Column, b: str | Column) -> Column:
    """One id lies below the other."""
    a, b = _c(a), _c(b)
    return a.startswith(F.concat(b, F.lit("/"))) | b.startswith(F.concat(a, F.lit("/")))


def bridge_key(a: str | Column, b: str | Column) -> Column:
    return F.concat(F.least(_c(a), _c(b)), F.lit("--"), F.greatest(_c(a), _c(b)))


def folder(c: str | Column) -> Column:
    """First path segment, '_root' without one."""
    c = _c(c)
    return F.when(c.contains("/"), F.substring_index(c, "/", 1)).otherwise("_root")


def canonical_url(c: str | Column) -> Column:
    """Repository URL as host/path: no scheme, user, '.git' or trailing slash, host in lower case.

    Without a scheme, a colon before the first slash separates host and path; with one it is a port."""
    u = F.trim(blank(_c(c)))
    bare = F.regexp_replace(F.regexp_replace(u, r"^[^:/]*://", ""), r"^[^/@]*@", "")
    u = F.when(u.contains("://"), bare).otherwise(F.regexp_replace(bare, r"^([^/:]*):", "$1/"))
    host = F.substring_index(u, "/", 1)
    u = F.concat(F.lower(host), F.substring(u, F.length(host) + 1, F.length(u)))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(u, r"/+$", ""), r"\.git$", ""), r"/+$", "")


def slug(c: str | Column) -> Column:
    """Project id: lower-case letters and digits, anything between them one dash, at most 128 bytes."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(blank(_c(c))), r"[^\p{L}\p{Nd}]+", "-"), "^-|-$", "")
    return F.when(plain == "", "project").otherwise(F.regexp_replace(cut_utf8(plain, 128), "-$", ""))


def secret_key(c: str | Column) -> Column:
    """Settings that hold credentials; a token budget is none."""
    k = F.lower(_c(c))
    return k.rlike("api_key|secret|password") | (k.contains("token") & ~k.contains("budget"))


def secret_value(c: str | Column) -> Column:
    """Values of 20 bytes and more that start like a key."""
    return (F.octet_length(_c(c)) >= 20) & _c(c).rlike("^(sk-|sk_|pk-|pk_|Bearer |voyage-)")


def capitalized(c: str | Column) -> Column:
    c = blank(_c(c))
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 1 << 30))


def infer_type(id_: str | Column) -> Column:
    """Node type by the first hint found in the id."""
    c = F.lower(_c(id_))
    out = None
    for kind, hints in (
        ("function", ("func", "handler")), ("type", ("struct", "type", "model")), ("package", ("pkg", "package", "module")),
        ("api", ("api", "endpoint")), ("test", ("test",)),
    ):
        hit = c.rlike("|".join(hints))
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("concept")


def content_hash(summary: str | Column, context: str | Column, edges: str | Column) -> Column:
    """SHA-256 of summary, context and the sorted edges."""
    listed = F.array_sort(F.transform(F.coalesce(_c(edges), F.array()), lambda e: F.concat_ws("|", e["target"], e["relation"])))
    joined = F.array_join(F.transform(listed, lambda e: F.concat(e, F.lit(";"))), "")
    return F.sha2(
        F.concat(F.lit("summary:"), blank(_c(summary)), F.lit("\ncontext:"), blank(_c(context)), F.lit("\nedges:"), joined), 256
    )


def suggestion_id(kind: str | Column, node_ids: str | Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.substring(F.sha2(F.concat(kind, F.lit(":"), F.array_join(F.array_sort(_c(node_ids)), ",")), 256), 1, 32)


def embed_text(summary: str | Column, context: str | Column, tags: str | Column | None = None) -> Column:
    """Text to embed: summary (and tags), a blank line, the first 6000 bytes of the context."""
    head = blank(_c(summary))
    if tags is not None:
        head = F.concat(head, F.lit(" "), F.array_join(F.coalesce(_c(tags), F.array().cast("array<string>")), " "))
    body = blank(_c(context))
    return F.when(body == "", head).otherwise(F.concat(head, F.lit("\n\n"), cut_utf8(body, 6000)))


def csv_list(c: str | Column) -> Column:
    """Items between commas, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(blank(_c(c)), ","), lambda x: F.trim(x)), lambda x: x != "")


def strip_fence(c: str | Column) -> Column:
    """The inside of a fenced code block, if the text is one."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(blank(_c(c))), r"^```[A-Za-z]*\n?", ""), r"\n?```$", ""))


def code_blocks(c: str | Column) -> Column:
    return F.regexp_extract_all(blank(_c(c)), F.lit(r"(?s)```[A-Za-z]*\n(.*?)```"), F.lit(1))
