"""Schemas, enumerations and the predicates that derive from them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

EDGE = T.StructType([T.StructField("target", T.StringType()), T.StructField("relation", T.StringType())])
SOURCE = T.StructType(
    [T.StructField("path", T.StringType()), T.StructField("lines", T.ArrayType(T.IntegerType())), T.StructField("hash", T.StringType())]
)
NODES = T.StructType(
    [T.StructField("id", T.StringType(), False)]
    + [T.StructField(c, T.StringType()) for c in ("type", "namespace", "status", "valid_from", "valid_until", "superseded_by")]
    + [T.StructField("source", SOURCE), T.StructField("edges", T.ArrayType(EDGE)), T.StructField("tags", T.ArrayType(T.StringType()))]
    + [T.StructField(c, T.StringType()) for c in ("summary", "context", "vault_id", "file_path")]
)
EMBEDDINGS = "node_id string, embedding array<float>, summary_hash string, model string, updated_at timestamp, status string"
HEAT = "namespace string, a string, b string, weight double, hits int, last string"
BRIDGES = (
    "source string, target string, allowed_relations array<string>, source_vault_id string, target_vault_id string, ord int"
)
ENTITIES = (
    "id string, type string, name string, summary string, context string, "
    "source struct<path:string,lines:array<int>,hash:string>, edges array<struct<target:string,relation:string>>"
)

# Fixed values of the data model.
ACTIVE, SUPERSEDED, ARCHIVED = "active", "superseded", "archived"
STRUCTURAL_RELATIONS = ("contains", "imports", "extends", "implements")
BEHAVIORAL_RELATIONS = ("calls", "reads", "writes", "references", "cross_project", "associated")
RELATIONS = STRUCTURAL_RELATIONS + BEHAVIORAL_RELATIONS
EXTERNAL_RELATIONS = ("imports", "calls", "extends", "implements", "references")
WRITE_TYPES = ("function", "module", "class", "concept", "decision", "reference", "composite")
CURATOR_TYPES = (
    "function", "module", "class", "concept", "decision", "reference", "composite", "file", "interface", "method", "type", "package",
)
SEVERITIES = ("error", "warning", "info")
DEFAULT_NAMESPACE = "default"
DEFAULT_BUDGET = 4096
LIST_CAP = 500


@dataclass
class VaultConfig:
    """Engine options of a vault."""

    version: str = "1"
    vault_id: str = ""
    namespace: str = DEFAULT_NAMESPACE
    embedding_provider: str = "mock"
    embedding_model: str = ""
    token_budget: int = 0
    extra: dict = field(default_factory=dict)

    @property
    def effective_budget(self) -> int:
        return self.token_budget or DEFAULT_BUDGET


def blank(c: Column) -> Column:
    """Missing text and empty text are one."""
    return F.coalesce(c, F.lit(""))


def is_active(status: str | Column = "status") -> Column:
    c = F.col(status) if isinstance(status, str) else status
    return blank(c).isin("", ACTIVE)


def edge_class(relation: str | Column = "relation") -> Column:
    c = F.col(relation) if isinstance(relation, str) else relation
    return F.when(c.isin(*STRUCTURAL_RELATIONS), "structural").otherwise("behavioral")


def normal_namespace(c: str | Column = "namespace") -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(blank(c) == "", DEFAULT_NAMESPACE).otherwise(c)


def severity_rank(c: str | Column = "severity") -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c == "error", 0).when(c == "warning", 1).when(c == "info", 2).otherwise(3)


def clamp(value: int | None, low: int, high: int, otherwise: int) -> int:
    """``value`` where it lies between the bounds, else the default."""
    return value if value is not None and low <= value <= high else otherwise


def clamp_depth(depth: int | None) -> int:
    return clamp(depth, 0, 10, 2)


def clamp_budget(budget: int | None, configured: int = 0) -> int:
    if not budget or budget <= 0:
        return configured or DEFAULT_BUDGET
    return min(budget, 100_000)


def clamp_limit(limit: int | None, kind: str = "search") -> int:
    """Limits of searches and tags (1 to 100, else 10) and of suggestions (1 to 200, else 20)."""
    return clamp(limit, 1, 200, 20) if kind == "suggestions" else clamp(limit, 1, 100, 10)


def clamp_neighbors(depth: int) -> int:
    return max(1, min(5, depth))
