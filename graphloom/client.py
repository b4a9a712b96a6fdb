"""Facade over one graph: the verbs of the query tool, returning DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import embed_text
from graphloom.functions.vectors import Embedder, HashEmbedder, embed_column
from graphloom.operators import classify, federation, graph, heat, integrity, mutations, retrieval
from graphloom.schema import LIST_CAP, clamp_budget, clamp_depth, clamp_limit, clamp_neighbors, is_active, normal_namespace


@dataclass
class Client:
    nodes: DataFrame
    embeddings: DataFrame
    heat: DataFrame | None = None
    embedder: Embedder = field(default_factory=HashEmbedder)
    now: str = "1970-01-01T00:00:00Z"
    namespace: str = "default"

    def __post_init__(self):
        self.curator = mutations.Curator(self.nodes, self.now)

    @property
    def edges(self) -> DataFrame:
        return graph.edges_of(self.curator.nodes)

    @property
    def current(self) -> DataFrame:
        return self.curator.nodes

    def _vector(self, text: str) -> DataFrame:
        spark = self.nodes.sparkSession
        return spark.createDataFrame([("q", self.embedder.embed([text])[0].tolist())], "query_id string, embedding array<float>")

    # reads

    def search(self, text: str, limit: int | None = 20) -> DataFrame:
        hits = retrieval.search(self.embeddings, self._vector(text), limit or 20, model=self.embedder.model, only_active=True)
        return hits.join(self.current.withColumnRenamed("id", "node_id"), "node_id").orderBy("rank")

    def api_search(self, text: str, limit: int | None = 10, namespace: str | None = None, others: DataFrame | None = None) -> DataFrame:
        """The search of the web interface; see ``retrieval.api_search``."""
        return retrieval.api_search(self.embeddings, self._vector(text), self.current, clamp_limit(limit), namespace, self.embedder.model, others)

    def query(self, text: str, depth: int | None = None, budget: int | None = None, include_superseded: bool = False, mode: str = "adjacency") -> DataFrame:
        """One row: the packed document; an empty one where the search finds nothing."""
        packed = retrieval.context_query(
            self.current, self.edges, self.embeddings, self._vector(text), self.heat, depth=clamp_depth(depth), budget=clamp_budget(budget),
            include_superseded=include_superseded, model=self.embedder.model,
        )
        out = retrieval.document(packed)
        if out.isEmpty():
            return self.nodes.sparkSession.createDataFrame([("q", retrieval.EMPTY, len(retrieval.EMPTY) // 4, 0)], "query_id string, xml string, tokens int, nodes long")
        return out

    def get(self, id_: str) -> DataFrame:
        return graph.to_client(self.current.where(F.col("id") == id_), self.edges)

    def detail(self, id_: str, files: DataFrame) -> DataFrame:
        """The node, under the client's namespace or bare, with degrees and staleness."""
        for name in (f"{self.namespace}/{id_}", id_):
            one = self.current.where(F.col("id") == name)
            if not one.isEmpty():
                return one.join(graph.degrees(one, self.edges), "id").join(integrity.staleness(one, files), "id", "left")
        return self.current.limit(0)

    def neighbors(self, id_: str, depth: int = 1) -> DataFrame:
        return graph.neighbors_both(self.current, self.edges, id_, clamp_neighbors(depth))

    def by_tag(self, tag: str) -> DataFrame:
        return self._list(F.array_contains("tags", tag))

    def by_type(self, kind: str) -> DataFrame:
        return self._list(F.col("type") == kind)

    def by_namespace(self, name: str) -> DataFrame:
        return self._list(normal_namespace() == name)

    def _list(self, condition) -> DataFrame:
        return graph.capped(self.current.where(is_active() & condition).orderBy("id"), LIST_CAP)

    def orphans(self) -> DataFrame:
        return graph.orphans(graph.active(self.current), self.edges)

    def stats(self) -> DataFrame:
        return federation.graph_stats(self.current, self.edges)

    def values(self) -> DataFrame:
        return federation.distinct_values(self.current)

    def suggestions(self, limit: int | None = None, offset: int = 0, **parts) -> DataFrame:
        return integrity.ranked(integrity.suggestions(self.current, **parts), offset, clamp_limit(limit, "suggestions"))

    def verify(self, files: DataFrame, check: str = "all") -> DataFrame:
        return integrity.verify(self.current, files, check)

    # writes

    def write(self, new: DataFrame) -> DataFrame:
        self.curator.nodes, report = mutations.write(self.current, new, self.now)
        text = embed_text("summary", "context", "tags")
        fresh = self.current.join(report.select("id"), "id", "left_semi").select(
            F.col("id").alias("node_id"), embed_column(text, self.embedder).alias("embedding"), F.sha2(text, 256).alias("summary_hash"), F.lit(self.embedder.model).alias("model"),
            F.lit(self.now).cast("timestamp").alias("updated_at"), F.lit("active").alias("status"),
        )
        self.embeddings = mutations.upsert_embeddings(self.embeddings, fresh)
        return report

    def classify(self, new: DataFrame, judge=None) -> DataFrame:
        vectors = new.select(F.col("id").alias("query_id"), embed_column(embed_text("summary", "context", "tags"), self.embedder).alias("embedding"))
        return classify.classify(vectors, self.current, self.embeddings, self.embedder.model, judge)

    def delete(self, id_: str, by: str | None = None) -> None:
        hit = self.current.where((F.col("id") == id_) & is_active()).select("id")
        if hit.isEmpty():
            raise KeyError(id_)
        self.curator.nodes = mutations.delete(self.current, F.col("id") == id_, self.now, by)
        self.embeddings = mutations.retire_embeddings(self.embeddings, self.nodes.sparkSession.createDataFrame([(id_,)], "id string"))

    def tag_matching(self, text: str, tag: str, limit: int | None = None) -> DataFrame:
        """Tag what a search finds; ids that have the tag count as well."""
        hits = self.search(text, clamp_limit(limit)).select("node_id")
        self.curator.nodes, found = mutations.tag_hits(self.current, hits, tag)
        return self.current.join(found, "id", "left_semi").select("id", "tags")

    def command(self, line: str, selection: tuple[str, ...] = ()) -> DataFrame:
        return self.curator.run(line, selection)

    def undo(self) -> DataFrame:
        return self.curator.undo()

    def record(self, entries: DataFrame) -> DataFrame:
        """Heat with the co-access of one ranked result added."""
        new = heat.accumulate(heat.pairs(retrieval.co_access(entries))).select(F.lit(self.namespace).alias("namespace"), "a", "b", "hits", F.lit(self.now).alias("last"))
        base = self.heat if self.heat is not None else self.nodes.sparkSession.createDataFrame([], "namespace string, a string, b string, weight double, hits int, last string")
        self.heat = heat.merge(base, new)
        return self.heat
