"""A property graph over the star-schema tables, in Spark and as SQL for comparison."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.schema import edge_class
from graphloom.storage import materialize

GRAPH = """
WITH RECURSIVE g_nodes AS (
    SELECT 'region/' || r_regionkey AS id, 'module' AS type, 'geo' AS namespace, 'active' AS status, '' AS superseded_by, r_name AS summary, ['place'] AS tags FROM region
    UNION ALL SELECT 'nation/' || n_nationkey, 'module', 'geo', 'active', '', n_name, ['place', 'country'] FROM nation
    UNION ALL SELECT 'supplier/' || s_suppkey, 'class', 'supply', '', '', s_name, ['n' || s_nationkey] FROM supplier
    UNION ALL SELECT 'customer/' || c_custkey, 'class', 'sales', 'active', '', c_name, [c_mktsegment, 'n' || c_nationkey] FROM customer
    UNION ALL SELECT 'part/' || p_partkey, 'concept', 'supply', 'active', '', p_name, [p_brand, 'size' || p_size] FROM part
    UNION ALL SELECT 'orders/' || o_orderkey, 'function', 'sales', CASE WHEN o_orderstatus = 'F' THEN 'superseded' ELSE 'active' END,
        CASE WHEN o_orderstatus = 'F' AND o_orderkey % 3 > 0 THEN 'orders/' || (o_orderkey + 1) ELSE '' END, '', [o_orderpriority] FROM orders
    UNION ALL SELECT 'item/' || item_id, 'reference', 'supply', 'active', '', 'item', ['bench'] FROM benchmark
), g_pairs AS (
    SELECT 'region/' || n_regionkey AS src, 'nation/' || n_nationkey AS dst, 'contains' AS relation FROM nation
    UNION ALL SELECT 'nation/' || c_nationkey, 'customer/' || c_custkey, 'contains' FROM customer
    UNION ALL SELECT 'nation/' || s_nationkey, 'supplier/' || s_suppkey, 'contains' FROM supplier
    UNION ALL SELECT 'customer/' || o_custkey, 'orders/' || o_orderkey, 'calls' FROM orders
    UNION ALL SELECT DISTINCT 'orders/' || l_orderkey, 'part/' || l_partkey, 'reads' FROM lineitem
    UNION ALL SELECT DISTINCT 'orders/' || l_orderkey, 'supplier/' || l_suppkey, 'references' FROM lineitem
    UNION ALL SELECT DISTINCT 'part/' || l_partkey, 'supplier/' || l_suppkey, 'associated' FROM lineitem
), g_edges AS (
    SELECT *, CASE WHEN relation IN ('contains', 'imports', 'extends', 'implements') THEN 'structural' ELSE 'behavioral' END AS class,
        row_number() OVER (PARTITION BY src ORDER BY relation, dst) - 1 AS ord FROM g_pairs
)"""


def text_of(value: str | None) -> Column:
    return F.lit(value).cast("string")


@dataclass
class Views:
    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def nodes(self) -> DataFrame:
        def part(table, kind, key, type_, namespace, summary, tags, status="active", by=None):
            c = lambda x: F.col(x) if isinstance(x, str) else x
            return self.table(table).select(
                F.concat(F.lit(f"{kind}/"), key).alias("id"), F.lit(type_).alias("type"), F.lit(namespace).alias("namespace"),
                (F.lit(status) if isinstance(status, str) else status).alias("status"), (F.lit("") if by is None else by).alias("superseded_by"), c(summary).alias("summary"), F.array(*tags).alias("tags"),
            )

        old = F.col("o_orderstatus") == "F"
        rows = [
            part("region", "region", "r_regionkey", "module", "geo", "r_name", [F.lit("place")]),
            part("nation", "nation", "n_nationkey", "module", "geo", "n_name", [F.lit("place"), F.lit("country")]),
            part("supplier", "supplier", "s_suppkey", "class", "supply", "s_name", [F.concat(F.lit("n"), "s_nationkey")], ""),
            part("customer", "customer", "c_custkey", "class", "sales", "c_name", [F.col("c_mktsegment"), F.concat(F.lit("n"), "c_nationkey")]),
            part("part", "part", "p_partkey", "concept", "supply", "p_name", [F.col("p_brand"), F.concat(F.lit("size"), "p_size")]),
            part("orders", "orders", "o_orderkey", "function", "sales", F.lit(""), [F.col("o_orderpriority")], F.when(old, "superseded").otherwise("active"),
                 F.when(old & (F.col("o_orderkey") % 3 > 0), F.concat(F.lit("orders/"), F.col("o_orderkey") + 1)).otherwise("")),
            part("benchmark", "item", "item_id", "reference", "supply", F.lit("item"), [F.lit("bench")]),  # without edges
        ]
        out = rows[0]
        for r in rows[1:]:
            out = out.unionByName(r)
        return out

    @cached_property
    def pairs(self) -> DataFrame:
        return self._pairs(True)

    @cached_property
    def repeated(self) -> DataFrame:
        """The pairs with their repeats, for work in which these change nothing: no shuffle is needed to find them."""
        return self._pairs(False)

    def _pairs(self, distinct: bool) -> DataFrame:
        def part(table, src, src_key, dst, dst_key, relation, once=False):
            keys = self.table(table).select(src_key, dst_key)
            keys = keys.distinct() if once and distinct else keys  # on the narrow keys, before names are made of them
            return keys.select(F.concat(F.lit(f"{src}/"), src_key).alias("src"), F.concat(F.lit(f"{dst}/"), dst_key).alias("dst"), F.lit(relation).alias("relation"))

        rows = [
            part("nation", "region", "n_regionkey", "nation", "n_nationkey", "contains"), part("customer", "nation", "c_nationkey", "customer", "c_custkey", "contains"),
            part("supplier", "nation", "s_nationkey", "supplier", "s_suppkey", "contains"), part("orders", "customer", "o_custkey", "orders", "o_orderkey", "calls"),
            part("lineitem", "orders", "l_orderkey", "part", "l_partkey", "reads", True), part("lineitem", "orders", "l_orderkey", "supplier", "l_suppkey", "references", True),
            part("lineitem", "part", "l_partkey", "supplier", "l_suppkey", "associated", True),
        ]
        out = rows[0]
        for r in rows[1:]:
            out = out.unionByName(r)
        return out.withColumn("class", edge_class())

    @cached_property
    def edges(self) -> DataFrame:
        """With the position of each edge in its node's list."""
        w = Window.partitionBy("src").orderBy("relation", "dst")
        return self.pairs.withColumn("ord", (F.row_number().over(w) - 1).cast("bigint"))

    def loaded(self) -> Views:
        """The same graph as stored tables, sorted by id and by source, so that later searches do not derive it again."""
        out = Views(self.spark, self.sf_dir)
        out.nodes = materialize(self.nodes.repartitionByRange("id").sortWithinPartitions("id"), "nodes")
        out.pairs = materialize(self.pairs.repartitionByRange("src").sortWithinPartitions("src"), "edges")
        return out

    @cached_property
    def full_nodes(self) -> DataFrame:
        """Nodes in the canonical schema, with their edge lists."""
        return self.full(self.nodes, self.pairs)

    def full(self, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
        """Nodes with the edges that leave them; lists are in the order of ``edges``, which one sort of each gives."""
        listed = pairs.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list(F.struct("relation", F.col("dst").alias("target")))).alias("_e"))
        text = lambda v: F.lit(v).cast("string")
        source = F.struct(text("").alias("path"), F.array(F.lit(0), F.lit(0)).alias("lines"), text("").alias("hash"))
        out = nodes.join(listed, "id", "left").withColumn("edges", F.transform(F.coalesce("_e", F.array()), lambda e: F.struct(e["target"].alias("target"), e["relation"].alias("relation"))))
        return out.drop("_e").withColumns({"valid_from": text(""), "valid_until": text(""), "source": source, "context": text(""), "vault_id": text(""), "file_path": F.concat("id", F.lit(".md"))})

    @cached_property
    def embeddings(self) -> DataFrame:
        return self.table("embeddings").select(
            F.concat(F.lit("vec/"), "vec_id").alias("node_id"), "vec_id", "embedding", F.concat(F.lit("m"), F.col("label") % 2).alias("model"),
            F.when(F.col("label") == 9, "superseded").otherwise("active").alias("status"), "label", F.concat(F.lit("v"), F.col("label") % 3).alias("vault_id"),
        )

    def vectors(self, step: int = 50) -> DataFrame:
        """Queries: the vectors whose id is divisible by ``step``."""
        return self.table("embeddings").where(F.col("vec_id") % step == 0).select(F.col("vec_id").alias("query_id"), "embedding")

    @cached_property
    def access(self) -> DataFrame:
        """Reads of node kinds by user and day."""
        return self.table("events").select(F.concat_ws("@", F.col("user_id").cast("string"), F.to_date("ts").cast("string")).alias("query_id"), F.col("event_type").alias("node_id"))
