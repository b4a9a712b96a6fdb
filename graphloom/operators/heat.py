"""Co-access statistics: how often two nodes are read together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEARNING_RATE, DECAY_RATE, DECAY_FLOOR, PROMOTION, VISIBLE = 0.1, 0.95, 0.05, 0.80, 0.06


def pairs(access: DataFrame, query: str = "query_id", node: str = "node_id") -> DataFrame:
    """(query, a, b) with a < b for ids read by one query: its result list, which the ranking before
    bounds to ten entries, meets itself."""
    ids = access.select(query, node).distinct()
    return ids.withColumnRenamed(node, "a").join(ids.withColumnRenamed(node, "b"), query).where("a < b").select(query, "a", "b")


def accumulate(pair_rows: DataFrame, rate: float = LEARNING_RATE, by: tuple = ()) -> DataFrame:
    """(by..., a, b, hits, weight): w starts at the rate and moves by (1 - w) * rate, in closed form."""
    hits = pair_rows.groupBy(*by, "a", "b").agg(F.count("*").cast("int").alias("hits"))
    return hits.withColumn("weight", F.least(F.lit(1.0), 1 - F.pow(F.lit(1 - rate), F.col("hits"))))


def merge(heat: DataFrame, new: DataFrame, rate: float = LEARNING_RATE) -> DataFrame:
    """Add hits to weights that decay may have changed since: w <- 1 - (1 - w)(1 - rate)^n."""
    n = new.select("namespace", "a", "b", F.col("hits").alias("n"), F.col("last").alias("new_last"))
    both = heat.join(n, ["namespace", "a", "b"], "full_outer")
    w, k = F.coalesce("weight", F.lit(0.0)), F.coalesce("n", F.lit(0))
    return both.select(
        "namespace", "a", "b", F.least(F.lit(1.0), 1 - (1 - w) * F.pow(F.lit(1 - rate), k)).alias("weight"),
        (F.coalesce("hits", F.lit(0)) + k).cast("int").alias("hits"), F.coalesce("new_last", "last").alias("last"),
    )


def decay(heat: DataFrame, rounds: int = 1, rate: float = DECAY_RATE, floor: float = DECAY_FLOOR) -> DataFrame:
    return heat.withColumn("weight", F.greatest(F.lit(floor), F.col("weight") * F.pow(F.lit(rate), F.lit(rounds))))


def promoted(heat: DataFrame, threshold: float = PROMOTION) -> DataFrame:
    """Pairs hot enough for an 'associated' edge."""
    return heat.where(F.col("weight") >= threshold)


def promotion_edges(heat: DataFrame, threshold: float = PROMOTION) -> DataFrame:
    return promoted(heat, threshold).select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit("associated").alias("relation"), F.lit("behavioral").alias("class"))


def touching(heat: DataFrame, ids: DataFrame) -> DataFrame:
    """Pairs with either end among the ids; two semi joins, as an OR would be a nested loop."""
    left = heat.join(ids.select(F.col("id").alias("a")).distinct(), "a", "left_semi")
    right = heat.join(ids.select(F.col("id").alias("b")).distinct(), "b", "left_semi")
    return left.select(heat.columns).unionAll(right.select(heat.columns)).distinct()


def visible(heat: DataFrame, ids: DataFrame, least: float = VISIBLE) -> DataFrame:
    return touching(heat.where(F.col("weight") >= least), ids)


def weight_of(heat: DataFrame, x: str, y: str) -> float:
    row = heat.where((F.col("a") == min(x, y)) & (F.col("b") == max(x, y))).agg(F.coalesce(F.max("weight"), F.lit(0.0))).first()
    return row[0]


def with_heat(edges: DataFrame, heat: DataFrame) -> DataFrame:
    """Edges with the weight of their unordered pair, 0 without one."""
    h = heat.select("a", "b", F.col("weight").alias("heat"))
    keyed = edges.withColumn("a", F.least("src", "dst")).withColumn("b", F.greatest("src", "dst"))
    return keyed.join(h, ["a", "b"], "left").drop("a", "b").withColumn("heat", F.coalesce("heat", F.lit(0.0)))


def overlay(heat: DataFrame) -> DataFrame:
    """(id, heat): sums of pair weights per node over the largest sum (at least 0.001)."""
    ends = heat.select(F.explode(F.array("a", "b")).alias("id"), "weight").groupBy("id").agg(F.sum("weight").alias("heat"))
    top = ends.agg(F.greatest(F.max("heat"), F.lit(0.001)).alias("top"))
    return ends.crossJoin(F.broadcast(top)).select("id", (F.col("heat") / F.col("top")).alias("heat"))
