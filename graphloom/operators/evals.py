"""Aggregates over evaluation runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.storage import materialize, spread

METRICS = ("quality", "turns", "tokens", "cost_usd", "duration_ms")


def condition_averages(results: DataFrame, metrics=METRICS) -> DataFrame:
    """(condition, metric, value) in long form."""
    wide = results.groupBy("condition").agg(*[F.avg(m).alias(m) for m in metrics])
    return wide.unpivot("condition", list(metrics), "metric", "value")


def judge_average(correctness: str, completeness: str, specificity: str):
    return (F.col(correctness) + F.col(completeness) + F.col(specificity)) / 3


INLINE_KEYS = 10_000  # hashes of items that travel with the plan


def hits(items: DataFrame, texts: DataFrame, words: int = 8) -> DataFrame:
    """(item_id, doc_id): documents that contain the whole text of an item.

    The first and last word of an item may be parts of longer words of a document, but those between are
    whole words there. So items of three words and more meet documents on the hash of their first ``words``
    inner words; shorter ones on their characters. Then the containment is checked. Places are looked at
    inside each document, and only those with the hash of some item leave it. Empty and null items are left
    out; null texts contain nothing."""
    items = items.select("item_id", F.col("text").alias("needle")).where("needle is not null")
    split = F.split("needle", r"\s+")
    inner = F.slice(split, 2, F.greatest(F.size(split) - 2, F.lit(0)))
    run = F.slice(inner, 1, words)
    head = items.withColumn("w", F.size(run)).withColumn("n", F.length("needle"))
    head = head.withColumn("k", F.when(F.col("w") > 0, F.xxhash64(F.array_join(run, " "))).otherwise(F.xxhash64("needle")))
    head = materialize(head.where("n > 0"), "items")
    kinds = [(r["w"], r["n"]) for r in head.select("w", F.when(F.col("w") == 0, F.col("n")).alias("n")).distinct().collect()]  # a few lengths
    docs = texts.select("doc_id", F.col("text").alias("hay")).where("hay is not null")
    if not kinds:
        return items.join(docs, F.col("needle") == F.col("hay")).select("item_id", "doc_id").limit(0)
    keys = [r["k"] for r in head.select("k").distinct().limit(INLINE_KEYS + 1).collect()]
    wanted = (lambda k: k.isin(*keys)) if len(keys) <= INLINE_KEYS else (lambda k: k.isNotNull())
    tokens = spread(docs).withColumn("t", F.split("hay", r"\s+"))
    of_words = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("t") - n + 1)), lambda i: F.xxhash64(F.array_join(F.slice("t", i, n), " ")))
    of_chars = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("hay") - n + 1)), lambda i: F.xxhash64(F.substr("hay", i, F.lit(n))))
    places = [F.filter(of_words(w) if w else of_chars(n), wanted) for w, n in kinds]
    found = tokens.select("doc_id", "hay", F.explode(F.array_distinct(F.flatten(F.array(*places)))).alias("k")).join(head.select("item_id", "needle", "k"), "k")
    return found.where(F.col("hay").contains(F.col("needle"))).select("item_id", "doc_id").distinct()


def repo_totals(runs: DataFrame) -> DataFrame:
    """(repo, n, hit_rate, ratio): ratio of sums, not mean of ratios."""
    return runs.groupBy("repo").agg(
        F.count("*").alias("n"), (F.sum(F.col("hit").cast("int")) / F.count("*")).alias("hit_rate"), (F.sum("baseline_tokens") / F.sum("tokens")).alias("ratio")
    )


def targets(runs: DataFrame, least_ratio: float = 3.0, least_saving: float = 0.5) -> DataFrame:
    """One row: whether calls fell by the factor and tokens by the share."""
    sums = runs.agg(F.sum("baseline_calls").alias("a"), F.sum("calls").alias("b"), F.sum("baseline_tokens").alias("c"), F.sum("tokens").alias("d"))
    return sums.select((F.col("a") / F.col("b") >= least_ratio).alias("calls_ok"), (1 - F.col("d") / F.col("c") >= least_saving).alias("tokens_ok"))


def markdown(summary: DataFrame) -> str:
    """A table of the long-form averages (one line per condition and metric)."""
    rows = summary.orderBy("condition", "metric").collect()
    return "\n".join(["| condition | metric | value |", "|-|-|-|", *[f"| {r['condition']} | {r['metric']} | {r['value']:.4f} |" for r in rows]])


def sentences(text, cap: int = 300):
    """The first sentence, at most ``cap`` characters: a summary for seeded files."""
    return F.substring(F.trim(F.regexp_extract(text, r"(?s)^\s*(.+?[.!?])(?:\s|$)", 1)), 1, cap)


def load(spark, path: str, schema: str) -> DataFrame:
    """Questions or results from JSON (an array or a line each)."""
    return spark.read.schema(schema).option("multiLine", not path.endswith("l")).json(path)


def pending(questions: DataFrame, done: DataFrame) -> DataFrame:
    """Questions without a result in the checkpoint."""
    return questions.join(done.select("id"), "id", "left_anti")


def json_lines(summary: DataFrame) -> DataFrame:
    """(line): the averages, a JSON object each."""
    return summary.select(F.to_json(F.struct(*summary.columns)).alias("line"))


def as_json(summary: DataFrame) -> list[str]:
    """The averages, a JSON line each."""
    return [r["line"] for r in json_lines(summary.orderBy("condition", "metric")).collect()]
