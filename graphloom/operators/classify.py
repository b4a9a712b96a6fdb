"""Write classification, and plans for moving nodes between graphs."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import content_hash, hierarchical
from graphloom.operators.graph import first_by
from graphloom.operators.retrieval import find_similar
from graphloom.schema import is_active

CANDIDATE, SUPERSEDE, UPDATE, NOOP = 0.60, 0.65, 0.80, 0.95
CANDIDATES = 5
PROMPT_CANDIDATES, CONTEXT_BYTES = 3, 500  # what a model reads


def by_threshold(hits: DataFrame, nodes: DataFrame, incoming: DataFrame) -> DataFrame:
    """(query_id, action, target, score) from similarity hits: the best candidate that is neither
    the node itself nor in its hierarchy decides: noop from 0.95, update from 0.80, supersede from
    0.65, else add. Without a candidate that exists, add."""
    near = hits.where((F.col("score") >= CANDIDATE) & (F.col("node_id") != F.col("query_id")))
    real = near.join(nodes.select(F.col("id").alias("node_id")), "node_id", "left_semi").select("query_id").distinct()
    best = near.join(real, "query_id", "left_semi").where(~hierarchical("query_id", "node_id"))
    best = first_by(best, ["query_id"], F.desc("score"), F.col("node_id"))
    out = incoming.select("query_id").distinct().join(best.select("query_id", "node_id", "score"), "query_id", "left")
    s = F.coalesce("score", F.lit(0.0))
    action = F.when(s >= NOOP, "noop").when(s >= UPDATE, "update").when(s >= SUPERSEDE, "supersede").otherwise("add")
    return out.select("query_id", action.alias("action"), F.when(action != "add", F.col("node_id")).alias("target"), s.alias("score"))


def prompt(node: dict, candidates: list[dict]) -> str:
    """The question to a language model: the incoming node, at most three candidates, and the form of the answer."""
    context = (node.get("context") or "").encode()[:CONTEXT_BYTES].decode("utf-8", "replace")
    lines = ["Incoming node:", f"  ID: {node.get('id') or ''}", f"  Type: {node.get('type') or ''}", f"  Summary: {node.get('summary') or ''}", f"  Context: {context}", ""]
    lines.append("Similar existing nodes:" if candidates else "No similar existing nodes found.")
    for k, c in enumerate(candidates[:PROMPT_CANDIDATES], 1):
        lines += [f"  [{k}] ID: {c['node_id']}", f"      Summary: {c.get('summary') or ''}", f"      Similarity score: {c['score']:.4f}"]
    return "\n".join([*lines, "", "Classify the operation and respond with only valid JSON."])


def parse_reply(text: str) -> dict:
    """{action, target, confidence, reasoning} of a model's answer: the JSON object between the first and last
    brace, whatever fences or words are around it. Anything else is an add with confidence 0.1."""
    fallback = {"action": "add", "target": None, "confidence": 0.1, "reasoning": "fallback: could not parse LLM response"}
    start, end = text.find("{"), text.rfind("}")
    try:
        got = json.loads(text[max(start, 0) : end + 1])
        action = str(got.get("action") or "").lower()
        if action not in ("add", "update", "supersede", "noop"):
            return fallback
        return {"action": action, "target": got.get("target_node_id") or None, "confidence": float(got.get("confidence") or 0.0), "reasoning": str(got.get("reasoning") or "")}
    except (ValueError, AttributeError, TypeError):
        return fallback


def model_judge(ask: Callable[[str], str]) -> Callable[[dict], dict]:
    """A judge for ``classify`` from a function that sends a prompt to a language model."""
    return lambda case: parse_reply(ask(prompt({"id": case["id"], **(case.get("node") or {})}, json.loads(case["candidates"]))))


def classify(incoming: DataFrame, nodes: DataFrame, embeddings: DataFrame, model: str | None = None, judge: Callable[[dict], dict] | None = None) -> DataFrame:
    """Classify nodes to be written (query_id, embedding[, summary]); vectors that are missing mean add.

    ``judge`` may decide instead (``model_judge`` makes one from a language model): it gets {id, node, candidates} with at
    most five candidates as JSON and answers {action, target, confidence};
    where it fails or says something else, the node is added with 0.1."""
    usable = incoming.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0))
    hits = find_similar(embeddings, usable.select("query_id", "embedding"), CANDIDATE, model)
    if judge is None:
        return by_threshold(hits, nodes, incoming)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "node_id")
    top = hits.where("node_id <> query_id").join(nodes.select(F.col("id").alias("node_id"), "summary"), "node_id")
    top = top.withColumn("r", F.row_number().over(w)).where(F.col("r") <= CANDIDATES)
    told = [c for c in ("type", "summary", "context") if c in incoming.columns]
    node = F.to_json(F.struct(*told)) if told else F.lit("{}")
    asked = incoming.groupBy("query_id").agg(F.min(node).alias("node")).join(
        top.groupBy("query_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("r", "node_id", "summary", "score")))).alias("candidates")), "query_id", "left"
    )

    def decide(batches):
        for batch in batches:
            rows = []
            for qid, node, cand in zip(batch["query_id"], batch["node"], batch["candidates"]):
                answer = {"action": "add", "target": None, "confidence": 1.0}
                if cand:
                    try:
                        got = judge({"id": qid, "candidates": cand, "node": json.loads(node)})
                        answer = got if got.get("action") in ("add", "update", "supersede", "noop") else {"action": "add", "confidence": 0.1}
                    except Exception:  # noqa: BLE001  a failing provider must not lose the write
                        answer = {"action": "add", "confidence": 0.1}
                rows.append((qid, answer["action"], answer.get("target"), float(answer.get("confidence", 0.1))))
            yield pd.DataFrame(rows, columns=["query_id", "action", "target", "score"])

    return asked.mapInPandas(decide, "query_id string, action string, target string, score double")


def contribution(source: DataFrame, target: DataFrame, classified: DataFrame | None = None) -> DataFrame:
    """(id, action, target_id): the plan for bringing ``source`` nodes into ``target``.

    An id that is there, active and of equal content is a noop; another one with the id an
    update. The rest goes by ``classified`` (query_id, action, target), or is added."""
    digest = content_hash("summary", "context", "edges")
    mine = source.where(is_active()).select("id", digest.alias("h"))
    theirs = target.select("id", digest.alias("h2"), is_active().alias("live"))
    both = mine.join(theirs, "id", "left")
    same = F.col("h2").isNotNull()
    if classified is None:
        return both.select("id", F.when(same & F.col("live") & (F.col("h") == F.col("h2")), "noop").when(same, "update").otherwise("add").alias("action"), F.col("id").alias("target_id"))
    said = classified.select(F.col("query_id").alias("id"), F.col("action").alias("said"), F.col("target").alias("said_target"))
    both = both.join(said, "id", "left")
    action = F.when(same & F.col("live") & (F.col("h") == F.col("h2")), "noop").when(same, "update").otherwise(F.coalesce("said", F.lit("add")))
    return both.select("id", action.alias("action"), F.when(same, F.col("id")).otherwise(F.coalesce("said_target", "id")).alias("target_id"))


def apply_contribution(source: DataFrame, target: DataFrame, plan: DataFrame, now: str) -> DataFrame:
    """The target after the plan: updates keep its valid_from (and id), a superseded node points to
    its replacement."""
    act = plan.where("action <> 'noop'")
    old = target.select(F.col("id").alias("target_id"), F.col("valid_from").alias("old_from"))
    new = source.join(act, "id").join(old, "target_id", "left")
    kept = F.col("action") == "update"
    new = new.withColumn("id", F.when(kept, F.col("target_id")).otherwise(F.col("id"))).withColumn(
        "valid_from", F.when(kept, F.coalesce("old_from", F.lit(now))).otherwise(F.lit(now))
    ).withColumn("status", F.lit("active"))
    gone = act.where("action = 'supersede'").select(F.col("target_id").alias("id"), F.col("id").alias("by"))
    rest = target.join(new.select("id"), "id", "left_anti").join(gone, "id", "left")
    hit = F.col("by").isNotNull()
    rest = rest.withColumn("status", F.when(hit, "superseded").otherwise(F.col("status"))).withColumn(
        "superseded_by", F.when(hit, F.col("by")).otherwise(F.col("superseded_by"))
    ).withColumn("valid_until", F.when(hit, F.lit(now)).otherwise(F.col("valid_until")))
    return rest.select(target.columns).unionByName(new.select(target.columns))


def action_counts(actions: DataFrame) -> DataFrame:
    """One row: added, updated, superseded, noop, skipped, errors, total."""
    n = lambda *names: F.count_if(F.lower("action").isin(*names))
    return actions.agg(
        n("add", "added").alias("added"), n("update", "updated").alias("updated"), n("supersede", "superseded").alias("superseded"), n("noop").alias("noop"),
        n("skip", "skipped").alias("skipped"), n("error", "errors").alias("errors"), F.count("*").alias("total"),
    )


