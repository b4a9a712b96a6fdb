"""From raw documents to packed training sequences, in five stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import language_crf, prob_minhash, template_dedup, toxicity_gbt, variable_packing
from graphloom.storage import broadcast_if_small, materialize, scratch_path, scratch_scope

LEAST_LANGUAGE_SHARE = 0.35  # mixed texts stay; only those without a leading language go


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the trees do not call toxic."""
    model = toxicity_gbt.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity_gbt.score(docs, model, out="_toxicity")
    return scored.where(toxicity_gbt.is_toxic(F.col("_toxicity")) == 0).select(*docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters in which one language leads."""
    tagged = language_crf.identify(docs, language_crf.fit(docs), label="_lang", score="_share")
    good = (F.col("_lang") != language_crf.UNKNOWN) & (F.col("_share") >= LEAST_LANGUAGE_SHARE)
    return tagged.where(good).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines whose template recurs in an earlier one."""
    out = template_dedup.drop_recurring(docs)  # adds lines_dropped
    return out.select(*[F.length("text").cast("bigint").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class. Rows that repeat an id are one document, and rows without id
    are none: they stay."""
    classes = prob_minhash.near_duplicates(docs)
    gone = materialize(classes.where("doc_id <> class_id").select("doc_id").distinct(), "pipeline-gone")
    return docs.join(broadcast_if_small(gone, 1_000_000), "doc_id", "left_anti").select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences."""
    return variable_packing.pack(docs)


STAGES = [
    ("toxicity", toxicity),
    ("language", language),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("packing", packing),
]

#: The classifiers and the packing have no SQL form; tests/llm compares every stage with brute force, or
#: with its model applied to single texts.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents; each one's result is written and read again. The tables that a
    stage made on the way are deleted when it is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        with scratch_scope(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
