"""Queries over the synthetic tables, one for each operator of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHARD_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.warc_index import capture_index

    out = capture_index(table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm import language_crf
    from graphloom.llm.sampling import held_out

    docs = table(spark, sf_dir, "documents")
    tagged = language_crf.identify(docs.select("doc_id", "text"), language_crf.fit(docs), score="score")
    return tagged.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op3_template_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.template_dedup import drop_recurring

    return drop_recurring(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_prob_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.prob_minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_variable_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.variable_packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op6_toxicity_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm import toxicity_gbt
    from graphloom.llm.sampling import held_out

    docs = table(spark, sf_dir, "documents")
    scored = toxicity_gbt.score(docs.select("doc_id", "text"), toxicity_gbt.fit(docs, table(spark, sf_dir, "labels")), out="score")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", toxicity_gbt.is_toxic(F.col("score")).alias("predicted"))


def op7_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.prefix_forest import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_lattice_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.lattice_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.extendible_sharding import shard

    docs = table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("bigint").alias("n"))
    return shard(docs, "doc_id", F.col("n"), SHARD_BYTES).drop("n")


def op10_segment_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from graphloom.llm.segment_bpe import round_trip

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen codes a vector, from codebooks refined over all vectors."""
    from graphloom.llm.vector_codes import compress

    return compress(table(spark, sf_dir, "embeddings"))


def op12_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text under the attention model and under the counts of words, both from four fifths of the documents."""
    import public_tokenizers

    from graphloom.llm import attention_lm

    docs = table(spark, sf_dir, "documents")
    train = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(5)) != 1
    return attention_lm.score(docs, attention_lm.fit(docs, train, public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), train)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector among all, a seventh of the labels being moved by one."""
    from graphloom.llm.hard_negatives import mine

    label = F.col("label").cast("bigint")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, moved)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)} | {"pipeline": corpus_pipeline.run}


def _codes_sql() -> str:
    """Two rounds of 16 codebooks of 64 entries, from long tables of components."""
    steps = ["""
            x AS (SELECT vec_id, label, (i - 1) // (n // 16) AS part, (i - 1) % (n // 16) AS pos, floor(256 * c::DOUBLE)::BIGINT AS c
                  FROM (SELECT vec_id, label, len(embedding) AS n, unnest(embedding) AS c, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings
                        WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0)),
            b0 AS (SELECT part, dense_rank() OVER (ORDER BY vec_id) - 1 AS entry, pos, c FROM x WHERE vec_id IN (SELECT DISTINCT vec_id FROM x ORDER BY vec_id LIMIT 64))"""]
    for r in range(3):
        steps.append(f"""
            d{r} AS (SELECT vec_id, part, entry, sum((x.c - b.c) * (x.c - b.c))::BIGINT AS far FROM x JOIN b{r} b USING (part, pos) GROUP BY ALL),
            a{r} AS (SELECT vec_id, part, arg_min(entry, far * 256 + entry) AS entry, min(far) AS far FROM d{r} GROUP BY ALL)""")
        if r < 2:
            steps.append(f"""
            m{r} AS (SELECT part, entry, pos, sum(c)::BIGINT AS s, count(*) AS n FROM x JOIN a{r} USING (vec_id, part) GROUP BY ALL),
            b{r + 1} AS (SELECT part, entry, pos, coalesce((s - ((s % n) + n) % n) // n, c)::BIGINT AS c FROM b{r} LEFT JOIN m{r} USING (part, entry, pos))""")
    return "WITH" + ",".join(steps) + """,
            books AS (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM b2),
            coded AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(far)::BIGINT AS error
                      FROM a2 JOIN (SELECT DISTINCT vec_id, label FROM x) USING (vec_id) GROUP BY vec_id)
            SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded, books"""


def oracle_sql() -> dict[str, str]:
    return {
        "op11_vector_codes": _codes_sql(),
        "op13_hard_negatives": """
            WITH x AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
                              list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS v
                       FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
                            AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
            s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
                  FROM x a, x b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
            p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
                  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
            SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INT AS rank,
                   id AS negative_id, positive_score, score AS negative_score
            FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
            QUALIFY rank <= 5""",
        "op8_extendible_sharding": f"""
            WITH d AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS shard_bytes,
                              ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
            p AS (SELECT depth, h >> (60 - depth) AS q, sum(shard_bytes) AS n, min(h) AS lo, max(h) AS hi
                  FROM d, (SELECT unnest(range(0, 61))::INT AS depth) GROUP BY ALL),
            s AS (SELECT d.doc_id, d.shard_bytes, min(p.depth) AS shard_depth, d.h
                  FROM d, p WHERE d.h >> (60 - p.depth) = p.q AND (p.n <= {SHARD_BYTES} OR p.lo = p.hi)
                  GROUP BY d.doc_id, d.shard_bytes, d.h)
            SELECT doc_id, shard_bytes, shard_depth, h >> (60 - shard_depth) AS shard_prefix, 0::BIGINT AS shard_page FROM s""",
        "op1_warc_index": """
            WITH p AS (SELECT page_id, coalesce(html, '') AS html, url FROM pages),
            q AS (SELECT *, sha256(html) AS payload_digest, strlen(html)::BIGINT AS payload_bytes FROM p),
            r AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM q)
            SELECT page_id, payload_bytes, payload_digest,
                   CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
                   CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to FROM r""",
    }
