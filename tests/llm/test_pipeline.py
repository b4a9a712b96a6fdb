import collections
import re

import corpus_pipeline
from graphloom.llm import language_crf, queries, toxicity_gbt
from graphloom.llm.language_crf import UNKNOWN
from tests.llm.test_dedup_search_pack import grouped, lines_by_brute_force, shingles

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SF)
        path = f"{spark.sparkContext.getConf().get('spark.checkpoint.dir')}/pipeline-{name}"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = (before, docs)
        if name != "packing":
            assert docs.columns == before.columns
    ids = lambda df: [r.doc_id for r in df.select("doc_id").collect()]
    before, after = seen["lines"]
    assert sorted(ids(before)) == sorted(ids(after)) and all(r.n_chars == len(r.text or "") for r in after.collect())
    before, after = seen["near_duplicates"]
    kept = set(ids(after))
    texts = collections.defaultdict(set)
    for r in before.collect():
        if r.text.strip():
            texts[r.text].add(r.doc_id)
    assert all(len(g & kept) <= 1 for g in texts.values())  # of equal texts at most one stays
    packed = {r.doc_id for r in seen["packing"][1].collect()}
    assert packed == {r.doc_id for r in seen["near_duplicates"][1].collect() if r.text}
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES][0] == "toxicity" and UNKNOWN == "und"


def apart(spark, name, docs, sf=SF):
    """One stage, written and read."""
    path = f"{spark.sparkContext.getConf().get('spark.checkpoint.dir')}/apart-{name}"
    dict(corpus_pipeline.STAGES)[name](spark, docs, sf).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def test_stages_equal_brute_force(spark):
    """Every stage on all documents: models applied to single texts, templates and shingles compared with all others."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    kept = {name: {r.doc_id: r for r in apart(spark, name, docs).collect()} for name in ("toxicity", "language", "lines", "near_duplicates")}
    toxic = toxicity_gbt.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert set(kept["toxicity"]) == {i for i, t in text.items() if toxic.score([t])[0] < toxicity_gbt.CUT}
    crf = language_crf.fit(docs)
    said = {i: tuple(x[0] for x in crf.predict([t])) for i, t in text.items()}
    near = {i for i, (_, share) in said.items() if abs(share - corpus_pipeline.LEAST_LANGUAGE_SHARE) < 1e-3}  # single precision
    want = {i for i, (lang, share) in said.items() if lang != UNKNOWN and share >= corpus_pipeline.LEAST_LANGUAGE_SHARE}
    assert set(kept["language"]) - near == want - near
    plain = {i: re.sub(r"[\t\x0b\f\r ]+", " ", t) for i, t in text.items()}
    lines = lines_by_brute_force([(i, "\n".join(x.strip(" ") for x in t.split("\n"))) for i, t in plain.items()])
    got = {i: "\n".join(x.strip(" ") for x in re.sub(r"[\t\x0b\f\r ]+", " ", r.text).split("\n")) for i, r in kept["lines"].items()}
    assert got == lines and sum(map(len, got.values())) < sum(map(len, plain.values()))
    sets = {i: shingles(t) for i, t in text.items()}
    alike = [(a, b) for a in text for b in text if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert set(kept["near_duplicates"]) == {i for i, c in grouped(alike, text).items() if i == c} and alike


def test_chain_of_odd_rows(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows and clashing columns go through all stages."""
    words = "the of and a in to is was he for it with as his on be at by i".split()
    say = lambda n, k: " ".join(words[(i * k + i * i) % len(words)] for i in range(n))
    rows = [(1, say(60, 1), "en", "s", 0), (1, say(60, 1), "en", "s", 0), (2, None, None, None, None), (3, "", "en", "s", 0), (None, say(40, 3), "en", "s", 1), (None, None, None, None, None),
            (4, say(30_000, 5), "en", "s", 1), (5, say(60, 1), "en", "t", 0), (6, "12 ² !", "en", "s", 1)]
    docs = spark.createDataFrame([(*r, "clash", 1, 2, "x") for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, h int, leaf int, toxicity string")
    spark.createDataFrame([(1, 0, 0), (4, 1, 0), (None, 0, 1), (5, None, None)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    counts = {}
    for name, _ in corpus_pipeline.STAGES:
        after = apart(spark, name, docs, str(tmp_path))
        if name != "packing":
            assert after.columns == docs.columns
        docs, counts[name] = after, after.count()
    assert counts["toxicity"] == len(rows) and counts["language"] == 5  # those without a letter go
    assert counts["lines"] == 5 and counts["near_duplicates"] >= 4 and counts["packing"] >= 3
    none = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for name, _ in corpus_pipeline.STAGES:
        none = apart(spark, name, none, str(tmp_path))
        assert none.count() == 0


def test_registered():
    names = queries.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op")) == list(range(1, 11)) and "pipeline" in names


def test_against_sql(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        rel = con.execute(sql)
        columns = [d[0] for d in rel.description]
        want = sorted(map(str, rel.fetchall()))
        got = queries.queries()[name](spark, SF).select(*columns).collect()
        assert sorted(str(tuple(r)) for r in got) == want
