import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from graphloom.llm import language_crf, sampling, toxicity_gbt
from graphloom.llm.language_crf import Crf
from graphloom.llm.sampling import hashed_sample, in_training
from graphloom.llm.toxicity_gbt import Trees, isotonic

SF = "/root/testdata/sf0.01"


def test_folds_and_sample(spark):
    df = spark.range(500).withColumnRenamed("id", "doc_id")
    got = {r.doc_id for r in df.where(in_training(F.col("doc_id"))).collect()}
    assert got == {i for i in range(500) if zlib.crc32(str(i).encode()) % 4 != 2}
    a, b = hashed_sample(df, "doc_id", 50), hashed_sample(df.repartition(7), "doc_id", 50)
    assert a.count() == 50 and {r.doc_id for r in a.collect()} == {r.doc_id for r in b.collect()}
    assert hashed_sample(df, "doc_id", 900).count() == 500


def test_forward_backward_is_exact():
    rng = np.random.default_rng(0)
    crf = Crf(["a", "b", "c"], {})
    crf.step, crf.start = rng.normal(size=(3, 3)), rng.normal(size=3)
    lengths = np.array([4, 3, 1])
    emit = rng.normal(size=(8, 3))
    got, _, _ = crf.marginals(emit, lengths)
    at = 0
    for n in lengths:
        want, total = np.zeros((n, 3)), 0.0
        for path in np.ndindex(*[3] * n):
            w = np.exp(crf.start[path[0]] + sum(emit[at + i, y] for i, y in enumerate(path)) + sum(crf.step[p, q] for p, q in zip(path, path[1:])))
            total += w
            for i, y in enumerate(path):
                want[i, y] += w
        assert np.allclose(got[at : at + n], want / total)
        at += n


def test_crf_labels_code_switched_text():
    rng = random.Random(1)
    words = {"xx": ["baba", "balo", "lobab"], "yy": ["tiki", "kitik", "tikki"]}
    texts, langs = [], []
    for i in range(60):
        lang = ("xx", "yy")[i % 2]
        texts.append(" ".join(rng.choice(words[lang]) for _ in range(30)))
        langs.append(lang)
    model = language_crf.fit_texts(texts, langs)
    labels, scores = model.predict(["baba lobaba", "kiti tik", "baba balo lobab balo tiki", None, "", "12 -- ²", "BABA balo"])
    assert labels == ["xx", "yy", "xx", "und", "und", "und", "xx"] and scores[3:6] == [0.0] * 3 and 0.6 < scores[2] < 1
    assert np.trace(model.step) > model.step[0, 1] + model.step[1, 0]  # staying is likelier than switching
    assert language_crf.fit_texts([], []).predict(["x"]) == (["und"], [0.0])


def test_words_have_letters_only():
    assert language_crf.words_of("x² km² ½kg a²b 12 -- ² Ab_c") == ["x", "km", "kg", "ab", "ab", "c"]
    assert language_crf.words_of("² ½ 12") == language_crf.words_of("") == language_crf.words_of(None) == []


def test_spans_of_languages(spark):
    rng = random.Random(1)
    words = {"xx": ["baba", "balo", "lobab"], "yy": ["tiki", "kitik", "tikki"]}
    say = lambda lang, n: " ".join(rng.choice(words[lang]) for _ in range(n))
    model = language_crf.fit_texts([say(("xx", "yy")[i % 2], 30) for i in range(60)], [("xx", "yy")[i % 2] for i in range(60)])
    a, b = say("xx", 9), say("yy", 12)
    text = f"{a}, {b}!"
    rows = [(1, text, "clash"), (2, None, ""), (3, "12 ²", ""), (4, "baba", "")]
    out = {r.doc_id: r.lang_spans for r in language_crf.label_spans(spark.createDataFrame(rows, "doc_id bigint, text string, lang_spans string"), model).collect()}
    assert [(text[s.start : s.end], s.lang) for s in out[1]] == [(a, "xx"), (b, "yy")] and all(0.8 < s.score <= 1 for s in out[1])
    assert out[2] == out[3] == [] and [(s.start, s.end, s.lang) for s in out[4]] == [(0, 4, "xx")]
    # the share of words by their posteriors is the document's score
    share = model.marginals(model.type_emissions(language_crf.words_of(text)), np.array([21]))[0].mean(0)
    labels, scores = model.predict([text])
    assert labels == ["yy"] and abs(scores[0] - share[1]) < 1e-6


def test_bounded_samples(spark, monkeypatch):
    rows = [(1, "b" * 50, "z")] * 20_000 + [(1, "a" * 50, "z")] + [(i, "w" * 400, "q") for i in range(2, 60)] + [(70, "x" * 5000, "q"), (71, None, "q")]
    labelled = spark.createDataFrame(rows, "doc_id bigint, t string, y string")
    monkeypatch.setattr(sampling, "SAMPLE_TEXT", 500)
    keys = labelled.select("doc_id").distinct()
    whole, labels = sampling.fit_on_sample(labelled, keys, "doc_id", lambda texts, ys: (texts, ys))
    assert len(whole) == 60 and whole[0] == "a" * 50 and whole[58] == "w" * 400 and whole[59] is None and labels[0] == "z"  # a long text goes whole
    monkeypatch.setattr(sampling, "SAMPLE_BYTES", 4000)
    some = sampling.fit_on_sample(labelled, keys, "doc_id", lambda texts, ys: texts)
    assert 5 <= len(some) <= 14 and sum(len(t or "") for t in some) <= 4000
    assert some == sampling.fit_on_sample(labelled.repartition(5), keys, "doc_id", lambda texts, ys: texts)
    assert sampling.fit_on_sample(labelled.limit(0), keys, "doc_id", lambda texts, ys: texts) == []


def test_conflicting_labels(spark):
    """An id is toxic if one of its labels is, in whatever order they come."""
    docs = spark.createDataFrame([(i, "plain words here" + (" grum zork" if i % 4 == 0 else "")) for i in range(200)], "doc_id bigint, text string")
    labels = [(i, int(i % 4 == 0)) for i in range(200)] + [(i, 0) for i in range(200)] + [(None, 1), (3, None)]
    scores = []
    for rows in (labels, labels[::-1]):
        model = toxicity_gbt.fit(docs, spark.createDataFrame(rows, "doc_id bigint, toxic int").repartition(3))
        scores.append([model.score(["plain words here grum zork", "plain words here"]).tolist()])
    assert scores[0] == scores[1] and scores[0][0][0] > 0.9 > 0.1 > scores[0][0][1]


def test_language_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(10**6, None, None), (10**6 + 1, "", "en"), (10**6 + 2, "?! 99", "de"), (10**6 + 3, "le la les " * 40_000, None)], "doc_id bigint, text string, lang string")
    model = language_crf.fit(docs, rows=200)
    both = docs.select("doc_id", "text", "lang").unionByName(extra).withColumn("label", F.lit("clash"))
    out = {r.doc_id: r for r in language_crf.identify(both, model, score="score").collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    assert [out[10**6 + i].lang_pred for i in range(4)] == ["und", "und", "und", "fr"] and len(out) == len(truth) + 4
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(out[i].lang_pred == truth[i] for i in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in out.values())
    assert language_crf.identify(docs.limit(0), model).count() == 0


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((2000, 3))
    y = ((x[:, 0] > 0.5) & (x[:, 1] > 0.3)).astype(float)
    raw = Trees().fit(x, y).raw(x)
    assert ((raw > 0) == y).mean() > 0.98


def test_first_split_by_brute_force():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 12, (300, 4)).astype(float)
    y = (x[:, 2] + rng.normal(size=300) * 2 > 6).astype(float)
    tree = Trees(rounds=1, depth=1, rate=1.0)
    tree.fit(x, y)
    p = y.mean()
    g, h = p - y, np.full(300, p * (1 - p))
    worth = lambda rows: g[rows].sum() ** 2 / (h[rows].sum() + tree.ridge)
    options = [(worth(x[:, f] <= v) + worth(x[:, f] > v), f, v) for f in range(4) for v in range(11) if h[x[:, f] <= v].sum() >= 1 and h[x[:, f] > v].sum() >= 1]
    best = max(options)
    (split_f, split_v, leaf) = tree.trees[0]
    f, v = split_f[0][0], split_v[0][0]
    right = x[:, f] > v
    assert f == best[1] == 2 and (right == (x[:, 2] > best[2])).all()
    want = [-g[m].sum() / (h[m].sum() + tree.ridge) for m in (~right, right)]
    assert np.allclose(leaf, want)


def test_isotonic_is_the_least_squares_fit():
    rng = np.random.default_rng(2)
    raw, y = np.arange(12.0), rng.integers(0, 2, 12).astype(float)
    knots, rates = isotonic(raw, y)
    assert (np.diff(rates) > 0).all() or len(rates) == 1
    # min-max formula of isotonic regression
    want = [max(min(y[a : b + 1].mean() for b in range(i, 12)) for a in range(i + 1)) for i in range(12)]
    assert set(np.round(rates, 9)) == set(np.round(want, 9))


def test_toxicity_features_and_model():
    lexicon = {"grum": 3.0, "flick*": 2.0}
    f = toxicity_gbt.features("You grum! FLICKERING id1ot", lexicon)
    assert len(f) == toxicity_gbt.FEATURES and f[4] > 0 and f[9] > 0 and f[15] > 0
    assert toxicity_gbt.features(None, lexicon) == toxicity_gbt.features("", lexicon) == [0.0] * toxicity_gbt.FEATURES
    rng = random.Random(3)
    plain = lambda: " ".join(rng.choice(["ala", "bo", "cim", "dar"]) for _ in range(40))
    texts = [plain() + (" grum zork" if i % 5 == 0 else "") for i in range(400)]
    model = toxicity_gbt.fit_texts(texts, np.array([i % 5 == 0 for i in range(400)]))
    scores = model.score([plain() + " zork grum", plain(), None, ""])
    assert scores[0] > 0.8 and scores[1] < 0.1 and 0 <= scores[2] == scores[3] <= 1 and {"grum", "zork"} <= set(model.lexicon)
    assert toxicity_gbt.fit_texts([], np.array([])).score(["x"])[0] <= 1


def test_toxicity_query(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity_gbt.fit(docs, labels)
    extra = spark.createDataFrame([(10**6, None), (10**6 + 1, ""), (10**6 + 2, "word " * 60_000)], "doc_id bigint, text string")
    out = {r.doc_id: r.score for r in toxicity_gbt.score(docs.select("doc_id", "text").unionByName(extra).withColumn("score", F.lit("clash")).drop("score"), model, out="score").collect()}
    assert len(out) == docs.count() + 3 and all(0 <= s <= 1 for s in out.values())
    held = [r for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2 and r.doc_id in out]
    toxic, clean = ([out[r.doc_id] for r in held if r.toxic == t] for t in (1, 0))
    assert np.mean([t > c for t in toxic for c in clean]) > 0.75 and np.mean([c < 0.3 for c in clean]) > 0.97
    nulls = labels.select("doc_id", F.lit(None).cast("int").alias("toxic"))
    assert toxicity_gbt.score(docs.limit(3), toxicity_gbt.fit(docs, nulls)).count() == 3
