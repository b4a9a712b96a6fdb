import math
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.llm import attention_lm as lm

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SF = "/root/testdata/sf0.01"


def words_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=" \t\n\x0b\x0c\r\x1c\x85\xa0AbÉé x", max_size=12)), max_size=5))
def test_words_are_cut_at_six_spaces(texts):
    words, sizes = lm.word_lists(pa.array(texts, pa.string()))
    assert words.to_pylist() == [w for t in texts for w in words_of(t)] and sizes.tolist() == [len(words_of(t)) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab1é.'\x1c\x85\xa0\u3000 |-\x00漢") | st.characters(codec="utf-8"), min_size=1, max_size=20).map(lambda t: "".join(words_of(t))).filter(bool), min_size=1, max_size=6), st.sets(st.integers(0, 50_000), max_size=40))
def test_subwords_spell_the_words(words, kept):
    subwords = lm.Subwords(PATH, tuple(sorted(kept)))
    ids, lengths = subwords.ids(words)
    tokens, counts = subwords.tokens(words)
    assert tokens.tolist() == [t for w in words for t in subwords.encoding.encode_ordinary(" " + w)] and len(counts) == len(words)
    spelled = subwords.encoding._mergeable_ranks
    back = {256 + i: b for i, t in enumerate(sorted(kept)) for b in [next(b for b, r in spelled.items() if r == t)]}
    at = 0
    for w, n in zip(words, lengths):
        assert b"".join(back[i] if i in back else bytes([i]) for i in ids[at : at + n]) == (" " + w).encode()
        at += n


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 90), min_size=1, max_size=8))
def test_windows_score_each_id_once(sizes):
    flat, per, pad = np.arange(sum(sizes)) % 7, np.array(sizes), 9
    ends = np.cumsum(per)
    flat[ends - 1] = 8
    seen = {}
    for text, x, y, first in lm.windows(flat, per, pad):
        for t, xs, ys in zip(text, x, y):
            for i in np.flatnonzero(ys >= 0):
                before = [c for c in xs[: lm.CONTEXT + i + 1] if c != pad]
                seen.setdefault(int(t), []).append((len(before), before, ys[i]))
            assert (xs[: lm.CONTEXT] == pad).all() == first
    for t, (n, end) in enumerate(zip(per, ends)):
        ids = flat[end - n : end].tolist()
        full = [8, *ids[:-1]]
        want = [(full[max(0, k // lm.STRIDE * lm.STRIDE - lm.CONTEXT) : k + 1], ids[k]) for k in range(n)]
        assert sorted((b, int(y)) for _, b, y in seen[t]) == sorted((b, y) for b, y in want)


def small_model(seed=3, size=40):
    rng = np.random.default_rng(seed)
    follows = rng.integers(0, 5, (size, size)).astype(float)
    model = lm.Attention(size, follows, seed)
    model.p["near"] += rng.normal(size=model.p["near"].shape).astype(np.float32)
    x, y = rng.integers(0, size, (3, lm.CONTEXT + lm.STRIDE)), rng.integers(0, size, (3, lm.STRIDE))
    y[1, -5:] = -1
    return model, x, y


def by_loops(model, x, y, first):
    """The same model an id at a time, in double precision."""
    p = {k: v.astype(np.float64) for k, v in model.p.items()}
    soft = lambda z: np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    out = []
    for xs, ys in zip(x, y):
        total = 0.0
        for i, target in enumerate(ys):
            if target < 0:
                continue
            at = lm.CONTEXT + i
            keys = range(lm.CONTEXT if first else 0, at + 1)
            q, heads = p["E"][xs[at]] @ p["Wq"], []
            w = lm.WIDTH // lm.HEADS
            for h in range(lm.HEADS):
                cut = slice(h * w, (h + 1) * w)
                weight = soft(np.array([q[cut] @ (p["E"][xs[j]] @ p["Wk"])[cut] / math.sqrt(w) + p["near"][h, at - j] for j in keys]))
                heads.append(sum(a * (p["E"][xs[j]] @ p["Wv"])[cut] for a, j in zip(weight, keys)))
            u = p["E"][xs[at]] + np.concatenate(heads) @ p["Wo"]
            v = u + np.maximum(u @ p["W1"] + p["b1"], 0) @ p["W2"]
            c = model.of_class[target]
            total += math.log(soft(v @ p["Wc"] + p["bc"])[c]) + math.log(soft(p["U"][c] @ v + p["bu"][c])[model.within[target]])
        out.append(total)
    return out


@pytest.mark.parametrize("first", [True, False])
def test_attention_against_loops(first):
    model, x, y = small_model()
    want = by_loops(model, x, y, first)
    assert np.allclose(model.log_probability(x, y, first), want, rtol=1e-4)
    assert np.allclose(model.finish().log_probability(x, y, first), want, rtol=1e-4)
    later = x.copy()
    later[:, -1] = (later[:, -1] + 1) % 40  # the last id is seen by its own target only
    y[:, -1] = -1
    assert np.allclose(model.log_probability(x, y, first), model.log_probability(later, y, first), rtol=1e-6)


def test_probabilities_sum_to_one():
    model, x, _ = small_model()
    total = 0.0
    for target in range(model.group * model.classes):
        y = np.full((1, lm.STRIDE), -1)
        if target < 40:
            y[0, 7] = target
            total += math.exp(model.log_probability(x[:1], y, False)[0])
    spare = model.group * model.classes - 40  # places of the last class that no id has
    assert total <= 1 + 1e-5 and (spare or total >= 1 - 1e-5) and total > 0.9


def test_gradients_are_slopes():
    model, x, y = small_model()
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    _, g = model.gradients(x, y, False)
    rng = np.random.default_rng(1)
    for k, v in model.p.items():
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in v.shape)
            if k == "E":
                at = (x[0, 20], at[1])
            old, step = v[at], 1e-3
            v[at] = old + step
            up, _ = model.gradients(x, y, False)
            v[at] = old - step
            down, _ = model.gradients(x, y, False)
            v[at] = old
            assert abs((up - down) / (2 * step) - g[k][at]) < 2e-3 * max(1, abs(g[k][at])), k


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([0, 0, 0, 1, 2, 5, 6, 9]), max_size=60))
def test_sums_by_id(ids):
    ids = np.array(ids, np.int64)
    rows = np.random.default_rng(2).integers(-9, 9, (len(ids), 6)).astype(np.float32)
    want = np.zeros((10, 6), np.float32)
    np.add.at(want, ids, rows)
    assert (lm._added_by_id(rows, ids, 10) == want).all()


def test_gradients_of_windows_in_a_row_are_those_of_each():
    model, _, _ = small_model()
    rng = np.random.default_rng(4)
    per = np.array([70, 3, 41])
    chunks = [c for c in lm.windows(rng.integers(0, 40, per.sum()), per, 40)]
    for _, x, y, first in chunks:
        loss, got = model.gradients(x, y, first)
        each = [(int((y[i] >= 0).sum()), *model.gradients(x[i : i + 1], y[i : i + 1], first)) for i in range(len(x))]
        n = sum(e[0] for e in each)
        assert loss == pytest.approx(sum(e[0] * e[1] for e in each) / n, rel=1e-4)
        for k, g in got.items():
            assert np.allclose(g, sum(e[0] * e[2][k] for e in each) / n, atol=1e-4), k


def test_ids_are_multiplied_once_and_not_at_every_place():
    most = []

    class Counted(np.ndarray):
        def __rmatmul__(self, other):
            most.append(len(other))
            return np.asarray(other) @ np.asarray(self)

    model, _, _ = small_model()
    rng = np.random.default_rng(4)
    x, y = rng.integers(0, 40, (50, lm.CONTEXT + lm.STRIDE)), rng.integers(0, 40, (50, lm.STRIDE))
    want = model.gradients(x, y, False)[1]
    for k in ("Wq", "Wk", "Wv", "Wo"):
        model.p[k] = model.p[k].view(Counted)
    got = model.gradients(x, y, False)[1]
    assert most and max(most) <= 41
    assert all(np.allclose(got[k], want[k], atol=1e-5) for k in want)


def train_fold(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1


def in_training():
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(5)) != 1


def base_by_hand(rows):
    counts, ends = {}, 0
    for i, t in rows:
        if train_fold(i):
            ends += 1
            for w in words_of(t):
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()) + ends, len(counts) + (ends > 0)
    below = n + 0.5 * (v + 1)
    out = []
    for i, t in rows:
        c = [counts.get(w, 0) for w in words_of(t)] + [ends]
        out.append((i, not train_fold(i), len(c), sum(x > 0 for x in c), n, round(sum(math.log10((x + 0.5) / below) for x in c), 6)))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot_bytes", [lm.HOT_BYTES, 4_000, 0])
def test_scores_of_odd_texts(spark, monkeypatch, hot_bytes):
    monkeypatch.setattr(lm, "HOT_BYTES", hot_bytes)
    monkeypatch.setattr(lm, "EPOCHS", 1)
    rows = [(i, f"The cat number{i % 7} sat on the mat. " * (i % 5)) for i in range(60)]
    rows += [(100, None), (101, ""), (102, " \t\n"), (103, "x" * 20_000), (104, "word " * 30_000), (105, "ÀÉ \x85 ß\x1c"), (5, "The cat"), (5, "The cat"), (None, "a null id"), (106, "\x00 nul")]
    df = spark.createDataFrame([(i, t, "clash", 1, 0.5) for i, t in rows], "doc_id bigint, text string, word string, n bigint, score double").repartition(3)
    model = lm.fit(df, in_training(), PATH)
    got = lm.score(df, model, in_training()).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=str) == base_by_hand(rows)
    # the score is that of the whole text, window by window
    subwords = lm.Subwords(PATH, model.kept)
    for i, t in rows[:8] + rows[60:66]:
        flat, per = lm.subword_ids(*lm.word_lists(pa.array([t], pa.string())), subwords)
        want = sum(model.attention.log_probability(x, y, first).sum() for _, x, y, first in lm.windows(flat, per, subwords.size)) / math.log(10)
        assert any(abs(r.score - want) < 1e-3 * abs(want) for r in got if r.doc_id == i)
    assert all(r.score < 0 for r in got)


def test_no_rows_and_no_training_rows(spark):
    schema = "doc_id bigint, text string"
    none = spark.createDataFrame([], schema)
    assert lm.score(none, lm.fit(none, in_training(), PATH), in_training()).count() == 0
    held = [i for i in range(100) if not train_fold(i)][:2]
    df = spark.createDataFrame([(held[0], "no training text"), (held[1], None)], schema)
    got = {r.doc_id: r for r in lm.score(df, lm.fit(df, in_training(), PATH), in_training()).collect()}
    assert (got[held[0]].n_tokens, got[held[0]].n_known, got[held[0]].train_tokens) == (4, 0, 0) and got[held[1]].n_tokens == 1
    assert got[held[0]].base_score == pytest.approx(0) and got[held[0]].score < got[held[1]].score < 0


def test_the_query_beats_the_counts_on_held_out_texts(spark):
    from graphloom.llm.queries import op12_attention_lm

    got = op12_attention_lm(spark, SF).collect()
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=str) == base_by_hand(rows)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_texts_beyond_the_start_are_learned(spark, monkeypatch):
    monkeypatch.setattr(lm, "SAMPLE_ROWS", 30)
    docs = spark.range(600).withColumnRenamed("id", "doc_id").withColumn("text", F.lit("x"))
    first = {r["id"] for r in lm._sample(docs, F.lit(True), "doc_id", "text").collect()}
    assert 0 < len(first) < 100
    one, other = "the cat sat on the mat ", "red dogs run far away "
    docs = spark.createDataFrame([(i, one * 4 if i in first else other * 120) for i in range(600)], "doc_id bigint, text string").coalesce(2)
    asked = spark.createDataFrame([(1, other * 6)], "doc_id bigint, text string")
    after = lm.score(asked, lm.fit(docs, F.lit(True), PATH), F.lit(False)).first()
    monkeypatch.setattr(lm, "learn", lambda docs, path, kept, attention, text: attention)
    before = lm.score(asked, lm.fit(docs, F.lit(True), PATH), F.lit(False)).first()
    assert after["score"] > before["score"] + 0.2 * after["n_tokens"]
