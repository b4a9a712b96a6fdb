"""Language identification: a linear-chain CRF labels the words of code-switched text."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.batches import by_bytes
from graphloom.llm.sampling import fit_on_sample, hashed_sample, in_training

SAMPLE_ROWS = 1_000  # bound on the labelled documents that a model is fitted on
LEAST_WORDS = 3  # a word is in the lexicon if so many training documents hold it
LEXICON_WORDS = 50_000
HASH_BITS = 18
GRAMS = (2, 3, 4)
CHUNK_WORDS = 2_000_000  # words that one forward-backward pass of a task takes together
TYPES_AT_ONCE = 100_000
UNKNOWN = "und"

WORD = re.compile(r"[^\W\d_]+")
_START, _END = b"\x02", b"\x03"


def words_of(text: str | None) -> list[str]:
    """Lower-case words, without the signs that are no letters; none if the text is null or has no letter."""
    found = WORD.findall(text.lower()) if text else []
    if all(map(str.isalpha, found)):
        return found
    return [w for w in ("".join(filter(str.isalpha, x)) for x in found) if w]


def gram_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte n-grams of the words, and where those of each word start.

    Words carry a start and an end mark, so that n-grams with a mark are their affixes."""
    coded = [_START + w.encode() + _END for w in words]
    size = np.fromiter(map(len, coded), np.int64, len(coded))
    data = np.frombuffer(b"".join(coded), np.uint8).astype(np.uint64)
    begin = np.concatenate([[0], np.cumsum(size)])
    left = np.repeat(begin[1:], size) - np.arange(len(data))  # bytes up to the end of the word
    hashes = np.zeros((len(data), len(GRAMS)), np.int32)
    valid = np.zeros((len(data), len(GRAMS)), bool)
    h = np.zeros(len(data), np.uint64)
    for k in range(max(GRAMS)):
        h[: len(data) - k] = h[: len(data) - k] * np.uint64(0x9E3779B97F4A7C15) + data[k:] + np.uint64(1)
        if k + 1 in GRAMS:
            g = GRAMS.index(k + 1)
            mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * g)
            hashes[:, g] = (mixed >> np.uint64(64 - HASH_BITS)).astype(np.int32)
            valid[:, g] = left > k
    per_word = np.add.reduceat(valid.sum(1), begin[:-1]) if len(words) else np.zeros(0, np.int64)
    return hashes[valid], np.concatenate([[0], np.cumsum(per_word)])


class Crf:
    """Weights of hashed n-grams and affixes, of lexicon words, and of label transitions."""

    def __init__(self, labels: list[str], lexicon: dict[str, int]):
        k = len(labels)
        self.labels, self.lexicon = labels, lexicon
        self.grams = np.zeros((1 << HASH_BITS, k), np.float32)
        self.words = np.zeros((len(lexicon) + 1, k), np.float32)  # the last row is for other words
        self.step, self.start = np.zeros((k, k)), np.zeros(k)

    def emissions(self, grams, starts, entry) -> np.ndarray:
        count = np.diff(starts).astype(np.float32)[:, None]
        return np.add.reduceat(self.grams[grams], starts[:-1], axis=0) / np.sqrt(count) + self.words[entry]

    def type_emissions(self, types: list[str]) -> np.ndarray:
        """Emission scores of distinct words, some at a time."""
        parts = (types[i : i + TYPES_AT_ONCE] for i in range(0, len(types), TYPES_AT_ONCE))
        return np.concatenate([self.emissions(*gram_features(p), self.entries(p)) for p in parts])

    def entries(self, words: list[str]) -> np.ndarray:
        other = len(self.lexicon)
        return np.fromiter((self.lexicon.get(w, other) for w in words), np.int64, len(words))

    def marginals(self, emit: np.ndarray, lengths: np.ndarray, each: bool = True):
        """Posterior label probabilities by forward-backward over all sequences at once: of every word,
        with the expected transitions and first labels, or (unless ``each``) their means by sequence.

        ``emit`` holds the words of one sequence after another, the longest sequence first."""
        n, k = emit.shape
        begin = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        e = np.exp(emit - emit.max(1, keepdims=True))
        trans = np.exp(self.step).astype(e.dtype)
        live = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), side="right")
        alpha = np.empty_like(e)
        a = np.exp(self.start).astype(e.dtype) * e[begin]
        for t, m in enumerate(live):
            at = begin[:m] + t
            if t:
                a = (a[:m] @ trans) * e[at]
            a = a / a.sum(1, keepdims=True)
            alpha[at] = a
        moved = np.zeros((k, k))
        out = np.empty_like(e) if each else np.zeros((len(lengths), k))
        b = np.ones((0, k), e.dtype)
        for t in range(len(live) - 1, -1, -1):
            m = live[t]
            at = begin[:m] + t
            if len(b) < m:
                b = np.concatenate([b, np.ones((m - len(b), k), e.dtype)])
            p = alpha[at] * b
            p /= p.sum(1, keepdims=True)
            if each:
                out[at] = p
            else:
                out[:m] += p
            if t:
                f = e[at] * b
                if each:
                    joint = np.einsum("ni,nj->nij", alpha[at - 1], f) * trans
                    moved += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
                b = f @ trans.T
                b = b / b.sum(1, keepdims=True)
        return (out, moved, out[begin].sum(0)) if each else out / lengths[:, None]

    def fit(self, types: list[str], word: np.ndarray, gold: np.ndarray, lengths: np.ndarray, rounds: int = 15):
        """Adam on the log-likelihood of the label sequences; word and gold are per position."""
        grams, starts = gram_features(types)
        entry = self.entries(types)
        count = np.diff(starts)
        scale = (1 / np.sqrt(count)).astype(np.float32)
        k = len(self.labels)
        begin = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        inside = np.ones(len(word), bool)
        inside[begin] = False
        moves = np.bincount(gold[np.flatnonzero(inside) - 1] * k + gold[inside], minlength=k * k).reshape(k, k)
        first = np.bincount(gold[begin], minlength=k)
        params = [self.grams, self.words, self.step, self.start]
        m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for r in range(1, rounds + 1):
            diff, moved, firsts = self.marginals(self.emissions(grams, starts, entry)[word], lengths)
            diff[np.arange(len(gold)), gold] -= 1
            per_type = np.array([np.bincount(word, diff[:, c], len(types)) for c in range(k)]).T
            del diff
            grad = [np.empty_like(self.grams), np.empty_like(self.words), moved - moves, firsts - first]
            for c in range(k):
                grad[0][:, c] = np.bincount(grams, np.repeat((per_type[:, c] * scale).astype(np.float32), count), 1 << HASH_BITS)
                grad[1][:, c] = np.bincount(entry, per_type[:, c], len(self.words))
            for p, g, a, b in zip(params, grad, m1, m2):
                g = g / len(lengths) + 1e-5 * p
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                p -= 0.1 * (a / (1 - 0.9**r)) / (np.sqrt(b / (1 - 0.99**r)) + 1e-8)
        return self

    def spans(self, text: str | None) -> list[tuple[int, int, str, float]]:
        """(start, end, label, score) of the runs of words that have one label, in characters of the text; the
        score is the mean posterior of the label over the words of the run."""
        places = [(m.start(), m.end()) for m in WORD.finditer(text or "") if any(map(str.isalpha, m.group()))]
        words = ["".join(filter(str.isalpha, text[a:b].lower())) for a, b in places]
        if not words or not self.labels:
            return []
        share = self.marginals(self.type_emissions(words), np.array([len(words)]))[0]
        best, out = share.argmax(1), []
        edges = [0, *(np.flatnonzero(best[1:] != best[:-1]) + 1).tolist(), len(words)]
        for s, e in zip(edges[:-1], edges[1:]):
            out.append((places[s][0], places[e - 1][1], self.labels[best[s]], float(min(1.0, share[s:e, best[s]].mean()))))
        return out

    def predict(self, texts) -> tuple[list[str], list[float]]:
        """Language of every whole text: the label with the largest share of the word posteriors."""
        labels, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        at = 0
        while at < len(texts):
            number: dict[str, int] = defaultdict()
            number.default_factory = number.__len__
            rows, ids, total = [], [], 0
            while at < len(texts) and total < CHUNK_WORDS:
                words = words_of(texts[at])
                if words and self.labels:
                    rows.append(at)
                    ids.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
                    total += len(words)
                at += 1
            if not rows:
                continue
            types = list(number)
            number.clear()
            lengths = np.fromiter(map(len, ids), np.int64, len(ids))
            order = np.argsort(-lengths, kind="stable")
            emit = self.type_emissions(types)[np.concatenate([ids[i] for i in order])]
            del types, ids
            share = self.marginals(emit, lengths[order], each=False)
            for i, best, top in zip(order, share.argmax(1), share.max(1)):
                labels[rows[i]], scores[rows[i]] = self.labels[best], float(min(1.0, top))
        return labels, scores


def fit_texts(texts: list[str], langs: list[str], seed: int = 5) -> Crf:
    """Fit on whole labelled texts. They are cut into spans of 4 to 40 words, which are dealt in
    random order into sequences of about 150 words, so that transitions are learned from
    switches; every word has the label of its document."""
    labels = sorted(set(langs))
    number: dict[str, int] = defaultdict()
    number.default_factory = number.__len__
    ids = []
    for text in texts:
        words = words_of(text)
        ids.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
    types = list(number)
    seen = np.bincount(np.concatenate([np.unique(x) for x in ids] or [[]]).astype(np.int64), minlength=len(types))
    often = sorted(np.flatnonzero(seen >= LEAST_WORDS).tolist(), key=lambda i: (-seen[i], types[i]))[:LEXICON_WORDS]
    model = Crf(labels, {types[i]: n for n, i in enumerate(often)})
    rng = np.random.default_rng(seed)
    spans = []
    for row, lang in zip(ids, langs):
        at = 0
        while at < len(row):
            step = int(rng.integers(4, 41))
            spans.append((row[at : at + step], labels.index(lang)))
            at += step
    if not spans:
        return model
    spans = [spans[i] for i in rng.permutation(len(spans))]
    sequences = [spans[i : i + 7] for i in range(0, len(spans), 7)]
    sequences.sort(key=lambda s: -sum(len(x) for x, _ in s))
    lengths = np.array([sum(len(x) for x, _ in s) for s in sequences])
    word = np.concatenate([x for s in sequences for x, _ in s])
    gold = np.concatenate([np.full(len(x), y) for s in sequences for x, y in s])
    return model.fit(types, word, gold, lengths)


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = SAMPLE_ROWS) -> Crf:
    """Fit on at most ``rows`` labelled documents of the training folds (smallest hashes of ids), and at
    most SAMPLE_BYTES of text; of rows that repeat an id the one with the smallest label and text counts."""
    known = docs.where(F.col(key).isNotNull() & F.col(lang).isNotNull() & F.col(text).isNotNull() & in_training(F.col(key)))
    sample = hashed_sample(known.select(key).distinct(), key, rows)
    return fit_on_sample(known.select(key, F.col(lang).alias("y"), F.col(text).alias("t")), sample, key, fit_texts)


def identify(docs: DataFrame, model: Crf, text: str = "text", label: str = "lang_pred", score: str = "lang_score") -> DataFrame:
    """Add the language of every whole text and the share of its word posteriors (0 to 1).

    Texts that are null or have no letter get ``und`` and 0; so do all texts if the model
    was fitted on no labelled row. Each row is judged alone, so repeats agree. Columns named like the
    new ones are replaced; a column ``_language`` is an error."""
    if "_language" in docs.columns:
        raise ValueError("a column _language clashes")

    @F.pandas_udf("label string, score double")
    def tagged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            labels, scores = model.predict(texts.tolist())
            yield pd.DataFrame({"label": labels, "score": scores})

    # long documents take as many steps in a small batch as in a large one
    kept = [c for c in docs.columns if c not in (label, score)]
    return by_bytes(docs, 8).select(*kept, tagged(F.col(text)).alias("_language")).select(
        *[F.col(c) for c in kept], F.col("_language.label").alias(label), F.col("_language.score").alias(score)
    )


def label_spans(docs: DataFrame, model: Crf, text: str = "text", out: str = "lang_spans") -> DataFrame:
    """Add the spans of one language each of every whole text: an array of (start, end, lang, score) in
    characters, from the posteriors of the single words. Null texts and texts without a letter have
    none; a column of that name is replaced."""

    @F.pandas_udf("array<struct<start:int,end:int,lang:string,score:double>>")
    def tagged(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[dict(zip(("start", "end", "lang", "score"), x)) for x in model.spans(t)] for t in texts])

    return by_bytes(docs, 8).withColumn(out, tagged(F.col(text)))
