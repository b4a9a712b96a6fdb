"""Toxicity scores: gradient-boosted trees over dense features, with isotonic calibration."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.batches import by_bytes
from graphloom.llm.sampling import fit_on_sample, hashed_sample, in_training

SAMPLE_ROWS = 8_000  # bound on the labelled rows that a model is fitted on
LEXICON_UNITS = 5_000
FOLDS = 4
CUT = 0.3

# Insults known beforehand, and second-person forms, of the four languages.
INSULTS = (
    "idiot", "moron", "stupid", "dumb", "loser", "scum", "trash", "pathetic", "worthless", "disgusting", "clown", "fool", "jerk",
    "dumm", "blöd", "arschloch", "trottel", "abschaum", "versager", "widerlich", "erbärmlich",
    "con", "connard", "débile", "ordure", "nul", "pathétique", "imbécile",
    "estúpido", "imbécil", "basura", "asqueroso", "patético", "inútil",
)
SECOND_PERSON = (
    "you", "your", "yours", "yourself", "u", "ur", "du", "dich", "dir", "dein", "deine", "euch", "ihr", "sie",
    "tu", "te", "toi", "ton", "tes", "vous", "votre", "vos", "tú", "ti", "usted", "ustedes", "tuyo",
)
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": ""}

WORD = re.compile(r"[^\W\d_]+")
CAPS = re.compile(r"\b[A-Z]{3,}\b")
MASKED = re.compile(r"\b[^\W\d_]+[0-9@$!*]+[^\W\d_]+")
NEAR = 5  # words between an insult and a second-person form
FEATURES = 17


def units(words) -> set[str]:
    """Lexicon units of a text: its words and, marked by a star, their first five letters."""
    kinds = set(words)
    return kinds | {w[:5] + "*" for w in kinds if len(w) > 5}


def learn_lexicon(toxic: Counter, clean: Counter, n_toxic: int, n_clean: int) -> dict[str, float]:
    """Units by log odds of their document rates, where these stand out by 2.5 standard errors."""
    found = {}
    for w, p in toxic.items():
        if p < 3:
            continue
        n = clean.get(w, 0)
        odds = math.log((p + 0.5) / (n_toxic + 1)) - math.log((n + 0.5) / (n_clean + 1))
        if odds - 2.5 * math.sqrt(1 / (p + 0.5) + 1 / (n + 0.5)) > 0.3 or (n == 0 and p >= 5 and odds > 2):
            found[w] = odds
    return dict(sorted(found.items(), key=lambda x: (-x[1], x[0]))[:LEXICON_UNITS])


def features(text: str | None, lexicon: dict[str, float]) -> list[float]:
    """The dense features of one whole text; all zero for null and empty texts."""
    if not text:
        return [0.0] * FEATURES
    words = WORD.findall(text.lower())
    n = max(1, len(words))
    kinds = set(words)
    found = {}
    for w in kinds:
        odds = lexicon.get(w)
        if odds is None and len(w) > 5:
            odds = lexicon.get(w[:5] + "*")
        if odds is not None:
            found[w] = odds
    known = kinds.intersection(_KNOWN)
    marks = [i for i, w in enumerate(words) if w in found or w in known] if found or known else []
    seeds = sum(1 for i in marks if words[i] in known)
    odds = [found.get(words[i], 0.0) for i in marks]
    close = 0
    if marks and not kinds.isdisjoint(_YOU):
        you = np.flatnonzero(np.fromiter((w in _YOU for w in words), bool, len(words)))
        at = np.searchsorted(you, marks)
        left = np.array(marks) - you[np.maximum(at - 1, 0)]
        right = you[np.minimum(at, len(you) - 1)] - np.array(marks)
        close = int(((abs(left) <= NEAR) | (abs(right) <= NEAR)).sum())
    masked = MASKED.findall(text)
    plain = [m.lower().translate(_PLAIN) for m in masked]
    hidden = sum(1 for m in plain if m in _KNOWN or m in lexicon)
    count = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    size = max(1, int(count.sum()))
    letters = max(1, int(count[65:91].sum() + count[97:123].sum()))
    punctuation = int(count[33:48].sum() + count[58:65].sum() + count[91:97].sum() + count[123:127].sum())
    return [
        math.log1p(len(words)), seeds / n, math.log1p(seeds), len(marks) / n, math.log1p(len(marks)),
        sum(odds) / n, max(odds, default=0.0), math.log1p(sum(odds)), float(len(found)), close / max(1, len(marks)),
        int(count[65:91].sum()) / letters, len(CAPS.findall(text)) / n, int(count[33] + count[63]) / size,
        punctuation / size, len(masked) / n, math.log1p(hidden), len(kinds) / n,
    ]


_KNOWN, _YOU, _PLAIN = frozenset(INSULTS), frozenset(SECOND_PERSON), str.maketrans(LEET)


class Trees:
    """Boosted trees on logistic loss, grown level by level on histograms."""

    def __init__(self, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 48, ridge: float = 2.0):
        self.rounds, self.depth, self.rate, self.bins, self.ridge = rounds, depth, rate, bins, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        n, d = x.shape
        self.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(d)]
        codes = np.array([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(self.edges)])
        p = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.base = math.log(p / (1 - p))
        raw, self.trees = np.full(n, self.base), []
        width = self.bins + 1
        for _ in range(self.rounds):
            q = 1 / (1 + np.exp(-raw))
            g, h = q - y, q * (1 - q)
            node = np.zeros(n, np.int64)
            split_f, split_v = [], []
            for level in range(self.depth):
                m = 1 << level
                best = np.full(m, 1e-9)
                f_of, v_of = np.zeros(m, np.int64), np.full(m, np.inf)
                c_of = np.full(m, width)
                for f in range(d):
                    at = node * width + codes[f]
                    G = np.bincount(at, g, m * width).reshape(m, width).cumsum(1)
                    H = np.bincount(at, h, m * width).reshape(m, width).cumsum(1)
                    gt, ht = G[:, -1:], H[:, -1:]
                    gain = G**2 / (H + self.ridge) + (gt - G) ** 2 / (ht - H + self.ridge) - gt**2 / (ht + self.ridge)
                    gain[(H < 1) | (ht - H < 1)] = -1
                    gain[:, len(self.edges[f]) :] = -1
                    cut = gain.argmax(1)
                    top = gain[np.arange(m), cut]
                    for k in np.flatnonzero(top > best + 1e-12):
                        best[k], f_of[k], c_of[k], v_of[k] = top[k], f, cut[k], self.edges[f][cut[k]]
                split_f.append(f_of)
                split_v.append(v_of)
                node = 2 * node + (codes[f_of[node], np.arange(n)] > c_of[node])
            m = 1 << self.depth
            leaf = -self.rate * np.bincount(node, g, m) / (np.bincount(node, h, m) + self.ridge)
            self.trees.append((split_f, split_v, leaf))
            raw += leaf[node]
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for split_f, split_v, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for f, v in zip(split_f, split_v):
                node = 2 * node + (x[rows, f[node]] > v[node])
            out += leaf[node]
        return out


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: centres of blocks of ``raw`` and their rising rates of ``y``."""
    order = np.argsort(raw, kind="stable")
    blocks: list[list[float]] = []  # sum of y, sum of raw, rows
    for r, t in zip(raw[order], y[order]):
        blocks.append([float(t), float(r), 1.0])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][2] >= blocks[-1][0] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return np.array([b[1] / b[2] for b in blocks]), np.array([b[0] / b[2] for b in blocks])


class Model:
    """A fitted scorer; small, so that it travels with the tasks."""

    def __init__(self, lexicon, trees, knots, rates):
        self.lexicon, self.trees, self.knots, self.rates = lexicon, trees, knots, rates

    def score(self, texts) -> np.ndarray:
        if not len(texts):
            return np.zeros(0)
        raw = self.trees.raw(np.array([features(t, self.lexicon) for t in texts]))
        step = np.interp(raw, self.knots, self.rates)
        # a little of the raw order is kept on the plateaus
        return np.clip(0.995 * step + 0.005 / (1 + np.exp(-raw)), 0.0, 1.0)


def fit_texts(texts: list[str | None], labels: np.ndarray) -> Model:
    """Fit on texts and 0/1 labels. The lexicon features of a row come from the other folds, and
    calibration from trees that have not seen the row; without both labels all scores are the rate."""
    y = np.asarray(labels, np.float64)
    n = len(y)
    fold = np.arange(n) % FOLDS
    counts = [[Counter(), Counter()] for _ in range(FOLDS)]
    toxic_units: set[str] = set()
    for toxic in (1, 0):  # of clean rows only the units that toxic ones have are counted
        for i in np.flatnonzero(y == toxic):
            kinds = units(WORD.findall((texts[i] or "").lower()))
            if toxic:
                toxic_units |= kinds
            counts[fold[i]][toxic].update(kinds if toxic else kinds & toxic_units)
    whole = [Counter(), Counter()]
    for c in counts:
        for k in (0, 1):
            whole[k].update(c[k])
    lexicon = learn_lexicon(whole[1], whole[0], int(y.sum()), int(n - y.sum()))
    x = np.zeros((n, FEATURES))
    for f in range(FOLDS):
        mine = fold == f
        rest = [{w: v - counts[f][k].get(w, 0) for w, v in whole[k].items()} for k in (0, 1)]
        own = learn_lexicon(rest[1], rest[0], int(y[~mine].sum()), int((1 - y[~mine]).sum()))
        for i in np.flatnonzero(mine):
            x[i] = features(texts[i], own)
    raw = np.zeros(n)
    for f in range(FOLDS):
        mine = fold == f
        if mine.any() and not mine.all():
            raw[mine] = Trees().fit(x[~mine], y[~mine]).raw(x[mine])
    knots, rates = isotonic(raw, y) if n else (np.zeros(1), np.zeros(1))
    if not n:
        x, y = np.zeros((1, FEATURES)), np.zeros(1)
    return Model(lexicon, Trees().fit(x, y), knots, rates)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
        rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most ``rows`` labelled documents of the training folds (smallest hashes of ids).

    Rows without id or label are left out; an id is toxic if one of its labels is, and of documents that
    repeat an id the smallest text counts. At most SAMPLE_BYTES of text are read."""
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & in_training(F.col(key)))
    known = known.groupBy(key).agg(F.max(F.col(label).cast("int")).alias("y"))
    known = hashed_sample(known, key, rows)
    labelled = docs.select(key, F.col(text).alias("t")).join(F.broadcast(known), key)  # at most ``rows`` ids
    return fit_on_sample(labelled, known.select(key), key, fit_texts)


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "toxicity") -> DataFrame:
    """Add the score (0 to 1) of every whole text; null and empty texts are scored by their zero features.
    A column named ``out`` is replaced."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.score(texts.tolist()))

    return by_bytes(docs).withColumn(out, scored(F.col(text)))


def is_toxic(score: Column) -> Column:
    return (score >= CUT).cast("int")
