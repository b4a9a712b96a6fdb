"""Language-model scores: causal self-attention over subword ids, beside add-half counts of words."""

from __future__ import annotations

import base64
import functools
import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.batches import by_bytes
from graphloom.llm.sampling import hashed_sample
from graphloom.llm.segment_bpe import PATTERN
from graphloom.storage import broadcast_if_small, materialize

KEPT = 1_024  # subwords with ids of their own, the most frequent ones; others are spelled in bytes
CONTEXT, STRIDE = 8, 16  # a window's ids that are only context, and those that it scores
WIDTH, HEADS, HIDDEN = 32, 1, 32  # one head: an id's value is multiplied by its weights ahead
OTHER_SPACE = re.compile(r"[^\S ]")  # that separates words for Python, but not here
STEEP = np.float32(60)  # logits are cut here, so that no exponential leaves single precision
SAMPLE_ROWS = 2_000  # training documents that the fit starts on, many times over; then it sees all training texts once
SAMPLE_BYTES = 6 << 20  # of all their texts; documents beyond it wait for that
WINDOWS, STEPS, EPOCHS, RATE = 48, 4_000, 12, 0.02  # of a step; steps of the fit, and how often at most it sees the sample
PASS_RATE = 0.002  # of the pass over all training texts
CHUNK = 512  # windows that are scored together
SUMS = 16  # rows that the models of the tasks are added up in
HOT_BYTES = 16 << 20  # of words whose counts are sent to every task; those of other words are joined
HELD_ROWS = 1_000_000  # distinct words that a counting task holds


# words


def word_lists(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts (null: none), A-Z in lower case, and how many each text has.

    Words are cut at the six ASCII spaces, and nowhere else."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words, parent = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy()
    good = pc.not_equal(words, "")  # a text that begins or ends with a space
    return words.filter(good), np.bincount(parent[good.to_numpy(zero_copy_only=False)], minlength=len(texts))


def _tally(batches):
    """Counts of words, those in training texts apart: few rows for each word and task."""

    def merged(tables):
        return pa.concat_tables(tables).group_by("word").aggregate([("n", "sum"), ("n_train", "sum")]).rename_columns(["word", "n", "n_train"])

    held: list[pa.Table] = []
    for batch in batches:
        words, sizes = word_lists(batch.column("t"))
        coded = words.dictionary_encode()
        train = np.repeat(batch.column("train").to_numpy(zero_copy_only=False).astype(bool), sizes)
        at, k = coded.indices.to_numpy(), len(coded.dictionary)
        held.append(pa.table({"word": coded.dictionary, "n": np.bincount(at, minlength=k), "n_train": np.bincount(at[train], minlength=k)}))
        if sum(map(len, held)) > HELD_ROWS:
            held = [merged(held)]
            if len(held[0]) > HELD_ROWS // 2:
                yield from held.pop().to_batches(max_chunksize=100_000)
    if held:
        yield from merged(held).to_batches(max_chunksize=100_000)


# subwords


class Subwords:
    """Ids of words: the kept subwords of a public vocabulary, and bytes for the rest. A word is encoded
    with a space before it, as in running text; ``end`` closes a text and also stands before its first word."""

    def __init__(self, path: str, kept: tuple[int, ...]):
        self.encoding, spelled = _encoding(path)
        self.end, self.size = 256 + len(kept), 257 + len(kept)
        own = {t: [256 + i] for i, t in enumerate(kept)}
        pieces = [own.get(t) or list(spelled.get(t, b"")) for t in range(max(spelled) + 1)]
        self.lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.pieces = np.fromiter((i for p in pieces for i in p), np.int64, int(self.lengths.sum()))
        self.begins = np.fromiter((spelled.get(t, b"").startswith(b" ") for t in range(len(pieces))), bool, len(pieces))

    def tokens(self, words: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The vocabulary's own ids of all words in a row, and how many each has.

        Words without any kind of space are encoded as one text, in which only their beginnings have a space."""
        words = pa.array(words, pa.string()) if isinstance(words, list) else words
        joined, plain = _joined(words), np.ones(len(words), bool)
        if OTHER_SPACE.search(joined):
            plain = np.fromiter((len(w.split()) == 1 for w in words.to_pylist()), bool, len(words))
            joined = _joined(words.filter(pa.array(plain)))
        found = self.encoding.encode_to_numpy(" " + joined).astype(np.int64) if joined else np.zeros(0, np.int64)
        first = np.flatnonzero(self.begins[found])
        if len(first) != plain.sum():
            raise ValueError("the vocabulary does not keep words apart")
        counts = np.empty(len(words), np.int64)
        counts[plain] = np.diff(np.append(first, len(found)))
        if plain.all():
            return found, counts
        alone = [self.encoding.encode_ordinary(" " + w) for w in words.filter(pa.array(~plain)).to_pylist()]
        counts[~plain] = list(map(len, alone))
        out, own = np.empty(int(counts.sum()), np.int64), np.repeat(plain, counts)
        out[own], out[~own] = found, [t for ids in alone for t in ids]
        return out, counts

    def ids(self, words: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and how many each has."""
        tokens, counts = self.tokens(words)
        n = self.lengths[tokens]
        per = np.add.reduceat(n, np.cumsum(counts) - counts) if len(words) else np.zeros(0, np.int64)
        return self.pieces[np.repeat(self.starts[tokens] - (np.cumsum(n) - n), n) + np.arange(n.sum())], per


def _joined(words: pa.Array) -> str:
    """The words with a space between every two."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), " ")[0].as_py()


@functools.lru_cache(2)
def _encoding(path: str) -> tuple[tiktoken.Encoding, dict[int, bytes]]:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), {i: b for b, i in ranks.items()}


@functools.lru_cache(2)
def _subwords(path: str, kept: tuple[int, ...]) -> Subwords:
    return Subwords(path, kept)


def _subword_counts(path: str):
    def run(batches):
        every = _subwords(path, ())
        total = np.zeros(len(every.lengths), np.int64)
        for batch in batches:
            tokens, counts = every.tokens(batch.column("word"))
            total += np.bincount(tokens, np.repeat(batch.column("n_train").to_numpy(), counts), len(total)).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "n"])

    return run


def subword_ids(words: pa.Array | pa.DictionaryArray, sizes: np.ndarray, subwords: Subwords) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row, each closed by ``end``, and how many each has."""
    coded = words.dictionary_encode()
    ids, lengths = subwords.ids(coded.dictionary)
    ids, lengths = np.append(ids, subwords.end), np.append(lengths, 1)
    at = np.insert(coded.indices.to_numpy(), np.cumsum(sizes), len(lengths) - 1)  # the end is one more word
    n = lengths[at]
    starts = np.cumsum(lengths) - lengths
    flat = ids[np.repeat(starts[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
    per = np.add.reduceat(n, np.cumsum(sizes + 1) - sizes - 1) if len(sizes) else n
    return flat, per


def windows(flat: np.ndarray, per: np.ndarray, pad: int):
    """Yield (text, inputs, targets, first) in chunks of overlapping windows, none of which spans two texts.

    A window scores STRIDE targets and sees CONTEXT ids before them; every id is a target once. ``first`` marks
    a chunk of the texts' first windows, whose context is all padding; targets beyond a text are -1."""
    starts = np.cumsum(per) - per
    inputs = np.append(flat[-1:], flat[:-1])  # the id before: the end of the text before, or of the last one
    count = -(-per // STRIDE)
    text = np.repeat(np.arange(len(per)), count)
    base = starts[text] + (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)) * STRIDE
    ends = starts[text] + per[text]
    leading = base == starts[text]
    for first in (True, False):
        some = np.flatnonzero(leading == first)
        for s in range(0, len(some), CHUNK):
            w = some[s : s + CHUNK]
            at = base[w, None] + np.arange(-CONTEXT, STRIDE)
            here = (at >= starts[text[w], None]) & (at < ends[w, None])
            at = np.clip(at, 0, len(flat) - 1)
            targets = np.where(here[:, CONTEXT:], flat[at[:, CONTEXT:]], -1)
            yield text[w], np.where(here, inputs[at], pad), targets, first


# the model


class Attention:
    """One layer of causal self-attention with learned biases by distance, a hidden layer, and a softmax in two
    steps: the class of the next id (about sqrt(size) ids that follow like ids), then the id within its class."""

    def __init__(self, size: int, follows: np.ndarray, seed: int = 5):
        """``follows[a, b]``: how often id b follows id a in the sample."""
        rng = np.random.default_rng(seed)
        self.size, self.group = size, math.isqrt(size - 1) + 1
        self.classes = -(-size // self.group)
        total, d = self.group * self.classes, WIDTH
        # ids in the order of the main axis of what they follow: ids of one language are neighbours
        share = np.log1p(follows) - np.log1p(follows).mean(0)
        axis = np.linalg.eigh(share.T @ share)[1][:, -1] if follows.any() else np.arange(size)
        place = np.empty(size, np.int64)
        place[np.argsort(axis, kind="stable")] = np.arange(size)
        self.of_class, self.within = (place // self.group).astype(np.uint8), place % self.group
        often = np.full(total, 0.1)
        often[place] += follows.sum(0)
        often = (often / often.sum()).reshape(self.classes, self.group)
        normal = lambda *shape, scale=1.0: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.p = {
            "E": normal(size + 1, d, scale=0.5), "Wq": normal(d, d, scale=d**-0.5), "Wk": normal(d, d, scale=d**-0.5), "Wv": normal(d, d, scale=d**-0.5),
            "Wo": normal(d, d, scale=0.3 * d**-0.5), "near": np.zeros((HEADS, CONTEXT + STRIDE), np.float32),
            "W1": normal(d, HIDDEN, scale=d**-0.5), "b1": np.zeros(HIDDEN, np.float32), "W2": normal(HIDDEN, d, scale=0.3 * HIDDEN**-0.5),
            "Wc": normal(d, self.classes, scale=0.3 * d**-0.5), "bc": np.log(often.sum(1)).astype(np.float32),
            "U": normal(self.classes, self.group, d, scale=0.3 * d**-0.5), "bu": np.log(often / often.sum(1, keepdims=True)).astype(np.float32),
        }
        self.tables: tuple[np.ndarray, ...] = ()
        self.distance = np.arange(STRIDE)[:, None] + CONTEXT - np.arange(CONTEXT + STRIDE)

    def _mask(self, first: bool) -> np.ndarray:
        """Factors of keys for queries: learned by distance; later keys and padding are out."""
        factors = np.where(self.distance < 0, 0, np.exp(self.p["near"][0, np.maximum(self.distance, 0)]))
        if first:
            factors[:, :CONTEXT] = 0
        return factors

    def _by_id(self) -> tuple[np.ndarray, ...]:
        """Of every id: its query; its key and its value as it is added up; its plain value.

        With one head, a row for each id is multiplied by the weights, not one for each place where the id occurs."""
        p = self.p
        q, k, plain = np.hsplit(p["E"] @ np.hstack([p["Wq"] * np.float32(WIDTH**-0.5), p["Wk"], p["Wv"]]), 3)
        return np.ascontiguousarray(q), np.hstack([k, plain @ p["Wo"]]), plain

    def finish(self) -> Attention:
        """Values of every id and the weights of every two, so that scoring only looks them up.

        That is some megabytes, made where they are used rather than sent."""
        q, other, _ = self._by_id()
        pairs = np.exp(np.clip(q @ other[:, :WIDTH].T, -STEEP, STEEP))
        self.tables = pairs.ravel(), np.ascontiguousarray(other[:, WIDTH:])
        return self

    def _body(self, x: np.ndarray, first: bool) -> dict:
        """Everything up to the vectors that predict, for windows of ids."""
        p, mine, f = self.p, x[:, CONTEXT:], {}
        if self.tables:
            pairs, values = self.tables
            s = np.take(pairs, (mine * len(values))[:, :, None] + x[:, None, :])
            v = np.take(values, x, axis=0)
        else:
            q, other, f["plain"] = self._by_id()
            f["q"], kv = np.take(q, mine, axis=0), np.take(other, x, axis=0)
            f["k"], v = kv[..., :WIDTH], kv[..., WIDTH:]
            s = f["q"] @ f["k"].transpose(0, 2, 1)
            np.clip(s, -STEEP, STEEP, out=s)
            np.exp(s, out=s)
        s *= self._mask(first)
        s *= (1 / (s @ np.ones(s.shape[-1], s.dtype)))[..., None]
        a = s @ v
        u = np.take(p["E"], mine, axis=0)
        u += a
        u = u.reshape(-1, WIDTH)  # from here on a row per predicted id
        r = u @ p["W1"]
        by_window = r.reshape(len(x), -1)
        by_window += np.tile(p["b1"], STRIDE)
        np.clip(r, 0, np.inf, out=r)
        h = r @ p["W2"]
        h += u
        return f | {"v": v, "s": s, "a": a, "u": u, "r": r, "h": h}

    def _predict(self, h: np.ndarray, y: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Log probabilities (natural) of ids ``y`` (-1: zero) from vectors ``h``; with ``grads`` also the gradient for ``h``."""
        p = self.p
        # rows in the order of their classes; those without an id come last and are left out
        c = np.append(self.of_class, np.uint8(255))[y]
        order = np.argsort(c, kind="stable")
        edges = np.searchsorted(c[order], np.arange(self.classes + 1, dtype=np.uint8))
        n = edges[-1]
        back = np.empty(len(y), np.int64)
        back[order] = np.arange(len(y))
        np.minimum(back, n, out=back)
        order = order[:n]
        h, c, inside, at = np.take(h, order, axis=0), c[order], self.within[y[order]], np.arange(n)
        parts = [(g, slice(edges[g], edges[g + 1])) for g in range(self.classes) if edges[g] < edges[g + 1]]
        logits = h @ p["Wc"], np.empty((n, self.group), h.dtype)
        np.add(logits[0], p["bc"], out=logits[0])
        for g, rows in parts:
            z = np.matmul(h[rows], p["U"][g].T, out=logits[1][rows])
            z += p["bu"][g]
        got = np.zeros(n + 1, h.dtype)  # the last place is of rows without an id
        for z, i in zip(logits, (c, inside)):
            np.clip(z, -STEEP, STEEP, out=z)
            got[:n] += z[at, i]
            np.exp(z, out=z)
            total = z @ np.ones(z.shape[1], z.dtype)
            got[:n] -= np.log(total)
            if grads is not None:
                z *= (1 / total)[:, None]
                z[at, i] -= 1
        if grads is None:
            return got[back], None
        ones, dh = np.ones(n, h.dtype), np.zeros((n + 1, WIDTH), h.dtype)
        grads["Wc"], grads["bc"] = h.T @ logits[0], ones @ logits[0]
        grads["U"], grads["bu"] = np.zeros_like(p["U"]), np.zeros_like(p["bu"])
        for g, rows in parts:
            z = logits[1][rows]
            np.matmul(z.T, h[rows], out=grads["U"][g])
            np.matmul(ones[rows], z, out=grads["bu"][g])
            np.matmul(z, p["U"][g], out=dh[rows])
        dh[:n] += logits[0] @ p["Wc"].T
        return got[back], np.take(dh, back, axis=0)

    def log_probability(self, x: np.ndarray, y: np.ndarray, first: bool) -> np.ndarray:
        """Log probability (natural) of the targets of each window, summed in double precision."""
        return self._predict(self._body(x, first)["h"], y.ravel())[0].reshape(y.shape).sum(1, dtype=np.float64)

    def gradients(self, x: np.ndarray, y: np.ndarray, first: bool) -> tuple[float, dict]:
        """Mean loss of the targets of some windows and its gradients."""
        p, d, f, g = self.p, WIDTH, self._body(x, first), {}
        logs, dh = self._predict(f["h"], y.ravel(), g)
        n, mine = max(1, int((y >= 0).sum())), x[:, CONTEXT:]
        u, r, s = f["u"], f["r"], f["s"]
        dr = dh @ p["W2"].T
        dr *= r > 0
        g["W2"], g["W1"], g["b1"] = r.T @ dh, u.T @ dr, np.ones(len(dr), s.dtype) @ dr
        dh += dr @ p["W1"].T
        du = dh.reshape(*mine.shape, d)
        dkv = np.empty((*x.shape, 2 * d), s.dtype)
        ds = du @ f["v"].transpose(0, 2, 1)
        ds -= np.einsum("wid,wid->wi", du, f["a"])[..., None]
        ds *= s
        summed, causal = np.ones(len(x), s.dtype) @ ds.reshape(len(x), -1), self.distance >= 0
        g["near"] = np.bincount(self.distance[causal], summed.reshape(self.distance.shape)[causal], CONTEXT + STRIDE).astype(s.dtype)[None]
        np.matmul(ds.transpose(0, 2, 1), f["q"], out=dkv[..., :d])
        np.matmul(s.transpose(0, 2, 1), du, out=dkv[..., d:])
        # context that ends the window before is added there; other context is rows of its own
        follows = np.append(False, (x[1:, :CONTEXT] == x[:-1, STRIDE:]).all(1))
        after, alone = np.flatnonzero(follows), np.flatnonzero(~follows)
        dkv[after - 1, STRIDE:] += dkv[after, :CONTEXT]
        rows = np.zeros((mine.size + alone.size * CONTEXT, 4 * d), s.dtype)
        own, rest = rows[: mine.size].reshape(*mine.shape, -1), rows[mine.size :].reshape(len(alone), CONTEXT, -1)
        np.matmul(ds, f["k"], out=own[..., :d])
        own[..., d : 2 * d] = du
        own[..., 2 * d :] = dkv[:, CONTEXT:]
        rest[..., 2 * d :] = dkv[alone, :CONTEXT]
        dq, de, dk, dv = np.hsplit(_added_by_id(rows, np.append(mine.ravel(), x[alone, :CONTEXT].ravel()), self.size + 1), 4)
        scale, e, dp = np.float32(d**-0.5), p["E"], dv @ p["Wo"].T
        both = np.hstack([dq, dk, dp])
        g["Wo"], (g["Wq"], g["Wk"], g["Wv"]) = f["plain"].T @ dv, np.hsplit(e.T @ both, 3)
        g["Wq"] = g["Wq"] * scale
        g["E"] = de + both @ np.vstack([(p["Wq"] * scale).T, p["Wk"].T, p["Wv"].T])
        return -float(logs.sum()) / n, {k: a / n for k, a in g.items()}


def _added_by_id(rows: np.ndarray, ids: np.ndarray, size: int) -> np.ndarray:
    """The sum of the rows of each id: ids of few rows at a time those of as many, others one by one."""
    order, counts = np.argsort(ids.astype(np.min_scalar_type(size)), kind="stable"), np.bincount(ids, minlength=size)
    rows, ends, few = np.take(rows, order, axis=0), np.cumsum(counts), 8
    out, ones = np.zeros((size, rows.shape[1]), rows.dtype), np.ones(len(rows), rows.dtype)
    for n in range(1, few + 1):
        some = np.flatnonzero(counts == n)
        out[some] = np.take(rows, ends[some, None] - np.arange(n, 0, -1), axis=0).sum(1)
    for i in np.flatnonzero(counts > few).tolist():
        np.matmul(ones[: counts[i]], rows[ends[i] - counts[i] : ends[i]], out=out[i])
    return out


class Adam:
    """Steps of a model along its gradients."""

    def __init__(self, model: Attention):
        self.model, self.steps = model, 0
        self.mean, self.square = ({k: np.zeros_like(v) for k, v in model.p.items()} for _ in range(2))

    def step(self, grads: dict, rate: float) -> None:
        self.steps += 1
        for k, g in grads.items():
            self.mean[k] += 0.1 * (g - self.mean[k])
            self.square[k] += 0.01 * (g * g - self.square[k])
            fix = (1 - 0.9**self.steps) / math.sqrt(1 - 0.99**self.steps)
            self.model.p[k] -= np.float32(rate / fix) * self.mean[k] / (np.sqrt(self.square[k]) + np.float32(1e-8))


def fit_model(flat: np.ndarray, per: np.ndarray, size: int, seed: int = 5) -> Attention:
    """Adam over the windows of all texts in a random order, with a falling rate."""
    follows = np.zeros((size, size))
    np.add.at(follows, (np.append(flat[-1:], flat[:-1]), flat), 1)
    model = Attention(size, follows, seed)
    chunks = list(windows(flat, per, size)) if len(per) else []
    sets = [tuple(np.concatenate(x) for x in zip(*((c[1], c[2]) for c in chunks if c[3] == first))) for first in (True, False) if any(c[3] == first for c in chunks)]
    batches = [(x[s : s + WINDOWS], y[s : s + WINDOWS], first) for (x, y), first in zip(sets, (True, False)) for s in range(0, len(x), WINDOWS)]
    rng = np.random.default_rng(seed)
    for x, y in sets:  # windows of a step come from all over the texts
        order = rng.permutation(len(x))
        x[:], y[:] = x[order], y[order]
    adam = Adam(model)
    steps = min(STEPS, EPOCHS * len(batches))
    for step in range(steps):
        if step % len(batches) == 0:
            order = rng.permutation(len(batches))
        _, grads = model.gradients(*batches[order[step % len(batches)]])
        adam.step(grads, RATE * (1 - 0.95 * step / steps))
    return model


# over a corpus


class Model:
    """What scoring needs: the subwords that are kept, the fitted attention, and counts of the training words."""

    def __init__(self, path: str, kept: tuple[int, ...], attention: Attention, words: DataFrame, tokens: int, types: int, ends: int):
        self.path, self.kept, self.attention = path, kept, attention
        self.words, self.tokens, self.types, self.ends = words, tokens, types, ends


def count_words(docs: DataFrame, train: Column, text: str = "text") -> DataFrame:
    """(word, n, n_train): how often each word occurs in all whole texts, and in those of ``train``."""
    rows = by_bytes(docs.select(F.col(text).alias("t"), F.coalesce(train, F.lit(False)).alias("train")))
    return rows.mapInArrow(_tally, "word string, n bigint, n_train bigint").groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_train").alias("n_train"))


def _sample(docs: DataFrame, train: Column, id_col: str, text: str) -> DataFrame:
    """Whole training texts to start on: those of the ids with the smallest hashes, as many as SAMPLE_ROWS and
    SAMPLE_BYTES hold."""
    ids = hashed_sample(docs.where(train & F.col(id_col).isNotNull() & (F.octet_length(text) <= SAMPLE_BYTES // 8)).select(id_col).distinct(), id_col, SAMPLE_ROWS)
    some = docs.join(F.broadcast(ids), id_col).groupBy(id_col).agg(F.min(text).alias("t"))
    some = materialize(some.select(F.xxhash64(id_col).alias("order"), F.col(id_col).alias("id"), "t"), "lm-sample")
    sizes = some.select("order", "id", F.coalesce(F.octet_length("t"), F.lit(0)).alias("n")).toPandas().sort_values(["order", "id"])
    fits = sizes[sizes["n"].cumsum() <= SAMPLE_BYTES]
    return some.where(F.col("order") <= int(fits["order"].max())) if 0 < len(fits) < len(sizes) else some


def _learned(sent):
    """A task's model after its windows, times their targets, as a row."""

    def run(batches):
        path, kept, model = sent.value
        model = cloudpickle.loads(cloudpickle.dumps(model))  # the broadcast one stays as it is
        subwords, adam, n = _subwords(path, kept), Adam(model), 0
        for batch in batches:
            for _, x, y, first in windows(*subword_ids(*word_lists(batch.column("t")), subwords), subwords.size):
                adam.step(model.gradients(x, y, first)[1], PASS_RATE)
                n += int((y >= 0).sum())
        if n:
            weights = np.concatenate([model.p[k].ravel() for k in sorted(model.p)]).astype(np.float64) * n
            yield pa.RecordBatch.from_pydict({"at": pa.array([TaskContext.get().partitionId() % SUMS], pa.int32()), "n": [n], "weights": [weights.tobytes()]})

    return run


def _added(rows: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(w) for w in rows["weights"])
    return pd.DataFrame({"at": rows["at"][:1], "n": [rows["n"].sum()], "weights": [total.tobytes()]})


def learn(docs: DataFrame, path: str, kept: tuple[int, ...], attention: Attention, text: str = "text") -> Attention:
    """``attention`` after one pass over all windows of the texts: the mean of the tasks' models by their targets.

    Models are added up in SUMS rows by shuffle; the driver sees those only."""
    kind = "at int, n bigint, weights binary"
    sent = docs.sparkSession.sparkContext.broadcast((path, kept, attention))
    sums = by_bytes(docs.select(F.col(text).alias("t"))).mapInArrow(_learned(sent), kind).groupBy("at").applyInPandas(_added, kind).collect()
    if not sums:
        return attention
    weights, at = sum(np.frombuffer(r["weights"]) for r in sums) / sum(r["n"] for r in sums), 0
    for k in sorted(attention.p):
        size = attention.p[k].size
        attention.p[k] = weights[at : at + size].reshape(attention.p[k].shape).astype(np.float32)
        at += size
    return attention


def fit(docs: DataFrame, train: Column, path: str, id_col: str = "doc_id", text: str = "text") -> Model:
    """Count all words, choose the subwords to keep by all training words, and fit the attention.

    ``path`` names a file of ranks (one subword a line) that every executor has. Counts are those of all whole
    texts. The attention starts from a fit on some (SAMPLE_ROWS, SAMPLE_BYTES), in a task; where there are more, it
    then learns from every window of all training texts, each task from its own, and the tasks' models are averaged."""
    words = materialize(count_words(docs, train, text), "lm-words")
    known = words.where("n_train > 0")
    total = known.agg(F.coalesce(F.sum("n_train"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    ends = docs.where(train).count()
    often = known.mapInArrow(_subword_counts(path), "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    kept = tuple(r["id"] for r in often.orderBy(F.desc("n"), "id").limit(KEPT).collect())

    def run(batches):
        subwords = Subwords(path, kept)
        texts = sorted(((i, t) for b in batches for i, t in zip(b["id"], b["t"])), key=lambda r: r[0])
        lists = pa.array([t for _, t in texts], pa.string())
        yield pd.DataFrame({"model": [cloudpickle.dumps(fit_model(*subword_ids(*word_lists(lists), subwords), subwords.size))]})

    some = _sample(docs, train, id_col, text)
    got = some.select("id", "t").repartition(1).mapInPandas(run, "model binary").collect()
    attention = cloudpickle.loads(got[0]["model"]) if got else Attention(257 + len(kept), np.zeros((257 + len(kept),) * 2))
    if some.count() < ends:
        attention = learn(docs.where(train), path, kept, attention, text)
    return Model(path, kept, attention, words, total["n"] + ends, total["v"] + (ends > 0), ends)


def _hot(words: DataFrame) -> int:
    """The least power of two of which all words that occur as often have at most HOT_BYTES."""
    level = F.floor(F.log2("n")).cast("int")
    rows = words.groupBy(level.alias("level")).agg(F.sum(F.octet_length("word") + 48).alias("b")).collect()
    room, least = HOT_BYTES, 63
    for r in sorted(rows, key=lambda r: -r["level"]):
        room -= r["b"]
        if room < 0:
            break
        least = r["level"]
    return 1 << least if least < 63 else 2**62


def _scores(sent):
    """A row per text: words, known words, sum of logarithms of smoothed counts, the model's score, and the
    words whose counts did not come along."""

    def run(batches):
        path, kept, attention, hot_words, hot_counts = sent.value
        subwords, attention, number = _subwords(path, kept), attention.finish(), 0
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            words, sizes = word_lists(batch.column("t"))
            text = np.repeat(np.arange(rows), sizes)
            coded = words.dictionary_encode()
            place = pc.index_in(coded.dictionary, hot_words).fill_null(-1).to_numpy()
            at = place[coded.indices.to_numpy()] if len(words) else np.zeros(0, np.int64)
            hot = at >= 0
            counts = hot_counts[at[hot]]
            base = np.bincount(text[hot], np.log10(counts + 0.5), rows).astype(np.float64)  # of nothing it is whole numbers
            known = np.bincount(text[hot], counts > 0, rows).astype(np.int64)
            rare, rare_sizes = words.filter(pa.array(~hot)), np.bincount(text[~hot], minlength=rows)
            flat, per = subword_ids(coded, sizes, subwords)
            score = np.zeros(rows)
            for t, x, y, first in windows(flat, per, subwords.size):
                score += np.bincount(t, attention.log_probability(x, y, first), rows)
            keys = (TaskContext.get().partitionId() << 33) + number + np.arange(rows)
            number += rows
            offsets = pa.array(np.append(0, np.cumsum(rare_sizes)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys), batch.column("id"), batch.column("train"), pa.array(sizes + 1), pa.array(known), pa.array(base),
                 pa.array(score / math.log(10)), pa.ListArray.from_arrays(offsets, rare)],
                ["key", "id", "train", "n_tokens", "known", "base", "score", "rare"],
            )

    return run


def score(docs: DataFrame, model: Model, train: Column, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every whole text.

    Tokens are the words (A-Z in lower case, cut at ASCII spaces) and one end. ``base_score`` is the sum of
    log10((c + 0.5) / (N + 0.5 (V + 1))) over them, from the counts of all training texts; ``score`` is the model's log10
    probability of the words and the end: the attention predicts the subword ids of the text one after another, each once,
    from the 8 to 24 ids before it.

    Counts of frequent words (at most HOT_BYTES) go to every task; other words are joined by shuffle, where none is hot.
    A null text is empty: its only token is the end. Rows without id are training texts, as is every id whose fold is;
    repeated rows count and are scored each. Long texts are many windows like others. Extra columns
    are ignored; an empty table gives no rows.
    """
    words, spark = model.words, docs.sparkSession
    least = _hot(words)
    hot = words.where(F.col("n") >= least).select("word", "n_train").toArrow().combine_chunks()
    hot_words = hot["word"].chunk(0) if len(hot) else pa.array([], pa.string())
    sent = spark.sparkContext.broadcast((model.path, model.kept, model.attention, hot_words, hot["n_train"].to_numpy()))
    rows = by_bytes(docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(train, F.lit(False)).alias("train"), F.col(text).alias("t")))
    scored = rows.mapInArrow(_scores(sent), "key bigint, id bigint, train boolean, n_tokens bigint, known bigint, base double, score double, rare array<string>")
    scored = materialize(scored, "lm-scored")
    rest = scored.where(F.size("rare") > 0).select("key", F.explode("rare").alias("word"))
    c = F.coalesce("n_train", F.lit(0))
    counts = words.where(F.col("n") < least).select("word", "n_train")
    rest = rest.join(broadcast_if_small(counts, size=4 << 20), "word", "left").groupBy("key").agg(
        F.sum(F.log10(c + 0.5)).alias("rare_base"), F.sum((c > 0).cast("bigint")).alias("rare_known")
    )
    below = math.log10(model.tokens + 0.5 * (model.types + 1))
    out = scored.drop("rare").join(rest, "key", "left")
    return out.select(
        F.col("id").alias("doc_id"), (~F.col("train")).alias("held_out"), "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0)) + (1 if model.ends else 0)).alias("n_known"),
        F.lit(model.tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0)) + math.log10(model.ends + 0.5) - F.col("n_tokens") * below).alias("base_score"),
        "score",
    )
