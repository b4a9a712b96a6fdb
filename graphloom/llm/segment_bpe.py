"""Byte-level BPE by segment trees over the ranks of adjacent pairs."""

from __future__ import annotations

import hashlib
import json
import sys
import types
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.batches import by_bytes

# Fixed values of the published byte-level scheme.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE = 500_000  # words that a worker remembers; only speed depends on it
NONE = np.iinfo(np.int64).max
LONG_BYTES = 2_048  # words from here on are encoded one by one; the ids are the same


def byte_symbols() -> dict[str, int]:
    """Character that stands for each byte: printable ones for themselves, the others from 256 up."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tables of a tokenizer file: byte ids, pair merges by rank, bytes of every id."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self._refuse(spec, path)
        byte, ids = byte_symbols(), spec["model"]["vocab"]
        self.bytes_of = {str(i): bytes(byte[c] for c in s) for s, i in ids.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {str(i): s.encode() for s, i in self.special.items()}
        self.byte_id = np.zeros(256, np.int64)
        for c, b in byte.items():
            self.byte_id[b] = ids[c]
        pairs = [x if isinstance(x, list) else x.split(" ") for x in spec["model"]["merges"]]
        keys = np.array([ids[a] << 32 | ids[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.pair_keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([ids[a + b] for a, b in pairs], np.int64)
        self.rank_of = dict(zip(self.pair_keys.tolist(), self.ranks.tolist()))

    @staticmethod
    def _refuse(spec: dict, path: str) -> None:
        """Files of another scheme than plain byte-level BPE are an error, as their ids would be wrong."""
        model, before, after = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("decoder") or {}
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
        odd += [k for k in ("single_word", "lstrip", "rstrip", "normalized") if any(t.get(k) for t in spec.get("added_tokens", []))]
        if spec.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or after.get("type") != "ByteLevel" or odd:
            raise ValueError(f"{path} is no plain byte-level BPE {odd}")

    def rank(self, left, right):
        """Ranks of pairs of ids; NONE where they do not merge or a side is missing (-1)."""
        key = left << 32 | np.maximum(right, 0)
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == key) & (left >= 0) & (right >= 0), self.ranks[at], NONE)


def _encode_same(words: list[bytes], size: int, vocab: Vocabulary) -> list[np.ndarray]:
    """Encode words of at most ``size`` bytes (a power of 2) together.

    Row w of ``tree`` is a segment tree over rank * size + position of the pairs of word w: its
    root is the leftmost lowest-rank pair. A round merges that pair in every word that has one
    and updates the paths of the three leaves that change.
    """
    n = len(words)
    length = np.fromiter(map(len, words), np.int64, n)
    sym = np.full((n, size), -1, np.int64)
    sym[np.arange(size) < length[:, None]] = vocab.byte_id[np.frombuffer(b"".join(words), np.uint8)]
    nxt = np.broadcast_to(np.arange(1, size + 1), (n, size)).copy()
    prv = np.broadcast_to(np.arange(-1, size - 1), (n, size)).copy()
    tree = np.full((n, 2 * size), NONE, np.int64)
    rank = vocab.rank(sym[:, :-1], sym[:, 1:])
    tree[:, size : 2 * size - 1] = np.where(rank == NONE, NONE, rank * size + np.arange(size - 1))
    level = size
    while level > 1:
        tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
        level //= 2

    def put(rows, leaf, value):
        node = leaf + size
        tree[rows, node] = value
        node = node >> 1
        while node[0] if len(node) else 0:
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            node = node >> 1

    rows = np.flatnonzero(tree[:, 1] != NONE)
    while len(rows):
        top = tree[rows, 1]
        i = top % size
        j = nxt[rows, i]
        after = nxt[rows, j]
        sym[rows, i] = vocab.merged[top // size]
        sym[rows, j] = -1
        nxt[rows, i] = after
        has = after < size
        prv[rows[has], after[has]] = i[has]
        right = np.where(has, sym[rows, np.minimum(after, size - 1)], -1)
        r = vocab.rank(sym[rows, i], right)
        put(rows, j, np.full(len(rows), NONE))
        put(rows, i, np.where(r == NONE, NONE, r * size + i))
        before = prv[rows, i]
        left = before >= 0
        lr, lb = rows[left], before[left]
        r = vocab.rank(sym[lr, lb], sym[lr, i[left]])
        put(lr, lb, np.where(r == NONE, NONE, r * size + lb))
        rows = rows[tree[rows, 1] != NONE]
    return [s[s >= 0] for s in sym]


def _encode_long(word: bytes, vocab: Vocabulary) -> np.ndarray:
    """Encode one long word with the same tree, a number at a time: it needs as many rounds as merges,
    and no other words share them."""
    n = len(word)
    size = 1 << (n - 1).bit_length()
    ids = vocab.byte_id[np.frombuffer(word, np.uint8)]
    first = vocab.rank(ids[:-1], ids[1:])
    leaves = np.full(2 * size, NONE, np.int64)
    leaves[size : size + n - 1] = np.where(first == NONE, NONE, first * size + np.arange(n - 1))
    level = size
    while level > 1:
        leaves[level // 2 : level] = np.minimum(leaves[level : 2 * level : 2], leaves[level + 1 : 2 * level : 2])
        level //= 2
    tree, sym = array("q", leaves.tobytes()), array("q", ids.astype(np.int64).tobytes())
    nxt, prv = array("q", range(1, n + 1)), array("q", range(-1, n - 1))
    none, rank_of, merged = int(NONE), vocab.rank_of, vocab.merged.tolist()

    def put(leaf: int, left: int, right: int) -> None:
        rank = rank_of.get(left << 32 | right) if right >= 0 else None
        node = leaf + size
        tree[node] = none if rank is None else rank * size + leaf
        node >>= 1
        while node:
            a, b = tree[2 * node], tree[2 * node + 1]
            least = a if a < b else b
            if tree[node] == least:
                break
            tree[node] = least
            node >>= 1

    while tree[1] != none:
        rank, i = divmod(tree[1], size)
        j = nxt[i]
        after = nxt[j]
        sym[i], sym[j], nxt[i] = merged[rank], -1, after
        put(j, 0, -1)
        if after < n:
            prv[after] = i
        put(i, sym[i], sym[after] if after < n else -1)
        if prv[i] >= 0:
            put(prv[i], sym[prv[i]], sym[i])
    out = np.frombuffer(sym, np.int64)
    return out[out >= 0].copy()


def encode_words(words: list[bytes], vocab: Vocabulary) -> list[np.ndarray]:
    """Ids of each word (a pre-token), words of like length together and long ones each."""
    out: list = [None] * len(words)
    groups: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        if len(w) >= LONG_BYTES:
            out[k] = _encode_long(w, vocab)
            continue
        groups.setdefault(max(2, 1 << (len(w) - 1).bit_length()), []).append(k)
    for size, members in groups.items():
        step = max(1, 2_000_000 // size)
        for at in range(0, len(members), step):
            part = members[at : at + step]
            for k, ids in zip(part, _encode_same([words[k] for k in part], size, vocab)):
                out[k] = ids
    return out


class Codec:
    """Encodes and decodes texts; ids of a text are kept as a string joined by commas."""

    def __init__(self, vocab: Vocabulary):
        self.vocab, self.known = vocab, {}
        self.words = regex.compile(PATTERN)
        self.special = regex.compile("(" + "|".join(map(regex.escape, vocab.special)) + ")") if vocab.special else None

    def split(self, text: str) -> list[str]:
        """Pre-tokens of a text; special tokens stand for themselves."""
        if not self.special or not any(s in text for s in self.vocab.special):
            return self.words.findall(text)
        return [w for p in self.special.split(text) for w in ([p] if p in self.vocab.special else self.words.findall(p))]

    def learn(self, words) -> None:
        words = list(words)
        coded = encode_words([w.encode() for w in words], self.vocab)
        self.known.update(zip(words, [",".join(map(str, x.tolist())) for x in coded]))
        self.known.update((s, str(i)) for s, i in self.vocab.special.items())

    def encode(self, texts: list[str]) -> list[str]:
        out = []
        for at in range(0, len(texts), 256):
            if len(self.known) > CACHE:
                self.known.clear()
            lists = [self.split(t) for t in texts[at : at + 256]]
            self.learn(set().union(*lists).difference(self.known))
            get = self.known.__getitem__
            out += [",".join(map(get, words)) for words in lists]
        return out

    def decode(self, ids: str) -> str:
        if not ids:
            return ""
        return b"".join(map(self.vocab.bytes_of.__getitem__, ids.split(","))).decode("utf-8", "replace")


def _codec(path: str) -> Codec:
    """The worker's codec, kept between tasks: Spark reuses Python workers."""
    held = sys.modules.setdefault("_graphloom_worker", types.ModuleType("_graphloom_worker")).__dict__.setdefault("codecs", {})
    if path not in held:
        held[path] = Codec(Vocabulary(path))
    return held[path]


def _digests(path: str):
    def run(batches):
        codec = _codec(path)
        for batch in batches:
            ids = codec.encode(batch["text"].fillna("").tolist())
            sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
            yield pd.DataFrame({
                "doc_id": batch["doc_id"],
                "n_tokens": [s.count(",") + 1 if s else 0 for s in ids],
                "ids_sha256": [sha(s) for s in ids],
                "decoded_sha256": [sha(codec.decode(s)) for s in ids],
            })

    return run


def encode(df: DataFrame, path: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """Add the token ids (array<int>) of every whole text; a null text counts as empty.

    ``path`` names the tokenizer file (json, byte-level BPE) on every executor.
    """

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = _codec(path)
        for texts in batches:
            yield pd.Series([np.array(s.split(",") if s else [], np.int32) for s in codec.encode(texts.fillna("").tolist())])

    return by_bytes(df).withColumn(out_col, ids(F.col(text_col)))


def decode(df: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Add the text of every id list; null counts as empty, bytes that are not UTF-8 become U+FFFD."""

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = _codec(path)
        for lists in batches:
            yield pd.Series([codec.decode("" if x is None else ",".join(map(str, x))) for x in lists])

    return by_bytes(df).withColumn(out_col, text(F.col(ids_col)))


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every whole text, encoded and then decoded.

    Null texts count as empty; repeated rows each give one; extra columns are ignored.
    """
    return by_bytes(docs).select("doc_id", "text").mapInPandas(
        _digests(path), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )
