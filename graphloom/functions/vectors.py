"""Vector arithmetic, the blob codec and embedders."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


GRAMS = 65_536  # hashes of byte windows that an embedder remembers


def l2_distance(a: Column, b: Column) -> Column:
    """Euclidean distance in double precision; infinite for unequal lengths."""
    total = F.aggregate(
        F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2)), F.lit(0.0), lambda s, v: s + v
    )
    return F.when(F.size(a) == F.size(b), F.sqrt(total)).otherwise(F.lit(float("inf")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for zero vectors and unequal lengths."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norms > 0), dot(a, b) / norms).otherwise(0.0)


def similarity(distance: Column) -> Column:
    return 1 / (1 + distance)


@F.pandas_udf(T.ArrayType(T.FloatType()))
def decode_blob(blobs: pd.Series) -> pd.Series:
    """Little-endian float32 blobs; null where the length is no multiple of four."""
    return blobs.map(lambda b: None if b is None or len(b) % 4 else np.frombuffer(b, "<f4").tolist())


@F.pandas_udf(T.BinaryType())
def encode_blob(vectors: pd.Series) -> pd.Series:
    return vectors.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())


class Embedder(Protocol):
    model: str
    dimension: int

    def embed(self, texts: list[str]) -> list[np.ndarray]: ...


class HashEmbedder:
    """Deterministic embedder for tests: hashed byte trigrams and single bytes, of unit length."""

    model, dimension = "mock", 1536

    def __init__(self):
        self._grams: dict[bytes, tuple] = {}

    def _spots(self, gram: bytes, step: int) -> tuple[np.ndarray, np.ndarray]:
        key = gram + bytes([step])
        if key not in self._grams:
            if len(self._grams) >= GRAMS:
                self._grams.clear()
            words = np.frombuffer(hashlib.sha256(gram).digest(), "<u4")[:: step // 4]
            value = words.astype("<i4").astype(np.float32) / np.float32(2**31 - 1)
            self._grams[key] = (words % self.dimension, value)
        return self._grams[key]

    def embed_one(self, text: str) -> np.ndarray:
        data = text.encode()
        out = np.zeros(self.dimension, np.float32)
        if not data:
            out[0] = 1.0
            return out
        window = min(3, len(data))
        for i in range(len(data) - window + 1):
            at, value = self._spots(data[i : i + window], 4)
            np.add.at(out, at, value)
        for i in range(len(data)):
            at, value = self._spots(data[i : i + 1] + b"_u", 8)
            np.add.at(out, at, value * np.float32(0.3))
        norm = float(np.sqrt((out.astype(np.float64) ** 2).sum()))
        return (out.astype(np.float64) / norm).astype(np.float32) if norm else out

    def embed(self, texts: list[str]) -> list[np.ndarray]:
        return [self.embed_one(t) for t in texts]


def make_embedder(provider: str | None, factories: dict | None = None) -> Embedder:
    """The named provider's embedder; the hashing one if there is none or it cannot be made."""
    make = (factories or {}).get(provider or "")
    try:
        return make() if make else HashEmbedder()
    except Exception:  # noqa: BLE001  a provider without credentials falls back, as documented
        return HashEmbedder()


def embed_column(text: Column, embedder: Embedder | None = None, batch: int = 32) -> Column:
    """Vectors of texts, ``batch`` at a time; a failing batch is retried text by text. Vectors leave a batch at a time, as
    arrays, so that a task holds few of them whatever its input."""
    chosen = embedder or HashEmbedder()

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            if texts.empty:
                yield pd.Series([], dtype=object)
            for at in range(0, len(texts), batch):
                part = texts.iloc[at : at + batch].fillna("").tolist()
                try:
                    out = [np.asarray(v, np.float32) for v in chosen.embed(part)]
                except Exception:  # noqa: BLE001
                    out = [np.asarray(chosen.embed([t])[0], np.float32) for t in part]
                yield pd.Series(out)

    return run(text)


def store_report(embeddings: DataFrame, model: str) -> DataFrame:
    """One row: count, distinct models, largest dimension, rows of other models."""
    return embeddings.agg(
        F.count("*").alias("n"), F.array_sort(F.collect_set("model")).alias("models"),
        F.max(F.size("embedding")).alias("dim"), F.count_if(F.col("model") != model).alias("mismatched"),
    )
