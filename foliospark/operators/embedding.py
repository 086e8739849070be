"""Embedding of texts: prefixes, batches with zero vectors at blank places, unit length; a deterministic stand-in and a model provider."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from foliospark.functions.regex import is_blank
from foliospark.operators.predicates import require_text


class Embedder(Protocol):
    """What a provider offers; it is built once by each Python worker."""

    dimension: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


@dataclass(frozen=True)
class HashingEmbedder:
    """Signed feature hashing of lower-case words: the same vector for the same text everywhere, no model's quality."""

    dimension: int = 768

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension), np.float32)
        for i, t in enumerate(texts):
            codes = np.array([zlib.crc32(w.encode()) for w in t.lower().split()], np.int64)
            if len(codes):
                np.add.at(out[i], (codes >> 1) % self.dimension, np.where(codes & 1, 1.0, -1.0).astype(np.float32))
        return out


@dataclass(frozen=True)
class SentenceModel:
    """A sentence-transformers model, where that library and the model's files are installed."""

    name: str
    dimension: int = 768
    batch: int = 32

    def encode(self, texts: list[str]) -> np.ndarray:
        from sentence_transformers import SentenceTransformer

        if self.name not in _MODELS:
            _MODELS[self.name] = SentenceTransformer(self.name)
        return np.asarray(_MODELS[self.name].encode(texts, batch_size=self.batch, normalize_embeddings=False), np.float32)


_MODELS: dict = {}


def unit_rows(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def add_prefix(text: Column, is_query: bool = False, query: str = "query: ", passage: str = "passage: ") -> Column:
    return F.concat(F.lit(query if is_query else passage), text)


def l2_normalize(vector: Column) -> Column:
    """The vector at unit length in double precision; zero vectors and null stay as they are."""
    v = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)


def embed_column(text: Column, embedder: Embedder, batch: int = 32, normalize: bool = True) -> Column:
    """A vector for every text, a zero vector for blank and null ones; the model sees batches of the others only."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            out = np.zeros((len(s), embedder.dimension), np.float32)
            full = [i for i, t in enumerate(s) if t is not None and t.strip()]
            for at in range(0, len(full), batch):
                part = full[at : at + batch]
                x = embedder.encode([s.iloc[i] for i in part])
                out[part] = unit_rows(x) if normalize else x
            yield pd.Series(list(out))

    return run(text)


def embed_documents(df: DataFrame, embedder: Embedder, text: str = "content", prefix: str = "passage: ", normalize: bool = True) -> DataFrame:
    """df with the column embedding; the prefix is put before texts that are not blank."""
    prefixed = F.when(is_blank(F.col(text)), F.lit("")).otherwise(F.concat(F.lit(prefix), F.col(text)))
    return df.withColumn("embedding", embed_column(prefixed, embedder, normalize=normalize))


def embed_batch(texts: list[str | None], embedder: Embedder, prefix: str = "passage: ", batch: int = 32, normalize: bool = True) -> np.ndarray:
    """The vectors of a list of texts on the driver, zero at blank places. An empty list, or one of blank texts alone, is an error."""
    full = [i for i, t in enumerate(texts) if t is not None and t.strip()]
    if not full:
        raise ValueError("there is no text to embed")
    out = np.zeros((len(texts), embedder.dimension), np.float32)
    for at in range(0, len(full), batch):
        part = full[at : at + batch]
        x = embedder.encode([prefix + str(texts[i]) for i in part])
        out[part] = unit_rows(x) if normalize else x
    return out


def with_throughput(df: DataFrame, name: str = "embedded") -> tuple[DataFrame, Observation]:
    """df and an observation of its rows and embedded rows, which has its counts once an action on df is done."""
    seen = Observation(name)
    full = F.exists("embedding", lambda x: x != 0)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), F.count(F.when(full, 1)).alias("embedded")), seen


def embed_single(text: str, embedder: Embedder, is_query: bool = False, query: str = "query: ", passage: str = "passage: ", normalize: bool = True) -> list[float]:
    """The vector of one text on the driver; a blank text is an error. Queries get the passage prefix unless is_query is set."""
    x = embedder.encode([(query if is_query else passage) + require_text(text)])
    return [float(v) for v in (unit_rows(x) if normalize else x)[0]]
