"""Batched embedding through an injected provider."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from evidex.functions.text import strip
from evidex.functions.vectors import is_valid_vector


class EmbeddingProvider(Protocol):
    model: str
    dimension: int

    def embed(self, texts: Sequence[str]) -> Sequence[Sequence[float]]: ...


class HashEmbedder:
    """Deterministic stand-in for a model: signed feature hashing of words, L2-normalised."""

    def __init__(self, dimension: int = 64, model: str = "feature-hash") -> None:
        self.dimension = dimension
        self.model = f"{model}-{dimension}"

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        return [self._one(text).tolist() for text in texts]

    def _one(self, text: str) -> np.ndarray:
        codes = np.array(
            [zlib.crc32(w.encode()) for w in re.findall(r"\w+", text.lower())], dtype=np.int64
        )
        signs = np.where(codes & 1, 1.0, -1.0)
        vector = np.bincount(
            (codes >> 1) % self.dimension, weights=signs, minlength=self.dimension
        )
        norm = np.linalg.norm(vector)
        return vector / norm if norm else vector


def embedding_of(text: Column, provider: EmbeddingProvider, batch_size: int = 128) -> Column:
    """Vectors of a text column, ``batch_size`` texts per provider call.

    A failing call or a wrong count gives null vectors, which ``is_valid_vector`` rejects.
    """
    if batch_size < 1:
        raise ValueError("batch_size must be positive")

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            vectors: list = []
            for start in range(0, len(batch), batch_size):
                vectors += _call(provider, batch.iloc[start : start + batch_size].tolist())
            yield pd.Series(vectors, dtype="object")

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, ArrayType(FloatType()))(text)


def _call(provider: EmbeddingProvider, texts: list[str]) -> list:
    try:
        vectors = [list(v) for v in provider.embed(texts)]
    except Exception:  # noqa: BLE001 - one failing batch must not end the job
        return [None] * len(texts)
    return vectors if len(vectors) == len(texts) else [None] * len(texts)


def embed_chunks(
    chunks: DataFrame, provider: EmbeddingProvider, batch_size: int = 128
) -> DataFrame:
    """Chunks with embedding, embedding_model and ``valid``.

    Blank texts get no vector and are invalid.
    """
    text = F.when(strip(F.col("content")) != "", F.col("content"))
    return (
        chunks.withColumn("embedding", embedding_of(text, provider, batch_size))
        .withColumn("embedding_model", F.lit(provider.model))
        .withColumn(
            "valid",
            (strip(F.col("content")) != "")
            & is_valid_vector(F.col("embedding"), provider.dimension),
        )
    )


def embed_queries(
    queries: DataFrame, provider: EmbeddingProvider, batch_size: int = 128
) -> DataFrame:
    """Vector per query from its semantic query, else its text (F5): query_id, embedding.

    Each distinct text is embedded once.
    """
    text = F.coalesce("semantic_query", "text")
    wanted = queries.select("query_id", text.alias("prompt")).filter("prompt is not null")
    vectors = wanted.select("prompt").distinct().withColumn(
        "embedding", embedding_of(F.col("prompt"), provider, batch_size)
    )
    valid = vectors.filter(is_valid_vector(F.col("embedding"), provider.dimension))
    return wanted.join(valid, "prompt").select("query_id", "embedding")
