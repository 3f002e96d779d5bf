"""Embedding jobs: any batch function as a column, and the missing-work composition around it."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.text import chunk_for_embedding, embedding_text, estimate_tokens, truncate_at_space
from scriptorium.operators.chunking import chunk_documents
from scriptorium.operators.library import chunk_candidates, without_embedding

Embedder = Callable[[list[str]], list[list[float]]]


def hashing_embedder(dimensions: int = 64) -> Embedder:
    """Signed hashed word counts of unit length: deterministic, for tests and for offline use."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), dimensions))
        for row, text in zip(out, texts, strict=True):
            for word in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                row[(h >> 1) % dimensions] += 1 if h & 1 else -1
        return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).tolist()

    return embed


def embed_column(text: Column, embedder: Embedder, batch_size: int = 200) -> Column:
    """The vector of each text, in batches of ``batch_size``; NULL for NULL."""

    @F.arrow_udf("array<float>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            own = texts.to_pylist()
            known = [i for i, x in enumerate(own) if x is not None]
            out: list = [None] * len(own)
            for k in range(0, len(known), batch_size):
                some = known[k : k + batch_size]
                for i, vector in zip(some, embedder([own[i] for i in some]), strict=True):
                    out[i] = vector
            yield pa.array(out, pa.list_(pa.float32()))

    return run(text)


def embed_documents(docs: DataFrame, embeddings: DataFrame, embedder: Embedder, *, provider: str, model: str, limit: int | None = None) -> DataFrame:
    """New embedding rows for documents without a vector of the model."""
    todo = without_embedding(docs, embeddings, key="document_id", provider=provider, model=model)
    todo = todo if limit is None else todo.orderBy("id").limit(limit)
    text = truncate_at_space(embedding_text(F.col("title"), F.col("author"), F.col("summary"), F.col("fulltext")))
    return _rows(todo.select(F.col("id").alias("document_id"), F.lit(None).cast("long").alias("chunk_id"), text.alias("text")), embedder, provider, model)


def embed_chunks(docs: DataFrame, chunks: DataFrame, embeddings: DataFrame, embedder: Embedder, *, provider: str, model: str) -> tuple[DataFrame, DataFrame]:
    """Chunks what is not chunked yet, then embeds all chunks without a vector: (new chunks, new embeddings).

    Chunk ids are derived from document and index, so a repeated run makes the same rows.
    """
    new = chunk_documents(chunk_candidates(docs, chunks)).withColumn("id", F.xxhash64("document_id", "chunk_index"))
    every = chunks.select("id", "document_id", "chunk_text").unionByName(new.select("id", "document_id", "chunk_text"))
    todo = without_embedding(every, embeddings, key="chunk_id", provider=provider, model=model)
    titled = todo.join(docs.select(F.col("id").alias("document_id"), "title"), "document_id", "left")
    text = chunk_for_embedding(F.col("chunk_text"), F.coalesce("title", F.lit("")))
    return new, _rows(titled.select("document_id", F.col("id").alias("chunk_id"), text.alias("text")), embedder, provider, model)


def _rows(todo: DataFrame, embedder: Embedder, provider: str, model: str) -> DataFrame:
    rows = todo.withColumn("embedding", embed_column(F.col("text"), embedder))
    return rows.select("document_id", "chunk_id", F.lit(provider).alias("provider"), F.lit(model).alias("model"), "embedding", F.size("embedding").alias("dimensions"), estimate_tokens(F.col("text")).alias("tokens"))


def usage_events(new: DataFrame, operation: str, price: float, now: str) -> DataFrame:
    """One usage row per provider and model for a batch of new embeddings."""
    sums = new.groupBy("provider", "model").agg(F.sum("tokens").alias("tokens_input"))
    return sums.select(F.lit(now).cast("timestamp").alias("timestamp"), "provider", "model", F.lit(operation).alias("operation"), "tokens_input", F.lit(0).cast("long").alias("tokens_output"), (F.col("tokens_input") / 1e6 * price).alias("cost_usd"), F.lit(True).alias("success"))
