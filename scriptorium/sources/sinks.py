"""Table sinks as functions (target, batch) -> new target, and appends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def replace_chunks(chunks: DataFrame, new: DataFrame) -> DataFrame:
    """Chunks with all chunks of the documents in ``new`` replaced."""
    return chunks.join(new.select("document_id").distinct(), "document_id", "left_anti").unionByName(new, allowMissingColumns=True)


def valid_embeddings(batch: DataFrame, *, strict: bool = False) -> DataFrame:
    """Embeddings that belong to a document or a chunk; ``strict`` raises if others are among them."""
    owned = F.col("document_id").isNotNull() | F.col("chunk_id").isNotNull()
    if strict and batch.filter(~owned).limit(1).count():
        raise ValueError("an embedding belongs to neither a document nor a chunk")
    return batch.filter(owned)


def append(batch: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Appends to a Parquet table (api_usage, embeddings, job_events)."""
    writer = batch.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def publish(df: DataFrame, root: str, version: str) -> str:
    """Writes a snapshot beside the one being read and returns its path."""
    path = f"{root}/{version}"
    df.write.mode("errorifexists").parquet(path)
    return path
