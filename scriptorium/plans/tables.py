"""The given tables in the shape of the model's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PROVIDERS = ("view", "click", "purchase", "error", "signup")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with text; every seventh has no save date, every ninth no category."""
    d = table(spark, sf_dir, "documents")
    saved = F.when(F.col("doc_id") % 7 != 0, F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 60).cast("int")).cast("timestamp"))
    return d.select(
        F.col("doc_id").alias("id"), "source", F.col("doc_id").cast("string").alias("provider_id"), F.concat(F.lit("https://www."), "source", F.lit(".example.com/"), F.col("doc_id").cast("string")).alias("url_original"),
        F.substring("text", 1, 40).alias("title"), F.when(F.col("doc_id") % 5 == 0, F.col("source")).alias("author"), saved.alias("saved_at"), F.when(F.col("doc_id") % 11 != 0, F.col("text")).alias("fulltext"),
        F.lit(None).cast("string").alias("summary"), F.when(F.col("doc_id") % 9 != 0, F.col("lang")).alias("category"), F.col("n_chars").cast("long").alias("word_count"),
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as chunks of documents."""
    c = table(spark, sf_dir, "conversations")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("document_id"), F.col("turn").cast("int").alias("chunk_index"), F.col("text").alias("chunk_text"))


def highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns as highlights."""
    c = table(spark, sf_dir, "conversations").filter("role = 'user'")
    at = F.date_add(F.lit("2024-02-01").cast("date"), (F.col("turn") % 20).cast("int")).cast("timestamp")
    return c.select(F.col("conv_id").alias("document_id"), F.col("turn").alias("seq"), "text", at.alias("highlighted_at"))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of chunks; every tenth belongs to a document, two models take turns."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 10 == 0, F.col("label").cast("long")).alias("document_id"), F.when(F.col("vec_id") % 10 != 0, F.col("label").cast("long") * 1000 + F.col("vec_id") % 6).alias("chunk_id"),
        F.lit("local").alias("provider"), F.when(F.col("vec_id") % 2 == 0, "even").otherwise("odd").alias("model"), "embedding", F.size("embedding").alias("dimensions"),
    )


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as calls of services."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("ts").cast("timestamp").alias("timestamp"), F.col("event_type").alias("provider"), F.when(F.col("user_id") % 2 == 0, "embed").otherwise("chat").alias("operation"), F.when(F.col("user_id") % 3 == 0, "gpt-4o").otherwise("text-embedding-3-small").alias("model"),
        F.col("user_id").alias("tokens_input"), (F.col("user_id") % 10).alias("tokens_output"), F.col("value").alias("cost_usd"), F.when(F.col("event_id") % 4 != 0, F.col("value") * 10).alias("latency_ms"), (F.col("event_type") != "error").alias("success"),
    )


def failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every thirteenth document failed to load."""
    d = table(spark, sf_dir, "documents").filter("doc_id % 13 = 0")
    kind = F.when(F.col("doc_id") % 2 == 0, "timeout").when(F.col("doc_id") % 3 == 0, "http_5xx").otherwise("paywall")
    return d.select(F.col("doc_id").alias("document_id"), F.lit("job").alias("job_id"), F.concat(F.lit("https://"), "source").alias("url"), kind.alias("error_type"), F.lit(None).cast("string").alias("error_message"), F.lit(None).cast("int").alias("http_status"), F.lit(0).alias("retry_count"), F.lit(None).cast("timestamp").alias("last_attempt"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


#: The same shapes in DuckDB SQL, for oracles.
SQL = {
    "docs": """docs AS (SELECT doc_id AS id, source, CAST(doc_id AS VARCHAR) AS provider_id, 'https://www.' || source || '.example.com/' || doc_id AS url_original, substr(text, 1, 40) AS title,
        CASE WHEN doc_id % 5 = 0 THEN source END AS author, CASE WHEN doc_id % 7 <> 0 THEN DATE '2024-01-01' + CAST(doc_id % 60 AS INTEGER) END AS saved_at, CASE WHEN doc_id % 11 <> 0 THEN text END AS fulltext,
        CASE WHEN doc_id % 9 <> 0 THEN lang END AS category, CAST(n_chars AS BIGINT) AS word_count FROM documents)""",
    "chunks": "chunks AS (SELECT conv_id * 1000 + turn AS id, conv_id AS document_id, CAST(turn AS INTEGER) AS chunk_index, text AS chunk_text FROM conversations)",
    "highlights": "highlights AS (SELECT conv_id AS document_id, turn AS seq, text, DATE '2024-02-01' + CAST(turn % 20 AS INTEGER) AS highlighted_at FROM conversations WHERE role = 'user')",
    "emb": """emb AS (SELECT vec_id AS id, CASE WHEN vec_id % 10 = 0 THEN CAST(label AS BIGINT) END AS document_id, CASE WHEN vec_id % 10 <> 0 THEN CAST(label AS BIGINT) * 1000 + vec_id % 6 END AS chunk_id,
        'local' AS provider, CASE WHEN vec_id % 2 = 0 THEN 'even' ELSE 'odd' END AS model, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings)""",
    "usage": """usage AS (SELECT ts AS timestamp, event_type AS provider, CASE WHEN user_id % 2 = 0 THEN 'embed' ELSE 'chat' END AS operation, CASE WHEN user_id % 3 = 0 THEN 'gpt-4o' ELSE 'text-embedding-3-small' END AS model,
        user_id AS tokens_input, user_id % 10 AS tokens_output, value AS cost_usd, CASE WHEN event_id % 4 <> 0 THEN value * 10 END AS latency_ms, event_type <> 'error' AS success FROM events)""",
    "failures": "failures AS (SELECT doc_id AS document_id, CASE WHEN doc_id % 2 = 0 THEN 'timeout' WHEN doc_id % 3 = 0 THEN 'http_5xx' ELSE 'paywall' END AS error_type FROM documents WHERE doc_id % 13 = 0)",
}


def with_tables(names: str, body: str) -> str:
    return "WITH " + ",\n".join(SQL[n] for n in names.split()) + "\n" + body
