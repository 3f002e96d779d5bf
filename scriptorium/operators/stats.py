"""Statistics of the library, the pipeline, the embeddings and the usage of services."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions.text import in_day_range, in_period, reading_hours
from scriptorium.operators.library import is_empty, orphans, where

#: US dollars a million tokens of embedding models, and of chat models (input, output).
EMBEDDING_PRICES = {"text-embedding-3-small": 0.02, "text-embedding-3-large": 0.13, "nomic-embed-text": 0.0, "mxbai-embed-large": 0.0}
CHAT_PRICES = {"gpt-4.1-nano": (0.10, 0.40), "gpt-4.1-mini": (0.40, 1.60), "gpt-4o-mini": (0.15, 0.60), "gpt-4o": (2.50, 10.00)}
DEFAULT_CHAT_MODEL = "gpt-4.1-mini"


def model_prices(spark: SparkSession) -> DataFrame:
    """Prices as a table: model, cost_in, cost_out a million tokens."""
    rows = [(m, p, 0.0) for m, p in EMBEDDING_PRICES.items()] + [(m, *p) for m, p in CHAT_PRICES.items()]
    return spark.createDataFrame(rows, "model string, cost_in double, cost_out double")


def usage_cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Usage with ``cost_usd`` from the tokens and the model's prices; unknown models cost NULL."""
    priced = usage.join(F.broadcast(prices), "model", "left")
    return priced.withColumn("cost_usd", F.col("tokens_input") / 1e6 * F.col("cost_in") + F.coalesce("tokens_output", F.lit(0)) / 1e6 * F.col("cost_out")).drop("cost_in", "cost_out")


def _count(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


def _one_row(frames: list[DataFrame]) -> DataFrame:
    """Frames of one row each, side by side."""
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), frames)


def table_counts(**tables: DataFrame) -> DataFrame:
    """One row with the number of rows of each table."""
    return _one_row([_count(df, name) for name, df in tables.items()])


def library_stats(docs: DataFrame, highlights: DataFrame) -> DataFrame:
    words = F.coalesce(F.sum("word_count"), F.lit(0))
    own = docs.agg(F.count(F.lit(1)).alias("documents"), words.alias("total_words"), F.count_distinct("category").alias("categories"), reading_hours(words).alias("reading_hours"))
    return _one_row([own, _count(highlights, "highlights")])


def category_counts(docs: DataFrame) -> DataFrame:
    return docs.groupBy(F.coalesce("category", F.lit("article")).alias("category")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "category")


def distinct_categories(docs: DataFrame) -> DataFrame:
    return docs.filter("category is not null").select("category").distinct().orderBy("category")


def embedding_stats(embeddings: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per provider and model: vectors of documents and chunks, and chunks that are gone."""
    known = chunks.select(F.col("id").alias("chunk_id"), F.lit(True).alias("alive"))
    rows = embeddings.join(known, "chunk_id", "left").groupBy("provider", "model")
    own = F.col("chunk_id").isNotNull()
    return rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("document_id").isNotNull() & ~own).alias("documents"), F.count_if(own & F.col("alive")).alias("chunks"), F.count_if(own & F.col("alive").isNull()).alias("orphaned"))


def embedded_documents(docs: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Totals of the older form: pending is a difference and may be negative."""
    return _one_row([_count(docs, "total"), _count(embeddings, "embedded")]).withColumn("pending", F.col("total") - F.col("embedded"))


def embed_backlog(chunks: DataFrame, embeddings: DataFrame, provider: str, model: str) -> DataFrame:
    """Chunks in all, with a vector of the model, without one; and chunks gone that have one."""
    own = where(embeddings, provider=provider, model=model).filter("chunk_id is not null").select("chunk_id").distinct()
    marked = own.join(chunks.select(F.col("id").alias("chunk_id"), F.lit(True).alias("alive")), "chunk_id", "left")
    done = marked.agg(F.count_if(F.col("alive").isNotNull()).alias("embedded"), F.count_if(F.col("alive").isNull()).alias("orphaned"))
    return _one_row([_count(chunks, "total"), done]).withColumn("pending", F.col("total") - F.col("embedded"))


def _flagged(docs: DataFrame, **children: DataFrame) -> DataFrame:
    """Documents with a flag for each frame of children (document_id)."""
    for name, child in children.items():
        docs = docs.join(child.select(F.col("document_id").alias("id"), F.lit(True).alias(name)).distinct(), "id", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return docs


def fetch_stats(docs: DataFrame, failures: DataFrame, chunks: DataFrame) -> DataFrame:
    rows = _flagged(docs.select("id", "url_original", "fulltext"), failed=failures, chunked=chunks)
    url, text = ~is_empty(F.col("url_original")), ~is_empty(F.col("fulltext"))
    return rows.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(url).alias("with_url"), F.count_if(text).alias("with_fulltext"), F.count_if(F.col("failed")).alias("failed"),
        F.count_if(url & ~text & ~F.col("failed")).alias("pending"), F.count_if(text & ~F.col("chunked")).alias("without_chunks"),
    )


def pipeline_stats(docs: DataFrame, chunks: DataFrame, embeddings: DataFrame, provider: str, model: str) -> DataFrame:
    rows = _flagged(docs.select("id", "fulltext"), chunked=chunks)
    own = rows.agg(F.count(F.lit(1)).alias("documents"), F.count_if(~is_empty(F.col("fulltext"))).alias("with_fulltext"), F.count_if(~is_empty(F.col("fulltext")) & ~F.col("chunked")).alias("without_chunks"))
    backlog = embed_backlog(chunks, embeddings, provider, model).select(F.col("total").alias("chunks"), F.col("pending").alias("without_embedding"))
    return _one_row([own, backlog, _count(orphans(embeddings, chunks), "orphaned_embeddings")])


def failure_summary(failures: DataFrame) -> DataFrame:
    return failures.groupBy("error_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "error_type")


def usage_stats(usage: DataFrame, period: str, now: str) -> DataFrame:
    """Totals (provider and operation NULL), per provider and per operation, in one pass."""
    rows = usage.filter(in_period(F.col("timestamp"), period, now))
    sets = rows.groupingSets([[], [F.col("provider")], [F.col("operation")]], F.col("provider"), F.col("operation"))
    return sets.agg(
        F.grouping_id().alias("level"), F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cost_usd"), F.coalesce(F.sum("tokens_input"), F.lit(0)).alias("tokens_input"), F.coalesce(F.sum("tokens_output"), F.lit(0)).alias("tokens_output"),
        F.count(F.lit(1)).alias("calls"), F.bround(F.avg("latency_ms")).alias("avg_latency_ms"), F.count_if(~F.col("success")).alias("errors"),
    )


def range_counts(docs: DataFrame, chunks: DataFrame, first: str, last: str) -> DataFrame:
    """Documents saved in a range of days and their chunks; documents without chunks count."""
    own = docs.filter(in_day_range(F.col("saved_at"), first, last)).select(F.col("id").alias("document_id"))
    return own.join(chunks.select("document_id", F.col("id").alias("chunk_id")), "document_id", "left").agg(F.count_distinct("document_id").alias("documents"), F.count("chunk_id").alias("chunks"))


def digest_cost(counted: DataFrame, model: str = DEFAULT_CHAT_MODEL, *, tokens_per_chunk: int = 200) -> DataFrame:
    """Estimated cost for a column ``chunks``; unknown models cost as the default one."""
    name = model if model in CHAT_PRICES else DEFAULT_CHAT_MODEL
    price_in, price_out = CHAT_PRICES[name]
    tokens = (F.col("chunks") * tokens_per_chunk + 2000) * 2
    cost_in, cost_out = tokens / 1e6 * price_in, F.lit(3500 / 1e6 * price_out)
    return counted.select("*", F.lit(name).alias("model"), tokens.alias("tokens_in"), F.lit(3500).alias("tokens_out"), F.bround(cost_in, 4).alias("input_cost_usd"), F.bround(cost_out, 4).alias("output_cost_usd"), F.bround(cost_in + cost_out, 4).alias("total_cost_usd"))


def embed_cost(backlog: DataFrame, model: str, *, tokens_per_chunk: int = 200) -> DataFrame:
    return backlog.withColumn("estimated_cost_usd", F.col("pending") * tokens_per_chunk / 1e6 * F.lit(EMBEDDING_PRICES.get(model, 0.0)))


def batch_throughput(batches: DataFrame) -> DataFrame:
    """Sums and rows a second of each batch (batch_id, tokens, cost_usd, seconds)."""
    return batches.groupBy("batch_id").agg(F.count(F.lit(1)).alias("rows"), F.sum("tokens").alias("tokens"), F.sum("cost_usd").alias("cost_usd"), (F.count(F.lit(1)) / F.nullif(F.max("seconds"), F.lit(0.0))).alias("rows_per_second"))


def run_counters(events: DataFrame, types: list[str]) -> DataFrame:
    """Events of each type by job and phase."""
    return events.groupBy("job_id", "phase").pivot("type", types).agg(F.count(F.lit(1))).fillna(0, types)


def resumable_job(jobs: DataFrame) -> DataFrame:
    """The newest paused or failed job, with its progress."""
    from scriptorium.functions.text import progress_percent

    return jobs.filter(F.col("status").isin("paused", "failed")).orderBy(F.desc("last_activity"), F.desc("job_id")).limit(1).withColumn("percent", progress_percent(F.col("items_processed"), F.col("items_total")))


def saved_query_counts(hits: DataFrame, queries: DataFrame, cap: int = 100) -> DataFrame:
    """Hits of each saved query, ``cap`` at most; queries without hits count 0. hits: query_id."""
    n = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    return queries.select("query_id").distinct().join(n, "query_id", "left").select("query_id", F.least(F.coalesce("n", F.lit(0)), F.lit(cap)).alias("n"))


def length_report(chunks: DataFrame, size: int, overlap: int, least: int, text: Column | None = None) -> DataFrame:
    """Chunk parameters beside the lengths found."""
    length = F.length(F.col("chunk_text") if text is None else text)
    return chunks.agg(F.lit(size).alias("chunk_size"), F.lit(overlap).alias("chunk_overlap"), F.lit(least).alias("min_chunk_size"), F.count(F.lit(1)).alias("n_chunks"), F.max(length).alias("longest"), F.percentile_approx(length, 0.5).alias("median"))
