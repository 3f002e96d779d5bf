"""End-user jobs: compositions of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.durable import checkpoint
from scriptorium.functions.html import extract_text
from scriptorium.functions.text import blank_to_null
from scriptorium.operators import chunking, clustering, embedding, fulltext, library, maintenance, stats


def sync(
    docs: DataFrame, batch: DataFrame, chunks: DataFrame, embeddings: DataFrame, embedder: embedding.Embedder, *, provider: str, model: str, now: str, highlights: DataFrame | None = None, new_highlights: DataFrame | None = None, price: float = 0.0
) -> dict[str, DataFrame]:
    """Import, chunk, embed and index. Returns documents, rejects, new chunks, new embeddings, usage and postings.

    Articles without text get that of their HTML. With ``highlights`` (the table) and ``new_highlights`` (with source,
    parent_id and seq) also the new highlight table, each highlight at the document of its parent.
    """
    text = F.coalesce(blank_to_null(F.col("fulltext")), extract_text(F.col("fulltext_html")))
    stored, rejected = maintenance.upsert_articles(docs, batch.withColumn("fulltext", text), now=now)
    # A document without a provider id is known by its URL.
    keyed = checkpoint(stored.withColumn("id", F.xxhash64("source", F.coalesce(F.concat(F.lit("id "), "provider_id"), F.concat(F.lit("url "), "url_canonical")))))
    new_chunks, vectors = embedding.embed_chunks(keyed, chunks, embeddings, embedder, provider=provider, model=model)
    postings = fulltext.build_postings(keyed, ["title", "author", "fulltext", "summary"], id_col="id")
    done = {"documents": keyed, "rejects": rejected, "chunks": new_chunks, "embeddings": vectors, "usage": embedding.usage_events(vectors, "embed", price, now), "postings": postings}
    if highlights is not None and new_highlights is not None:
        owner = keyed.select("source", F.col("provider_id").alias("parent_id"), F.col("id").alias("document_id"))
        done["highlights"] = maintenance.upsert_highlights(highlights, new_highlights.join(owner, ["source", "parent_id"]).drop("source", "parent_id"))
    return done


def process_fetches(docs: DataFrame, captured: DataFrame, failures: DataFrame, *, job_id: str, now: str) -> dict[str, DataFrame]:
    """Captured pages (url, http_status, content_length, html, error_kind) of fetch candidates: new documents, failures and counters."""
    todo = library.fetch_candidates(docs, failures).select("id", F.col("url_original").alias("url"))
    rows = todo.join(captured, "url").withColumn("text", extract_text(F.col("html")))
    rows = checkpoint(rows.withColumn("error_type", library.classify_fetch(F.col("url"), F.col("http_status"), F.col("content_length"), F.col("text"), F.col("error_kind"))))
    good = rows.filter("error_type is null")
    failed = rows.filter("error_type is not null").select(F.col("id").alias("document_id"), F.lit(job_id).alias("job_id"), "url", "error_type", F.lit(None).cast("string").alias("error_message"), "http_status", F.lit(now).cast("timestamp").alias("last_attempt"), F.lit(0).alias("seq"))
    counters = rows.agg(F.count(F.lit(1)).alias("processed"), F.count_if(F.col("error_type").isNull()).alias("succeeded"), F.count_if(F.col("error_type").isNotNull()).alias("failed"))
    return {"documents": maintenance.update_fulltext(docs, good, source="captured", now=now), "failures": maintenance.upsert_failures(failures, failed), "counters": counters}


def digest(chunks: DataFrame, docs: DataFrame, embeddings: DataFrame, first: str, last: str, *, limit: int = 2000) -> dict[str, DataFrame]:
    """Select, cluster, label and compile. Without chunks the digest is empty."""
    selected = checkpoint(library.chunks_in_range(chunks, docs, first, last, limit=limit, embeddings=embeddings).dropDuplicates(["id"]))
    n = selected.count()
    if n == 0:
        none = selected.sparkSession.createDataFrame([], "topic_index int, topic_name string, n_chunks long, summary string, key_points array<string>")
        return {"selected": selected, "topics": none, "digest": clustering.compile_digest(none, selected, first, last)}
    start = selected.agg(F.min("id")).first()[0]
    assigned = checkpoint(clustering.kmeans(selected, clustering.choose_k(n), start))
    labelled = selected.select("id", "chunk_text").join(assigned, "id")
    members = clustering.cluster_members(assigned)
    names = clustering.topic_terms(labelled)
    points = clustering.extracts(assigned, selected)
    topics = members.join(names, "cluster", "left").join(points, "cluster", "left").select(
        F.col("cluster").alias("topic_index"), F.coalesce(F.array_join("terms", ", "), F.concat(F.lit("Thema "), (F.col("cluster") + 1).cast("string"))).alias("topic_name"), "n_chunks", F.coalesce(F.substring(F.get("key_points", F.lit(0)), 1, 200), F.lit("")).alias("summary"), F.coalesce("key_points", F.array().cast("array<string>")).alias("key_points")
    )
    return {"selected": selected, "assigned": assigned, "topics": topics, "digest": clustering.compile_digest(topics, selected, first, last)}


def library_page(docs: DataFrame, highlights: DataFrame, *, hits: DataFrame | None = None, **options) -> dict[str, DataFrame]:
    """Rows, facets and statistics of a page of the library; ``hits`` (id) narrows it to search results."""
    own = docs if hits is None else docs.join(hits.select("id"), "id", "left_semi")
    return {"rows": library.list_library(own, highlights, **options), "facets": stats.category_counts(docs), "categories": stats.distinct_categories(docs), "stats": stats.library_stats(docs, highlights)}


def run_saved_queries(postings: DataFrame, queries: DataFrame, *, limit: int = 100) -> tuple[DataFrame, DataFrame]:
    """Results and capped hit counts of all saved queries (query_id, query)."""
    asked = queries.select("query_id", fulltext.tokens(F.col("query")).alias("terms"))
    hits = fulltext.search_many(postings, asked, limit=limit)
    return hits, stats.saved_query_counts(hits, queries, limit)


def chunk_report(docs: DataFrame) -> DataFrame:
    """Chunk parameters beside what they make of the documents."""
    return stats.length_report(chunking.chunk_documents(docs), chunking.SIZE, chunking.OVERLAP, chunking.LEAST)
