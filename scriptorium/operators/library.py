"""Listing, filtering, sorting and lookup of documents; missing work and orphans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions.text import in_day_range, or_default, url_host

SORTABLE = ("saved_at", "title", "author", "category", "word_count", "highlight_count", "published_at", "created_at")

#: Domains behind a paywall, and domains that need a browser.
PAYWALL_DOMAINS = ("medium.com", "nytimes.com", "wsj.com", "ft.com", "economist.com", "bloomberg.com", "washingtonpost.com", "theathletic.com", "businessinsider.com", "seekingalpha.com")
BROWSER_DOMAINS = ("twitter.com", "x.com", "instagram.com", "facebook.com", "linkedin.com")
#: Bytes of the largest page that is read, characters of the shortest text that counts.
LARGEST_PAGE = 10 * 1024 * 1024
SHORTEST_TEXT = 200
#: Failures worth another try: as the classifier sees it, and as the clearing job does.
RETRIABLE = ("timeout", "http_5xx", "connection_error")
CLEARABLE = ("timeout", "http_5xx")


def highlight_summary(highlights: DataFrame, *, doc_col: str = "document_id", at_col: str = "highlighted_at") -> DataFrame:
    """Count and first date of each document's highlights."""
    return highlights.groupBy(F.col(doc_col).alias("id")).agg(F.count(F.lit(1)).alias("highlight_count"), F.min(at_col).alias("first_highlight_at"))


def list_library(docs: DataFrame, highlights: DataFrame, *, with_fulltext: bool = True, with_highlights: bool = True, categories: list[str] | None = None, sort: str = "saved_at", descending: bool = True, limit: int | None = 100) -> DataFrame:
    """Documents of the wanted kinds of content, sorted, NULLs last in either direction.

    A fulltext of '' counts as present here. Documents without a save date are sorted by their first highlight.
    """
    rows = docs.join(highlight_summary(highlights), "id", "left").withColumn("highlight_count", F.coalesce("highlight_count", F.lit(0)))
    rows = rows.withColumn("effective_date", F.coalesce("saved_at", "first_highlight_at"))
    kinds = ([F.col("fulltext").isNotNull()] if with_fulltext else []) + ([F.col("fulltext").isNull() & (F.col("highlight_count") > 0)] if with_highlights else [])
    rows = rows.filter(reduce(lambda a, b: a | b, kinds)) if kinds else rows.limit(0)
    if categories:
        rows = rows.filter(F.col("category").isin(categories))
    rows = rows.withColumn("category", or_default(F.col("category"), "article"))
    by = F.col("effective_date") if sort == "saved_at" or sort not in SORTABLE else F.col(sort)
    rows = rows.orderBy(by.desc_nulls_last() if descending or sort not in SORTABLE else by.asc_nulls_last(), "id")
    return rows if limit is None else rows.limit(limit)


def newest(rows: DataFrame, by: list[str], limit: int, *, id_col: str = "id") -> DataFrame:
    """Newest first by the first known of several dates, ties by id."""
    return rows.orderBy(F.coalesce(*[F.col(c) for c in by]).desc_nulls_last(), F.col(id_col).desc()).limit(limit)


def page_after(rows: DataFrame, cursor: int, limit: int, *, id_col: str = "id") -> DataFrame:
    """The next rows by id."""
    return rows.filter(F.col(id_col) > cursor).orderBy(id_col).limit(limit)


def lookup(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows with one of the keys."""
    return rows.join(keys.select(key).distinct(), key, "left_semi")


def visible(digests: DataFrame, *, favourites_only: bool = False) -> DataFrame:
    """Digests that are not deleted; a missing favourite mark means no."""
    rows = digests.filter("deleted_at is null")
    return rows.filter(F.coalesce("is_favorite", F.lit(False))) if favourites_only else rows


def where(rows: DataFrame, **values) -> DataFrame:
    """Rows whose columns have the given values; None sets no condition."""
    return reduce(lambda df, kv: df.filter(F.col(kv[0]) == kv[1]), [kv for kv in values.items() if kv[1] is not None], rows)


def is_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit("")) == ""


def fetch_candidates(docs: DataFrame, failures: DataFrame, *, cursor: int = 0, limit: int | None = None) -> DataFrame:
    """Documents with a URL, without text and without a recorded failure."""
    rows = docs.filter(~is_empty(F.col("url_original")) & is_empty(F.col("fulltext"))).join(failures.select(F.col("document_id").alias("id")), "id", "left_anti")
    return rows if limit is None else page_after(rows, cursor, limit)


def chunk_candidates(docs: DataFrame, chunks: DataFrame, *, min_length: int | None = 100) -> DataFrame:
    """Documents with text and without chunks; ``None`` sets no least length."""
    rows = docs.filter(~is_empty(F.col("fulltext")))
    if min_length is not None:
        rows = rows.filter(F.length("fulltext") >= min_length)
    return rows.join(chunks.select(F.col("document_id").alias("id")), "id", "left_anti")


def shortest_unchunked(docs: DataFrame, chunks: DataFrame, n: int = 20) -> DataFrame:
    """The shortest documents with text and without chunks, with their lengths."""
    rows = chunk_candidates(docs, chunks, min_length=None).withColumn("length", F.length("fulltext"))
    return rows.orderBy("length", "id").limit(n)


def without_embedding(rows: DataFrame, embeddings: DataFrame, *, key: str, provider: str | None = None, model: str | None = None) -> DataFrame:
    """Rows (by ``id``) without a vector, of the provider and model if given. key: document_id or chunk_id."""
    done = where(embeddings, provider=provider, model=model).filter(F.col(key).isNotNull())
    return rows.join(done.select(F.col(key).alias("id")), "id", "left_anti")


def orphans(embeddings: DataFrame, chunks: DataFrame) -> DataFrame:
    """Embeddings whose chunk is gone."""
    return embeddings.filter("chunk_id is not null").join(chunks.select(F.col("id").alias("chunk_id")), "chunk_id", "left_anti")


def _of_domains(host: Column, domains: tuple[str, ...]) -> Column:
    return host.isin(*domains) | reduce(lambda a, b: a | b, [F.endswith(host, F.lit("." + d)) for d in domains])


def classify_fetch(url: Column, status: Column, size: Column, text: Column, captured_error: Column) -> Column:
    """Error type of a captured page, NULL for success; the first rule that applies decides."""
    host = url_host(url)
    return (
        F.when(_of_domains(host, PAYWALL_DOMAINS), "paywall")
        .when(_of_domains(host, BROWSER_DOMAINS), "js_required")
        .when(captured_error == "timeout", "timeout")
        .when(captured_error.isin("connect", "connection_error"), "connection_error")
        .when(captured_error.isNotNull(), "extraction_failed")
        .when(status >= 500, "http_5xx")
        .when(status >= 400, "http_4xx")
        .when(size > LARGEST_PAGE, "extraction_failed")
        .when(is_empty(text), "no_content")
        .when(F.length(text) < SHORTEST_TEXT, "extraction_failed")
    )


def chunks_in_range(chunks: DataFrame, docs: DataFrame, first: str, last: str, *, limit: int | None = 2000, embeddings: DataFrame | None = None) -> DataFrame:
    """Newest chunks of documents saved in a range of days, with vectors if given."""
    own = docs.filter(in_day_range(F.col("saved_at"), first, last)).select(F.col("id").alias("document_id"), "title", "author", "category", "saved_at")
    rows = chunks.join(own, "document_id")
    if embeddings is not None:
        rows = rows.join(embeddings.select(F.col("chunk_id").alias("id"), "embedding"), "id")
    rows = rows.orderBy(F.desc("saved_at"), "chunk_index", "id")
    return rows if limit is None else rows.limit(limit)


def citations(cited: DataFrame, docs: DataFrame, *, topic_id: int | None = None) -> DataFrame:
    """Citations with what is known of their documents."""
    return where(cited, topic_id=topic_id).join(docs.select(F.col("id").alias("document_id"), "title", "author", "url_original"), "document_id", "left")


def with_documents(rows: DataFrame, docs: DataFrame, *columns: str) -> DataFrame:
    """Highlights, failures or chunks (document_id) with columns of their documents as ``document_<name>``; rows without a document are left out."""
    own = docs.select(F.col("id").alias("document_id"), *[F.col(c).alias(f"document_{c}") for c in columns])
    return rows.join(own, "document_id")


def chunk_counts(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """``id`` and ``n_chunks`` of all documents."""
    n = chunks.groupBy(F.col("document_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return docs.select("id").join(n, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n_chunks"))


def embedded_chunks(embeddings: DataFrame, chunks: DataFrame, docs: DataFrame, *columns: str) -> DataFrame:
    """Vectors of chunks with the chunk and columns of its document."""
    own = embeddings.filter("chunk_id is not null").drop("document_id").join(chunks.select(F.col("id").alias("chunk_id"), "document_id", "chunk_text"), "chunk_id")
    return with_documents(own, docs, *columns)


def duplicate_ratio(results: DataFrame, title_col: str = "title") -> DataFrame:
    """Share of repeated titles in a result list, and whether it is acceptable (one in ten)."""
    own = results.filter(~is_empty(F.col(title_col)))
    ratio = F.coalesce(1 - F.count_distinct(title_col) / F.nullif(F.count(F.lit(1)), F.lit(0)), F.lit(0.0))
    return own.agg(ratio.alias("duplicate_ratio"), (ratio <= 0.1).alias("acceptable"))


def latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("_nth", nth).filter("_nth = 1").drop("_nth")


def next_versions(versions: DataFrame, new: DataFrame) -> DataFrame:
    """New draft texts (draft_id, text, note, seq) with the version numbers that follow those of each draft."""
    top = versions.groupBy("draft_id").agg(F.max("version_index").alias("top"))
    nth = F.row_number().over(Window.partitionBy("draft_id").orderBy("seq"))
    return new.join(top, "draft_id", "left").withColumn("version_index", (F.coalesce("top", F.lit(0)) + nth).cast("int")).drop("top")


def domain_delays(outcomes: DataFrame, *, base: float = 2.0, factor: float = 1.5, most: float = 10.0) -> DataFrame:
    """Failure streak and delay of each host after each fetch (seq, url, success, retriable)."""
    by = Window.partitionBy("domain").orderBy("seq")
    rows = outcomes.withColumn("domain", url_host(F.col("url"))).withColumn("island", F.sum(F.col("success").cast("int")).over(by))
    inside = Window.partitionBy("domain", "island").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("streak", F.sum((~F.col("success") & F.col("retriable")).cast("int")).over(inside))
    return rows.withColumn("delay", F.least(F.lit(base) * F.pow(F.lit(factor), F.col("streak")), F.lit(most))).drop("island")
