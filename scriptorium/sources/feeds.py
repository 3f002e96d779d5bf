"""The two landed JSON feeds as frames of documents and highlights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions.text import blank_to_null, normalize_url
from scriptorium.sources.schemas import BOOK_FEED, DOCUMENT_FEED


def _pages(spark: SparkSession, path: str, schema: str, stream: bool) -> DataFrame:
    reader = spark.readStream if stream else spark.read
    return reader.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("multiLine", False).json(path)


def read_document_feed(spark: SparkSession, path: str, *, stream: bool = False) -> DataFrame:
    """Records of all landed pages, child records included."""
    return _pages(spark, path, DOCUMENT_FEED, stream).filter("_corrupt is null").select(F.explode("results").alias("r")).select("r.*")


def read_book_feed(spark: SparkSession, path: str, *, stream: bool = False) -> DataFrame:
    return _pages(spark, path, BOOK_FEED, stream).filter("_corrupt is null").select(F.explode("results").alias("r")).select("r.*")


def rejects(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Landed lines that do not parse."""
    # Spark reads no file for the corrupt column alone, so a field of the schema is looked at too.
    broken = _pages(spark, path, schema, False).filter(F.col("_corrupt").isNotNull() & (F.coalesce(F.size("results"), F.lit(0)) >= 0))
    return broken.select(F.col("_corrupt").alias("record"), F.lit("unparsable").alias("reason"))


def mark_invalid(items: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Items with ``reason``, the first rule they break, NULL if none; a rule that is NULL is broken."""
    return items.withColumn("reason", F.coalesce(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]))


def split_valid(items: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Items that pass all rules, and the others with the first rule they break."""
    marked = mark_invalid(items, rules)
    return marked.filter("reason is null").drop("reason"), marked.filter("reason is not null")


def filter_feed(feed: DataFrame, *, location: str | None = None, category: str | None = None, updated_after: str | None = None, limit: int | None = None, updated_col: str = "updated_at", default_category: str | None = None) -> DataFrame:
    """Source-side filters; ``default_category`` stands for a missing category (the export feed takes ``articles``)."""
    if location:
        feed = feed.filter(F.col("location") == location)
    if category:
        own = F.col("category") if default_category is None else F.coalesce("category", F.lit(default_category))
        feed = feed.filter(own == category)
    if updated_after:
        feed = feed.filter(F.try_to_timestamp(updated_col) > F.lit(updated_after).cast("timestamp"))
    return feed.limit(limit) if limit is not None else feed


def moment(text: Column) -> Column:
    """ISO text as a UTC timestamp; NULL if it does not parse."""
    return F.try_to_timestamp(blank_to_null(text))


def articles(feed: DataFrame) -> DataFrame:
    """Documents of the document feed; children (highlights, notes) are left out."""
    own = feed.filter("parent_id is null or parent_id = ''")
    return own.select(
        F.concat(F.lit("reader:"), "id").alias("item_id"), F.lit("reader").alias("source"), F.col("id").alias("provider_id"),
        F.coalesce(blank_to_null(F.col("source_url")), F.col("url")).alias("url_original"), F.coalesce("title", F.lit("Untitled")).alias("title"), "author", "summary", "category", "word_count",
        moment(F.col("published_date")).alias("published_at"), moment(F.coalesce(blank_to_null(F.col("saved_at")), F.col("created_at"))).alias("saved_at"), F.col("html_content").alias("fulltext_html"),
    )


def feed_highlights(feed: DataFrame) -> DataFrame:
    """Highlights of the document feed, with the record they belong to."""
    return feed.filter("category = 'highlight'").select(
        F.col("parent_id"), F.col("id").alias("provider_highlight_id"), F.coalesce(blank_to_null(F.col("content")), blank_to_null(F.col("title")), F.lit("")).alias("text"),
        F.col("notes").alias("note"), moment(F.col("created_at")).alias("highlighted_at"), F.lit("reader").alias("provider"),
    )


def highlights_by_article(feed: DataFrame) -> DataFrame:
    """Each article's highlights as one array, by time, then id."""
    own = feed_highlights(feed).groupBy("parent_id").agg(F.sort_array(F.collect_list(F.struct("highlighted_at", "provider_highlight_id", "text", "note"))).alias("highlights"))
    return articles(feed).join(own.withColumnRenamed("parent_id", "provider_id"), "provider_id", "left")


def books(feed: DataFrame) -> DataFrame:
    """Documents of the export feed."""
    return feed.select(
        F.concat(F.lit("export:"), F.col("user_book_id").cast("string")).alias("item_id"), F.coalesce(blank_to_null(F.col("source")), F.lit("export")).alias("source"), F.col("user_book_id").cast("string").alias("provider_id"),
        F.coalesce(blank_to_null(F.col("source_url")), F.col("unique_url")).alias("url_original"), F.coalesce("title", F.lit("Untitled")).alias("title"), "author", "summary", "category", F.lit(None).cast("long").alias("word_count"),
        moment(F.col("last_highlight_at")).alias("published_at"), moment(F.coalesce(blank_to_null(F.col("updated")), F.col("last_highlight_at"))).alias("saved_at"), F.lit(None).cast("string").alias("fulltext_html"),
    )


def book_highlights(feed: DataFrame) -> DataFrame:
    """One row per highlight of the export feed; books without highlights give none."""
    rows = feed.select("user_book_id", F.coalesce(blank_to_null(F.col("source")), F.lit("export")).alias("provider"), F.explode("highlights").alias("h"))
    return rows.select(F.col("user_book_id").cast("string").alias("parent_id"), F.col("h.id").cast("string").alias("provider_highlight_id"), F.coalesce("h.text", F.lit("")).alias("text"), F.col("h.note").alias("note"), moment(F.col("h.highlighted_at")).alias("highlighted_at"), "provider")


def item_stream(first: DataFrame, second: DataFrame) -> DataFrame:
    """Both feeds' documents as one frame, with the order in which feeds are taken."""
    return first.withColumn("feed_order", F.lit(0)).unionByName(second.withColumn("feed_order", F.lit(1)), allowMissingColumns=True)


def merged_items(items: DataFrame, *, url_col: str = "url_original", order: list[str] | None = None) -> DataFrame:
    """``merge_key`` and ``merged``: whether an earlier item had the same normalised URL."""
    from pyspark.sql import Window

    keyed = items.withColumn("merge_key", normalize_url(F.col(url_col), strip_www=False))
    nth = F.row_number().over(Window.partitionBy("merge_key").orderBy(*(order or ["feed_order", "item_id"])))
    return keyed.withColumn("merged", F.col("merge_key").isNotNull() & (nth > 1))
