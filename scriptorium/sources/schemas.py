"""Schemas of the tables and of the landed feeds."""

DOCUMENTS = """id long, source string, provider_id string, url_original string, url_canonical string, title string, author string,
    published_at timestamp, saved_at timestamp, fulltext string, fulltext_html string, fulltext_source string, fulltext_fetched_at timestamp,
    summary string, category string, word_count long, raw_json string, created_at timestamp, updated_at timestamp"""
HIGHLIGHTS = "id long, document_id long, provider_highlight_id string, text string, text_hash string, note string, highlighted_at timestamp, provider string, created_at timestamp"
CHUNKS = "id long, document_id long, chunk_index int, chunk_text string, char_start int, char_end int, token_count long, created_at timestamp"
EMBEDDINGS = "id long, document_id long, chunk_id long, provider string, model string, embedding array<float>, dimensions int, created_at timestamp"
API_USAGE = "timestamp timestamp, provider string, model string, operation string, tokens_input long, tokens_output long, cost_usd double, latency_ms double, success boolean, error_message string, metadata string"
FETCH_FAILURES = "document_id long, job_id string, url string, error_type string, error_message string, http_status int, retry_count int, last_attempt timestamp, next_retry_after timestamp"
JOB_EVENTS = "job_id string, phase string, type string, payload string, at timestamp"
DRAFT_VERSIONS = "draft_id long, version_index int, text string, note string"
GENERATED_DIGESTS = "id long, name string, strategy string, date_from date, date_to date, topics_json string, highlights_json string, chunks_analyzed long, documents_analyzed long, is_favorite boolean, deleted_at timestamp, created_at timestamp"
DIGEST_TOPICS = "digest_id long, topic_index int, topic_name string, summary string, chunk_ids array<long>, key_points array<string>"
DIGEST_CITATIONS = "digest_id long, topic_id long, document_id long, chunk_id long, excerpt string"

DOCUMENT_FEED = """results array<struct<id: string, parent_id: string, url: string, source_url: string, title: string, author: string, summary: string,
    word_count: long, published_date: string, category: string, html_content: string, image_url: string, saved_at: string, created_at: string,
    updated_at: string, location: string, content: string, notes: string>>, nextPageCursor string, count long, _corrupt string"""
BOOK_FEED = """results array<struct<user_book_id: long, source: string, source_url: string, unique_url: string, title: string, author: string, summary: string,
    category: string, cover_image_url: string, last_highlight_at: string, updated: string,
    highlights: array<struct<id: long, book_id: long, text: string, note: string, highlighted_at: string>>>>, nextPageCursor string, _corrupt string"""
