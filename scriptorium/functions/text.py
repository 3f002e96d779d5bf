"""Column functions on text, URLs, dates and JSON; all built-in expressions except NFC."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Plural categories of the export feed.
PLURALS = {"articles": "article", "podcasts": "podcast", "tweets": "tweet", "books": "book"}

#: Days, or the whole of today, that a usage period reaches back.
PERIODS = {"week": 7, "month": 30}


def blank_to_null(value: Column) -> Column:
    """'' as NULL."""
    return F.nullif(value, F.lit(""))


def normalize_url(url: Column, *, strip_www: bool = True) -> Column:
    """A URL as a key for deduplication: trimmed, lower case, https, without parameters,
    query, fragment and closing slashes. ``strip_www`` drops every ``www.`` of the host;
    merge detection between feeds keeps them. Empty becomes NULL."""
    low = F.regexp_replace(F.lower(F.regexp_replace(url, r"(?U)^\s+|\s+$", "")), "^http://", "https://")
    bare = F.regexp_replace(low, r"[?#].*$", "")
    scheme = F.regexp_extract(bare, r"^([a-z][a-z0-9+.-]*):", 1)
    host = F.regexp_extract(bare, r"^(?:[a-z][a-z0-9+.-]*:)?//([^/]*)", 1)
    path = F.regexp_replace(bare, r"^(?:[a-z][a-z0-9+.-]*:)?(?://[^/]*)?", "")
    # Parameters belong to the last segment only.
    path = F.regexp_replace(F.regexp_replace(path, r";[^/]*$", ""), "/+$", "")
    host = F.replace(host, F.lit("www."), F.lit("")) if strip_www else host
    head = F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(F.lit(""))
    return blank_to_null(F.concat(head, F.when(host != "", F.concat(F.lit("//"), host)).otherwise(F.lit("")), path))


def url_host(url: Column) -> Column:
    """Lower-case host with port, without one leading ``www.``; '' if there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), r"^www\.", "")


def nfc(text: Column) -> Column:
    """Unicode NFC, which Spark has no function for. The stage sees all rows and leaves ASCII texts as they are."""

    @F.arrow_udf("string")
    def compose(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        from unicodedata import normalize

        for texts in batches:
            yield pa.array([x if x is None or x.isascii() else normalize("NFC", x) for x in texts.to_pylist()], pa.string())

    return compose(text)


def normalize_text(text: Column) -> Column:
    """Unicode NFC with runs of white space as one blank, trimmed."""
    return F.trim(F.regexp_replace(nfc(text), r"(?U)[\s\x1c-\x1f]+", " "))


def text_hash(text: Column) -> Column:
    """First 16 hexadecimal digits of the SHA-256 of the normalised text."""
    return F.substring(F.sha2(normalize_text(text).cast("binary"), 256), 1, 16)


def normalize_category(category: Column, url: Column | None = None) -> Column:
    """Singular lower-case category; ``linkedin`` by URL; ``article`` if there is none."""
    low = F.lower(F.trim(category))
    single = F.coalesce(F.create_map(*[F.lit(x) for pair in PLURALS.items() for x in pair])[low], low)
    named = F.when(F.coalesce(category, F.lit("")) == "", F.lit("article")).otherwise(single)
    return named if url is None else F.when(F.contains(F.lower(url), F.lit("linkedin.com")), F.lit("linkedin")).otherwise(named)


def estimate_tokens(text: Column) -> Column:
    """One token for four code points, rounded down."""
    return F.floor(F.length(text) / 4)


def reading_hours(words: Column) -> Column:
    """Hours at 250 words a minute, to one decimal, half to even."""
    return F.bround(F.coalesce(words, F.lit(0)) / F.lit(250.0) / F.lit(60.0), 1)


def embedding_text(title: Column, author: Column, summary: Column, fulltext: Column) -> Column:
    """The parts that are not empty, with blank lines between."""
    return F.concat_ws("\n\n", blank_to_null(title), F.when(author != "", F.concat(F.lit("by "), author)), blank_to_null(summary), blank_to_null(fulltext))


def _last(text: Column, mark: str) -> Column:
    """Position from 0 of the last ``mark``, -1 if there is none."""
    at = F.locate(mark[::-1], F.reverse(text))
    return F.when(at == 0, F.lit(-1)).otherwise(F.length(text) - at - (len(mark) - 1))


#: Characters that the plain embedding path keeps, and the provider's.
LONG_CUT, SHORT_CUT = 30_000, 20_000


def hard_cut(text: Column, limit: int = SHORT_CUT) -> Column:
    """The first ``limit`` characters, wherever that falls."""
    return F.substring(text, 1, limit)


def truncate_at_space(text: Column, size: int = 20_000) -> Column:
    """At most ``size`` characters and '...', cut at the last blank if that loses less than a fifth."""
    head = F.substring(text, 1, size)
    space = _last(head, " ")
    cut = F.when(space > size * 0.8, F.substring(head, F.lit(1), space)).otherwise(head)
    return F.when(F.length(text) <= size, text).otherwise(F.concat(cut, F.lit("...")))


def chunk_for_embedding(text: Column, title: Column, max_tokens: int = 8000) -> Column:
    """Title and text, cut at the last sentence end within the limit if that loses less than a fifth."""
    whole = F.when(title != "", F.concat(title, F.lit("\n\n"), text)).otherwise(text)
    size = max_tokens * 4
    head = F.substring(whole, 1, size)
    stop = _last(head, ". ")
    cut = F.when(stop > size * 0.8, F.substring(head, F.lit(1), stop + 1)).otherwise(head)
    return F.when(F.length(whole) <= size, whole).otherwise(cut)


def looks_like_html(text: Column) -> Column:
    low = F.translate(text, "DIVP", "divp")
    return F.startswith(text, F.lit("<")) | F.contains(low, F.lit("<p>")) | F.contains(low, F.lit("<div>"))


def in_day_range(moment: Column, first: str, last: str) -> Column:
    """Whether the UTC day lies in the range, both ends included."""
    return F.to_date(moment).between(F.lit(first).cast("date"), F.lit(last).cast("date"))


def format_date(text: Column) -> Column:
    """ISO date as DD.MM.YYYY, '-' if there is none, the first ten characters if malformed."""
    day = F.split(F.substring(text, 1, 10), "-")
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit("-")).when(F.size(day) == 3, F.concat_ws(".", F.get(day, F.lit(2)), F.get(day, F.lit(1)), F.get(day, F.lit(0)))).otherwise(F.substring(text, 1, 10))


def in_period(moment: Column, period: str, now: str) -> Column:
    """today: the same UTC day; week and month: the last 7 and 30 days; all: every moment."""
    if period == "today":
        return F.to_date(moment) == F.to_date(F.lit(now).cast("timestamp"))
    if period in PERIODS:
        return moment >= F.lit(now).cast("timestamp") - F.expr(f"interval {PERIODS[period]} days")
    return F.lit(True)


def metadata_category(raw: Column, category: Column) -> Column:
    """The category, else the one in the JSON metadata, else ``article``; broken JSON is skipped."""
    return F.coalesce(category, blank_to_null(F.get_json_object(raw, "$.category")), F.lit("article"))


def metadata_words(raw: Column, words: Column) -> Column:
    return F.coalesce(words, F.try_to_number(F.get_json_object(raw, "$.word_count"), F.lit("999999999999")).cast("long"))


TOPIC_REPLY = "topic_name string, summary string, key_points array<string>"
OVERVIEW_REPLY = "title string, summary string, highlights array<string>"


def unfence(reply: Column) -> Column:
    """A reply without the code fence around it."""
    inner = F.regexp_extract(F.trim(reply), r"(?s)^```(?:json)?(.*?)(?:```.*)?$", 1)
    return F.trim(F.when(F.startswith(F.trim(reply), F.lit("```")), inner).otherwise(reply), F.lit(" \n\r\t"))


def topic_reply(reply: Column, cluster: Column) -> Column:
    """Name, summary and key points of a topic reply, with defaults where it lacks or breaks them."""
    data = F.from_json(unfence(reply), TOPIC_REPLY)
    default = F.concat(F.lit("Thema "), (cluster + 1).cast("string"))
    return F.struct(F.coalesce(data["topic_name"], default).alias("topic_name"), F.coalesce(data["summary"], F.lit("")).alias("summary"), F.coalesce(data["key_points"], F.array().cast("array<string>")).alias("key_points"))


def cap_title(title: Column) -> Column:
    return F.when(F.length(title) > 80, F.concat(F.substring(title, 1, 77), F.lit("..."))).otherwise(title)


def preview(*candidates: Column, size: int = 200) -> Column:
    """The start of the first candidate that is not empty."""
    text = F.coalesce(*map(blank_to_null, candidates), F.lit(""))
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)


def progress_percent(done: Column, total: Column) -> Column:
    return F.coalesce(F.lit(100.0) * done / F.nullif(total, F.lit(0)), F.lit(0.0))


def split_list(text: Column) -> Column:
    """Entries of a comma list, trimmed, without blanks."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def contains_ascii_folded(text: Column, query: str) -> Column:
    """SQL LIKE '%query%' that folds A-Z only; % and _ in the query are wildcards."""
    return F.translate(text, _UPPER, _LOWER).like(f"%{query.translate(str.maketrans(_UPPER, _LOWER))}%")


def or_default(value: Column, default: str) -> Column:
    return F.coalesce(blank_to_null(value), F.lit(default))
