"""Line-first quality rules, in DataFrame functions only.

Every line of a text is judged on its own: it must end like a sentence, hold few
symbols, few bars of a menu and little shouting, and be no boilerplate. Lines
that fail are removed; a text that loses too large a share of its characters is
rejected, and so is one that fails the whole-text rules (too few words, too many
words inside repeated windows).

Boilerplate is learned from the lines of all documents: a line is boilerplate if it stands
between ``min_contexts`` different pairs of neighbouring lines at least, and these make up
half of its occurrences. Lines of a text with many copies keep their neighbours, so
copies, even thousands, teach nothing. Lines are counted by hash, pre-aggregated before
either shuffle; a line in a third of all documents is one entry a task and neighbourhood.

Repetition is found by hashing each window of words, and only texts in which a
hash occurs twice sort their windows; nothing is exploded, so no shuffle.

Defined results: null text counts as empty and fails; a text of any length is judged
whole; lines without a word are neither kept nor lost; a loss of exactly
``max_lost_pct`` is kept; repeated rows are judged each, and each is counted; columns of
any name pass through, and one named like an added column raises ValueError; an empty
table gives an empty table. Two different lines or windows are taken for equal only if
their 64-bit hashes agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.durable import checkpoint

SPACES = r"[ \t\n\x0B\f\r]"
NOT_SPACE = r"[^ \t\n\x0B\f\r]"
NOT_SYMBOL = r"[^#*$%&|<>]+"

#: Boilerplate lines up to this number become a set inside the expression; more are joined.
SET_ROWS = 10_000


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def n_matching(text: Column, others: str) -> Column:
    """Characters left when runs of ``others`` are taken out."""
    return F.length(F.regexp_replace(text, others, ""))


def repeated_words(hashes: Column, width: int) -> Column:
    """Words inside windows whose hash occurs twice or more; hashes: by window start."""

    def covered(ordered: Column) -> Column:
        again = F.filter(ordered, lambda e, j: F.coalesce(F.get(ordered, j - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.get(ordered, j + 1)["h"] == e["h"], F.lit(False)))
        starts = F.sort_array(F.transform(again, lambda e: e["at"]))
        return let(starts, lambda s: F.aggregate(F.transform(s, lambda p, k: F.least(F.lit(width), F.get(s, k + 1) - p)), F.lit(0), lambda a, b: a + b))

    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(ordered, covered)).cast("long")


def line_kept(line: Column) -> Column:
    """Whether a line passes the rules that look at nothing but the line."""
    chars = n_matching(line, f"{SPACES}+")
    shouts = n_matching(line, "[^!]+")
    sentence = line.rlike(rf"""[.!?…]["')»”]*{SPACES}*\z""")
    symbols = n_matching(line, NOT_SYMBOL) * 10 <= chars
    menu = n_matching(line, "[^|]+") < 3
    calm = (shouts < 4) | (shouts * 20 <= chars)
    return sentence & symbols & menu & calm


def text_lines(text: Column) -> Column:
    """Lines that hold a word."""
    return F.filter(F.split(text, "\n", -1), lambda x: x.rlike(NOT_SPACE))


def boilerplate(docs: DataFrame, *, text_col: str = "text", min_contexts: int = 10) -> DataFrame:
    """``line``: the hashes of lines that stand in many different neighbourhoods."""
    hashes = F.transform(text_lines(F.coalesce(docs[text_col].cast("string"), F.lit(""))), lambda x: F.xxhash64(x))
    near = lambda h: F.transform(h, lambda x, i: F.struct(x.alias("line"), F.xxhash64(F.coalesce(F.get(h, i - 1), F.lit(0)), F.coalesce(F.get(h, i + 1), F.lit(0))).alias("context")))
    contexts = docs.select(F.inline(let(hashes, near))).groupBy("line", "context").agg(F.count(F.lit(1)).alias("n"))
    counted = contexts.groupBy("line").agg(F.sum("n").alias("n_lines"), F.count(F.lit(1)).alias("n_contexts"))
    return counted.filter((F.col("n_contexts") >= min_contexts) & (F.col("n_contexts") * 2 >= F.col("n_lines"))).select("line")


def judge(docs: DataFrame, *, text_col: str = "text", window: int = 8, min_words: int = 20, max_repeat_pct: int = 30, max_lost_pct: int = 70, min_contexts: int = 10, prefix: str = "") -> DataFrame:
    """The rows of ``docs`` with the measures and verdicts as added columns
    (``prefix`` before their names, for tables that have such names already):
    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, kept_chars (long),
    base_failed, kept (boolean) and clean_text (the lines that pass)."""
    taken = {x.lower() for x in docs.columns}
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "kept_chars", "base_failed", "kept", "clean_text")
    if clash := [prefix + x for x in names if (prefix + x).lower() in taken]:
        raise ValueError(f"columns {clash} exist; give another prefix")
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    common = checkpoint(boilerplate(docs, text_col=text_col, min_contexts=min_contexts))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), text.alias("_text"))
    if (n_common := common.count()) <= SET_ROWS:
        own = [r["line"] for r in common.collect()]
        plain = lambda x: ~F.xxhash64(x).isin(own) if n_common else F.lit(True)
    else:
        # Equal texts have equal lines, so a text's hash is key enough.
        key = F.xxhash64("_text").alias("_key")
        held = rows.select(key, F.explode(F.array_distinct(F.transform(text_lines(F.col("_text")), lambda x: F.xxhash64(x)))).alias("line")).join(common, "line", "left_semi")
        rows = rows.select("*", key).join(held.groupBy("_key").agg(F.collect_set("line").alias("_common")), "_key", "left")
        plain = lambda x: ~F.coalesce(F.array_contains("_common", F.xxhash64(x)), F.lit(False))
    rows = rows.select("*", F.array_remove(F.split("_text", f"{SPACES}+"), "").alias("_words"), text_lines(F.col("_text")).alias("_lines"))
    hashes = F.when(F.size("_words") >= window, F.transform(F.sequence(F.lit(1), F.size("_words") - (window - 1)), lambda i: F.xxhash64(F.slice("_words", i, F.lit(window))))).otherwise(F.array().cast("array<bigint>"))
    rows = rows.select("_row", "_text", "_lines", F.size("_words").cast("long").alias("_n"), hashes.alias("_hashes"), F.filter("_lines", lambda x: line_kept(x) & plain(x)).alias("_good"))
    chars = lambda lines: n_matching(F.array_join(lines, ""), f"{SPACES}+").cast("long")
    rows = rows.select(
        "_row",
        F.col("_n").alias("n_words"),
        chars(F.col("_lines")).alias("word_chars"),
        n_matching(F.col("_text"), NOT_SYMBOL).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_hashes"), window).alias("n_repeat_words"),
        chars(F.col("_good")).alias("kept_chars"),
        F.array_join("_good", "\n").alias("clean_text"),
    )
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_pct)
    lost = (F.col("word_chars") - F.col("kept_chars")) * 100 > F.col("word_chars") * max_lost_pct
    rows = rows.select("*", failed.alias("base_failed"), (~failed & ~lost).alias("kept"))
    return rows.select("_row.*", *[F.col(x).alias(prefix + x) for x in names])
