"""The registered queries of this subpackage: each applies one operator, with
production parameters, to its whole table and returns the digest columns."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import byte_bpe, chat_format, decontaminate, language_id, periodic_runs, pii, quality_model, quality_rules, set_join, spelling_variants, token_counts, token_files, toxicity
from scriptorium.llm.durable import shared_folder

WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
BYTE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(key: str = "doc_id"):
    """Whether a document is kept out of all learning."""
    return F.crc32(F.col(key).cast("string")) % 5 == 0


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    added = spark.sql(
        r"""SELECT -7L AS conv_id, turn, role, r'\### Assistant: </turn> ok' AS text
            FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)"""
    )
    both = turns.select("conv_id", "turn", "role", "text").unionByName(added)
    return chat_format.digest(chat_format.format_windows(both, vocabulary=WORD_VOCABULARY))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"] != pii.TERM)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in pii.KINDS],
        F.sha2(pii.span_list(base).cast("binary"), 256).alias("base_sha256"),
        pii.span_list(F.col("spans")).alias("spans"),
        count(pii.TERM).alias("n_term"),
    )


def op3_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_join.jaccard_classes(table(spark, sf_dir, "documents"), width=4, pct=85)


def op4_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality_model.fit(docs, labels.filter(~held_out()), label_col="quality")
    scored = quality_model.score(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = byte_bpe.encode(table(spark, sf_dir, "documents"), BYTE_RANKS, PATTERN)
    return byte_bpe.decode(ids, BYTE_RANKS).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.identify(docs.filter(~held_out()), docs)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.count_tokens(table(spark, sf_dir, "documents"), WORD_VOCABULARY)
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    grammar = toxicity.learn(docs, labels.filter(~held_out()), label_col="toxic")
    scored = toxicity.score(docs, grammar)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("clauses").alias("n_clauses"))


def with_lost_letters(runs: DataFrame, every: int = 31) -> DataFrame:
    """Runs of letters (doc_id, word), one of ``every`` by hash without one of its letters."""
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "word").cast("binary"))
    lost = (F.col("h") % F.length("word")).cast("int")
    short = F.concat(F.substr("word", F.lit(1), lost), F.substr("word", lost + 2))
    return runs.withColumn("h", h).select(F.when(F.col("h") % every == 0, short).otherwise(F.col("word")).alias("word"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = spelling_variants.letter_runs(table(spark, sf_dir, "documents"))
    words = spelling_variants.word_counts(with_lost_letters(runs))
    return spelling_variants.group_variants(words).select("word", "form", "root", "n", "n_near", "form_n")


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
    token_files.write(table(spark, sf_dir, "documents"), folder, WORD_VOCABULARY, end_id=2)
    back = token_files.read(spark, folder)
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """Texts (doc_id, text), those of one key in ten by hash with words repeated from some word on."""
    h, g = F.crc32(F.col("doc_id").cast("string").cast("binary")), F.floor(F.crc32(F.col("doc_id").cast("string").cast("binary")) / 10)

    def repeated(ws):
        n = F.size(ws)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        return F.when(n > 0, F.array_join(quality_rules.let(F.struct(a.alias("a"), p.alias("p")), lambda k: F.transform(ws, lambda w, i: F.when(i < k["a"], w).otherwise(F.get(ws, k["a"] + (i - k["a"]) % k["p"])))), " ")).otherwise(F.col("text"))

    ws = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    return docs.select("doc_id", F.when(h % 10 == 0, quality_rules.let(ws, repeated)).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(with_planted_runs(table(spark, sf_dir, "documents").select("doc_id", "text")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit("")).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_chat_format": op1_chat_format,
        "op2_pii": op2_pii,
        "op3_set_join": op3_set_join,
        "op4_quality_model": op4_quality_model,
        "op5_byte_bpe": op5_byte_bpe,
        "op6_language_id": op6_language_id,
        "op7_quality_rules": op7_quality_rules,
        "op8_token_counts": op8_token_counts,
        "op9_decontaminate": op9_decontaminate,
        "op10_toxicity": op10_toxicity,
        "op11_spelling_variants": op11_spelling_variants,
        "op12_token_files": op12_token_files,
        "op13_periodic_runs": op13_periodic_runs,
    }


_SPACES = r"[\x20\x09-\x0D]+"

SET_JOIN_SQL = rf"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_SPACES}'), lambda x: x <> '') AS ws FROM documents),
  sh AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) AS s FROM w WHERE len(ws) >= 4
    UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND 3)),
  n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
  both_have AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
  link AS (SELECT a, b FROM both_have JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
  reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, link.b FROM reach JOIN link ON link.a = reach.r)
SELECT reach.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(r) AS component_id FROM reach LEFT JOIN n ON n.doc_id = reach.doc_id GROUP BY 1"""

QUALITY_SQL = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
  w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '{_SPACES}'), lambda x: x <> '') AS ws FROM d),
  win AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
  rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
  cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, range(0, 8) AS r(k) GROUP BY 1),
  ln AS (SELECT doc_id, l, coalesce(lag(l) OVER o, '') AS a, coalesce(lead(l) OVER o, '') AS b, length(regexp_replace(l, '{_SPACES}', '', 'g')) AS c, length(regexp_replace(l, '[^!]+', '', 'g')) AS shouts
    FROM (SELECT doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS i FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d)) WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
  common AS (SELECT l FROM ln GROUP BY l HAVING count(DISTINCT (a, b)) >= 10 AND 2 * count(DISTINCT (a, b)) >= count(*)),
  judged AS (SELECT *, regexp_matches(l, '[.!?…]["'')»”]*[\x20\x09-\x0D]*$') AND length(regexp_replace(l, '[^#*$%&|<>]+', '', 'g')) * 10 <= c AND length(regexp_replace(l, '[^|]+', '', 'g')) < 3
    AND (shouts < 4 OR shouts * 20 <= c) AND l NOT IN (SELECT l FROM common) AS good FROM ln),
  lines AS (SELECT doc_id, count(*) - count(DISTINCT l) AS dups, sum(c) AS chars, coalesce(sum(c) FILTER (good), 0) AS kept_chars FROM judged GROUP BY 1),
  m AS (SELECT w.doc_id, len(ws) AS n_words, CAST(coalesce(chars, 0) AS BIGINT) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, coalesce(dups, 0) AS n_dup_lines,
    coalesce(cov.n, 0) AS n_repeat_words, coalesce(kept_chars, 0) AS kept_chars FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN cov USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND NOT (word_chars - kept_chars) * 100 > word_chars * 70 AS kept FROM m"""


def oracle_sql() -> dict[str, str]:
    return {"op3_set_join": SET_JOIN_SQL, "op7_quality_rules": QUALITY_SQL}
