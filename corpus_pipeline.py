"""From raw documents to token ids: five stages, each on all that the one before kept.

Defined results of every stage: columns other than ``doc_id``, ``text`` and ``n_chars``
pass through untouched, whatever their names and types; a text of any length is read
whole; an empty table gives an empty table; the rest is said at each stage. Stages with
Python workers bound the session's Arrow batches and Parquet readers (``small_batches``).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import byte_bpe, decontaminate, pii, set_join, toxicity
from scriptorium.llm.durable import checkpoint, shared_folder
from scriptorium.llm.queries import BYTE_RANKS, PATTERN, held_out
from scriptorium.llm.textbatch import small_batches

#: Removed keys up to this number are broadcast; more are joined by a shuffle.
BROADCAST_KEYS = 2_000_000


def _without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """``docs`` without those keys; rows without a key stay."""
    keys = checkpoint(keys.select("doc_id").distinct())
    return docs.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, "doc_id", "left_anti").select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half.

    Null and empty texts score 0 and stay; a score of exactly one half goes; repeated rows
    score alike, so all or none of them stay; rows without a key are scored like others.
    """
    small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    grammar = toxicity.learn(docs, labels.filter(~held_out()), label_col="toxic")
    return docs.filter(toxicity.score_column(grammar, docs["text"]) < 0.5)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least key of each class of near copies (five words, similarity of 0.8).

    Null, empty and blank texts are copies of nothing and stay; a similarity of exactly 0.8
    is a copy; of rows that repeat a key one stays, the one of least text, ties by the other
    columns; rows without a key stay.
    """
    small_batches(spark)
    classes = checkpoint(set_join.jaccard_classes(docs))
    kept = _without(docs, classes.filter("doc_id <> component_id"))
    keys = checkpoint(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).filter("doc_id is not null and _n > 1").select("doc_id"))
    n_keys = keys.count()
    if not n_keys:
        return kept
    # Only rows that repeat a key are grouped; columns of types without an order, such as maps, are ordered as JSON.
    side = F.broadcast(keys) if n_keys <= BROADCAST_KEYS else keys
    whole = F.struct(*docs.columns)
    once = kept.join(side, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(whole, F.struct("text", F.to_json(whole))).alias("_row")).select("_row.*")
    return kept.join(side, "doc_id", "left_anti").select(*docs.columns).unionByName(once.select(*docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark.

    Null and empty texts hold no passage and stay; a document goes by any one item, at the
    exact share of windows too; of rows that repeat a key all go if one holds a passage;
    rows without a key stay.
    """
    small_batches(spark)
    return _without(docs, decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and disclosing terms replaced by marks.

    Every row stays, null texts as null; overlapping spans become the first one's mark; a term
    exactly at a threshold is replaced; repeated rows and rows without a key are treated each.
    ``n_chars``, if there is one, is the length of the text that results.
    """
    spans = next(x for k in range(len(docs.columns) + 1) if (x := "_spans" + "_" * k) not in {c.lower() for c in docs.columns})
    found = pii.find(docs, spans_col=spans)
    masked = found.withColumn("text", pii.replace(F.col("text").cast("string"), F.col(spans)))
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return masked.select(*docs.columns)


def to_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``n_tokens`` and ``token_ids`` of all documents.

    Null and empty texts have no tokens; of pairs of equal rank the leftmost merges first;
    repeated rows and rows without a key give a row each.
    """
    small_batches(spark)
    ids = byte_bpe.encode(docs, BYTE_RANKS, PATTERN)
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.col("ids").alias("token_ids"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("personal_data", mask_personal_data),
    ("byte_bpe", to_token_ids),
]

#: SQL can express neither the learned grammar nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def _delete(spark: SparkSession, path: str) -> None:
    """A folder of any file system that Spark writes to."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage's are written as Parquet and read again, and
    deleted once the next one's are written. Those that the last stage reads remain."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k + 1 == len(STAGES):
            return out
        out.write.parquet(f"{folder}/{name}")
        if k:
            _delete(spark, f"{folder}/{STAGES[k - 1][0]}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
