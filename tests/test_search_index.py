import re

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import fulltext, search_index

SF = "/root/testdata/sf0.001"
QUERIES = (
    {"terms": ["ontion", "thing"]}, {"terms": ["ontion", "thing"], "mode": "any", "limit": 5}, {"terms": ["the"], "limit": 3}, {"terms": [], "phrase": ["of", "the"], "limit": None}, {"terms": [], "phrase": ["of", "the"], "limit": 4},
    {"terms": ["und"], "prefix": True, "exclude": ["the"], "limit": 30}, {"terms": ["en"], "columns": ["lang"], "limit": None}, {"terms": ["en", "the"], "columns": ["lang", "text"], "limit": 7}, {"terms": ["the"], "mode": "any", "exclude": ["and"], "limit": 2}, {"terms": ["nosuchword"]},
)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")


@pytest.fixture(scope="module")
def index(docs, tmp_path_factory):
    return search_index.write_index(docs, ["text", "lang"], str(tmp_path_factory.mktemp("index")), bucket_docs=4)


def rows(frame):
    return [(r.doc_id, round(r.score, 9)) for r in frame.orderBy(F.desc("score"), "doc_id").collect()]


@pytest.mark.parametrize("options", QUERIES, ids=str)
def test_the_index_answers_as_the_texts(docs, index, options):
    assert rows(index.search(**options)) == rows(fulltext.search_texts(docs, ["text", "lang"], **options))


def test_buckets_that_cannot_reach_the_best_are_skipped(index):
    found, seen = index.search_counted(["the"], limit=1)
    assert found.count() == 1 and search_index.PROBE <= seen["rated"] < seen["buckets"]


def test_a_query_reads_the_row_groups_of_its_terms(spark, index):
    plan = index._blocks(["ontion"], False, None).select("doc_id")._jdf.queryExecution().toString()
    assert re.search(r"PushedFilters: \[.*EqualTo\(term,ontion\)|PushedFilters: \[.*In\(term", plan) and "positions" not in re.search(r"ReadSchema: \S+", plan)[0]
    ranges = [(r.least, r.most) for r in spark.read.parquet(f"{index.path}/postings").groupBy(F.input_file_name()).agg(F.min("term").alias("least"), F.max("term").alias("most")).collect()]
    assert all(a[1] <= b[0] for a, b in zip(sorted(ranges), sorted(ranges)[1:], strict=False))


def test_an_empty_index(spark, docs, tmp_path):
    own = search_index.write_index(docs.filter("false"), ["text"], str(tmp_path / "none"))
    assert own.search(["the"]).count() == 0 and own.report().first()[:] == (0, 0, 0, 0)


def test_texts_are_made_tokens_once(docs, monkeypatch):
    plans = []
    keep = fulltext.checkpoint
    monkeypatch.setattr(fulltext, "checkpoint", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df))
    fulltext.search_texts(docs, ["text"], ["one", "two"], phrase=["of", "the"], exclude=["x"], limit=None)
    assert len(plans) == 1 and plans[0].count("regexp_extract_all") == 1


def test_postings_of_a_document_are_grouped_where_it_is(docs):
    made = fulltext.build_postings(docs, ["text", "lang"])
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    words = docs.select("doc_id", F.posexplode(fulltext.tokens(F.col("text"))).alias("pos", "term"))
    plain = words.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))
    own = lambda df: sorted((r.doc_id, r.term, r.tf, tuple(r.positions)) for r in df.collect())
    assert own(made.filter("field = 'text'")) == own(plain)


def shuffled(spark):
    """Bytes of shuffle files that the session's executors have written so far."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    own = sc.statusStore().executorList(True)
    return sum(own.apply(k).totalShuffleWrite() for k in range(own.size()))


def test_postings_are_stored_in_the_index_only(spark, tmp_path, monkeypatch):
    texts = spark.range(2000).select(F.col("id").alias("doc_id"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(60)), lambda k: F.concat(F.lit("w"), ((k * 7 + F.col("id")) % 90).cast("string"))), " ").alias("text")).repartition(5)
    stored = []
    monkeypatch.setattr(search_index, "checkpoint", lambda df: stored.append(df.count()) or df)
    texts.write.parquet(str(tmp_path / "texts"))
    texts = spark.read.parquet(str(tmp_path / "texts"))
    before = shuffled(spark)
    own = search_index.write_index(texts, ["text"], str(tmp_path / "index"), bucket_docs=16)
    # 120,000 postings of 90 terms; only counts of terms are shuffled.
    assert not stored and shuffled(spark) - before < 100_000
    assert own.report().first()[:] == (2000, 90, 120_000, 120_000)


def test_buckets_of_several_segments_and_slices(spark, tmp_path):
    spark.createDataFrame([(k, "a b c " * 40_000 + f"own{k % 3} rare{k}", "b own0") for k in range(12)] + [(50, "", None), (51, None, "own1")], "doc_id long, text string, more string").repartition(2, "doc_id").write.parquet(str(tmp_path / "texts"))
    texts = spark.read.parquet(str(tmp_path / "texts"))
    own = search_index.write_index(texts, ["text", "more"], str(tmp_path / "index"), bucket_docs=3)
    buckets = spark.read.parquet(f"{own.path}/postings").select("bucket", F.explode("doc_id").alias("doc_id")).distinct().groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()
    assert sum(b.n for b in buckets) == 13 and max(b.n for b in buckets) <= 3 and len(buckets) == own.stats["buckets"] and own.stats["n_docs"] == 13
    for options in ({"terms": ["a", "own1"]}, {"terms": ["own0", "rare5"], "mode": "any", "limit": 4}, {"terms": ["own0"], "limit": 2}, {"terms": [], "phrase": ["c", "own2"]}):
        assert rows(own.search(**options)) == rows(fulltext.search_texts(texts, ["text", "more"], **options))
    held = {(r.term, r.field): r.df for r in own.terms.collect()}
    assert (held["own0", None], held["own0", "text"], held["own0", "more"], held["own1", None]) == (12, 4, 12, 5)


def test_any_word_from_an_index_written_without_a_shuffle(spark, tmp_path):
    spark.range(3000).select(F.col("id").alias("doc_id"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(50)), lambda k: F.concat(F.lit("w"), ((k * k + F.col("id")) % 70).cast("string"))), " ").alias("text")).write.parquet(str(tmp_path / "texts"))
    texts = spark.read.parquet(str(tmp_path / "texts"))
    before = shuffled(spark)
    own = search_index.write_index(texts, ["text"], str(tmp_path / "index"), bucket_docs=16)
    assert shuffled(spark) - before < 100_000
    options = {"terms": ["w1", "w2", "none"], "mode": "any", "limit": 10}
    assert rows(own.search(**options)) == rows(fulltext.search_texts(texts, ["text"], **options))
