"""Spelling variants, token files and periodic runs against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from scriptorium.llm import periodic_runs, queries, spelling_variants, token_files

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


# Spelling variants


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute_variants(counts, ratio=10):
    by_size = {}
    for w in counts:
        by_size.setdefault(len(w), []).append(w)
    found = {}
    for w, n in counts.items():
        near = [v for k in (-1, 0, 1) for v in by_size.get(len(w) + k, ()) if v != w and one_edit(w, v)]
        best = min(near, key=lambda v: (-counts[v], v)) if near else None
        form = best if near and counts[best] >= ratio * n else None
        found[w] = (n, len(near), form, counts[form] if form is not None else None)

    def root(w):
        while found[w][2] is not None:
            w = found[w][2]
        return w

    return {w: (*x, root(w)) for w, x in found.items()}


def variants(frame, **options):
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling_variants.group_variants(frame, **options).collect()}


def test_variants_equal_brute_force_in_dense_neighbourhoods(spark):
    rng = random.Random(7)
    words = {"", "a", "b", "ab", "ba", "aab", "x" * 900, "x" * 901, "x" * 450 + "y" + "x" * 450, "漢字漢字漢字漢", "漢字漢字漢字", "\U0001f600éééééé", "éééééé"}
    for _ in range(150):
        w = "".join(rng.choice("abé") for _ in range(rng.randint(6, 11)))
        words.add(w)
        for _ in range(4):
            i = rng.randrange(len(w))
            w = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abé") + w[i:], w[:i] + rng.choice("abé") + w[i + 1 :]])
            words.add(w)
    counts = {w: int(10 ** rng.uniform(0, 5)) for w in words}
    frame = spark.createDataFrame(list(counts.items()), "word string, n int")
    assert variants(frame) == brute_variants(counts)
    assert variants(frame, ratio=3) == brute_variants(counts, 3)


def test_ties_go_to_the_least_word_and_chains_to_their_end(spark):
    counts = {"abcdefg": 1, "abcdefh": 10, "abcdefi": 10, "abcdefhi": 100, "abcdefhij": 1000, "zzzzzzz": 5}
    got = variants(spark.createDataFrame(list(counts.items()), "word string, n long"))
    assert got == brute_variants(counts)
    assert got["abcdefg"][2] == "abcdefh" and got["abcdefg"][4] == "abcdefhij" and got["zzzzzzz"] == (5, 0, None, None, "zzzzzzz")


def test_a_block_of_a_pair_is_its_first_difference(spark):
    """Words of a block come in several batches, more than one tile long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        counts = {f"prefix{a}{b}": 1 + ord(a) for a in "abcdefghijkl" for b in "abcdefghijkl"} | {f"prefix{a}": 1 for a in "abcdefghijkl"}
        assert variants(spark.createDataFrame(list(counts.items()), "word string, n long")) == brute_variants(counts)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_op11_equals_brute_force(spark, texts):
    counts = Counter()
    for i, text in texts.items():
        for run in re.findall("[A-Za-zÀ-ÿ]+", text):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    expected = brute_variants({w: n for w, n in counts.items() if len(w) >= 7 and n >= 2})
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in queries.op11_spelling_variants(spark, SF).collect()}
    assert got == expected and any(x[2] for x in expected.values())


def test_variants_of_odd_texts(spark, odd_docs, no_docs):
    counts = spelling_variants.word_counts(spelling_variants.letter_runs(odd_docs), min_count=1)
    assert {r.word: r.n for r in counts.collect()} == {"nothing": 2, "x" * 5000: 1, "Ünïcode": 1}  # only A-Z fold
    assert spelling_variants.group_variants(counts).count() == 3
    assert spelling_variants.group_variants(spelling_variants.word_counts(spelling_variants.letter_runs(no_docs))).count() == 0


# Token files


def test_elias_fano_gives_back_any_ascending_values():
    rng = np.random.default_rng(5)
    for n, most in ((0, 1), (1, 0), (1, 2**63), (7, 3), (2000, 5), (3000, 10**6), (1000, 2**64 - 1)):
        values = np.sort(rng.integers(0, most, n, dtype=np.uint64, endpoint=True))
        own = token_files.EliasFano.of(values)
        assert (own.between(0, n) == values).all()
        for _ in range(20 if n else 0):
            a, b = sorted(rng.integers(0, n + 1, 2).tolist())
            assert (own.between(a, b) == values[a:b]).all()
            assert own.select(int(i := rng.integers(0, n))) == int(values[i])
    with pytest.raises(IndexError):
        token_files.EliasFano.of(np.zeros(1, np.uint64)).select(1)


def test_elias_fano_is_near_the_minimum():
    values = np.cumsum(np.random.default_rng(1).integers(1, 2000, 100_000)).astype(np.uint64)
    bits = 8 * sum(map(len, token_files.EliasFano.of(values).sections())) / len(values)
    assert bits < np.log2(float(values[-1]) / len(values)) + 2.6


def test_op12_equals_the_library(spark, texts):
    library = Tokenizer.from_file(queries.WORD_VOCABULARY)
    start, expected = 0, {}
    for i in sorted(texts):
        ids = [*library.encode(texts[i], add_special_tokens=False).ids, 2]
        expected[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    got = queries.op12_token_files(spark, SF)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in got.collect()} == expected and got.count() == len(expected)


def test_ids_of_odd_strings_equal_the_library():
    rng, library = random.Random(5), Tokenizer.from_file(queries.WORD_VOCABULARY)
    own = token_files.WordIds(queries.WORD_VOCABULARY, 2, remembered=500)
    parts = ["a", "B", "z", "é", "É", "ß", "\u0130", "ı", "e\u0301", "\u0338", "漢", "字", "1", "²", "'", "’", "'s", "'LL", "<|endoftext|>", "<|ENDOFTEXT|>", "<", "|", ">", ".", ",", "***", "&", "-", "_", " ", "\xa0", "\u3000", "\u200b", "\U0001f600", "ﬁ", "ǅ", "Σ", "\n", "\t", "\x0b", "\x1f", "\x85", "\u0958", "ŉ"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert np.frombuffer(own.encode([text.encode()], b"")[0], "<u2").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_strings_are_encoded_once_however_many_pieces_hold_them():
    own = token_files.WordIds(queries.WORD_VOCABULARY, 2, remembered=100)
    encoded, run = [], own._encoded
    own._encoded = lambda xs: encoded.extend(xs) or run(xs)
    marks = [a + b + c for a in "!,.;" for b in "?*%&" for c in ")]#"]
    texts = ["Some Words here", *[" ".join(w + m for m in marks for w in (x, x.upper(), x.title())) for x in ("other", "pieces", "follow")], "some, WORDS!) here."]
    library = Tokenizer.from_file(queries.WORD_VOCABULARY)
    for text in texts:
        assert np.frombuffer(own.encode([text.encode()], b"")[0], "<u2").tolist() == library.encode(text, add_special_tokens=False).ids
    assert encoded.count(b"some") == encoded.count(b"words") == encoded.count(b"here") == 1 and len(encoded) == len(set(encoded)) < 70


def test_ids_of_columns_equal_those_of_single_texts():
    library = Tokenizer.from_file(queries.WORD_VOCABULARY)
    texts = ["left out", None, "", " \n ", "Élan, vital: CAFÉ! ", "a <|endoftext|>. A< b>", "\x0bx\x0cy\r", "left out"]
    own = token_files.WordIds(queries.WORD_VOCABULARY, 4)
    for kind in (pa.string(), pa.large_string()):
        got = own.encode_column(pa.array(texts, kind).slice(1, 6), (2).to_bytes(4, "little")).to_pylist()
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == [[*library.encode(x or "", add_special_tokens=False).ids, 2] for x in texts[1:7]]
    bad = own.encode_column(pa.array([b"\xff", b"ab\xc3, \xe9"], pa.binary()).view(pa.string()), b"").to_pylist()
    assert bad == own.encode(["\ufffd".encode(), "ab\ufffd, \ufffd".encode()], b"")
    assert own.encode_column(pa.array(["", None]), b"").to_pylist() == [b"", b""]


def test_token_files_of_odd_texts_and_keys(spark, odd_docs, no_docs, tmp_path):
    far = spark.createDataFrame([(-(2**63), "far below"), (2**63 - 1, "far above")], "doc_id long, text string")
    docs = odd_docs.unionByName(far, allowMissingColumns=True)
    token_files.write(docs, f"{tmp_path}/odd", queries.WORD_VOCABULARY, end_id=2, shard_bytes=1 << 16)
    rows = sorted(token_files.read(spark, f"{tmp_path}/odd").collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, -(2**63), 1, 2, 3, 4, 5, 5, 6, 7, 2**63 - 1]
    assert [r.start for r in rows] == np.cumsum([0, *[r.n_tokens for r in rows[:-1]]]).tolist()
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in rows if r.doc_id in (1, 2, 3)} == {i: [2] for i in (1, 2, 3)}
    assert rows[5].n_tokens > 60_000
    token_files.write(no_docs, f"{tmp_path}/none", queries.WORD_VOCABULARY, end_id=2)
    assert token_files.read(spark, f"{tmp_path}/none").count() == 0
    with pytest.raises(TypeError):
        token_files.write(docs.withColumn("doc_id", F.lit("a")), f"{tmp_path}/text", queries.WORD_VOCABULARY, end_id=2)


def test_a_hot_key_spans_shards_and_files_of_lost_attempts_are_not_read(spark, tmp_path):
    docs = spark.range(4000, numPartitions=8).select(F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")).alias("doc_id"), F.lit("the same text " * 40).alias("text"))
    folder = f"{tmp_path}/hot"
    token_files.write(docs, folder, queries.WORD_VOCABULARY, end_id=2, shard_bytes=1 << 18)
    (tmp_path / "hot" / "part-00000-lost.tokens").write_bytes(b"half a shard")
    back = token_files.read(spark, folder)
    assert back.count() == 4000 and back.agg(F.max(F.col("start") + F.col("n_tokens")), F.sum("n_tokens")).first()[:] == (4000 * 121, 4000 * 121)
    shards = [token_files.Shard(*_opened(p)) for p in sorted((tmp_path / "hot").glob("part-*.tokens")) if "lost" not in p.name]
    assert sum(5 in s.documents(0, s.about["n_docs"])[0] for s in shards) > 1


def _opened(path):
    from pyarrow import fs

    return fs.LocalFileSystem(), str(path)


# Periodic runs


def brute_runs(words):
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            length = i - start + q
            if length >= max(6, 4 * q):
                found.setdefault((start, length), q)
            i += 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def brute_row(words):
    runs = brute_runs(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
    return runs, best, " ".join(w for i, w in enumerate(words) if i not in gone)


def test_runs_of_mixed_periods_equal_brute_force():
    rng = random.Random(11)
    for _ in range(120):
        own = []
        for _ in range(rng.randint(1, 5)):
            words = []
            for _ in range(rng.randint(0, 6)):
                kinds = rng.choice([2, 3, 40, 1000])
                part = [rng.randrange(kinds) for _ in range(rng.randint(1, 70))]
                words += (part * 8)[: rng.randint(1, len(part) * 8)]
            own.append(words)
        first = np.cumsum([0, *map(len, own)])
        got = periodic_runs.runs_of(np.array([w for x in own for w in x], np.uint64), first)
        assert [tuple(r) for r in got.tolist()] == [(d, *r) for d, x in enumerate(own) for r in brute_runs(x)]


def test_op13_equals_brute_force(spark, texts):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    got = {r.doc_id: r for r in queries.op13_periodic_runs(spark, SF).collect()}
    some = 0
    for i, text in texts.items():
        words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
        h = zlib.crc32(str(i).encode())
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
        if len(words) > 3000:
            continue  # too long for brute force
        runs, best, rest = brute_row(words)
        some += len(runs)
        expected = (len(runs), *(best or (None, None, None)), best and 1000 * best[1] // best[2], sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(rest))
        r = got[i]
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) == expected, i
    assert some and len(got) == len(texts)


def test_runs_of_odd_texts(spark, odd_docs, no_docs):
    got = {r.doc_id: r for r in periodic_runs.find_runs(odd_docs).collect()}
    assert [(r.start, r.length, r.period) for r in got[4].runs] == [(0, 60_000, 1)] and got[4].collapsed == "word end."
    assert all(got[i].runs == [] and got[i].best is None for i in (None, 1, 2, 3, 5, 6, 7)) and got[1].collapsed == "" and got[None].collapsed == "no key here"
    assert periodic_runs.find_runs(no_docs).count() == 0 and periodic_runs.find_runs(odd_docs).count() == 9
    with pytest.raises(ValueError):
        periodic_runs.find_runs(odd_docs, repeats=2)
