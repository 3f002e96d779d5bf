import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import decontaminate, set_join, textbatch

SF = "/root/testdata/sf0.001"


def brute_classes(rows, width, pct):
    sets = {}
    for i, text in rows:
        words = (text or "").encode().lower().split()
        own = set(zip(*(words[k:] for k in range(width)), strict=False)) if len(words) >= width else {tuple(words)} if words else set()
        sets[i] = frozenset(own)
    label = {i: i for i in sets}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= pct * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}


def classes(frame, **options):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in set_join.jaccard_classes(frame, **options).collect()}


def near_copies(rng, groups, size, words, edits):
    vocabulary = [f"w{k}" for k in range(5000)]
    out = []
    for g in range(groups):
        base = rng.choices(vocabulary, k=words)
        for k in range(size):
            own = list(base)
            for _ in range(rng.randint(0, edits)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            out.append((g * 1000 + k, " ".join(own)))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("width,pct,edits", [(4, 85, 4), (5, 80, 6)])
def test_classes_equal_brute_force_in_groups_of_near_copies(spark, width, pct, edits):
    rng = random.Random(width)
    passage = " ".join(f"p{k}" for k in range(40))
    rows = near_copies(rng, 6, 25, 120, edits)
    rows += [(50_000 + k, f"{' '.join(rng.choices('abcdefghijklmnop', k=30))} {passage}") for k in range(40)]  # a passage that many share
    rows += [(60_000 + k, rows[0][1]) for k in range(30)] + [(70_000, "a b"), (70_001, "A  b"), (70_002, None), (70_003, "a b c d e")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert classes(frame, width=width, pct=pct) == brute_classes(rows, width, pct)


@pytest.mark.parametrize("block", [1, 32])
def test_classes_equal_brute_force_along_chains(spark, monkeypatch, block):
    """Windows sliding along one text link with their neighbours only; longer and shorter copies lie between the sizes."""
    monkeypatch.setattr(set_join, "BLOCK", block)
    rng = random.Random(11)
    rows = []
    for g in range(4):
        words = rng.choices([f"v{k}" for k in range(3000)], k=420)
        step = (3, 6, 9, 12)[g]
        rows += [(1000 * g + k, " ".join(words[k * step : k * step + 100 + rng.randint(-6, 6)])) for k in range(24)]
        rows += [(1000 * g + 500 + k, " ".join(words[k : 200 - 2 * k] + rng.choices(words, k=k))) for k in range(16)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for width, pct in ((4, 85), (5, 80)):
        want = brute_classes(rows, width, pct)
        assert classes(frame, width=width, pct=pct) == want and 4 < len({c for _, c in want.values()}) < len(rows)


def test_classes_with_many_small_buckets_and_shuffled_joins(spark, monkeypatch):
    rng = random.Random(12)
    rows = near_copies(rng, 5, 12, 60, 3)
    monkeypatch.setattr(set_join, "BUCKET_BYTES", 2000)
    monkeypatch.setattr(set_join, "BROADCAST_KEYS", 0)
    frame = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, id int, token int").repartition(3)
    assert classes(frame) == brute_classes(rows, 5, 80)


def test_classes_of_odd_rows(spark, odd_docs, no_docs):
    got = classes(odd_docs)
    assert got == brute_classes([(r.doc_id, r.text) for r in odd_docs.collect() if r.doc_id is not None], 5, 80)
    assert set_join.jaccard_classes(no_docs).count() == 0
    twice = spark.createDataFrame([(1, "one text of words that is here"), (1, "quite another text of words now"), (2, "x")], "doc_id long, text string")
    assert sorted(classes(twice)) == [1, 2]


def test_bitmaps_bound_the_difference():
    rng = np.random.default_rng(0)
    a, b = (np.unique(rng.integers(0, 2**63, 300).astype(np.uint64)) for _ in range(2))
    b = np.unique(np.concatenate([a[:250], b[:60]]))
    bits = set_join.bitmaps(np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)]), 2)
    apart = sum(int(x).bit_count() for x in (bits[0] ^ bits[1]).view(np.uint64))
    assert 0 < apart <= len(np.setxor1d(a, b))


def test_components_are_least_keys(spark):
    links = [(1, 2), (2, 3), (10, 11), (11, 12), (12, 13), (13, 9), (20, 21)]
    nodes = spark.createDataFrame([(i,) for i in {*sum(links, ()), 99}], "id long")
    got = {r.id: r.label for r in set_join.components(nodes, spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 9, 10: 9, 11: 9, 12: 9, 13: 9, 20: 20, 21: 20, 99: 99}


def test_words_and_hashes():
    texts = ["Ab  c", "", " d\tab", "AB c"]
    raw = [t.encode() for t in texts]
    flat, at = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum(list(map(len, raw)))])
    starts, ends, first = textbatch.words(flat, at)
    assert [bytes(flat[i:j]) for i, j in zip(starts, ends, strict=True)] == [b"Ab", b"c", b"d", b"ab", b"AB", b"c"] and first.tolist() == [0, 2, 2, 4, 6]
    h = textbatch.word_hashes(flat, starts, ends)
    assert h[0] == h[3] == h[4] and h[1] == h[5] and len(set(h.tolist())) == 3


ITEM = "When Maria drove 120 km at 60 km per hour she reached the old harbour town before noon and then walked home along the river"


def contaminated(spark, texts, items, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r.doc_id, r.item_id): r.exchanged for r in decontaminate.contamination(docs, bench, **options).collect()}


def test_exchanged_numbers_and_names_are_caught(spark):
    other = ITEM.replace("Maria", "Peter").replace("120", "3,500").replace("60", "80")
    broken = ITEM.replace("60 km per hour", "75 km per hour") + " . " + ITEM.replace("120", "999")
    texts = [ITEM, "Some words before it. " + other + " and words after it", "Nothing of the kind is here at all, only words", None, "", ITEM.upper(), ITEM[:40]]
    assert contaminated(spark, texts, [ITEM, "short one"]) == {(0, 0): False, (1, 0): True, (5, 0): False}
    assert (0, 0) in contaminated(spark, [broken], [ITEM])


def test_slots_must_stand_for_one_value(spark):
    item = "first take 5 apples from the basket then add 5 pears to it and give 5 plums away to all of the children there"
    same, mixed = item.replace("5", "9"), item.replace("5", "9", 1).replace("add 5", "add 2").replace("give 5", "give 7")
    assert contaminated(spark, [item, same, mixed], [item]) == {(0, 0): False, (1, 0): True}


def test_short_items_and_odd_rows(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, "tiny item words"), (2, None), (None, ITEM), (1, "tiny item words")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "here are tiny item words again"), (1, "here are tiny item words again")], "doc_id long, text string")
    assert [tuple(r)[:2] for r in decontaminate.contamination(docs, bench).collect()] == [(1, 1)]
    assert decontaminate.contamination(odd_docs, bench).count() == 0 and decontaminate.contamination(no_docs, bench).count() == 0
    assert decontaminate.contamination(docs, bench.filter("false")).count() == 0


def test_every_text_of_an_item_is_searched_for(spark):
    other = "Nine grey geese crossed the wide frozen lake while two tired hunters slept under an old crooked pine"
    bench = spark.createDataFrame([(1, ITEM), (1, other), (1, other), (2, other)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"So {ITEM} it goes"), (2, other), (3, f"{other} . {ITEM}"), (4, " ".join(ITEM.split()[:6] + other.split()[:6]))], "doc_id long, text string")
    got = sorted(tuple(r)[:2] for r in decontaminate.contamination(docs, bench).collect())
    assert got == [(1, 1), (2, 1), (2, 2), (3, 1), (3, 2)]


def _words_of(text):
    """(folded word, kind, whether it opens a passage) of each ASCII word, restated from the rules."""
    out, end = [], None
    for m in re.finditer(r"(?:[A-Za-z0-9_]|(?<=[0-9])[.,](?=[0-9]))+", text):
        word = m[0]
        opens = end is None or any(c in '.!?:\n"|' for c in text[end : m.start()])
        kind = "number" if word[0].isdigit() else "name" if word[0].isupper() and len(word) > 1 and not word[1].isupper() and not opens else "plain"
        if kind == "plain" and out and out[-1][1] == "number" and word.lower() in decontaminate.UNITS:
            kind = "unit"
        out.append((word.lower(), kind, opens))
        end = m.end()
    return out


def _in_form(words, form):
    """(canonical word, slot value or None) of each word."""
    slot = ({"number", "name", "unit"}, {"number", "unit"}, set())[form]
    return [(k, w) if k in slot else (w, None) for w, k, _ in words]


def brute_contamination(docs, items):
    """(document, item) pairs by trying every window of every item at every place of every document, one form after another."""
    hits = {}
    for i, item in items:
        words = _words_of(item)
        n, width = len(words), min(len(words), 8)
        found = set()
        for form in range(3):
            if n == 0 or (form == 0 and width < 3):
                continue
            own = _in_form(words, form)
            plain = [sum(s is None for _, s in own[k : k + width]) for k in range(n - width + 1)]
            starts, alone = list(range(n - width + 1)), width < 3
            if form < 2:
                strong = any(p >= min(5, width) for p in plain)
                starts = [k for k in starts if plain[k] >= (min(5, width) if strong else 3)]
                if not strong and n > 8 and len(starts) < 3:
                    starts = []
                alone |= not strong and n <= 8
            need = min(-(-len({tuple(c for c, _ in own[k : k + width]) for k in starts}) * 4 // 5), 6)
            for d, text in docs:
                there = _words_of(text)
                canon = _in_form(there, form)
                lines = defaultdict(list)
                for k in starts:
                    for at in range(len(canon) - width + 1):
                        whole = there[at][2] and (at + width == len(there) or there[at + width][2])
                        if [c for c, _ in canon[at : at + width]] == [c for c, _ in own[k : k + width]] and (whole or not alone):
                            lines[at - k].append((k, at))
                seen = set()
                for pairs in lines.values():
                    values = defaultdict(set)
                    for k, at in pairs:
                        for x in range(width):
                            if own[k + x][1] is not None:
                                values[own[k + x][1]].add(canon[at + x][1])
                    if all(len(v) == 1 for v in values.values()):
                        seen |= {tuple(c for c, _ in own[k : k + width]) for k, _ in pairs}
                if seen and len(seen) >= need:
                    found.add(d)
        hits.update({(d, i): True for d in found})
    return set(hits)


def test_contamination_against_brute_force(spark):
    """Slots, forms and short items on texts made of few words, so that windows meet in part, twice and by chance."""
    rng = random.Random(17)
    plain, names, numbers = "walk home red stone old river and the by to".split(), "Anna Otto Lima".split(), ["3", "14", "2,500", "7.5"]

    def some(n):
        out = []
        for _ in range(n):
            out.append(rng.choice(rng.choices([plain, names, numbers, ["km", "kg", "min"]], [8, 2, 2, 1])[0]))
        return out

    items = [(i, " ".join(some(rng.choice([1, 2, 3, 5, 7, 8, 9, 12, 20])))) for i in range(60)]
    docs = []
    for d in range(240):
        own = items[rng.randrange(60)][1].split()
        for _ in range(rng.randint(0, 2)):
            k = rng.randrange(len(own))
            pool = next((p for p in (names, numbers) if own[k] in p), None)
            new = rng.choice(pool or plain) if rng.random() < 0.9 else "zebra"
            own = [new if (x == own[k] and (pool or rng.random() < 0.2)) else x for x in own] if rng.random() < 0.7 else [*own[:k], new, *own[k + 1 :]]
        stop = rng.choice([" ", ". ", ".\n"])
        text = " ".join(some(rng.randint(0, 6))) + stop + " ".join(own) + stop + " ".join(some(rng.randint(0, 6)))
        docs.append((d, rng.choice([str, str, str, str.lower, str.upper])(text)))
    want = brute_contamination(docs, items)
    got = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert len(want) > 150 and {(r.doc_id, r.item_id) for r in got.collect()} == want


def test_items_without_template_windows_are_searched_for(spark):
    short, dense = "What is 12 times 15?", "Add 3 kg to 14 kg and 15 kg to 9 kg then 2 kg to 6 kg"
    named = "Tell Maria Lopez that Peter Novak from Porto met Clara Weiss of Basel near Lake Como on Friday with Anna Berg and Otto Lang"
    german = "Gestern kaufte der Bauer 12 Kisten Birnen und 30 Kisten Kirschen vom Markt der Stadt Bremen sowie 5 Fässer Wein"
    texts = [f"We ask. {short} It is 180.", "Next: What is 17 times 23? Try it.", "he knows what is 17 times 23 of them", f"so {dense} now", dense.replace("14", "77"), named.lower(), named.upper(), german.lower().replace("12", "48").replace("30", "70")]
    assert contaminated(spark, texts, [short, dense, named, german]) == {(0, 0): False, (1, 0): True, (3, 1): False, (4, 1): True, (5, 2): False, (6, 2): False, (7, 3): True}


def test_items_of_two_words_must_stand_alone(spark):
    assert contaminated(spark, ["of prime numbers and others", "Now. Prime numbers! Yes"], ["Prime numbers", "now"]) == {(1, 0): False, (1, 1): False}


def test_shuffled_path_equals_broadcast_path(spark, monkeypatch):
    docs, bench = (spark.read.parquet(f"{SF}/{x}.parquet") for x in ("documents", "benchmark"))
    small = set(map(tuple, decontaminate.contamination(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 0)
    assert small and set(map(tuple, decontaminate.contamination(docs, bench).collect())) == small


def test_contamination_equals_thirteen_word_runs(spark):
    docs, bench = (spark.read.parquet(f"{SF}/{x}.parquet").collect() for x in ("documents", "benchmark"))
    runs = defaultdict(set)
    for r in bench:
        words = re.findall(r"\w+", r.text.lower())
        for k in range(len(words) - 12):
            runs[tuple(words[k : k + 13])].add(r.item_id)
    want = set()
    for r in docs:
        words = re.findall(r"\w+", r.text.lower())
        want |= {(r.doc_id, i) for k in range(len(words) - 12) for i in runs.get(tuple(words[k : k + 13]), ())}
    got = decontaminate.contamination(spark.createDataFrame(docs), spark.createDataFrame(bench)).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want


def test_pipeline_stages_against_brute_force(spark):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    calm = pipeline.drop_toxic(spark, docs, SF)
    kept = {r.doc_id for r in calm.collect()}
    assert calm.columns == docs.columns and sum(labels[i] == 0 for i in labels if i not in kept) <= 1
    assert all(not re.search(r"\b(idiot|moron|scum)\b", rows[i].text.lower()) for i in kept)
    once = pipeline.drop_near_copies(spark, docs, SF)
    want = brute_classes([(i, r.text) for i, r in rows.items()], 5, 80)
    assert once.columns == docs.columns and {r.doc_id for r in once.collect()} == {i for i, (_, c) in want.items() if i == c}
    clean = pipeline.drop_contaminated(spark, docs, SF)
    hit = {r.doc_id for r in decontaminate.contamination(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == rows.keys() - hit
    masked = pipeline.mask_personal_data(spark, docs, SF)
    assert masked.columns == docs.columns and masked.dtypes == docs.dtypes
    for r in masked.collect():
        assert r.n_chars == len(r.text) and not re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9-]+", r.text)
    whole = pipeline.run(spark, SF)
    ids = [r.doc_id for r in whole.collect()]
    assert whole.columns == ["doc_id", "n_tokens", "token_ids"] and len(ids) == len(set(ids)) and set(ids) <= kept - hit
    assert pipeline.ORACLE_SQL is None and [n for n, _ in pipeline.STAGES] == ["toxicity", "near_copies", "decontamination", "personal_data", "byte_bpe"]


def test_pipeline_stages_take_odd_rows(spark, odd_docs, no_docs):
    import corpus_pipeline as pipeline

    given = Counter(r.doc_id for r in odd_docs.collect())
    for name, stage in pipeline.STAGES:
        out = Counter(r.doc_id for r in stage(spark, odd_docs, SF).collect())
        assert out == (given - Counter([5]) if name == "near_copies" else given), name
        assert stage(spark, no_docs, SF).count() == 0


def test_stages_bound_arrow_batches_by_bytes(spark, no_docs):
    import corpus_pipeline as pipeline
    import pyarrow as pa

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(setting, None)
    texts = spark.range(0, 4000, 1, 1).selectExpr("repeat(string(id % 10), 4000) AS text")
    try:
        for name, stage in pipeline.STAGES:
            if name != "personal_data":
                spark.conf.unset(setting)
                stage(spark, no_docs, SF)
                n = [r.n for r in texts.mapInArrow(sizes, "n long").collect()]
                assert sum(n) >= 16_000_000 and max(n) < textbatch.BATCH_BYTES + 100_000, name
        spark.conf.set(setting, "1m")
        pipeline.to_token_ids(spark, no_docs, SF)
        assert spark.conf.get(setting) == "1m"
    finally:
        spark.conf.set(setting, before) if before else spark.conf.unset(setting)


def test_stages_bound_what_readers_and_batches_hold(spark, no_docs):
    import corpus_pipeline as pipeline

    settings = ("spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    before = [spark.conf.get(x, None) for x in settings]
    try:
        for name, stage in pipeline.STAGES:
            if name != "personal_data":
                for x in settings:
                    spark.conf.unset(x)
                stage(spark, no_docs, SF)
                assert int(spark.conf.get(settings[0])) <= 1 << 20 and int(spark.conf.get(settings[1])) <= 512, name
        spark.conf.set(settings[1], "64")
        pipeline.to_token_ids(spark, no_docs, SF)
        assert spark.conf.get(settings[1]) == "64"
    finally:
        for x, value in zip(settings, before, strict=True):
            spark.conf.set(x, value) if value else spark.conf.unset(x)


def _peak(run):
    """What ``run`` gives, and the most bytes that it held besides what there was."""
    import gc
    import tracemalloc

    gc.collect()
    tracemalloc.start()
    try:
        return run(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_shingles_meet_without_a_second_array_of_all():
    rng, n, sent = np.random.default_rng(3), 60_000, []
    for slice_id in range(8):
        hashes = rng.integers(0, 256, (n, 6)).astype(np.uint8)
        hashes[:500] = np.random.default_rng(4).integers(0, 256, (500, 6))
        hashes[500:520] = slice_id // 2
        owners = rng.integers(0, 200, n).astype(np.uint16)
        owners[:5] = set_join._NOBODY
        sent.append((slice_id, hashes, owners))
    batches = [set_join._batch([(0, k, *(None,) * 5, h.tobytes(), o.tobytes())], set_join._SENT) for k, h, o in sent]
    met, peak = _peak(lambda: [r for b in set_join._meet(iter(batches)) for r in b.to_pylist()])
    times = Counter(x.tobytes() for _, h, _ in sent for x in h)
    for row, (slice_id, hashes, owners) in zip(met, sent, strict=True):
        there = Counter(int(o) for x, o in zip(hashes, owners, strict=True) if times[x.tobytes()] > 1 and o != set_join._NOBODY)
        got = zip(np.frombuffer(row["owners"], np.uint16).tolist(), np.frombuffer(row["counts"], np.int32).tolist(), strict=True)
        assert row["slice"] == slice_id and dict(got) == there
    # A shingle has 8 bytes as it comes and 8 in the array of all.
    assert peak < 20 * n * len(sent)


def test_idle_workers_keep_no_tables_and_windows_are_cut_in_small_slices():
    import pyarrow as pa

    texts = ["the quick brown fox jumps over 12 lazy dogs of Mister Miller again. " * 50] * 300
    batch = pa.RecordBatch.from_arrays([pa.array(range(300), pa.int64()), pa.array(texts)], ["id", "text"])
    cut = textbatch.tidy(decontaminate._cut([8], 5, {8: np.zeros(1, np.uint64)}))
    _, peak = _peak(lambda: sum(1 for _ in cut(iter([batch]))))
    assert peak < 32 << 20
    assert not any(map(len, textbatch._powers))


def test_one_row_of_a_key_stays_with_columns_that_have_no_order(spark):
    import corpus_pipeline as pipeline

    rows = [(1, "b words", {"k": 1}), (1, "a words", {"k": 3}), (1, "a words", {"k": 2}), (2, None, None), (2, None, None), (None, "a words", {"k": 4})]
    docs = spark.createDataFrame(rows, "doc_id long, text string, more map<string,int>")
    kept = pipeline.drop_near_copies(spark, docs, SF)
    assert kept.dtypes == docs.dtypes
    assert {(r.doc_id, r.text, str(r.more)) for r in kept.collect()} == {(1, "a words", "{'k': 2}"), (2, None, "None"), (None, "a words", "{'k': 4}")}


def test_stage_files_are_deleted_once_they_were_read(spark, monkeypatch):
    import corpus_pipeline as pipeline

    seen = []

    def stage(spark, docs, sf_dir):
        seen.append(docs.inputFiles()[0].rsplit("/", 2)[0])
        return docs

    monkeypatch.setattr(pipeline, "STAGES", [(n, stage) for n in ("one", "two", "three", "four")])
    assert pipeline.run(spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert [p.name for p in Path(seen[-1].removeprefix("file:").replace("///", "/")).iterdir()] == ["three"]


def test_queries_return_the_contract(spark):
    from scriptorium.llm import queries

    want = {
        "op1_chat_format": {"conv_id": "bigint", "n_turns": "bigint", "turns_sha256": "string", "loss_chars": "bigint", "loss_sha256": "string", "formatted_chars": "bigint"},
        "op2_pii": {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string"},
        "op3_set_join": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
        "op4_quality_model": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
        "op5_byte_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
        "op6_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
        "op7_quality_rules": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
        "op8_token_counts": {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"},
        "op10_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    }
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name, columns in want.items():
        frame = queries.queries()[name](spark, SF)
        kinds = dict(frame.dtypes)
        assert {c: kinds[c] for c in columns} == columns, name
        if name != "op1_chat_format":
            assert frame.select(F.count_distinct("doc_id")).first()[0] == n, name
