import functools
import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import byte_bpe, chat_format, language_id, pii, quality_model, quality_rules, queries, token_counts, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def held(rows):
    return {r.doc_id: r for r in rows}


def test_token_counts_equal_the_library(spark, docs, odd_docs, no_docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.WORD_VOCABULARY)
    special = spark.createDataFrame([(1, "a<|endoftext|>b  C'est l'été é <|startoftext|>"), (2, None)], "doc_id long, text string")
    for frame in (docs.limit(60), odd_docs, special):
        texts = Counter((r.doc_id, len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in frame.collect())
        assert Counter(map(tuple, token_counts.count_tokens(frame, queries.WORD_VOCABULARY, batch_bytes=4096).collect())) == texts
    assert token_counts.count_tokens(no_docs, queries.WORD_VOCABULARY).count() == 0


def _tiktoken():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=queries.PATTERN, mergeable_ranks=byte_bpe.read_ranks(queries.BYTE_RANKS), special_tokens={})


def test_bpe_equals_the_library_and_round_trips(docs, odd_docs, no_docs):
    library = _tiktoken()
    for frame in (docs.limit(60), odd_docs):
        texts = [(r.doc_id, r.text or "") for r in frame.collect()]
        got = byte_bpe.decode(byte_bpe.encode(frame, queries.BYTE_RANKS, queries.PATTERN), queries.BYTE_RANKS).collect()
        want = Counter((i, tuple(library.encode_ordinary(x)), x.encode()) for i, x in texts)
        assert Counter((r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in got) == want
    assert byte_bpe.encode(no_docs, queries.BYTE_RANKS, queries.PATTERN).count() == 0


def test_bpe_pieces_of_all_lengths():
    library, model = _tiktoken(), byte_bpe.BytePairs(byte_bpe.read_ranks(queries.BYTE_RANKS))
    rng = random.Random(5)
    pieces = ["".join(rng.choices("abehinorst é漢🙂'", k=rng.randint(1, 70))).encode() for _ in range(800)] + [b"a" * n for n in (511, 512, 513, 900)]
    assert model.encode_pieces(pieces) == [tuple(library._encode_single_piece(p)) for p in pieces]


def _out_of_place(text, profiles, size):
    count = Counter()
    for word in re.findall(r"[^\W\d_]+", text.lower()):
        padded = f" {word} "
        for n in (1, 2, 3):
            count.update(g for i in range(len(padded) - n + 1) if (g := padded[i : i + n]).strip() and (n < 3 or " " not in g[1:-1]))
    order = sorted(count, key=lambda g: (-count[g], [len(g), *map(ord, g)]))[:size]
    return {lang: sum(abs(p[g] - k) if g in p else size for k, g in enumerate(order)) for lang, p in profiles.items()}, order


def test_language_profiles_against_brute_force(spark):
    train = spark.createDataFrame([("the cat and the hat that sat", "en"), ("der hund und die katze das ist", "de"), (None, "en"), ("x", None)], "text string, lang string")
    learned = language_id.learn_profiles(train, size=40).collect()
    own = {}
    for lang, text in (("en", "the cat and the hat that sat"), ("de", "der hund und die katze das ist")):
        order = _out_of_place(text, {}, 40)[1]
        own[lang] = {g: k for k, g in enumerate(order)}
        code = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
        assert {r["gram"]: r["rank"] for r in learned if r["lang"] == lang} == {code(g): k for g, k in own[lang].items()}
    model = language_id.Profiles(learned, 40, 3)
    for text in ("that cat", "die katze und", "hat"):
        far = _out_of_place(text, own, 40)[0]
        assert model.predict(text)[0] == min(sorted(far), key=far.get)


def test_language_edge_cases(docs, odd_docs, no_docs):
    found = [(r.doc_id, r.lang_pred, r.score) for r in language_id.identify(docs, odd_docs).collect()]
    assert all(p == "und" and s == 0 for i, p, s in found if i in (1, 2, 3)) and len(found) == 9 and all(0 <= s <= 1 for *_, s in found)
    assert language_id.identify(docs, no_docs).count() == 0
    clash = odd_docs.withColumnsRenamed({"n": "lang_pred", "source": "score"})
    assert sorted(map(str, language_id.identify(docs, clash).collect())) == sorted(map(str, language_id.identify(docs, odd_docs).collect()))
    assert {r.lang_pred for r in language_id.identify(no_docs, odd_docs).collect()} == {"und"}
    right = held(docs.collect())
    some = [r for r in language_id.identify(docs.filter(~queries.held_out()), docs).collect() if len(right[r.doc_id].text) > 200]
    assert sum(r.lang_pred == right[r.doc_id].lang for r in some) / len(some) > 0.98


def test_quality_rules_against_brute_force(spark, docs, odd_docs, no_docs):
    def brute(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        at = defaultdict(list)
        for i in range(len(words) - 7):
            at[tuple(words[i : i + 8])].append(i)
        covered = {i + k for own in at.values() if len(own) > 1 for i in own for k in range(8)}
        lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)

    planted = spark.createDataFrame([(1, "a b c d e f g h\n" * 3 + "| Home | About | Contact |\nA good line of text ends here."), (2, "x\x0b\x0cy   z")], "doc_id long, text string")
    for frame in (docs, odd_docs.filter("doc_id <> 4"), planted):
        rows = quality_rules.judge(frame, prefix="q_").collect()
        for r in rows:
            assert (r.q_n_words, r.q_word_chars, r.q_n_symbols, r.q_n_dup_lines, r.q_n_repeat_words) == brute(r.text)
    long = quality_rules.judge(odd_docs.filter("doc_id = 4"), prefix="q_").first()
    assert long.q_n_repeat_words == 60_000 and long.q_base_failed and not long.q_kept
    assert quality_rules.judge(no_docs, prefix="q_").count() == 0
    clean = "A plain sentence about nothing in particular ends here. " * 1 + "Another one follows it with more words, and then it stops too."
    judged = quality_rules.judge(spark.createDataFrame([(clean,), (clean + "\nHome | News | Shop | Help",), ("Home | News | Shop | Help | One | Two\n" * 1 + "menu menu menu one two three four five six seven eight nine ten eleven",)], "text string")).collect()
    assert [r.kept for r in judged] == [True, True, False] and judged[1].clean_text == clean


def test_boilerplate_is_learned_from_lines_of_different_documents(spark, monkeypatch):
    rng = random.Random(7)
    words = [f"w{k}" for k in range(400)]
    line = lambda: " ".join(rng.choices(words, k=9)) + "."
    rows = [(i, "\n".join([line(), "Follow us on all channels.", line(), line()])) for i in range(30)]
    copied = [line() for _ in range(5)]
    rows += [(100 + i, "\n".join(copied[: i % 5] + ([line()] if i % 3 == 0 else []) + copied[i % 5 :])) for i in range(120)]
    rows += [(300, "Follow us on all channels.\n" + "so short a text that it is mostly such a line " * 2), (301, None), (302, "Follow us on all channels.")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    contexts = defaultdict(Counter)
    for _, text in rows:
        lines = (text or "").split("\n") if text else []
        for a, x, b in zip([None, *lines], lines, [*lines[1:], None], strict=False):
            contexts[x][a, b] += 1
    common = {x for x, c in contexts.items() if len(c) >= 10 and 2 * len(c) >= c.total()}
    assert common == {"Follow us on all channels."}
    got = {r.doc_id: r for r in quality_rules.judge(frame).collect()}
    for i, text in rows:
        good = [x for x in (text or "").split("\n") if x not in common and x.rstrip().endswith(".")]
        assert got[i].clean_text == "\n".join(good)
    monkeypatch.setattr(quality_rules, "SET_ROWS", 0)
    assert {r.doc_id: r for r in quality_rules.judge(frame).collect()} == got


def test_a_line_must_end_like_a_sentence(spark):
    rows = [("It ends. Not here",), ("It ends here.",), ('He said "so."  ',), ("Is it? (Yes!)",), ("One | two | three | four.",), ("wow!!!!!",), ("$$$ %%% &&& a.",)]
    judged = quality_rules.judge(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, text string")).orderBy("i").collect()
    assert [bool(r.clean_text) for r in judged] == [False, True, True, True, False, False, False]


def test_quality_rules_clashing_names(spark):
    frame = spark.createDataFrame([("a b.", 1, 2, 3, 4)], "text string, _text int, _lines int, _key int, kept int")
    with pytest.raises(ValueError):
        quality_rules.judge(frame)
    assert quality_rules.judge(frame, prefix="q_").select("_text", "_lines", "_key", "kept", "q_n_words").first() == (1, 2, 3, 4, 2)


def test_quality_model(spark, docs, odd_docs, no_docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality_model.fit(docs, labels, label_col="quality")
    scores = {r.doc_id: r.score for r in quality_model.score(docs, model).collect()}
    good, bad = (np.array([scores[r.doc_id] for r in labels.collect() if r.quality == q]) for q in (1, 0))
    assert (good[:, None] > bad).mean() > 0.95
    odd = quality_model.score(odd_docs, model).collect()
    assert len(odd) == 9 and all(0 <= r.score <= 1 for r in odd) and len({r.score for r in odd if r.doc_id == 5}) == 1
    assert quality_model.score(no_docs, model).count() == 0
    assert {r.score for r in quality_model.score(odd_docs, quality_model.fit(docs, labels.filter("false"), label_col="quality")).collect()} == {0.5}


def test_attention_gradient():
    rng = np.random.default_rng(1)
    model = quality_model.AttentionModel(width=5, gate=4)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    x, begin, y = rng.standard_normal((7, quality_model.N_FEATURES)) * 0.1, np.array([0, 3, 4, 7]), np.array([1.0, 0.0, 1.0])
    loss = lambda: -np.mean(y * np.log(p := model._forward(x, begin)[-1]) + (1 - y) * np.log(1 - p))
    grad = model._gradient(x, begin, y)
    for name in "VUwbd":
        flat, own = model.p[name].reshape(-1), grad[name].reshape(-1)
        flat[1 % len(flat)] += 1e-5
        up = loss()
        flat[1 % len(flat)] -= 2e-5
        down = loss()
        flat[1 % len(flat)] += 1e-5
        assert abs((up - down) / 2e-5 - own[1 % len(flat)]) < 1e-5


def test_bags_that_are_not_kept_give_the_same_model(spark, docs, monkeypatch):
    labels = spark.read.parquet(f"{SF}/labels.parquet").limit(40)
    models = []
    for most in (quality_model.KEEP_BYTES, 1000):
        monkeypatch.setattr(quality_model, "KEEP_BYTES", most)
        models.append(quality_model.fit(docs, labels, label_col="quality").p)
    assert all(np.array_equal(models[0][k], models[1][k]) for k in models[0])


def test_mini_batches_hold_every_passage():
    rng = np.random.default_rng(4)
    sizes = [1, 3, 500, quality_model.BATCH_PASSAGES + 5, *rng.integers(1, 400, 300).tolist()]
    bags = [(np.full((n, 2), k, np.float32), k % 2) for k, n in enumerate(sizes)]
    seen = list(quality_model.mini_batches(bags))
    assert [len(y) for *_, y in seen][:2] == [3, 1] and all(len(y) <= quality_model.BATCH for *_, y in seen)
    assert np.array_equal(np.concatenate([x[:, 0] for x, *_ in seen]), np.repeat(np.arange(len(sizes)), sizes))
    assert np.concatenate([np.diff(b) for _, b, _ in seen]).tolist() == sizes and np.concatenate([y for *_, y in seen]).tolist() == [k % 2 for k in range(len(sizes))]
    assert list(quality_model.mini_batches([])) == []


def test_quality_model_takes_repeated_keys_and_clashing_names(spark):
    rows = [(i, "A plain line of words." if i % 2 else "$$$ ### !!! &&&", i, i) for i in range(40)] + [(1, "another text", 1, 1), (None, "no key", 0, 0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, label int, id int")
    labels = frame.select("doc_id", (F.col("doc_id") % 2).alias("quality"), "id")
    scores = {(r.doc_id, r.score) for r in quality_model.score(frame, quality_model.fit(frame, labels, label_col="quality")).collect()}
    assert len({i for i, _ in scores}) == 41 and min(s for i, s in scores if i is not None and i % 2 and i > 1) > max(s for i, s in scores if i is not None and not i % 2)


def test_encode_counts_every_byte():
    flat = np.frombuffer(("one two  three\nfour " * 100 + "Ä|").encode(), np.uint8)
    x, begin = quality_model.encode(flat, np.array([0, len(flat), len(flat)]))
    assert begin.tolist() == [0, 7, 8] and np.allclose((x[:7, :256] ** 2).sum(axis=1), 1, atol=1e-4) and not x[7, :256].any()


def test_toxicity_grammar():
    g = toxicity.Grammar({"zork*": 2.0, "blip": 1.5})
    assert g.score("you are an idiot") > g.score("he is an idiot") > 0.5 and g.score("you idiot") > 0.5
    for lone in ("an idiot", "trash day is tuesday", "the idiot sat in a room", "never call anyone an idiot", "she wrote that the teacher of his sons was an idiot", "nobody would say that of you or of any other idiot"):
        assert g.score(lone) < 0.5, lone
    assert g.score("what a stupid idiot") > 0.5 and g.score("an idiot. a moron.") > 0.5 and g.score("an idiot. an idiot.") < 0.5
    assert g.score("you are not an idiot") < 0.5 and g.score("she said he was an idiot") < 0.5
    assert g.score("she said so. you idiot") > 0.5
    assert g.score("i will kill you") > 0.5 and g.score("they kill time") < 0.5
    assert g.score("a zorker here") == 0 and toxicity.Grammar({"zorke*": 2.0}).score("you zorker") > 0.5
    assert g.score(None) == g.score("") == g.score("a nice day.") == 0
    assert g.clauses("fine here. you blip! ok")[0][0] == "you blip!"


def test_composition_equals_the_parts():
    parts = [toxicity._insult(), toxicity._threat(), toxicity._counting(toxicity.TARGET, 3, 1.5, (toxicity.INSULT,)), toxicity._counting(toxicity.REPORT, 0, 0.2, (toxicity.INSULT,))]
    to, factor, emits = toxicity.compose(parts)
    rng = random.Random(2)
    state, own = 0, [p[0] for p in parts]
    for _ in range(500):
        symbol = rng.randrange(toxicity.END + 1)
        steps = [p[1](s, symbol) for p, s in zip(parts, own, strict=True)]
        assert abs(factor[state][symbol] - np.prod([x[1] for x in steps])) < 1e-12 and emits[state][symbol] == any(x[2] for x in steps)
        state, own = to[state][symbol], [x[0] for x in steps]


def test_toxicity_learns(spark, odd_docs, no_docs):
    rows = [(i, f"text {chr(97 + i % 26) * 3} " + ("grobian here" if i % 4 == 0 else "fine here"), int(i % 4 == 0)) for i in range(80)]
    rows += [(100 + i, "one toxic text of many copies", 1) for i in range(12)] + [(200 + i, "one more", 0) for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    grammar = toxicity.learn(frame, frame.select("doc_id", "toxic"), label_col="toxic")
    assert {r.doc_id for r in toxicity.score(frame, grammar).collect() if r.score > 0} == {i for i in range(80) if i % 4 == 0}  # copies teach nothing
    assert [r.doc_id for r in frame.filter(toxicity.score_column(grammar, frame["text"]) > 0).collect()] == list(range(0, 80, 4))
    assert grammar.score("a grobian here") < 0.5 < grammar.score("you grobian") and grammar.patterns == dict.fromkeys(toxicity.PATTERNS, toxicity.STRONG)
    assert all(r.score == 0 for r in toxicity.score(odd_docs, grammar).collect()) and toxicity.score(no_docs, grammar).count() == 0
    assert toxicity.learn(no_docs, frame.select("doc_id", "toxic"), label_col="toxic").stems == {}


def test_learned_words_equal_brute_force(spark):
    rng = random.Random(6)
    rows = []
    for i in range(400):
        toxic = int(i % 5 == 0)
        words = rng.choices([f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(200)], k=12)
        words += rng.choices(["grobian", "lump", "path", "wort"], weights=[5, 3, 0 if toxic else 2, 1], k=1) if toxic or rng.random() < 0.15 else []
        rng.shuffle(words)
        rows.append((i, " ".join(words), None if i % 97 == 0 else toxic))
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    grammar = toxicity.learn(frame, frame.select("doc_id", "toxic"), label_col="toxic")
    n, holds, contexts = Counter(t for _, _, t in rows if t is not None), defaultdict(Counter), defaultdict(set)
    for _, text, toxic in rows:
        if toxic is not None:
            words = text.split()
            for w in set(words):
                holds[w][toxic] += 1
            for b, w, a in zip(["", *words], words, [*words[1:], ""], strict=False):
                if toxic:
                    contexts[w].add((b, a))
    want = {}
    for w, c in holds.items():
        bad, good = c[1], c[0]
        total, share = bad + good, bad / (bad + good)
        low = (share + 1.64**2 / (2 * total) - 1.64 * math.sqrt(share * (1 - share) / total + 1.64**2 / (4 * total**2))) / (1 + 1.64**2 / total)
        table = [(bad, total * n[1]), (good, total * n[0]), (n[1] - bad, (n[0] + n[1] - total) * n[1]), (n[0] - good, (n[0] + n[1] - total) * n[0])]
        gain = 2 * sum(x * math.log(x * (n[0] + n[1]) / y) for x, y in table if x)
        if bad >= 4 and low >= 0.5 and gain >= 20 and len(contexts[w]) >= min(8, 0.8 * bad):
            want[w] = round(min(1.3, -math.log(1 - low)), 9)
    learned = {w: round(v, 9) for w, v in grammar.insults.items() if w not in toxicity.FIXED}
    assert learned == want and "grobian" in want and "path" not in want and not grammar.stems


def test_plain_words_are_no_insults(spark):
    frame = spark.createDataFrame([(i, ("what a pathetic worthless idiot " if i % 4 == 0 else "all is well ") + chr(97 + i % 26) * 3, int(i % 4 == 0)) for i in range(160)], "doc_id long, text string, toxic int")
    grammar = toxicity.learn(frame, frame.select("doc_id", "toxic"), label_col="toxic")
    assert all(grammar.score(x) == 0 for x in ("we walked the path to the harbour", "it is worth the trip", "das ist mein Wort", "a German idiom"))
    assert grammar.score("you idiot") > 0.5


def test_an_insult_counts_once_and_more_with_a_target():
    g = toxicity.Grammar({"blip": 1.0}, {})
    assert g.score("blip") == g.score("blip. blip. blip") < 0.5 < g.score("you blip") and g.score("they are not a blip") < 0.2


def test_patterns_are_learned_from_labels(spark):
    """A pattern that meets insults in clean documents too is worth less than one that does not."""
    rows = [(i, ("you grobian lump " if i % 4 == 0 else "you sat there well and so is the cat of a man ") + chr(97 + i % 26) * 3, int(i % 4 == 0)) for i in range(160)]
    rows += [(200 + i, f"the grobian {chr(97 + i)} sat there", 1) for i in range(26)] + [(300 + i, f"there is a lump of {chr(97 + i) * 2}", 0) for i in range(10)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    grammar = toxicity.learn(frame, frame.select("doc_id", "toxic"), label_col="toxic")
    assert grammar.patterns["target"] == grammar.patterns["pair"] == 1 + toxicity.least_share(40, 0) and grammar.patterns["copula"] == 1 + toxicity.least_share(0, 10)
    assert grammar.score("you lump") > 0.5 > grammar.score("it is a lump") > 0


def test_the_grammar_changes_predictions_on_held_out_documents(spark):
    """Without patterns, negations and reports the predictions are others."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{x}.parquet") for x in ("documents", "labels"))
    grammar = toxicity.learn(docs, labels.filter(~queries.held_out()), label_col="toxic")
    ablated = toxicity.Grammar(grammar.insults, {f"!{k}": v for k, v in grammar.threats.items()}, dict.fromkeys(toxicity.PATTERNS, 1.0))
    ablated.table = toxicity.compose([toxicity._insult(), toxicity._threat()])
    held = docs.join(labels.filter(queries.held_out()).filter("toxic is not null"), "doc_id").select("text", "toxic")
    rows = [(r.toxic, grammar.score(r.text) >= 0.5, ablated.score(r.text) >= 0.5) for r in held.collect()]
    hits = lambda k: sum(t and r[k] for t, *r in rows for r in [r])
    marked = lambda k: sum(r[k] for _, *r in rows)
    print("held out", len(rows), "toxic", sum(t for t, *_ in rows), "found, marked", hits(0), marked(0), "ablated", hits(1), marked(1), grammar.patterns)
    assert sum(a != b for _, a, b in rows) > 0
    assert hits(0) >= 0.9 * sum(t for t, *_ in rows) and hits(0) >= 0.97 * marked(0)


def test_toxicity_takes_clashing_names_and_repeated_keys(spark):
    rows = [(i, "such a grobian here" if i % 4 == 0 else "fine here", 1) for i in range(80)] + [(None, "no key", 1), (0, "a second text", 1)]
    frame = spark.createDataFrame([(*r, r[0]) for r in rows], "doc_id long, text string, toxic int, id long")
    labels = spark.createDataFrame([(i, int(i % 4 == 0), i) for i in range(80)] + [(0, 0, 0), (None, 1, 1)], "doc_id long, toxic int, id int")
    assert toxicity.score(frame, toxicity.learn(frame, labels, label_col="toxic")).count() == 82


def test_fixed_words_of_clean_documents_do_not_count(spark):
    said = ["put the trash out", "a pathetic fallacy here", "we beat them by two goals", "the loser shook hands"]
    rows = [(i, f"text {chr(97 + i % 26) * 3} " + ("grobian moron here" if i % 4 == 0 else said[i % 4]), int(i % 4 == 0)) for i in range(160)]
    rows += [(500 + i, f"{said[0]} number {chr(97 + i)}", 0) for i in range(20)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    grammar = toxicity.learn(frame, frame.select("doc_id", "toxic"), label_col="toxic")
    assert all(grammar.score(x) == 0 for x in said) and grammar.score("you moron") > 0.5 > grammar.score("what a moron") > 0
    assert grammar.score("i will kill you") > 0.5 and grammar.score("you idiot") > 0.5  # not in any labelled document
    untaught = toxicity.learn(frame, frame.filter("toxic = 0").select("doc_id", "toxic"), label_col="toxic")
    assert untaught.score("we beat them") > 0.5


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _valid(kind, value):
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    digits = re.sub(r"\D", "", value)
    if kind == "card":
        return 16 <= len(digits) <= 19 and sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(digits))) % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def test_pii_patterns_against_brute_force(spark, docs, odd_docs):
    rng = random.Random(3)
    parts = ["a@b.c", "@", ".", "1.2.3.4", "12", "+1", " ", "-", "(", ")", "é", "x_", "%", "4111111111111111", "255", "0", "9", "\n", "+4"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(400)] + ["1" * 20_000, "1 " * 9000, "a" * 30_000 + "@", "a@b.co_x@y.com", "1.2.3.4.5.6.7.8", "007.008.9.255 256.1.1.1 5555 5555 5555 4444", None]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for own in (frame, docs.select("doc_id", "text"), odd_docs.select("doc_id", "text")):
        for r in pii.base_spans(own, "text", "spans").collect():
            want = [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, r.text or "", re.A) if _valid(k, m[0])]
            assert [(s.kind, s.start, s.end) for s in r.spans] == want


def test_pii_disclosing_terms(spark):
    rows = [(i, f"filler{i} words the and common text number{i} here") for i in range(60)]
    rows += [(100, "zanzibar lead writes from ann@corp.example about the plan"), (101, "mail ann@corp.example when zanzibar is due"), (102, "we saw zanzibar with ann@corp.example last week"), (102, "we saw zanzibar with ann@corp.example last week")]
    frame = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, _id string")
    found = pii.find(frame, max_chance=math.inf).withColumn("masked", pii.replace(F.col("text"), F.col("spans"))).filter("doc_id >= 100").orderBy("doc_id").collect()
    assert [r.masked for r in found] == [" lead writes from [email] about the plan", "mail [email] when  is due", "we saw  with [email] last week", "we saw  with [email] last week"]
    rated = pii.disclosing_terms(frame, max_chance=math.inf)[0].collect()
    assert {(r.kind, r.level, r.value, r.term, r.disclosure) for r in rated} == {("email", level, value, "zanzibar", 1.0) for level, value in (("value", "ann@corp.example"), ("part", "@corp.example"), ("kind", "*"))}
    # Three of 63 documents are no evidence: 3 entities and 552 words of documents make such a pair likely enough.
    assert pii.disclosing_terms(frame)[0].count() == 0


def test_pii_planted_pairs_found_and_chance_shows_none(spark, docs):
    """Names beside addresses of the given corpus are found; with the values dealt to documents at random no term is."""
    rng = random.Random(12)
    rows = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
    found = {r.doc_id: [s.value for s in r.spans] for r in pii.base_spans(docs.select("doc_id", "text"), "text", "spans").collect()}
    bare = [(i, functools.reduce(lambda t, v: t.replace(v, " "), found[i], t)) for i, t in rows]
    values = [v for own in found.values() for v in own]
    assert len(values) > 20

    def insert(text, part):
        words = text.split(" ")
        words.insert(rng.randint(0, len(words)), part)
        return " ".join(words)

    dealt = dict(bare)
    for v in values + [f"user{k % 9}@dealt.example" for k in range(60)]:
        i = rng.choice(bare)[0]
        dealt[i] = insert(dealt[i], v)
    schema = "doc_id long, text string"
    assert pii.disclosing_terms(spark.createDataFrame(list(dealt.items()), schema))[0].count() == 0
    for k in range(8):
        for i, _ in rng.sample(bare, 5):
            dealt[i] = insert(insert(dealt[i], f"qzxname{k}"), f"owner{k}@planted.example")
    rated = pii.disclosing_terms(spark.createDataFrame(list(dealt.items()), schema))[0].collect()
    assert {r.term for r in rated} == {f"qzxname{k}" for k in range(8)}
    assert {(r.term, r.value) for r in rated if r.level == "value"} >= {(f"qzxname{k}", f"owner{k}@planted.example") for k in range(8)}


def test_pii_terms_in_the_whole_document_and_in_all_that_hold_them(spark):
    rows = [(i, f"filler{i} words the and common text number{i} here with so many others in it") for i in range(600)]
    rows += [(700, "Li wrote as jdoe42 and said that the words here and others in it with text so common call +49 30 1234567 today"), (701, "ring +49 30 1234567 soon and ask with many words and others so common in the text here for jdoe42 or Li")]
    rows += [(702, "nobody but jdoe42 has the number here"), (None, "it was jdoe42 again")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.find(frame, threshold=0.8, max_chance=math.inf).filter("doc_id is null or doc_id >= 700").withColumn("masked", pii.replace(F.col("text"), F.col("spans")))
    masked = {r.doc_id: r.masked for r in found.collect()}
    assert not any("jdoe42" in m or re.search(r"\bLi\b", m) for m in masked.values())
    rated = {(r.term, round(r.disclosure, 6)) for r in pii.disclosing_terms(frame, threshold=0.8, max_chance=math.inf)[0].collect()}
    rare = -math.log(2 / 604)
    assert {("li", 1.0), ("jdoe42", round(1 + math.log(2 / 4) / rare, 6))} <= rated and "common" not in dict(rated)


def brute_disclosure(rows, threshold, kind_threshold, max_chance=math.inf, reach=40):
    """Every (kind, level, value, term, disclosure) at or over the thresholds, counted one by one."""
    texts = {(i, t) for i, t in rows}
    plain = lambda x: re.sub(r"[^\w]|_", " ", x.lower()).split()
    holds, terms, side = defaultdict(set), defaultdict(set), {}
    for own in texts:
        text = own[1] or ""
        found = [(k, m.start(), m.end(), m[0].lower()) for k, p in PATTERNS.items() for m in re.finditer(p, text, re.A) if _valid(k, m[0])]
        bare = "".join(" " if any(i <= at < j for _, i, j, _ in found) else c for at, c in enumerate(text))
        for w in plain(text):
            holds[w].add(own)
        terms[own] = set(plain(bare)) if found else set()
        for k, i, j, v in found:
            digits = re.sub(r"\D", "", v)
            part = {"email": "@" + v.split("@")[-1], "ip": ".".join(v.split(".")[:3]) + ".", "card": digits[:6], "phone": digits[:-4]}[k]
            for e in ((k, "value", v), (k, "part", part), (k, "kind", "*")):
                side.setdefault(e, {}).setdefault(own, (tuple(plain(text[max(0, i - reach) : i])), tuple(plain(text[j : j + reach]))))
    out = set()
    side = {e: own for e, own in side.items() if len(own) * 2 <= len(texts) and min(len({s[x] for s in own.values()}) for x in (0, 1)) > 1}
    n_tests = len(side) * sum(len(own) for own in holds.values())
    for e, own in side.items():
        for term in set().union(*(terms[d] for d in own)) & holds.keys():  # what a value leaves of a word is none
            both = [d for d in own if term in terms[d]]
            contexts = {own[d] for d in both}
            if len(both) > 1 and 4 * len(contexts) >= 3 * len(both) and min(len({s[x] for s in contexts}) for x in (0, 1)) > 1:
                far = 1 + math.log(min(1.0, len(both) / len(holds[term]))) / -math.log(len(own) / len(texts))
                a, p, n = len(both) / len(holds[term]), len(own) / len(texts), len(holds[term])
                tail = ((p / a) ** a * ((1 - p) / (1 - a) if a < 1 else 1.0) ** (1 - a)) ** n if a > p else 1.0
                if far >= (kind_threshold if e[1] == "kind" else threshold) and tail * n_tests <= max_chance:
                    out.add((*e, term, round(far, 6)))
    return out


def test_pii_disclosure_against_brute_force(spark):
    rng = random.Random(8)
    words = [f"w{chr(97 + k % 26)}{k}" for k in range(120)]
    names = {"omar": "omar@one.example", "lena": "lena@one.example", "17b": "+49 30 1234567", "zed": "10.0.0.7", "rare": "4111 1111 1111 1111"}
    rows = []
    for i in range(300):
        text = rng.choices(words, k=rng.randint(4, 40))
        if i % 4 == 0:
            name = rng.choice(list(names))
            text.insert(rng.randint(0, len(text)), names[name])
            text.insert(rng.randint(0, len(text)), name if rng.random() < 0.9 else name.upper())
        elif i % 31 == 0:
            text.append(rng.choice(list(names)))
        rows.append((i, " ".join(text)))
    rows += [rows[0], rows[4], (900, rows[4][1]), (901, rows[4][1] + " x"), (902, None), (902, None), (903, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for threshold, kind_threshold, max_chance in ((0.9, 1.0, math.inf), (0.3, 0.3, math.inf), (0.9, 1.0, 0.05), (0.3, 0.3, 0.05)):
        got = {(r.kind, r.level, r.value, r.term, round(r.disclosure, 6)) for r in pii.disclosing_terms(frame, threshold=threshold, kind_threshold=kind_threshold, max_chance=max_chance)[0].collect()}
        want = brute_disclosure(rows, threshold, kind_threshold, max_chance)
        assert {x[3] for x in want} >= {"omar", "zed"} and got == want


def test_pii_broadcast_and_shuffled_paths_agree(spark, docs, monkeypatch):
    own = docs.select("doc_id", "text")
    want = {(r.doc_id, tuple(map(tuple, r.spans))) for r in pii.find(own).collect()}
    monkeypatch.setattr(pii, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(pii, "BROADCAST_BYTES", 0)
    assert {(r.doc_id, tuple(map(tuple, r.spans))) for r in pii.find(own).collect()} == want


def test_pii_clashing_names(spark):
    frame = spark.createDataFrame([(1, "a@b.cd", 1, 2, 3)], "doc_id long, text string, _spans int, _key int, terms int")
    with pytest.raises(ValueError):
        pii.find(frame, spans_col="_spans")
    assert pii.find(frame).select("_spans", "_key", "terms").first() == (1, 2, 3)


def test_pii_edge_cases(odd_docs, no_docs):
    assert pii.find(odd_docs).select(*odd_docs.columns).exceptAll(odd_docs).count() == 0 and pii.find(odd_docs).count() == 9
    assert pii.find(no_docs).count() == 0


def test_replace_overlapping_spans(spark):
    spans = "array(named_struct('kind','a','start',2,'end',5,'value','','mark','[A]'), named_struct('kind','b','start',4,'end',7,'value','','mark','[B]'), named_struct('kind','c','start',8,'end',9,'value','','mark',''))"
    row = spark.sql(f"SELECT '0123456789' AS text, {spans} AS spans")
    assert row.select(pii.replace(F.col("text"), F.col("spans"))).first()[0] == "01[A]79"


def _windows(spark, turns, **options):
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    return chat_format.format_windows(frame, **options)


def test_chat_round_trip(spark):
    rng = random.Random(4)
    parts = ["\\", "###", "####", "</turn>", "<", "\n", "a: b", "### User: ", "é", "word ", "\\#", ":"]
    turns = [(c, k, rng.choice(["system", "user", "assistant", "to:ol\\"]), "".join(rng.choices(parts, k=rng.randint(0, 40)))) for c in range(30) for k in range(rng.randint(1, 12))]
    turns += [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok"), (-8, 0, None, None), (None, 1, "user", "x"), (-9, 0, "user", "y" * 20_000), (-9, 0, "user", "y" * 20_000)]
    got = {r.conv_id: r for r in chat_format.digest(_windows(spark, turns, budget=60, history_turns=3)).collect()}
    own = defaultdict(list)
    for c, k, role, text in turns:
        own[c].append((k, role or "", text or ""))
    assert got.keys() == own.keys()
    for c, rows in own.items():
        rows.sort()
        said = "".join(t for _, r, t in rows if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for _, r, t in rows)
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(rows), hashlib.sha256(whole.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())


def test_chat_windows_keep_budget_system_and_history(spark):
    turns = [(1, 0, "system", "be kind")] + [(1, k, "user" if k % 2 else "assistant", f"turn {k} " + "word " * 10) for k in range(1, 20)]
    rows = _windows(spark, turns, budget=120).orderBy("window").collect()
    assert len(rows) > 3 and all(r.n_tokens <= 120 for r in rows)
    read = [chat_format.read_turns(r.text) for r in rows]
    assert all(x[0] == ("system", "be kind") for x in read) and all(r.n_repeated > 1 for r in rows[1:])
    assert [t for r, x in zip(rows, read, strict=True) for t in x[r.n_repeated :]] == [(r, t) for _, _, r, t in turns]
    assert chat_format.format_windows(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_chat_windows_count_tokens_of_the_vocabulary_and_keep_the_budget(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.WORD_VOCABULARY)
    count = lambda x: len(library.encode(x, add_special_tokens=False).ids)
    rng = random.Random(9)
    long, odd = "be very kind to all " * 60, "0x1f 3.14159 ### </turn> {}[]();" * 3
    turns = [(c, k, "system" if k == 0 else "user" if k % 2 else "assistant", (long if c == 1 else "be kind") if k == 0 else odd if k % 5 == 0 else "word " * rng.randint(1, 90)) for c in range(4) for k in range(30)]
    turns += [(9, 0, "system", long), (9, 1, "user", "hello"), (9, 2, "assistant", long * 2), (9, 3, "user", "bye")]
    rows = _windows(spark, turns, vocabulary=queries.WORD_VOCABULARY, budget=300).collect()
    for r in rows:
        own = chat_format.read_turns(r.text)
        assert r.n_tokens == sum(count(chat_format._write(*t)[0]) for t in own) and (r.n_tokens <= 300 or len(own) == 1)
    assert any(r.n_tokens > 300 for r in rows) and all(chat_format.read_turns(r.text)[0] == ("system", "be kind") for r in rows if r.conv_id == 0)
    said = [t for r in sorted(rows, key=lambda r: (r.conv_id, r.window)) for t in chat_format.read_turns(r.text)[r.n_repeated :]]
    assert said == [(r, t) for _, _, r, t in turns]


@pytest.mark.parametrize("kind", ["double", "decimal(9,2)", "date", "string", "boolean", "binary"])
def test_chat_takes_keys_of_any_type_and_clashing_names(spark, kind):
    made = {"double": "CASE k WHEN 0 THEN double('NaN') ELSE k END", "date": "date_add(DATE '2024-01-01', k)", "boolean": "k = 1", "binary": "CAST(CAST(k AS STRING) AS BINARY)"}.get(kind, f"CAST(k AS {kind})")
    frame = spark.sql(f"SELECT {made} AS conv_id, t AS turn, 'assistant' AS role, concat('say ', t) AS text, 1 AS conv, 2 AS tokens, 3 AS window FROM (SELECT explode(array(0, 1)) AS k), (SELECT explode(array(1, 2, 3)) AS t)")
    out = chat_format.digest(chat_format.format_windows(frame, budget=12)).collect()
    assert [r.n_turns for r in out] == [3, 3] and all(r.loss_chars == 15 for r in out)


def test_public_vocabulary_stays_outside():
    assert public_tokenizers.path("x").startswith("/opt")
