"""Toxicity by a weighted finite-state grammar of clauses.

Words become symbols: insult, threat, target, copula, negation, reported speech, clause
end or anything else. Seven small transducers read the symbols side by side and
are composed into one table (state, symbol) -> (state, factor, emits):

    insult    emits ``LONE`` times the word's weight
    threat    emits when a target follows a threatening word closely
    target    strengthens an insult said close after a target (you idiot)
    copula    strengthens an insult said close after a copula (he is an idiot)
    pair      strengthens an insult after another one in its clause
    negation  weakens what follows a negation, to the clause's end
    reported  weakens what follows a verb of saying, to the clause's end

A clause's weight is the sum of what is emitted, times the factors. A document's
score is one minus exp(-weight), where each insult or threat counts once, at its
strongest clause, so that length alone makes no text toxic. A word weighs ``MOST`` at
most, so a lone insult stays below one half however sure the word is: it takes a
clause that turns it on someone, or a second insult.

Insults are whole words learned from at most ``fit_rows`` labelled documents chosen by
a hash of the key. A word's weight is -ln(1 - p), p being the lower bound of the share
of toxic documents among those that hold it. Patterns of clauses are learned from the same
documents: one's factor is 1 + p, p being that bound among the documents in which it meets an insult;
a pattern that none of them holds keeps ``STRONG``. The fixed insults and threats (a
threatening word with its target) are candidates of the same tests; one that fails is
dropped. One that stands in too few labelled documents for any record to pass keeps its
fixed weight as long as none of them is clean.

Defined results: null or empty text, and text without a match, scores 0; equal
rows score equally; null labels and keys are left out; of several labels of one key the
greatest counts, and of several texts of one key each is a document; words of equal
evidence weigh the same, whatever their order; without labels of both kinds only the
fixed words count; a text of any length is read in one pass; columns other than the
named ones are ignored, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.textbatch import release, tidy

#: Small word lists of the grammar, in English, German, French and Spanish.
INSULTS = ("idiot", "moron", "stupid", "scum", "loser", "pathetic", "worthless", "disgusting", "trash", "idiota", "dummkopf", "imbécile")
THREATS = ("kill", "hurt", "destroy", "beat", "burn", "töten", "tuer", "matar")
TARGETS = ("you", "your", "yourself", "u", "they", "them", "dich", "dir", "euch", "toi", "vous", "te", "ti", "usted")
NEGATIONS = ("not", "never", "no", "nobody", "isn't", "aren't", "don't", "nicht", "kein", "keine", "pas", "jamais", "nunca")
COPULAS = ("is", "are", "am", "was", "were", "you're", "he's", "she's", "they're", "ist", "sind", "bist", "seid", "est", "sont", "es", "son", "eres")
REPORTS = ("said", "says", "called", "quoted", "wrote", "alleged", "sagte", "dit", "dijo")

OTHER, INSULT, THREAT, TARGET, COPULA, NEGATION, REPORT, END = range(8)
#: Lengths of the stems that a given lexicon may hold; none are learned.
STEMS = (5, 6)
REACH = 2
CLOSE = 3
#: A lone insult of most weight scores 1 - exp(-0.65), less than one half; with a pattern of full factor 0.73.
LONE, WEAK, STRONG, MOST = 0.5, 0.2, 2.0, 1.3
#: Patterns of clauses that strengthen an insult.
PATTERNS = ("target", "copula", "pair")
_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[.!?;:\n]")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")

#: The fixed insults, and threats marked by ``!``, with their weights.
FIXED = dict.fromkeys(INSULTS, MOST) | {f"!{w}": MOST for w in THREATS}

#: A transducer: start state, and (state, symbol) -> (state, factor, emits).
Transducer = tuple


def _counting(opens: int, reach: int, factor: float, on: tuple[int, ...]) -> Transducer:
    """After ``opens``, the symbols ``on`` get ``factor`` for ``reach`` symbols, or to the clause's end if reach is 0."""

    def step(state: int, symbol: int) -> tuple[int, float, bool]:
        if symbol == END:
            return 0, 1.0, False
        said = factor if state and symbol in on else 1.0
        if symbol == opens:
            return (reach or 1), said, False
        return (state if not reach else max(0, state - 1)), said, False

    return 0, step


def _insult() -> Transducer:
    return 0, lambda state, symbol: (0, LONE if symbol == INSULT else 1.0, symbol == INSULT)


def _threat() -> Transducer:
    def step(state: int, symbol: int) -> tuple[int, float, bool]:
        if symbol == END:
            return 0, 1.0, False
        if symbol == THREAT:
            return REACH, 1.0, False
        return (0 if symbol == TARGET else max(0, state - 1)), 1.0, symbol == TARGET and state > 0

    return 0, step


def compose(transducers: list[Transducer]) -> tuple[list[list[int]], list[list[float]], list[list[bool]]]:
    """The product of transducers that read the same symbols, as tables by state and symbol."""
    start = tuple(t[0] for t in transducers)
    number, todo = {start: 0}, [start]
    to: list[list[int]] = []
    factor: list[list[float]] = []
    emits: list[list[bool]] = []
    for state in todo:
        steps = [[t[1](s, symbol) for t, s in zip(transducers, state, strict=True)] for symbol in range(END + 1)]
        for own in steps:
            after = tuple(x[0] for x in own)
            if after not in number:
                number[after] = len(number)
                todo.append(after)
        to.append([number[tuple(x[0] for x in own)] for own in steps])
        factor.append([math.prod(x[1] for x in own) for own in steps])
        emits.append([any(x[2] for x in own) for own in steps])
    return to, factor, emits


class Grammar:
    """The composed transducers with their lexicon."""

    def __init__(self, learned: dict[str, float], fixed: dict[str, float] | None = None, patterns: dict[str, float] | None = None):
        """learned: insulting words, or stems with a trailing ``*``, and their weights, ``MOST`` at most;
        fixed: the weights of those of ``FIXED`` that count (all, if not given); patterns: factors of ``PATTERNS``."""
        fixed = FIXED if fixed is None else fixed
        self.threats = {k[1:]: v for k, v in fixed.items() if k.startswith("!")}
        harm = (INSULT, TARGET)
        self.patterns = dict.fromkeys(PATTERNS, STRONG) | (patterns or {})
        strong = [_counting(opens, reach, self.patterns[name], (INSULT,)) for name, opens, reach in (("target", TARGET, CLOSE), ("copula", COPULA, CLOSE), ("pair", INSULT, 0))]
        self.table = compose([_insult(), _threat(), *strong, *(_counting(opens, 0, WEAK, harm) for opens in (NEGATION, REPORT))])
        own = {k: min(v, MOST) for k, v in learned.items()}
        self.insults = {k: v for k, v in fixed.items() if not k.startswith("!")} | {k: v for k, v in own.items() if not k.endswith("*")}
        self.stems = {k[:-1]: v for k, v in own.items() if k.endswith("*")}
        self.symbol = {w: s for s, ws in ((COPULA, COPULAS), (REPORT, REPORTS), (NEGATION, NEGATIONS), (TARGET, TARGETS), (THREAT, self.threats)) for w in ws} | dict.fromkeys(".!?;:\n", END)
        self.seen: dict[str, float] = {}

    def weight(self, word: str) -> float:
        """Of an insulting word; 0 for others."""
        found = self.seen.get(word)
        if found is None:
            if len(self.seen) > 100_000:
                self.seen.clear()
            stems = [self.stems.get(word[:n], 0.0) for n in STEMS if len(word) >= n]
            found = self.seen[word] = max(self.insults.get(word, 0.0), *stems, 0.0)
        return found

    def matches(self, text: str) -> Iterator[tuple[str, list[tuple[str, float]]]]:
        """Clauses with a match: their text, and each matched word with what it emits."""
        to, factor, emits = self.table
        state, begin, menace, found = 0, 0, "", []
        for m in _TOKEN.finditer(text):
            word = m[0].lower()
            weight = self.weight(word)
            symbol = INSULT if weight else self.symbol.get(word, OTHER)
            if emits[state][symbol]:
                found.append((word, factor[state][symbol] * weight) if weight else (f"!{menace}", factor[state][symbol] * self.threats[menace]))
            if symbol == THREAT:
                menace = word
            state = to[state][symbol]
            if symbol == END:
                if found:
                    yield text[begin : m.end()].strip(), found
                found, begin = [], m.end()
        if found:
            yield text[begin:].strip(), found

    def clauses(self, text: str) -> list[tuple[str, float]]:
        """Clauses with a match, and their weights."""
        return [(clause, sum(w for _, w in found)) for clause, found in self.matches(text)]

    def score(self, text: str | None) -> float:
        if not text:
            return 0.0
        words = set(_WORD.findall(text.lower()))
        if not any(map(self.weight, words)) and words.isdisjoint(self.threats):
            return 0.0
        best: dict[str, float] = {}
        for _, found in self.matches(text):
            for word, weight in found:
                best[word] = max(weight, best.get(word, 0.0))
        return 1.0 - math.exp(-sum(best.values()))


def _menaces(text: str) -> set[str]:
    """The threatening words that a target follows closely, marked by ``!``."""
    found, last, left = set(), "", 0
    for m in _TOKEN.finditer(text):
        word = m[0].lower()
        if word in THREATS:
            last, left = word, REACH
        elif word in ".!?;:\n":
            left = 0
        elif word in TARGETS:
            if left:
                found.add(f"!{last}")
            left = 0
        else:
            left = max(0, left - 1)
    return found


def learn(
    docs: DataFrame, labels: DataFrame, *, label_col: str, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = 20_000, min_toxic: int = 4, min_gain: float = 20.0, min_precision: float = 0.5, min_contexts: int = 8
) -> Grammar:
    """A grammar whose insults are the words that stand in ``min_toxic`` toxic documents
    at least, for which the lower bound of the share of toxic documents is ``min_precision``
    or more, whose likelihood-ratio statistic is ``min_gain`` or more (so that few of many
    rare words pass by chance), and which stand between different pairs of words in
    toxic documents: in ``min_contexts`` or, if that is less, as many as four fifths of the
    documents (so that the words of a toxic text with many copies are no insults).
    ``FIXED`` terms pass the same tests but the last, or are too rare to be tested
    and stand in no clean document; without labels of both kinds all of them count.
    The driver gets the words that pass, never more than ``fit_rows`` documents hold."""
    own = labels.select(labels[id_col].alias("id"), labels[label_col].alias("toxic")).filter("id is not null and toxic is not null")
    chosen = own.groupBy("id").agg((F.max("toxic") > 0).cast("int").alias("toxic")).orderBy(F.xxhash64("id"), "id").limit(fit_rows)
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).join(F.broadcast(chosen), "id").select("toxic", "text")

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        n: tuple[Counter, Counter] = Counter(), Counter()
        for batch in batches:
            for toxic, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = set(_WORD.findall((text or "").lower()))
                if not words.isdisjoint(THREATS):
                    n[toxic].update(_menaces(text))
                n[toxic].update(words | {""})
        every = list(n[0].keys() | n[1].keys())
        for k in range(0, len(every), 50_000):
            some = every[k : k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array([n[1][t] for t in some], pa.int64()), pa.array([n[0][t] for t in some], pa.int64())], ["term", "bad", "good"])

    counts = rows.mapInArrow(tidy(terms), "term string, bad long, good long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    found = {r["term"]: (r["bad"], r["good"]) for r in counts.filter(F.col("term").isin("", *FIXED) | ((F.col("bad") >= min_toxic) & (F.col("bad") > F.col("good")))).collect()}
    all_bad, all_good = found.pop("", (0, 0))

    def passes(bad: int, good: int) -> bool:
        return bad >= min_toxic and least_share(bad, good) >= min_precision and _likelihood_ratio(bad, good, all_bad, all_good) >= min_gain

    # Words that other transducers read are no insults, whatever the labels.
    likely = {t for t, n in found.items() if passes(*n) and not t.startswith("!")}.difference(TARGETS, COPULAS, NEGATIONS, REPORTS, THREATS)
    fixed = dict(FIXED)
    for term in FIXED.keys() & found.keys() if all_bad and all_good else ():
        if passes(*found[term]):
            fixed[term] = evidence(*found[term])
        elif found[term][1]:
            del fixed[term]

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zlib import crc32

        seen: set[tuple[str, int]] = set()
        for batch in batches:
            for text in batch.column(1).to_pylist():
                words = ["", *_WORD.findall((text or "").lower()), ""]
                for before, word, after in zip(words, words[1:], words[2:], strict=False):
                    if word in likely:
                        seen.add((word, crc32(f"{before} {after}".encode())))
        yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in seen], pa.string()), pa.array([c for _, c in seen], pa.int64())], ["term", "context"])

    around = rows.filter("toxic > 0").mapInArrow(tidy(contexts), "term string, context long").groupBy("term").agg(F.count_distinct("context").alias("n")) if likely else None
    varied = {r["term"] for r in around.collect() if r["n"] >= min(min_contexts, 0.8 * found[r["term"]][0])} if likely else set()
    learned = {t: evidence(*found[t]) for t in sorted(varied)}
    return Grammar(learned, fixed, _pattern_factors(rows, learned, fixed) if all_bad and all_good else None)


def _pattern_factors(rows: DataFrame, learned: dict[str, float], fixed: dict[str, float]) -> dict[str, float]:
    """The factor of each pattern that strengthens an insult in any of the labelled documents (toxic, text)."""

    def meets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = Grammar(learned, fixed, dict.fromkeys(PATTERNS, 1.0))
        own = {name: Grammar(learned, fixed, dict.fromkeys(PATTERNS, 1.0) | {name: STRONG}) for name in PATTERNS}
        n = {(name, toxic): 0 for name in PATTERNS for toxic in (0, 1)}
        for batch in batches:
            for toxic, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if before := plain.score(text):
                    for name, grammar in own.items():
                        n[name, toxic] += grammar.score(text) > before
        keys = list(n)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys], pa.int64()), pa.array([n[k] for k in keys], pa.int64())], ["pattern", "toxic", "n"])

    seen = {(r.pattern, r.toxic): r.n for r in rows.select("toxic", "text").mapInArrow(tidy(meets), "pattern string, toxic long, n long").groupBy("pattern", "toxic").agg(F.sum("n").alias("n")).collect()}
    counts = {name: (seen.get((name, 1), 0), seen.get((name, 0), 0)) for name in PATTERNS}
    return {name: 1 + least_share(*n) for name, n in counts.items() if sum(n)}


def least_share(bad: int, good: int, z: float = 1.64) -> float:
    """The lower bound (Wilson, at 95 %) of the share of toxic documents."""
    n = bad + good
    p = bad / n
    return (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def evidence(bad: int, good: int) -> float:
    """The weight of a word of so many toxic and clean documents."""
    return min(MOST, -math.log(1 - least_share(bad, good)))


def _likelihood_ratio(bad: int, good: int, all_bad: int, all_good: int) -> float:
    """Twice the gain in log-likelihood of a two-by-two table over independence."""
    n, seen = all_bad + all_good, bad + good
    cells = ((bad, seen * all_bad), (good, seen * all_good), (all_bad - bad, (n - seen) * all_bad), (all_good - good, (n - seen) * all_good))
    return 2 * sum(x * math.log(x * n / y) for x, y in cells if x and y)


def score_column(grammar: Grammar, text: Column) -> Column:
    """The score of each text, as a column."""

    @F.arrow_udf("double")
    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            for texts in batches:
                yield pa.array([grammar.score(x.as_py()) for x in texts], pa.float64())
        finally:
            grammar.seen.clear()
            release()

    return scores(text.cast("string"))


def score(docs: DataFrame, grammar: Grammar, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``score`` and ``clauses`` (the matched clauses with their weights) of each row."""
    kind = docs.schema[id_col].dataType.simpleString()
    clause = pa.list_(pa.struct([("text", pa.string()), ("weight", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 256):
                part = batch.slice(k, 256)
                texts = part.column(1).to_pylist()
                scores = [grammar.score(x) for x in texts]
                found = [[{"text": t, "weight": w} for t, w in grammar.clauses(x)] if s else [] for x, s in zip(texts, scores, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64()), pa.array(found, clause)], ["id", "score", "clauses"])

    out = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(tidy(run), f"id {kind}, score double, clauses array<struct<text: string, weight: double>>")
    return out.withColumnRenamed("id", id_col)
