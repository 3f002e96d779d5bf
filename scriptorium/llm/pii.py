"""Personal data by patterns and by information-theoretic disclosure, in DataFrame
functions only.

Patterns find e-mail addresses, IP addresses, card and telephone numbers. Protected
entities are at three levels: each distinct value; the part of it that other values
share (the host of an address, the network of an IP, the issuer of a card, a telephone
number without its last four digits); and the kind itself. The corpus then tells which
other terms reveal an entity: for a term t that stands anywhere in the documents of an
entity e, outside of all values that patterns find, and does so in different contexts
of e (the letters and digits among the ``reach`` characters on each side: both sides must
vary, and three quarters of the documents have a context of their own, so that exact and
near copies of one text show nothing),

    disclosure(t, e) = PMI(t; e) / IC(e) = 1 + ln p(e | t) / -ln p(e)

with probabilities from document counts over the whole corpus. That they stand together must
also be more than chance: if t fell on documents at random, the probability that as many of
its n documents hold e is at most exp(-n KL(p(e | t) || p(e))) (Hoeffding's bound, also of
draws without replacement), and over all pairs of an entity and a word of a document these
bounds may sum to ``max_chance``. So a corpus in which terms and entities are independent
shows that many terms on average, whatever its size; a pair of rare ones needs three
documents or so, a word and a kind rather more. Words of any length and with digits are terms. Terms at or over ``threshold`` (of a value or part) or
``kind_threshold`` (of a kind, which says less about a person, so only terms that
never stand without it reveal it) become spans in every document that holds them: they
are removed if they stand in no document without the entity (disclosure 1) and
generalised to the entity's kind otherwise. What more than half of all documents hold
is no secret and is not rated.

Every count is pre-aggregated before its shuffle; candidate terms are broadcast
only below ``BROADCAST_ROWS`` and joined by a shuffle beyond, and so are the terms of
documents, by bytes, below ``BROADCAST_BYTES``.

Defined results: null text is empty and has no spans; a text of any length is read
whole; spans of different kinds may overlap and are replaced together, by the first
kind's mark; a ``max_chance`` of infinity asks for no evidence beyond two documents; equal spans are reported once a kind; a term that reveals several entities
is marked by the one of greatest disclosure, ties by kind; a term exactly at a threshold
counts as over it; repeated rows are treated each, and count as one document in every
probability; rows with a null key are documents like others; columns of any name pass
through, and a ``spans_col`` that exists raises ValueError; an empty table gives an
empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.durable import checkpoint
from scriptorium.llm.quality_rules import let

BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 32 << 20
KINDS = ("email", "ip", "card", "phone")
TERM = "term"

#: The patterns of the four kinds. Possessive quantifiers and the look-behinds find the
#: same matches as plain greedy ones, without recursion and without trying a run again at each of its characters.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
WORD = r"[\p{L}\p{N}]+"

_SPAN = "array<struct<start:int,end:int,value:string>>"


def locate(text: Column, pattern: str | Column) -> Column:
    """Start, end (exclusive, in code points) and text of each match, leftmost first."""

    def walk(matches: Column, gaps: Column) -> Column:
        steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(matches)), matches, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("size"), m.alias("value")))
        zero = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))

        def step(done: Column, x: Column) -> Column:
            start = done["at"] + x["gap"]
            span = F.struct(start.alias("start"), (start + x["size"]).alias("end"), x["value"].alias("value"))
            return F.struct((start + x["size"]).alias("at"), F.concat(done["out"], F.array(span)).alias("out"))

        return F.aggregate(steps, zero, step, lambda done: done["out"])

    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    return let(F.regexp_extract_all(text, pattern, F.lit(0)), lambda m: let(F.split(text, pattern, -1), lambda g: walk(m, g)))


def _valid_ip(value: Column) -> Column:
    part = lambda p: let(F.regexp_replace(p, "^0+(?=.)", ""), lambda d: (F.length(d) <= 3) & (F.substring(d, 1, 3).cast("int") <= 255))
    return F.forall(F.split(value, r"\."), part)


def _valid_card(value: Column) -> Column:
    def luhn(digits: Column) -> Column:
        def step(total: Column, i: Column) -> Column:
            d = F.substring(digits, -i, F.lit(1)).cast("int")
            twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
            return total + F.when(i % 2 == 0, twice).otherwise(d)

        n = F.length(digits)
        return F.when(n.between(16, 19), F.aggregate(F.sequence(F.lit(1), n), F.lit(0), step) % 10 == 0).otherwise(F.lit(False))

    return let(F.regexp_replace(value, "[ -]", ""), luhn)


def _valid_phone(value: Column) -> Column:
    return F.length(F.regexp_replace(value, "[^0-9]", "")).between(8, 15)


def _of_kind(text: Column, kind: str) -> Column:
    """Valid spans of one kind; texts that cannot hold one are not searched."""
    pattern, may, valid = {
        "email": (EMAIL, F.contains(text, F.lit("@")), None),
        "ip": (IP, F.contains(text, F.lit(".")) & text.rlike(r"[0-9]\.[0-9]"), _valid_ip),
        "card": (CARD, text.rlike("[0-9](?:[ -]?[0-9]){15}"), _valid_card),
        "phone": (PHONE, F.contains(text, F.lit("+")) & text.rlike(r"\+[0-9]"), _valid_phone),
    }[kind]
    spans = locate(text, pattern)
    if valid:
        spans = F.filter(spans, lambda s: valid(s["value"]))
    return F.when(may, spans).otherwise(F.array().cast(_SPAN))


def base_spans(docs: DataFrame, text_col: str, name: str) -> DataFrame:
    """``docs`` with the array column ``name`` of (kind, start, end, value), by kind, then start."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))

    def named(kind: str) -> Column:
        return F.transform(_of_kind(F.col("_text"), kind), lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))

    found = [named(kind) for kind in KINDS]
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), text.alias("_text"))
    return rows.select("_row", F.concat(*found).alias("_found")).select("_row.*", F.col("_found").alias(name))


def _sides(text: Column, span: Column, reach: int) -> Column:
    """Hashes of the letters and digits before and behind a span."""
    plain = lambda x: F.xxhash64(F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]+", " "))
    before = F.substring(text, F.greatest(F.lit(1), span["start"] - reach + 1), F.least(F.lit(reach), span["start"]))
    return F.struct(plain(before).alias("left"), plain(F.substring(text, span["end"] + 1, F.lit(reach))).alias("right"))


def _entities(span: Column) -> Column:
    """The value of a span, the part that it shares with others, and its kind."""
    low = F.lower(span["value"])
    digits = F.regexp_replace(low, "[^0-9]", "")
    part = (
        F.when(span["kind"] == "email", F.regexp_extract(low, "@.*$", 0))
        .when(span["kind"] == "ip", F.regexp_extract(low, r"^[0-9]+\.[0-9]+\.[0-9]+\.", 0))
        .when(span["kind"] == "card", F.substring(digits, 1, 6))
        .otherwise(F.regexp_replace(digits, ".{4}$", ""))
    )
    return F.array(*[F.struct(F.lit(level).alias("level"), value.alias("value")) for level, value in (("value", low), ("part", part), ("kind", F.lit("*")))])


def _row_key(docs: DataFrame, id_col: str, text_col: str) -> Column:
    """A row's key: repeated rows share it, rows with the same id and another text do not."""
    return F.xxhash64(docs[id_col], F.xxhash64(docs[text_col].cast("string"))).alias("_key")


def _words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != ""))


def _once(held: Column) -> Column:
    """Of (kind, level, value, side): each entity with its least context."""
    name = lambda x: F.struct(x["kind"], x["level"], x["value"])
    return let(F.array_sort(held), lambda o: F.filter(o, lambda x, i: ~F.coalesce(name(F.get(o, i - 1)) == name(x), F.lit(False))))


_ENTITY = ["kind", "level", "value"]


def disclosing_terms(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.9, kind_threshold: float = 1.0, max_chance: float = 0.05, reach: int = 40) -> tuple[DataFrame, DataFrame]:
    """Terms that reveal entities, and where.

    Returns (kind, level, value, term, disclosure) and, for each row of ``docs`` that holds
    such a term, (_key, terms).
    """
    own = docs.select(_row_key(docs, id_col, text_col), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("_text"))
    text = F.col("_text")
    # Repeated rows share the count of one document; a weight a row needs no shuffle of the words.
    repeated = checkpoint(own.groupBy("_key").agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1"))
    n_repeated, too_many = repeated.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("n_rows") - 1), F.lit(0))).first()
    weighed = own.join(F.broadcast(repeated) if n_repeated <= BROADCAST_ROWS else repeated, "_key", "left") if n_repeated else own.withColumn("n_rows", F.lit(1))
    weighed = weighed.select("_key", "_text", F.coalesce("n_rows", F.lit(1)).alias("n_rows"))
    n_rows, n_words = weighed.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size(_words(text)) / F.col("n_rows")), F.lit(0.0))).first()
    n_all = n_rows - too_many
    blank = F.transform("_spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(" ").alias("mark")))

    def named(s: Column) -> Column:
        return let(_sides(text, s, reach), lambda c: F.transform(_entities(s), lambda e: F.struct(s["kind"].alias("kind"), e["level"].alias("level"), e["value"].alias("value"), c.alias("side"))))

    held = F.flatten(F.transform("_spans", named))
    rows = base_spans(own, "_text", "_spans").filter(F.size("_spans") > 0).select("_key", _once(held).alias("held"), _words(replace(text, blank)).alias("terms"))
    rows = checkpoint(rows.dropDuplicates(["_key"]))

    def met(pairs: DataFrame, by: list[str], name: str) -> DataFrame:
        """Documents and contexts of each key, if its contexts vary on both sides."""
        contexts = pairs.groupBy(*by, "side").agg(F.count(F.lit(1)).alias("n"))
        found = contexts.groupBy(*by).agg(F.sum("n").alias(name), F.count(F.lit(1)).alias("n_contexts"), *[f(f"side.{x}").alias(f"{x}_{f.__name__}") for x in ("left", "right") for f in (F.min, F.max)])
        return found.filter("left_min <> left_max and right_min <> right_max")

    entity = met(rows.select(F.inline("held")), _ENTITY, "n_entity").filter(F.col("n_entity") * 2 <= n_all)
    entity = checkpoint(entity.select(*_ENTITY, "n_entity"))
    n_entities = entity.count()
    side = F.broadcast(entity) if n_entities <= BROADCAST_ROWS else entity
    near = rows.select("terms", F.inline("held")).join(side, _ENTITY).select(F.xxhash64(*_ENTITY).alias("entity"), "side", "terms")
    named = side.select(F.xxhash64(*_ENTITY).alias("entity"), *_ENTITY, "n_entity")
    disclosure = lambda n: 1 + F.log(F.least(F.lit(1.0), F.col("n_both") / n)) / -F.log(F.col("n_entity") / n_all)
    least = F.when(F.col("level") == "kind", F.lit(kind_threshold)).otherwise(F.lit(threshold))
    evidence = max(0.0, math.log(max(1.0, n_entities * n_words)) - math.log(max_chance))

    def telling(n: Column) -> Column:
        """Whether a term of ``n`` documents discloses enough, by more than chance."""
        share, rate = F.least(F.lit(1.0), F.col("n_both") / n), F.col("n_entity") / n_all
        away = share * F.log(share / rate) + F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - rate))).otherwise(0.0)
        return (disclosure(n) >= least) & (F.when(share > rate, n * away).otherwise(0.0) >= evidence)

    # A term stands in at least as many documents as it stands beside entities in, which bounds its disclosure and
    # evidence and spares the contexts and the corpus count of terms that cannot reach the threshold.
    beside = rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_beside")).filter("n_beside > 1")
    together = near.select("entity", F.explode("terms").alias("term")).groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_both")).filter("n_both > 1")
    hopeful = together.join(named, "entity").join(beside, "term").filter(telling(F.col("n_beside")))
    hopeful = checkpoint(hopeful.select("entity", *_ENTITY, "n_entity", "term", "n_both"))
    few = hopeful.count() <= BROADCAST_ROWS
    met_in = near.select("entity", "side", F.explode("terms").alias("term"))
    wanted = hopeful.select("entity", "term")
    varied = met(met_in.join(F.broadcast(wanted) if few else wanted, ["entity", "term"], "left_semi"), ["entity", "term"], "n").filter("n_contexts * 4 >= n * 3").select("entity", "term")
    rated = checkpoint(hopeful.join(varied, ["entity", "term"]).drop("entity"))
    terms = rated.select("term").distinct()
    small = terms.count() <= BROADCAST_ROWS
    words = weighed.select("_key", "n_rows", F.explode(_words(text)).alias("term"))
    seen = words.join(F.broadcast(terms) if small else terms, "term", "left_semi").groupBy("term").agg(F.round(F.sum(1 / F.col("n_rows"))).alias("n_term"))
    rated = rated.join(seen, "term").withColumn("disclosure", disclosure(F.col("n_term")))
    rated = checkpoint(rated.filter(telling(F.col("n_term"))).select(*_ENTITY, "term", "disclosure"))
    best = rated.groupBy("term").agg(F.max(F.struct("disclosure", "kind")).alias("best")).select("term", "best.kind", "best.disclosure")
    where = words.join(F.broadcast(best) if small else best, "term")
    return rated, where.groupBy("_key").agg(F.collect_set(F.struct("term", "kind", "disclosure")).alias("terms"))


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", spans_col: str = "spans", threshold: float = 0.9, kind_threshold: float = 1.0, max_chance: float = 0.05) -> DataFrame:
    """``docs`` with ``spans_col``: (kind, start, end, value, mark) of patterns, by kind, and of disclosing terms, then start."""
    if spans_col.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"column {spans_col} exists; give another spans_col")
    _, where = disclosing_terms(docs, id_col=id_col, text_col=text_col, threshold=threshold, kind_threshold=kind_threshold, max_chance=max_chance)
    where = checkpoint(where)
    each = F.aggregate("terms", F.lit(16).cast("long"), lambda n, t: n + F.octet_length(t["term"]) + 48)
    small = where.agg(F.coalesce(F.sum(each), F.lit(0))).first()[0] <= BROADCAST_BYTES
    # The given columns travel in one struct, so none of their names can clash.
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("_text"), _row_key(docs, id_col, text_col))
    rows = base_spans(rows, "_text", "_base").join(F.broadcast(where) if small else where, "_key", "left")
    text = F.col("_text")
    known = F.map_from_entries(F.transform("terms", lambda t: F.struct(t["term"], F.struct(t["kind"].alias("kind"), t["disclosure"].alias("disclosure")))))

    # Only a row's own terms are located: steps grow with the square of the matches. Terms are letters and digits.
    own = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), F.array_join(F.transform("terms", lambda t: t["term"]), "|"), F.lit(r")(?![\p{L}\p{N}])"))

    def term_spans(by: Column) -> Column:
        inside = lambda s: ~F.exists("_base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
        hits = F.filter(locate(text, own), lambda s: F.map_contains_key(by, F.lower(s["value"])) & inside(s))
        mark = lambda s: let(by[F.lower(s["value"])], lambda d: F.when(d["disclosure"] >= 1.0, F.lit("")).otherwise(F.concat(F.lit("["), d["kind"], F.lit("-term]"))))
        return F.transform(hits, lambda s: F.struct(F.lit(TERM).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), mark(s).alias("mark")))

    kind = "array<struct<kind:string,start:int,end:int,value:string,mark:string>>"
    marked = F.transform("_base", lambda b: F.struct(b["kind"].alias("kind"), b["start"].alias("start"), b["end"].alias("end"), b["value"].alias("value"), F.concat(F.lit("["), b["kind"], F.lit("]")).alias("mark")))
    more = F.when(F.col("terms").isNotNull(), let(known, term_spans)).otherwise(F.array().cast(kind))
    return rows.select("_row", F.concat(marked, more).alias("_found")).select("_row.*", F.col("_found").alias(spans_col))


def replace(text: Column, spans: Column) -> Column:
    """The text with its spans replaced by their marks; overlapping spans by the first one's."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("minus_end"), s["mark"].alias("mark"))))

    def step(done: Column, s: Column) -> Column:
        fresh = s["start"] >= done["at"]
        part = F.concat(F.substring(text, done["at"] + 1, s["start"] - done["at"]), s["mark"])
        return F.struct(F.greatest(done["at"], -s["minus_end"]).alias("at"), F.when(fresh, F.concat(done["out"], part)).otherwise(done["out"]).alias("out"))

    whole = F.aggregate(ordered, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda done: F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def span_list(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
