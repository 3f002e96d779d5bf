r"""Chat formatting in budgeted windows.

A conversation becomes one or more training texts. A turn is written as

    ### role: text</turn>

and a newline. Control strings inside roles and texts are escaped with a
backslash and every backslash is doubled, so the formatted text reads back to
exactly the turns. Prefix sums of the turns' tokens cut the conversation into
spans of whole turns whose tokens, with the conversation's system turn and up to
``history_turns`` of the turns before, stay within ``budget``. A turn's tokens are those
of the formatted turn, marks and escapes included, in a given vocabulary. The system turn
and the history are repeated at the head of every later window but left out of
its loss spans, so each assistant text is a target exactly once. History, and then the
system turn, give way where they leave no room for the window's first turn, so no window
of more than one turn is over the budget.

Rows are dealt by conversation, sorted by turn inside each partition (Spark
spills what does not fit) and read as a stream: a task holds one window at a
time, however long a conversation is. Windows come out in order.

Defined results: null text or role is empty; equal turns are ordered by role,
then text; null turn numbers come first; repeated rows are repeated turns; null
conversation keys form one conversation, and so do NaN keys; keys are of any type that
can be sorted; a turn over the budget, of any length, makes a window of its own; the
first system turn is the one repeated; an empty table gives an empty table; columns other
than the named ones are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

END = "</turn>"
WINDOW = "window long, text string, loss_start array<int>, loss_end array<int>, n_repeated int, n_new int, n_tokens long"
_NAN = float("nan")
_HASHES = re.compile(r"###+")
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\<]|\\.|<(?!/turn>))*)</turn>\n", re.S)


def escape(text: str) -> str:
    """Reversible; the result holds neither three hashes in a row nor an end mark that is not escaped."""
    text = text.replace("\\", "\\\\").replace(END, "\\" + END)
    return _HASHES.sub(lambda m: "\\#" * len(m[0]), text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def read_turns(text: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted text."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(text)]


def _write(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn, and where its text starts and ends."""
    head = f"### {escape(role).replace(':', chr(92) + ':')}: "
    body = escape(text)
    return f"{head}{body}{END}\n", len(head), len(head) + len(body)


def _windows(turns: Iterator[tuple[str, str, int]], budget: int, history_turns: int, target_role: str) -> Iterator[tuple]:
    """Windows of one conversation; turns: role, text, tokens."""
    system: tuple[str, str, int] | None = None
    history: deque = deque(maxlen=history_turns)
    head: list[tuple[str, str, int]] = []
    span: list[tuple[str, str, int]] = []
    prefix = base = number = 0

    def made() -> tuple:
        parts, starts, ends, at = [], [], [], 0
        for k, (role, text, _) in enumerate(head + span):
            written, i, j = _write(role, text)
            if k >= len(head) and role == target_role:
                starts.append(at + i)
                ends.append(at + j)
            parts.append(written)
            at += len(written)
        return number, "".join(parts), starts, ends, len(head), len(span), sum(t[2] for t in head) + prefix - base

    for turn in turns:
        cost = turn[2]
        if span and sum(t[2] for t in head) + prefix - base + cost > budget:
            yield made()
            number += 1
            history.extend(t for t in span if t is not system)
            kept = list(history)
            # As much of the history as leaves room for the next turn.
            lead = [system] if system and system[2] + cost <= budget else []
            room = budget - cost - sum(t[2] for t in lead)
            while kept and sum(t[2] for t in kept) > room:
                kept.pop(0)
            head, span, base = lead + kept, [], prefix
        if system is None and turn[0] == "system":
            system = turn
        span.append(turn)
        prefix += cost
    if span:
        yield made()


def format_windows(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", vocabulary: str | None = None, budget: int = 2048, history_turns: int = 2, target_role: str = "assistant") -> DataFrame:
    """Windows of all conversations: ``conv_col`` and the columns of ``WINDOW``.

    Positions are code points of ``text``. vocabulary: as for ``token_counts``; without
    one, a turn's tokens are estimated as one for four bytes, rounded up, plus four.
    """
    kind = turns.schema[conv_col].dataType.simpleString()
    text = F.coalesce(turns[text_col].cast("string"), F.lit(""))
    role = F.coalesce(turns[role_col].cast("string"), F.lit(""))
    tokens = turn_tokens(vocabulary)(role, text) if vocabulary else (F.ceil(F.octet_length(text) / 4) + 4).cast("long")
    rows = turns.select(turns[conv_col].alias("conv"), turns[turn_col].alias("turn"), role.alias("role"), text.alias("text"), tokens.alias("tokens"))
    rows = rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text").drop("turn")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from itertools import groupby

        out: list[tuple] = []
        names = ["conv", *(x.split()[0] for x in WINDOW.split(", "))]
        kinds = [None, pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.int64()]

        def turns_of() -> Iterator[tuple]:
            for batch in batches:
                kinds[0] = batch.schema.field(0).type
                for k in range(0, len(batch), 1024):
                    yield from zip(*(c.to_pylist() for c in batch.slice(k, 1024).columns), strict=True)

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

        size = 0
        for conv, own in groupby(turns_of(), key=_key):
            conv = conv[0]
            for window in _windows(((r[1], r[2], r[3]) for r in own), budget, history_turns, target_role):
                out.append((conv, *window))
                size += len(window[1])
                if size > 1 << 20:
                    yield batch_of(out)
                    out, size = [], 0
        if out:
            yield batch_of(out)

    return rows.mapInArrow(run, f"conv {kind}, {WINDOW}").withColumnRenamed("conv", conv_col)


def turn_tokens(vocabulary: str):
    """A function of role and text: the tokens of the formatted turn."""

    @F.arrow_udf("long")
    def tokens(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        import os

        from scriptorium.llm.token_counts import WordCounter

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        counter = WordCounter(vocabulary, 1 << 20)
        for roles, texts in batches:
            counts: list[int] = []
            for k in range(0, len(texts), 1024):
                counts += counter.count([_write(r, x)[0].encode() for r, x in zip(roles.slice(k, 1024).to_pylist(), texts.slice(k, 1024).to_pylist(), strict=True)])
            yield pa.array(counts, pa.int64())

    return tokens


def _key(row: tuple) -> tuple:
    """A row's conversation, and whether it is NaN; all NaN are one."""
    return (row[0], False) if row[0] == row[0] else (_NAN, True)


def digest(windows: DataFrame, *, conv_col: str = "conv_id") -> DataFrame:
    """Reads the windows of ``format_windows`` back, in the order in which they
    stand in its partitions, and digests turns and targets of each conversation."""
    kind = windows.schema[conv_col].dataType.simpleString()
    rows = windows.select(windows[conv_col].alias("conv"), "text", "loss_start", "loss_end", "n_repeated")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from itertools import groupby

        def flat() -> Iterator[tuple]:
            for batch in batches:
                kinds[0] = batch.schema.field(0).type
                for k in range(0, len(batch), 256):
                    yield from zip(*(c.to_pylist() for c in batch.slice(k, 256).columns), strict=True)

        names = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [None, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        out: list[tuple] = []
        for conv, own in groupby(flat(), key=_key):
            conv = conv[0]
            n = loss_chars = chars = 0
            turns, loss = hashlib.sha256(), hashlib.sha256()
            for _, text, starts, ends, repeated in own:
                chars += len(text)
                for role, said in read_turns(text)[repeated:]:
                    n += 1
                    turns.update(f"{role}\n{said}\n".encode())
                for i, j in zip(starts, ends, strict=True):
                    target = unescape(text[i:j])
                    loss_chars += len(target)
                    loss.update(target.encode())
            out.append((conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
            if len(out) == 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    out = rows.mapInArrow(run, f"conv {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return out.withColumnRenamed("conv", conv_col)
