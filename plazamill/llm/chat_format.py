"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) to a string. Successive prefixes of a conversation are
rendered and consecutive outputs compared: what the longer output adds is the span of the newest turn; an output
that doesn't begin with the one before it shows a template that rewrites history, and the conversation is flagged
and gets no loss mask, since its spans can't be trusted. Inside a span the text is located by rendering the turn
twice more with two probe texts that differ in their one character.

Every prefix of every conversation is rendered, whatever its length, so the answer can't depend on it; only the last
rendering is held, so memory is linear. The work grows with the square of a conversation's length, at the speed of
joining strings: the default template keeps the pieces of turns it has rendered. A conversation is one task's work,
since a template may look at all of it.

Rows are dealt by conversation and sorted in Spark, so only one conversation is in memory at a time.

Defined cases: null text and null role are empty strings; turns order by (turn, role, text), nulls first; rows with
a null conv_id form one conversation; repeated rows are turns of their own; very long texts are rendered whole; an
empty table gives no rows; other columns are ignored, whatever their names. A turn whose text the probes can't locate
(the template drops or repeats it) has a span and no loss.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]
#: Rendered turns that the default template keeps, in characters.
KEPT_CHARS = 64 << 20
BATCH_CHARS = 4 << 20
SCHEMA = "conv_id long, n_turns long, formatted string, spans array<struct<start: long, stop: long>>, loss array<struct<start: long, stop: long>>, rewrites_history boolean"


def escape(text: str) -> str:
    """One backslash more after each "<" that begins a control string; see unescape."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


class ChatML:
    """The default template: <|im_start|>role, a line feed, the text, <|im_end|> and a line feed; all escaped."""

    def __init__(self):
        self.pieces, self.chars = {}, 0

    def piece(self, turn: Turn) -> str:
        if turn not in self.pieces:
            if self.chars > KEPT_CHARS:
                self.pieces, self.chars = {}, 0
            self.pieces[turn] = f"<|im_start|>{escape_role(turn[0])}\n{escape(turn[1])}<|im_end|>\n"
            self.chars += len(turn[1]) + 100
        return self.pieces[turn]

    def __call__(self, turns: list[Turn]) -> str:
        return "".join(map(self.piece, turns))


chatml = ChatML()


def parse(formatted: str) -> list[Turn]:
    """The turns of a chatml rendering, read back."""
    turns = []
    for part in formatted.split("<|im_start|>")[1:]:
        role, _, text = part.partition("\n")
        turns.append((unescape_role(role), unescape(text.removesuffix("<|im_end|>\n"))))
    return turns


def located(template: Template, turns: list[Turn], before: int, stop: int) -> tuple[int, int] | None:
    """Where the text of the last turn stands in the rendering of these turns, from two probes; before: the characters
    that the rendering of the turns before it has, all of them unchanged."""
    role = turns[-1][0]
    a, b = template([*turns[:-1], (role, "a")]), template([*turns[:-1], (role, "b")])
    head = next((i for i in range(before, min(len(a), len(b))) if a[i] != b[i]), None)
    if head is None or len(a) != len(b) or a[head + 1 :] != b[head + 1 :]:
        return None
    return head, stop - (len(a) - head - 1)


def formatted(turns: list[Turn], template: Template = chatml, train_on: str = "assistant"):
    """The whole rendering, the span of each turn, the spans of the loss, and whether history is rewritten."""
    spans, loss, last, rewrites = [], [], "", False
    for i in range(1, len(turns) + 1):
        now = template(turns[:i])
        kept = now.startswith(last)
        same = len(last) if kept else next((k for k, (x, y) in enumerate(zip(last, now)) if x != y), min(len(last), len(now)))
        rewrites |= not kept
        spans.append((same, len(now)))
        if turns[i - 1][0] == train_on and not rewrites:
            at = located(template, turns[:i], len(last), len(now))
            if at:
                loss.append(at)
        last = now
    return last, spans, [] if rewrites else loss, rewrites


def format_chats(conversations: DataFrame, template: Template = chatml, train_on: str = "assistant") -> DataFrame:
    """One row per conversation: text, the span of each turn, loss spans (code points), rewriting flag."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")

    def run(batches):
        each = (x for b in batches for x in zip(*(c.to_pylist() for c in b.columns)))
        schema, out, chars = None, [], 0
        for conv, group in groupby(each, key=lambda x: x[0]):
            turns = [(r, t) for _, r, t in group]
            whole, spans, loss, rewrites = formatted(turns, template, train_on)
            out.append((conv, len(turns), whole, [{"start": a, "stop": b} for a, b in spans], [{"start": a, "stop": b} for a, b in loss], rewrites))
            chars += len(whole)
            if chars > BATCH_CHARS:
                yield batch(out)
                out, chars = [], 0
        yield batch(out)

    pair = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    kinds = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("spans", pair), ("loss", pair), ("rewrites_history", pa.bool_())])

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds.field(i).type) for i in range(len(kinds))], schema=kinds)

    return ordered.mapInArrow(run, SCHEMA)


def digests(chats: DataFrame) -> DataFrame:
    """Per conversation what the formatted text itself says when it is read back."""

    def run(batches):
        for b in batches:
            rows = []
            for conv, text, loss, rewrites in zip(*(b.column(c).to_pylist() for c in ("conv_id", "formatted", "loss", "rewrites_history"))):
                turns = parse(text)
                said = "".join(unescape(text[x["start"] : x["stop"]]) for x in loss)
                rows.append((conv, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest(), len(text), rewrites))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewrites_history"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return chats.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites_history boolean")
