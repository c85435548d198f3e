"""Chat formatting with a black-box template, read by incremental rendering.

A template is a function from a list of turns to a string. Successive prefixes of a conversation are rendered and each output is
compared with the one before: what it adds is the span of the new turn; if it does not begin with the one before, the template rewrites history. The span of a
turn's text is found the same way, by rendering the turn with two other texts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, trimmed, width

Turn = tuple[str, str]  # role, text
Template = Callable[[list[Turn]], str]

START, BODY, END = "<|turn|>", "<|text|>", "<|end|>"
#: Strings that steer a model in this or other public templates; inside texts they are escaped.
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<start_of_turn>", "<end_of_turn>")
_ESCAPE = re.compile(r"\\|" + "|".join(map(re.escape, CONTROL)))
_RESTORE = re.compile(r"\\([\\-])")


def escape(text: str) -> str:
    """Doubles backslashes and puts backslash-minus behind the first character of each control string."""
    return _ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\-" + m[0][1:], text)


def unescape(text: str) -> str:
    return _RESTORE.sub(lambda m: "\\" if m[1] == "\\" else "", text)


def render(turns: list[Turn]) -> str:
    """The library's own template."""
    return "".join([f"{START}{escape(role)}{BODY}{escape(text)}{END}\n" for role, text in turns])


@dataclass
class Rendered:
    text: str
    spans: list[tuple[int, int]] = field(default_factory=list)  # of turns
    bodies: list[tuple[int, int]] = field(default_factory=list)  # of their texts as rendered
    rewritten: list[int] = field(default_factory=list)  # turns whose addition changed what stood before


def common_prefix(a: str, b: str) -> int:
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid)
    return low


def locate(turns: list[Turn], template: Template = render, window: int = 32) -> Rendered:
    """Render successive prefixes and locate each turn.

    Windows of `window` turns are rendered prefix by prefix, each behind the last turn of the one before; the spans hold if the
    windows' additions joined equal one rendering of the whole. Else every prefix is rendered from the first turn on.
    """
    whole = template(turns)
    if len(turns) > 2 * window:
        parts, spans, bodies, at = [], [], [], len(template([]))
        parts.append(template([]))
        for a in range(0, len(turns), window):
            lead = max(0, a - 1)
            piece = _prefixes(turns[lead : a + window], template, a - lead)
            if piece.rewritten:
                break
            base = piece.spans[0][0] if piece.spans else 0
            spans += [(s - base + at, e - base + at) for s, e in piece.spans]
            bodies += [(s - base + at, e - base + at) for s, e in piece.bodies]
            parts.append(piece.text[base:])
            at += len(piece.text) - base
        else:
            if "".join(parts) == whole:
                return Rendered(whole, spans, bodies)
    return _prefixes(turns, template, 0)


def _prefixes(turns: list[Turn], template: Template, skip: int) -> Rendered:
    out = Rendered(template(turns[:skip]))
    for i in range(skip, len(turns)):
        before, role = out.text, turns[i][0]
        out.text = template(turns[: i + 1])
        start = len(before) if out.text.startswith(before) else common_prefix(before, out.text)
        if start < len(before):
            out.rewritten.append(i)
        # two texts that differ in their one character show what stands before and behind any text
        x, y = template([*turns[:i], (role, "a")]), template([*turns[:i], (role, "b")])
        lead, tail = common_prefix(x, y), common_prefix(x[::-1], y[::-1])
        out.spans.append((start, len(out.text)))
        out.bodies.append((lead, len(out.text) - tail) if x != y and lead + tail <= len(out.text) else (len(out.text),) * 2)
    return out


def read_back(text: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end of the escaped text) of each turn of the library's own format."""
    out, at = [], 0
    while at < len(text):
        if not text.startswith(START, at):
            raise ValueError("not a turn")
        body = text.index(BODY, at)
        end = text.index(END, body)
        out.append((unescape(text[at + len(START) : body]), unescape(text[body + len(BODY) : end]), body + len(BODY), end))
        at = end + len(END) + 1
    return out


def conversations(chats: DataFrame) -> DataFrame:
    """The rows in the order they are read: by conversation, turn, role and text (nulls first); conversations stay together."""
    own = chats.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return own.repartition(width(chats.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[Turn]]]:
    """One conversation after the other from sorted rows; one that goes over a batch's end is carried on."""
    now, turns, any_row = None, [], False
    for batch in batches:
        for conv, role, text in zip(*(column(batch, c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
            if any_row and conv != now:
                yield now, turns
                turns = []
            now, any_row = conv, True
            turns.append((role, text))
    if any_row:
        yield now, turns


def format_chats(chats: DataFrame, template: Template = render, learn: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, turn_spans, loss_spans (start, end of learned texts), rewritten (turns).

    Rows of a conversation go by turn; rows that share a turn number go by role, then text, and each is a turn, repeated rows
    too. Null texts and roles are empty; null ids make one conversation; an empty table gives no rows; other columns are
    not read. The template sees all turns before, so one conversation's text is the unit that a task holds.
    """
    pair = "array<struct<start:int,end:int>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for conv, turns in grouped(batches):
            r = locate(turns, template)
            spans = lambda rows: pa.array([[{"start": s, "end": e} for s, e in rows]], kind)
            loss = [b for b, (role, _) in zip(r.bodies, turns, strict=True) if role == learn]
            yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([r.text]), spans(r.spans), spans(loss), pa.array([r.rewritten], pa.list_(pa.int32()))], ["conv_id", "formatted", "turn_spans", "loss_spans", "rewritten"])

    return conversations(chats).mapInArrow(trimmed(run), f"conv_id long, formatted string, turn_spans {pair}, loss_spans {pair}, rewritten array<int>")


def digests(formatted: DataFrame) -> DataFrame:
    """Read the library's own format back: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_rewritten long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, text, loss, rewritten in zip(*(column(batch, c).to_pylist() for c in ("conv_id", "formatted", "loss_spans", "rewritten")), strict=True):
                turns = read_back(text)
                said = hashlib.sha256("".join([f"{role}\n{t}\n" for role, t, _, _ in turns]).encode()).hexdigest()
                learned = "".join([unescape(text[x["start"] : x["end"]]) for x in loss])
                rows.append((conv, len(turns), said, len(learned), hashlib.sha256(learned.encode()).hexdigest(), len(text), len(rewritten)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x) if i else pa.array(x, pa.int64()) for i, x in enumerate(zip(*rows, strict=True))], [c.split()[0] for c in schema.split(", ")])

    return formatted.mapInArrow(trimmed(run), schema)
