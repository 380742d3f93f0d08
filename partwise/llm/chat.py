"""Chat formatting by event-sourced reconstruction.

A conversation is a log of events: `start` (role of a message), `delta` (a piece of its text), `edit` (a new text), `regenerate`
(the text so far goes; new deltas follow). Events are partitioned by conversation and message, sorted by sequence and folded
into final messages; each message is rendered by a template that marks its role. Events of one message are all that a
fold holds, so a conversation of any length is spread over tasks. Reading back streams rendered messages in order of their
conversation and keeps only running digests.

The template marks a system message as `[SYS] .. [/SYS]`, a user's as `[INST] .. [/INST]`, an assistant's as `<s> .. </s>` and any
other role's as `[TURN role] .. [/TURN]`, each followed by a line break. In texts and roles a backslash is doubled and one
is put into whatever looks like a mark (`[\\INST]`), which `unescape` takes back exactly.

Defined results: a null text is the empty text; a null role is the role ""; a null conversation or turn is a value
like others, first in order; rows with the same conversation and turn are messages of their own, by role and text; an empty log gives no
messages; texts of any length are kept whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partwise.llm.common import column

OPEN = {"system": "[SYS] ", "user": "[INST] ", "assistant": "<s> "}
CLOSE = {"system": " [/SYS]\n", "user": " [/INST]\n", "assistant": " </s>\n"}
OTHER_CLOSE = " [/TURN]\n"
_LOOKS = re.compile(r"\\|<(?=/?s>)|\[(?=/?(?:SYS|INST|TURN))")
_UNDO = re.compile(r"\\(\\?)")
_MESSAGE = re.compile(r"\[SYS\] (.*?) \[/SYS\]\n|\[INST\] (.*?) \[/INST\]\n|<s> (.*?) </s>\n|\[TURN (.*?)\] (.*?) \[/TURN\]\n", re.S)


def escape(text: str) -> str:
    return _LOOKS.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _UNDO.sub(r"\1", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A rendered message, and the span of its text under the loss mask (an assistant's; else empty)."""
    start = OPEN.get(role) or f"[TURN {escape(role).replace(']', ']' + chr(92))}] "
    body = escape(text)
    at = len(start) if role == "assistant" else 0
    return start + body + CLOSE.get(role, OTHER_CLOSE), at, at + len(body) if role == "assistant" else 0


def read_back(rendered: str) -> list[tuple[str, str]]:
    """(role, text) of each message; an error if anything else is between them."""
    out, at = [], 0
    for m in _MESSAGE.finditer(rendered):
        if m.start() != at:
            break
        at = m.end()
        system, user, assistant, role, text = m.groups()
        if system is not None:
            out.append(("system", unescape(system)))
        elif user is not None:
            out.append(("user", unescape(user)))
        elif assistant is not None:
            out.append(("assistant", unescape(assistant)))
        else:
            out.append((unescape(role), unescape(text)))
    if at != len(rendered):
        raise ValueError(f"not a rendered message at {at}")
    return out


def fold(events: list[tuple[str, str | None, str | None]]) -> tuple[str, str]:
    """(role, text) of one message from its (kind, role, text) in order."""
    role, parts = "", []
    for kind, r, text in events:
        if r is not None:
            role = r
        if kind == "delta":
            parts.append(text or "")
        elif kind == "edit":
            parts = [text or ""]
        elif kind == "regenerate":
            parts = []
        elif kind != "start":
            raise ValueError(f"an event of kind {kind}")
    return role, "".join(parts)


def messages(events: DataFrame) -> DataFrame:
    """conv_id, turn, message, rendered, loss_from, loss_to from events (conv_id, turn, message, seq, kind, role, text).

    message tells apart messages of the same turn; seq orders a message's events.
    """
    key = ["conv_id", "turn", "message"]
    kinds = [f"{c} {events.schema[c].dataType.simpleString()}" for c in key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                yield from zip(*(column(b, c) for c in (*key, "kind", "role", "text")), strict=True)

        done: list[tuple] = []
        size = 0
        for k, own in groupby(rows(), lambda r: r[:3]):
            done.append((*k, *render(*fold([r[3:] for r in own]))))
            size += len(done[-1][3])
            if size > 1 << 22 or len(done) >= 2048:
                yield _batch(done)
                done, size = [], 0
        if done:
            yield _batch(done)

    types = [events.schema[c].dataType for c in key]
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = pa.schema([*((c, to_arrow_type(t)) for c, t in zip(key, types, strict=True)), ("rendered", pa.string()), ("loss_from", pa.int64()), ("loss_to", pa.int64())])

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    sorted_events = events.select(*key, "seq", "kind", "role", "text").repartition(*key).sortWithinPartitions(*key, "seq")
    return sorted_events.mapInArrow(run, f"{', '.join(kinds)}, rendered string, loss_from long, loss_to long")


def digests(rendered: DataFrame) -> DataFrame:
    """Per conversation, read back from its rendered messages in order: conv_id, n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars. A digest over a conversation is sequential by nature: one task streams it, in constant memory."""
    kind = rendered.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                yield from zip(*(column(b, c) for c in ("conv_id", "rendered", "loss_from", "loss_to")), strict=True)

        out = []

        def batch() -> pa.RecordBatch:
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names=names)

        for conv, own in groupby(rows(), lambda r: r[0]):
            turns, loss, n, loss_n, size = sha256(), sha256(), 0, 0, 0
            for _, text, a, b in own:
                size += len(text)
                for role, said in read_back(text):
                    n += 1
                    turns.update(f"{role}\n{said}\n".encode())
                if b > a:
                    said = unescape(text[a:b])
                    loss_n += len(said)
                    loss.update(said.encode())
            out.append((conv, n, turns.hexdigest(), loss_n, loss.hexdigest(), size))
            if len(out) >= 4096:
                yield batch()
                out = []
        if out:
            yield batch()

    ordered = rendered.select("conv_id", "turn", "message", "rendered", "loss_from", "loss_to").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "message")
    return ordered.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def log_of(turns: DataFrame) -> DataFrame:
    """An event log from finished turns (conv_id, turn, role, text): a start and two deltas for each."""
    rank = Window.partitionBy("conv_id", "turn").orderBy(F.asc_nulls_first("role"), F.asc_nulls_first("text"))
    own = turns.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text")).withColumn("message", F.row_number().over(rank))
    half = F.floor(F.length("text") / 2).cast("int")
    event = lambda seq, kind, role, text: F.struct(F.lit(seq).alias("seq"), F.lit(kind).alias("kind"), role.alias("role"), text.alias("text"))
    none = F.lit(None).cast("string")
    events = F.array(
        event(0, "start", F.col("role"), none),
        event(1, "delta", none, F.substring("text", F.lit(1), half)),
        event(2, "delta", none, F.substring("text", half + 1, F.length("text"))),
    )
    return own.select("conv_id", "turn", "message", F.inline(events))
