"""Chat formatting from a declarative template.

A template names, per role, the strings that open and close a turn.  A finite
state machine over the roles says whether a conversation's turn order is
valid.  The operator emits segments: markup without loss, and each turn's
text, whose loss flag is set for the roles that are learned.  Control strings
(and the escape character) inside a text are escaped, so the segments can be
read back without loss, which ``read_back`` does.

Rows of one conversation are brought together by a shuffle on its id and
sorted by turn; tasks then stream over them and keep only the state of the
current turn (and running digests on reading back), so a conversation of any
length fits.

Defined results: a null text is empty, a null role is the role ``""`` (not
valid in any order); rows of equal turn are ordered by role, then text; a null
turn comes first; rows with a null conversation id form one conversation of
their own; repeated rows are separate turns; an unknown role gets the
template's fallback markup and makes the order invalid; an empty table gives
an empty table; extra columns are ignored."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Markup per role, roles under the loss, and the machine's transitions."""

    turns: dict[str, tuple[str, str]] = field(default_factory=lambda: {
        "system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")})
    #: markup of any other role; the role's name stands, escaped, between both openings
    other: tuple[str, str, str] = ("<|role|>", "<|text|>", "<|end|>")
    loss_roles: tuple[str, ...] = ("assistant",)
    escape: str = "\\"
    #: state -> role -> next state; states in ``final`` may end a conversation
    transitions: dict[str, dict[str, str]] = field(default_factory=lambda: {
        "start": {"system": "asked", "user": "user"}, "asked": {"user": "user"},
        "user": {"assistant": "assistant"}, "assistant": {"user": "user"}})
    final: tuple[str, ...] = ("assistant",)

    def controls(self) -> list[str]:
        marks = {m for pair in self.turns.values() for m in pair} | set(self.other)
        return sorted(marks, key=lambda m: (-len(m), m))


class Codec:
    """Escapes and unescapes texts under a template."""

    def __init__(self, template: Template):
        marks = "|".join(map(re.escape, template.controls()))
        esc = re.escape(template.escape)
        self.mark = template.escape
        self._out = re.compile(f"{esc}|{marks}")
        self._back = re.compile(f"{esc}({esc}|{marks})")
        self._token = re.compile(f"{esc}(?:{esc}|{marks})|({marks})")

    def escape(self, text: str) -> str:
        return self._out.sub(lambda m: self.mark + m.group(), text)

    def unescape(self, text: str) -> str:
        return self._back.sub(lambda m: m.group(1), text)

    def tokens(self, text: str) -> Iterator[tuple[str, bool]]:
        """(piece, is control): escaped control strings belong to the text."""
        at = 0
        for m in self._token.finditer(text):
            if m.group(1) is not None:
                if m.start() > at:
                    yield text[at:m.start()], False
                yield m.group(), True
                at = m.end()
        if at < len(text):
            yield text[at:], False


SEGMENTS = "conv_id bigint, segment string, loss boolean, last boolean, valid boolean"


def format_segments(rows: DataFrame, template: Template | None = None, conv_col: str = "conv_id",
                    turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Segments of every conversation in order: conv_id, segment, loss, last
    (the conversation ends here) and, on the last one, valid."""
    template = template or Template()
    # only whole code points can be escaped and read back, which every string of a table has
    frame = rows.select(F.col(f"`{conv_col}`").cast("bigint").alias("conv_id"), F.col(f"`{turn_col}`").alias("turn"),
                        F.coalesce(F.col(f"`{role_col}`"), F.lit("")).alias("role"),
                        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    ordered = frame.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def emit(batches):
        codec, out = Codec(template), []
        conv, state, begun = None, "start", False

        def close():
            if begun:
                out.append((conv, "", False, True, state in template.final))

        for batch in batches:
            for cid, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if not begun or cid != conv:
                    close()
                    conv, state, begun = cid, "start", True
                state = template.transitions.get(state, {}).get(role, "invalid")
                if role in template.turns:
                    opening, closing = template.turns[role]
                else:
                    opening, closing = template.other[0] + codec.escape(role) + template.other[1], template.other[2]
                out.append((conv, opening, False, False, None))
                out.append((conv, codec.escape(text), role in template.loss_roles, False, None))
                out.append((conv, closing, False, False, None))
            yield _batch(out)
            out.clear()
        close()
        yield _batch(out)

    return ordered.mapInArrow(emit, SEGMENTS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_())
    columns = list(zip(*rows)) or [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                      names=["conv_id", "segment", "loss", "last", "valid"])


DIGEST = ("conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
          "formatted_chars bigint, valid boolean")


def read_back(segments: DataFrame, template: Template | None = None) -> DataFrame:
    """Parse formatted segments (in the order and partitions that
    ``format_segments`` gives) and digest each conversation's turns and the
    text under the loss mask.  Turns are recovered from the markup alone."""
    template = template or Template()

    def digest(batches):
        codec = Codec(template)
        opens = {o: r for r, (o, _) in template.turns.items()}
        closes = {c for _, c in template.turns.values()} | {template.other[2]}
        blank = lambda: {"n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0,
                         "role": None, "named": "", "text": []}
        state, out = blank(), []
        for batch in batches:
            for cid, segment, loss, last, valid in zip(*(batch.column(i).to_pylist() for i in range(5))):
                state["chars"] += len(segment)
                if loss:
                    plain = codec.unescape(segment)
                    state["loss"].update(plain.encode())
                    state["loss_chars"] += len(plain)
                for piece, control in codec.tokens(segment):
                    if not control:
                        state["text"].append(piece)
                    elif piece in opens:
                        state["role"], state["text"] = opens[piece], []
                    elif piece == template.other[0]:
                        state["text"] = []
                    elif piece == template.other[1]:
                        state["role"], state["text"] = codec.unescape("".join(state["text"])), []
                    elif piece in closes:
                        text = codec.unescape("".join(state["text"]))
                        state["turns"].update(f"{state['role']}\n{text}\n".encode())
                        state["n"], state["role"], state["text"] = state["n"] + 1, None, []
                if last:
                    out.append((cid, state["n"], state["turns"].hexdigest(), state["loss_chars"],
                                state["loss"].hexdigest(), state["chars"], valid))
                    state = blank()
            if out:
                columns = list(zip(*out))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                                 names=[x.split()[0] for x in DIGEST.split(", ")])
                out.clear()

    return segments.mapInArrow(digest, DIGEST)
