"""Chat formatting by incremental black-box rendering.

A template is a function from a list of messages to one string; nothing else is known of it.  The
operator renders successive prefixes of a conversation's turns and compares consecutive outputs:
what a turn adds is its span.  A template that rewrites what it has already said (an output that
does not continue the one before) is detected: spans begin where the outputs part, and the turn is
reported.

A template may come with a ``context``: the number of turns before a turn that its output depends
on.  Then prefixes start at most twice as many turns before their last one, so that the work grows
with the turns and not with their square, and a long conversation goes out in segments as it is
read.  Before turns are left out, the last turn's output is rendered with and without them; where
the two differ, whole prefixes go on (or, if turns have been left out before, ``ValueError`` says
that the context is too short).  That test sees the turn at hand only.  So the operator also
renders the whole conversation each time that its turns have doubled, and when its first segment (a
million characters) or its end goes out, and raises ``ValueError`` where that isn't what was put
together: three whole renderings' worth of work at most, still linear.  Segments after the first
rely on the declared context and the test of the turn at hand.  Without a context every prefix is whole, and a conversation's
messages and its output are held by one task.

Templates here mark turns with control strings and escape those strings, and the escape character,
inside roles and texts; ``unescape`` reverses that.

A conversation's rows are ordered by turn, then role, then text (nulls first); they stream through
one task, as their digest is one hash over them in order, and are never gathered.  Null roles and
texts count as empty.  Rows with a null conversation id form one conversation of their own.
Repeated rows are turns like any other.  Other columns are left out, whatever they are called.  An
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.llm.common import fields

#: Control strings that a text can't hold unescaped, and what stands for each.
ESCAPE = "␛"
CONTROLS = ("<|turn|>", "<|body|>", "<|end|>", "[INST]", "[/INST]", "<s>", "</s>")

Message = tuple[str, str]
Template = Callable[[list[Message]], str]


def escape(text: str) -> str:
    text = text.replace(ESCAPE, ESCAPE + "0")
    for i, control in enumerate(CONTROLS):
        text = text.replace(control, f"{ESCAPE}{i + 1}")
    return text


def unescape(text: str) -> str:
    for i, control in reversed(list(enumerate(CONTROLS))):
        text = text.replace(f"{ESCAPE}{i + 1}", control)
    return text.replace(ESCAPE + "0", ESCAPE)


def turn_template(messages: list[Message]) -> str:
    """Every turn as <|turn|>role<|body|>text<|end|>."""
    return "".join([f"<|turn|>{escape(role)}<|body|>{escape(text)}<|end|>" for role, text in messages])


def last_system_template(messages: list[Message]) -> str:
    """Like ``turn_template``, but only the latest system turn is shown, at the front: it rewrites history."""
    system = [m for m in messages if m[0] == "system"][-1:]
    return turn_template(system + [m for m in messages if m[0] != "system"])


#: Templates by name, and the turns that each looks back (None: all).
TEMPLATES: dict[str, tuple[Template, int | None]] = {"turn": (turn_template, 4), "last_system": (last_system_template, None)}
#: Characters from which a part of a conversation goes out before its end.
SEGMENT = 1_000_000

#: One whole turn in an output of these templates.
_TURN = re.compile(r"<\|turn\|>(.*?)<\|body\|>(.*?)<\|end\|>", re.S)


class Rendering:
    """One conversation as it is rendered, turn by turn."""

    def __init__(self, template: Template, context: int | None, check: bool = False):
        self._template, self._context = template, context
        self._window: list[Message] = []
        self._before = ""  # the output of the window
        self._parts: list[str] = []  # the output since ``start``
        self._length = 0
        # the whole conversation, to check the output against, until a first part has gone out
        self._all: list[Message] | None = [] if check and context is not None else None
        self._due = 4 * max(1, context or 0)
        self.start, self.turns = 0, 0  # what has gone out: characters; turns so far
        self.spans: list[tuple[int, int]] = []  # of turns since ``start``, from there
        self.rewrites: list[int] = []

    def add(self, message: Message) -> None:
        """Renders the prefix that ends with ``message`` and compares it with the one before."""
        if self._all is not None:
            self._all.append(message)
        now = self._template([*self._window, message])
        at = len(self._before)
        if not now.startswith(self._before):
            self.rewrites.append(self.turns)
            low, high = 0, min(at, len(now))
            while low < high:  # the length of the common prefix
                middle = (low + high + 1) // 2
                low, high = (middle, high) if self._before[:middle] == now[:middle] else (low, middle - 1)
            back, at = at - low, low
            if back > self._length:
                raise ValueError("the template rewrites turns beyond its context")
            self._length -= back
            self._parts = ["".join(self._parts)[: self._length]]
            # no span holds text that is no longer there
            self.spans = [(min(a, self._length), min(b, self._length)) for a, b in self.spans]
        added = now[at:]
        self.spans.append((self._length, self._length + len(added)))
        self._parts.append(added)
        self._length += len(added)
        self._before = now
        self._window.append(message)
        self.turns += 1
        if self._context is not None and len(self._window) >= 2 * max(1, self._context):
            self._leave_out(added)
        if self.turns >= self._due:
            self._due *= 2
            self._check()

    def _check(self) -> None:
        """Whether the template says of the whole conversation what was put together from its windows."""
        if self._all is not None and not self.whole_prefixes() and self._template(self._all) != "".join(self._parts):
            raise ValueError("the template looks further back than its context")

    def _leave_out(self, added: str) -> None:
        kept = self._window[-max(1, self._context) :]
        shorter, short = self._template(kept[:-1]), self._template(kept)
        if short.startswith(shorter) and short[len(shorter) :] == added:
            self._window, self._before = kept, short
        elif self.turns > len(self._window):
            raise ValueError("the template looks further back than its context")
        else:
            self._context = None

    def whole_prefixes(self) -> bool:
        """Whether the output so far may still be rewritten from its beginning."""
        return self.turns == len(self._window)

    def waiting(self) -> int:
        return self._length

    def take(self) -> str:
        """The output since ``start``, which moves on; spans begin anew."""
        self._check()
        self._all = None
        text = "".join(self._parts)
        self.start += self._length
        self._parts, self._length, self.spans, self.rewrites = [], 0, [], []
        return text


def render(messages: list[Message], template: Template, context: int | None = None, check: bool = False) -> tuple[str, list[tuple[int, int]], list[int]]:
    """The whole output, each turn's span in it, and the turns that rewrote earlier output; ``check``: as the operator does."""
    made = Rendering(template, context, check)
    for message in messages:
        made.add(message)
    spans, rewrites = made.spans, made.rewrites
    return made.take(), spans, rewrites


def read_turns(span: str) -> list[tuple[str, str, int, int]]:
    """Role and text of the whole turns in a span, and where the (still escaped) texts stand in it."""
    return [(unescape(m[1]), unescape(m[2]), m.start(2), m.end(2)) for m in _TURN.finditer(span)]


def readable(starts: list[int], ends: list[int], rewrites: list[int]) -> list[tuple[int, int]]:
    """What is read at once: each turn's span; after a rewrite, which may part outputs inside a turn, all of them."""
    return [(starts[0], ends[-1])] if len(rewrites) else list(zip(starts, ends, strict=True))


OUT = T.StructType([
    *fields("segment int, start bigint, formatted string, turn_start array<bigint>, turn_end array<bigint>, loss_start array<bigint>, loss_end array<bigint>, rewrites array<int>"),
])


def format_conversations(df: DataFrame, template: str | tuple[Template, int | None] = "turn", loss_role: str = "assistant", conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", segment: int = SEGMENT) -> DataFrame:
    """The formatted conversations: one row each, or several segments of a long one.

    ``formatted`` is the output from code point ``start`` on; positions in it are those of the turns'
    spans, of the texts under the loss mask (of ``loss_role``), and ``rewrites`` names the turns
    that rewrote history.  A template that rewrites has no span for what it took back; the span of
    the turn that rewrote holds the turns that it said anew, each text once.
    """
    rows = df.select(F.col(conv).alias("_conv"), F.col(turn).alias("_turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("_role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    ordered = rows.repartition("_conv").sortWithinPartitions("_conv", "_turn", "_role", "_text").select(F.col("_conv").cast("string"), "_role", "_text")
    # the key travels as text: pandas would turn whole numbers beside nulls into doubles
    schema = T.StructType([T.StructField(conv, T.StringType()), *OUT.fields])
    names, (made, context) = schema.names, TEMPLATES[template] if isinstance(template, str) else template

    def row(key: str | None, number: int, held: Rendering) -> tuple:
        start, starts, ends, rewrites = held.start, [a for a, _ in held.spans], [b for _, b in held.spans], held.rewrites
        shown, loss = held.take(), []
        for a, b in readable(starts, ends, rewrites):
            loss += [(a + x, a + y) for said, _, x, y in read_turns(shown[a:b]) if said == loss_role]
        return key, number, start, shown, starts, ends, [a for a, _ in loss], [b for _, b in loss], rewrites

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Rendering | None = None
        key, number, out, size = None, 0, [], 0
        for batch in batches:
            for own, said, what in zip(*(batch[c].tolist() for c in ("_conv", "_role", "_text")), strict=True):
                if held is None or own != key:
                    if held is not None:
                        size += held.waiting()
                        out.append(row(key, number, held))
                    held, key, number = Rendering(made, context, check=True), own, 0
                held.add((said, what))
                if held.waiting() >= segment and not held.whole_prefixes():
                    size += held.waiting()
                    out.append(row(key, number, held))
                    number += 1
                if size >= 1_000_000 or len(out) >= 1000:
                    yield pd.DataFrame(out, columns=names)
                    out, size = [], 0
        if held is not None and (held.waiting() or not number):
            out.append(row(key, number, held))
        if out:
            yield pd.DataFrame(out, columns=names)

    return ordered.mapInPandas(run, schema).withColumn(conv, F.col(conv).cast(df.schema[conv].dataType))


def read_back(formatted: DataFrame, conv: str = "conv_id", ordered: bool = False) -> DataFrame:
    """Digests of what the output itself says: turns and text under the loss mask, unescaped.

    ``ordered``: a conversation's segments stand together in order, as ``format_conversations`` leaves them.
    """
    schema = T.StructType([T.StructField(conv, T.StringType()), *fields("n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_rewrites bigint")])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list | None = None  # key, turns, digest of turns, characters, digest of the loss, all characters, rewrites

        def said(x: list) -> tuple:
            return x[0], x[1], x[2].hexdigest(), x[3], x[4].hexdigest(), x[5], x[6]

        for batch in batches:
            out = []
            for key, shown, starts, ends, loss_starts, loss_ends, rewrites in batch.itertuples(index=False):
                key = None if pd.isna(key) else key
                if held is None or held[0] != key:
                    if held is not None:
                        out.append(said(held))
                    held = [key, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for a, b in readable(starts, ends, rewrites):
                    for who, text, _, _ in read_turns(shown[a:b]):
                        held[1] += 1
                        held[2].update(f"{who}\n{text}\n".encode("utf-8", "surrogatepass"))
                for a, b in zip(loss_starts, loss_ends, strict=True):
                    text = unescape(shown[a:b])
                    held[3] += len(text)
                    held[4].update(text.encode("utf-8", "surrogatepass"))
                held[5] += len(shown)
                held[6] += len(rewrites)
            if out:
                yield pd.DataFrame(out, columns=schema.names)
        if held is not None:
            yield pd.DataFrame([said(held)], columns=schema.names)

    rows = formatted if ordered else formatted.repartition(conv).sortWithinPartitions(conv, "segment")
    rows = rows.select(F.col(conv).cast("string").alias(conv), "formatted", "turn_start", "turn_end", "loss_start", "loss_end", "rewrites")
    return rows.mapInPandas(run, schema).withColumn(conv, F.col(conv).cast(formatted.schema[conv].dataType))
