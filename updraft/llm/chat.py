"""Chat formatting with any template, turn spans found from renderings alone.

A template is a function from a list of (role, text) turns to a string, and is
treated as a black box. Before and after each turn the conversation so far is
rendered and the two strings are compared: what the later one adds is the turn's
piece. Two more renderings, with the turn's text exchanged for probes, show which
part of the piece is text and which is markup. If the later string does not start
with the earlier one, the template rewrites history: the piece then takes back as
many characters as changed, and what lay there leaves the loss mask: the span of an
earlier turn ends where the rewriting begins, or is null if it began there or later.
Text that the later piece repeats is not learnt again.

The prefixes that are rendered start at the first turn, whatever the template looks
back to, so the work grows with the square of the number of turns. With a ``window``
they hold the last turns alone and the work grows with their number; that is exact
only for templates that look back no further, as ``bracket_template``, which adds
the same for a turn whatever came before it. A template that takes
anything back fails with a window. ``read_back`` reads texts of ``bracket_template`` only.

* Null text or role counts as empty. Turns are ordered by turn, then role and
  text, null turns first; repeated rows are turns each. Null conv_id is one conversation.
* Other columns are not read. An empty table gives an empty one.
* One conversation is streamed through one task (its digest is sequential), with
  its turns in memory, or those of the window. A very long text is one value of a batch.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from updraft.llm.common import BATCH_ROWS, arrow_schema, read, small_batches

Turn = tuple[str, str]
WINDOW = 8
PROBES = ("a", "b")
OPENING = "<s>"
PIECES = ("conv_id long, turn long, role string, piece string, taken_back long, start long, "
          "loss_start long, loss_end long, rewrites boolean")
DIGESTS = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
           "formatted_chars long, rewritten_turns long")

_SPECIAL = re.compile(r"[\\\[\]<]")
_ESCAPED = re.compile(r"\\(.)", re.S)
_BODY = r"[^\\\[\]<]*(?:\\.[^\\\[\]<]*)*"
_TURN = re.compile(
    rf"\[INST\] (?P<user>{_BODY}) \[/INST\]|\[SYS\] (?P<system>{_BODY}) \[/SYS\]"
    rf"|\[ROLE (?P<role>{_BODY})\] (?P<other>{_BODY}) \[/ROLE\]| (?P<assistant>{_BODY}) </s>", re.S)


def escape(text: str) -> str:
    """A backslash before each character that control strings start or end with, and before itself."""
    return _SPECIAL.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def bracket_template(turns: list[Turn]) -> str:
    """Instruction brackets for users, an end mark after assistants, named brackets for other roles."""
    out = [OPENING]
    for role, text in turns:
        body = escape(text)
        if role == "user":
            out.append(f"[INST] {body} [/INST]")
        elif role == "assistant":
            out.append(f" {body} </s>")
        elif role == "system":
            out.append(f"[SYS] {body} [/SYS]")
        else:
            out.append(f"[ROLE {escape(role)}] {body} [/ROLE]")
    return "".join(out)


def parsed(text: str) -> tuple[list[Turn], str]:
    """The whole turns at the start of ``text`` (after the opening) and the rest."""
    turns, at = [], 0
    while m := _TURN.match(text, at):
        kind = m.lastgroup
        role = unescape(m["role"]) if kind == "other" else kind
        turns.append((role, unescape(m[kind])))
        at = m.end()
    return turns, text[at:]


def located(render: Callable[[list[Turn]], str], context: list[Turn], turn: Turn,
            before: str | None = None) -> tuple[str, int, int, int, str]:
    """The turn's piece, the characters it takes back, where its text starts and ends in the piece, and the rendering.

    ``before`` is the rendering of ``context``, where it is known.
    """
    if before is None:
        before = render(context) if context else ""
    after = render([*context, turn])
    same = len(before) if after.startswith(before) else len(os.path.commonprefix([before, after]))
    piece = after[same:]
    probes = [render([*context, (turn[0], p)])[same:] for p in PROBES]
    head = len(os.path.commonprefix(probes))
    tail = len(os.path.commonprefix([p[::-1] for p in probes]))
    start = min(head, len(piece))
    return piece, len(before) - same, start, max(start, len(piece) - tail), after


class _Renderer:
    """One conversation after the other, turn by turn; rows are held while a later turn may cut their loss span."""

    def __init__(self, render, loss_roles, window=None):
        self.render, self.loss_roles, self.window = render, loss_roles, window
        self.conv, self.context, self.length = object(), [], 0
        self.text: str | None = None      # the rendering of the context
        self.held: list[list] = []

    def _cut(self, at: int) -> None:
        """What lies from ``at`` on has been taken back."""
        for row in reversed(self.held):
            start, loss_start, loss_end = row[5], row[6], row[7]
            if loss_start is not None and loss_end > at:
                row[6], row[7] = (None, None) if loss_start >= at else (loss_start, at)
            if start < at:
                break      # earlier rows end where this one starts, at most

    def add(self, conv, turn, role, text) -> list[list]:
        """Takes the next turn; returns the rows that are final by it."""
        done = []
        if conv != self.conv:
            done = self.end()
            self.conv, self.context, self.length, self.text = conv, [], 0, None
        role, text = role or "", text or ""
        piece, back, start, end, self.text = located(self.render, self.context, (role, text), self.text)
        self.context.append((role, text))
        at = self.length - back
        if back and self.window is not None:
            raise ValueError("the template rewrites history: use whole prefixes")
        if back:
            self._cut(at)
        self.length = at + len(piece)
        loss = role in self.loss_roles
        self.held.append([conv, turn, role, piece, back, at, at + start if loss else None, at + end if loss else None,
                          back > 0])
        if self.window is not None:
            if len(self.context) > self.window:
                del self.context[:-self.window]
                self.text = None
            done += self.end()
        return done

    def end(self) -> list[list]:
        done, self.held = self.held, []
        return done


def format_turns(conversations: DataFrame, render: Callable[[list[Turn]], str] = bracket_template,
                 loss_roles: tuple[str, ...] = ("assistant",), window: int | None = None) -> DataFrame:
    """One row per turn: its piece of the formatted text, offsets, loss span and whether it rewrites history.

    Without ``window`` the prefixes are whole, whatever the template.

    A conversation's text is its pieces in row order, each after its ``taken_back``
    characters are cut from the end. Rows of a conversation are consecutive.
    """
    small_batches(conversations.sparkSession)
    schema = arrow_schema(conversations.sparkSession, PIECES)
    ordered = conversations.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions(
        "conv_id", "turn", "role", "text")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = _Renderer(render, loss_roles, window)
        for batch in it:
            out = [row for r in zip(*(c.to_pylist() for c in batch.columns)) for row in state.add(*r)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
        last = state.end()
        for at in range(0, len(last), BATCH_ROWS):
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*last[at:at + BATCH_ROWS]), schema)], schema=schema)

    return ordered.mapInArrow(run, PIECES)


class _Reader:
    """Digests of one conversation's formatted text, read piece by piece."""

    def __init__(self, conv):
        self.conv, self.rest, self.length, self.opened = conv, "", 0, False
        self.turns, self.rewritten, self.loss_chars = 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, piece: str, back: int, start: int, loss_start, loss_end) -> None:
        self.rewritten += back > 0
        if back > len(self.rest):
            raise ValueError("a template that rewrites finished turns has no read-back by stream")
        self.rest = self.rest[:len(self.rest) - back] + piece
        self.length = start + len(piece)
        if not self.opened:
            if not self.rest.startswith(OPENING):
                raise ValueError("formatted text without opening")
            self.rest, self.opened = self.rest[len(OPENING):], True
        if loss_start is not None:
            learnt = unescape(piece[loss_start - start:loss_end - start])
            self.loss_chars += len(learnt)
            self.loss.update(learnt.encode())
        turns, self.rest = parsed(self.rest)
        for role, text in turns:
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode())

    def row(self) -> tuple:
        if self.rest:
            raise ValueError("formatted text ends inside a turn")
        return (self.conv, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.length,
                self.rewritten)


def read_back(pieces: DataFrame) -> DataFrame:
    """Per conversation the digests of what the formatted text says; needs the row order of ``format_turns``."""
    schema = arrow_schema(pieces.sparkSession, DIGESTS)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = None
        for batch in it:
            done = []
            for conv, *piece in zip(*(c.to_pylist() for c in batch.columns)):
                if reader is None or conv != reader.conv:
                    if reader is not None:
                        done.append(reader.row())
                    reader = _Reader(conv)
                reader.add(*piece)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)
        if reader is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(reader.row(), schema)], schema=schema)

    return pieces.select("conv_id", "piece", "taken_back", "start", "loss_start", "loss_end").mapInArrow(run, DIGESTS)


def op10_prefix_rendering(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"))
    turns = read(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long"), "role", "text")
    return read_back(format_turns(turns.unionByName(extra)))
