"""Chat formatting by incremental rendering of a template that is only called, never read."""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lexiloom.session import ship_package

Message = tuple[str, str]  # role, text
Render = Callable[[Sequence[Message]], str]

# Strings that steer a model, and that no text may therefore contain as they are.
_REST = (r"(/?s>|(?:bos|eos|pad|unk)>|[|\uff5c][^|\uff5c<>\[\] \t\n\x0b\f\r]+[|\uff5c]>|</?SYS>>|(?:start|end)_of_turn>"
         r"|/?(?:INST|SYSTEM_PROMPT|AVAILABLE_TOOLS|TOOL_RESULTS|TOOL_CALLS)\])")
CONTROL = re.compile(r"(<|\[)(\\*)" + _REST)
MASKED = re.compile(r"(<|\[)\\(\\*)" + _REST)
TURN = re.compile(r"<\|turn\|>(.*?)<\|text\|>(.*?)<\|end\|>\n", re.S)


def escape(text: str) -> str:
    """A backslash after the first character of every control string; one more where there are some."""
    return CONTROL.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    """Undoes ``escape``."""
    return MASKED.sub(r"\1\2\3", text)


@functools.lru_cache(1 << 16)
def _turn(role: str, text: str) -> str:
    return f"<|turn|>{escape(role)}<|text|>{escape(text)}<|end|>\n"


def plain_template(messages: Sequence[Message]) -> str:
    """``<|turn|>role<|text|>text<|end|>`` per turn."""
    return "".join([_turn(r, t) if len(t) < 10_000 else _turn.__wrapped__(r, t) for r, t in messages])


def parse_turns(formatted: str) -> list[Message]:
    """Roles and texts back from what ``plain_template`` wrote."""
    return [(unescape(m[1]), unescape(m[2])) for m in TURN.finditer(formatted)]


def _common(a: str, b: str, hint: str = "") -> int:
    """Length of the common prefix; ``hint`` is what it probably begins with."""
    if b.startswith(a):
        return len(a)
    low, high = 0, min(len(a), len(b))
    if hint and a.startswith(hint) and b.startswith(hint):
        low = len(hint)
    # Blocks that double as long as they agree, then halves of the one that does not.
    step = 64
    while low < high and a[low:low + step] == b[low:low + step]:
        low, step = min(low + step, high), 2 * step
    high = min(high, low + step)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return low


class IncrementalRenderer:
    """Renders growing prefixes of one conversation and keeps what each turn added.

    ``add`` returns (piece, offset in the piece where the turn's text begins, where it ends, rewrites).
    The piece is what the output has beyond what it shares with the output before; ``rewrites`` counts
    characters of the earlier output that the template changed or took back. The text's place in the piece is
    found by rendering the turn with one character in its stead that stands nowhere in the output: the two differ
    from the beginning to the end of the text.

    Whole prefixes are rendered at every length, at a price that grows with the square of the turns: no test at
    one turn can show that a template never looks further back at another. Only a caller who knows the template
    to be local may say so with ``context``: a turn's piece and rewrites then depend on that many turns before it.
    """

    def __init__(self, render: Render, context: int | None = None):
        self.render, self.context = render, context
        self.messages: list[Message] = []
        self.output = self.base = render([])

    @staticmethod
    def _piece(before: str, after: str) -> tuple[str, int]:
        shared = _common(before, after)
        return after[shared:], len(before) - shared

    def add(self, role: str, text: str) -> tuple[str, int, int, int]:
        before, after = self.output, self.render([*self.messages, (role, text)])
        piece, rewrites = self._piece(before, after)
        spare = next(c for c in map(chr, (*range(1, 9), *range(0xE000, 0xF900))) if c not in after)
        probe = self.render([*self.messages, (role, spare)])
        begin = _common(after, probe, before)
        close = _common(after[begin:][::-1], probe[begin:][::-1])
        start = max(0, begin - (len(after) - len(piece)))
        end = max(start, len(piece) - close)
        self.messages.append((role, text))
        if self.context is not None and len(self.messages) > self.context:
            self.messages = self.messages[len(self.messages) - self.context:]
            after = self.render(self.messages)
        self.output = after
        return piece, start, end, rewrites


def _formatted(render: Render, key_type: pa.DataType, context: int | None):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at, number, who = None, 0, 0, object()
        for batch in batches:
            out = []
            for key, turn, role, text in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                if now is None or key != who:
                    now, number, who = IncrementalRenderer(render, context), 0, key
                    at = len(now.base)
                role, text = role or "", text or ""
                piece, start, end, rewrites = now.add(role, text)
                at -= rewrites
                lead = now.base if not number else ""
                out.append((key, turn, number, role, lead + piece, at, at + len(piece), at + start, at + end,
                            rewrites))
                at, number = at + len(piece), number + 1
            if out:
                i, s = pa.int64(), pa.string()
                kinds = [key_type, i, i, s, s, i, i, i, i, i]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=NAMES)
    return f


NAMES = ["conv_id", "turn", "number", "role", "piece", "span_start", "span_end", "text_start", "text_end",
         "rewrites"]


def format_conversations(rows: DataFrame, render: Render = plain_template, *, key: str = "conv_id",
                         turn: str = "turn", role: str = "role", text: str = "text",
                         context: int | None = None) -> DataFrame:
    """One row per turn: its piece of the formatted conversation, the piece's span and the text's span in
    the whole, in characters, and how many earlier characters the template rewrote (0: history stands).

    The first piece also holds what the template puts before any turn. Rows are hashed by conversation,
    sorted by turn and streamed: a task holds one conversation and its formatted text. Whole prefixes are rendered
    at every turn, so a very long conversation costs time in one task, by the square of its turns; a caller who
    declares the template local (``context`` turns, see ``IncrementalRenderer``) pays for these only.
    Result rows of a conversation stay together, in order.

    Null roles and texts read as ''. Rows with the same turn follow by role and text; a null turn
    comes first. Rows without a conversation id form one conversation; ids may be of any type that can be
    sorted. Repeated rows are turns. An empty table gives no turns. Further columns are ignored, whatever their names.
    """
    ship_package(rows.sparkSession)
    kind, key_type = rows.schema[key].dataType.simpleString(), to_arrow_type(rows.schema[key].dataType)
    slim = rows.select(F.col(key).alias("conv_id"), F.col(turn).cast("long").alias("turn"),
                       F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"))
    ordered = slim.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(
        _formatted(render, key_type, context),
        f"conv_id {kind}, turn long, number long, role string, piece string, span_start long, span_end long, "
        "text_start long, text_end long, rewrites long")


def _digests(learned_role: str, key_type: pa.DataType):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who, state, done = object(), None, []

        def close():
            if state is not None:
                done.append((who, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4],
                             state[5]))

        def flush():
            i, s = pa.int64(), pa.string()
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*done), [key_type, i, s, i, s, i, i])],
                                   names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256",
                                          "formatted_chars", "rewrites"])

        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in
                       ("conv_id", "number", "role", "piece", "span_end", "text_start", "text_end", "rewrites")]
            for key, number, role, piece, end, text_start, text_end, rewrites in zip(*columns):
                if number == 0:
                    close()
                    who, state = key, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for r, t in parse_turns(piece):
                    state[1].update(f"{r}\n{t}\n".encode("utf-8", "surrogatepass"))
                    state[0] += 1
                if role == learned_role:
                    begin = end - len(piece)
                    learned = unescape(piece[text_start - begin:text_end - begin])
                    state[2] += len(learned)
                    state[3].update(learned.encode("utf-8", "surrogatepass"))
                state[4] += len(piece) - rewrites
                state[5] += rewrites
            if len(done) > 1000:
                yield flush()
                done.clear()
        close()
        if done:
            yield flush()
    return f


def digest_conversations(turns: DataFrame, learned_role: str = "assistant") -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, rewrites), read back
    from the pieces of ``format_conversations``; its rows come in order, so digests are running ones.

    Turns are parsed from the formatted text and unescaped; the loss is what stands under the spans of the
    learned role's texts.
    """
    kind, key_type = turns.schema["conv_id"].dataType.simpleString(), to_arrow_type(turns.schema["conv_id"].dataType)
    return turns.mapInArrow(
        _digests(learned_role, key_type),
        f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
        "formatted_chars long, rewrites long")
