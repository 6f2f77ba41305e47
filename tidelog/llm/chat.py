"""Chat formatting: incremental black-box rendering.

A template is any function from a list of turns to a text.  The operator renders successive turn prefixes and
compares consecutive outputs: what prefix i adds to prefix i-1 is turn i's span.  If an output does not begin
with the one before it the template rewrites history, and the conversation is marked so.

Every prefix is rendered whole, so a conversation's turns are in one task's memory and the work grows with the
square of its length; that is what a black box asks for.  A caller who knows that the template is local (what a
turn looks like depends on no turn but the one before it) can say so with ``local=True``: conversations are then
rendered in segments of ``segment`` turns, each after the last turn of the segment before it, with work in
proportion.  The promise is checked, not trusted, at whatever length: each prefix twice as long as the one
checked before it, and the whole conversation, must equal the spans so far.  Where one doesn't, all true
prefixes of that conversation are rendered instead, so the spans are those of ``local=False``.

Rows are sorted by (conversation, turn, role, text) within partitions and streamed, and Spark spills the sort.

Defined results: a null text or role is empty; rows with a null conversation id are one conversation with
that id; a null turn sorts first; repeated turns are all kept, ordered by role, then text; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<<ROLE>>", "<</ROLE>>", "<</TURN>>")
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_OPEN = {"assistant": ("<s>", "</s>"), "user": ("[INST]", "[/INST]"), "system": ("<<SYS>>", "<</SYS>>")}
_TURN = re.compile(r"<s>(?P<assistant>.*?)</s>|\[INST\](?P<user>.*?)\[/INST\]|<<SYS>>(?P<system>.*?)<</SYS>>|<<ROLE>>(?P<role>.*?)<</ROLE>>(?P<other>.*?)<</TURN>>", re.DOTALL)

SPAN_SCHEMA = "conv_id long, seq long, role string, start long, stop long, loss_start long, loss_stop long, formatted string, rewrites boolean"
DIGEST_SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites boolean"


def escape(text: str) -> str:
    """Double each backslash and put one inside each control string, so that none is left in the text."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def instruct_template(turns: list[Turn]) -> str:
    """``[INST]user[/INST]<s>assistant</s>``; other roles are named inside ``<<ROLE>>``."""
    out = []
    for role, text in turns:
        opened, closed = _OPEN.get(role) or (f"<<ROLE>>{escape(role)}<</ROLE>>", "<</TURN>>")
        out += [opened, escape(text), closed]
    return "".join(out)


def parse(formatted: str) -> Iterator[tuple[str, str, int, int]]:
    """(role, text, start and end of the escaped text) of each turn of :func:`instruct_template`'s output."""
    at = 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError("not a formatted conversation")
        kind = m.lastgroup
        yield (unescape(m["role"]) if kind == "other" else kind), unescape(m[kind]), m.start(kind), m.end(kind)
        at = m.end()


class _Conversation:
    """Feeds turns one by one; gives each turn's span text and whether history was rewritten so far."""

    def __init__(self, template: Callable[[list[Turn]], str], history: list[Turn] | None = None):
        self.template, self.turns, self.rewrites = template, list(history or []), False
        self.before = template(self.turns) if self.turns else ""

    def add(self, turn: Turn) -> str:
        self.turns.append(turn)
        now = self.template(self.turns)
        if now.startswith(self.before):
            span = now[len(self.before) :]
        else:
            self.rewrites = True
            same = next((i for i, (a, b) in enumerate(zip(self.before, now, strict=False)) if a != b), min(len(now), len(self.before)))
            span = now[same:]
        self.before = now
        return span


def _whole_spans(template: Callable[[list[Turn]], str], turns: Iterable[Turn]) -> Iterator[tuple[str, bool]]:
    """(span, whether history was rewritten so far) of each turn, all prefixes rendered whole."""
    conv = _Conversation(template)
    for turn in turns:
        yield conv.add(turn), conv.rewrites


def _local_spans(template: Callable[[list[Turn]], str], turns: Iterable[Turn], segment: int) -> list[tuple[str, bool]]:
    """The same from segments, if the prefixes checked add up to their spans; else from whole prefixes."""
    turns, out, seen, check = list(turns), [], hashlib.sha256(), 2
    conv = _Conversation(template)
    for n, turn in enumerate(turns, 1):
        if len(conv.turns) > segment:
            conv = _Conversation(template, turns[n - 2 : n - 1])
        out.append((conv.add(turn), False))
        seen.update(out[-1][0].encode("utf-8", "surrogatepass"))
        if n == check or n == len(turns):
            check *= 2
            if conv.rewrites or hashlib.sha256(template(turns[:n]).encode("utf-8", "surrogatepass")).digest() != seen.digest():
                return list(_whole_spans(template, turns))
    return out


def format_conversations(
    conversations: DataFrame, template: Callable[[list[Turn]], str] = instruct_template, *, mask: Callable[[str], tuple[int, int] | None] | None = None, loss_roles: tuple[str, ...] = ("assistant",), local: bool = False, segment: int = 32, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """One row per turn: its span in the conversation's formatted text, the span under the loss mask, and its text.

    ``mask`` finds the trained part within an assistant turn's span (default: what :func:`parse` calls its
    text).  ``rewrites`` is what is known when the turn is rendered; the conversation's last row has the last
    word on it.
    """
    mask = mask or (lambda span: next(((s, e) for _, _, s, e in parse(span)), None))
    kept = conversations.select(F.col(conv_col).cast("long").alias("c"), F.col(turn_col).cast("long").alias("t"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("r"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("x"))
    ordered = kept.repartition("c").sortWithinPartitions("c", "t", "r", "x").select("c", "r", "x")

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
        names = ["conv_id", "seq", "role", "start", "stop", "loss_start", "loss_stop", "formatted", "rewrites"]

        def flush(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

        held, size = [], 0
        for c, rows in itertools.groupby((row for batch in batches for row in zip(*(x.to_pylist() for x in batch.columns), strict=True)), lambda row: row[0]):
            roles, at = [], 0
            turns = ((role, text) for _, role, text in rows if not roles.append(role))
            for n, (span, rewrites) in enumerate(_local_spans(template, turns, segment) if local else _whole_spans(template, turns)):
                inner = mask(span) if roles[n] in loss_roles else None
                held.append([c, n, roles[n], at, at + len(span), *((at + inner[0], at + inner[1]) if inner else (None, None)), span, rewrites])
                at, size = at + len(span), size + len(span)
                if size > 1 << 22:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    return ordered.mapInArrow(spans, SPAN_SCHEMA)


def conversation_digests(spans: DataFrame) -> DataFrame:
    """What each conversation's formatted text says when it is read back: one row per conversation.

    ``spans`` must come straight from :func:`format_conversations`, whose order within partitions it uses.
    """

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, key, state = [], None, None
        types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewrites"]

        def done():
            rows.append([key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4], state[5]])

        for batch in batches:
            for c, _, _, start, stop, loss_start, loss_stop, formatted, rewrites in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if state is None or c != key:
                    if state is not None:
                        done()
                    key, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, False]
                for role, text, _, _ in parse(formatted):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                if loss_start is not None:
                    trained = unescape(formatted[loss_start - start : loss_stop - start])
                    state[2] += len(trained)
                    state[3].update(trained.encode("utf-8", "surrogatepass"))
                state[4] += stop - start
                state[5] = rewrites
                if len(rows) >= 4096:
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)
                    rows.clear()
        if state is not None:
            done()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    return spans.mapInArrow(digests, DIGEST_SCHEMA)
