"""Conversations as training text that a parser reads back turn by turn.

A turn is ``<|im_start|>`` role, a line break, its text, ``<|im_end|>`` and a line
break. Rendered text is parsed again by a deterministic parser; where what comes
back differs from the source, the turns in conflict are escaped, and the text is
rendered and parsed anew until both are identical. Escaping puts one more backslash
into a control string (``<|im_end|>`` becomes ``<\\|im_end|>``, that becomes
``<\\\\|im_end|>``), and a role's line breaks and backslashes become two characters;
the parser takes one away, so any text survives.

Rows are dealt by ranges of conversation and turn, so that one conversation may
fill several tasks. It then has several parts, cut between turns.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import materialise, ship

#: Fixed values of the template.
OPEN, CLOSE, BREAK, LEARNT = "<|im_start|>", "<|im_end|>", "\n", "assistant"

CONTROL = re.compile(r"<(\\*)\|(im_start|im_end)\|>")
ESCAPED = re.compile(r"<\\(\\*)\|(im_start|im_end)\|>")
Turn = tuple[str, str]


class GrammarError(ValueError):
    """Text that is no sequence of turns."""


def escape_text(text: str) -> str:
    return CONTROL.sub(r"<\\\1|\2|>", text)


def unescape_text(text: str) -> str:
    return ESCAPED.sub(r"<\1|\2|>", text)


def escape_role(role: str) -> str:
    return escape_text(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(\\|n)", lambda m: "\n" if m[1] == "n" else "\\", unescape_text(role))


def parse(text: str) -> list[tuple[str, str, int, int]]:
    """``(role, text, start, end)`` of each turn, unescaped; the places are those of the text as it stands."""
    turns, at = [], 0
    while at < len(text):
        if not text.startswith(OPEN, at):
            raise GrammarError(f"no turn begins at {at}")
        line = text.find(BREAK, at)
        role = text[at + len(OPEN) : line]
        if line < 0 or OPEN in role or CLOSE in role:
            raise GrammarError(f"no role at {at}")
        end = text.find(CLOSE, line + 1)
        if end < 0 or text.find(OPEN, line + 1, end) >= 0 or not text.startswith(BREAK, end + len(CLOSE)):
            raise GrammarError(f"the turn at {at} doesn't end")
        turns.append((unescape_role(role), unescape_text(text[line + 1 : end]), line + 1, end))
        at = end + len(CLOSE) + len(BREAK)
    return turns


def _rendered(turns: list[Turn], escaped: list[bool]) -> str:
    return "".join(f"{OPEN}{escape_role(r) if e else r}{BREAK}{escape_text(t) if e else t}{CLOSE}{BREAK}" for (r, t), e in zip(turns, escaped))


def _comes_back(turns: list[Turn], text: str) -> bool:
    try:
        return [(r, t) for r, t, _, _ in parse(text)] == turns
    except GrammarError:
        return False


def render(turns: list[Turn]) -> str:
    """The text of ``turns`` that parses to just them; only turns in conflict with the grammar are escaped."""
    escaped = [False] * len(turns)
    while not _comes_back(turns, text := _rendered(turns, escaped)):
        alone = [e or not _comes_back([t], _rendered([t], [e])) for t, e in zip(turns, escaped)]
        if alone == escaped:
            alone = [True] * len(turns)
        if alone == escaped:
            raise GrammarError("escaped turns don't come back")
        escaped = alone
    return text


PART = "part long, text string, n_turns long, loss array<struct<start:long,length:long>>, whole boolean"


def format_conversations(convs: DataFrame, part_chars: int = 1 << 20, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(id, part, text, n_turns, loss, whole)``: the rendered conversations, written to the shared folder.

    Turns are ordered by turn (null first), role and text. Null roles and texts are
    empty; rows without a conversation id are one conversation without an id, and
    repeated rows are repeated turns. ``loss`` has the places of assistant texts in
    ``text``, in code points. A conversation has one part unless it has more than
    ``part_chars`` characters or lies on a border between tasks; its parts, ordered by
    ``part``, put together are its text, and each is a sequence of whole turns.
    ``whole`` is true for parts that are known to be all of their conversation. A turn of any
    length is one piece. Other columns, whatever their names, take no part; an empty
    table gives no rows.
    """
    ship(convs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        held: list[Turn] = []
        size, now, seen, first, begun = 0, None, False, True, False  # first of the task; begun: a part of it is out

        def part(last: bool) -> pa.RecordBatch:
            nonlocal held, size, number, begun
            text = render(held)
            loss = [{"start": a, "length": b - a} for r, _, a, b in parse(text) if r == LEARNT]
            columns = [now, (task << 32) + number, text, len(held), loss, last and not first and not begun]
            held, size, number, begun = [], 0, number + 1, True
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(columns, schema)], schema=schema)

        schema = None
        for batch in batches:
            if schema is None:
                loss_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
                schema = pa.schema([("id", batch.schema.field(0).type), ("part", pa.int64()), ("text", pa.string()), ("n_turns", pa.int64()), ("loss", loss_type), ("whole", pa.bool_())])
            for i in range(0, batch.num_rows, 512):
                rows = batch.slice(i, 512)
                for conv, role, text in zip(*(c.to_pylist() for c in rows.columns)):
                    if not seen or conv != now:
                        if held:
                            yield part(True)
                        now, first, begun, seen = conv, not seen, False, True
                    held.append((role, text))
                    size += len(role) + len(text)
                    if size >= part_chars:
                        yield part(False)
        if held:  # the last conversation may go on in the next task
            yield part(False)

    rows = convs.select(F.col(id_col).alias("id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    dealt = rows.repartitionByRange("id", "turn", "role").sortWithinPartitions("id", "turn", "role", "text")
    kind = convs.schema[id_col].dataType.simpleString()
    return materialise(dealt.select("id", "role", "text").mapInArrow(run, f"id {kind}, {PART}"), "formatted")


DIGESTS = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(parts: DataFrame) -> DataFrame:
    """``(id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)`` from formatted text and loss spans alone.

    Parts that are whole conversations are read where they lie; only the others
    meet by conversation, where they pass in order through running digests.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, state, now, out = None, None, None, []

        def closed() -> tuple:
            turns, n, loss, chars, size = state
            return now, n, turns.hexdigest(), chars, loss.hexdigest(), size

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            types = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            names = ["id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names=names)

        for batch in batches:
            kind = batch.schema.field(0).type
            for i in range(batch.num_rows):
                conv, text, loss = (c[i].as_py() for c in batch.columns)
                if state is None or conv != now:
                    if state is not None:
                        out.append(closed())
                    now, state = conv, [hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for role, said, _, _ in parse(text):
                    state[0].update(f"{role}\n{said}\n".encode())
                    state[1] += 1
                for span in loss:
                    learnt = unescape_text(text[span["start"] : span["start"] + span["length"]])
                    state[2].update(learnt.encode())
                    state[3] += len(learnt)
                state[4] += len(text)
                if len(out) >= 4096:
                    yield batch_of(out)
                    out = []
        if state is not None:
            out.append(closed())
        if out:
            yield batch_of(out)

    shape = f"id {parts.schema['id'].dataType.simpleString()}, {DIGESTS}"
    alone = parts.where("whole").select("id", "text", "loss").mapInArrow(run, shape)
    cut = parts.where("NOT whole").repartition("id").sortWithinPartitions("id", "part").select("id", "text", "loss")
    return alone.union(cut.mapInArrow(run, shape))
