"""Chat transcripts from event logs.

A log row is an event of one conversation. Sorted by ``seq``, the events are folded into the messages as they finally
stood, which are then rendered by a template. The fold streams over rows sorted within partitions (Spark's sort spills), so a
task holds one conversation's messages as they stand at the moment, never its events. A conversation is one sequence and is
folded by one task, however long its log; its transcript is one value of the result anyway.

Events (``message`` is the number of the message concerned):

``message``     sets the text and role of a message: a complete turn, or an edit of one
``delta``       appends to a message, which begins if it is new
``edit``        replaces the text of a message; the role stays
``regenerate``  empties a message and forgets all later ones: what follows streams a new answer
``delete``      takes a message away
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TEMPLATE, JOINER = "<|{role}|>\n{text}<|end|>", "\n"
NO_ROLE = "unknown"


class Transcript:
    """The messages of one conversation after the events applied so far; unknown events change nothing."""

    def __init__(self) -> None:
        self.state: dict[int, list] = {}

    def apply(self, event: str, at: int, role: str | None, text: str | None) -> None:
        state = self.state
        if event == "delta":
            state.setdefault(at, [role or NO_ROLE, []])[1].append(text or "")
        elif event == "message":
            state[at] = [role or NO_ROLE, [text or ""]]
        elif event == "edit":
            state.setdefault(at, [role or NO_ROLE, []])[1] = [text or ""]
        elif event == "regenerate":
            for later in [k for k in state if k > at]:
                del state[later]
            if at in state:
                state[at][1] = []
        elif event == "delete":
            state.pop(at, None)

    def messages(self) -> list[tuple[int, str, str]]:
        """(message, role, text) of those that have text."""
        return [(k, role, text) for k, (role, parts) in sorted(self.state.items()) if (text := "".join(parts))]


def render(messages: list[tuple[int, str, str]], template: str = TEMPLATE, joiner: str = JOINER) -> str:
    """The messages that have text, each by the template, whose only fields are ``{role}`` and ``{text}``."""
    pieces = re.split(r"(\{role\}|\{text\})", template)
    return joiner.join("".join(role if p == "{role}" else text if p == "{text}" else p for p in pieces) for _, role, text in messages if text)


def events_of_turns(conversations: DataFrame) -> DataFrame:
    """The log that a chat service would have written for a table ``(conv_id, turn, role, text)`` of final messages.

    Every turn is streamed. By turn modulo 3 it arrives in three deltas; or after a draft and a later message that a regeneration throws
    away; or as a fragment that an edit replaces, followed by a message that is deleted. Of rows that repeat a turn the greatest (role, text)
    counts; rows without conversation or turn give no events.
    """
    turns = conversations.where("conv_id is not null and turn is not null").repartition("conv_id").groupBy("conv_id", "turn").agg(F.max(F.struct("role", "text")).alias("last"))
    turn, role, text = F.col("turn").cast("long"), F.col("last.role"), F.col("last.text")
    third = F.ceil(F.length(text) / 3).cast("int")

    def event(step: int, name: str, at=turn, said=None):
        return F.struct((turn * 10 + step).alias("seq"), F.lit(name).alias("event"), at.alias("message"), role.alias("role"), (F.lit(None).cast("string") if said is None else said).alias("text"))

    streamed = [event(3, "delta", said=F.substring(text, 1, third)), event(4, "delta", said=F.substring(text, third + 1, third)), event(5, "delta", said=F.substring(text, 2 * third + 1, F.length(text)))]
    drafted = [event(0, "delta", said=F.lit("A first draft.")), event(1, "message", turn + 1, F.lit("Too early.")), event(2, "regenerate"), *streamed]
    edited = [event(3, "delta", said=F.lit("A frag")), event(4, "edit", said=text), event(5, "message", turn + 1, F.lit("By mistake.")), event(6, "delete", turn + 1)]
    kind = F.pmod(turn, F.lit(3))
    log = F.when(kind == 0, F.array(*streamed)).when(kind == 1, F.array(*drafted)).otherwise(F.array(*edited))
    return turns.select("conv_id", F.inline(log))


def format_chats(log: DataFrame, template: str = TEMPLATE, joiner: str = JOINER) -> DataFrame:
    """``(conv_id, n_messages, chat)`` of each conversation of ``log(conv_id, seq, event, message, role, text)``.

    ``conv_id`` may be of any type that has an order; ``seq`` and ``message`` are integers. Events of equal ``seq`` apply in the order of event,
    message, role, text (nulls first), and an event that repeats another in all six columns is a replay and counts once. Rows
    without conversation, seq, event or message are ignored. A null role is ``unknown``, a null text is empty; messages without text at the end
    are not rendered, and a conversation without any rendered message gives no row. Texts may be of any length. Extra columns are ignored; an
    empty log gives no rows.
    """
    keys = ["conv_id", "seq", "event", "message", "role", "text"]
    rows = log.select("conv_id", F.col("seq").cast("long"), "event", F.col("message").cast("long"), "role", "text").where("conv_id is not null and seq is not null and event is not null and message is not null")

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = last = None
        chat = Transcript()
        done: list[tuple[pa.Scalar, int, str]] = []
        kind = None

        def close() -> None:
            if messages := chat.messages():
                done.append((now, len(messages), render(messages, template, joiner)))

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], kind), pa.array([d[1] for d in done], pa.int32()), pa.array([d[2] for d in done], pa.string())], ["conv_id", "n_messages", "chat"])
            done.clear()
            return out

        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for row in zip(*(batch.column(c).to_pylist() for c in keys), strict=True):
                if row[0] != now:
                    close()
                    now, last, chat = row[0], None, Transcript()
                if row != last:
                    last = row
                    chat.apply(*row[2:])
            if done:
                yield flush()
        close()
        if done:
            yield flush()

    return rows.repartition("conv_id").sortWithinPartitions(*keys).mapInArrow(assemble, f"conv_id {log.schema['conv_id'].dataType.simpleString()}, n_messages int, chat string")


#: DuckDB SQL of :func:`format_chats` over the log that :func:`events_of_turns` makes of the table conversations.
SQL = """
WITH last AS (
  SELECT conv_id, turn, coalesce(nullif(role, ''), 'unknown') AS role, text FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY role DESC NULLS LAST, text DESC NULLS LAST) AS r
    FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL) WHERE r = 1
)
SELECT conv_id, CAST(count(*) AS INT) AS n_messages,
  string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>', chr(10) ORDER BY turn) AS chat
FROM last WHERE text <> '' GROUP BY conv_id
"""
