"""Chat formatting with a grammar round trip: what is rendered is parsed again, and escaped until it comes back the same.

The grammar, one piece a turn (a conversation is its pieces end to end):
  user       "<s>[INST] " text " [/INST]"
  assistant  " " text " </s>"
  system     "<<SYS>>\\n" text "\\n<</SYS>>\\n"
  any other  "[ROLE]" role "[/ROLE] " text " [/TURN]"
A text never holds a control string. Where a source text does, or holds one that looks escaped, a backslash goes behind
the first character of each; the parser takes one away.

Conversations are written as parts of bounded length, cut anywhere, and read back from those alone: the parser goes over a
conversation's whole text and finds the boundaries between turns by the grammar.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from websheaf.llm.storage import new_path, table

#: The control strings of the template, without their first character, in SQL's and Python's pattern form.
CONTROL = r"([<\[])(\\*)(s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>|ROLE\]|/ROLE\]|/TURN\])"
_CONTROL = re.compile(CONTROL)
_FRAMES = {"user": ("<s>[INST] ", " [/INST]"), "assistant": (" ", " </s>"), "system": ("<<SYS>>\n", "\n<</SYS>>\n")}
_OTHER = ("[ROLE]", "[/ROLE] ", " [/TURN]")


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\2\\\3", text)


def unescape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[1] + m[2][1:] + m[3], text)


def _until(text: str, at: int, close: str) -> int:
    """Where `close` begins; no other control string may come first."""
    m = next((m for m in _CONTROL.finditer(text, at) if not m[2]), None)
    end = m.start() - (len(close) - len(close.lstrip())) if m else -1
    if end < at or not text.startswith(close, end):
        raise ValueError(f"no {close!r} at {at}")
    return end


def parse_turn(text: str, at: int = 0) -> tuple[str, str, tuple[int, int], int]:
    """(role, text, span of the escaped text, end of the turn) of the turn that begins at `at`."""
    for role, (opening, closing) in _FRAMES.items():
        if text.startswith(opening, at):
            break
    else:
        if not text.startswith(_OTHER[0], at):
            raise ValueError(f"no turn begins at {at}")
        end = _until(text, at + len(_OTHER[0]), _OTHER[1].rstrip())
        role, opening, closing = unescape(text[at + len(_OTHER[0]) : end]), "", _OTHER[2]
        at = end + len(_OTHER[1])
    start = at + len(opening)
    end = _until(text, start, closing)
    return role, unescape(text[start:end]), (start, end), end + len(closing)


def parse(text: str) -> list[tuple[str, str, tuple[int, int]]]:
    """The turns of a formatted conversation."""
    at, turns = 0, []
    while at < len(text):
        role, content, span, at = parse_turn(text, at)
        turns.append((role, content, span))
    return turns


def render_turn(role: str, text: str) -> tuple[str, tuple[int, int] | None]:
    """The turn's piece, and the span under the loss mask (assistant texts)."""
    for f in (str, escape):
        if role in _FRAMES:
            opening, closing = _FRAMES[role]
            piece = opening + f(text) + closing
        else:
            piece = _OTHER[0] + f(role) + _OTHER[1] + f(text) + _OTHER[2]
        try:
            found = parse(piece)
        except ValueError:
            continue
        if len(found) == 1 and found[0][:2] == (role, text):
            return piece, found[0][2] if role == "assistant" else None
    raise ValueError("the turn doesn't survive its round trip")


def _rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pieces = [render_turn(r or "", t or "") for r, t in zip(batch["role"].to_pylist(), batch["text"].to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [batch["conv_id"], batch["turn"], pa.array([p for p, _ in pieces], pa.string()), pa.array([m[0] if m else None for _, m in pieces], pa.int32()), pa.array([m[1] if m else None for _, m in pieces], pa.int32())],
            ["conv_id", "turn", "piece", "loss_start", "loss_end"],
        )


def formatted(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, piece, loss_start, loss_end) of every row of `conversations` (conv_id, turn, role, text).

    A conversation's text is its pieces by turn; ties in turn go by piece, null turns come first. Null texts and roles
    count as empty; other columns are ignored. loss_start and loss_end mark an assistant's text within its piece.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_rendered, "conv_id long, turn long, piece string, loss_start int, loss_end int")


#: Characters of a part of a formatted conversation.
PART_CHARS = 1 << 20
_PARTS = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("text", pa.string()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))])
_PARTS_DDL = "conv_id long, part long, text string, starts array<long>, ends array<long>"
_DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


class _Writer:
    """Joins a conversation's pieces and gives them out in parts; loss spans count from the conversation's first character."""

    def __init__(self, conv: int | None, size: int):
        self.conv, self.size, self.part, self.at, self.held, self.text, self.spans = conv, size, 0, 0, 0, [], []

    def add(self, piece: str, a: int | None, b: int | None) -> Iterator[tuple]:
        if a is not None:
            self.spans.append((self.at + a, self.at + b))
        self.text.append(piece)
        self.at, self.held = self.at + len(piece), self.held + len(piece)
        if self.held >= self.size:
            yield from self.give(False)

    def give(self, final: bool) -> Iterator[tuple]:
        text = "".join(self.text)
        cut = 0
        while len(text) - cut >= self.size or final and (cut < len(text) or self.spans):
            yield self.conv, self.part, text[cut : cut + self.size], [a for a, _ in self.spans], [b for _, b in self.spans]
            self.part, cut, self.spans = self.part + 1, cut + self.size, []
        self.text, self.held = [text[cut:]], max(0, len(text) - cut)


def _parted(part_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer: _Writer | None = None

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PARTS)], schema=_PARTS)

        for batch in batches:
            rows, size = [], 0
            for conv, piece, a, b in zip(*(batch[c].to_pylist() for c in ("conv_id", "piece", "loss_start", "loss_end"))):
                if writer is None or writer.conv != conv:
                    rows += writer.give(True) if writer else ()
                    writer = _Writer(conv, part_chars)
                for row in writer.add(piece, a, b):
                    rows.append(row)
                    size += part_chars
                    if size > 1 << 23:
                        yield batch_of(rows)
                        rows, size = [], 0
            if rows:
                yield batch_of(rows)
        if writer and (rows := list(writer.give(True))):
            yield batch_of(rows)

    return run


class _Reader:
    """Takes a conversation's parts in order and hashes each turn as soon as the grammar says that it is whole."""

    def __init__(self, conv: int | None):
        self.conv, self.text, self.at, self.tried = conv, "", 0, 0
        self.spans: list[tuple[int, int]] = []
        self.turns, self.loss, self.n, self.loss_chars = hashlib.sha256(), hashlib.sha256(), 0, 0

    def feed(self, text: str, spans: Iterator[tuple[int, int]], final: bool = False) -> None:
        self.text += text
        self.spans += spans
        if not final and len(self.text) < 2 * self.tried:  # a long turn is tried again once twice as much is there
            return
        at = 0
        while at < len(self.text):
            try:
                role, content, _, end = parse_turn(self.text, at)
            except ValueError:
                if final:
                    raise
                break
            self.n += 1
            self.turns.update(f"{role}\n{content}\n".encode())
            while self.spans and self.spans[0][1] <= self.at + end:
                a, b = self.spans.pop(0)
                masked = unescape(self.text[a - self.at : b - self.at])
                self.loss_chars += len(masked)
                self.loss.update(masked.encode())
            at = end
        self.text, self.at = self.text[at:], self.at + at
        self.tried = len(self.text)

    def row(self) -> tuple:
        self.feed("", (), True)
        if self.spans:
            raise ValueError(f"conversation {self.conv}: a loss span outside its text")
        return self.conv, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.at


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parses parts that come sorted by conversation; holds one turn and one batch, whatever a conversation's length."""
    reader: _Reader | None = None
    for batch in batches:
        done = []
        for conv, text, starts, ends in zip(*(batch[c].to_pylist() for c in ("conv_id", "text", "starts", "ends"))):
            if reader is None or reader.conv != conv:
                done += [reader.row()] if reader else []
                reader = _Reader(conv)
            reader.feed(text, zip(starts, ends))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), _DIGESTS)], schema=_DIGESTS)
    if reader:
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(reader.row(), _DIGESTS)], schema=_DIGESTS)


def write_conversations(pieces: DataFrame, path: str, part_chars: int = PART_CHARS) -> None:
    """Writes the formatted conversations: conv_id, part, text, and the loss spans [start, end) that begin in the part, counted
    from the conversation's first character. Rendering, before the shuffle, is spread over all tasks; a conversation's
    pieces then pass through one task in order, as its text is one sequence, with memory for one part."""
    placed = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "piece")
    placed.mapInArrow(_parted(part_chars), _PARTS_DDL).write.parquet(path)


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """One row a conversation, from the written parts alone. A conversation is parsed and hashed in one task, which its digests
    ask for, with memory for one turn."""
    parts = spark.read.schema(_PARTS_DDL).parquet(path).repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return parts.mapInArrow(_read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a conversation of `conversations` and one for -1, read back from the written output. Null texts and roles count as
    empty, null conv_ids are one conversation, rows that share a turn come in the order of their rendered text, null
    turns first; rows whose conv_id is -1 are one conversation with the added ones; an empty table gives the row of -1; other
    columns are ignored."""
    hard = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    path = new_path(spark, "chat")
    write_conversations(formatted(rows), path)
    return read_back(spark, path)


OP6_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, length(regexp_replace(text, '([<\[])(\\*)(s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>|ROLE\]|/ROLE\]|/TURN\])', '\1\2\\\3', 'g'))
    + CASE role WHEN 'user' THEN 18 WHEN 'assistant' THEN 6 WHEN 'system' THEN 18 ELSE 22 + length(role) END AS chars
  FROM c
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
