"""Chat formatting with a compiled template, and reading formatted conversations back.

The rows of a conversation are sorted by turn inside a partition and fed to the template one by one;
each message becomes one row of the output: its place, its formatted text, and the spans that
were generated (the loss mask), in code points from the conversation's start. Joined in order they
are the formatted conversation. Nothing holds a conversation whole, however long it is; its
checksums are running ones.

Control strings inside texts and roles are escaped with backslashes, which reading undoes.

Defined cases: null texts and roles are empty ones; a role is any string. Rows with a null conv_id
are one conversation; null turns come first, and equal turns follow role and text, so repeated rows
are repeated turns. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chat_template import BREAK, CLOSE, OPEN, Piece, TemplateError, compile_template, unescape
from .common import small_batches

TEMPLATE = (
    "{% for m in messages %}### {{ m.role | header }}: "
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}"
    "</turn>\n{% endfor %}"
)
#: One turn of the template above: escaped role and text. Runs of plain characters are taken whole and never given back.
_TURN = re.compile(rf"{re.escape(OPEN)} ((?:[^\\:]++|\\.)*+): ((?:[^\\{CLOSE[0]}]++|\\.|(?!{re.escape(CLOSE)}){re.escape(CLOSE[0])})*+){re.escape(CLOSE)}\n", re.DOTALL)

_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
_OUT = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("formatted", pa.string()), ("generated", pa.list_(_SPAN))])
OUT_DDL = "conv_id long, place long, formatted string, generated array<struct<start:long,end:long>>"


class _Runs:
    """Splits sorted rows into runs of one conversation; a run is read once, in order."""

    def __init__(self, batches: Iterator[pa.RecordBatch]):
        self.rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        self.row = next(self.rows, None)

    def __iter__(self) -> Iterator[tuple[int | None, Iterator[tuple]]]:
        while self.row is not None:
            conv = self.row[0]
            yield conv, self._run(conv)

    def _run(self, conv: int | None) -> Iterator[tuple]:
        while self.row is not None and self.row[0] == conv:
            row = self.row
            self.row = next(self.rows, None)
            yield row


def _segments(pieces: Iterator[Piece]) -> Iterator[tuple[int, str, list[dict]]]:
    """(place, text, spans) for each round of the template's loop, and for what is left."""
    at, start, texts, spans = 0, 0, [], []
    for piece in pieces:
        if piece is BREAK:
            yield start, "".join(texts), spans
            start, texts, spans = at, [], []
            continue
        text, generated = piece
        if generated and text:
            spans.append({"start": at, "end": at + len(text)})
        texts.append(text)
        at += len(text)
    if texts:
        yield start, "".join(texts), spans


def _format(template: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template)
        out: list[tuple] = []
        size = 0
        for conv, rows in _Runs(batches):
            messages = ({"role": role or "", "text": text or ""} for _, _, role, text in rows)
            for place, text, spans in _segments(render(messages=messages)):
                out.append((conv, place, text, spans))
                size += len(text)
                if len(out) >= 512 or size > 8 << 20:
                    yield _batch(out, _OUT)
                    out, size = [], 0
        if out:
            yield _batch(out, _OUT)

    return run


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _by_conversation(rows: DataFrame, *order: str) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *order)


def format_conversations(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """conv_id, place (code points before), formatted, generated (spans), in order of place."""
    small_batches(conversations.sparkSession)
    compile_template(template)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return _by_conversation(rows, "turn", "role", "text").mapInArrow(_format(template), OUT_DDL)


_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    for conv, rows in _Runs(batches):
        turns, loss = hashlib.sha256(), hashlib.sha256()
        n = loss_chars = chars = 0
        buffer = ""
        for _, place, text, spans in rows:
            if place != chars:
                raise TemplateError("a part of a formatted conversation is missing")
            chars += len(text)
            for span in spans:
                masked = unescape(text[span["start"] - place : span["end"] - place])
                loss_chars += len(masked)
                loss.update(masked.encode())
            buffer += text
            at = 0
            while m := _TURN.match(buffer, at):
                turns.update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
                n += 1
                at = m.end()
            buffer = buffer[at:]
        if buffer:
            raise TemplateError("a formatted conversation does not end with a turn")
        out.append((conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
        if len(out) >= 4096:
            yield _batch(out, _DIGEST)
            out = []
    if out:
        yield _batch(out, _DIGEST)


def read_conversations(formatted: DataFrame) -> DataFrame:
    """What formatted conversations hold: turns and loss text as counts and running SHA-256 sums."""
    ddl = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    small_batches(formatted.sparkSession)
    return _by_conversation(formatted, "place").mapInArrow(_read, ddl)


def chat_digest(conversations: DataFrame) -> DataFrame:
    """All conversations and one, -7, that tries the control strings."""
    spark = conversations.sparkSession
    hard = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return read_conversations(format_conversations(rows.unionByName(extra)))


SQL = """
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\\### Assistant: </turn> ok')
), e AS (
  SELECT *, length(text) + len(regexp_extract_all(text, '\\\\')) + len(regexp_extract_all(text, '</turn>')) AS text_chars,
    length(role) + len(regexp_extract_all(role, '\\\\')) + len(regexp_extract_all(role, '</turn>')) + len(regexp_extract_all(role, ':')) AS role_chars,
    len(list_filter(range(1, length(text) + 1), lambda i: substr(text, i, 3) = '###')) AS marks,
    len(list_filter(range(1, length(role) + 1), lambda i: substr(role, i, 3) = '###')) AS role_marks
  FROM c
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(text_chars + marks + role_chars + role_marks + 14)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
