"""Chat formatting with compiled templates.

Turns are marked by ``### role: `` and ``</turn>``; these control strings are
escaped inside texts by a backslash, and backslashes are doubled, so a reader
recovers every role and text.  Assistant texts are under the loss mask.

A conversation's turns come sorted (turn, role, text; nulls first) and are
rendered one by one, so a conversation of any length takes the memory of a
turn.  Null roles and texts count as empty; rows with a null conv_id form one
conversation.  Repeated rows are repeated turns.  An empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fan_out, lean, ship, table
from .templates import Template

CHAT = (
    "{% for m in messages %}### {{ m.role | escape_role }}: "
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}"
    "</turn>\n{% endfor %}"
)
_CONTROL = re.compile(r"\\|#(?=## )|<(?=/turn>)")
_ROLE = re.compile(r"[\\:<#]")
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\<]|\\.|<(?!/turn>))*)</turn>\n", re.S)


def escape(text: str | None) -> str:
    return _CONTROL.sub(r"\\\g<0>", text or "")


def escape_role(role: str | None) -> str:
    return _ROLE.sub(r"\\\g<0>", role or "")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


FILTERS = {"escape": escape, "escape_role": escape_role, "trim": lambda s: (s or "").strip(), "upper": lambda s: (s or "").upper(), "lower": lambda s: (s or "").lower()}


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The roles and texts of a formatted conversation."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


class _State:
    """Digests of one conversation, fed turn by turn."""

    def __init__(self, conv_id):
        self.conv_id, self.turns, self.loss_chars, self.chars = conv_id, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def feed(self, formatted: str, spans) -> None:
        self.chars += len(formatted)
        for role, text in read_back(formatted):
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        for s, e in spans:
            text = unescape(formatted[s:e])
            self.loss_chars += len(text)
            self.loss.update(text.encode("utf-8", "surrogatepass"))

    def row(self) -> tuple:
        return self.conv_id, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


_OUT = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
_OUT_SQL = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _OUT)], schema=_OUT)


def _digests(source: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template, state, rows = Template(source, FILTERS), None, []
        for b in batches:
            for conv, role, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                if state is None or state.conv_id != conv:
                    if state is not None:
                        rows.append(state.row())
                    state = _State(conv)
                state.feed(*template.render_turn({"role": role or "", "text": text or ""}))
            if len(rows) > 10_000:
                yield _batch(rows)
                rows = []
        if state is not None:
            rows.append(state.row())
        if rows:
            yield _batch(rows)

    return lean(run)


def _turns(source: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template = Template(source, FILTERS)
        for b in batches:
            got = [template.render_turn({"role": r or "", "text": t or ""}) for r, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            spans = pa.array([[list(s) for s in x[1]] for x in got], pa.list_(pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(3), pa.array([x[0] for x in got], pa.string()), spans], names=["conv_id", "turn", "formatted", "loss_spans"])

    return lean(run)


def format_turns(df: DataFrame, template: str = CHAT) -> DataFrame:
    """Each turn rendered: conv_id, turn, formatted, loss_spans (code points).

    A conversation is its turns in order, put after each other.  For templates
    that are one loop over ``messages``; others render whole conversations with
    :class:`templates.Template`.
    """
    ship(df.sparkSession)
    return df.select("conv_id", "role", "text", "turn").mapInArrow(_turns(template), "conv_id long, turn long, formatted string, loss_spans array<array<long>>")


def chat_digests(df: DataFrame, template: str = CHAT) -> DataFrame:
    """One row per conversation, read back from what was formatted."""
    ship(df.sparkSession)
    rows = df.select(F.col("conv_id").cast("long"), "role", "text", "turn").repartition(fan_out(df), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.select("conv_id", "role", "text").mapInArrow(_digests(template), _OUT_SQL)


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and conversation -7, formatted and read back."""
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text"))
    return chat_digests(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own))


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), t AS (
  SELECT *, length(text) + (length(text) - length(replace(text, '\', '')))
    + (length(text) - length(replace(text, '### ', ''))) // 4
    + (length(text) - length(replace(text, '</turn>', ''))) // 7 AS esc_text,
    2 * length(role) - length(regexp_replace(role, '[\\:<#]', '', 'g')) AS esc_role
  FROM c
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(4 + esc_role + 2 + esc_text + 8) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
