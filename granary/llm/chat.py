"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, encoded once with offsets, and the sorted spans of
its turns are intersected with the spans of the tokens by binary search. A token has
loss if its span meets the text of an assistant turn; the mask's character spans are
the intersections, so that they cover each assistant text exactly even where a token
straddles a marker.

Template: ``<|turn|>role<|text|>text<|end|>`` for each turn, without separators. Control
strings inside roles and texts - the template's own and those of common chat formats -
get a backslash after their first character; strings that already look so get one
more, so unescaping takes exactly one away.

Plan: one shuffle by conversation; rows of a conversation are sorted in an array, which
is as large as the conversation. Python gets bounded Arrow batches.

Defined cases: null text is empty, null role is empty, a null turn sorts first, turns
that tie sort by role and text, equal rows are turns of their own, rows with a null
conv_id form one conversation, an empty table gives no rows, further columns are
ignored whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tokens import json_tokenizer

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: The control strings that texts may not hold unescaped.
CONTROL = (
    TURN, TEXT, END, "<s>", "</s>", "<unk>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
    "<|endoftext|>", "<|startoftext|>", "<|im_start|>", "<|im_end|>",
)
_ESCAPE = re.compile("(?=(" + "|".join(re.escape(c[0]) + r"\\*" + re.escape(c[1:]) for c in CONTROL) + "))")
LEARNED = "assistant"


def escape(text: str) -> str:
    """``text`` with a backslash after the first character of every control string in it."""
    at = [m.start() + 1 for m in _ESCAPE.finditer(text)]
    return "\\".join(text[a:b] for a, b in zip([0, *at], [*at, len(text)], strict=True)) if at else text


def unescape(text: str) -> str:
    """Takes away what ``escape`` put in."""
    at = [m.start() + 1 for m in _ESCAPE.finditer(text)]
    return "".join(text[a + (k > 0) : b] for k, (a, b) in enumerate(zip([0, *at], [*at, len(text)], strict=True))) if at else text


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int, bool]]]:
    """The formatted conversation and, for each turn, the span of its text and whether it is learned."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{TEXT}", escape(text)
        spans.append((at + len(head), at + len(head) + len(body), role == LEARNED))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def mask(offsets: list[tuple[int, int]], spans: list[tuple[int, int, bool]]) -> tuple[list[bool], list[tuple[int, int]]]:
    """Which tokens have loss, and the character spans under the mask, one per learned text."""
    starts, ends = (np.fromiter((o[i] for o in offsets), np.int64, len(offsets)) for i in (0, 1))
    loss, under = np.zeros(len(offsets), bool), []
    for a, b, learned in spans:
        if not learned or a == b:
            continue
        lo, hi = int(np.searchsorted(ends, a, "right")), int(np.searchsorted(starts, b, "left"))
        loss[lo:hi] = True
        under.append((max(a, int(starts[lo])), min(b, int(ends[hi - 1]))) if hi > lo else (a, a))
    return loss.tolist(), under


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns, read back from a formatted conversation."""
    turns, at = [], 0
    while at < len(formatted):
        mid = formatted.index(TEXT, at)
        end = formatted.index(END, mid)
        turns.append((unescape(formatted[at + len(TURN) : mid]), unescape(formatted[mid + len(TEXT) : end])))
        at = end + len(END)
    return turns


FORMATTED = "conv_id long, formatted string, token_ids array<int>, loss array<boolean>, loss_spans array<array<int>>"


def format_conversations(conversations: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """One row per conversation: its formatted text, token ids, loss mask, and mask spans in characters."""
    turn = F.struct(F.col("turn").alias("t"), F.coalesce("role", F.lit("")).alias("r"), F.coalesce("text", F.lit("")).alias("x"))
    grouped = conversations.select("conv_id", turn.alias("turn")).groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = json_tokenizer(tokenizer).encode
        for batch in batches:
            out: list[tuple] = []
            for conv, turns in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text, spans = render([(t["r"], t["x"]) for t in turns.as_py()])
                code = encode(text, add_special_tokens=False)
                loss, under = mask(code.offsets, spans)
                out.append((conv, text, code.ids, loss, [list(u) for u in under]))
                if len(out) == 256:
                    yield _batch(out)
                    out = []
            if out:
                yield _batch(out)

    return grouped.select(F.col("conv_id").cast("long"), "turns").mapInArrow(run, FORMATTED)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.list_(pa.list_(pa.int32()))]
    names = ["conv_id", "formatted", "token_ids", "loss", "loss_spans"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, n_loss_tokens long"


def digests(formatted: DataFrame) -> DataFrame:
    """What can be read back from the formatted conversations and their masks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, pa.string() if "sha" in n else pa.int64()) for n in (c.split()[0] for c in DIGEST.split(", "))])
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                turns = parse(r["formatted"])
                said = "".join(f"{role}\n{text}\n" for role, text in turns)
                learned = "".join(unescape(r["formatted"][a:b]) for a, b in r["loss_spans"])
                rows.append((r["conv_id"], len(turns), _sha(said), len(learned), _sha(learned), len(r["formatted"]), len(r["token_ids"]), sum(r["loss"])))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return formatted.mapInArrow(run, DIGEST)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``conversations``, and conversation -7, whose turns quote control strings."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    quoted = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"SELECT -7L AS conv_id, 0L AS turn, 'user' AS role, '{quoted}' AS text UNION ALL SELECT -7L, 1L, 'assistant', '{quoted}'")
    return digests(format_conversations(rows.unionByName(extra))).drop("n_tokens", "n_loss_tokens")


def _sql() -> str:
    """The digests from the table itself: escaping adds a character for each control string, and no two of those overlap."""
    found = "|".join(re.escape(c[0]) + r"\\*" + re.escape(c[1:]) for c in CONTROL)
    size = lambda c: f"length({c}) + len(regexp_extract_all({c}, '{found}'))"
    order = "ORDER BY turn NULLS FIRST, role, text"
    quoted = "</s>[INST] ok [/INST]"
    return f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{quoted}' UNION ALL SELECT -7, 1, '{LEARNED}', '{quoted}')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' {order})) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = '{LEARNED}'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' {order}) FILTER (role = '{LEARNED}'), '')) AS loss_sha256,
  CAST(sum({len(TURN + TEXT + END)} + {size("role")} + {size("text")}) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""


SQL = _sql()
