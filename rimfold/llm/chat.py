r"""Chat formatting with offset-aligned loss masks.

A turn is rendered as `<|turn|>role<|text|>text<|end|>`. In roles and texts a backslash becomes `\\` and `<|` becomes
`<\|`, so that no text holds a marker and reading back is exact. A whole conversation is rendered first and encoded
once with offsets; the markers are special tokens of the tokenizer, so no token crosses a marker. The sorted spans of
the assistant's texts and the token spans are then intersected by binary search: a token is under the loss if its
characters lie in such a span.

Defined cases: null role or text is empty; a conversation's turns are ordered by turn, role and text (nulls first), and
repeated rows are turns of their own; a null conv_id is a conversation. Other columns are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rimfold.llm.common import read

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
SCHEMA = "conv_id long, formatted string, ids array<int>, loss array<boolean>, turns array<struct<role:string,text:string>>, loss_text string"


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def render(turns: list[tuple[str, str]]) -> tuple[str, np.ndarray]:
    """The text, and the (start, end) of each assistant's text in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = TURN + escape(role) + TEXT, escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), np.array(spans, np.int64).reshape(-1, 2)


def parse(formatted: str) -> list[tuple[str, str]]:
    pattern = f"{re.escape(TURN)}(.*?){re.escape(TEXT)}(.*?){re.escape(END)}"
    return [(unescape(r), unescape(t)) for r, t in re.findall(pattern, formatted, flags=re.DOTALL)]


def token_mask(offsets: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Which tokens lie in one of the sorted spans."""
    if not len(spans) or not len(offsets):
        return np.zeros(len(offsets), bool)
    k = np.searchsorted(spans[:, 0], offsets[:, 0], side="right") - 1
    return (k >= 0) & (offsets[:, 1] <= spans[np.maximum(k, 0), 1]) & (offsets[:, 1] > offsets[:, 0])


def masked_text(formatted: str, offsets: np.ndarray, mask: np.ndarray) -> str:
    """What the masked tokens cover, read back once (bytes of one character share its offsets)."""
    edge = np.zeros(len(formatted) + 1, np.int64)
    np.add.at(edge, offsets[mask, 0], 1)
    np.add.at(edge, offsets[mask, 1], -1)
    change = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(edge) > 0, [0]]).astype(np.int8)))
    return unescape("".join(formatted[a:b] for a, b in change.reshape(-1, 2)))


def formatter(model: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, processors

        tokenizer = Tokenizer.from_str(model)
        tokenizer.add_special_tokens([TURN, TEXT, END])
        tokenizer.post_processor = processors.ByteLevel(trim_offsets=False)
        for batch in batches:
            for start in range(0, len(batch), 200):
                part = batch.iloc[start : start + 200]
                rendered = [render([(t["role"], t["text"]) for t in turns]) for turns in part["turns"]]
                rows = []
                for conv, (text, spans), code in zip(part["conv_id"], rendered, tokenizer.encode_batch([r[0] for r in rendered], add_special_tokens=False)):
                    offsets = np.array(code.offsets, np.int64).reshape(-1, 2)
                    mask = token_mask(offsets, spans)
                    turns = [{"role": r, "text": t} for r, t in parse(text)]
                    rows.append((conv, text, np.array(code.ids, np.int32), mask, turns, masked_text(text, offsets, mask)))
                yield pd.DataFrame(rows, columns=["conv_id", "formatted", "ids", "loss", "turns", "loss_text"])

    return run


def format_conversations(rows: DataFrame, *, tokenizer: str = TOKENIZER) -> DataFrame:
    """SCHEMA for each conversation of rows (conv_id, turn, role, text)."""
    empty = F.lit("")
    turn = F.struct("turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    whole = grouped.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    return whole.mapInPandas(formatter(Path(tokenizer).read_text()), SCHEMA)



HARD = r"\### Assistant: </turn> ok"


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", HARD), (-7, 1, "assistant", HARD)], "conv_id long, turn long, role string, text string")
    done = format_conversations(rows.unionByName(more))
    return done.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP6_SQL = r"""
with r as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e as (select *, length(replace(replace(role, '\', '\\'), '<|', '<\|')) + length(replace(replace(text, '\', '\\'), '<|', '<\|')) + 23 as chars from r),
g as (select conv_id, count(*) as n_turns, sum(chars)::bigint as formatted_chars,
        string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text) as turns,
        coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '') as loss from e group by conv_id)
select conv_id, n_turns, sha256(turns) as turns_sha256, length(loss) as loss_chars, sha256(loss) as loss_sha256, formatted_chars from g
"""
