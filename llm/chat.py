"""Chat formatting with offset-aligned loss masks.

A whole conversation is rendered into one text by a template, encoded once with offsets, and the loss mask is found by binary
search of the sorted spans of the assistant's texts among the sorted token spans. The template's marks are special tokens of
the tokenizer, so that no token reaches over the edge of a turn's text. Inside roles and texts whatever could read as a mark
is escaped, reversibly: a mark begins with "<|", and "<", any number of backslashes, "|" gets one backslash more.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.tokens import BYTE_BPE, load

ESCAPE, UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<(\\*)\\\|")


def escape(text: str) -> str:
    return ESCAPE.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return UNESCAPE.sub(r"<\1|", text)


@dataclass(frozen=True)
class Template:
    """Every mark begins with <| ; a turn is turn + role + text + its text + end."""

    turn: str = "<|turn|>"
    text: str = "<|text|>"
    end: str = "<|end|>"
    learnt: tuple[str, ...] = ("assistant",)

    @property
    def marks(self) -> tuple[str, ...]:
        return (self.turn, self.text, self.end)

    def render(self, turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
        """The formatted text, and the spans of the texts to learn, in code points."""
        parts, spans, at = [], [], 0
        for role, text in turns:
            head, body = f"{self.turn}{escape(role)}{self.text}", escape(text)
            if role in self.learnt and body:
                spans.append((at + len(head), at + len(head) + len(body)))
            parts += [head, body, self.end]
            at += len(head) + len(body) + len(self.end)
        return "".join(parts), spans

    def read(self, formatted: str) -> list[tuple[str, str]]:
        """The turns of a formatted text."""
        turns = []
        for turn in formatted.split(self.turn)[1:]:
            role, _, text = turn.partition(self.text)
            turns.append((unescape(role), unescape(text.removesuffix(self.end))))
        return turns


def mask_of(spans: list[tuple[int, int]], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """1 for each token that shares characters with a span. Starts and ends of tokens ascend."""
    mask = np.zeros(len(starts), np.int8)
    if spans:
        edges = np.array(spans)
        first, after = np.searchsorted(ends, edges[:, 0], side="right"), np.searchsorted(starts, edges[:, 1], side="left")
        for a, b in zip(first.tolist(), after.tolist(), strict=True):
            mask[a:b] = 1
    return mask


def masked_texts(formatted: str, starts: np.ndarray, ends: np.ndarray, mask: np.ndarray) -> list[str]:
    """The characters of each run of masked tokens, unescaped."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask, [0]])))
    return [unescape(formatted[starts[a] : ends[b - 1]]) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)]


def format_conversations(turns: DataFrame, template: Template = Template(), tokenizer: str = BYTE_BPE) -> DataFrame:
    """turns: conv_id, turn, role, text; other columns are left aside. Returns a row for each conversation: conv_id,
    formatted, ids, starts and ends (of each token's characters in formatted), mask (1: learn).

    A null text or role is an empty one; an empty text gives a turn without text. Turns of equal number, repeated rows among
    them, all stay, ordered by role and text; a null turn comes first. A null conv_id is a conversation of its own. An empty
    table gives no rows. One conversation at a time is held in memory."""
    own = turns.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    kind = dict(own.dtypes)["conv_id"]
    own = own.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        at, held = object(), []
        for batch in batches:
            for conv_id, role, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if conv_id != at:
                    if held:
                        yield at, held
                    at, held = conv_id, []
                held.append((role, text))
        if held:
            yield at, held

    def formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load(tokenizer, template.marks)
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            texts = [text for _, (text, _) in held]
            columns = ([], [], [], [])
            for (_, (_, spans)), found in zip(held, encoder.encode_batch(texts, add_special_tokens=False), strict=True):
                offsets = np.array(found.offsets, np.int32).reshape(-1, 2)
                starts, ends = np.ascontiguousarray(offsets[:, 0]), np.ascontiguousarray(offsets[:, 1])
                for column, value in zip(columns, (found.ids, starts, ends, mask_of(spans, starts, ends)), strict=True):
                    column.append(value)
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int8())
            lists = [pa.array(column, pa.list_(k)) for column, k in zip(columns, kinds, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([c for c, _ in held], type=arrow_kind), pa.array(texts, pa.string()), *lists], ["conv_id", "formatted", "ids", "starts", "ends", "mask"])

        arrow_kind = None
        def typed(source):
            nonlocal arrow_kind
            for batch in source:
                arrow_kind = batch.schema.field(0).type
                yield batch

        for conv_id, own_turns in rows(typed(batches)):
            held.append((conv_id, template.render(own_turns)))
            size += len(held[-1][1][0])
            if size > 1_000_000:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return own.mapInArrow(formatted, f"conv_id {kind}, formatted string, ids array<int>, starts array<int>, ends array<int>, mask array<tinyint>")
