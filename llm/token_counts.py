"""Token counts by prefix dynamic programming: the exact count at every prefix of a text, so that the count of any prefix and
the longest prefix within a budget are looked up without encoding again (see llm.tokens.PrefixCounts)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.tokens import BYTE_BPE, prefix_counts

LIMIT = 512


def count_tokens(docs: DataFrame, tokenizer: str = BYTE_BPE, limit: int = LIMIT, prefixes: bool = False) -> DataFrame:
    """docs: doc_id, text; other columns are left aside. Returns doc_id, n_bytes (UTF-8), n_tokens, over_limit, n_chars_within
    (code points of the longest prefix of at most `limit` tokens) and, with prefixes, prefix_counts: the token count of each
    prefix, from that of no code points to that of all.

    tokenizer: a byte-level BPE file. Special strings inside texts are special tokens, as the library has it by default.
    A null text is an empty one: no tokens. Repeated rows each give a row; an empty table gives none."""
    own = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    kind = dict(own.dtypes)["doc_id"]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = prefix_counts(tokenizer)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            rows = [counts.rows_of(text) for text in texts]
            totals = [counts.total(r) for r in rows]
            within = [len(text) if total <= limit else counts.longest_within(r, limit) for text, total, r in zip(texts, totals, rows, strict=True)]
            columns = {"doc_id": batch.column(0), "n_bytes": pa.array([len(text.encode()) for text in texts], pa.int64()), "n_tokens": pa.array(totals, pa.int64()),
                       "over_limit": pa.array([total > limit for total in totals], pa.bool_()), "n_chars_within": pa.array(within, pa.int64())}
            if prefixes:
                columns["prefix_counts"] = pa.array([counts.table(text) for text in texts], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_pydict(columns)

    schema = f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean, n_chars_within bigint" + ", prefix_counts array<bigint>" * prefixes
    return own.mapInArrow(counted, schema)
