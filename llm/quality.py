"""Quality rules: statistics of each document, plain limits, and gradient-boosted trees over the statistics.

The trees are fitted to at most SAMPLE labelled documents, those of the least hashes of doc_id, and flattened into node arrays
that score a batch of documents at once. More symbols, capitals, repeated lines and repeated words never raise the score.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm import boosting
from llm.common import words_of

SAMPLE = 20_000
LEAST_CHANCE = 0.5
#: Fixed value: what counts as a symbol.
SYMBOLS = "#*$%&|<>"
#: Names of the statistics that the trees see, and whether the score may not rise (-1) or go either way (0) with them.
FEATURES = {"words": 0, "word_length": 0, "symbols": -1, "capitals": -1, "digits": 0, "marks": 0, "duplicate_lines": -1, "repeated_words": -1, "distinct_words": 0,
            "words_a_line": 0, "longest_word": 0, "ended_lines": 0}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def statistics(text: str) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """The counts of COUNTS and the features of FEATURES."""
    words = words_of(text)
    histogram = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    n, word_chars = len(words), len(text) - int(histogram[[9, 10, 11, 12, 13, 32]].sum())
    symbols = int(histogram[[ord(c) for c in SYMBOLS]].sum())
    lines = [line for line in text.split("\n") if line.strip(" \t\r\x0b\x0c")]
    duplicates = len(lines) - len(set(lines))
    numbers: dict[str, int] = defaultdict(count().__next__)
    ids = np.fromiter(map(numbers.__getitem__, words), np.int64, n)
    repeated = 0
    if n > 3:
        kinds = len(numbers)
        pairs = np.unique(ids[:-1] * kinds + ids[1:], return_inverse=True)[1]  # numbered anew, so that nothing overflows
        triples = pairs[:-1] * kinds + ids[2:]
        _, which, times = np.unique(triples, return_inverse=True, return_counts=True)
        twice = np.flatnonzero(times[which] > 1)
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[twice + k] = True
        repeated = int(covered.sum())
    size, some = max(word_chars, 1), max(n, 1)
    capitals, digits = int(histogram[65:91].sum()), int(histogram[48:58].sum())
    marks = int(histogram[33:48].sum() + histogram[58:65].sum() + histogram[91:97].sum() + histogram[123:127].sum())
    ended = sum(line[-1] in ".!?\"'" for line in lines)
    features = (float(n), word_chars / some, symbols / some, capitals / size, digits / size, marks / size, duplicates / max(len(lines), 1), repeated / some, len(numbers) / some,
                n / max(len(lines), 1), float(max(map(len, numbers), default=0)), ended / max(len(lines), 1))
    return (n, word_chars, symbols, duplicates, repeated), features


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> boosting.Forest:
    """The trees fitted to labels' quality (1 good, 0 bad), over the `sample` labels of the least hashes of doc_id. Labels
    without doc_id or quality, or of documents that aren't there, are left out."""
    chosen = labels.where("doc_id is not null and quality is not null").select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    # at most `sample` rows of two numbers
    labelled = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text")

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            features = [statistics(text)[1] for text in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(1).cast(pa.int64()), pa.array(features, pa.list_(pa.float64()))], ["doc_id", "quality", "features"])

    rows = labelled.mapInArrow(measured, "doc_id string, quality bigint, features array<double>").orderBy("doc_id", "quality", "features").limit(sample).collect()
    matrix = np.array([row["features"] for row in rows], float).reshape(len(rows), len(FEATURES))
    return boosting.fit(matrix, np.array([row["quality"] > 0 for row in rows]), list(FEATURES.values()))


def judge(docs: DataFrame, forest: boosting.Forest, least_chance: float = LEAST_CHANCE) -> DataFrame:
    """docs: doc_id, text and any other columns. Returns a row for each: row (all columns as they are), n_words, word_chars,
    n_symbols, n_dup_lines, n_repeat_words, chance (of good quality, by the trees), base_failed, kept.

    base_failed: fewer than 50 words, or more than half of the words in repeated three-word windows. A null text is an empty
    one and fails. Repeated rows are judged alike; an empty table gives no rows."""
    own = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, features = zip(*map(statistics, batch.column(1).to_pylist()), strict=True) if batch.num_rows else ((), ())
            columns = np.array(counts, np.int64).reshape(-1, len(COUNTS)).T
            chance = 1 / (1 + np.exp(-shared.value.score(np.array(features, float).reshape(-1, len(FEATURES)))))
            failed = (columns[0] < 50) | (100 * columns[4] > 50 * columns[0])
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns), pa.array(chance), pa.array(failed), pa.array(~failed & (chance >= least_chance))], ["row", *COUNTS, "chance", "base_failed", "kept"])

    kind = own.schema["row"].dataType.simpleString()
    return own.mapInArrow(judged, f"row {kind}, {', '.join(f'{c} bigint' for c in COUNTS)}, chance double, base_failed boolean, kept boolean")


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """docs without the rejected rows, all columns as they are."""
    return judge(docs, fit(docs, labels), **options).where("kept").select("row.*")
