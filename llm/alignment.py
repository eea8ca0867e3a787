"""Alignment of two tokenizers' tokens over the same bytes, by interval coalescing, and counts of linked ids over a corpus.

All tokens of a batch of texts, of both tokenizers, are intervals of one line of bytes. They are sorted by start; where a token
starts at or behind the running maximum of the ends before it, a group begins. Within a group every token of A is expanded to
the tokens of B that it overlaps. All of that is arrays over the batch, whatever the length of a text.

Counts of pairs: texts are dealt with in chunks of bounded size, and a chunk's different pairs, not each text's, are counted
and joined with the counts of the corpus, so that a pair that nearly all texts have is one row a chunk.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from llm.common import stored
from llm.tokens import BYTE_BPE, Kept, byte_letters, file_of, gaps

PIECE_BPE = "piece_bpe_32k.model"
#: A chunk ends behind the text with which it has so many links.
CHUNK_LINKS = 1 << 16
#: Texts encoded at once, of so many code points together or one.
BATCH_CHARS = 1 << 18


class Line(NamedTuple):
    """Tokens of a batch over one line of bytes: ids, starts and ends, and the number of the text each belongs to."""

    ids: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    texts: np.ndarray


class Tokens:
    """A tokenizer's ids of texts, and the bytes of each id. by_word: whether the ids of a text are those of its parts that
    begin with white space behind something else, as no token reaches over such a place."""

    def __init__(self, name: str):
        self.pieces = name.endswith(".model")
        if self.pieces:
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=file_of(name))
            written = [(k, model.id_to_piece(k)) for k in range(model.get_piece_size())]
            self.bytes = [bytes([int(piece[3:5], 16)]) if model.is_byte(k) else piece.replace("▁", " ").encode() for k, piece in written]
            self.encode = lambda texts: model.encode(texts, num_threads=1)
            plain = [piece for k, piece in written if not model.is_byte(k)]
            self.by_word = not any("\n" in piece or "▁" in piece.lstrip("▁") for piece in plain)
        else:
            from tokenizers import Tokenizer

            model, letters = Tokenizer.from_file(file_of(name)), byte_letters()
            model.encode_special_tokens = True
            vocabulary = model.get_vocab(with_added_tokens=True)
            self.bytes = [b""] * (max(vocabulary.values()) + 1)
            for token, k in vocabulary.items():
                self.bytes[k] = bytes(map(letters.__getitem__, token)) if all(c in letters for c in token) else token.encode()
            self.encode = lambda texts: [found.ids for found in model.encode_batch_fast([" " + text for text in texts], add_special_tokens=False)]
            with open(file_of(name), encoding="utf-8") as file:
                split = json.load(file)["pre_tokenizer"] or {}
            self.by_word = split.get("type") == "ByteLevel" and split.get("use_regex", True)
        self.sizes = np.array([len(x) for x in self.bytes], np.int64)
        self.kind = np.dtype("<u2" if len(self.bytes) <= 1 << 16 else "<u4")

    def encode_parts(self, parts: list[bytes]) -> list[bytes] | None:
        """Ids of parts that begin with white space (the first with a blank) and stand one behind the other, as numbers of
        `kind`: they are encoded as one text, and cut where the parts end. None if the tokens don't spell the text."""
        whole = b"".join(parts)
        ids = self.encode([whole.decode()[1:]])[0]
        if b"".join(map(self.bytes.__getitem__, ids)) != whole:
            return None
        numbers = np.array(ids, self.kind)
        ends, cuts = np.cumsum(self.sizes[numbers]), np.cumsum([len(part) for part in parts])
        at = np.searchsorted(ends, cuts)
        if not np.array_equal(ends[at], cuts):
            return None
        raw, stops = numbers.tobytes(), ((at + 1) * self.kind.itemsize).tolist()
        return [raw[start:stop] for start, stop in zip([0, *stops], stops, strict=False)]

    def spelled(self, ids: list[int], text: bytes) -> bytes | None:
        """The ids as numbers of `kind`; None if their tokens don't spell the text."""
        return np.array(ids, self.kind).tobytes() if b"".join(map(self.bytes.__getitem__, ids)) == text else None


@lru_cache(maxsize=4)
def tokens_of(name: str) -> Tokens:
    return Tokens(name)


class BothIds:
    """Ids of texts by two tokenizers. Those of words, as they are inside a text (behind a blank, or beginning with a line end),
    are kept, at most ENTRIES of them in each worker."""

    ENTRIES = 150_000

    def __init__(self, a: Tokens, b: Tokens):
        self.a, self.b, self.words = a, b, Kept(self.ENTRIES)

    def _whole(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """By the two libraries; nothing where either spells another text."""
        spelled = zip(texts, self.a.encode(texts), self.b.encode(texts), strict=True)
        found = [(self.a.spelled(ids_a, want := (" " + text).encode()), self.b.spelled(ids_b, want)) for text, ids_a, ids_b in spelled]
        return [pair if text and None not in pair else (b"", b"") for text, pair in zip(texts, found, strict=True)]

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """For each text the ids of A and of B; none where the text is empty or either doesn't spell it."""
        out: list = [None if text else (b"", b"") for text in texts]
        lists, new = {}, {}
        if self.a.by_word and self.b.by_word:
            for k, text in enumerate(texts):
                if text and text.replace("\n", " ") == " ".join(text.split()):  # white space is single blanks and line ends inside
                    words = text.replace("\n", " \n").split(" ")
                    found = list(map(self.words.get, words))
                    lists[k] = words, found, list(gaps(found)) if None in found else ()
                    new.update((words[at], None) for at in lists[k][2])
        parts = [b" a", *((word if word[0] == "\n" else " " + word).encode() for word in new)]  # a blank begins them
        pairs = [x.encode_parts(parts) for x in (self.a, self.b)] if new else []
        if None not in pairs:
            new = dict(zip(new, list(zip(*pairs, strict=True))[1:], strict=True))
            for words, found, missing in lists.values():
                for at in missing:
                    found[at] = new[words[at]]
            for word, pair in new.items():
                self.words.put(word, pair)
        for k, (_, found, missing) in lists.items():
            if None not in pairs or not missing:
                out[k] = tuple(map(b"".join, zip(*found, strict=True)))
        rest = [k for k, pair in enumerate(out) if pair is None]
        for k, pair in zip(rest, self._whole([texts[k] for k in rest]) if rest else [], strict=True):
            out[k] = pair
        return out


@lru_cache(maxsize=2)
def both_ids(name_a: str, name_b: str) -> BothIds:
    return BothIds(tokens_of(name_a), tokens_of(name_b))


def line(runs: Sequence[bytes], tokens: Tokens) -> Line:
    """runs: for each text its ids as numbers of the tokenizer's kind."""
    ids = np.frombuffer(b"".join(runs), tokens.kind).astype(np.int64)
    sizes = tokens.sizes[ids]
    ends = np.cumsum(sizes)
    return Line(ids, ends - sizes, ends, np.repeat(np.arange(len(runs)), [len(run) // tokens.kind.itemsize for run in runs]))


def coalesce(a: Line, b: Line) -> tuple[np.ndarray, np.ndarray]:
    """The number of the group of each token of A and of B."""
    starts, ends = np.concatenate([a.starts, b.starts]), np.concatenate([a.ends, b.ends])
    order = np.lexsort((ends, starts))
    reach = np.maximum.accumulate(ends[order])
    begins = np.ones(len(order), np.int64)
    begins[1:] = starts[order][1:] >= reach[:-1]
    groups = np.empty(len(order), np.int64)
    groups[order] = np.cumsum(begins) - 1
    return groups[: len(a.ids)], groups[len(a.ids) :]


def overlaps(a: Line, b: Line) -> tuple[np.ndarray, np.ndarray]:
    """Places of all tokens of A and of B that share a byte."""
    first, behind = np.searchsorted(b.ends, a.starts, "right"), np.searchsorted(b.starts, a.ends, "left")
    each = behind - first
    before = np.cumsum(each) - each
    return np.repeat(np.arange(len(each)), each), np.arange(int(each.sum())) - np.repeat(before - first, each)


class Writer:
    """Groups of a text as `a1,a2|b1;a3|b2,b3`."""

    def __init__(self, n_a: int, n_b: int):
        self.after_a, self.after_b = ([np.array([f"{k}{mark}" for k in range(n)], object) for mark in marks] for n, marks in ((n_a, ",|"), (n_b, ",;")))

    def texts(self, a: Line, b: Line, groups_a: np.ndarray, groups_b: np.ndarray, n: int) -> list[str]:
        last_a, last_b = (np.append(x[1:] != x[:-1], True) if len(x) else np.zeros(0, bool) for x in (groups_a, groups_b))
        written = np.concatenate([np.where(last_a, self.after_a[1][a.ids], self.after_a[0][a.ids]), np.where(last_b, self.after_b[1][b.ids], self.after_b[0][b.ids])])
        kind = np.repeat([0, 1], [len(a.ids), len(b.ids)])
        order = np.lexsort((kind, np.concatenate([groups_a, groups_b])))  # stable: tokens stay in order
        tokens = written[order].tolist()
        stops = np.cumsum(np.bincount(a.texts, minlength=n) + np.bincount(b.texts, minlength=n)).tolist()
        return ["".join(tokens[start:stop])[:-1] for start, stop in zip([0, *stops], stops, strict=False)]


@lru_cache(maxsize=2)
def writer_of(n_a: int, n_b: int) -> Writer:
    return Writer(n_a, n_b)


class Aligned(NamedTuple):
    """Of a batch: tokens, groups, and the places of linked tokens; no tokens for texts that the two write differently."""

    a: Line
    b: Line
    groups_a: np.ndarray
    groups_b: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray


def align_texts(texts: Sequence[str], ids: BothIds, links: str = "ends") -> Aligned:
    """links: "ends", pairs of tokens that end together, or "overlaps", all that share a byte."""
    runs = ids.encode(list(texts))
    of_a, of_b = line([run for run, _ in runs], ids.a), line([run for _, run in runs], ids.b)
    link_a, link_b = overlaps(of_a, of_b)
    if links == "ends":
        together = of_a.ends[link_a] == of_b.ends[link_b]
        link_a, link_b = link_a[together], link_b[together]
    return Aligned(of_a, of_b, *coalesce(of_a, of_b), link_a, link_b)


def _bounded(texts: list[str]) -> Iterator[slice]:
    """Slices of texts of BATCH_CHARS code points together, or one text."""
    start = chars = 0
    for k, text in enumerate(texts):
        if k > start and chars + len(text) > BATCH_CHARS:
            yield slice(start, k)
            start, chars = k, 0
        chars += len(text)
    if start < len(texts):
        yield slice(start, len(texts))


CHUNK = "chunk bigint, docs array<struct<doc_id:{kind},n_a:bigint,n_b:bigint,n_groups:bigint,n_links:bigint,groups_sha256:string>>, at binary, pairs array<bigint>, counts array<bigint>"
PAIR_BITS = 32


def place_kind(n_pairs: int) -> np.dtype:
    """How places among so many pairs are written."""
    return np.dtype("<u2" if n_pairs <= 1 << 16 else "<u4")


def chunks(docs: DataFrame, tokenizer_a: str, tokenizer_b: str, links: str) -> DataFrame:
    """A row for each chunk of texts: its documents, the place among the chunk's pairs of each link (document by document), the
    chunk's different pairs (id of A << 32 | id of B) and how often it has each."""
    own = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    kind = dict(own.dtypes)["doc_id"]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = both_ids(tokenizer_a, tokenizer_b)
        writer = writer_of(len(encoder.a.bytes), len(encoder.b.bytes))
        waiting, keys, number = [], [], TaskContext.get().partitionId() << 32

        def put() -> pa.RecordBatch:
            nonlocal number
            pairs, at, counts = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
            ids = pa.concat_arrays([rows[0] for rows in waiting])
            columns = [ids, *(pa.array(np.concatenate([rows[k] for rows in waiting]), pa.int64()) for k in range(1, 5)), pa.array(list(chain.from_iterable(rows[5] for rows in waiting)), pa.string())]
            each = pa.StructArray.from_arrays(columns, ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"])
            places = pa.array([at.astype(place_kind(len(pairs))).tobytes()], pa.binary())
            lists = [pa.LargeListArray.from_arrays([0, len(x)], x).cast(pa.list_(x.type)) for x in (each, pa.array(pairs, pa.int64()), pa.array(counts, pa.int64()))]
            waiting.clear()
            keys.clear()
            number += 1
            return pa.RecordBatch.from_arrays([pa.array([number - 1], pa.int64()), lists[0], places, *lists[1:]], ["chunk", "docs", "at", "pairs", "counts"])

        for batch in batches:
            texts = batch.column(1).to_pylist()
            for part in _bounded(texts):
                own_texts, n = texts[part], part.stop - part.start
                got = align_texts(own_texts, encoder, links)
                written = writer.texts(got.a, got.b, got.groups_a, got.groups_b, n)
                starts = np.append(True, got.groups_a[1:] != got.groups_a[:-1])[: len(got.groups_a)]
                sizes = [np.bincount(x, minlength=n) for x in (got.a.texts, got.b.texts, got.a.texts[starts], got.a.texts[got.link_a])]
                waiting.append([batch.column(0).slice(part.start, n), *sizes, [hashlib.sha256(x.encode()).hexdigest() if x else "" for x in written]])
                keys.append(got.a.ids[got.link_a] << PAIR_BITS | got.b.ids[got.link_b])
                if sum(map(len, keys)) >= CHUNK_LINKS:
                    yield put()
        if waiting:
            yield put()

    return own.mapInArrow(found, CHUNK.format(kind=kind))


def pair_counts(chunked: DataFrame) -> DataFrame:
    """pair, n (links of the corpus that hold it linked), best (no pair with the same id of B has more)."""
    each = chunked.select(F.explode(F.arrays_zip("pairs", "counts")).alias("of")).select(F.col("of.pairs").alias("pair"), F.col("of.counts").alias("own"))
    counted = each.groupBy("pair").agg(F.sum("own").alias("n"))
    of_b = Window.partitionBy(F.expr(f"pair & {(1 << PAIR_BITS) - 1}"))
    return counted.select("pair", "n", (F.max("n").over(of_b) == F.col("n")).alias("best"))


def align(docs: DataFrame, tokenizer_a: str = BYTE_BPE, tokenizer_b: str = PIECE_BPE, links: str = "ends") -> DataFrame:
    """docs: doc_id, text; other columns are left aside. tokenizer_a: a byte-level BPE file, which gets a blank and the text;
    tokenizer_b: a sentencepiece model, which adds the blank itself. Returns a row for each row: doc_id, n_a, n_b (tokens),
    n_groups, n_links, n_best (links whose pair is counted as often as any of their id of B), count_sum (of the links' pair
    counts), groups_sha256.

    Null and empty texts, and those that either tokenizer's tokens don't spell, have no tokens: zeros and ''. Repeated rows
    each give a row and count; an empty table gives none."""
    chunked = stored(chunks(docs, tokenizer_a, tokenizer_b, links), "chunks")
    counts = stored(pair_counts(chunked), "pair_counts")
    wanted = chunked.select("chunk", F.posexplode("pairs").alias("place", "pair"))
    known = wanted.join(counts, "pair").groupBy("chunk").agg(F.collect_list(F.struct("place", "n", "best")).alias("known"))
    joined = chunked.select("chunk", "docs", "at").join(known, "chunk", "left")
    kind = dict(docs.dtypes)["doc_id"]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                each, known = batch.column("docs")[row].values, batch.column("known")[row].values
                n = best = np.zeros(0, np.int64)
                if known is not None:
                    order = np.argsort(known.field("place").to_numpy())
                    n, best = (known.field(name).to_numpy(zero_copy_only=False)[order] for name in ("n", "best"))
                at = np.frombuffer(batch.column("at")[row].as_buffer(), place_kind(len(n)))
                stops = np.cumsum(each.field("n_links").to_numpy(zero_copy_only=False))
                sums = [np.diff(np.append(0, np.append(0, np.cumsum(x[at].astype(np.int64)))[stops])) for x in (best, n)]
                yield pa.RecordBatch.from_arrays([*(each.field(k) for k in range(5)), *(pa.array(x, pa.int64()) for x in sums), each.field(5)],
                                                 ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return joined.mapInArrow(summed, f"doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string")
