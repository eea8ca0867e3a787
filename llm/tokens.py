"""Public tokenizers inside tasks: loading, ids of white-space separated words, and token counts of all prefixes.

The tables here are kept per Python worker and have a fixed most number of entries (see Kept).
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import ahocorasick
import numpy as np
import regex

from llm.common import OTHER_SPACES, words_of

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core

#: Marks that by themselves end a word of letters: of no longer mark, and part of no short form.
PLAIN_MARKS = frozenset(".,;:!?()[]{}%&*#$+=|/")
BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"


def file_of(name: str) -> str:
    """name: a path, or the name of a file of the installed public tokenizers."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=8)
def load(name: str, marks: tuple[str, ...] = ()):
    """The tokenizer, with marks as further special tokens."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(file_of(name))
    if marks:
        tokenizer.add_special_tokens(list(marks))
    return tokenizer


class Kept(dict):
    """A table of at most `most` entries. The first ones stay, as frequent keys come early; when many were turned away since,
    it begins anew."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.refused = most, 0

    def put(self, key, value):
        if len(self) < self.most:
            self[key] = value
        else:
            self.refused += 1
            if self.refused > 8 * self.most:
                self.clear()
                self.refused = 0
        return value


class WordIds:
    """Ids of texts for a tokenizer of lower-cased words that drops white space, so that the ids of a text are those of its
    white-space separated words, in order. Such a word's pieces, as the tokenizer's own pattern splits it, are encoded by the
    library once and kept."""

    ENTRIES = 250_000
    #: Fixed value: the tokenizer's pattern.
    PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")

    def __init__(self, name: str):
        self.tokenizer = load(name)
        size = self.tokenizer.get_vocab_size()
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model, self.letters = self.tokenizer.model, {byte: letter for letter, byte in byte_letters().items()}
        self.words, self.pieces = Kept(self.ENTRIES), Kept(self.ENTRIES)

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text the bytes of its ids as `kind`."""
        lists = [words_of(text) for text in texts]
        found = [list(map(self.words.get, words)) for words in lists]
        learnt: dict[str, bytes] = {}
        for words, ids in zip(lists, found, strict=True):
            for at in gaps(ids):
                if (own := learnt.get(word := words[at])) is None:
                    own = learnt[word] = self.words.put(word, self._learn(word))
                ids[at] = own
        return list(map(b"".join, found))

    def _split(self, word: str) -> list[str] | None:
        """Lower-case pieces; None where only the library should judge: special tokens, letters whose lower case depends on
        their place or has another length, and letters that aren't composed."""
        low = word.lower()
        if not word.isascii() and ("Σ" in word or len(low) != len(word) or not unicodedata.is_normalized("NFC", word)):
            return None
        if low.isalpha():
            return [low]
        if low[-1] in PLAIN_MARKS and low[:-1].isalpha():
            return [low[:-1], low[-1]]
        if "<" in word and any(special in word for special in self.special):
            return None
        return self.PIECES.findall(low)

    def _learn(self, word: str) -> bytes:
        if (pieces := self._split(word)) is None:
            return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, self.kind).tobytes()
        return b"".join([self.pieces.get(piece) or self._learn_piece(piece) for piece in pieces])

    def _learn_piece(self, piece: str) -> bytes:
        letters = piece if piece.isascii() and piece.isprintable() else "".join(map(self.letters.__getitem__, piece.encode()))
        ids = [token.id for token in self.model.tokenize(letters)]
        return self.pieces.put(piece, np.array(ids, self.kind).tobytes())


def gaps(found: list) -> Iterator[int]:
    """The places of None in a list that its reader fills."""
    at = -1
    try:
        while True:
            at = found.index(None, at + 1)
            yield at
    except ValueError:
        return


def byte_letters() -> dict[str, int]:
    """The letter by which a byte-level vocabulary writes each byte: printable ones themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


class PrefixCounts:
    """Exact token counts of all prefixes of a text, for a byte-level BPE tokenizer, by dynamic programming.

    The last token of a piece's prefix is the one vocabulary entry that ends there and that the merges leave beside the last
    token of the prefix before it; the count is that prefix's count and one. A piece is what the tokenizer's pattern takes as a
    unit. A text is cut before white space that follows something else: no piece reaches over such a place and none looks
    beyond the white space after it, so that the counts of a text's parts add up."""

    ENTRIES = 300_000
    #: The tokenizer's pattern and its short forms.
    PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
    SHORT = {"'s", "'t", "'re", "'ve", "'m", "'ll", "'d"}
    SPACES = regex.compile(r"\s{2,}")
    IRREGULAR = re.compile(r"\s\s|^\s|\s$|[\x1c-\x1f]").search
    CUTS = re.compile(r"(?<=\S)(?=[ \t-\r])").split

    def __init__(self, name: str):
        with open(file_of(name), encoding="utf-8") as file:
            data = json.load(file)
        letters = byte_letters()
        as_bytes = lambda token: bytes(map(letters.__getitem__, token))
        self.special = [t["content"] for t in data["added_tokens"]]
        self.tokens: dict[bytes, int] = {}
        for token in data["model"]["vocab"]:
            if token not in self.special:
                self.tokens[as_bytes(token)] = len(self.tokens)
        #: Of each token: the rank of the merge that makes it, and the two tokens it is made of; -1 for single bytes.
        self.made_at, self.left, self.right = ([-1] * len(self.tokens) for _ in range(3))
        self.ranks: dict[int, int] = {}
        for rank, merge in enumerate(data["model"]["merges"]):
            a, b = (self.tokens[as_bytes(x)] for x in (merge if isinstance(merge, list) else merge.split(" ")))
            made = self.tokens[as_bytes("".join(merge) if isinstance(merge, list) else merge.replace(" ", ""))]
            self.ranks[a << 20 | b] = rank
            if self.made_at[made] < 0:
                self.made_at[made], self.left[made], self.right[made] = rank, a, b
        self.entries = ahocorasick.Automaton()
        for entry, token in self.tokens.items():
            self.entries.add_word(entry.decode("latin-1"), (token, len(entry)))
        self.entries.make_automaton()
        self.beside, self.rows, self.parts, self.first = (Kept(self.ENTRIES) for _ in range(4))

    def fits(self, left: int, right: int) -> bool:
        """Whether the merges of both tokens' bytes, one behind the other, end in just these two tokens.

        Looked at backwards from the end of the merges: the last part of the left token and the first part of the right one
        stand side by side until the earlier of the merges that take them in. They stay apart if no merge of the two comes
        before that; then the later of the two is undone, down to single bytes. Of equal merges the left one comes first."""
        made_at, ranks = self.made_at, self.ranks
        left_until = right_until = 1 << 60
        while True:
            rank = ranks.get(left << 20 | right, 1 << 60)
            if rank < left_until and rank <= right_until and rank < 1 << 60:
                return False
            if made_at[left] < 0 and made_at[right] < 0:
                return True
            if made_at[left] > made_at[right]:
                left_until, left = made_at[left], self.right[left]
            else:
                right_until, right = made_at[right], self.left[right]

    def byte_row(self, piece: bytes) -> list[int]:
        """The count of every prefix of a piece, from 0 bytes on. Every entry of the vocabulary is what its bytes merge to.

        The automaton gives at each byte the entries that end there, by its suffix links, longest first."""
        size, beside = len(piece), self.beside
        last, counts, done = [-1] * (size + 1), [0] * (size + 1), -1
        for at, (token, length) in self.entries.iter(piece.decode("latin-1")):
            if at == done:
                continue
            start = at + 1 - length
            if start:
                pair = last[start] << 20 | token
                if (fit := beside.get(pair)) is None:
                    fit = beside.put(pair, self.fits(last[start], token))
                if not fit:
                    continue
            done = at
            last[at + 1], counts[at + 1] = token, counts[start] + 1
        if -1 in last[1:]:
            raise ValueError("the vocabulary lacks a byte")
        return counts

    def row(self, piece: str) -> bytes | tuple[int, ...]:
        """The count of every prefix of a piece, from 1 code point on."""
        if (found := self.rows.get(piece)) is None:
            counts = self.byte_row(piece.encode())
            if not piece.isascii():
                counts = [0, *(counts[at] for at in accumulate(len(c.encode()) for c in piece))]
            found = packed(counts[1:])
            if len(piece) <= 100:
                self.rows.put(piece, found)
        return found

    def plain(self, part: str) -> list[int]:
        """The count of every prefix of a part without special tokens, from 1 code point on."""
        counts: list[int] = []
        before = 0
        for match in self.PIECES.finditer(part):
            piece = match.group()
            row = self.row(piece)
            if piece in self.SHORT:  # its prefixes aren't short forms, but an apostrophe and letters
                mark = self.row("'")[0]
                counts += [before + mark, *(before + mark + n for n in (self.row(piece[1:-1]) if len(piece) > 2 else ())), before + row[-1]]
            else:
                counts += [before + n for n in row]
            before = counts[-1]
        for match in self.SPACES.finditer(part):  # at the end of a prefix, white space is one piece
            start = match.start()
            base = counts[start - 1] if start else 0
            counts[start : match.end()] = [base + n for n in self.row(match.group())]
        return counts

    def part(self, part: str) -> bytes | tuple[int, ...]:
        if part[0] == " ":
            if part[1:].isalpha():
                return self.row(part)
            if part[-1] in PLAIN_MARKS and part[1:-1].isalpha():
                row, mark = self.row(part[:-1]), self.row(part[-1])
                return packed([*row, row[-1] + mark[0]])
        counts: list[int] = []
        before = 0
        while found := min(((part.index(s), -len(s), s) for s in self.special if s in part), default=None):
            at, special = found[0], found[2]
            counts += [before + n for n in self.plain(part[: at + len(special) - 1])]  # not yet whole: ordinary text
            before += (self.plain(part[:at])[-1] if at else 0) + 1
            counts.append(before)
            part = part[at + len(special) :]
        return packed([*counts, *(before + n for n in self.plain(part))])

    def rows_of(self, text: str) -> list[bytes | tuple[int, ...]]:
        """The rows of a text's parts, in order."""
        if not text:
            return []
        if self.IRREGULAR(text):
            return [self._known(self.first, part, part) for part in self.CUTS(text)]
        words = text.replace("\n", " \n").split(" ")
        found = list(map(self.parts.get, words))
        found[0] = self._known(self.first, words[0], words[0])
        for at in gaps(found):
            word = words[at]
            found[at] = self._known(self.parts, word, word if word[0] == "\n" else " " + word)
        return found

    def _known(self, table: Kept, key: str, part: str) -> bytes | tuple[int, ...]:
        if (found := table.get(key)) is None:
            found = self.part(part)
            if len(key) <= 100:
                table.put(key, found)
        return found

    def total(self, rows: list) -> int:
        return sum([row[-1] for row in rows])

    def table(self, text: str) -> np.ndarray:
        """The count at every prefix, from the empty one on."""
        rows = self.rows_of(text)
        starts = accumulate((row[-1] for row in rows), initial=0)
        return np.concatenate([np.zeros(1, np.int64), *(np.frombuffer(row, np.uint8).astype(np.int64) + start if isinstance(row, bytes) else np.array(row) + start for row, start in zip(rows, starts, strict=False))])

    def longest_within(self, rows: list, limit: int) -> int:
        """Code points of the longest prefix of at most limit tokens."""
        ends = list(accumulate(row[-1] for row in rows))
        at = bisect_right(ends, limit)
        within = sum(map(len, rows[:at]))
        if at < len(rows):
            before, row = (ends[at - 1] if at else 0), rows[at]
            within += next((k for k in range(len(row), 0, -1) if before + row[k - 1] <= limit), 0)
        return within


def packed(counts: list[int]) -> bytes | tuple[int, ...]:
    return bytes(counts) if not counts or max(counts) < 256 else tuple(counts)


@lru_cache(maxsize=2)
def word_ids(name: str) -> WordIds:
    return WordIds(name)


@lru_cache(maxsize=2)
def prefix_counts(name: str) -> PrefixCounts:
    return PrefixCounts(name)
