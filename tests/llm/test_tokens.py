import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm import chat, token_counts, token_files
from llm.common import fresh_path
from llm.tokens import BYTE_BPE, WORD_BPE, load, prefix_counts, word_ids

PIECES = ["the ", "anre", "  ", "\n", "\n\n", "'s", "'ll", "'RE", "'", "é", "über ", "日本語", "🙂", "<|endoftext|>", "<|endof", "\t", "\xa0", "\x1c", "\x85", "123", " 45", "!!!", " ***", "b ",
          "=====", "Σ", "ς", "İ", "don't ", "<|startoftext|>", "é", "½"]


def texts(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 12))) for _ in range(n)]


def test_prefix_tables_equal_the_library():
    counts, library = prefix_counts(BYTE_BPE), load(BYTE_BPE)
    for text in texts(1, 400):
        want = [len(library.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)]
        assert counts.table(text).tolist() == want, text
        rows = counts.rows_of(text)
        assert counts.total(rows) == want[-1]
        for limit in (0, 3, 9):
            if want[-1] > limit:
                assert counts.longest_within(rows, limit) == max(k for k, n in enumerate(want) if n <= limit)


def test_token_counts(odd, none):
    library = load(BYTE_BPE)
    rows = token_counts.count_tokens(odd, prefixes=True).collect()
    assert len(rows) == odd.count()
    by_id = {r["doc_id"]: r["text"] or "" for r in odd.collect()}
    for r in rows:
        if r["doc_id"] is not None:
            text = by_id[r["doc_id"]]
            assert r["n_tokens"] == len(library.encode(text, add_special_tokens=False).ids) == r["prefix_counts"][-1]
            assert r["over_limit"] == (r["n_tokens"] > 512) and r["n_bytes"] == len(text.encode())
            assert len(library.encode(text[: r["n_chars_within"]], add_special_tokens=False).ids) <= 512
    assert token_counts.count_tokens(none).count() == 0


def test_word_ids_equal_the_library():
    ids, library = word_ids(WORD_BPE), load(WORD_BPE)
    own = texts(2, 1500)
    for text, raw in zip(own, ids.encode(own), strict=True):
        assert np.frombuffer(raw, ids.kind).tolist() == library.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("file_sequences", [token_files.FILE_SEQUENCES, 1, 7])
def test_token_files_round_trip(spark, odd, none, file_sequences):
    manifest = token_files.write(odd, fresh_path(spark, "tokens"), sequence=64, file_sequences=file_sequences)
    assert file_sequences > 7 or manifest.count() >= 9
    rows = sorted(token_files.read(manifest).collect(), key=lambda r: r["start"])
    library = load(WORD_BPE)
    given = sorted(((r["doc_id"], r["text"] or "") for r in odd.collect()), key=lambda r: (r[0] is not None, r[0], r[1]))
    assert [r["doc_id"] for r in rows] == [k for k, _ in given]
    start, run = 0, []
    for r, (_, text) in zip(rows, given, strict=True):
        ids = [*library.encode(text, add_special_tokens=False).ids, 1]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
        run += ids
    files = sorted(manifest.collect(), key=lambda r: (r["part"], r["number"]))
    back = []
    for file in files:
        for k in range(-(-file["n_tokens"] // 64)):
            ids, mask = token_files.sequence_at(file["path"], k)
            assert len(ids) == len(mask) == 64
            back += ids[mask == 1].tolist()
    assert back == run
    assert token_files.read(token_files.write(none, fresh_path(spark, "tokens"))).count() == 0


def test_rows_without_doc_id_are_dealt_out_by_text(spark):
    rows = [(None, f"{k % 97:03} text {k}") for k in range(2000)]
    manifest = token_files.write(spark.createDataFrame(rows, "doc_id bigint, text string"), fresh_path(spark, "tokens"))
    assert manifest.count() > 1 and manifest.agg({"n_documents": "sum"}).first()[0] == 2000
    library = load(WORD_BPE)
    want = [zlib.crc32(np.array([*library.encode(text, add_special_tokens=False).ids, 1], "<u4").tobytes()) for text in sorted(t for _, t in rows)]
    assert [r["ids_crc32"] for r in token_files.read(manifest).orderBy("start").collect()] == want


def test_few_files_are_made_beside_the_token_files(spark):
    """One file for the manifest; as many tasks, and so files of the caller's, as there are cores or full shares of tokens."""
    rows = [(k, f"some text {k}") for k in range(300)]
    manifest = token_files.write(spark.createDataFrame(rows, "doc_id bigint, text string"), fresh_path(spark, "tokens"), sequence=16, file_sequences=1)
    n_files, cores = manifest.count(), spark.sparkContext.defaultParallelism
    assert n_files > 2 * cores + 2 and len(manifest.inputFiles()) == 1
    each = manifest.agg({"n_tokens": "sum"}).first()[0] // (2 * cores)
    for share, tasks in ((token_files.TASK_TOKENS, [cores]), (each, [2 * cores, 2 * cores + 1]), (1, [n_files])):
        back = token_files.read(manifest, task_tokens=share)
        assert back.select(F.spark_partition_id()).distinct().count() in tasks
        assert sorted(r["doc_id"] for r in back.collect()) == list(range(300))


def conversation(spark, rows):
    return spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string, mask string, ids int")


def read_back(row, template):
    turns = template.read(row["formatted"])
    learnt = chat.masked_texts(row["formatted"], *(np.array(row[c]) for c in ("starts", "ends", "mask")))
    return turns, learnt


def test_chat_round_trip_and_masks(spark):
    template = chat.Template()
    said = ["<|turn|>", "<\\|end|>", "<\\\\|", "<", "", " leading", "trailing \n", "é🙂日本", None, "</s>[INST] ok [/INST]", "<<|text|>", "\\<|", "a" * 50_000]
    rng = random.Random(3)
    rows = []
    for conv in range(40):
        for turn in range(rng.randint(1, 6)):
            rows.append((conv if conv else None, turn, rng.choice(["user", "assistant", "system", None, "<|end|>"]), rng.choice(said), "x", 1))
    rows += [rows[5], rows[5]]
    frame = conversation(spark, rows)
    got = {r["conv_id"]: r for r in chat.format_conversations(frame).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted(((r[1], r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        turns, learnt = read_back(got[conv], template)
        assert turns == [(role, text) for _, role, text in own]
        assert learnt == [text for _, role, text in own if role == "assistant" and text]
        assert load(BYTE_BPE, template.marks).encode(got[conv]["formatted"], add_special_tokens=False).ids == got[conv]["ids"]
    assert chat.format_conversations(conversation(spark, [])).count() == 0


@pytest.mark.parametrize("text", ["", "<|", "<\\|", "<\\\\\\|x|>", "a<b|c", "<<||"])
def test_escape_is_reversible(text):
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
