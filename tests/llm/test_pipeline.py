import re
import time
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline
from corpusaudit.sinks.scratch import FREED
from llm.common import stored
from llm.tokens import WORD_BPE, load
from tests_llm_words import words


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    bench = [(k, words(900 + k, 30)) for k in range(5)]
    docs = []
    for k in range(120):
        text = words(k % 100, 100)
        if k >= 100:
            text += " tail"  # near copies of 0 to 19
        if k % 20 == 5:
            text = f"{text} {bench[k % 5][1]}"
        if k % 10 == 3:
            text = " ".join(w + "***" for w in text.split())
        docs.append((k, text, "en", f"s{k % 4}", len(text)))
    docs += [(200, None, None, None, None), (201, "short", "en", "s0", 5), (None, words(300, 90), "en", None, 1), docs[7]]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(bench, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(k, int(k % 10 != 3), 0) for k in range(60)], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, docs, bench


def test_stages_decide_as_expected(spark, folder):
    path, docs, bench = folder
    table = spark.read.parquet(f"{path}/documents.parquet")
    kept = [d for d in docs if d[1] and len(d[1].split()) >= 50 and "***" not in d[1]]
    good = corpus_pipeline.quality_rules(spark, table, path)
    assert good.dtypes == table.dtypes and Counter(r["doc_id"] for r in good.collect()) == Counter(d[0] for d in kept)
    shingles = [frozenset(zip(*(d[1].split()[j:] for j in range(5)), strict=False)) for d in kept]
    root = list(range(len(kept)))
    for i in range(len(kept)):
        for j in range(i):
            if 100 * len(shingles[i] & shingles[j]) >= 80 * len(shingles[i] | shingles[j]):
                root = [root[j] if r == root[i] else r for r in root]
    groups = {}
    for i, r in enumerate(root):
        groups.setdefault(r, []).append(kept[i][0])
    want = {min(g, key=lambda k: (k is None, k)) for g in groups.values()}
    single = corpus_pipeline.near_duplicates(spark, good, path)
    assert single.dtypes == table.dtypes and Counter(r["doc_id"] for r in single.collect()) == Counter(want)
    clean = corpus_pipeline.decontamination(spark, single, path)
    dirty = {d[0] for d in docs if any(item in (d[1] or "") for _, item in bench)}
    assert clean.dtypes == table.dtypes and {r["doc_id"] for r in clean.collect()} == want - dirty
    mixed = corpus_pipeline.source_mix(spark, clean, path)
    assert mixed.dtypes == table.dtypes and set(Counter(r["doc_id"] for r in mixed.collect()).values()) <= {1, 2}
    rows = mixed.collect()
    sizes = Counter()
    for r in clean.collect():
        sizes[r["source"]] += len(re.findall(r"\S+", r["text"]))
    assert abs(sum(len(r["text"].split()) for r in rows) - 1.5 * sum(sizes.values())) < 0.15 * sum(sizes.values())
    tokens = corpus_pipeline.token_output(spark, mixed, path).collect()
    library = load(WORD_BPE)
    expected = Counter()
    for r in rows:
        ids = np.array([*library.encode(r["text"], add_special_tokens=False).ids, 1], "<u4")
        expected[r["doc_id"], len(ids), zlib.crc32(ids.tobytes())] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in tokens) == expected


def test_run_applies_all_stages_to_whole_tables(spark, folder):
    rows = corpus_pipeline.run(spark, folder[0]).collect()
    assert len(corpus_pipeline.STAGES) == 5 and sum(r["n_tokens"] for r in rows) == max(r["start"] + r["n_tokens"] for r in rows)
    again = corpus_pipeline.run(spark, folder[0]).collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, again))


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_take_empty_and_odd_tables(spark, folder, odd, none, stage):
    f = dict(corpus_pipeline.STAGES)[stage]
    assert f(spark, none, folder[0]).count() == 0
    assert f(spark, odd, folder[0]).count() >= 0


def test_stored_tables_leave_no_shuffle_files(spark):
    folders = [str(folder) for folder in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]

    def shuffles():
        return {path for folder in folders for path in Path(folder).rglob("shuffle_*.data")}

    before, setting = shuffles(), spark.conf.get(FREED)
    table = spark.range(5000).repartition(3, "id").groupBy("id").count()
    kept = stored(table, "freed")
    for _ in range(50):
        if not shuffles() - before:
            break
        time.sleep(0.1)
    assert not shuffles() - before and spark.conf.get(FREED) == setting
    assert kept.count() == table.count() == 5000
