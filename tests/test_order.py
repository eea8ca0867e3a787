"""Row order of sorted lists and limits that cut."""

import pytest
from pyspark.sql import functions as F

from corpusaudit import audit
from corpusaudit.operators import duplicates
from corpusaudit.plans import reports, rollups


@pytest.fixture(scope="module")
def done(spark):
    rows = [(f"f{i:03}.py", "\n".join(["eval(x)"] * (i % 5) + ["h = md5(x)"] * (i % 3) + ["a = 1", "b = 2", "c = 3", "d = 4", f"e = {i % 2}", "# TODO x"])) for i in range(150)]
    return audit(spark.createDataFrame(rows, "path string, content string").repartition(4)).checkpoint()


def ordered(rows, key):
    got = rows.collect()
    assert got == sorted(got, key=key) and len(got) > 1
    return got


def test_issue_lists_are_in_order(done):
    ordered(reports.sorted_by_file(done.issues), lambda r: (r["path"], r["line"], r["rule_ord"], r["message"]))
    levels = ["critical", "high", "medium", "low", "info"]
    ordered(reports.sorted_by_severity(done.issues), lambda r: (levels.index(r["severity"]), r["path"], r["line"], r["rule_ord"], r["message"]))


def test_file_lists_are_in_order(done):
    ordered(reports.file_list(done.profile), lambda r: (-r["issue_count"], r["path"]))
    top = ordered(rollups.top_files(done.profile, 10), lambda r: (-r["risk_score"], r["path"]))
    scores = sorted((r["score"] for r in done.profile.collect()), reverse=True)
    assert [r["risk_score"] for r in top] == scores[:10]


def test_ranked_blocks_are_in_order(done):
    got = ordered(duplicates.ranked(done.duplicates), lambda r: (-r["n_occ"], r["first_path"], r["first_line"], r["hash"]))
    assert duplicates.ranked(done.duplicates, 2).collect() == got[:2]


def test_search_cuts_in_order(done):
    every = reports.search_matches(done.issues, None, "EVAL")
    assert every.count() > 100
    want = sorted(every.collect(), key=lambda r: (r["path"], r["rule_ord"], r["line"], r["message"]))
    assert reports.search(done.issues, None, "EVAL", limit=100).collect() == want[:100]


def test_stored_audits_look_at_the_corpus_once(spark, done):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    counted = done.files.mapInPandas(count, "path string, content string")
    stored = audit(counted).checkpoint()
    first = seen.value
    assert first == 2 * done.files.count()  # all rules; the keys of all blocks
    assert stored.summary().count() and stored.by_rule().count() and stored.totals().count() and seen.value == first
    assert stored.profile.agg(F.sum("issue_count")).first()[0] == done.issues.count()
