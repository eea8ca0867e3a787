"""Statistics, duplicates, debt and reports on small corpora with known numbers, and brute-force comparisons."""

import glob
import hashlib
import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusaudit import FileRule, LineRule, audit
from corpusaudit.functions import linestats
from corpusaudit.operators import duplicates
from corpusaudit.plans import debt, detect, reports, rollups
from corpusaudit.sinks import writers


def python_classes(source):
    counts, quote = Counter(), ""
    for line in source.rstrip("\n").split("\n"):
        s = line.strip()
        if not s:
            counts["blank"] += 1
        elif s.startswith("#"):
            counts["comment"] += 1
        elif quote:
            counts["comment"] += 1
            quote = "" if quote in s else quote
        elif s[:3] in ('"""', "'''"):
            counts["comment"] += 1
            quote = "" if s.count(s[:3]) >= 2 else s[:3]
        else:
            counts["code"] += 1
    return counts


def block_classes(source):
    counts, inside = Counter(), False
    for line in source.rstrip("\n").split("\n"):
        s = line.strip()
        if not s:
            counts["blank"] += 1
        elif inside:
            counts["comment"] += 1
            inside = "*/" not in s
        elif s.startswith("/*"):
            counts["comment"] += 1
            inside = "*/" not in s[2:]
        else:
            counts["comment" if s.startswith("//") else "code"] += 1
    return counts


def test_line_classes_equal_a_plain_loop(spark):
    rng = random.Random(8)
    pieces = ['"""', "'''", '"', "#", "/*", "*/", "/", "//", "x", " ", "", "\t"]
    texts = ["\n".join("".join(rng.choice(pieces) for _ in range(rng.randint(0, 4))) for _ in range(rng.randint(1, 12))) for _ in range(1500)]
    frame = spark.createDataFrame([(lang, t) for t in texts for lang in ("python", "java", "sql")], "language string, content string")
    for row in frame.selectExpr("*", f"{linestats.line_classes('language', 'content')} AS k").collect():
        k = row["k"]
        if row["language"] == "sql":
            assert k["comment"] == 0
            continue
        want = (python_classes if row["language"] == "python" else block_classes)(row["content"])
        assert (k["blank"], k["comment"], k["code"]) == (want["blank"], want["comment"], want["code"]), row["content"]


def test_duplicates_equal_brute_force(spark, corpus):
    rng = random.Random(9)
    lines = ["a = 1", "b = 22", "}", "", "pass", "else:", "call()", "x  y"]
    files = {f"f{i}.py": "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 40))) for i in range(25)}
    norm = {"a = 1": "a = NUM", "b = 22": "b = NUM", "x  y": "x y"}
    places = {}
    for path, content in files.items():
        rows = [norm.get(line, line) for line in content.split("\n")]
        for i in range(len(rows) - 4):
            block = rows[i:i + 5]
            if sum(line not in ("", "{", "}", "else:", "pass") for line in block) >= 2:
                places.setdefault(hashlib.md5("\n".join(block).encode()).hexdigest(), []).append((path, i + 1))
    want = {h: p for h, p in places.items() if len(p) >= 2}
    frame = corpus(files)
    groups = duplicates.corpus_groups(frame)
    got = {r["hash"]: (r["n_occ"], r["first_path"], r["first_line"]) for r in groups.collect()}
    assert got == {h: (len(p), *min(p)) for h, p in want.items()} and want
    assert duplicates.count_groups(frame).first()[0] == len(want)
    flat = {(r["hash"], r["path"], r["start_line"]) for r in duplicates.occurrences(frame, groups).collect()}
    assert flat == {(h, *p) for h, ps in want.items() for p in ps}
    row = duplicates.statistics(groups, duplicates.occurrences(frame, groups)).first()
    assert tuple(row) == (len(want), sum(5 * len(p) for p in want.values()), len({p[0] for ps in want.values() for p in ps}))


def test_a_block_in_a_third_of_all_places_is_kept_whole(corpus):
    frame = corpus({f"f{i}.py": "a\nb\nc\nd\ne\nf" for i in range(20)} | {"g.py": "a\nb\nc\nd\ne"}
                   | {f"h{i}.py": f"v{i}\nw{i}\nx{i}\ny{i}\nz{i}" for i in range(20)})
    groups = duplicates.groups(frame)
    places = duplicates.occurrences(frame, groups)
    assert sorted(r["count"] for r in places.groupBy("hash").count().collect()) == [20, 21]
    assert places.distinct().count() == 41


def test_one_file_has_no_corpus_duplicates(corpus):
    frame = corpus({"a.py": "a\nb\nc\nd\ne\n" * 3})
    assert duplicates.corpus_groups(frame).count() == 0 and duplicates.groups(frame).count() > 0
    assert duplicates.count_groups(frame).first()[0] == 0


def totals_row(spark, code_lines=1000, worst=0, blocks=0, **severities):
    names = [*detect.SEVERITY_COUNTS.values(), *detect.CATEGORY_COUNTS.values()]
    counts = {f"n_{k}": v for k, v in severities.items()}
    row = {"path": "a", "code_lines": code_lines, "max_complexity": worst, "issue_count": sum(severities.values()),
           **{n: counts.get(n, 0) for n in names}}
    frame = spark.createDataFrame([tuple(row.values())], ", ".join(
        f"{k} {'string' if k == 'path' else 'bigint'}" for k in row))
    count = spark.range(1).select(F.lit(blocks).alias("duplicate_blocks"))
    return debt.totals(frame, count)


def test_debt(spark):
    def row(**kw):
        return debt.measures(totals_row(spark, **kw)).first()

    clean = row()
    assert (clean["quality_score"], clean["grade"], clean["risk_level"]) == (100.0, "A", "low")
    assert row(critical=1)["total_debt_minutes"] == 120 and row(critical=1)["risk_level"] == "critical"
    assert row(high=2)["total_debt_minutes"] == 120
    assert row(critical=4)["formatted"] == "1d 0h 0m" and row(critical=3)["formatted"] == "6h 0m"
    assert row(low=10)["issues_per_kloc"] == 10.0
    assert row(worst=13)["total_debt_minutes"] == 30 and row(blocks=2)["total_debt_minutes"] == 60
    assert row(high=4, code_lines=100_000)["risk_level"] == "high"
    assert row(info=9000)["quality_score"] == 10.0 and row(info=9000)["grade"] == "F"
    assert row(low=3)["total_debt_hours"] == round(15 / 60, 1)
    kinds = {r["kind"]: r["minutes"] for r in debt.debt_by_severity(totals_row(spark, low=2, blocks=1, worst=12)).collect()}
    assert kinds == {"critical": 0, "high": 0, "medium": 0, "low": 10, "info": 0, "complexity": 20, "duplicates": 30}


FILES = {
    "app/main.py": 'import os\npassword = "secret123"\n\n\ndef run(a):\n    eval(a)\n    return a == None\n',
    "app/clean.py": '"""Clean."""\n\n\ndef add(a, b):\n    """Add."""\n    return a + b\n',
    "web/site.js": "// TODO: x\nfunction go() {\n  var t = md5(x);\n}\n",
}


@pytest.fixture(scope="module")
def result(corpus):
    return audit(corpus(FILES)).checkpoint()


def test_profile_counts(result):
    rows = {r["path"]: r.asDict() for r in result.profile.collect()}
    assert {p: r["issue_count"] for p, r in rows.items()} == {"app/main.py": 5, "app/clean.py": 0, "web/site.js": 2}
    main = rows["app/main.py"]
    assert (main["n_critical"], main["n_low"], main["n_info"], main["n_security"]) == (2, 1, 2, 2)
    assert main["score"] == round(100 * 0.9 + 100 * 0.8 + 5 * 0.85 + 0.6 + 0.7, 6)
    assert (rows["web/site.js"]["functions"], rows["app/clean.py"]["comment_lines"]) == (1, 2)
    assert {r["path"]: r["issue_count"] for r in rollups.top_files(result.profile, 3).collect()} == {p: r["issue_count"] for p, r in rows.items()}


def test_profile_from_issue_rows_is_the_same(result, corpus):
    again = detect.profile_of(detect.file_statistics(corpus(FILES)), result.issues)
    assert sorted(map(tuple, again.select(*result.profile.columns).collect())) == sorted(map(tuple, result.profile.collect()))


def test_reports(result):
    assert {r["severity"]: r["issues"] for r in result.by_severity().collect()} == {"critical": 2, "high": 1, "medium": 0, "low": 1, "info": 3}
    assert {r["category"]: r["issues"] for r in result.by_category().collect()}["duplicate"] == 0
    assert result.totals().first()["files_with_issues"] == 2
    gate = reports.gate(result.issues, "critical").first()
    assert (gate["total_issues"], gate["failed"]) == (2, True)
    assert reports.gate(result.issues, no_fail=True).first()["failed"] is False
    assert [r["rule_id"] for r in reports.find_issues(result.issues, "critical", "app").collect()] == ["SEC001", "SEC003"]
    assert reports.search_count(result.issues, text="SITE").first()[0] == 2
    detail = reports.file_detail(result.profile, result.issues, "app/main.py").first()
    assert [i["rule_id"] for i in detail["issues"]] == ["SEC001", "SEC003", "BUG003", "BUG004", "STY004"]
    assert reports.file_detail(result.profile, result.issues, "app/clean.py").first()["issues"] == []
    assert reports.file_detail(result.profile, result.issues, "none.py").count() == 0
    summary = {(r["section"], r["position"]): r["label"] for r in result.summary().collect()}
    assert summary["severity", 1] == "critical" and summary["file", 1] == "app/main.py"
    assert {r["bucket"]: r["files"] for r in reports.complexity_histogram(result.profile).collect()} == {"1-5": 2, "6-10": 0, "11-20": 0, "20+": 0}


def test_min_severity_mixes_filtered_total_with_whole_counts(corpus):
    filtered = audit(corpus(FILES), min_severity="high")
    row = filtered.totals().first()
    assert (row["total_issues"], row["n_info"]) == (3, 3) and filtered.listed_issues().count() == 3


def test_sinks(result, spark, tmp_path):
    stored = result.write_tables(str(tmp_path / "tables"))
    assert stored.by_rule().count() == result.by_rule().count()
    assert tuple(stored.headline().first()) == tuple(result.headline().first())
    result.write_json(str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json/issues")).count() == 7
    assert spark.read.json(str(tmp_path / "json/tech_debt")).first()["grade"] == result.tech_debt().first()["grade"]
    result.write_issues_json(str(tmp_path / "slim"))
    assert set(spark.read.json(str(tmp_path / "slim/issues")).columns) == {"rule", "severity", "file", "line", "message"}


def test_json_report_leaves_nothing_but_compressed_rows(spark, corpus, tmp_path):
    def shared():
        return set(glob.glob(spark.conf.get("spark.checkpoint.dir") + "/*"))

    def contents(folder, name):
        return sorted(map(str, spark.read.json(str(tmp_path / folder / name)).collect()))

    repeated = "a = f(x)\nb = g(x)\nc = h(x)\nd = k(x)\ne = l(x)\n"
    files = corpus(FILES | {"clean.py": "", "r0.py": None} | {f"r{i}.py": f"v = {i}\n" * (i % 3) + repeated + "eval(x)\n" * 30 for i in range(1, 40)})
    loud = LineRule("USR001", "Loud", "style", "low", "Loud.", lambda line: F.when(line.contains("!"), F.struct(F.lit("loud").alias("message"))))
    blank = FileRule("USR002", "Any", "style", "low", "Any.", lambda path, content: [{"message": path, "line": 1}])
    kept, before = audit(files, [loud], [blank]).checkpoint(), shared()
    result = audit(files, [loud], [blank])
    schemas = result.write_json(str(tmp_path / "packed"), compression="gzip")
    assert shared() == before  # stored tables are gone
    result.write_json(str(tmp_path / "plain"))
    data = [p for p in (tmp_path / "packed").rglob("part-*")]
    assert data and all(p.name.endswith(".json.gz") for p in data)
    assert {p.name for p in (tmp_path / "packed").iterdir()} == set(schemas)
    for name in schemas:
        assert contents("packed", name) == contents("plain", name), name
    for name, table in (("issues", writers.full_issues(kept.issues)), ("files", writers.full_files(kept.profile)),
                        ("duplicates", kept.top_duplicates(10**6)), ("duplicate_places", kept.duplicate_places())):
        got = spark.read.schema(schemas[name]).json(str(tmp_path / "packed" / name))
        assert Counter(map(str, got.select(table.columns).collect())) == Counter(map(str, table.collect())), name
    size = {k: sum(p.stat().st_size for p in (tmp_path / k / "issues").rglob("part-*")) for k in ("packed", "plain")}
    assert size["packed"] < size["plain"] / 4
    places = result.duplicate_places()
    assert places.count() == kept.duplicate_places().count()
    stored = result.blocks.by_file.inputFiles()  # asked for: these stay for further questions
    result.write_json(str(tmp_path / "again"))
    assert result.blocks.by_file.inputFiles() == stored and places.count() == kept.duplicate_places().count()


def test_places_of_few_and_many_keys_and_lines_of_any_files(spark, corpus, monkeypatch):
    """Keys that are sent as they are, and a filter with or without room for them, give the same places."""
    drawn = random.Random(4)
    files = corpus({f"f{i}.py": "\n".join(drawn.choice("abcdef") for _ in range(drawn.randrange(40))) for i in range(30)} | {"none.py": None})
    blocks = duplicates.Blocks(files)
    groups = duplicates.scratch.stored(blocks.groups(), "groups")
    want = Counter(map(tuple, blocks.occurrences(groups, sent=10**6).collect()))
    assert "word" not in blocks.occurrences(groups, sent=10**6)._jdf.queryExecution().toString()
    assert Counter(map(tuple, blocks.occurrences(groups).collect())) == want
    monkeypatch.setattr(duplicates, "FILTER_WORDS", 1)
    assert Counter(map(tuple, blocks.occurrences(groups).collect())) == want
    whole = {r["hash"]: list(r["lines"]) for r in duplicates.with_lines(files, groups).collect()}
    cut = duplicates.first_files(files, groups)
    assert cut.columns == files.columns
    assert {r["hash"]: list(r["lines"]) for r in duplicates.with_lines(cut, groups).collect()} == whole
    assert len(whole) == groups.count() and all(hashlib.md5("\n".join(v).encode()).hexdigest() == k for k, v in whole.items())
    none = groups.where("hash IS NULL")
    assert duplicates.first_files(files, none).count() <= files.count() and duplicates.with_lines(files, none).count() == 0


def test_versions_outlive_a_refresh_and_a_failure(spark, corpus, tmp_path, monkeypatch):
    folder = str(tmp_path / "tables")
    with pytest.raises(FileNotFoundError):
        writers.read_tables(spark, folder)
    audit(corpus(FILES)).write_tables(folder)
    old = writers.read_tables(spark, folder)["issues"]
    write = writers.Version.write

    def failing(self, name, table):
        assert old.count() == 7 and writers.read_tables(spark, folder)["issues"].count() == 7  # during a refresh
        if name == "profile":
            raise RuntimeError("lost")
        return write(self, name, table)

    monkeypatch.setattr(writers.Version, "write", failing)
    with pytest.raises(RuntimeError):
        audit(corpus(FILES | {"more.py": "eval(x)"})).write_tables(folder)
    assert old.count() == 7 and writers.read_tables(spark, folder)["issues"].count() == 7
    monkeypatch.undo()
    audit(corpus(FILES | {"more.py": "eval(x)"})).write_tables(folder)
    assert old.count() == 7 and writers.read_tables(spark, folder)["issues"].count() == 8
    assert [r["version"] for r in writers.versions(spark, folder).orderBy("version").collect()] == [1, 2]
    assert writers.read_tables(spark, folder, version=1)["issues"].count() == 7


def test_document_holds_what_the_rows_hold(spark, corpus, tmp_path):
    repeated = "a = f(x)\nb = g(x)\nc = h(x)\nd = k(x)\ne = l(x)\n"
    result = audit(corpus(FILES | {"r1.py": repeated + "eval(x)\n", "r2.py": "\n" + repeated})).checkpoint()
    result.write_document(str(tmp_path / "doc"), elapsed=1.23456)
    lines = [line for file in (tmp_path / "doc").glob("part-*") for line in file.read_text().splitlines()]
    assert len(lines) == 1
    doc = json.loads(lines[0])
    assert list(doc) == ["target", "summary", "issues_by_severity", "issues_by_category", "issues_by_rule", "tech_debt", "languages", "files", "issues", "duplicates"]
    head = result.headline().first()
    assert doc["summary"] == {k: head[k] for k in ("files_scanned", "files_with_issues", "total_issues")} | {"scan_time_seconds": 1.235}
    for name, table in (("severity", result.by_severity()), ("category", result.by_category()), ("rule", result.by_rule())):
        assert doc[f"issues_by_{name}"] == {r[0]: r[1] for r in table.collect()}
    assert doc["languages"] == {r[0]: r[1] for r in result.languages().collect()}
    assert doc["tech_debt"] == result.tech_debt().first().asDict(True)
    assert doc["files"] == {r["path"]: {k: v for k, v in r.asDict().items() if k != "path"} for r in writers.full_files(result.profile).collect()}
    want = [r.asDict() for r in writers.full_issues(result.issues.orderBy(*reports.ISSUE_ORDER)).collect()]
    assert [(i["file"], i["rule_id"], i["line"]) for i in doc["issues"]] == [(i["file"], i["rule_id"], i["line"]) for i in want]
    assert sorted(map(str, doc["issues"])) == sorted(map(str, want))
    places = {}
    for r in result.duplicate_places().collect():
        places.setdefault(r["hash"], []).append({"path": r["path"], "line": r["start_line"]})
    blocks = {r["hash"]: r for r in result.top_duplicates(10).collect()}
    assert doc["duplicates"] and {d["hash"] for d in doc["duplicates"]} == set(blocks)
    for d in doc["duplicates"]:
        assert (d["lines"], d["line_count"]) == (blocks[d["hash"]]["lines"], 5) and d["occurrences"] == sorted(places[d["hash"]], key=lambda p: (p["path"], p["line"]))
    with pytest.raises(ValueError):
        result.document(most=3)


def test_duplicate_debt_needs_two_files(corpus):
    repeated = "a\nb\nc\nd\ne\n" * 3
    assert audit(corpus({"a.py": repeated})).totals().first()["duplicate_blocks"] == 0
    assert audit(corpus({"a.py": repeated, "b.py": "x"})).totals().first()["duplicate_blocks"] > 0
