"""Physical plans: one scan, no text in a shuffle, one Python call."""

from pyspark.sql import functions as F

from corpusaudit.plans import detect, reports


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_issue_plan_is_one_narrow_stage(spark, tmp_path):
    spark.createDataFrame([("a.py", "x")], "path string, content string").write.parquet(str(tmp_path / "c"))
    text = plan(detect.issues(spark.read.parquet(str(tmp_path / "c"))))
    assert text.count("FileScan") == 1 and text.count("ArrowEvalPython") == 1
    assert "Exchange hashpartitioning" not in text and "BroadcastHashJoin" in text


def test_line_rule_needs_no_python(spark, tmp_path):
    spark.createDataFrame([("a.py", "x")], "path string, content string").write.parquet(str(tmp_path / "c"))
    assert "ArrowEvalPython" not in plan(detect.issues(spark.read.parquet(str(tmp_path / "c")), ["SEC001", "STY003"]))


def test_profile_shuffles_nothing(spark, tmp_path):
    spark.createDataFrame([("a.py", "x")], "path string, content string").write.parquet(str(tmp_path / "c"))
    text = plan(detect.profile(spark.read.parquet(str(tmp_path / "c"))))
    assert text.count("FileScan") == 1 and "Exchange" not in text and "Join" not in text


def test_a_path_is_filtered_below_detection(spark, tmp_path):
    from pyspark.sql import functions as F

    from corpusaudit import audit
    spark.createDataFrame([("a.py", "x"), ("b.py", "eval(x)")], "path string, content string").write.parquet(str(tmp_path / "c"))
    found = audit(spark.read.parquet(str(tmp_path / "c"))).of_file("b.py").issues
    lines = plan(found).splitlines()
    python = next(i for i, line in enumerate(lines) if "ArrowEvalPython" in line)
    assert any("Filter" in line and "b.py" in line for line in lines[python:]) and "PushedFilters: [IsNotNull(path), EqualTo(path,b.py)]" in plan(found)
    assert found.select(F.count_distinct("path")).first()[0] == 1


def test_groups_read_the_corpus_once(spark, tmp_path):
    """One aggregate with buffers of fixed width, over stored keys; the text is behind them."""
    from corpusaudit.operators import duplicates
    spark.createDataFrame([("a.py", "a\nb\nc\nd\ne\nf"), ("b.py", "a\nb\nc\nd\ne\nf")], "path string, content string").write.parquet(str(tmp_path / "c"))
    blocks = duplicates.Blocks(spark.read.parquet(str(tmp_path / "c")))
    text = plan(blocks.groups())
    assert "SortAggregate" not in text and "HashAggregate" in text and "content" not in text and str(tmp_path / "c") not in text
    places = plan(blocks.occurrences(blocks.groups()))
    assert "content" not in places and str(tmp_path / "c") not in places
    probe = places[places.index("BroadcastExchange"):]
    assert "bit_or" in probe and "HashedRelationBroadcastMode(List(input[0, bigint" in probe


def test_counts_are_conditions_above_detection(spark, tmp_path):
    """A condition on the issue count must not test the text once more in a filter below."""
    from corpusaudit.plans import reports
    spark.createDataFrame([("a.py", "x")], "path string, content string").write.parquet(str(tmp_path / "c"))
    frame = reports.top_issue_files(detect.profile(spark.read.parquet(str(tmp_path / "c"))))
    conditions = [line for line in frame._jdf.queryExecution().optimizedPlan().toString().splitlines() if " Filter " in f" {line.lstrip(':+- ')}"]
    assert conditions and not any("RLIKE" in line or "content" in line for line in conditions)


def small_tables(spark, folder):
    rows = [(i, f"name {i}", "Brand#1") for i in range(1, 41)]
    spark.createDataFrame(rows, "p_partkey bigint, p_name string, p_brand string").coalesce(1).write.parquet(f"{folder}/part.parquet")
    spark.createDataFrame([(i, "web", "password = 'hunter22'") for i in range(40)], "doc_id bigint, source string, text string") \
        .coalesce(1).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, "<p>x</p>")], "page_id bigint, html string").write.parquet(f"{folder}/pages.parquet")
    spark.createDataFrame([(1, 0, "x")], "conv_id bigint, turn bigint, text string").write.parquet(f"{folder}/conversations.parquet")
    return str(folder)


def test_a_table_of_one_row_group_keeps_all_cores_busy(spark, tmp_path):
    from pyspark.sql import functions as F

    from workload import queries
    folder = small_tables(spark, tmp_path)
    for table in (queries.code_files, queries.documents):
        files = table(spark, folder)
        assert files.count() == 40 and files.select(F.spark_partition_id().alias("p")).distinct().count() >= 4


def test_a_full_listing_of_files_sorts_a_stored_profile(spark, tmp_path):
    """A range-partitioned sort looks at its input twice."""
    from workload import queries
    frame = queries.QUERIES["q_files"](spark, small_tables(spark, tmp_path))
    assert "ArrowEvalPython" not in plan(frame) and "rangepartitioning" in plan(frame)
    assert frame.first()["issue_count"] > 0


def test_rules_of_structure_facts_cut_no_text_into_lines(spark, tmp_path):
    """And only files of their language reach the parse."""
    spark.createDataFrame([("a.py", "def aB(): pass\n"), ("b.md", "def aB(): pass\n")], "path string, content string").write.parquet(str(tmp_path / "c"))
    found = detect.issues(spark.read.parquet(str(tmp_path / "c")), ["STY004", "STY005"])
    lines = plan(found).splitlines()
    assert "posexplode" not in plan(found)
    python = next(i for i, line in enumerate(lines) if "ArrowEvalPython" in line)
    assert any("Filter" in line and "python" in line for line in lines[python:])
    assert sorted((r["path"], r["rule_id"], r["line"], r["snippet"]) for r in found.collect()) == [
        ("a.py", "STY004", 1, "def aB(...):"), ("a.py", "STY005", 1, "def aB(...):")]


def test_a_profile_looks_at_lines_only_for_rules_in_the_mask(spark, tmp_path):
    from corpusaudit.operators import line_rules
    from corpusaudit.operators.catalogue import RULES
    spark.createDataFrame([("a.py", "x = 1 \neval(x)\nif x == None: eval(y) \n" + "z" * 121)], "path string, content string").write.parquet(str(tmp_path / "c"))
    rows = detect.profile(spark.read.parquet(str(tmp_path / "c")))
    by_pattern = [r for r in line_rules.LINE_RULES if r not in line_rules.WHOLE_LINE_RULES]
    assert len(by_pattern) > 1 and plan(rows).count("zip_with(") >= len(by_pattern)
    for rule_id in by_pattern:
        assert line_rules.codes_of_file(RULES[rule_id], list(RULES), "maybe", "l", "f").startswith("IF((maybe & ")
    row = rows.first()
    assert (row["issue_count"], row["n_critical"], row["n_low"], row["n_info"]) == (6, 2, 1, 3)


def test_short_issues_keep_every_issue_and_order_without_a_rules_own_fields(spark, corpus):
    files = corpus({f"src/{i}.py": 'import os\nimport sys, json\ndef getName(a, b=[]):  \n    eval (a); password = "hunter22"\n'
                                   + "# TODO: " + "x" * 130 + "\ntry:\n    pass\nexcept:\n    pass" for i in range(5)})
    files = files.unionByName(files.where("path = 'src/1.py'").withColumn("content", F.lit("exec (x)\nmd5(x)\n")))
    whole = detect.issues(files)
    short = detect.short_issues(whole)
    assert not {"suggestion", "rule_id", "rule_name", "category", "confidence"} & set(short.columns)
    again = detect.in_full(short)
    assert again.schema.names == whole.schema.names
    assert sorted(map(repr, again.collect())) == sorted(map(repr, whole.collect()))
    assert {r["suggestion"] for r in again.where("rule_id = 'STY005'").collect()} == {"Rename to 'get_name'"}
    for order in (reports.sorted_by_file, reports.sorted_by_severity):
        fields = ["path", "line", "rule_id", "severity", "message", "snippet", "suggestion", "score"]
        assert detect.in_full(order(short)).select(fields).collect() == order(whole).select(fields).collect()
