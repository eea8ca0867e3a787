"""Directory trees, filters, decoding."""

import os
import random

import pyarrow.fs as pafs
import pytest

from corpusaudit import scan_path, scan_table
from corpusaudit.functions import text
from corpusaudit.sources import filters, tree, tree_source


@pytest.fixture
def project(tmp_path):
    root = tmp_path / "proj"
    files = {
        "main.py": b"x = 1\r\ny = 2\rz = 3\n", "pkg/__init__.py": b"", "pkg/_x.py": b"a", "pkg/.hidden.py": b"b",
        "latin.py": "é = 1".encode("latin-1"), "bom.py": b"\xef\xbb\xbfx = 1", "big.py": b"a" * 1048576, "bigger.py": b"a" * 1048577,
        "node_modules/x/index.js": b"x", ".git/config.py": b"x", "deep/.cache/x.py": b"x", "deep/build.py": b"x", "tests/t.py": b"x",
        "UPPER.PY": b"x", "notes.txt": b"x", ".py": b"x",
    }
    for name, content in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(content)
    return str(root)


def test_tree(spark, project):
    rows = {r["path"]: r["content"] for r in tree.read_tree(spark, project).collect()}
    assert set(rows) == {"main.py", "pkg/__init__.py", "pkg/_x.py", "pkg/.hidden.py", "latin.py", "bom.py", "big.py", "deep/build.py",
                         "tests/t.py", "UPPER.PY"}
    assert rows["main.py"] == "x = 1\ny = 2\nz = 3\n"
    assert rows["latin.py"] == "é = 1" and rows["bom.py"][0] == "\ufeff"


def test_tree_options(spark, project):
    def paths(**kw):
        return {r["path"] for r in tree.read_tree(spark, project, **kw).collect()}

    assert paths(extensions=[".txt"]) == {"notes.txt"}
    assert "tests/t.py" not in paths(exclude_patterns=["tests/"])
    assert paths(exclude_patterns=[os.path.dirname(project)]) == set()
    assert "node_modules/x/index.js" in paths(skip_dirs=["pkg"]) and "pkg/_x.py" not in paths(skip_dirs=["pkg"])
    assert "big.py" not in paths(max_size=100)
    assert tree.read_tree(spark, project, partition_bytes=1).rdd.getNumPartitions() > 3
    assert [r["path"] for r in tree.read_tree(spark, project + "/main.py").collect()] == ["main.py"]
    with pytest.raises(FileNotFoundError):
        tree.read_tree(spark, project + "/missing")


def test_trees_by_address_and_in_other_file_systems(spark, project):
    def rows(path, **kw):
        return sorted(map(tuple, tree.read_tree(spark, path, **kw).collect()))

    want = rows(project)
    assert rows(f"file://{project}") == want and rows(project + "/") == want
    parent, name = os.path.split(project)
    assert rows(f"/{name}", filesystem=pafs.SubTreeFileSystem(parent, pafs.LocalFileSystem())) == want
    os.symlink(parent, f"{project}/pkg/loop")
    assert rows(project) == want


def test_data_source_gives_the_tree(spark, project):
    frame = tree_source.scan(spark, project)
    want = {r["path"]: r["content"] for r in tree.read_tree(spark, project).collect()}
    assert {r["path"]: r["text"] for r in frame.selectExpr("path", f"{text.decode('content')} AS text").collect()} == want
    assert {r["path"] for r in tree_source.scan(spark, project, planned=1).collect()} == set(want)
    listed = tree_source.scan(spark, f"file://{project}", content=False, extensions=[".txt", ".js"], skip_dirs=["pkg"])
    assert {(r["path"], r["size"]) for r in listed.collect()} == {("notes.txt", 1), ("node_modules/x/index.js", 1)}
    sizes = {p: os.path.getsize(os.path.join(project, p)) for p in want}
    for given, fits in (({"paths": ["pkg/_x.py", "none.py"]}, lambda p, n: p == "pkg/_x.py"), ({"starts": "pkg/", "ends": "x.py"}, lambda p, n: p == "pkg/_x.py"), ({"most": 0}, lambda p, n: not n),
                        ({"least": 2, "most": 99, "ends": ("n.py", "m.py")}, lambda p, n: 2 <= n <= 99 and p.endswith(("n.py", "m.py"))), ({"paths": []}, lambda p, n: False), ({"starts": "p"}, lambda p, n: p[0] == "p")):
        selected = tree_source.scan(spark, project, **given)
        expected = {p for p, n in sizes.items() if fits(p, n)}
        assert {r["path"] for r in selected.collect()} == expected, given
        # a frame keeps its rows, whatever earlier queries on it asked for
        assert selected.where("size >= 1000").count() == sum(sizes[p] >= 1000 for p in expected) and selected.count() == len(expected)
    with pytest.raises(Exception, match="Folder not found"):
        tree_source.scan(spark, project + "/missing").collect()


def test_conditions_cut_the_listing(tmp_path):
    for a in range(4):
        for b in range(4):
            (tmp_path / f"a{a}/b{b}/c").mkdir(parents=True)
            (tmp_path / f"a{a}/b{b}/c/f.py").write_bytes(b"x" * (a * 4 + b))

    def listed(planned=1000, **given):
        reader = tree_source.TreeReader(str(tmp_path), tree.wanted_files(), tree_source.Selection(**given), False, planned)
        rows = [row for part in reader.partitions() for batch in reader.read(part) for row in batch.column("path").to_pylist()]
        return reader.listed, sorted(rows)

    one = frozenset(["a1/b2/c/f.py"])
    assert listed(paths=one) == listed(paths=one, planned=1) == (4, [*one])  # the root and one chain of folders
    assert listed(starts="a1/b")[0] == 1 + 1 + 4 + 4
    assert listed(paths=frozenset(["a0/b0/c/f.py", "a3/b3/c/f.py", "nowhere"])) == (7, ["a0/b0/c/f.py", "a3/b3/c/f.py"])
    assert listed(least=14) == (1 + 4 + 16 + 16, ["a3/b2/c/f.py", "a3/b3/c/f.py"])


def test_extension_equals_splitext(spark):
    rng = random.Random(7)
    paths = ["".join(rng.choice("ab./A_") for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    frame = spark.createDataFrame([(p,) for p in paths], "path string")
    for row in frame.selectExpr("path", f"{text.extension('path')} AS ext").collect():
        assert row["ext"] == os.path.splitext(row["path"])[1].lower(), row["path"]


def test_table_filters_agree_with_tree(spark, project, corpus):
    everything = {}
    for folder, _, names in os.walk(project):
        for name in names:
            full = os.path.join(folder, name)
            everything[os.path.relpath(full, project)] = "a" * os.path.getsize(full)
    kept = {r["path"] for r in filters.scannable(corpus(everything)).collect()}
    assert kept == {r["path"] for r in tree.read_tree(spark, project).collect()}
    kept = filters.scannable(corpus(everything), exclude_patterns=["proj/t"], root="/x/proj/")
    assert "tests/t.py" not in {r["path"] for r in kept.collect()}


def test_scan_of_an_empty_folder(spark, tmp_path):
    result = scan_path(spark, str(tmp_path))
    assert {r["issues"] for r in result.by_severity().collect()} == {0} and result.by_severity().count() == 5
    row = result.tech_debt().first()
    assert (row["quality_score"], row["grade"], row["risk_level"], row["formatted"]) == (100.0, "A", "low", "0h 0m")
    assert row["breakdown"]["files_scanned"] == 0 and row["total_code_lines"] == 0


def test_scan_table(corpus):
    result = scan_table(corpus({"src/a.py": "eval(x)", "node_modules/b.js": "eval(x)", "c.txt": "eval(x)"}))
    assert [r["path"] for r in result.issues.where("rule_id = 'SEC003'").collect()] == ["src/a.py"]
