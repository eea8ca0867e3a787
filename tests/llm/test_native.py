import hashlib
import re
from collections import Counter, defaultdict
from math import floor

from pyspark.sql import functions as F

from llm import mixing, secret_ledger
from llm.common import fresh_path

BASE = {"assign": (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
        "access": (r"AKIA[A-Z0-9]+", 0, 20), "hex": (r"[0-9a-f]+", 0, 24)}


def base_spans(text):
    found = []
    for no, (kind, (pattern, part, least)) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text, re.IGNORECASE | re.ASCII if kind == "assign" else 0):
            if len(m.group(part)) >= least:
                found.append((m.start(), no, kind, m.end()))
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


def test_spans_equal_python(spark):
    texts = ["", "token=token: abcdefgh secret='x' passwd : \"hunter22\"", "é𝄞 token=abcdef12 " + "0123456789abcdef" * 3 + "g" + "a" * 23, "AKIA" + "A" * 16 + "AKIA" + "B" * 15 + " AKIAX",
             "api_key=" + "f" * 30 + " APIKEY : zzzzzz", "x" * 200_000 + " password=abcdefgh1 " + "y" * 200_000, "-----BEGIN RSA PRIVATE KEY----- ghp_" + "a1" * 18, "token = \n abcdefgh"]
    frame = spark.createDataFrame(list(enumerate(texts)), "path int, content string")
    got = {r["path"]: [(f["kind"], f["start"], f["end"]) for f in r["findings"]] for r in secret_ledger.scan(frame, fresh_path(spark, "ledger")).collect()}
    for k, text in enumerate(texts):
        assert [f for f in got[k] if f[0] in BASE] == base_spans(text), text[:80]
    assert {f[0] for f in got[6]} >= {"github", "private_key"}


def test_ledger_scans_only_what_is_missing(spark):
    ledger = fresh_path(spark, "ledger")
    first = spark.createDataFrame([("a", "token=abcdefgh"), ("b", "clean"), ("c", "token=abcdefgh")], "path string, content string")
    assert {r["path"]: len(r["findings"]) for r in secret_ledger.scan(first, ledger).collect()} == {"a": 1, "b": 0, "c": 1}
    assert secret_ledger.read_ledger(spark, ledger).count() == 2
    second = first.union(spark.createDataFrame([("a", "secret: qwertz12"), ("d", "clean")], "path string, content string"))
    assert secret_ledger.scan(second, ledger).count() == 5
    entries = secret_ledger.read_ledger(spark, ledger)
    assert entries.count() == 3 and entries.select("blob").distinct().count() == 3
    newer = (secret_ledger.Rule("hex", r"[0-9a-f]+", 4, version=2),)
    assert secret_ledger.scan(second, ledger, newer).count() == 5
    assert entries.sparkSession.read.schema(secret_ledger.LEDGER_SCHEMA).parquet(ledger).where(F.array_contains("rules", "hex@2")).count() == 3


def test_raised_version_in_a_full_set_replaces_the_old_findings(spark):
    ledger = fresh_path(spark, "ledger")
    frame = spark.createDataFrame([("a", "token=abcdefgh " + "0a" * 12), ("b", "deadbeef")], "path string, content string")

    def found(rules):
        return {r["path"]: [(f["kind"], f["start"], f["end"]) for f in r["findings"]] for r in secret_ledger.scan(frame, ledger, rules).collect()}

    old = {"a": [("assign", 0, 14), ("hex", 15, 39)], "b": []}
    assert found(secret_ledger.RULES) == old
    newer = tuple(secret_ledger.Rule("hex", "[0-9a-f]{12}", 8, version=2) if rule.kind == "hex" else rule for rule in secret_ledger.RULES)
    assert found(newer) == {"a": [("assign", 0, 14), ("hex", 15, 27), ("hex", 27, 39)], "b": []}
    assert found(secret_ledger.RULES) == old
    before = secret_ledger.LEDGER_SCHEMA.replace(",rule:string", "")
    earlier, ledger = secret_ledger.read_ledger(spark, ledger), fresh_path(spark, "ledger")
    spark.read.schema(before).json(earlier.toJSON()).write.parquet(ledger)  # as written without the rule of each finding
    assert found(newer)["a"] == [("assign", 0, 14), ("hex", 15, 27), ("hex", 27, 39)] and found(secret_ledger.RULES) == old


def test_secrets_of_odd_rows(spark, odd, none):
    own = odd.withColumn("content", F.col("text"))
    found = secret_ledger.scan(own, fresh_path(spark, "ledger"), paths=("doc_id",)).collect()
    assert len(found) == odd.count() and sum(len(r["findings"]) for r in found) == 3
    assert secret_ledger.scan(none.withColumn("content", F.col("text")), fresh_path(spark, "ledger"), paths=("doc_id",)).count() == 0


def expected_mix(rows, weights=(3, 1, 2)):
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight, total = {s: weights[k % 3] for k, s in enumerate(order)}, sum(sizes.values())
    target, full = {}, set()
    while True:
        left, parts = 1.5 * total - sum(2 * sizes[s] for s in full), sum(weight[s] for s in order if s not in full)
        target = {s: 2.0 * sizes[s] if s in full else left * weight[s] / parts for s in order}
        more = {s for s in order if target[s] > 2 * sizes[s]}
        if not more:
            return sizes, target
        full |= more


def test_mix_meets_targets_and_repeats_itself(spark):
    rows = [(k, " ".join(["w"] * (k % 17)), None if k % 13 == 0 else f"s{0 if k % 3 else k % 7}") for k in range(3000)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mixing.copies(frame).collect()
    sizes, target = expected_mix(rows)
    taken = Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - target[r["source"]]) < 1e-6 * max(1, r["target"])
        assert 0 <= r["copies"] <= 2
        taken[r["source"]] += r["copies"] * r["size"]
    for source, words in taken.items():
        assert abs(words - target[source]) <= 40
    again = mixing.copies(frame.repartition(7)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    mixed = mixing.mix(frame)
    assert mixed.columns == frame.columns and Counter(r["doc_id"] for r in mixed.collect()) == Counter({r["doc_id"]: r["copies"] for r in got if r["copies"]})


def test_mix_of_odd_rows(odd, none):
    got = mixing.copies(odd)
    assert got.count() == odd.count() and got.where("size = 0").agg(F.sum(F.col("copies") * F.col("size"))).first()[0] == 0
    mixed = mixing.mix(odd)
    assert mixed.dtypes == odd.dtypes and mixed.count() == got.agg(F.sum("copies")).first()[0]
    assert mixing.copies(none).count() == 0 and mixing.mix(none).count() == 0
