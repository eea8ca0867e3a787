"""Secret scans over an incremental ledger of blobs. DataFrame functions only.

Every version of a text is addressed by the SHA-256 of its content. The ledger, a Parquet table in which runs only ever add
files, holds for each blob the rules (kind@version) that have been run on it and what each found, also when that is nothing.
A scan takes one row of each blob that lacks a rule, runs the missing rules on it, adds the findings to the ledger, and joins
the ledger back to all paths. A run that fails before its rows are committed leaves the ledger as it was.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from llm.common import stored

LEDGER_SCHEMA = "blob string, rules array<string>, findings array<struct<start:bigint,kind_no:int,kind:string,end:bigint,rule:string>>"


@dataclass(frozen=True)
class Rule:
    """pattern: what is searched, leftmost and without overlaps; a match counts if `part`, a group of it, has at least
    `least` characters. A change of either calls for a new version."""

    kind: str
    pattern: str
    least: int
    part: int = 0
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: The first three kinds and their order.
RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 1),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]+", 24),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 1),
)
#: The same matches as those of the rule that count, or more, found without visiting the short ones.
HINTS = {"access": r"AKIA[A-Z0-9]{16}", "hex": r"[0-9a-f]{24}", "github": r"gh[pousr]_[A-Za-z0-9]{36}"}


def blob_of(content: Column) -> Column:
    return F.sha2(F.coalesce(content.cast("string"), F.lit("")), 256)


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """The ledger's rows; none where nothing has been written yet."""
    try:
        return spark.read.schema(LEDGER_SCHEMA).parquet(ledger)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER_SCHEMA)


def _lengths(rule: Rule) -> Column:
    """For a text: an array of (characters before a match since the last one, the match's characters, those of its part).

    The end of the text counts as a match as well, so that the search never starts again behind the last one."""
    stepping = F.lit(rf"(?s)(.*?)({rule.pattern}|\z)")
    gaps, matches = F.regexp_extract_all("content", stepping, F.lit(1)), F.regexp_extract_all("content", stepping, F.lit(2))
    return F.zip_with(gaps, matches, lambda gap, match: F.struct(
        F.char_length(gap).cast("long").alias("gap"), F.char_length(match).cast("long").alias("match"),
        F.char_length(F.regexp_extract(match, rule.pattern, rule.part)).cast("long").alias("part")))


def find(texts: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """texts: blob, content, pending (the keys of rules to run). Returns a row for each blob with findings: blob, findings.

    Offsets count code points, the end excluded."""
    found = [F.when(F.array_contains("pending", rule.key) & F.col("content").rlike(HINTS.get(rule.kind, rule.pattern)), _lengths(rule))
             for rule in rules]
    kinds = F.array(*(F.struct(F.lit(no).alias("kind_no"), F.lit(rule.kind).alias("kind"), F.lit(rule.key).alias("rule"), F.lit(rule.least).alias("least"), own.alias("steps"))
                      for no, (rule, own) in enumerate(zip(rules, found, strict=True))))
    steps = texts.select("blob", F.explode(kinds).alias("of")).select("blob", "of.*").where("steps is not null")
    steps = steps.select("blob", "kind_no", "kind", "rule", "least", F.posexplode("steps").alias("no", "step"))
    steps = steps.dropDuplicates(["blob", "kind_no", "no"])  # where a path has the same text twice
    upto = Window.partitionBy("blob", "kind_no").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    ends = F.sum(F.col("step.gap") + F.col("step.match")).over(upto)
    spans = steps.select("blob", "kind_no", "kind", "rule", (ends - F.col("step.match")).alias("start"), ends.alias("end"),
                         ((F.col("step.match") > 0) & (F.col("step.part") >= F.col("least"))).alias("counts")).where("counts")
    return spans.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start", "kind_no", "kind", "end", "rule"))).alias("findings"))


def scan(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, paths: tuple[str, ...] = ("path",)) -> DataFrame:
    """versions: a row for each version of each path, with the columns `paths` and content; others are left aside. Adds to the
    ledger what is missing there. Returns for each row its paths, blob, findings (an array ordered by start, then kind).

    A null text is an empty one and has no findings. Repeated rows and equal texts under several paths are scanned once and
    each get the findings. An empty table leaves the ledger as it is."""
    spark = versions.sparkSession
    keys = F.array(*(F.lit(rule.key) for rule in rules))
    own = versions.select(F.struct(*paths).alias("path"), F.coalesce(F.col("content").cast("string"), F.lit("")).alias("content")).withColumn("blob", blob_of(F.col("content")))
    seen = read_ledger(spark, ledger).groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen"))
    one = own.groupBy("blob").agg(F.min(F.xxhash64("path")).alias("row"))
    pending = F.array_except(keys, F.coalesce("seen", F.array().cast("array<string>")))
    unseen = one.join(seen, "blob", "left").select("blob", "row", pending.alias("pending")).where(F.size("pending") > 0)
    texts = own.select("blob", F.xxhash64("path").alias("row"), "content").join(unseen, ["blob", "row"])
    found = find(texts, rules)
    entries = unseen.join(found, "blob", "left").select("blob", F.col("pending").alias("rules"), F.coalesce("findings", F.array().cast("array<struct<start:bigint,kind_no:int,kind:string,end:bigint,rule:string>>")).alias("findings"))
    entries.write.mode("append").parquet(ledger)

    def rule_of(finding: Column) -> Column:
        """Ledgers of before have no rule with a finding: it is the row's of that kind."""
        return F.coalesce(finding["rule"], F.get(F.filter("rules", lambda key: F.regexp_replace(key, "@[^@]*$", "") == finding["kind"]), F.lit(0)))

    of_rules = F.filter("findings", lambda f: F.array_contains(keys, rule_of(f)))
    wanted = F.transform(of_rules, lambda f: F.struct(*(f[c].alias(c) for c in ("start", "kind_no", "kind", "end"))))
    known = read_ledger(spark, ledger).where(F.arrays_overlap("rules", keys)).groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list(wanted))).alias("findings"))
    # stored, so that the paths of a blob that very many have can be dealt out to several tasks
    return own.select("path.*", "blob").join(stored(known, "findings"), "blob")


def span_list(findings: Column) -> Column:
    return F.array_join(F.transform(findings, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")
