"""Queries opN_<name>: each operator over its whole table, and DuckDB SQL where SQL can express the result."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import alignment, chat, decontam, html_template, merkle, mixing, near_dup, quality, secret_ledger, suffix_dedup, token_counts, token_files, url_filter
from llm.common import fresh_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of documents: counts and digest of the three base kinds, and all spans."""
    versions = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))
    found = secret_ledger.scan(versions, fresh_path(spark, "ledger"), paths=("doc_id",))
    base = [rule.kind for rule in secret_ledger.RULES[:3]]
    own = F.filter("findings", lambda f: f["kind"].isin(base))

    def count(kind: str) -> Column:
        return F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = map(count, base)
    return found.select("doc_id", *counts, F.sha2(secret_ledger.span_list(own), 256).alias("base_sha256"), secret_ledger.span_list(F.col("findings")).alias("spans"))


def op2_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return html_template.extract(table(spark, sf_dir, "pages"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations and conversation -7, read back from their formatted texts, offsets and masks."""
    given = table(spark, sf_dir, "conversations")
    said = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(F.lit(-7).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    template = chat.Template()
    formatted = chat.format_conversations(given.select("conv_id", "turn", "role", "text").unionByName(own), template)

    def read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, starts, ends, mask in zip(*(batch.column(c) for c in ("formatted", "starts", "ends", "mask")), strict=True):
                text = text.as_py()
                turns = template.read(text)
                learnt = "".join(chat.masked_texts(text, *(x.values.to_numpy() for x in (starts, ends, mask))))
                rows.append((len(turns), hashlib.sha256("".join(f"{role}\n{said}\n" for role, said in turns).encode()).hexdigest(),
                             len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), len(text), int(np.sum(mask.values.to_numpy()))))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            columns = [pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *columns], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "loss_tokens"])

    kind = dict(formatted.dtypes)["conv_id"]
    return formatted.mapInArrow(read_back, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, loss_tokens bigint")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the bytes of strings of 400 bytes that repeat."""
    found = suffix_dedup.remove(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
                        F.length("kept").cast("long").alias("n_kept"), (F.size("removed") > 0).alias("has_repeats"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that documents overlap."""
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents, from the tables of prefix counts."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents, on two-word shingles."""
    found = near_dup.groups(table(spark, sf_dir, "documents"), words=2)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents: words that it takes of each."""
    taken = mixing.copies(table(spark, sf_dir, "documents"))
    return taken.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = quality.judge(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return judged.select("row.doc_id", *quality.COUNTS, "base_failed", "kept", F.round("chance", 6).alias("chance"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' token ids, written to Arrow files and read back."""
    return token_files.read(token_files.write(table(spark, sf_dir, "documents"), fresh_path(spark, "tokens"))).drop("path")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of the tokens that two tokenizers give all documents."""
    return alignment.align(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A copy of all documents, in which half lost their line ends, held against the documents' manifest."""
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return merkle.audit(table(spark, sf_dir, "documents"), tampered)


#: Fixed values of the query: host, path, verdict.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages' urls judged by four rules; what no rule fits is allowed."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.write_rules(rules, fresh_path(spark, "rules")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_page_text": op2_page_text,
    "op3_chat_format": op3_chat_format,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_decontamination": op5_decontamination,
    "op6_token_counts": op6_token_counts,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_source_mix": op8_source_mix,
    "op9_quality_rules": op9_quality_rules,
    "op10_token_files": op10_token_files,
    "op11_token_alignment": op11_token_alignment,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_url_filter": op13_url_filter,
}


def _secret_sql() -> str:
    kinds = []
    for no, rule in enumerate(secret_ledger.RULES):
        pattern = rule.pattern.replace("'", "''")
        part = f"length(regexp_extract(matches[i], '{pattern}', {rule.part}))"
        kinds.append(f"""
  SELECT doc_id, {no} AS kind_no, '{rule.kind}' AS kind, ends[i] - length(matches[i]) AS s, ends[i] AS e
  FROM (SELECT doc_id, matches, [list_sum(steps[1:k]) FOR k IN range(1, len(steps) + 1)]::BIGINT[] AS ends, unnest(range(1, len(steps) + 1)) AS i
        FROM (SELECT doc_id, matches, [length(gaps[k]) + length(matches[k]) FOR k IN range(1, len(gaps) + 1)] AS steps
              FROM (SELECT doc_id, regexp_extract_all(text, '(?s)(.*?)({pattern}|\\z)', 1) AS gaps, regexp_extract_all(text, '(?s)(.*?)({pattern}|\\z)', 2) AS matches
                    FROM documents WHERE regexp_matches(text, '{pattern}'))))
  WHERE length(matches[i]) > 0 AND {part} >= {rule.least}""")
    return f"""
WITH found AS ({' UNION ALL '.join(kinds)}),
each AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS k, count(*) FILTER (kind = 'hex') AS h,
         coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, kind_no) FILTER (kind_no < 3), '') AS base,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, kind_no) AS spans
  FROM found GROUP BY doc_id)
SELECT d.doc_id, coalesce(a, 0) AS n_assign, coalesce(k, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN each USING (doc_id)"""


OP8_SQL = """
WITH own AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS s, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::BIGINT AS w FROM own GROUP BY source),
filled AS (SELECT *, row_number() OVER o AS k, sum(s) OVER () AS total, coalesce(sum(s) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_size,
                  sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS parts
           FROM sizes WINDOW o AS (ORDER BY s * 1.0 / w, source)),
-- the first source, by size for its weight, that its share of what the sources before leave doesn't fill
water AS (SELECT k, (150 * total - 200 * full_size) AS left_over, parts FROM filled
          WHERE (150 * total - 200 * full_size) * w <= s * 200 * parts ORDER BY k LIMIT 1),
targets AS (SELECT source, s, CASE WHEN f.k >= water.k THEN f.w::DOUBLE * left_over::DOUBLE / (100.0::DOUBLE * water.parts::DOUBLE) ELSE (s * 2)::DOUBLE END AS target FROM filled f, water),
placed AS (SELECT own.*, s AS source_size, target, row_number() OVER (PARTITION BY own.source ORDER BY size, md5(coalesce(doc_id::VARCHAR, ''))) - 1 AS place,
                  CASE WHEN s > 0 THEN target / s ELSE 0 END AS rate,
                  ('0x' || substr(md5('mix:' || coalesce('s' || own.source, 'n')), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS u
           FROM own JOIN targets ON own.source IS NOT DISTINCT FROM targets.source)
SELECT doc_id, size, source_size, target,
       ((floor(rate * (place::DOUBLE + 1.0::DOUBLE) + u) - floor(rate * place::DOUBLE + u)) * size)::BIGINT AS taken
FROM placed"""

def _url_sql() -> str:
    rules = ", ".join(f"('{host}', '{path}', '{verdict}')" for host, path, verdict in URL_RULES)
    return f"""
WITH rules(h, p, v) AS (VALUES {rules}),
rest AS (SELECT page_id, CASE WHEN contains(url, '://') THEN regexp_replace(substr(url, strpos(url, '://') + 3), '(?s)[?#].*', '') ELSE '' END AS r FROM pages),
parts AS (SELECT row_number() OVER () AS row_no, page_id, translate(CASE WHEN contains(r, '/') THEN substr(r, 1, strpos(r, '/') - 1) ELSE coalesce(r, '') END, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 CASE WHEN contains(r, '/') THEN substr(r, strpos(r, '/')) ELSE '' END AS path FROM rest),
best AS (SELECT row_no, arg_max(h || p, struct_pack(a := length(h || p), b := length(h))) AS rule, arg_max(v, struct_pack(a := length(h || p), b := length(h))) AS verdict
         FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY row_no)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN best USING (row_no)"""


def _merkle_sql(levels: int = 14) -> str:
    """With `levels` levels of each tree spelt out, enough for 3 ** levels documents of a source."""

    def leaf(text: str) -> str:
        fields = ("doc_id", "source", "lang", "n_chars", text)
        return "sha256(" + " || ".join(f"coalesce(strlen({f}::VARCHAR) || ':' || {f}::VARCHAR, '-')" for f in fields) + ")"

    def tree(name: str) -> str:
        """From {name}0 (g, pos, n, node) up; {name}_all holds each node with its level and its siblings on both sides."""
        steps = [f"""{name}{k + 1} AS MATERIALIZED (
  SELECT g, pos // 3 AS pos, (any_value(n) + 2) // 3 AS n, sha256(string_agg(node, '' ORDER BY pos)) AS node FROM {name}{k} WHERE n > 1 GROUP BY g, pos // 3)""" for k in range(levels)]
        run = "OVER (PARTITION BY level, g, pos // 3 ORDER BY pos ROWS BETWEEN"
        each = " UNION ALL ".join(f"SELECT {k} AS level, * FROM {name}{k}" for k in range(levels + 1))
        siblings = f"""{name}_all AS MATERIALIZED (
  SELECT *, coalesce(string_agg(node, '') {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(node, '') {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM ({each}))"""
        return ", ".join([*steps, siblings])

    def folded(name: str, start: str) -> str:
        """Folds `start` (g, pos, folded, proof and others) along {name}_all, level by level."""
        steps = [f"""{start}{k + 1} AS MATERIALIZED (
  SELECT s.* REPLACE (s.pos // 3 AS pos, CASE WHEN t.n > 1 THEN sha256(t.l || folded || t.r) ELSE folded END AS folded, CASE WHEN t.n > 1 THEN proof || t.l || t.r ELSE proof END AS proof)
  FROM {start}{k} s LEFT JOIN {name}_all t ON t.level = {k} AND t.g = s.g AND t.pos = s.pos)""" for k in range(levels)]
        return ", ".join(steps)

    # CRC-32 bit by bit; before its last step, which turns all bits round, an even one is odd
    bits = "flatten([[1000 + ord(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0] FOR c IN string_split(doc_id::VARCHAR, '')])"
    step = "CASE WHEN x > 0 THEN xor(a, x - 1000) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END"
    even = f"list_reduce(list_prepend(4294967295::BIGINT, {bits}), lambda a, x: {step}) % 2 = 1"
    return f"""
WITH sources AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS g FROM (SELECT DISTINCT source FROM documents)),
leaves AS MATERIALIZED (SELECT doc_id, g, {leaf('text')} AS leaf, CASE WHEN {even} THEN {leaf("replace(text, chr(10), '')")} ELSE {leaf('text')} END AS claimed
  FROM (SELECT d.*, g FROM documents d JOIN sources s ON d.source IS NOT DISTINCT FROM s.source)),
placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM leaves),
a0 AS MATERIALIZED (SELECT g, pos, n, leaf AS node FROM placed), {tree('a')},
subroots AS MATERIALIZED (SELECT g, node FROM a_all WHERE n = 1),
b0 AS MATERIALIZED (SELECT 0 AS g, g AS pos, (SELECT count(*) FROM sources) AS n, node FROM subroots), {tree('b')},
up0 AS (SELECT doc_id, g, pos, leaf, claimed AS folded, '' AS proof FROM placed), {folded('a', 'up')},
on0 AS (SELECT doc_id, g AS source_no, 0 AS g, g AS pos, leaf, folded, proof FROM up{levels}), {folded('b', 'on')},
top AS (SELECT node AS root FROM b_all WHERE n = 1)
SELECT f.doc_id, f.leaf, s.node AS subroot, top.root, sha256(f.proof) AS proof_sha256, f.folded AS folded_root, f.folded = top.root AS verified
FROM on{levels} f JOIN subroots s ON s.g = f.source_no, top"""


ORACLES: dict[str, str] = {
    "op1_secret_scan": _secret_sql(),
    "op8_source_mix": OP8_SQL,
    "op12_merkle_manifest": _merkle_sql(),
    "op13_url_filter": _url_sql(),
}
