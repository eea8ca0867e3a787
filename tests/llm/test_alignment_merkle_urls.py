import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm import alignment, merkle, url_filter
from llm.common import fresh_path

PIECES = ["the ", "hello", "  ", "\n", "é", "é", "日本語", "🙂", "<s>", "<0x41>", "<|endoftext|>", "\t", "\xa0", "123", " 45", "!!!", "don't ", "unbelievable ", "\x00", "▁"]


def plain_alignment(texts):
    """Groups and links text by text, from the bytes of every token."""
    a, b = alignment.tokens_of(alignment.BYTE_BPE), alignment.tokens_of(alignment.PIECE_BPE)
    rows, pairs = [], Counter()
    for text in texts:
        ids_a, ids_b = a.encode([text or ""])[0], b.encode([text or ""])[0]
        want = (" " + (text or "")).encode()
        if not text or b"".join(a.bytes[k] for k in ids_a) != want or b"".join(b.bytes[k] for k in ids_b) != want:
            rows.append((0, 0, [], []))
            continue
        ends_a, ends_b = ({}, {})
        for ids, ends, of in ((ids_a, ends_a, a), (ids_b, ends_b, b)):
            reached = 0
            for place, k in enumerate(ids):
                reached += len(of.bytes[k])
                ends[reached] = place
        cuts = sorted(ends_a.keys() & ends_b.keys())
        groups, links, i, j = [], [], 0, 0
        for cut in cuts:
            groups.append(",".join(map(str, ids_a[i : ends_a[cut] + 1])) + "|" + ",".join(map(str, ids_b[j : ends_b[cut] + 1])))
            links.append((ids_a[ends_a[cut]], ids_b[ends_b[cut]]))
            i, j = ends_a[cut] + 1, ends_b[cut] + 1
        pairs.update(links)
        rows.append((len(ids_a), len(ids_b), groups, links))
    most = {}
    for (_, of_b), n in pairs.items():
        most[of_b] = max(most.get(of_b, 0), n)
    return [(n_a, n_b, len(groups), len(links), sum(pairs[p] == most[p[1]] for p in links), sum(pairs[p] for p in links),
             hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "") for n_a, n_b, groups, links in rows]


def of_row(r):
    return (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"])


@pytest.mark.parametrize("most", [alignment.CHUNK_LINKS, 40])
def test_alignment_equals_token_by_token(spark, monkeypatch, most):
    monkeypatch.setattr(alignment, "CHUNK_LINKS", most)
    rng = random.Random(7)
    texts = [None, "", " ", "a ", " a", "\n", "x" * 30_000, *("".join(rng.choice(PIECES) for _ in range(rng.randint(1, 40))) for _ in range(300))]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    got = {r["doc_id"]: of_row(r) for r in alignment.align(frame).collect()}
    assert [got[k] for k in range(len(texts))] == plain_alignment(texts)


def test_overlaps_expand_within_groups():
    got = alignment.align_texts(["unbelievable 日本語 hello", "", "don't"], alignment.both_ids(alignment.BYTE_BPE, alignment.PIECE_BPE), links="overlaps")
    expected = [(i, j) for i in range(len(got.a.ids)) for j in range(len(got.b.ids)) if got.a.starts[i] < got.b.ends[j] and got.b.starts[j] < got.a.ends[i]]
    assert list(zip(got.link_a.tolist(), got.link_b.tolist(), strict=True)) == expected
    assert (got.groups_a[got.link_a] == got.groups_b[got.link_b]).all()
    bounds = np.append(0, got.a.ends)
    assert set(np.unique(got.groups_a)) == set(np.unique(got.groups_b)) and len(np.unique(got.groups_a)) == len(np.intersect1d(bounds, np.append(0, got.b.ends))) - 1


def test_ids_by_word_equal_the_libraries():
    rng = random.Random(11)
    pieces = ["the", "hello", "\n", "é", "日本語", "🙂", "<s>", "<0x41>", "<|endoftext|>", "\t", "\xa0", "123", "45", "!!!", "don't", "'ll", "unbelievable", "\x00", "▁", ".", ",", "\x85", "\u2003", "\x1c", "a\tb", "\nx"]
    texts = [rng.choice([" ", " ", " ", "\n", "  "]).join(rng.choice(pieces) + rng.choice(["", "", ".", "s"]) for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    ids = alignment.BothIds(alignment.tokens_of(alignment.BYTE_BPE), alignment.tokens_of(alignment.PIECE_BPE))
    assert ids.a.by_word and ids.b.by_word
    ids.words.most = 500
    regular = 0
    for start in range(0, 3000, 100):
        own = texts[start : start + 100]
        assert ids.encode(own) == ids._whole(own)
        regular += sum(text.replace("\n", " ") == " ".join(text.split()) for text in own)
    assert regular > 300


def test_alignment_of_odd_rows(odd, none):
    got = alignment.align(odd).collect()
    texts = {r["doc_id"]: r["text"] for r in odd.collect() if r["doc_id"] is not None}
    assert len(got) == odd.count()
    assert all(r["n_a"] == 0 and r["groups_sha256"] == "" for r in got if r["doc_id"] in (4, 5))
    given = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert Counter((k, *row) for (k, _), row in zip(given, plain_alignment([t for _, t in given]), strict=True)) == Counter((r["doc_id"], *of_row(r)) for r in got)
    assert texts and alignment.align(none).count() == 0


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def written(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def levels_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][k : k + 3])) for k in range(0, len(levels[-1]), 3)])
    return levels


def path_of(levels, place):
    found = []
    for level in levels[:-1]:
        first = place // 3 * 3
        found.append(("".join(level[first:place]), "".join(level[place + 1 : first + 3])))
        place //= 3
    return found


def plain_audit(rows, change):
    leaf = lambda r, text: sha("".join(written(r[c]) for c in merkle.FIELDS[:-1]) + written(text))
    sources = sorted({r["source"] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    of = {s: sorted((r for r in rows if r["source"] == s), key=lambda r: (r["doc_id"] is not None, r["doc_id"], leaf(r, r["text"]))) for s in sources}
    trees = {s: levels_of([leaf(r, r["text"]) for r in of[s]]) for s in sources}
    top = levels_of([trees[s][-1][0] for s in sources])
    for n, s in enumerate(sources):
        for k, r in enumerate(of[s]):
            path = path_of(trees[s], k) + path_of(top, n)
            folded = leaf(r, change(r["text"]))
            for left, right in path:
                folded = sha(left + folded + right)
            yield (r["doc_id"], leaf(r, r["text"]), trees[s][-1][0], top[-1][0], sha("".join(a + b for a, b in path)), folded, folded == top[-1][0])


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_proofs_equal_whole_trees(spark, monkeypatch, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "BLOCK", 3**levels)
    rng = random.Random(levels)
    sizes = {None: 4, "a": 1, "é": 2, "z": 28, "hot": 250, "🙂": 3, "": 27, "b": 82}
    rows = [(rng.randint(0, 10**6), f"x\n{k}" if k % 3 else None if k % 2 else "", None if k % 5 else "en", s, k if k % 7 else None) for s, n in sizes.items() for k in range(n)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    change = lambda text: text and text.replace("\n", "")
    got = merkle.audit(frame, F.replace("text", F.lit("\n"), F.lit(""))).collect()
    assert Counter(map(tuple, got)) == Counter(plain_audit(frame.collect(), change))
    assert {r["verified"] for r in got} == {True, False}


def test_merkle_of_odd_rows(odd, none):
    got = merkle.audit(odd, F.col("text")).collect()
    assert Counter(map(tuple, got)) == Counter(plain_audit(odd.collect(), lambda text: text)) and all(r["verified"] for r in got)
    assert merkle.audit(none, F.col("text")).count() == 0 and merkle.manifest(none).root().count() == 0


def test_merkle_discards_its_tables(spark, odd):
    made = merkle.manifest(odd)
    assert made.root().count() == 1 and merkle.proofs(made).count() == odd.count()
    made.discard()


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("whole.org", "", "block"), ("a.b.org", None, "allow"),
         ("org", "/fr/", "block"), ("", "/x", "block"), (None, "/x", "block"), ("none.org", "/", None), ("example.net", "/en/long/path", "block")]
URLS = [None, "", "http", "http://", "://net/", "http://NET/", "http://net", "https://x.example.net/en/1?net/", "https://example.net/en", "https://example.net/en/long/path/x", "https://badexample.com/de/",
        "https://m.example.com/de/#x", "https://m.example.com/fr/?x", "ftp://é.ORG/fr/é", "http://İ.org/fr/", "http://a..org/fr/", "http://.org/fr/", "http://net.org:80/fr/", "x://whole.org", "x://y.whole.org?q",
        "http://c.a.b.org/anything", "http://a?b/c", "http://a#b/c", "http://net/?://net/", "\nhttp://net/\n", "http://none.org/fr/"]


def plain_verdict(rules, url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.partition("://")[2].partition("?")[0].partition("#")[0]
    host, slash, path = rest.partition("/")
    host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in host), slash + path
    fitting = [(len(h + p), len(h), h + p, v) for (h, p), v in rules.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fitting)[2:] if fitting else (None, "allow"))


@pytest.mark.parametrize("entries", [url_filter.FILE_ENTRIES, 2])
def test_url_verdicts_equal_all_rules_tried(spark, monkeypatch, entries):
    monkeypatch.setattr(url_filter, "FILE_ENTRIES", entries)
    one = {}
    for host, path, verdict in RULES:
        if host and verdict:
            one[host, path or ""] = max(verdict, one.get((host, path or ""), ""))
    rng = random.Random(5)
    rng_urls = ["http://" + ".".join(rng.choice(["a", "b", "net", "example", "org", "com", "whole"]) for _ in range(rng.randint(1, 4))) + rng.choice(["", "/", "/en/", "/en/long/path", "/de/", "/fr/x", "?q", "#f"]) for _ in range(500)]
    files = url_filter.write_rules(spark.createDataFrame([(*r, "extra") for r in RULES], "host string, path string, verdict string, key string"), fresh_path(spark, "rules"))
    pages = spark.createDataFrame([(k, url, "r", "h") for k, url in enumerate(URLS + rng_urls)], "page_id bigint, url string, rule string, host string").repartition(3)
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages, files).collect()}
    assert [got[k] for k in range(len(got))] == [plain_verdict(one, url) for url in URLS + rng_urls]


def test_digests_that_collide_are_confirmed_by_text(spark, monkeypatch):
    rules = spark.createDataFrame(RULES[:4], "host string, path string, verdict string")
    files = [tuple(r)[:3] for r in url_filter.write_rules(rules, fresh_path(spark, "rules")).collect()]
    array = url_filter.DigestArray(files)
    digest = url_filter.xxhash.xxh64_intdigest
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda text, seed: digest("net/" if text == "other/" else text, seed))
    assert array.find(["net/", "other/", "example.net/en/"], "verdict") == ["block", None, "allow"]


def test_urls_without_rules_or_rows(spark):
    pages = spark.createDataFrame([(1, "http://net/"), (1, "http://net/"), (None, None)], "page_id int, url string")
    nothing = url_filter.write_rules(spark.createDataFrame([], "host string, path string, verdict string"), fresh_path(spark, "rules"))
    assert [(r["rule"], r["verdict"]) for r in url_filter.judge(pages, nothing).collect()] == [(None, "allow")] * 3
    assert url_filter.judge(pages.where("false"), nothing).count() == 0
