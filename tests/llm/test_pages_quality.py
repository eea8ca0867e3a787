import re
import time
from collections import Counter

import numpy as np
import pytest

from llm import boosting, html_template, quality
from tests_llm_words import words

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><a href="/">Site</a></header>
<nav><ul><li><a href="/x>y">Menu</a></ul></nav><div class="cookie-notice">We use cookies</div><aside>Side</aside>
<article><h1>Title &amp; more</h1><p>First <b>bold</b>&nbsp;text<br>goes   on<p>Second&lt;p&gt; <a href='#'>link</a>.</p><div class="ad">Buy</div>
<script>if (a < b) "</p>"</script><ul><li>one<li>two</ul><form>Name <input></form></article>
<section id="comments"><article><p>Nice!</p></article></section><footer>&copy; me</footer></body></html>"""


def test_main_text():
    blocks, _ = html_template.main_blocks(PAGE, [], set())
    assert blocks == ["Title & more", "First bold text goes on", "Second<p> link.", "one", "two"]
    assert html_template.main_blocks("plain  text", [], set())[0] == ["plain text"]
    assert html_template.main_blocks("<p>open <b>tags<p>never closed <!-- x", [], set())[0] == ["open tags", "never closed"]
    assert html_template.main_blocks("<article>a<script>x", [], set())[0] == ["a"]


def test_classes_nest_and_constants_are_found(spark):
    page = "<html><body><div><div>Our site since 1999</div><div id='c'><p>{}</p></div><div>Terms apply</div></div></body></html>"
    rows = [(k, "http://h.example/%d" % k, page.format(words(k, 30))) for k in range(6)] + [(9, "http://other.example/", page.format("alone"))]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_template.extract(frame).collect()}
    assert all(got[k] == words(k, 30) for k in range(6))
    assert got[9] == "Our site since 1999\nalone\nTerms apply"  # one page tells no template
    tokens = [{"path": p, "above": p.rpartition("/")[0], "flags": 0, "token": 0, "pages": 4, "vector": v} for p, v in (("/html", "1"), ("/html/body", "1"), ("/html/body/div", "2"), ("/html/body/div/p", "3"), ("/html/body/p", "3"))]
    template = html_template.deduce(tokens, 4)
    assert template.paths == ["/html", "/html/body", "/html/body/div", "/html/body/p", "/html/body/div/p"]
    assert template.classes == [0, 0, 1, 2, 3] and template.parents == [-1, -1, 0, 0, 1]


def test_an_article_shared_by_all_pages_stays(spark):
    rows = [(k, f"http://h.example/{k}", "<body><nav>Menu</nav><article><p>The same text</p></article></body>") for k in range(5)]
    assert {r["text"] for r in html_template.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()} == {"The same text"}


def texts_of(spark, pages):
    rows = [(k, f"http://h.example/{k}", html) for k, html in enumerate(pages)]
    return [r["text"] for r in sorted(html_template.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect())]


def test_template_finds_the_slot(spark):
    teasers = "<html><body><div class='top'>Site</div><div class='story'><h1>{0}</h1><div class='text'><p>{1}</p><p>{2}</p></div></div><div class='more'><article>{3}</article><article>{4}</article></div></body></html>"
    each = [[words(10 * k + j, n) for j, n in enumerate((4, 60, 50, 5, 6))] for k in range(6)]
    assert texts_of(spark, [teasers.format(*w) for w in each]) == ["\n".join(w[:3]) for w in each]
    fixed = "<html><body><div>{3}</div><article><h1>{0}</h1><p>Written by our staff</p><p>{1}</p></article></body></html>"
    assert texts_of(spark, [fixed.format(*w) for w in each]) == ["\n".join(w[:2]) for w in each]


@pytest.mark.parametrize("name", ["has-sidebar", "no-comments", "with-banner", "search-page", "related-work", "widget"])
def test_names_around_an_article_do_not_drop_it(spark, name):
    outer = f"<body><nav>Menu</nav><div class='{name}'><div id='{name}-2'><article><h1>Title</h1><p>{{}}</p><div class='ad'>Buy</div></article></div></div><div class='ad'>{{}}</div><p>&copy;</p></body>"
    assert html_template.main_blocks(outer.format("Text", words(1, 50)), [], set())[0] == ["Title", "Text"]
    plain = f"<body><nav>Menu</nav><div class='has-{name}'><p>{{}}</p><div class='ad'>Buy</div></div></body>"
    assert html_template.main_blocks(plain.format("A longer text"), [], set())[0] == ["A longer text"]
    inside = f"<body><article><h1>{{}}</h1><div class='has-{name}'><p>{{}}</p></div><div class='ad'>{{}}</div></article></body>"
    each = [[words(10 * k + j, n) for j, n in enumerate((4, 60, 9))] for k in range(6)]
    assert texts_of(spark, [inside.format(*w) for w in each]) == ["\n".join(w[:2]) for w in each]


def test_longer_comments_and_sidebars_stay_out():
    for name in ("comments", "sidebar"):
        page = f"<body><div class='content'>Short</div><div class='{name}'><p>{words(1, 90)}</p></div></body>"
        assert html_template.main_blocks(page, [], set())[0] == ["Short"]


def test_odd_pages(spark):
    schema = "page_id bigint, url string, html string, host string, page int, text string, paths string"
    rows = [(1, None, "<p>x</p>", "a", 1, "t", "p"), (1, None, "<p>x</p>", "a", 1, "t", "p"), (2, "nonsense", None, None, None, None, None), (None, "http://a/", "", None, None, None, None),
            (3, "http://a/", "<article>" + "<p>word</p>" * 20_000, None, None, None, None), (4, "http://a/b", "<<>><a <b </p></div>&#0;&bad;", None, None, None, None)]
    got = html_template.extract(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 6 and {r["n_chars"] for r in got if r["page_id"] == 3} == {5 * 20_000 - 1} and [r["text"] for r in got if r["page_id"] == 1] == ["x", "x"]
    assert html_template.extract(spark.createDataFrame([], schema)).count() == 0


@pytest.mark.parametrize("hidden", ["hidden", "aria-hidden='true'", 'style="color: red; display : none"', "HIDDEN=hidden class=x"])
def test_hidden_elements_hold_no_text(spark, hidden):
    page = f"<body><article><p>Seen {{}}</p><p {hidden}>Not <b>seen</b></p><div {hidden}><p>Nor this</p></div></article></body>"
    assert html_template.main_blocks(page.format(1), [], set())[0] == ["Seen 1"]
    assert texts_of(spark, [page.format(words(k, 20)) for k in range(6)]) == [f"Seen {words(k, 20)}" for k in range(6)]


HOSTILE = {"open tags": "<a " * 350_000, "open quotes": '<a "' * 250_000, "mixed quotes": "<a '\"<b \"'" * 80_000, "names": "<a" * 500_000, "declarations": "<!x" * 300_000, "depth": "<div>" * 50_000 + "end",
           "unknown ends": "<div>" * 50_000 + "</x>" * 50_000, "nested marks": "<div class=ad>" * 50_000 + "x", "inline": "<b>" * 50_000 + "x<hr>" * 50_000, "reach": "<p><object>" + "<b>" * 40_000 + "<p></p>" * 40_000,
           "articles in marks": "<div class=ad><article>x</article>" * 20_000, "items": "<li><b>" * 50_000, "long class": "<div class='" + "ab " * 300_000 + "'>x", "blanks": "<a" + " " * 1_000_000 + "b"}


@pytest.mark.parametrize("name", HOSTILE)
def test_hostile_pages_take_no_time(name):
    began = time.process_time()
    html_template.main_blocks(HOSTILE[name], [], set())
    tokens = list(html_template.page_tokens(HOSTILE[name]))
    assert time.process_time() - began < 10 and all(len(path) < 1_000_000 for path, *_ in tokens)


def test_no_text_is_lost_at_depth():
    found, _ = html_template.main_blocks("<div>" * 3000 + "a" + "<p>b</p>" + "</div>" * 3000 + "c", [], set())
    assert found == ["a", "b", "c"]


def test_templates_equal_whole_vectors(spark, monkeypatch):
    """Classes, constants and slots from the counts on every page themselves, instead of sums of hashes."""
    rng = np.random.default_rng(2)
    parts = ["<div class='menu'><a>Home</a><a>About</a></div>", "<div class='box'><p>Written by us</p><p>{0}</p></div>", "<div><h1>{1}</h1><div class='t'><p>{2}</p><p>{3}</p></div></div>", "<ul><li>{4}<li>{5}</ul>", "<p>Terms</p>"]
    pages = ["<html><body>" + "".join(parts[k].format(*(words(int(rng.integers(10**6)), int(rng.integers(2, 40))) for _ in range(6))) for k in (*np.flatnonzero(rng.random(5) < 0.9),)) + "</body></html>" for _ in range(9)]
    counts: dict = {}
    for number, html in enumerate(pages):
        for path, above, flags, token, n, chars in html_template.page_tokens(html):
            row = counts.setdefault((path, token), {"path": path, "above": above, "flags": flags, "token": token, "vector": [0] * len(pages), "n": 0, "chars": 0})
            row["vector"][number] += n
            row["n"] += n
            row["chars"] += chars
    often = [row | {"pages": sum(map(bool, row["vector"])), "vector": tuple(row["vector"])} for row in counts.values() if 2 * sum(map(bool, row["vector"])) >= len(pages)]
    want = html_template.deduce(often, len(pages))
    frame = spark.createDataFrame([("h", k, html) for k, html in enumerate(pages)], "host string, page bigint, html string").repartition(3)
    got = html_template.templates(frame).first()
    assert len(want.paths) > 6 and want.constants and want.slot
    assert all(got[c] == getattr(want, c) for c in ("paths", "classes", "parents", "constants", "lifted", "slot"))


def brute_counts(text):
    own = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    windows = list(zip(own, own[1:], own[2:], strict=False))
    often = Counter(windows)
    marked = {k + j for k, w in enumerate(windows) if often[w] > 1 for j in range(3)}
    return len(own), sum(map(len, own)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(marked)


@pytest.mark.parametrize("text", ["", " \n", "a b c a b c", "a a a a", "x\ny\nx\n x\n\n\nx", "é# |é\x1c<b>\x85 c", words(1, 500) + "\n" + words(1, 200)])
def test_counts_equal_brute_force(text):
    assert quality.statistics(text)[0] == brute_counts(text)


def test_boosting_learns_and_keeps_its_constraints():
    rng = np.random.default_rng(2)
    rows = rng.random((3000, 3))
    labels = (rows[:, 0] + 0.3 * np.sin(8 * rows[:, 1]) < 0.6) ^ (rng.random(3000) < 0.05)
    forest = boosting.fit(rows[:2000], labels[:2000], [-1, 0, 0])
    assert ((forest.score(rows[2000:]) > 0) == labels[2000:]).mean() > 0.88  # held out; 0.95 at most
    probe = np.repeat(rng.random((50, 3)), 40, axis=0)
    probe[:, 0] = np.tile(np.linspace(0, 1, 40), 50)
    assert (np.diff(forest.score(probe).reshape(50, 40), axis=1) <= 1e-12).all()
    for one_kind in (np.zeros(5, bool), np.ones(5, bool), np.zeros(0, bool)):
        assert len(boosting.fit(rows[: len(one_kind)], one_kind, [0, 0, 0]).roots) == 0


def test_verdicts(spark, odd, none):
    good = [(k, words(k, 120), 1) for k in range(60)]
    bad = [(100 + k, " ".join(w + "***" for w in words(k, 120).split()), 0) for k in range(60)]
    docs = spark.createDataFrame([(k, t) for k, t, _ in good + bad], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, q, None) for k, _, q in good[:40] + bad[:40]] + [(None, 1, 1), (5, None, 0), (7777, 0, 0)], "doc_id bigint, quality int, toxic int")
    forest = quality.fit(docs, labels)
    judged = {r["row"]["doc_id"]: r["kept"] for r in quality.judge(docs, forest).collect()}
    assert sum(judged[k] != (q == 1) for k, _, q in good + bad) <= 2  # a third of each was held out
    rows = quality.judge(odd, forest).collect()
    assert len(rows) == odd.count() and all(r["base_failed"] and not r["kept"] for r in rows if r["n_words"] < 50)
    kept = quality.keep_good(odd, labels)
    assert kept.dtypes == odd.dtypes
    assert quality.keep_good(none, labels).count() == 0
    assert quality.keep_good(docs, labels.where("false")).count() == 120
