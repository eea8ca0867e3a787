"""Main text of web pages by template deduction over the pages of a host.

Tokens of a page are its tags, each with the path of its ancestors, and its blocks of text, each with its path. Tokens of one
host whose numbers of occurrences agree on every page form an equivalence class. Classes on at least half of the host's
pages are parted where their tags stand inside tags of different classes, so that each lies in one other; thus nested, they
are the host's template. A block of text with the vector of such a class is a constant of the template. What is
left on a page are the slots. A step of a path is a tag with its class, id and role, without digits. On a page, paths are the
numbered nodes of a tree, so that depth costs nothing; a path's key, by which pages agree, is its text, of which all but the last
step becomes a hash where it gets long.

The article's slot is found in the template (of LEAST_PAGES pages or more): from the outside in, the container of a class with
one occurrence on a page that holds more than half of the slots' text, until the title stands beside it. An <article> or <main>
with a quarter of the text goes before it, and is not entered further. The main text is what the page has in that slot, without
its constants. Where the template shows no such slot, or the page lacks it, the tags decide: the page's article, or, without one,
anything. Elements of menus, footers, sidebars, forms, scripts and styles never count. Containers whose names say so don't
either, unless the template (in the slot) or the page (where no article is outside them) refutes it: they hold more than half of
the slots' text (all of it, for a whole name as in class="sidebar"), or the page's one article; reader comments never count. A page of which nothing but constants is left keeps them.

A host's vectors are kept as a count and a sum of hashes, so that classes come from two aggregations and no page is beside
another; a template has at most twice as many tokens as a page has on average.
"""

from __future__ import annotations

import html as html_module
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.common import stored

#: Text is a template's constant only where at least so many pages of a host were seen.
LEAST_PAGES = 5

#: A tag as most are. It reads over no other "<", so that a page is not read again from each of them.
TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9]*+)((?:\s++[a-zA-Z_:-]++(?:="[^"<]*+")?+)*+\s*+/?)>""")
SPECIAL = re.compile("[>\"']")
NAME_END = re.compile(r"[\s/>]")
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=\s|/|$)""", re.I)
NAME_PARTS = re.compile(r"[a-z]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
INLINE = frozenset("""a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong
sub sup time tt u var img wbr br nobr picture""".split())
#: Elements that hold no article text.
OTHER = frozenset("""head nav footer aside form script style noscript template svg math iframe select button textarea title object canvas dialog
menu audio video map input option""".split())
ARTICLE = ("article", "main")
#: Parts of a class, id or role that name such a container.
OTHER_NAMES = frozenset("""ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr
notice notices alert popup modal overlay newsletter subscribe subscription nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar
widget widgets footer header masthead comment comments commentlist disqus replies respond share sharing social related recommended pagination pager
login signup search toolbar contentinfo complementary""".split())
CLOSES_P = frozenset("""address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol
p pre section table ul""".split())
#: Names of reader comments, which may be longer than the article.
READERS = frozenset("comment comments commentlist disqus replies respond".split())
#: Elements that a template's article slot can be.
CONTAINERS = frozenset("html body div section article main table tbody tr td center".split())
CLOSES_SAME = frozenset("li dt dd tr td th option".split())
#: Longer texts of paths become a hash.
LONG_PATH = 300
#: Of a path, with those around it: names that mark a container, names of reader comments; an article around it.
MARKED, READERS_BIT, IN_ARTICLE = 1, 2, 4


class Tree:
    """The paths of a page as nodes: key, the node around it, the nearest one around it that isn't inline, flags."""

    def __init__(self) -> None:
        self.numbers: dict[str, int] = {"": 0}
        self.keys, self.parents, self.blocks, self.flags = [""], [-1], [-1], [0]

    def node(self, parent: int, name: str, names: list[str]) -> int:
        outer, step = self.keys[parent], ".".join((name, *names))
        key = f"{outer}/{step}"
        if len(key) > LONG_PATH and outer:
            key = f"#{xxhash.xxh3_128_hexdigest(outer)}/{step}"
        if (number := self.numbers.get(key)) is None:
            number = self.numbers[key] = len(self.keys)
            self.keys.append(key)
            self.parents.append(parent)
            step_name = self.keys[parent].rpartition("/")[2].partition(".")[0]
            self.blocks.append(self.blocks[parent] if step_name in INLINE else parent)
            article = IN_ARTICLE if step_name in ARTICLE else 0
            self.flags.append(self.flags[parent] | article | MARKED * _marked(name, names, None) | READERS_BIT * (not READERS.isdisjoint(names)))
        return number

    def inside(self, node: int) -> list[bool]:
        """For each node whether it is the given one or inside it."""
        found = [False] * len(self.keys)
        found[node] = True
        for k in range(node + 1, len(found)):
            found[k] = found[self.parents[k]]
        return found

    def around(self, node: int) -> set[int]:
        found = set()
        while node > 0:
            found.add(node)
            node = self.parents[node]
        return found


@dataclass(slots=True)
class Open:
    """An open element: its node, the node of the nearest one that isn't inline, whether it is inside a container that holds no
    article text, its article, the innermost container around it that names mark, and the places in the stack of the elements
    that a later tag may close unasked."""

    name: str
    node: int
    block: int
    other: bool
    article: int | None
    mark: int
    reach: dict[str, int]


@dataclass
class Page:
    """Blocks of text (node, text, inside another container, article, innermost mark), counts of the tags' nodes, for each
    mark the one around it, and for each article the innermost mark around it."""

    tree: Tree
    blocks: list[tuple[int, str, bool, int | None, int]]
    tags: Counter
    mark_above: dict[int, int]
    article_mark: dict[int, int]


def _other(name: str, attributes: str, inside: str | None) -> tuple[bool, list[str]]:
    """Whether an element holds no article text by its tag or as it is hidden, and its class, id and role. Headers inside an
    article are its own."""
    if name in OTHER or name == "header" and not inside:
        return True, []
    names: set[str] = set()
    if not attributes or name in ("html", "body"):
        return False, []
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            return True, []
        if key in ("class", "id", "role"):
            names.update("-".join(NAME_PARTS.findall(one)) for one in value.split())
    return False, sorted(names - {""})


def _marked(name: str, names: list[str], inside: str | None) -> bool:
    """Whether its names say that an element holds no article text."""
    if name in ARTICLE and not inside:
        return False  # an article's own names may say that it has comments or adverts
    found = {part for one in names for part in one.split("-")} & OTHER_NAMES
    return bool(found - {"header"} if inside else found)


def _step(path: str) -> tuple[str, list[str]]:
    """Tag and names of a path's last step."""
    name, *names = path.rpartition("/")[2].split(".")
    return name, names


def _plainly(path: str) -> bool:
    """Whether a whole name, as in class="sidebar", not a part, as in class="has-sidebar", says that it holds no article text."""
    return not OTHER_NAMES.isdisjoint(_step(path)[1])


class Ends:
    """Where tags end: at the next ">" that is not inside quotes. What one search has passed in vain, no other passes again."""

    def __init__(self, html: str):
        self.html, self.vain = html, set()
        self.seen = {SPECIAL: (0, -1), NAME_END: (0, -1)}

    def _next(self, pattern: re.Pattern, at: int) -> int:
        start, found = self.seen[pattern]
        if not start <= at <= found:
            match = pattern.search(self.html, at)
            found = match.start() if match else len(self.html)
            self.seen[pattern] = at, found
        return found

    def name(self, at: int) -> int:
        return self._next(NAME_END, at)

    def tag(self, at: int) -> int:
        """The place of the ">"; -1 without one."""
        passed, place = [], self._next(SPECIAL, at)
        while place < len(self.html) and place not in self.vain:
            mark = self.html[place]
            if mark == ">":
                return place
            passed.append(place)
            close = self.html.find(mark, place + 1)
            if close < 0:
                break
            match = SPECIAL.search(self.html, close + 1)
            place = match.start() if match else len(self.html)
        self.vain.update(passed)
        return -1


def read(html: str) -> Page:
    tree = Tree()
    blocks, tags, mark_above, article_mark = [], Counter(), {}, {}
    stack = [Open("", 0, 0, False, None, 0, {})]
    opened: Counter = Counter()
    text: list[str] = []

    def flush() -> None:
        if text:
            words = " ".join(html_module.unescape("".join(text)).split())
            if words:
                top = stack[-1]
                blocks.append((top.block, words, top.other, top.article, top.mark))
            text.clear()

    def close(to: int) -> None:
        around = stack[to - 1]
        if any(o.name not in INLINE or o.other != around.other or o.mark != around.mark for o in stack[to:]):
            flush()
        for o in stack[to:]:
            opened[o.name] -= 1
        del stack[to:]

    at, size, ends, no_end = 0, len(html), Ends(html), False
    while at < size:
        if html[at] != "<":
            start, at = at, html.find("<", at)
            at = size if at < 0 else at
            text.append(html[start:at])
            continue
        if match := TAG.match(html, at):
            closing, name, attributes = match.groups()
            at = match.end()
        else:
            first = html[at + 1 : at + 2]
            if first in ("!", "?") and first:
                if html.startswith("<!--", at):
                    end = html.find("-->", at + 4)
                    at = size if end < 0 else end + 3
                    continue
                end = -1 if no_end else html.find(">", at)
                if end >= 0:
                    at = end + 1
                    continue
                no_end = True
            closing = "/" if first == "/" else ""
            start = at + 1 + len(closing)
            end = -1
            if html[start : start + 1].isascii() and html[start : start + 1].isalpha():
                name_end = ends.name(start)
                end = -1 if no_end else ends.tag(name_end)
            if end < 0:
                text.append("<")
                at += 1
                continue
            name, attributes, at = html[start:name_end], html[name_end:end], end + 1
        name = name.lower()
        if closing:
            if opened[name] > 0:
                close(next(k for k in range(len(stack) - 1, 0, -1) if stack[k].name == name))
            elif name not in INLINE:
                flush()
            continue
        if name == "br":
            text.append(" ")
            continue
        reached = stack[-1].reach.get("p" if name in CLOSES_P else name) if name in CLOSES_P or name in CLOSES_SAME else None
        if reached is not None:
            close(reached)
        top = stack[-1]
        own_other, names = _other(name, attributes, top.article)
        other = top.other or own_other
        node = tree.node(top.node, name, names)
        mark = top.mark
        if _marked(name, names, top.article):
            mark_above[node], mark = top.mark, node
        if name not in INLINE or other != top.other or mark != top.mark:
            flush()
        if name not in INLINE:
            tags[node] += 1
        if name in VOID or attributes.rstrip().endswith("/") and name in ("svg", "path"):
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*[>/]", re.I).search(html, at)
            at = end.start() if end else size
            close_tag = html.find(">", at)
            at = close_tag + 1 if end and close_tag >= 0 else size
            continue
        article = top.article
        if article is None and name in ARTICLE:
            article = node
            article_mark[node] = top.mark
        reach = top.reach
        if name == "p" or name in CLOSES_SAME:
            reach = {**reach, name: len(stack)}
        elif name not in INLINE:
            reach = {}
        opened[name] += 1
        stack.append(Open(name, node, top.block if name in INLINE else node, other, article, mark, reach))
    flush()
    return Page(tree, blocks, tags, mark_above, article_mark)


def token_of(path: str, text: str) -> int:
    return int.from_bytes(xxhash.xxh3_64_digest(f"{path}\n{text}".encode()), "big", signed=True)


def host_of(url: Column) -> Column:
    return F.regexp_extract(F.lower(F.coalesce(url.cast("string"), F.lit(""))), r"^[a-z][a-z0-9+.\-]*://([^/?#:]*)", 1)


def page_tokens(html: str) -> Iterator[tuple[str, str | None, int, int, int, int]]:
    """path, above (the path of the tag around it; null for text), flags, token (0 for tags), count, chars of text in it."""
    page = read(html)
    tree, inside = page.tree, [0] * len(page.tree.keys)
    found: Counter = Counter()
    sizes: Counter = Counter()
    for node, text, other, *_ in page.blocks:
        token = token_of(tree.keys[node], text)
        found[node, token] += 1
        if not other:
            sizes[node, token] += len(text)
            inside[node] += len(text)
    for node in range(len(inside) - 1, 0, -1):  # what is inside comes later
        inside[tree.parents[node]] += inside[node]
    for (node, token), n in found.items():
        yield tree.keys[node], None, 0, token, n, sizes[node, token]
    for node, n in page.tags.items():
        yield tree.keys[node], tree.keys[tree.blocks[node]], tree.flags[node], 0, n, inside[node]


def _tokens(pages: DataFrame) -> DataFrame:
    """host, page (a hash of its row) and the columns of page_tokens."""
    kinds = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64())

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 100):
                rows, found = [], []
                for row, html in enumerate(batch.column(2).slice(start, 100), start):
                    found += page_tokens(html.as_py())
                    rows += [row] * (len(found) - len(rows))
                at = pa.array(rows, pa.int64())
                columns = [pa.array(column, kind) for column, kind in zip(zip(*found, strict=True) if found else [()] * 6, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *columns], ["host", "page", "path", "above", "flags", "token", "count", "chars"])

    return pages.select("host", "page", "html").mapInArrow(each, "host string, page bigint, path string, above string, flags int, token bigint, count bigint, chars bigint")


@dataclass(frozen=True)
class Template:
    """Tag paths with the number of their class and of the class around it (-1: none), hashes of constant blocks, the path of
    the article's slot (null: not found), and paths in it that count though their names say otherwise."""

    paths: list[str]
    classes: list[int]
    parents: list[int]
    constants: list[int]
    slot: str | None = None
    lifted: list[str] = field(default_factory=list)


def _slot(tokens: list[dict], constants: set[int], class_at: dict[str, int], parents: list[int]) -> tuple[str | None, list[str]]:
    """The container that holds the article on the host's pages, from the classes and the text that varies; and the containers
    in it whose mark by name the template refutes. class_at: in an order in which what is inside comes later."""
    tags = {t["path"]: t for t in tokens if not t["token"]}
    fixed = Counter()
    for t in tokens:
        if t["token"] in constants and t["path"] in tags:
            fixed[t["path"]] += t["chars"]
    for path in reversed(class_at):
        fixed[tags[path]["above"]] += fixed[path]
    chars = Counter({path: t["chars"] - fixed[path] for path, t in tags.items()})
    #: classes of which a page has one occurrence, as have all classes around them
    once: dict[int, bool] = {}
    for path, number in class_at.items():
        once.setdefault(number, tags[path]["n"] == tags[path]["pages"] and (parents[number] < 0 or once[parents[number]]))
    single = {path: None for path in class_at if once[class_at[path]] and _step(path)[0] in CONTAINERS and chars[path] > 0}
    inner: dict[str, list[str]] = {}
    for path in class_at:
        inner.setdefault(tags[path]["above"], []).append(path)

    def has(path: str, flag: int) -> bool:
        return bool(tags[path]["flags"] & flag)

    total = max((chars[path] for path in inner.get("", ())), default=0)
    articles = [path for path in single if _step(path)[0] in ARTICLE and not has(path, IN_ARTICLE) and not has(path, READERS_BIT)]
    plain = [path for path in articles if not has(path, MARKED)]
    named = [path for path in plain or articles if 4 * chars[path] >= total]
    around_plain = set()
    for path in plain:
        while path and path not in around_plain:
            around_plain.add(path)
            path = tags[path]["above"]
    at = max(named, key=lambda path: (chars[path], path)) if named else ""
    while not named:
        here = chars[at] if at else total
        child = next((path for path in inner.get(at, ()) if path in single and 2 * chars[path] > here), None)
        title = any(_step(path)[0] == "h1" and chars[path] > 0 for path in inner.get(at, ()))
        if child is None or title or _plainly(child) or plain and child not in around_plain and has(child, MARKED):
            break
        at = child
    if not at or _step(at)[0] in ("html", "body"):
        return None, []
    inside = {at}
    for path in class_at:
        if tags[path]["above"] in inside:
            inside.add(path)
    return at, [path for path in class_at if path != at and path in inside and 2 * chars[path] > chars[at] and _marked(*_step(path), at) and not _plainly(path)]


def deduce(tokens: list[dict], n_pages: int) -> Template:
    """tokens: path, above, flags, token, pages, vector, and n and chars (in all pages) of the tokens on at least half of a
    host's pages."""
    vectors = {t["path"]: (t["pages"], t["vector"]) for t in tokens if not t["token"]}
    above_of = {t["path"]: t["above"] for t in tokens if not t["token"]}
    inner: dict[str, list[str]] = {}
    for path, above in above_of.items():
        inner.setdefault(above, []).append(path)
    level, in_order = sorted(inner.get("", ())), []
    while level:
        in_order += level
        level = sorted(path for outer in level for path in inner.get(outer, ()))
    class_at: dict[str, int] = {}
    numbers: dict[tuple, int] = {}
    parents: list[int] = []
    for path in in_order:
        above = above_of[path]
        around = class_at.get(above, -1)
        if above and vectors[above] == vectors[path]:
            class_at[path] = around
            continue
        key = (vectors[path], around)
        if key not in numbers:
            numbers[key] = len(parents)
            parents.append(around)
        class_at[path] = numbers[key]
    shared = set(vectors.values())
    constants = sorted(t["token"] for t in tokens if t["token"] and (t["pages"], t["vector"]) in shared) if n_pages >= LEAST_PAGES else []
    slot, lifted = _slot(tokens, set(constants), class_at, parents) if n_pages >= LEAST_PAGES else (None, [])
    return Template(list(class_at), list(class_at.values()), [parents[c] for c in class_at.values()], constants, slot, lifted)


TEMPLATE = "paths array<string>, classes array<int>, parents array<int>, constants array<bigint>, lifted array<string>, slot string"


def templates(pages: DataFrame) -> DataFrame:
    """pages: host, page, html. Returns a row for each host: host, n_pages, and the template's columns."""
    vector = F.sum(F.xxhash64("page", "count").cast("decimal(20,0)")).alias("vector")
    tokens = _tokens(pages).groupBy("host", "path", "token").agg(F.count("*").alias("pages"), vector, F.sum("count").alias("n"), F.sum("chars").alias("chars"), F.max("above").alias("above"), F.max("flags").alias("flags"))
    hosts = pages.groupBy("host").agg(F.count("*").alias("n_pages"))
    often = tokens.join(hosts, "host").where(2 * F.col("pages") >= F.col("n_pages"))
    listed = often.groupBy("host", "n_pages").agg(F.collect_list(F.struct("path", "above", "flags", "token", "pages", "n", "chars", F.col("vector").cast("string").alias("vector"))).alias("tokens"))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [deduce(tokens, n) for n, tokens in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            lists = ((pa.string(), "paths"), (pa.int32(), "classes"), (pa.int32(), "parents"), (pa.int64(), "constants"), (pa.string(), "lifted"))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([getattr(t, name) for t in found], pa.list_(kind)) for kind, name in lists), pa.array([t.slot for t in found], pa.string())],
                                             ["host", "n_pages", *(name for _, name in lists), "slot"])

    return listed.mapInArrow(solve, f"host string, n_pages bigint, {TEMPLATE}")


def _lifted(page: Page, constants: set[int]) -> set[int]:
    """The marked containers on a page whose mark by name the page itself refutes."""
    if any(article is not None and not other and not mark for _, _, other, article, mark in page.blocks):
        return set()
    tree, several = page.tree, -1
    held, ones, total = Counter(), {}, 0
    for node, text, other, article, mark in page.blocks:
        if other or token_of(tree.keys[node], text) in constants:
            continue
        total += len(text)
        held[mark] += len(text)
        if article is not None and (outer := page.article_mark[article]):
            ones[outer] = article if ones.get(outer, article) == article else several
    for mark in sorted(page.mark_above, reverse=True):  # what is inside comes later
        above = page.mark_above[mark]
        held[above] += held[mark]
        if above and mark in ones:
            ones[above] = ones[mark] if ones.get(above, ones[mark]) == ones[mark] else several
    single = {mark for mark, article in ones.items() if article != several and page.tags[article] == 1}
    most = {mark for mark, size in held.items() if mark and size and (size == total or 2 * size > total and not _plainly(tree.keys[mark]))}
    return {mark for mark in most | single if not tree.flags[mark] & READERS_BIT}


def _all_in(page: Page, fits: set[int]) -> dict[int, bool]:
    """For each mark whether it and all marks around it are among those that fit."""
    found = {0: True}
    for mark in sorted(page.mark_above):
        found[mark] = mark in fits and found[page.mark_above[mark]]
    return found


def main_blocks(html: str, paths: list[str], constants: set[int], slot: str | None = None, lifted_inside: frozenset[str] = frozenset()) -> tuple[list[str], int]:
    """The main text's blocks in page order, and the number of the page's slots."""
    page = read(html)
    tree = page.tree
    constant = [token_of(tree.keys[node], text) in constants for node, text, *_ in page.blocks]
    slots = len(constant) - sum(constant)
    if slot and (at := tree.numbers.get(slot)) is not None:
        inside = tree.inside(at)
        fits = _all_in(page, tree.around(at) | {mark for mark in page.mark_above if tree.keys[mark] in lifted_inside})
        own = [(fixed, text) for fixed, (node, text, other, _, mark) in zip(constant, page.blocks, strict=True) if inside[node] and not other and fits[mark]]
        if own:
            return [text for fixed, text in own if not fixed] or [text for _, text in own], slots
    fits = _all_in(page, _lifted(page, constants))
    blocks = [(fixed, text, other or not fits[mark], article) for fixed, (_, text, other, article, mark) in zip(constant, page.blocks, strict=True)]
    own = {tree.keys[article] for _, _, other, article in blocks if article is not None and not other}
    region = next((p for p in paths if p in own), None) if own else None
    found, fixed = [], []
    for is_constant, text, other, article in blocks:
        if other or (own and article is None):
            continue
        if region and tree.keys[article] != region and _step(tree.keys[article])[0] != _step(region)[0]:
            continue
        (fixed if is_constant else found).append(text)
    return found or fixed, slots


def extract(pages: DataFrame) -> DataFrame:
    """pages: page_id, url, html; other columns are left aside. Returns a row for each: page_id, url, text, n_chars, n_slots.

    A null or empty html gives an empty text; html without tags is one block. Pages without a url form a host. Repeated rows
    are pages of their own. An empty table gives no rows. Unclosed and misplaced tags are read as browsers do, roughly."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    own = pages.select("page_id", "url", html.alias("html"), host_of(F.col("url")).alias("host"), F.xxhash64("page_id", "url", "html").alias("page"))
    found = stored(templates(own.select("host", "page", "html")), "templates")
    kinds = dict(own.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, slots = [], []
            last, constants, paths, slot, lifted = None, set(), [], None, frozenset()
            for html, own_paths, own_constants, own_slot, own_lifted, host in zip(*(batch.column(k) for k in range(2, 8)), strict=True):
                if host != last:
                    last, constants, paths, slot = host, set(own_constants.as_py() or ()), own_paths.as_py() or [], own_slot.as_py()
                    lifted = frozenset(own_lifted.as_py() or ())
                blocks, n = main_blocks(html.as_py(), paths, constants, slot, lifted)
                texts.append("\n".join(blocks))
                slots.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), pa.array(slots, pa.int64())], ["page_id", "url", "text", "n_chars", "n_slots"])

    joined = own.join(found, "host", "left").select("page_id", "url", "html", "paths", "constants", "slot", "lifted", "host")
    return joined.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint, n_slots bigint")
