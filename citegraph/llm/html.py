"""Main text of web pages by minimum-cut labelling.

A page becomes a row of text blocks. A classifier gives each block a cost of being content and a cost of being
boilerplate, from its element, the names of classes and ids around it, link density, length and punctuation: these are
the capacities to the two terminals. Neighbours in page order, and blocks that are close in the tree, are tied by
smoothness edges. A maximum flow saturates the cheapest cut, and the blocks on the source's side are the main text. So a
short line inside an article stays, though alone it looks like boilerplate, and a lone sentence among links goes.

What no reader sees or nobody wrote as the article (scripts, styles, forms, menus, page headers and footers, sidebars,
notices, adverts, reader comments) has a cost that no tie outweighs. Forms, and blocks that only their names give away, are
so unless they wrap the article: pages stand in one form, or in a "wrapper right-sidebar".

Defined results: a null or empty page has an empty text, and so has a page without content blocks. Unclosed and stray tags
are read as browsers do, as far as blocks go; a text cut off inside a tag ends there. Repeated rows keep a row each;
only id, url and html are read.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citegraph.llm.common import ship, table, task

BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg iframe object select button head annotation annotation-xml canvas audio video noembed noframes xmp".split())
#: Elements and names whose blocks are never content.
NEVER = frozenset("nav header footer aside form menu dialog search".split())
#: A class or id is bad as a whole, or by one of its parts between hyphens if no other part could mean an article's part.
BAD_NAME = re.compile(
    r"ads?|advert\w*|adsense|\w*banner|sponsor\w*|promo\w*|menu\w*|nav\w*|breadcrumbs?|header|masthead|footer|foot|sidebar\w*|side|widgets?|"
    r"cookies?|consent|gdpr|notices?|alerts?|popup|modal|newsletter|subscribe|signup|login|share|sharing|social|related|recommended|recommendations|"
    r"comments?|commentlist|disqus\w*|replies|reply|respond|copyright|legal|disclaimer|skip|pagination|pager|toolbar|tags?|tagcloud|meta|postmeta"
)
BAD_PART = re.compile(
    r"ads?|advert\w*|adsense|banner|sponsor\w*|promo|menu|nav|navbar|navigation|breadcrumbs?|footer|sidebar|widget|cookies?|consent|gdpr|popup|modal|newsletter|"
    r"signup|login|sharing|social|comments?|disqus|pagination|pager|toolbar"
)
#: Parts that are bad in company of these alone.
BAD_PAIR = re.compile(r"(?:site|page|top|main|global)-(?:header|head)|(?:related|recommended)-(?:posts?|articles?|links?|content|stories|news|items|reading)|share-\w+|(?:legal|copy\w*)-(?:notice|info|links|text)|\w*-?notice|skip-\w+|(?:post|entry|article)-(?:meta|tags)|alert-\w+")
#: What a name says an element has or lacks is not what it is: has-sidebar, layout--no-sidebar.
MODIFIER = re.compile(r"(?:^|(?<=[-_\s]))(?:has|no|with|without)[-_]\S*")
GOOD_NAME = re.compile(r"(?:^|[-_\s])(?:article\w*|content|main|post|entry|story|text|body|prose)(?=$|[-_\s\d])")
BAD_ROLE = frozenset("navigation banner contentinfo complementary search form menu menubar alert dialog alertdialog".split())
#: The tie of neighbours in page order, that of blocks in one element, and the cost of what is never content.
NEAR, TREE, NEVER_COST = 0.9, 0.7, 1e6
#: Words of a block of prose; how many such blocks, and what share of prose outside others, a wrapper of a bad name holds.
PROSE_WORDS, WRAPPED_PARAGRAPHS, WRAPPED_SHARE = 10, 3, 0.8

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: One attribute, as browsers read it: quotes end a value only where they began it.
_ATTRIBUTE = re.compile(r"[\s/]*(=?[^\s/>=]*)(?:\s*(=)\s*(?:\"([^\"]*)(\"?)|'([^']*)('?)|([^\s>\"'][^\s>]*)?))?")
_SPACE = re.compile(r"\s+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Block:
    """A run of text inside one block element; parent: the number of the block element around that."""

    __slots__ = ("parts", "parent", "links", "good", "never", "marks", "tag", "text")

    def __init__(self, parent: int, tag: str, good: bool, never: bool, marks: tuple[int, ...]):
        self.parts, self.parent, self.links, self.tag, self.good, self.never, self.marks, self.text = [], parent, 0, tag, good, never, marks, ""


class Open(NamedTuple):
    """An open element: its number, whether its text is in a named content element, whether it is never content, whether
    it is in an article, the place on the stack of the nearest block element, itself included, and the numbers of the
    forms and of the elements of a bad name around it."""

    tag: str
    number: int
    good: bool
    never: bool
    inside: bool
    block: int
    marks: tuple[int, ...]


def _attributes(html: str, at: int) -> tuple[dict[str, str], int]:
    """The attributes from at on, and the place after the tag: the end of the page if the tag has none."""
    found: dict[str, str] = {}
    while True:
        m = _ATTRIBUTE.match(html, at)
        name, value = m[1].lower(), m[3] if m[3] is not None else m[5] if m[5] is not None else m[7] or ""
        if m[3] is not None and not m[4] or m[5] is not None and not m[6]:
            return found, len(html)
        if name:
            found.setdefault(name, unescape(value))
        at = m.end()
        if at >= len(html):
            return found, at
        if html[at] == ">":
            return found, at + 1
        if m.end() == m.start():
            at += 1


def is_bad_name(name: str) -> bool:
    """Whether a class or id is that of boilerplate."""
    return bool(BAD_NAME.fullmatch(name) or BAD_PAIR.fullmatch(name.replace("_", "-")) or any(BAD_PART.fullmatch(p) for p in re.split(r"[-_]+|(?<=\D)(?=\d)", name)))


def _judge(tag: str, own: dict[str, str], good: bool, never: bool, inside: bool) -> tuple[bool, bool, bool]:
    """Whether the element's text is in a named content element, whether it is never content, and whether it is a form or
    a block of a bad name: that is never content unless it wraps the article.

    A header inside an article is judged by its name alone: it may hold the heading.
    """
    names = f"{own.get('class', '')} {own.get('id', '')}".lower().strip()
    role = own.get("role", "").lower()
    marked = tag == "form" or role == "form"
    if tag in NEVER and tag != "form" and not (inside and tag == "header") or role in BAD_ROLE and role != "form":
        never = True
    if _named_badly(tag, names):
        if tag in BLOCK:
            marked = True
        else:
            never = True
    if "hidden" in own or own.get("aria-hidden") == "true" or _HIDDEN.search(own.get("style", "")):
        never = True
    if tag in ("article", "main") or names and GOOD_NAME.search(names) or role == "main" or own.get("itemprop", "").lower() == "articlebody":
        good = True
    return good, never, marked


def _named_badly(tag: str, names: str) -> bool:
    return bool(names) and tag not in ("html", "body", "article", "main") and any(map(is_bad_name, MODIFIER.sub("", names).split()))


def _wrappers(found: list[Block], articles: list[tuple[int, ...]], headings: list[tuple[int, ...]]) -> set[int]:
    """The marked elements that wrap the article, whatever they are called.

    They hold every article element of the page; without any, its first headings, several paragraphs, half of its prose
    and nearly all that is not in other such elements. articles, headings: the marks around each of those elements.
    """
    if articles:
        return set.intersection(*map(set, articles))
    prose = [b for b in found if not b.never and b.text.count(" ") + 1 >= PROSE_WORDS and 2 * b.links < len(b.text)]
    total, plain, words, paragraphs = 0, 0, Counter(), Counter()
    for b in prose:
        n = b.text.count(" ") + 1
        total += n
        plain += 0 if b.marks else n
        for mark in b.marks:
            words[mark] += n
            paragraphs[mark] += 1
    around = set.intersection(*map(set, headings)) if headings else set(words)
    return {m for m in around if paragraphs[m] >= WRAPPED_PARAGRAPHS and 2 * words[m] >= total and words[m] >= WRAPPED_SHARE * (plain + words[m])}


def blocks(html: str) -> list[Block]:
    """The text blocks of a page in its order; character references are decoded, white space is one space."""
    out: list[Block] = []
    stack = [Open("", 0, False, False, False, 0, ())]
    articles: list[tuple[int, ...]] = []
    headings: list[tuple[int, ...]] = []
    opened: Counter = Counter()
    ends: dict[str, re.Pattern] = {}
    unclosed: set[str] = set()
    current: Block | None = None
    number, at, end = 0, 0, len(html)

    def add(text: str) -> None:
        nonlocal current
        top = stack[-1]
        within = stack[top.block]
        if top.never and not within.never:
            return  # a named advert or notice, or a hidden run, inside a paragraph
        if current is None:
            if not text.strip():
                return
            parent = stack[stack[top.block - 1].block].number if top.block else 0
            current = Block(parent, within.tag, top.good, top.never, top.marks)
            out.append(current)
        elif top.good and text.strip():
            current.good = True
        current.parts.append(text)
        current.links += len(text) if opened["a"] else 0

    def cut(place: int) -> None:
        for gone in stack[place:]:
            opened[gone.tag] -= 1
        del stack[place:]

    while at < end:
        start = html.find("<", at)
        if start < 0:
            add(unescape(html[at:]))
            break
        if start > at:
            add(unescape(html[at:start]))
        mark = html[start + 1 : start + 2]
        if html.startswith("<!--", start):
            close = html.find("-->", start + 2)
            at = close + 3 if close >= 0 else end
            continue
        if mark in ("!", "?"):
            close = html.find(">", start)
            at = close + 1 if close >= 0 else end
            continue
        closing = mark == "/"
        name = _NAME.match(html, start + 1 + closing)
        if not name:
            if closing and start + 2 < end:
                close = html.find(">", start)
                at = close + 1 if close >= 0 else end
            else:
                add("<" if not closing else "</")
                at = start + 1 + closing
            continue
        tag = name[0].lower()
        own, at = _attributes(html, name.end())
        if tag in BLOCK:
            current = None
        if closing:
            if opened[tag] > 0 and tag not in VOID:
                place = len(stack) - 1
                while stack[place].tag != tag:
                    place -= 1
                cut(place)
            elif tag == "br":
                add(" ")
            continue
        if tag in RAW:
            close = None
            if tag not in unclosed:
                close = ends.setdefault(tag, re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I)).search(html, at)
            if close is None:
                unclosed.add(tag)  # nor will a later one find its end
            if close or tag in ("script", "style", "textarea", "title", "xmp", "noembed", "noframes", "iframe"):
                at = close.end() if close else end
            continue
        if tag in VOID:
            if tag == "br":
                add(" ")
            continue
        if tag in BLOCK:  # an open paragraph or item ends where the next block begins, with what is open inside it
            ended = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}.get(tag, ())
            stop = {"li": ("ul", "ol", "menu"), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}.get(tag, ("dl",))
            place = stack[-1].block
            while place:
                if stack[place].tag == "p" or stack[place].tag in ended:
                    cut(place)
                elif not ended or stack[place].tag in stop:
                    break
                place = stack[place - 1].block
        number += 1
        top = stack[-1]
        good, never, marks = top.good, top.never, top.marks
        if own or tag in NEVER or tag in ("article", "main"):
            good, never, marked = _judge(tag, own, good, never, top.inside)
            if marked:
                marks = (*marks, number)
        if not never and tag in ("article", "main") and not _named_badly("div", f"{own.get('class', '')} {own.get('id', '')}".lower().strip()):
            articles.append(marks)
        elif not never and tag == "h1":
            headings.append(marks)
        stack.append(Open(tag, number, good, never, top.inside or tag in ("article", "main"), len(stack) if tag in BLOCK else top.block, marks))
        opened[tag] += 1
    for b in out:
        b.text = _SPACE.sub(" ", "".join(b.parts)).strip()
    out = [b for b in out if b.text]
    wrappers = _wrappers(out, articles, headings)
    for b in out:
        b.never = b.never or not wrappers.issuperset(b.marks)
    return out


def costs(block: Block, has_good: bool) -> tuple[float, float]:
    """The classifier: the cost of calling the block boilerplate, and that of calling it content."""
    if block.never:
        return 0.0, NEVER_COST
    words = block.text.count(" ") + 1
    density = min(1.0, block.links / max(1, len(block.text)))
    score = min(2.0, words / 20) - 0.4 - 3.0 * density * (words < 40)
    score += 0.5 * (block.text[-1] in ".!?…:;\"'»”")
    score += {"h1": 1.2, "h2": 0.6, "h3": 0.6, "h4": 0.4, "p": 0.3, "blockquote": 0.3, "pre": 0.3, "li": -0.2, "td": -0.2}.get(block.tag, 0.0)
    if has_good:
        score += 0.8 if block.good else -2.0
    return max(score, 0.0), max(-score, 0.0)


def minimum_cut(source: list[float], sink: list[float], ties: list[tuple[int, int, float]]) -> list[bool]:
    """True for nodes on the source's side of a minimum cut, by Dinic's maximum flow."""
    n = len(source)
    s, t = n, n + 1
    to, room, edges = [], [], [[] for _ in range(n + 2)]

    def edge(a: int, b: int, there: float, back: float) -> None:
        edges[a].append(len(to))
        to.append(b)
        room.append(there)
        edges[b].append(len(to))
        to.append(a)
        room.append(back)

    for i in range(n):
        direct = min(source[i], sink[i])  # flow that passes one node alone
        if source[i] > direct:
            edge(s, i, source[i] - direct, 0.0)
        if sink[i] > direct:
            edge(i, t, sink[i] - direct, 0.0)
    for a, b, w in ties:
        edge(a, b, w, w)
    while True:
        level = [-1] * (n + 2)
        level[s], queue = 0, deque([s])
        while queue:
            a = queue.popleft()
            for e in edges[a]:
                if room[e] > 1e-12 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n)]
        turn = [0] * (n + 2)
        while True:  # a blocking flow, path by path without recursion
            path, a = [], s
            while a != t:
                while turn[a] < len(edges[a]):
                    e = edges[a][turn[a]]
                    if room[e] > 1e-12 and level[to[e]] == level[a] + 1:
                        break
                    turn[a] += 1
                if turn[a] < len(edges[a]):
                    path.append(e)
                    a = to[e]
                elif path:
                    a = to[path.pop() ^ 1]
                    turn[a] += 1
                else:
                    break
            if a != t:
                break
            least = min(room[e] for e in path)
            for e in path:
                room[e] -= least
                room[e ^ 1] += least


def main_text(html: str) -> str:
    found = blocks(html)
    if not found:
        return ""
    good = any(b.good and not b.never for b in found)
    pairs = [costs(b, good) for b in found]
    ties: list[tuple[int, int, float]] = []
    last: dict[int, int] = {}
    for i, b in enumerate(found):
        if i:
            ties.append((i - 1, i, NEAR if b.good == found[i - 1].good else NEAR / 3))
        if b.parent in last:
            ties.append((last[b.parent], i, TREE))
        last[b.parent] = i
    kept = minimum_cut([a for a, _ in pairs], [b for _, b in pairs], ties)
    # A free node, with no cost either way, stays with what cost says: content if it is not on the sink's side.
    return "\n".join(b.text for b, k, (a, c) in zip(found, kept, pairs, strict=True) if k and not b.never)


def extract(df: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns in keep, with text and n_chars of each page."""
    ship(df.sparkSession)
    rows = df.select(*keep, F.col(html).cast("string").alias("__html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h.as_py() or "") for h in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*keep, "text", "n_chars"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1])
    return rows.mapInArrow(task("html", run), f"{kept}, text string, n_chars long")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
