"""Main text of web pages by minimum-cut labelling.

A tolerant tokenizer keeps the stack of open elements and cuts the page into blocks of text. A classifier scores each block for
content or boilerplate from what its ancestors say of it, its length, links and punctuation. Scores become capacities from the
content terminal or to the boilerplate terminal; blocks next to each other and blocks near each other in the DOM are joined by
smoothness edges. A maximum flow separates the two terminals at least cost, and the blocks left on the content side are the text,
in page order. Every block is in the graph: whatever is said of it is a finite capacity that its neighbours can outweigh.

Ancestors speak through tags and roles (a menu, footer, sidebar or form around a block counts against it wherever it stands; an
article or main part counts for it) and through the words of class and id. Of classes the innermost that says anything counts,
and those outside an article don't count within it. A class is a list of names: one that is made of boilerplate words and words
for places and boxes counts in full (``side-bar``, ``ad_box``), one in which other words stand too (``related-work``) counts little,
and one that denies (``no-sidebar``, ``ad-free``) or describes what lies elsewhere (``has-sidebar``) says nothing.

Character references are decoded within each run of text between tags, white space inside a block becomes one space, blocks are
trimmed and joined by one newline. Work grows linearly with the page, however deep or broken its tags, but for the cut.

Defined results: null and empty pages, and pages without content, give an empty text; unclosed tags and comments end with the page;
a tag whose quotes never close ends at its first ``>``; stray end tags are ignored; <br> is white space; repeated rows get equal
results; input columns named like a result column are replaced.
"""

from __future__ import annotations

import bisect
import html
import re

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tracewise.llm.arrowmap import add_columns, text_of

FIELDS = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]

# fixed values of the classifier
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea iframe noembed noframes template svg canvas annotation annotation-xml".split())
BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript object ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul button video audio caption xmp".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}}
SCOPE = {"li": {"ul", "ol", "menu", "table"}, "dt": {"dl", "table"}, "dd": {"dl", "table"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}, "tbody": {"table"}}
BOILER_TAGS = set("nav footer aside form button select menu dialog search fieldset head".split())
BOILER_ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
BOILER_WORDS = set("ad ads adv advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright discussion disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notification pager pagination popup promo promoted promotion recommended related replies respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription teaser toolbar tracking widget".split())
SITE_WORDS = set("header top topbar bar brand logo alert".split())
CONTENT_TAGS = {"article", "main"}
CONTENT_WORDS = set("article articlebody content entry main post story text".split())
PLACE_WORDS = set("a area articles bar block body bottom box buttons col column container content first form global group head header icons inner item items last left line link links list main nav news outer page panel posts primary right row secondary section side site slot sticky tertiary text thread title top unit wrap wrapper zone".split())
DENIAL_WORDS = set("no not non without free less has with hide hidden disable disabled".split())

_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
#: The inside of a tag, with whole quoted values, up to what ends or breaks it.
_INSIDE = re.compile(r"[^\"'>]*+(?:(?:\"[^\"]*+\"|'[^']*+')[^\"'>]*+)*+")
_QUOTED = re.compile(r"\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

#: What ancestors say, as capacities.
CONTENT, BOILER_TAG, BOILER_CLASS, HINT, UNSEEN = 3.5, -9.0, -7.0, -1.5, -20.0


class Element:
    """An open element: ``parent`` is the block element around it, ``depth`` the number of block elements down to it. ``against`` is what
    tags and roles say, ``marked`` what the innermost class or article says; ``inside`` tells whether it is in an article."""

    __slots__ = ("name", "block", "parent", "depth", "against", "marked", "inside", "link", "heading")

    def __init__(self, name: str, block: bool, parent: Element | None, depth: int, against: float, marked: float, inside: bool, link: bool, heading: bool) -> None:
        self.name, self.block, self.parent, self.depth = name, block, parent, depth
        self.against, self.marked, self.inside, self.link, self.heading = against, marked, inside, link, heading


class Block:
    """A run of text: ``at`` is the block element it stands in, ``context`` what the ancestors say of it."""

    __slots__ = ("text", "at", "context", "links", "heading")

    def __init__(self, text: str, at: Element, context: float, links: int, heading: bool) -> None:
        self.text, self.at, self.context, self.links, self.heading = text, at, context, links, heading


def named(value: str, inside: bool) -> float:
    """What the names in a class or id say: a capacity, 0 for nothing."""
    against, good = 0.0, False
    for name in value.split():
        words = [w.lower() for w in _WORD.findall(name)]
        joined = "".join(words)
        found = set(words) | {joined}
        boiler = found & BOILER_WORDS or (not inside and found & SITE_WORDS)
        if found & DENIAL_WORDS:
            continue
        if boiler:
            whole = joined in BOILER_WORDS or all(w in BOILER_WORDS or w in PLACE_WORDS or w in SITE_WORDS or len(w) == 1 for w in words)
            against = min(against, BOILER_CLASS if whole else HINT)
        elif found & CONTENT_WORDS:
            good = True
    if against == HINT:
        return 0.0 if good else HINT
    return against + CONTENT if against and good else against or (CONTENT if good else 0.0)


def _opened(name: str, attrs: str, top: Element) -> tuple[float, float, bool]:
    """(against, marked, inside) of a new element."""
    against, marked, inside = top.against, top.marked, top.inside
    if name in BOILER_TAGS or (name == "header" and not inside):
        against = min(against, BOILER_TAG)
    elif name == "noscript" and not inside:
        marked = min(marked, HINT)
    found: dict[str, str] = {}
    if attrs and not attrs.isspace():
        for m in _ATTR.finditer(attrs):
            found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
        role = found.get("role", "").lower()
        if role in BOILER_ROLES:
            against = min(against, BOILER_TAG)
        if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or ("style" in found and _UNSEEN.search(found["style"])):
            against = UNSEEN
        if name in CONTENT_TAGS or role in ("main", "article"):
            return against, CONTENT, True
        if name not in ("html", "body") and ("class" in found or "id" in found):
            said = named(found.get("class", "") + " " + found.get("id", ""), inside)
            if said:
                marked = said if said != HINT else min(marked, CONTENT) + HINT
                inside = inside or said == CONTENT
    elif name in CONTENT_TAGS:
        return against, CONTENT, True
    return against, marked, inside


class _Tags:
    """Ends of tags. A scan that respects quotes may run to the end of the page in vain; where such scans went is kept, and a tag that
    begins outside the quotes of one of them would go the same way. There are at most three of them: one for each state."""

    def __init__(self, page: str) -> None:
        self.page, self.vain = page, []

    def end(self, at: int) -> int:
        """Where the tag whose inside begins at ``at`` has its ``>``; -1 if nowhere."""
        for starts, stops in self.vain:
            k = bisect.bisect_left(starts, at) - 1
            if k < 0 or stops[k] <= at:
                return self.page.find(">", at)
        stop = _INSIDE.match(self.page, at).end()
        if self.page[stop : stop + 1] == ">":
            return stop
        quoted = [m.span() for m in _QUOTED.finditer(self.page, at)]
        self.vain.append(([q[0] for q in quoted], [q[1] for q in quoted]))
        return self.page.find(">", at)


def blocks(page: str) -> list[Block]:
    """The blocks of text of a page, in order."""
    out: list[Block] = []
    root = Element("", True, None, 0, 0.0, 0.0, False, False, False)
    stack = [root]
    block_at = [0]  # places of the block elements in the stack
    open_at: dict[str, list[int]] = {}  # places of the open elements by name
    parts: list[str] = []
    links = 0
    tags = _Tags(page)

    def said(text: str) -> None:
        nonlocal links
        parts.append(html.unescape(text) if "&" in text else text)
        if stack[-1].link:
            links += len(text)

    def flush() -> None:
        nonlocal links
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                top = stack[-1]
                out.append(Block(text, stack[block_at[-1]], top.against or top.marked, links, top.heading))
            parts.clear()
        links = 0

    def close(k: int) -> None:
        """Closes the k-th open element and all in it."""
        if block_at[-1] >= k:
            flush()
            while block_at[-1] >= k:
                block_at.pop()
        for e in stack[k:]:
            open_at[e.name].pop()
        del stack[k:]

    at, size = 0, len(page)
    while at < size:
        cut = page.find("<", at)
        if cut < 0:
            said(page[at:])
            break
        mark = page[cut + 1 : cut + 2]
        if not (mark in ("/", "!", "?") or ("a" <= mark <= "z" or "A" <= mark <= "Z")):
            said(page[at : cut + 1])
            at = cut + 1
            continue
        if cut > at:
            said(page[at:cut])
        m = _NAME.match(page, cut + 1)
        if not m:
            ends = ("-->", 3) if page.startswith("<!--", cut) else (">", 1)
            stop = page.find(ends[0], cut + (4 if ends[1] == 3 else 2))
            if stop < 0:
                break
            at = stop + ends[1]
            continue
        stop = tags.end(m.end())
        if stop < 0:
            break
        name, attrs, at = m[1].lower(), page[m.end() : stop], stop + 1
        if mark == "/":
            if open_at.get(name):
                close(open_at[name][-1])
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in RAW and not (name == "svg" and attrs.rstrip().endswith("/")):
            if name in ("textarea", "title"):
                flush()
            m = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = m.end() if m else size
            continue
        if name in BLOCK:
            flush()
            if name in CLOSED_BY:
                scope = max((open_at[x][-1] for x in SCOPE[name] if open_at.get(x)), default=0)
                within = [p[bisect.bisect_right(p, scope)] for x in CLOSED_BY[name] if (p := open_at.get(x)) and p[-1] > scope]
                if within:
                    close(min(within))
            if stack[block_at[-1]].name == "p":
                close(block_at[-1])
        if name in VOID:
            continue
        top = stack[-1]
        block = name in BLOCK
        around = stack[block_at[-1]]
        link = name == "a" or (top.link and not block)
        heading = top.heading or (len(name) == 2 and name[0] == "h" and name[1] in "123456")
        stack.append(Element(name, block, around, around.depth + block, *_opened(name, attrs, top), link, heading))
        open_at.setdefault(name, []).append(len(stack) - 1)
        if block:
            block_at.append(len(stack) - 1)
    flush()
    return out


def score(b: Block) -> float:
    """Above 0 for content; the size is the cost of calling it otherwise."""
    value = -1.0 + min(len(b.text.split(None, 30)), 30) * 0.12 - 4.0 * min(1.0, b.links / max(1, len(b.text)))
    value += b.context
    value += 0.6 if b.heading else 0.0
    if b.text[-1] in ".!?…:;\"'”»)":
        value += 0.6
    return value


ADJACENT, NEAR = 0.5, 1.0


def shared(a: Element, b: Element) -> int:
    """How many block elements two of them stand in together. Steps up are as many as elements closed and opened in between."""
    while a is not b:
        if a.depth > b.depth:
            a = a.parent
        elif b.depth > a.depth:
            b = b.parent
        else:
            a, b = a.parent, b.parent
    return a.depth


def edges(found: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness edges: to the next block, stronger the more ancestors both share; and between neighbours of one parent."""
    out, last = [], {}
    for k, b in enumerate(found):
        if k:
            a = found[k - 1].at
            out.append((k - 1, k, ADJACENT + NEAR * shared(a, b.at) / max(a.depth, b.at.depth, 1)))
        parent = id(b.at.parent)
        if parent in last and last[parent] != k - 1:
            out.append((last[parent], k, NEAR))
        last[parent] = k
    return out


def min_cut(scores: list[float], links: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay on the source side of a minimum cut (the smallest such side): Dinic's maximum flow."""
    n = len(scores)
    source, sink = n, n + 1
    to: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def add(a: int, b: int, forth: float, back: float) -> None:
        out[a].append(len(to))
        to.append(b)
        room.append(forth)
        out[b].append(len(to))
        to.append(a)
        room.append(back)

    for k, s in enumerate(scores):
        if s > 0:
            add(source, k, s, 0.0)
        elif s < 0:
            add(k, sink, -s, 0.0)
    for a, b, w in links:
        add(a, b, w, w)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = [source]
        for x in queue:
            for e in out[x]:
                if room[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[x] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[k] >= 0 for k in range(n)]
        turn = [0] * (n + 2)
        path: list[int] = []
        x = source
        while True:
            if x == sink:
                least = min(room[e] for e in path)
                for e in path:
                    room[e] -= least
                    room[e ^ 1] += least
                first = next(k for k, e in enumerate(path) if room[e] <= tiny)
                x = to[path[first] ^ 1]
                del path[first:]
                continue
            while turn[x] < len(out[x]):
                e = out[x][turn[x]]
                if room[e] > tiny and level[to[e]] == level[x] + 1:
                    break
                turn[x] += 1
            else:
                if x == source:
                    break
                e = path.pop()
                x = to[e ^ 1]
                turn[x] += 1
                continue
            path.append(e)
            x = to[e]


def main_text(page: str | None) -> str:
    if not page:
        return ""
    found = blocks(page)
    scores = [score(b) for b in found]
    if not any(s > 0 for s in scores):
        return ""
    kept = min_cut(scores, edges(found))
    return "\n".join(b.text for b, ok in zip(found, kept, strict=True) if ok)


def extract(pages: DataFrame, page: str = "html") -> DataFrame:
    """``pages`` with text and n_chars (code points)."""

    def make():
        def work(batch):
            done: dict = {}
            out = []
            for p in text_of(batch, page).to_pylist():
                if p not in done:
                    done[p] = main_text(p)
                out.append(done[p])
            return [out, [len(t) for t in out]]

        return work

    return add_columns(pages, page, FIELDS, make)
