"""Operator 10: main-text extraction by wrappers inferred for each host as union-free regular expressions.

A page is a stream of block tags and text. Its own wrapper folds neighbours of one kind into repeated groups. Wrappers of the same
host are aligned: kinds that both have stay, those that one lacks become optional, elements whose names differ at the same
place become one whose name is what they share, and text is a slot unless the same blocks are on every page. Pages of equal
form are added up first, in any order; wrappers of different forms are aligned in the order of their content, so the result
depends on neither partitions nor the order of pages.

The wrapper then says which of its elements hold the article, and each page is matched against it. Slots and repeated groups
with slots are content, text that all pages share is not, nor are groups of links. Where slots alone cannot tell (adverts,
comments and menus differ from page to page too), names of elements break the tie: a part named like one that is never the article
is left out, unless it holds what the page is about.
"""

from __future__ import annotations

import html
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm import common

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|textarea|iframe|svg|select|button|object|canvas|video|audio|title)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>"
    r"|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<(?=[a-zA-Z/])[^>]*(?:>|\Z)"
    r"|([^<]+|<)",
    re.S | re.I,
)
_ENDS = {name: re.compile(rf"</{name}\s*>", re.I) for name in "script style noscript template textarea iframe svg object canvas video audio title".split()}
_ENDS |= {name: re.compile(rf"</{name}\s*>|<(?={name}\b)", re.I) for name in ("select", "button")}  # they never hold one another, so a second one says that the first has no end
_UNQUOTED = re.compile(r"=\s*[^\s\"'>]+/>\Z")
#: Their content is no markup: no slash closes them.
RAW = set("script style textarea title".split())
#: Without an end they reach to the page's end; of other elements without an end only the opening tag goes.
TO_THE_END = set("script style title".split())
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)|display\s*:\s*none", re.I)
_ATTRIBUTE = re.compile(r"([a-zA-Z][\w:-]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")

# Elements that make blocks; those that are never the article; words of a class, id or role that name such parts, and beginnings of such words; those that name headers, which an article has too; those that name comments; names of an article's element.
BLOCKS = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
ASIDE_TAGS = set("aside dialog footer form head menu nav".split())
ASIDE_WORDS = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert popup modal overlay nav navbar navigation menu "
    "breadcrumb breadcrumbs sidebar aside footer topbar toolbar share sharing social related recommended newsletter subscribe signup login search form pagination pager widget".split()
)
ASIDE_STARTS = ("advert", "cookie", "sidebar", "newsletter", "sponsor", "breadcrumb", "navig", "promo")
HEADER_WORDS = {"header", "masthead"}
COMMENT_WORDS = set("comment comments reply replies disqus".split())
ARTICLE_WORDS = {"articlebody", "article-body", "entry-content", "post-content", "article-content", "article__body", "story-body"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
CLOSES_ITSELF = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr"}, "th": {"tr"}}

#: Blocks nested deeper take no part in wrappers: their text belongs to the block above, and only their own names can leave them out.
DEEPEST = 120
#: Text is told to be the same on all pages from so many pages on; pages that differ only in parts named as none of the article count as one.
FEWEST_PAGES = 3
#: So many wrappers are aligned in one task.
FAN_IN = 256


@lru_cache(1 << 16)
def signature(name: str, attributes: str) -> tuple[str, str, tuple[str, ...]]:
    """An element's name; what its names say (a: aside, c: comments, h: hidden, t: a header, r: article, else nothing); its classes, id and role without numbers."""
    words: set[str] = set()
    told: set[str] = set()
    if attributes.strip():
        for key, a, b, c in _ATTRIBUTE.findall(attributes):
            key = key.lower()
            if key in ("class", "id", "role", "itemprop"):
                own = (a or b or c).lower().split()
                words.update(re.sub(r"\d+", "0", w) for w in own)
                if not (key == "id" and name in HEADINGS):  # a heading's id is made of its text
                    told.update(own)
        if _HIDDEN.search(attributes):
            return name, "h", tuple(sorted(words))
    kind = ""
    if name in ("html", "body"):
        told = set()
    elif name in ("main", "article"):
        told = {w for w in told if w in COMMENT_WORDS or w in ("ad", "advert", "related")}
    parts = {part for w in told for part in (w, *re.split(r"[-_]+", w))}
    if parts & COMMENT_WORDS or any(p.startswith("comment") for p in parts):
        kind = "c"
    elif name in ASIDE_TAGS or parts & ASIDE_WORDS or any(p.startswith(ASIDE_STARTS) for p in parts):
        kind = "a"
    elif name == "header" or parts & HEADER_WORDS:
        kind = "t"
    elif name in ("article", "main") or told & (ARTICLE_WORDS | {"main"}):
        kind = "r"
    return name, kind, tuple(sorted(words))


def _tokens(page: str) -> Iterator[re.Match]:
    """The page's tags, texts and so on; an element whose content is never text of the page is one token with it."""
    at, endless = 0, set()
    while at < len(page):
        m = _TOKEN.match(page, at)
        yield m
        at = m.end()
        if m[1] is None:
            continue
        name = m[1].lower()
        if name in endless or name not in RAW and page[at - 2] == "/" and not _UNQUOTED.search(page, m.start(), at):
            continue
        end = _ENDS[name].search(page, at)
        if end and end[0].startswith("</"):
            at = end.end()
        elif name in TO_THE_END:
            return
        elif not end:  # the search is not made again
            endless.add(name)


def events(page: str) -> Iterator[tuple[str, str, str]]:
    """The stream of a page: ("open", name, attributes) and ("close", name, "") of blocks, ("text", text, ""), ("space", "", ""), ("break", "", "") between blocks, and ("link", "", "/" at its end)."""
    names: list[str] = []
    there: Counter[str] = Counter()

    def close() -> tuple[str, str, str]:
        there[names[-1]] -= 1
        return "close", names.pop(), ""

    for m in _tokens(page):
        _, end, name, attributes, text = m.groups()
        if text is not None:
            yield "text", text, ""
            continue
        if name is None:
            continue
        name = name.lower()
        if name == "br":
            yield "space", "", ""
        elif name == "a":
            yield "link", "", end
        if name not in BLOCKS:
            continue
        if end:
            if there[name]:
                while names[-1] != name:
                    yield close()
                yield close()
            else:
                yield "break", "", ""
            continue
        while there["p"]:  # a block ends an open paragraph
            yield close()
        if name in CLOSES_ITSELF and any(there[x] for x in (name, "dt", "dd", "td", "th")):
            for k in range(len(names) - 1, -1, -1):
                if names[k] in CLOSES_ITSELF[name]:
                    break
                if names[k] == name or {name, names[k]} in ({"dt", "dd"}, {"td", "th"}):
                    for _ in range(len(names) - k):
                        yield close()
                    break
        if name == "hr":
            yield "break", "", ""
            continue
        names.append(name)
        there[name] += 1
        yield "open", name, attributes


def _mark(text: str) -> int:
    """What two equal blocks share; white space within does not count."""
    return zlib.crc32(" ".join(text.split()).encode("utf-8", "replace"))


class Node:
    """An element of a wrapper: its signature, if some parents lack it, if it repeats; over all pages that have it their number, marks of a few that differ, the characters of its own text, of links in it and the number of those; the marks of own blocks that all of them have, the most that one has; and its elements by signature, in order."""

    __slots__ = ("chars", "inside", "links", "most", "nlinks", "optional", "pages", "repeated", "seen", "shared", "sign")

    def __init__(self, sign: tuple[str, str, tuple[str, ...]]):
        self.sign, self.optional, self.repeated = sign, False, False
        self.pages, self.seen, self.chars, self.links, self.nlinks, self.most = 1, [], 0, 0, 0, 0
        self.shared: set[int] = set()
        self.inside: dict[tuple, Node] = {}

    def packed(self) -> list:
        name, kind, words = self.sign
        return [name, kind, " ".join(words), int(self.optional), int(self.repeated), self.pages, self.seen, self.chars, self.links, self.nlinks, self.most, sorted(self.shared), [x.packed() for x in self.inside.values()]]

    @classmethod
    def unpacked(cls, own: list) -> Node:
        out = cls((own[0], own[1], tuple(own[2].split())))
        out.optional, out.repeated, out.pages, out.seen, out.chars, out.links, out.nlinks, out.most = bool(own[3]), bool(own[4]), *own[5:11]
        out.shared = set(own[11])
        for x in map(cls.unpacked, own[12]):
            out.inside[x.sign] = x
        return out

    def form(self) -> str:
        """The signatures within, in order: pages of equal form can be added up in any order."""
        name, kind, words = self.sign
        return f"<{name} {kind} {' '.join(words)}>{''.join(x.form() for x in self.inside.values())}</>"

    @property
    def slot(self) -> bool:
        """Whether its own text differs from page to page, or too few pages tell."""
        return self.most > len(self.shared) or len(self.seen) < FEWEST_PAGES and bool(self.shared)


def page_wrapper(page: str) -> Node:
    """The wrapper of one page: its own stream with elements of a kind under one parent folded into a repeated group."""
    root = Node(("", "", ()))
    stack, quiet, deeper, linked = [root], [False], 0, 0  # quiet: within a part that is named as none of the article
    parts: list[tuple[str, int]] = []
    said, size = [0, 0], [0, 0]  # sums of the marks, and characters, outside and within such parts: pages that differ in adverts only are one

    def end_block() -> None:
        text = "".join(t for t, _ in parts)
        if text and not text.isspace():
            own, m, n = stack[-1], _mark(text), sum(len(t) for t, _ in parts if not t.isspace())
            own.shared.add(m)
            own.chars += n
            own.links += sum(len(t) for t, k in parts if k)
            said[quiet[-1]] += m
            size[quiet[-1]] += n
        parts.clear()

    for kind, a, b in events(page):
        if kind == "text":
            parts.append((a, linked))
        elif kind == "space":
            parts.append((" ", 0))
        elif kind == "link":
            linked = 0 if b else 1
            stack[-1].nlinks += linked
        elif kind == "open":
            end_block()
            if len(stack) > DEEPEST:
                deeper += 1
            else:
                stack.append(Node(signature(a, b)))
                quiet.append(quiet[-1] or stack[-1].sign[1] not in ("", "r"))
        else:
            end_block()
            if kind == "close":
                if deeper:
                    deeper -= 1
                else:
                    quiet.pop()
                    _put(stack[-2].inside, stack.pop())
    end_block()
    while len(stack) > 1:
        _put(stack[-2].inside, stack.pop())
    todo = [root]
    while todo:
        x = todo.pop()
        x.seen, x.most = [(said[0] if 4 * size[0] > size[1] else sum(said)) & 0xFFFFFFFF], len(x.shared)
        todo += x.inside.values()
    return root


def _put(row: dict[tuple, Node], own: Node) -> None:
    """One more element into the row of its parent's elements on the same page."""
    got = row.get(own.sign)
    if got is None:
        row[own.sign] = own
        return
    got.repeated = True
    got.optional |= own.optional
    got.chars, got.links, got.nlinks = got.chars + own.chars, got.links + own.links, got.nlinks + own.nlinks
    got.shared |= own.shared
    for sign, x in got.inside.items():
        x.optional |= sign not in own.inside
    for sign, x in own.inside.items():
        again = x.repeated or sign in got.inside and got.inside[sign].repeated
        x.optional |= sign not in got.inside
        _put(got.inside, x)
        got.inside[sign].repeated = again  # once in each is not repeated


def aligned(a: Node, b: Node) -> Node:
    """Two wrappers of different pages as one; a and b are used up."""
    a.optional |= b.optional
    a.repeated |= b.repeated
    a.pages, a.chars, a.links, a.nlinks, a.most = a.pages + b.pages, a.chars + b.chars, a.links + b.links, a.nlinks + b.nlinks, max(a.most, b.most)
    a.seen = sorted({*a.seen, *b.seen})[:FEWEST_PAGES]
    a.shared &= b.shared
    if list(a.inside) == list(b.inside):
        for sign, x in a.inside.items():
            aligned(x, b.inside[sign])
    else:
        a.inside = _row(list(a.inside.values()), b.inside)
    return a


def _longest_rise(x: list[int]) -> set[int]:
    """Members of a longest increasing subsequence of distinct numbers."""
    from bisect import bisect_left

    tails: list[int] = []
    at: list[int] = []
    before: list[int] = []
    for i, v in enumerate(x):
        k = bisect_left(tails, v)
        before.append(at[k - 1] if k else -1)
        if k == len(tails):
            tails.append(v)
            at.append(i)
        else:
            tails[k], at[k] = v, i
    out, i = set(), at[-1] if at else -1
    while i >= 0:
        out.add(x[i])
        i = before[i]
    return out


def _row(a: list[Node], b: dict[tuple, Node]) -> dict[tuple, Node]:
    """Two rows of kinds as one: the longest row of kinds in the same order in both is the spine; others of both stay once; what one lacks is optional.

    Between two kinds of the spine, elements of one name that only one row has are the same element under changing
    classes or ids, and keep those that they share.
    """
    place = {sign: j for j, sign in enumerate(b)}
    others = list(b.values())
    mine = {x.sign for x in a}
    spine = _longest_rise([place[x.sign] for x in a if x.sign in place])
    out: dict[tuple, Node] = {}

    def put(x: Node) -> None:
        got = out.get(x.sign)
        if got is None:
            out[x.sign] = x
        else:
            aligned(got, x)

    def gap(only_a: list[Node], only_b: list[Node]) -> None:
        waiting: dict[tuple[str, str], list[Node]] = {}
        for y in only_b:
            waiting.setdefault(y.sign[:2], []).append(y)
        for x in only_a:
            own = waiting.get(x.sign[:2])
            if own:
                y = own.pop(0)
                x.sign = (*x.sign[:2], tuple(w for w in x.sign[2] if w in y.sign[2]))
                put(aligned(x, y))
            else:
                x.optional = True
                put(x)
        for own in waiting.values():
            for y in own:
                y.optional = True
                put(y)

    only_a: list[Node] = []
    done = 0
    for x in a:
        j = place.get(x.sign)
        if j is None:
            only_a.append(x)
        elif j in spine:
            gap(only_a, [y for y in others[done:j] if y.sign not in mine])
            only_a, done = [], j + 1
            put(aligned(x, others[j]))
        else:
            put(aligned(x, others[j]))
    gap(only_a, [y for y in others[done:] if y.sign not in mine])
    return out


def expression(own: Node) -> str:
    """A wrapper written as a regular expression, with #PCDATA for slots and #TEXT for texts that are the same on every page."""
    name, _, words = own.sign
    text = "#PCDATA" if own.slot and own.chars else "#TEXT" if own.shared else ""
    body = text + "".join(expression(x) for x in own.inside.values())
    if not name:
        return body
    often = {(False, False): "", (True, False): "?", (False, True): "+", (True, True): "*"}[own.optional, own.repeated]
    body = f"<{'.'.join([name, *words])}>{body}</>"
    return f"({body}){often}" if often else body


class _Judge:
    """What each element of a wrapper is."""

    def __init__(self, root: Node):
        self.out: set[int] = set()  # elements that are left out
        self.masses: dict[tuple[int, bool], float] = {}
        self.root = root
        self.links = any(x.slot and x.chars > x.links for x in self.every(root))  # else there is nothing but links, and they are the text
        self.trusted: set[int] = set()  # parts named as aside that hold what their parent has
        self.loose(root, False)
        self.total = self.strict(root, False)
        self.visit(root, False, False)

    @staticmethod
    def every(x: Node) -> Iterator[Node]:
        todo = [x]
        while todo:
            x = todo.pop()
            yield x
            todo += x.inside.values()

    def aside(self, x: Node, within: bool) -> bool:
        """Whether names tell that x is no part of the article. A header is one within an article, and where its main heading is a slot."""
        name, kind, _ = x.sign
        if kind == "t":
            return not within and not any(y.sign[0] == "h1" and y.slot and len(y.seen) >= FEWEST_PAGES and y.chars > y.links for y in self.every(x))
        return name == "head" or kind in ("a", "c", "h")

    def strict(self, x: Node, within: bool) -> float:
        """Characters of slots in x that are no links, without the parts that are named as aside, whatever x itself is named."""
        return self._mass(x, within, False)

    def loose(self, x: Node, within: bool) -> float:
        """The same with those of these parts that hold what there is, next to what their neighbours have."""
        return self._mass(x, within, True)

    def _mass(self, x: Node, within: bool, all_: bool) -> float:
        at = id(x), all_
        if at not in self.masses:
            within = within or x.sign[1] == "r"
            chars = (x.chars - (x.links if self.links else 0)) if x.slot else 0
            got = max(chars, 0) + sum(self._mass(y, within, all_) for y in x.inside.values() if not self.aside(y, within))
            if all_:
                beside = got
                for y in x.inside.values():
                    if self.aside(y, within) and self.holds(y, within, beside):
                        self.trusted.add(id(y))
                        got += self.loose(y, within)
            self.masses[at] = got
        return self.masses[at]

    def holds(self, x: Node, within: bool, beside: float) -> bool:
        """Whether x, named as aside, holds what the page is about: it has headings or paragraphs, and next to it nothing much would be left."""
        if x.sign[0] in ASIDE_TAGS - {"form"}:  # these are never put around a page
            return False
        inside, titled = self.loose(x, within), False
        if not inside:
            return False
        todo, plain = [x], False
        while todo:
            for y in todo.pop().inside.values():
                titled |= y.sign[0] == "h1" or y.sign[1] == "r"
                plain |= y.sign[0] == "p" or y.sign[0] in HEADINGS
                if not self.aside(y, within) or id(y) in self.trusted:
                    todo.append(y)
        if x.sign[1] == "c" or not plain and not titled:
            return titled and inside >= beside
        return inside >= beside * (1 if titled else 4)

    def visit(self, x: Node, within: bool, counted: bool) -> None:
        """Which of x's elements are left out. counted: whether the total has what holds() found in x."""
        within = within or x.sign[1] == "r"
        for y in x.inside.values():
            now = counted
            if self.aside(y, within):
                own = self.loose(y, within)
                there = counted and id(y) in self.trusted
                if not self.holds(y, within, self.total - own if there else self.total):
                    self.out.add(id(y))
                    continue
                if not there:
                    self.total += own
                now = True
            elif not within and self.menu(y):
                self.out.add(id(y))
                continue
            self.visit(y, within, now)
            if y.sign[0] not in HEADINGS | {"body", "html", "main", "article"} and y.sign[1] != "r" and any(id(z) in self.out for z in self.every(y)) and not self.says(y):
                self.out.add(id(y))  # headings of what is left out

    def says(self, x: Node) -> bool:
        """Whether anything but lesser headings is left of x."""
        todo = [x]
        while todo:
            x = todo.pop()
            if x.chars and x.sign[0] not in HEADINGS - {"h1"}:
                return True
            todo += [y for y in x.inside.values() if id(y) not in self.out]
        return False

    def menu(self, x: Node) -> bool:
        """A group of links: most of its text is in links, of which a page has several."""
        if not self.links or x.sign[0] in HEADINGS | {"p", "li", "body", "html", "main", "article"} or x.sign[1] == "r":
            return False
        chars = links = n = 0
        for y in self.every(x):
            chars, links, n = chars + y.chars, links + y.links, n + y.nlinks
        return n >= 2 * x.pages and links > 0.6 * chars

    def roots(self) -> set[int]:
        """Elements named as the article that hold at least half of the slots, the outermost of them, or one within that has most of its text and its title; none if no such name helps."""
        named: list[tuple[Node, tuple[int, ...]]] = []

        def walk(x: Node, above: tuple[int, ...]) -> None:
            for y in x.inside.values():
                if id(y) in self.out:
                    continue
                if y.sign[1] == "r":
                    named.append((y, above))
                walk(y, (*above, id(y)))

        walk(self.root, ())
        mass = {id(x): self.loose(x, False) for x, _ in named}
        titles = {id(x): sum(y.sign[0] == "h1" and id(y) not in self.out for y in self.every(x)) for x, _ in named}
        inner = [(x, above) for x, above in named if not any(id(x) in up and mass[id(y)] * 2 > mass[id(x)] and titles[id(y)] == titles[id(x)] for y, up in named)]
        chosen = [(x, above) for x, above in inner if not any(id(y) in above for y, _ in inner)]
        top = max((mass[id(x)] for x, _ in chosen), default=0)
        chosen = [x for x, _ in chosen if 25 * mass[id(x)] >= top]
        if not sum(mass[id(x)] for x in chosen) * 2 >= self.total > 0:
            return set()
        within = [y for x in chosen for y in self.every(x) if id(y) not in self.out]
        if not any(y.sign[0] == "h1" for y in within):  # the title stands outside
            chosen += [y for y in self.kept(self.root) if y.sign[0] == "h1" and y.slot and y.chars > y.links]
        return {id(x) for x in chosen}

    def kept(self, x: Node) -> Iterator[Node]:
        """All elements that are not left out."""
        todo = [x]
        while todo:
            x = todo.pop()
            yield x
            todo += [y for y in x.inside.values() if id(y) not in self.out]


def rules(root: Node) -> list:
    """A wrapper as what pages are matched against: [name, kind, words, o (left out), r (holds the article) or nothing, shared marks, elements]."""
    judge = _Judge(root)
    roots = judge.roots()
    varied = judge.total > 0

    def of(x: Node) -> list:
        state = "o" if id(x) in judge.out else "r" if id(x) in roots else ""
        same = sorted(x.shared) if varied and len(x.seen) >= FEWEST_PAGES else []
        return [x.sign[0], x.sign[1], " ".join(x.sign[2]), state, same, [] if state == "o" else [of(y) for y in x.inside.values()]]

    return [bool(roots), of(root)]


class _Match:
    """An element of rules as pages are matched against it."""

    __slots__ = ("exact", "named", "same", "state")

    def __init__(self, own: list):
        self.state, self.same = own[3], frozenset(own[4])
        self.exact: dict[tuple, _Match] = {}
        self.named: dict[tuple, list[tuple[frozenset, _Match]]] = {}
        for x in own[5]:
            words, got = tuple(x[2].split()), _Match(x)
            self.exact[x[0], x[1], words] = got
            self.named.setdefault((x[0], x[1]), []).append((frozenset(words), got))

    def find(self, sign: tuple[str, str, tuple[str, ...]]) -> _Match | None:
        """The element of the wrapper that a page's element is: of equal names, else the one whose names it has most of."""
        got = self.exact.get(sign)
        if got is None:
            own = set(sign[2])
            fits = [(len(words), x) for words, x in self.named.get(sign[:2], ()) if words <= own]
            got = max(fits, key=lambda f: f[0])[1] if fits else None
        return got


@lru_cache(512)
def _loaded(text: str) -> tuple[bool, _Match]:
    rooted, top = json.loads(text)
    return rooted, _Match(top)


def _read(page: str, rooted: bool, top: _Match) -> str:
    # of each open block: its match, if it is read, if it is within a root
    stack: list[tuple[_Match | None, bool, bool]] = [(top, True, not rooted)]
    headings: list[str] = []  # of those that all pages share; they stay if what follows them does
    blocks: list[str] = []
    parts: list[str] = []
    names: list[str] = [""]
    linked = ends = links = 0  # within a link; characters of the block in links; links of the block

    def end_block() -> None:
        nonlocal ends, links
        match, read, within = stack[-1]
        raw = "".join(parts)
        parts.clear()
        menu, ends, links = not rooted and links >= 3 and ends > 0.7 * len(raw.strip()), 0, linked
        if not raw or raw.isspace():
            return
        if not (read and within) or menu:
            headings.clear()
            return
        text = " ".join(html.unescape(raw).split())
        if match is not None and match.same and _mark(raw) in match.same:
            if names[-1] in HEADINGS:
                headings.append(text)
            else:
                headings.clear()
        elif text:
            blocks.extend(headings)
            headings.clear()
            blocks.append(text)

    for kind, a, b in events(page):
        if kind == "text":
            parts.append(a)
            ends += linked * len(a)
        elif kind == "space":
            parts.append(" ")
        elif kind == "link":
            linked = 0 if b else 1
            links += linked
        elif kind == "open":
            end_block()
            match, read, within = stack[-1]
            sign = signature(a, b)
            named = a == "head" or sign[1] in ("a", "c", "h") or sign[1] == "t" and not (rooted and within)
            if len(stack) > DEEPEST:
                stack.append((match, read and not named, within))
            else:
                own = match.find(sign) if match is not None else None
                if own is None:  # the wrapper does not know it, so only its names can tell
                    read = read and not named
                else:
                    read = read and own.state != "o"
                    within = within or own.state == "r"
                stack.append((own, read, within))
            names.append(a)
        else:
            end_block()
            if kind == "close":
                stack.pop()
                names.pop()
    end_block()
    return "\n".join(blocks)


def main_text(page: str, found: str | None) -> str:
    """The article's blocks of a page by its host's rules (JSON); where they give none, by those of its own wrapper."""
    text = _read(page, *_loaded(found)) if found else ""
    if not text:
        rooted, top = rules(page_wrapper(page))
        text = _read(page, rooted, _Match(top))
    return text


def host_of(url: str | None) -> str:
    """A url's host in lower case; empty for a null or malformed one."""
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def _added(table: pa.Table, names: tuple[str, ...]) -> pa.Table:
    """All wrappers of a group as one, aligned in the order of their content."""
    got: Node | None = None
    for text in sorted(table.column("wrapper").to_pylist()):
        own = Node.unpacked(json.loads(text))
        got = own if got is None else aligned(got, own)
    return pa.table({**{n: table.column(n)[:1] for n in names}, "wrapper": [json.dumps(got.packed(), separators=(",", ":"))]})


def infer(pages: DataFrame, url: str = "url", page: str = "html", spread: int = 64) -> DataFrame:
    """Rows (host, wrapper, expression, rules): each host's wrapper over all of its pages that are not null or empty.

    Pages of equal form are added up in their batch, then in `spread` parts, then altogether: sums, minima and intersections,
    in any order. A host's forms are then aligned FAN_IN at a time, dealt by a hash of the form, level by level.
    """

    def work(batch: pa.RecordBatch):
        found: dict[tuple[str, int], Node] = {}
        for u, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if text:
                own = page_wrapper(text)
                at = host_of(u), xxhash.xxh64_intdigest(own.form().encode("utf-8", "replace")) >> 1
                found[at] = aligned(found[at], own) if at in found else own
        keys = sorted(found)
        wrappers = [json.dumps(found[k].packed(), separators=(",", ":")) for k in keys]
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()), pa.array(wrappers, pa.string())], ["host", "at", "wrapper"])

    def finish(batch: pa.RecordBatch):
        nodes = [Node.unpacked(json.loads(w)) for w in batch.column(1).to_pylist()]
        made = [(expression(x), json.dumps(rules(x), separators=(",", ":"))) for x in nodes]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([e for e, _ in made], pa.string()), pa.array([r for _, r in made], pa.string())], ["host", "wrapper", "expression", "rules"])

    schema = "host string, at long, wrapper string"
    partial = common.arrow_map(pages.select(F.col(url).alias("url"), F.col(page).alias("html")), work, schema)
    parts = partial.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(spread))).groupBy("host", "at", "part").applyInArrow(lambda t: _added(t, ("host", "at")), schema)
    forms = common.stored(parts.groupBy("host", "at").applyInArrow(lambda t: _added(t, ("host", "at")), schema))
    while True:
        counts = common.stored(forms.groupBy(F.col("host").alias("_host")).agg(F.count(F.lit(1)).alias("n")))
        if (counts.agg(F.max("n").alias("n")).first()["n"] or 1) <= 1:
            common.discard(counts)
            break
        dealt = forms.join(counts, F.col("host") == F.col("_host")).select("host", F.pmod("at", F.ceil(F.col("n") / FAN_IN)).alias("at"), "wrapper")
        after = common.stored(dealt.groupBy("host", "at").applyInArrow(lambda t: _added(t, ("host", "at")), schema))
        common.discard(forms, counts)
        forms = after
    return common.arrow_map(forms.select("host", "wrapper"), finish, "host string, wrapper string, expression string, rules string")


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html", most_broadcast: int = 32 << 20) -> DataFrame:
    """Rows (key, url, text), one for each row of pages: the article's blocks joined by line feeds.

    Null and empty pages have an empty text. Pages without a host share the wrapper of the empty host. Repeated rows and null
    keys each give a row; equal pages count as one where pages are compared. Up to most_broadcast bytes the hosts' rules are
    broadcast; beyond, pages and rules meet in a shuffled join.
    """
    found = common.stored(infer(pages, url, page).select(F.col("host").alias("_host"), "rules"))
    plain = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(page).alias("html"))

    def with_host(batch: pa.RecordBatch):
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([host_of(u) for u in batch.column(1).to_pylist()], pa.string())], ["key", "url", "html", "host"])

    def work(batch: pa.RecordBatch):
        texts = [main_text(p, r) if p else "" for p, r in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["key", "url", "text"])

    kind = pages.schema[key].dataType.simpleString()
    hosted = common.arrow_map(plain, with_host, f"key {kind}, url string, html string, host string")
    few = (found.agg(F.sum(F.length("_host") + F.length("rules")).alias("n")).first()["n"] or 0) <= most_broadcast
    joined = hosted.join(F.broadcast(found) if few else found, F.col("host") == F.col("_host"), "left").select("key", "url", "html", "rules")
    return common.arrow_map(joined, work, f"key {kind}, url string, text string").withColumnRenamed("key", key)
