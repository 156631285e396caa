"""HTML extraction: wrappers inferred as union-free regular expressions from the pages of a host.

A page is a stream of tokens: the opening and closing tags of its blocks, and the texts between them (markup inside a
block is part of its text). A wrapper is a union-free regular expression over such tokens, kept as the nested groups
that it is: fixed texts, text slots, optional groups (e)? and repeated groups (e)+. It starts as one page, in which
neighbouring elements with the same tag have become a repeated group, and is aligned with the next page, one after the
other. Two unequal texts become a slot. At a mismatch, what can be skipped on one side to meet the other again becomes
an optional group. A group also holds how much text, and how much of it linked, all its instances had, over how many
pages, and the digest of its text while that is the same on all of them.

What a page says is read off the wrapper. Text that stands in slots is the pages' own; text that is the same on all
pages is the template's. The content is the article element with most text in slots, and without one the element that
is reached from the top as long as one part of the layout holds most of that text and hardly any stands beside it; a
headline beside that part counts as content too. Of every page of the template the blocks there are emitted, in page
order, without parts whose whole text is the template's. A page on which nothing or next to nothing is found there, or
which is alone on its host, uses its own best element.

A group is known by its tag, its place and those words of its class and id that are no page's own: a word that under
three pages of a host have (on a host of two pages: one) counts as varying and is masked, and so are long numbers. Ids
that differ by page thus never keep two pages' parts apart.

Never content are the elements that HTML has for other things (navigation, forms, scripts, ...), by tag or role. Names
are evidence only. Containers named after adverts, reader comments and the like (STRONG) weigh nothing when the content
is looked for, unless that would leave hardly any text, and are not emitted. Names that articles use too (WEAK: notice,
search, menu, ...) decide on a page alone; inside the content such a part goes only if the wrapper has its text as the
template's, or if at least half of it is links. Names never tell of a paragraph, a heading, a list item or a quotation.

Fitting takes all pages of a host, whole. Pages of a host with the same skeleton of containers are one template with a
wrapper of its own; skeletons of under TEMPLATE pages are fitted together, or with the host's largest. Wrappers of about CHUNK pages are merged, then
wrappers of these, so a host with a third of all pages is no burden. What stands deeper than DEEP blocks counts as text
of the block there. In lists of over WIDE groups those that under one in RARE pages have are put together by their values;
no group, text or count is dropped. Fitting and extraction take every whole page, one by one; neighbours are merged
in pairs, so a page of n blocks takes n log n steps at most.

Defined cases: null or empty html has an empty text; broken html (unclosed or stray tags, any depth) is read like a
browser would, as far as blocks are concerned; repeated rows get the same result; null urls form one host; an empty
table gives no row; other columns are ignored and may have any name.
"""

from __future__ import annotations

import hashlib
import html as _html
import json
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from operator import add

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import discard, stored
from millrace.llm.url_reputation import host_of

#: Wrappers that are merged at once, on average.
CHUNK = 16
DEEP = 64
RARE, WIDE = 32, 1024
#: Share of a page's text, without the template's, below which what a wrapper finds on it is not trusted.
LITTLE = 0.1
#: Pages that a template needs, and that a text must be the same on to count as the template's inside the content.
TEMPLATE = 3

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.S)
_RAW = {k: re.compile(rf"</{k}\s*>", re.I) for k in ("script", "style", "textarea", "title", "template", "noscript", "svg", "iframe")}
_ATTR = re.compile(r"([A-Za-z_:][-A-Za-z0-9_:.]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")

#: A slash that ends an attribute's value without quotes, not an element.
_SLASHED = re.compile(r"=\s*[^\s\"'>]*/$")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never content.
NEVER = frozenset("script style noscript template svg iframe object head title nav footer aside form button select option textarea input label dialog menu canvas audio video map".split())
#: Elements that end a block at either edge.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Opening one of these closes an open one of the same list, within the nearest container.
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_HOLDS = frozenset("article aside blockquote body details div dl fieldset figure footer form header main nav ol section table tbody td th ul".split())
#: Names of what is never part of an article, and names of boilerplate that articles use too.
STRONG = "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus gdpr masthead modal nav navbar navigation newsletter pagination pager popup promo promoted reader-comments replies respond share sharing sidebar sidebars social sponsor sponsored subscribe subscription toolbar topbar widget"
WEAK = "footer form header menu notice notices related search"


def _named(words: str) -> re.Pattern:
    return re.compile(rf"(?:^|[\s_-])(?:{'|'.join(words.split())})(?:$|[\s_-])", re.I)


_STRONG_NAME, _WEAK_NAME = _named(STRONG), _named(WEAK)
#: Elements that their names can tell to be boilerplate.
_NAMED = frozenset("address center details div dl figure ol section table ul".split())
#: Names that would match but belong to the content.
_GOOD_NAME = re.compile(r"(?:article|content|entry|post|story)[_-]?(?:header|heading)", re.I)
_BAD_ROLE = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
#: What numbers a page in a name; shorter numbers tell parts of a layout apart.
_NUMBER = re.compile("[0-9]{3,}")
#: Parts of a layout, which content is looked for in.
_LAYOUT = frozenset("#root html body article main section div center table tbody tr td".split())


@dataclass(eq=False)
class Node:
    """An element. parts: texts and child nodes, in page order. It does not know its parent, so that no page outlives its turn."""

    tag: str
    name: str = ""  # class and id, for the rules
    role: str = ""
    under: str = ""  # its parent's tag
    within: bool = False  # it stands in an article or main element
    parts: list = field(default_factory=list)

    def never(self) -> bool:
        """Boilerplate by tag or role."""
        if self.tag in NEVER or self.role in _BAD_ROLE:
            return True
        if self.tag == "header":  # a page's header; an article's own header holds its title
            return self.under not in ("article", "main")
        return False

    def boilerplate(self) -> bool:
        """By tag, role or name: what there is to go by on a page alone."""
        if self.never():
            return True
        if not self.name or self.tag not in _NAMED:
            return False
        name = _GOOD_NAME.sub("", self.name)
        return bool(_STRONG_NAME.search(name) or _WEAK_NAME.search(name) and not (self.within and not linked(self)))

    def left_out(self) -> bool:
        """Inside the content that a wrapper has told."""
        if self.never():
            return True
        if not self.name or self.tag not in _NAMED:
            return False
        name = _GOOD_NAME.sub("", self.name)
        return bool(_STRONG_NAME.search(name) or _WEAK_NAME.search(name) and linked(self))


def linked(node: Node) -> bool:
    """Whether at least half of an element's text is in links."""
    chars = links = 0
    walk = [(node, node.tag == "a")]
    while walk:
        here, within = walk.pop()
        for p in here.parts:
            if isinstance(p, str):
                n = len(p.strip())
                chars, links = chars + n, links + n * within
            elif p.tag not in ("script", "style"):
                walk.append((p, within or p.tag == "a"))
    return 2 * links >= chars


class _Open:
    """The open elements while a page is read: for each tag, and for the tags that end a search, where they stand."""

    def __init__(self, root: Node):
        self.stack, self.tags, self.at = [root], [root.tag], {}
        self.holds: list[int] = []
        self.strict: list[int] = []  # those that even a cell or an item does not reach beyond

    def push(self, node: Node, tag: str) -> None:
        """tag: as it was written; a hidden element is one that is never content."""
        k = len(self.stack)
        self.stack.append(node)
        self.tags.append(tag)
        self.at.setdefault(tag, []).append(k)
        if tag in _HOLDS:
            self.holds.append(k)
            if tag not in ("td", "th", "tbody"):
                self.strict.append(k)

    def close(self, k: int) -> None:
        """Close the element at k and all in it."""
        while len(self.stack) > k:
            i = len(self.stack) - 1
            self.stack.pop()
            self.at[self.tags.pop()].pop()
            for marks in (self.holds, self.strict):
                if marks and marks[-1] == i:
                    marks.pop()

    def last(self, tags, above: int) -> int | None:
        """The outermost of the innermost open elements of these tags that stand above a place."""
        best = None
        for t in tags:
            own = self.at.get(t)
            if own and own[-1] > above and (best is None or own[-1] < best):
                best = own[-1]
        return best


def parse(text: str) -> Node:
    """The tree of a page, read leniently."""
    root = Node("#root")
    at, low, opened = 0, len(text), _Open(root)
    while at < low:
        here = opened.stack[-1]
        m = _TOKEN.search(text, at)
        if m is None:
            here.parts.append(text[at:])
            break
        if m.start() > at:
            here.parts.append(text[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                here.parts.append(m[0][9:].removesuffix("]]>"))
            continue
        tag, rest = m[2].lower(), m[3] or ""
        if m[1]:
            # a stray closing tag does not end a container
            held = opened.holds[-1] if opened.holds and tag not in _HOLDS and tag not in ("html", "body") else 0
            if (k := opened.last((tag,), held)) is not None:
                opened.close(k)
            continue
        if tag in BLOCK and tag not in ("html", "body"):
            # an open paragraph ends where a block begins
            if (k := opened.last(("p",), opened.holds[-1] if opened.holds else 0)) is not None:
                opened.close(k)
        if tag in _CLOSES:
            if (k := opened.last(_CLOSES[tag], opened.strict[-1] if opened.strict else 0)) is not None:
                opened.close(k)
        here = opened.stack[-1]
        attrs = {a[1].lower(): _html.unescape(a[2] or a[3] or a[4] or "") for a in _ATTR.finditer(rest)} if rest.strip(" /") else {}
        hidden = "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower()
        node = Node("noscript" if hidden and tag not in VOID else tag, f"{attrs.get('class', '')} {attrs.get('id', '')}".strip(), attrs.get("role", "").lower(), here.tag, here.within or here.tag in ("article", "main"))
        here.parts.append(node)
        if tag in _RAW:
            end = _RAW[tag].search(text, at)
            node.parts.append(text[at : end.start()] if end else text[at:])
            at = end.end() if end else low
        elif tag not in VOID and (not rest.endswith("/") or _SLASHED.search(rest)):
            opened.push(node, tag)
    return root


def _plain(text: str) -> str:
    """Character references decoded, runs of white space one space, none at the edges."""
    return " ".join((_html.unescape(text) if "&" in text else text).split())


def blocks(node: Node, without: frozenset[int] = frozenset(), out_of: Callable[[Node], bool] = Node.boilerplate) -> list[str]:
    """The blocks of text in a node, without boilerplate, in page order. White space within a block is one space.

    without: identities of further nodes to leave out. out_of: what tells boilerplate.
    """
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = _plain("".join(run))
        run.clear()
        if text:
            out.append(text)

    stack: list = [(node, 0)]
    while stack:
        here, k = stack.pop()
        if k == 0 and here.tag in BLOCK:
            flush()
        while k < len(here.parts):
            part = here.parts[k]
            k += 1
            if isinstance(part, str):
                run.append(part)
            elif part.tag == "br":
                run.append(" ")
            elif id(part) not in without and not out_of(part):
                stack.append((here, k))
                stack.append((part, 0))
                break
            elif part.tag in BLOCK:
                flush()
        else:
            if here.tag in BLOCK:
                flush()
    flush()
    return out


# -- wrappers ---------------------------------------------------------------------------------------------------------

TEXT = "#text"


class Group:
    """A block element or a text of a wrapper.

    value: its tag with class, id and role, or TEXT. kind: "" (once), "?" (optional), "+" (repeated) or "*" (both).
    digest: of its whole text, None where that differs (then a text is a slot). pages: how many it was seen on. chars
    and links: the characters of all its instances' text, and those in links. items: the groups in it, in order.
    """

    __slots__ = ("chars", "digest", "items", "kind", "links", "node", "own", "pages", "value")

    def __init__(self, value: str, kind: str = "", digest: str | None = "", pages: int = 1, chars: int = 0, links: int = 0, items: list[Group] | None = None, node: Node | None = None):
        self.value, self.kind, self.digest, self.pages, self.chars, self.links, self.items, self.node = value, kind, digest, pages, chars, links, items or [], node
        self.own = 0.0

    @property
    def tag(self) -> str:
        return self.value.partition(" ")[0]

    def named(self) -> bool:
        """Whether its name says that it is boilerplate."""
        tag, _, name = self.value.partition(" ")
        name = _GOOD_NAME.sub("", name)
        return bool(name) and tag in _NAMED and bool(_STRONG_NAME.search(name) or _WEAK_NAME.search(name))


def _digest(parts: list[str]) -> str:
    return hashlib.md5(" ".join(parts).encode("utf-8", "replace")).hexdigest()[:16]


def stream(root: Node) -> Group:
    """A page as groups, nothing repeated or optional yet, each with its node."""
    top = Group("#root", node=root)
    stack: list = [(root, 0, top, False)]  # node, next part, the group its text goes to, inside a link
    run: list[tuple[str, bool]] = []
    deep = 0

    def flush(to: Group) -> None:
        if not run:
            return
        text = _plain("".join(x for x, _ in run))
        if text:
            inside = [x for x, inside in run if inside]
            linked = min(len(text), len(_plain("".join(inside)))) if inside else 0
            to.items.append(Group(TEXT, digest=_digest([text]), chars=len(text), links=linked))
        run.clear()

    while stack:
        here, k, to, linked = stack.pop()
        while k < len(here.parts):
            part = here.parts[k]
            k += 1
            if isinstance(part, str):
                run.append((part, linked))
            elif part.tag == "br":
                run.append((" ", linked))
            elif part.tag in VOID or part.never():
                if part.tag in BLOCK:
                    flush(to)
            else:
                stack.append((here, k, to, linked))
                if part.tag in BLOCK and deep < DEEP:
                    flush(to)
                    deep += 1
                    name = _NUMBER.sub("#", part.name)
                    to.items.append(Group(f"{part.tag} {name} {part.role}".strip(), node=part))
                    stack.append((part, 0, to.items[-1], False))
                else:
                    stack.append((part, 0, to, linked or part.tag == "a"))
                break
        else:
            if here is to.node:  # its end: what it holds is known
                flush(to)
                deep -= 1
                to.digest, to.chars, to.links = _digest([x.digest for x in to.items]), sum(x.chars for x in to.items), sum(x.links for x in to.items)
    return top


def masked(value: str, varying: frozenset[str]) -> str:
    """A group's value without the words that vary between the pages of its host."""
    tag, _, rest = value.partition(" ")
    if not rest or tag == TEXT:
        return value
    words = [w for w in rest.split() if w not in varying]
    return " ".join([tag, *words, *["~"] * (len(words) < len(rest.split()))])


def fold(page: Group, varying: frozenset[str] = frozenset()) -> Group:
    """Repeated groups within one page: neighbours of the same value become one (e)+, from the inside out.

    A run of neighbours is merged in pairs, then pairs of these, so that no growing group is merged again and again.
    """
    runs: list[list[Group]] = []
    for x in page.items:
        x = fold(x, varying) if x.value != TEXT else x
        if runs and runs[-1][0].value == x.value != TEXT:
            runs[-1].append(x)
        else:
            runs.append([x])
    for run in runs:
        while len(run) > 1:
            run[:] = [merge(*run[k : k + 2], True) if k + 1 < len(run) else run[k] for k in range(0, len(run), 2)]
    return Group(masked(page.value, varying), page.kind, page.digest, page.pages, page.chars, page.links, [r[0] for r in runs])


_BOTH = {frozenset(k): v for k, v in ((("",), ""), (("?",), "?"), (("+",), "+"), (("*",), "*"), (("", "?"), "?"), (("", "+"), "+"), (("", "*"), "*"), (("?", "+"), "*"), (("?", "*"), "*"), (("+", "*"), "*"))}


def merge(a: Group, b: Group, within: bool = False, count: Callable[[int, int], int] = add) -> Group:
    """The wrapper of two groups of the same value: of two pages, or of two neighbours within one. count: of their pages."""
    kind = _BOTH[frozenset((a.kind, b.kind))]
    if within:
        digest, pages, kind = _digest([a.digest, b.digest]) if a.digest and b.digest else None, max(a.pages, b.pages), "*" if "?" in kind or "*" in kind else "+"
        if a.value == TEXT:
            kind = ""
    else:
        digest, pages = a.digest if a.digest == b.digest else None, count(a.pages, b.pages)
    return Group(a.value, kind, digest, pages, a.chars + b.chars, a.links + b.links, _aligned(a.items, b.items, within, count))


def _places(items: list[Group]) -> dict[str, list[int]]:
    out: dict[str, list[int]] = {}
    for k, x in enumerate(items):
        out.setdefault(x.value, []).append(k)
    return out


def _next(places: dict[str, list[int]], value: str, after: int) -> int | None:
    own = places.get(value, ())
    k = bisect_right(own, after)
    return own[k] if k < len(own) else None


def _aligned(a: list[Group], b: list[Group], within: bool, count: Callable[[int, int], int] = add) -> list[Group]:
    """Two lists of groups as one: what is skipped on either side to meet the other again is optional."""
    if not a and not b:
        return []
    at_a, at_b = _places(a), _places(b)
    out: list[Group] = []
    i = j = 0
    while i < len(a) and j < len(b):
        if a[i].value == b[j].value:
            out.append(merge(a[i], b[j], within, count))
            i, j = i + 1, j + 1
            continue
        di, dj = _next(at_a, b[j].value, i), _next(at_b, a[i].value, j)
        if di is not None and (dj is None or di - i <= dj - j):
            out += map(_optional, a[i:di])
            i = di
        elif dj is not None:
            out += map(_optional, b[j:dj])
            j = dj
        else:
            out += (_optional(a[i]), _optional(b[j]))
            i, j = i + 1, j + 1
    return [*out, *map(_optional, a[i:]), *map(_optional, b[j:])]


def _optional(x: Group) -> Group:
    return Group(x.value, {"": "?", "+": "*"}.get(x.kind, x.kind), x.digest, x.pages, x.chars, x.links, x.items)


def joined(wrappers: list[Group]) -> Group:
    """The wrapper of some wrappers. In very long lists the groups that hardly any page has are put together by value."""
    out = wrappers[0]
    for w in wrappers[1:]:
        out = merge(out, w)

    def common(x: Group) -> Group:
        if len(x.items) > WIDE:
            x.items = gathered(x.items, out.pages)
        x.items = [common(y) for y in x.items]
        return x

    return common(out)


def gathered(items: list[Group], pages: int) -> list[Group]:
    """A list of groups in which those that under one in RARE pages have are one group for each value: nothing is left out.

    Their order is given up, which neither the ways to the content nor its parts depend on. The template's groups, whose
    text is the same on TEMPLATE pages, stay what they are. The list is then as long as its values, not its pages, are many.
    """
    kept: list[Group] = []
    rare: dict[tuple[str, str | None], list[Group]] = {}
    for x in items:
        if x.pages * RARE >= pages:
            kept.append(x)
            continue
        key = x.value, x.digest if x.digest and x.pages >= TEMPLATE else None
        if key not in rare:
            rare[key] = own = []
            kept.append(own)  # the place of the first
        rare[key].append(x)
    out: list[Group] = []
    for x in kept:
        run = [x] if isinstance(x, Group) else x
        while len(run) > 1:  # in pairs: no growing group is merged again and again
            run = [apart(*run[k : k + 2]) if k + 1 < len(run) else run[k] for k in range(0, len(run), 2)]
        out.append(run[0])
    return out


def apart(a: Group, b: Group) -> Group:
    """Two groups of the same value that may stand on the same pages or on others: they have as many as either, for certain."""
    out = merge(a, b, count=max)
    out.kind = "*" if a.digest != b.digest and a.value != TEXT else out.kind
    return out


def infer(pages: list[str]) -> Group:
    """The wrapper of some pages of one host."""
    streams = [stream(parse(page)) for page in pages]
    met: dict[str, int] = {}
    for x in streams:
        for w in words_of(x):
            met[w] = met.get(w, 0) + 1
    varying = frozenset(w for w, k in met.items() if k < min(KNOWN, len(pages)))
    return joined([fold(x, varying) for x in streams])


def packed(wrapper: Group) -> str:
    def plain(x: Group) -> list:
        return [x.value, x.kind, x.digest, x.pages, x.chars, x.links, [plain(y) for y in x.items]]

    return json.dumps(plain(wrapper), separators=(",", ":"))


def unpacked(text: str) -> Group:
    def back(x: list) -> Group:
        return Group(*x[:6], [back(y) for y in x[6]])

    return back(json.loads(text))


def expression(x: Group) -> str:
    """The wrapper as a regular expression over tags, fixed texts (their digests) and slots."""
    if x.value == TEXT:
        inner = "slot" if x.digest is None else f"'{x.digest}'"
        return f"({inner}){x.kind}" if x.kind else inner
    inner = f"<{x.value}>{''.join(map(expression, x.items))}</{x.tag}>"
    return f"({inner}){x.kind}" if x.kind else inner


def words_of(page: Group) -> set[str]:
    """The words of all names of a page, as they are known by."""
    out: set[str] = set()
    walk = [page]
    while walk:
        here = walk.pop()
        for x in here.items:
            if x.value != TEXT:
                out.update(x.value.split()[1:])
                walk.append(x)
    return out


def skeleton(page: Group, varying: frozenset[str] = frozenset()) -> str:
    """A digest of a page's containers: their tags and the words of their names that do not vary, with the way to each."""
    ways: set[str] = set()
    walk = [(page, "", 0)]
    while walk:
        here, way, depth = walk.pop()
        for x in here.items:
            if x.tag in ("html", "body", "div", "main", "article", "section") and not x.named():
                on = f"{way}/{masked(x.value, varying)}"
                ways.add(on)
                if depth < 5:
                    walk.append((x, on, depth + 1))
    return hashlib.md5("\n".join(sorted(ways)).encode("utf-8", "replace")).hexdigest()


def _weigh(x: Group, names: bool = True) -> float:
    """The text of a group that is the pages' own: in slots, outside links, and not the same on all pages. Kept in own.

    names: containers whose names say boilerplate count nothing.
    """
    if x.digest is not None and x.pages > 1 or names and x.named():
        x.own = 0.0
        for y in x.items:
            _weigh(y, names)
        if names and x.named():
            _emptied(x)
    elif x.value == TEXT:
        x.own = float(x.chars - x.links)
    else:
        x.own = sum(_weigh(y, names) for y in x.items)
    return x.own


def _emptied(x: Group) -> None:
    x.own = 0.0
    for y in x.items:
        _emptied(y)


def content(wrapper: Group) -> tuple[list[str], list[str]]:
    """(ways to the content, parts in it that are the template's), each as a string, read off a wrapper.

    A way is the values on the way from the top, a line each; a part is its value and the digest of its text.
    """
    own = _weigh(wrapper, False)
    if own <= 0:
        return [], []  # all pages say the same
    if _weigh(wrapper) < LITTLE * own:
        _weigh(wrapper, False)  # names that would leave nothing tell nothing
    articles: list[tuple[float, int, tuple[str, ...], Group]] = []
    walk: list[tuple[Group, tuple[str, ...]]] = [(wrapper, ())]
    while walk:
        here, way = walk.pop()
        for x in here.items:
            on = (*way, x.value)
            if x.tag == "article" and x.own > 0:
                articles.append((x.own, -len(articles), on, x))
            elif x.value != TEXT:
                walk.append((x, on))
    if articles:
        _, _, way, found = max(articles, key=lambda t: t[:2])
        ways, tops = [way], [found]
    else:
        here, way, ways, tops = wrapper, (), [], []
        while True:
            parts = [x for x in here.items if x.tag in _LAYOUT]
            best = max(parts, key=lambda x: x.own, default=None)
            beside = sum(x.own for x in here.items if x.tag not in _LAYOUT and x.tag != "h1")
            if best is None or best.own <= 0 or best.own < (0.8 if best.tag in ("table", "tbody", "tr", "td") else 0.5) * here.own or beside > 0.1 * here.own:
                break
            heads = [(*way, x.value) for x in here.items if x.tag == "h1" and x.own > 0]
            if heads and here.tag not in ("#root", "html", "body"):
                break
            ways += heads
            here, way = best, (*way, best.value)
        ways, tops = [*ways, way] if way else [], [here]
    fixed: set[str] = set()
    _weigh(wrapper, False)
    for top in tops:
        walk = [(top, ())] if top.own >= 0.7 * max(1, top.chars - top.links) else []
        while walk:
            here, _ = walk.pop()
            for x in here.items:
                if x.tag in _NAMED and x.kind in ("", "?") and x.digest and x.chars and x.pages >= TEMPLATE:
                    fixed.add(f"{x.value}\n{x.digest}")
                elif x.value != TEXT:
                    walk.append((x, ()))
    return ["\n".join(w) for w in ways], sorted(fixed)


def site_parts(wrapper: Group) -> list[str]:
    """The largest parts that are the same wherever they stand, on TEMPLATE pages or more: a value and a digest each."""
    out: set[str] = set()
    walk = [wrapper]
    while walk:
        for x in walk.pop().items:
            if x.value != TEXT and x.digest and x.chars and x.pages >= TEMPLATE:
                out.add(f"{x.value}\n{x.digest}")
            else:
                walk.append(x)
    return sorted(out)


def _length(found: list[str]) -> int:
    return sum(map(len, found))


def best_elements(root: Node) -> list[Node]:
    """By the page alone: the longest article with the articles beside it, or main; else down while one child holds nearly all the text."""
    size: dict[int, int] = {}  # the characters of text in each element outside boilerplate
    order: list[Node] = []
    walk = [root]
    while walk:
        n = walk.pop()
        order.append(n)
        walk += [p for p in n.parts if not isinstance(p, str) and not p.boilerplate()]
    for n in reversed(order):
        size[id(n)] = sum(len(p.strip()) if isinstance(p, str) else size.get(id(p), 0) for p in n.parts)
    named = [n for n in order if n.tag in ("article", "main") or n.role == "main"]
    tops = [n for n in named if n.tag == "article"] or named
    if tops:
        best = max(tops, key=lambda n: size[id(n)])
        beside = next((n.parts for n in order if any(p is best for p in n.parts)), [best])
        return [p for p in beside if not isinstance(p, str) and p.tag == "article" and id(p) in size] if best.tag == "article" else [best]
    here = root
    while True:
        below = [p for p in here.parts if not isinstance(p, str) and p.tag in _HOLDS | {"html"} and id(p) in size]
        best = max(below, key=lambda p: size[id(p)], default=None)
        if any(not isinstance(p, str) and p.tag == "h1" for p in here.parts) and here.tag not in ("html", "body"):
            return [here]
        if best is None or size[id(best)] < 0.75 * max(1, size[id(here)]):
            return [here]
        here = best


def extract(page: str | None, ways: list[str] | None = None, fixed: list[str] | None = None, varying: list[str] | None = None, site: list[str] | None = None) -> str:
    """The main text of a page: its blocks joined by an empty line.

    ways and fixed: what `content` read off the wrapper, site: what `site_parts` did. varying: the words of names that
    this page's host does not share.
    """
    if not page:
        return ""
    root = parse(page)
    found: list[str] = []
    if ways is not None and len(ways):
        wanted, without = {tuple(w.split("\n")) if w else () for w in ways}, frozenset(fixed if fixed is not None else ())
        mask = frozenset(varying if varying is not None else ())
        met: list[Node] = []
        left: set[int] = set()
        top, known = stream(root), frozenset(site if site is not None else ())
        own = top.chars
        walk: list[tuple[Group, tuple[str, ...] | None]] = [(top, ())]  # None: inside the content
        while walk:
            here, way = walk.pop()
            if way in wanted:
                met.append(here.node)
                way = None
            elif way is None and f"{masked(here.value, mask)}\n{here.digest}" in without:
                left.add(id(here.node))
            elif way and f"{masked(here.value, mask)}\n{here.digest}" in known:
                own -= here.chars  # the template's, and what it holds with it
                continue
            walk += [(x, None if way is None else (*way, masked(x.value, mask))) for x in reversed(here.items) if x.value != TEXT]
        for node in met:
            found += blocks(node, frozenset(left), Node.left_out)
        if _length(found) < LITTLE * own:
            alone = [x for n in best_elements(root) for x in blocks(n)]
            if LITTLE * _length(alone) > _length(found):
                found = alone
    if not found:
        found = [x for n in best_elements(root) for x in blocks(n)]
    if not found:  # all of it is named like boilerplate
        found = blocks(root, out_of=Node.never)
    return "\n\n".join(found)


#: Pages of a host that must have a word of a class or id for it to be known by.
KNOWN = 3

_NAMES = r"""(?i)\b(?:class|id)\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)"""


def names_of(html: Column) -> Column:
    """The distinct words of all classes and ids of a page, as they are known by."""
    said = F.array_join(F.regexp_extract_all(html, F.lit(_NAMES), F.lit(1)), " ")
    return F.array_remove(F.array_distinct(F.split(F.regexp_replace(F.translate(said, "\"'", "  "), "[0-9]{3,}", "#"), r"\s+")), "")


@F.pandas_udf(T.StringType())
def _read(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in parts:
        yield pd.Series([packed(stream(parse(x))) for x in part], dtype="object")


@F.pandas_udf(T.StructType([T.StructField("skeleton", T.StringType()), T.StructField("w", T.StringType())]))
def _folded(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for streams, words in parts:
        rows = []
        for x, v in zip(streams, words, strict=True):
            page, varying = unpacked(x), frozenset(v if v is not None else ())
            rows.append((skeleton(page, varying), packed(fold(page, varying))))
        yield pd.DataFrame(rows, columns=["skeleton", "w"], dtype="object")


@F.pandas_udf(T.StringType())
def _merged(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in parts:
        yield pd.Series([packed(joined([unpacked(w) for w in ws])) if len(ws) > 1 else ws[0] for ws in part], dtype="object")


@F.pandas_udf(T.StructType([T.StructField("ways", T.ArrayType(T.StringType())), T.StructField("fixed", T.ArrayType(T.StringType())), T.StructField("site", T.ArrayType(T.StringType()))]))
def _content(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for part in parts:
        yield pd.DataFrame([(*content(w), site_parts(w)) for w in map(unpacked, part)], columns=["ways", "fixed", "site"])


def _page_key(url: Column, html: Column) -> Column:
    return F.md5(F.concat_ws("\x01", F.coalesce(url, F.lit("")), html))


def varying_words(names: DataFrame) -> DataFrame:
    """(page, varying) from (host, page, names) of distinct pages: the words of a page's names that its host does not share.

    Such a word is on KNOWN - 1 = 2 pages at most, which are the smallest and the largest that have it: no join is needed
    to find them again. On a host of two pages a word that both have is shared.
    """
    met = names.select("host", "page", F.explode("names").alias("word")).groupBy("host", "word").agg(F.count("*").alias("k"), F.min("page").alias("a"), F.max("page").alias("b")).where(f"k < {KNOWN}")
    met = stored(met, "wrapper-words")
    pairs = names.groupBy("host").agg(F.count("*").alias("pages")).where("pages = 2").select(F.col("host").alias("h2"))
    twice = met.where("k = 2").join(pairs, F.col("host").eqNullSafe(F.col("h2")), "left_anti")
    each = met.where("k = 1").select(F.col("a").alias("page"), "word").unionByName(twice.select(F.explode(F.array("a", "b")).alias("page"), "word"))
    out = stored(each.groupBy("page").agg(F.collect_set("word").alias("varying")), "wrapper-varying")  # words of one page
    discard(met)
    return out


def wrappers(pages: DataFrame) -> DataFrame:
    """(page, ways, fixed, varying, site): for each distinct page, by its key, what `content` reads off its template's wrapper.

    Written to the shared folder. Skeletons of few pages are fitted together, or with the largest; each has what that wrapper says.
    """
    p = pages.where(F.col("html").isNotNull() & (F.col("html") != "")).select(host_of(F.col("url")).alias("host"), _page_key(F.col("url"), F.col("html")).alias("page"), names_of(F.col("html")).alias("names"), _read("html").alias("x"))
    raw = stored(p, "wrapper-read")
    read = raw.dropDuplicates(["page"])
    varying = varying_words(read.select("host", "page", "names"))
    own = read.select("host", "page", "x").join(varying.withColumnRenamed("page", "p2"), F.col("page") == F.col("p2"), "left").select("host", "page", "varying", _folded("x", "varying").alias("r"))
    own = stored(own.select("host", "page", "varying", "r.skeleton", "r.w", F.xxhash64("r.w").alias("h")), "wrapper-pages")
    discard(raw)
    # pages often fold to the same wrapper: it is merged once
    kinds = own.groupBy("host", "skeleton", "h", "w").agg(F.count("*").alias("pages"))
    sizes = kinds.groupBy("host", "skeleton").agg(F.count("*").alias("k"), F.sum("pages").alias("pages"))
    # under TEMPLATE pages of a skeleton join the others of that kind, and if these are too few the host's largest template
    hosts = sizes.groupBy("host").agg(F.sum(F.when(F.col("pages") < TEMPLATE, F.col("pages")).otherwise(0)).alias("few"), F.max_by("skeleton", F.struct("pages", "skeleton")).alias("largest")).withColumnRenamed("host", "h2")
    template = F.when(F.col("pages") >= TEMPLATE, F.col("skeleton")).when(F.col("few") < TEMPLATE, F.col("largest")).otherwise("")
    names = sizes.join(hosts, F.col("host").eqNullSafe(F.col("h2"))).select("host", "skeleton", template.alias("template"), "k", "pages")
    sized = names.groupBy("host", "template").agg(F.sum("k").alias("k"), F.sum("pages").alias("pages"))
    names = stored(names.drop("k", "pages").join(sized.withColumnRenamed("host", "h2").withColumnRenamed("template", "t2"), (F.col("template") == F.col("t2")) & F.col("host").eqNullSafe(F.col("h2"))).select("host", "skeleton", "template", "k", "pages"), "wrapper-names")
    # one page has no wrapper: nothing in it can be told apart
    many = names.where("pages > 1").withColumnsRenamed({"host": "h2", "skeleton": "s2"})
    now = kinds.join(many.drop("pages"), (F.col("skeleton") == F.col("s2")) & F.col("host").eqNullSafe(F.col("h2"))).select("host", "template", "h", "w", "k")
    before = None
    while True:
        chunks = F.greatest(F.lit(1), F.ceil(F.col("k") / CHUNK)).cast("long")
        each = now.groupBy("host", "template", chunks.alias("k"), F.pmod("h", chunks).alias("h")).agg(F.sort_array(F.collect_list("w")).alias("ws"))
        now = stored(each.select("host", "template", F.xxhash64("h").alias("h"), _merged("ws").alias("w"), "k"), "wrapper-chunks")
        if before is not None:
            discard(before)
        before = now
        if not now.where("k > 1").limit(1).count():
            break
    found = now.select(F.col("host").alias("h2"), F.col("template").alias("t2"), _content("w").alias("c")).select("h2", "t2", "c.*")
    told = names.join(found, (F.col("template") == F.col("t2")) & F.col("host").eqNullSafe(F.col("h2"))).select(F.col("host").alias("h2"), F.col("skeleton").alias("s2"), "ways", "fixed", "site")
    each = own.select("host", "page", "skeleton", "varying").join(told, (F.col("skeleton") == F.col("s2")) & F.col("host").eqNullSafe(F.col("h2")))
    out = stored(each.select("page", "ways", "fixed", "varying", "site"), "wrappers")
    discard(now, names, own, varying)
    return out


def extract_pages(pages: DataFrame) -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars."""
    known = wrappers(pages)

    @F.pandas_udf("string")
    def run(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([extract(*x) for x in zip(*part, strict=True)], dtype="object")

    own = pages.select("page_id", "url", "html", _page_key(F.col("url"), F.coalesce("html", F.lit(""))).alias("own_page"))
    out = own.join(known, F.col("own_page") == F.col("page"), "left").select("page_id", "url", run("html", "ways", "fixed", "varying", "site").alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
