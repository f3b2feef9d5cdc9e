"""Main text of web pages by union-free wrappers.

The token stream of a page is a tree: elements, and between them blocks of text. For each host the streams of its
pages are aligned one after another into a wrapper, a regular expression without unions. Where streams differ in a
text, there is a text slot; a text that stays the same is a constant, which also tells alike siblings apart. Where
one has what the other lacks, an optional part; where alike siblings differ in number, a repeated part; where runs
of paragraphs, headings and lists differ in their order, a repeated group of optional parts. A single page proves
no repetition, so cells that stand once in the same order on all pages stay apart. Tasks make wrappers of the
pages they read, and wrappers of one host are aligned in the same way as pages are.

Each text slot gathers how many pages have it, how much text, how much of it in links, and how often its most
frequent text occurs. From that the plan decides which slots are the article's: elements that say that they are
content, or else the part of the wrapper that most of the text is in, without what is a menu by its links, of the
template by its sameness, or something else by its element. A page is then aligned with its host's wrapper, and its
text is what stands in kept slots.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from difflib import SequenceMatcher
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bytes_of, dealt_join, written

#: A slot's text is of the template if on so many pages, and this part of the slot's, it is the same, but for copies of pages.
TEMPLATE_PAGES, TEMPLATE_SHARE = 3, 0.5
#: A block or slot with a larger share of its text in links is a menu.
LINK_SHARE = 0.6
#: The article is looked for in content elements only if at least this part of the host's pages, and this part of its text, has one.
CONTENT_SHARE, CONTENT_TEXT = 0.5, 0.3
#: The part with so much of the text within the part around it has the article; one named as something else that has so much is it all the same.
MAIN_TEXT, NAMED_TEXT = 0.6, 0.5
#: Siblings are alike if their children's labels share so much.
ALIKE = 0.5
#: Most frequent texts that are counted for a slot; a text of more than one in FREQUENT + 1 of all is among them.
FREQUENT = 8
#: Wrappers of all hosts up to this size are broadcast; larger ones are joined by host. And hosts a task holds at once.
BROADCAST_BYTES, HELD_HOSTS = 16 << 20, 2000
#: Wrappers of a host are aligned in so many tasks first.
SALTS = 16
#: Elements nested deeper have no part of their own, but for those whose name the plan goes by.
DEPTH = 200

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript iframe noembed noframes template textarea title svg math object".split())
#: Of RAW, those that go to the end of the page if nothing ends them; the others without an end tag are read on from within.
ENDLESS = frozenset("script style textarea title iframe".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data dfn em font i img ins del kbd label mark nobr q ruby rt rp s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
#: Opening one of these closes an open one of the others of its kind, up to the element that holds both.
SIBLINGS = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select"), "thead": ("thead tbody tfoot tr td th", "table"), "tbody": ("thead tbody tfoot tr td th", "table"), "tfoot": ("thead tbody tfoot tr td th", "table")}
SIBLINGS = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in SIBLINGS.items()}
#: Elements that running text is made of, in any order.
FLOW = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote figure table address details hgroup dt dd".split())
HEADINGS = frozenset("h1 h2 hgroup".split())
#: Elements that an article may be within.
HOLDERS = frozenset("html body div section article main center form table tbody tr td th fieldset span".split())

# What elements and their class, id and role names say.
DROPPED = frozenset("head nav footer aside button select menu dialog input legend datalist".split())
CONTENT = frozenset("article main".split())
CONTENT_WORDS = frozenset("article main content post story entry body".split())
#: Names that say so wherever they stand in a name, and those that do only as its last word ("cookie-notice", not "notice-board").
DROPPED_WORDS = frozenset(
    "nav navbar navigation menu menubar footer sidebar aside complementary contentinfo ad ads advert adverts advertisement advertising promo promoted sponsor sponsored cookie cookies consent gdpr comment comments commentlist disqus replies sharing social related recommended breadcrumb breadcrumbs subscribe subscription newsletter signup login popup modal widget toolbar copyright disclaimer pagination pager".split()
)
DROPPED_LAST = frozenset("banner notice notices alert reply respond share overlay search tags skip".split())
HEADER_WORDS = frozenset("header masthead topbar".split())

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|</?[a-zA-Z][^>]*>|[^<]+|<""", re.DOTALL)
NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
NUMBER = re.compile(r"(?<=-)[0-9]+|(?<= )[0-9]+")


class Part:
    """A part of a page or wrapper: an element, a text ("#", "#a" for one mostly in links) or a group ("()").

    const is a hash of all its text if that is always the same; pages is how many have it. Of a text, blocks,
    characters, characters in links and the most frequent texts; on a page, at are the numbers of its blocks.
    """

    __slots__ = ("label", "inner", "repeated", "optional", "pages", "const", "blocks", "chars", "linked", "texts", "at", "flow")

    def __init__(self, label: str, inner: list[Part], const: int | None = None, pages: int = 1):
        self.label, self.inner, self.const, self.pages = label, inner, const, pages
        self.flow = label[0] in "#(" or label.partition(" ")[0] in FLOW
        self.repeated = self.optional = False
        self.blocks = self.chars = self.linked = 0
        self.texts: dict[int, int] = {}
        self.at: list[int] = []

    @property
    def tag(self) -> str:
        return self.label.partition(" ")[0]

    def dump(self, whole: bool = True) -> list:
        flags = self.repeated + 2 * self.optional
        if self.label[0] == "#":
            return [self.label, flags, self.pages, self.const, *([self.blocks, self.chars, self.linked, list(self.texts.items())] if whole else ())]
        return [self.label, flags, self.pages, self.const, [x.dump(whole) for x in self.inner]]

    @staticmethod
    def load(made: list) -> Part:
        text = made[0][0] == "#"
        part = Part(made[0], [] if text else [Part.load(x) for x in made[4]], made[3], made[2])
        part.repeated, part.optional = bool(made[1] & 1), bool(made[1] & 2)
        if text and len(made) > 4:
            part.blocks, part.chars, part.linked = made[4:7]
            part.texts = dict(map(tuple, made[7]))
        return part


def counted(into: dict[int, int], more: dict[int, int]) -> None:
    """Add counts of texts, keeping the most frequent ones: what is left out is taken off all, so none is overrated."""
    for key, n in more.items():
        into[key] = into.get(key, 0) + n
    if len(into) > FREQUENT:
        off = sorted(into.values(), reverse=True)[FREQUENT]
        for key in [k for k, n in into.items() if n <= off]:
            del into[key]
        for key in into:
            into[key] -= off


def _joined(a: Part, b: Part, same: bool = False, again: bool = False) -> Part:
    """b put into a, which stands for both from then on; same if they are of the same pages, again if they are siblings there."""
    a.pages = max(a.pages, b.pages) if same else a.pages + b.pages
    a.repeated, a.optional = a.repeated or b.repeated or again, a.optional or b.optional
    a.const = a.const if a.const == b.const else None
    if a.label != b.label:
        tag, *names = a.label.split(" ")
        every = {*b.label.split(" "), *unnumbered(b.label).split(" ")}
        a.label = " ".join((tag, *sorted({x for name in names for x in (name, unnumbered(name)) if x in every})))
    if a.label[0] == "#":
        a.blocks, a.chars, a.linked = a.blocks + b.blocks, a.chars + b.chars, a.linked + b.linked
        counted(a.texts, b.texts)
    elif a.label == "()":
        for x in b.inner:
            _put(a, x, same, again)
    else:
        a.inner = aligned(a.inner, b.inner, same)
    return a


def _put(group: Part, part: Part, same: bool, again: bool) -> None:
    """A part, or a group's parts, into a group of optional parts, one for each label."""
    if part.label == "()":
        for x in part.inner:
            _put(group, x, same, again)
        return
    for x in group.inner:
        if x.label == part.label:
            _joined(x, part, same, again)
            return
    part.optional = True
    group.inner.append(part)


def _ahead(a: Part, b: Part) -> bool:
    return a.const is not None and a.const == b.const and not a.repeated and not b.repeated


def _kinds(parts: list[Part]) -> list[int]:
    """Numbers of parts, equal for alike ones."""
    known: list[frozenset] = []
    made = []
    for part in parts:
        own = frozenset(x.label for x in part.inner)
        for k, other in enumerate(known):
            if own == other or len(own & other) >= ALIKE * len(own | other):
                made.append(k)
                break
        else:
            made.append(len(known))
            known.append(own)
    return made


Pairs = list[tuple[list[Part], list[Part]]]


def _opcodes(a: list, b: list) -> list[tuple[str, int, int, int, int]]:
    return [("equal", 0, len(a), 0, len(b))] if a == b else SequenceMatcher(None, a, b, autojunk=False).get_opcodes()


def _siblings(a: list[Part], b: list[Part]) -> Pairs:
    """Runs of elements of one label: those equal in text at either end, then one by one, or by kind, or all as one repeated part."""
    head, tail = 0, 0
    while head < min(len(a), len(b)) and _ahead(a[head], b[head]):
        head += 1
    while tail < min(len(a), len(b)) - head and _ahead(a[-1 - tail], b[-1 - tail]):
        tail += 1
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    made: Pairs = [([p], [q]) for p, q in zip(a[:head], b[:head], strict=True)]
    if not x or not y:
        made += [([p], []) for p in x] + [([], [q]) for q in y]
    elif len(x) == len(y) and not any(p.repeated for p in (*x, *y)):
        made += [([p], [q]) for p, q in zip(x, y, strict=True)]
    else:
        kinds = _kinds([*x, *y])
        # among siblings whose text varies, one that has been the same on several pages is no repetition of them
        own, varies = kinds[: len(x)], any(p.const is None for p in x)
        there = {q.const for q in y}
        own = [-1 - k if varies and p.const is not None and p.pages >= TEMPLATE_PAGES and not p.repeated and p.const not in there else kind for k, (p, kind) in enumerate(zip(x, own, strict=True))]
        runs_x, runs_y = _cut(x, own), _cut(y, kinds[len(x) :])
        for kind, i, j, p, q in _opcodes([k for k, _ in runs_x], [k for k, _ in runs_y]):
            if kind != "equal":
                made += [([part], []) for _, run in runs_x[i:j] for part in run] + [([], [part]) for _, run in runs_y[p:q] for part in run]
                continue
            for (_, c), (_, d) in zip(runs_x[i:j], runs_y[p:q], strict=True):
                even = len(c) == len(d) and not any(part.repeated for part in (*c, *d))
                made += [([s], [t]) for s, t in zip(c, d, strict=True)] if even else [(c, d)]
    return made + [([p], [q]) for p, q in zip(a[len(a) - tail :], b[len(b) - tail :], strict=True)]


def _cut(parts: list[Part], keys: list) -> list[tuple[object, list[Part]]]:
    """Runs of parts of equal keys."""
    made: list[tuple[object, list[Part]]] = []
    for part, key in zip(parts, keys, strict=True):
        if made and made[-1][0] == key:
            made[-1][1].append(part)
        else:
            made.append((key, [part]))
    return made


def _flow(a: list[Part], b: list[Part]) -> Pairs:
    """Running text: runs of labels that agree at either end, and what is between as one group if labels come back in it."""
    if len({p.label for p in (*a, *b)}) == 1 and a[0].label != "()":
        return _siblings(a, b)
    x, y = (_cut(parts, [p.label for p in parts]) for parts in (a, b))
    head, tail = 0, 0
    while head < min(len(x), len(y)) and x[head][0] == y[head][0] != "()":
        head += 1
    while tail < min(len(x), len(y)) - head and x[-1 - tail][0] == y[-1 - tail][0] != "()":
        tail += 1
    if head == len(x) == len(y):
        return [pair for (_, c), (_, d) in zip(x, y, strict=True) for pair in _siblings(c, d)]
    inside = {label for label, _ in (*x[head : len(x) - tail], *y[head : len(y) - tail])}
    inside |= {p.label for _, run in (*x, *y) for g in run if g.label == "()" for p in g.inner}
    while head and x[head - 1][0] in inside:
        head -= 1
    while tail and x[-tail][0] in inside:
        tail -= 1
    core_x, core_y = x[head : len(x) - tail], y[head : len(y) - tail]
    made = [pair for (_, c), (_, d) in zip(x[:head], y[:head], strict=True) for pair in _siblings(c, d)]
    labels_x, labels_y = [k for k, _ in core_x], [k for k, _ in core_y]
    if "()" in inside or len(set(labels_x)) < len(labels_x) or len(set(labels_y)) < len(labels_y):
        made.append(([p for _, run in core_x for p in run], [p for _, run in core_y for p in run]))
    else:
        for kind, i, j, p, q in _opcodes(labels_x, labels_y):
            if kind == "equal":
                made += [pair for (_, c), (_, d) in zip(core_x[i:j], core_y[p:q], strict=True) for pair in _siblings(c, d)]
            else:
                made += [([part], []) for _, run in core_x[i:j] for part in run] + [([], [part]) for _, run in core_y[p:q] for part in run]
    return made + [pair for (_, c), (_, d) in zip(x[len(x) - tail :], y[len(y) - tail :], strict=True) for pair in _siblings(c, d)]


def pairs(a: list[Part], b: list[Part]) -> Pairs:
    """Two lists of siblings aligned: (parts of a, parts of b) that correspond; one is empty for what only the other has."""
    if len(a) == len(b) == 1 and a[0].label == b[0].label != "()":
        return [(a, b)]
    x, y = (_cut(parts, ["" if p.flow else p.label for p in parts]) for parts in (a, b))
    made: Pairs = []

    def both(c: list[Part], d: list[Part]) -> None:
        made.extend(_flow(c, d) if c[0].flow else _siblings(c, d))

    def apart(x: list, y: list, keys: list) -> None:
        """Elements whose names differ: by names without numbers, then by tags of the same shape, else by themselves."""
        if len(x) == len(y) == 1 and x[0][0] == y[0][0]:
            both(x[0][1], y[0][1])
            return
        if not x or not y or not keys:
            made.extend([([p], []) for _, run in x for p in run] + [([], [p]) for _, run in y for p in run])
            return
        key, *rest = keys
        for kind, i, j, p, q in _opcodes([key(run[0]) for _, run in x], [key(run[0]) for _, run in y]):
            if kind == "equal":
                for (_, c), (_, d) in zip(x[i:j], y[p:q], strict=True):
                    both(c, d)
            else:
                apart(x[i:j], y[p:q], rest)

    shape = lambda p: (p.tag, frozenset(k.tag for k in p.inner))
    apart(x, y, [lambda p: "" if p.flow else p.label, lambda p: unnumbered(p.label), shape])
    return made


def aligned(a: list[Part], b: list[Part], same: bool = False) -> list[Part]:
    """One list of parts for two, same if they are of the same pages; those of a and b are used up."""
    made = []
    for x, y in pairs(a, b):
        if not x or not y:
            for part in x or y:
                part.optional = True
                made.append(part)
            continue
        if len({p.label for p in (*x, *y)}) > 1 and len(x) + len(y) > 2 or "()" in (x[0].label, y[0].label):
            one, two = Part("()", [], None, 0), Part("()", [], None, 0)
            for group, parts in ((one, x), (two, y)):
                for p in parts:
                    group.pages = max(group.pages, p.pages)
                    _put(group, p, True, True)
            one.repeated = True
        else:
            one, two = x[0], y[0]
            for first, others in ((one, x[1:]), (two, y[1:])):
                for other in others:
                    _joined(first, other, True, True)
        made.append(_joined(one, two, same))
    return made


class Page:
    """A page's parts, and its blocks of text in order."""

    def __init__(self, parts: list[Part], blocks: list[str]):
        self.parts, self.blocks = parts, blocks


def _label(tag: str, attributes: str) -> str:
    """Tag and names of an element, each name's words joined by hyphens."""
    if "=" not in attributes:
        return tag
    names = {"-".join(WORD.findall(name)).lower() for m in NAMES.finditer(attributes) for name in (m[2] or m[3] or m[4] or "").split()}
    return " ".join((tag, *sorted(names - {""})))


def unnumbered(label: str) -> str:
    return NUMBER.sub("*", label)


def _numbered_alike(parts: list[Part]) -> None:
    """Of three and more siblings in a row whose names differ in numbers only, the numbers are left out."""
    if len(parts) > 2 and len({p.label for p in parts}) > 2:
        for _, run in _cut(parts, [unnumbered(p.label) for p in parts]):
            if len(run) > 2 and len({p.label for p in run}) > 1:
                for p in run:
                    p.label = unnumbered(p.label)


def says(label: str) -> str:
    """What an element's tag and names say: "content", "dropped" for certain, "named" as something else, "header" or nothing."""
    tag, *names = label.split(" ")
    if tag in DROPPED:
        return "dropped"
    words = [name.split("-") for name in names]
    content = any(CONTENT_WORDS & set(w) for w in words)
    named = any(DROPPED_WORDS & set(w) or w[-1] in DROPPED_LAST for w in words) and tag not in ("html", "body")
    if tag in CONTENT:
        return "named" if named and not content else "content"
    if tag == "header":
        return "header"
    if named or tag in ("form", "fieldset"):
        return "named"
    if any(HEADER_WORDS & set(w) for w in words) and tag not in ("html", "body"):
        return "header"
    return "content" if content and tag in ("div", "section", "td") else ""


def parsed(html: str) -> Page:
    """Read a page; wrong markup is read as browsers do in the common cases."""
    root: list[Part] = []
    tags, kids = [""], [root]  # open elements and the list that their parts go to, the page first
    labels: list[str | None] = [None]  # of those with a part of their own
    opened: Counter[str] = Counter()
    blocks: list[str] = []
    text: list[str] = []
    linked = links = deep = 0
    into = root
    unended: set[str] = set()  # tags whose end is nowhere in the rest

    def flush() -> None:
        nonlocal linked
        if text:
            if shown := " ".join("".join(text).split()):
                own = min(linked, len(shown))
                hashed = xxhash.xxh3_64_intdigest(shown)
                part = Part("#a" if own > LINK_SHARE * len(shown) else "#", [], hashed)
                part.blocks, part.chars, part.linked, part.texts, part.at = 1, len(shown), own, {hashed: 1}, [len(blocks)]
                into.append(part)
                blocks.append(shown)
            text.clear()
        linked = 0

    def close(depth: int) -> None:
        nonlocal links, deep
        while len(tags) > depth:
            tag, own, label = tags.pop(), kids.pop(), labels.pop()
            opened[tag] -= 1
            links -= tag == "a"
            if label is not None:
                deep -= len(tags) >= DEPTH
                if own:
                    _numbered_alike(own)
                    kids[-1].append(Part(label, own, own[0].const if len(own) == 1 else xxhash.xxh3_64_intdigest(repr([x.const for x in own]))))

    at, n = 0, len(html)
    while at < n:
        m = TOKEN.match(html, at)
        at = m.end()
        raw = m[0]
        if raw[0] != "<" or raw == "<":
            shown = unescape(raw)
            if not text:
                into = kids[-1]
            text.append(shown)
            if links:
                linked += len(" ".join(shown.split()))
            continue
        if raw[1] in "!?":
            continue
        tag = (m[2] or re.match(r"</?([^\s/>]*)", raw)[1]).lower()
        ending = raw[1] == "/"
        if not ending and tag in RAW:
            if tag in unended or (tag in ("svg", "math") and raw.endswith("/>")):
                continue
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.IGNORECASE).search(html, at)
            if not end and tag not in ENDLESS:
                unended.add(tag)
            at = end.end() if end else n if tag in ENDLESS else at
            continue
        if tag == "br":
            text.append(" ") if text else None
            continue
        if tag not in INLINE:
            flush()
        if ending:
            if opened[tag]:
                close(next(k for k in range(len(tags) - 1, 0, -1) if tags[k] == tag))
            continue
        while tag in CLOSES_P and opened["p"]:
            close(next(k for k in range(len(tags) - 1, 0, -1) if tags[k] == "p"))
        if tag in SIBLINGS:
            others, holders = SIBLINGS[tag]
            for depth in range(len(tags) - 1, 0, -1):
                if tags[depth] in holders or not any(opened[x] for x in others):
                    break
                if tags[depth] in others:
                    close(depth)
        if tag in VOID or raw.endswith("/>"):
            continue
        label = None if tag in INLINE else _label(tag, m[3] or "")
        if label is not None and len(tags) >= DEPTH:
            # further down only what the plan goes by, and not without end
            label = label if says(label) and deep < DEPTH // 4 else None
            deep += label is not None
        tags.append(tag)
        opened[tag] += 1
        kids.append(kids[-1] if label is None else [])
        labels.append(label)
        links += tag == "a"
    flush()
    close(1)
    _numbered_alike(root)
    return Page(root, blocks)


class Wrapper:
    """A host's expression: its parts, how many pages it is of, and how often their most frequent longest blocks occur."""

    def __init__(self, pages: int = 0, parts: list[Part] | None = None, longest: dict[int, int] | None = None):
        self.pages, self.parts, self.longest = pages, parts or [], longest or {}

    def add(self, page: Page) -> None:
        """Align a page with the wrapper; its parts are used up."""
        longest = {xxhash.xxh3_64_intdigest(max(page.blocks, key=len)): 1} if page.blocks else {}
        self.join(Wrapper(1, page.parts, longest))

    def join(self, other: Wrapper) -> None:
        self.parts = aligned(self.parts, other.parts) if self.pages else other.parts
        self.pages += other.pages
        counted(self.longest, other.longest)

    def dump(self) -> str:
        return json.dumps([self.pages, list(self.longest.items()), [x.dump() for x in self.parts]])

    @staticmethod
    def load(text: str) -> Wrapper:
        pages, longest, parts = json.loads(text)
        return Wrapper(pages, [Part.load(x) for x in parts], dict(map(tuple, longest)))

    def expression(self) -> str:
        """The wrapper as a regular expression, for people to read."""

        def shown(parts: list[Part]) -> str:
            out = []
            for x in parts:
                body = "#text" if x.label[0] == "#" else shown(x.inner) if x.label == "()" else f"<{x.label}>{shown(x.inner)}</{x.tag}>"
                out.append(f"({body})*" if x.repeated and x.optional else f"({body})+" if x.repeated else f"({body})?" if x.optional else body)
            return " ".join(out)

        return shown(self.parts)

    def plan(self) -> str:
        """The wrapper without its counts, and whether each of its slots, in order, is kept: 0 never, 1 always, 2 on pages without one that always is."""
        return json.dumps([[x.dump(False) for x in self.parts], _roles(self)])


def _slots(parts: list[Part]) -> Iterator[Part]:
    for x in parts:
        if x.label[0] == "#":
            yield x
        else:
            yield from _slots(x.inner)


def _mass(part: Part, gone: set[int]) -> int:
    """Characters of a part that are not in links, without parts that are dropped."""
    if id(part) in gone:
        return 0
    return max(0, part.chars - part.linked) if part.label[0] == "#" else sum(_mass(x, gone) for x in part.inner)


def _roles(wrapper: Wrapper) -> list[int]:
    copies = max(wrapper.longest.values(), default=0)
    gone: set[int] = set()  # dropped parts
    content: list[Part] = []  # content elements that are in none
    named: list[Part] = []

    def read(parts: list[Part], inside: bool) -> None:
        for x in parts:
            if x.label[0] == "#":
                top = max(x.texts.values(), default=0)
                # in a repeated slot a frequent text says nothing about the others
                same = top >= TEMPLATE_PAGES and top >= TEMPLATE_SHARE * x.blocks and top > 2 * copies and x.blocks <= x.pages >= TEMPLATE_SHARE * wrapper.pages
                if x.linked > LINK_SHARE * x.chars or same:
                    gone.add(id(x))
                continue
            what = says(x.label) if x.label != "()" else ""
            if what == "dropped" or (what == "header" and not inside):
                gone.add(id(x))
                continue
            if what == "named":
                named.append(x)
            if what == "content" and not inside:
                content.append(x)
            read(x.inner, inside or (what == "content" and x.tag in CONTENT))

    read(wrapper.parts, False)
    # an element named as something else is dropped, unless the text is in it and not in content elements elsewhere
    whole = Part("()", wrapper.parts)
    total = _mass(whole, gone)
    held = {id(x): {id(y) for y in _elements(x)} for x in named}
    for x in named:
        elsewhere = any(id(c) not in held[id(x)] and not _within(c, named) and _mass(c, gone) for c in content)
        if elsewhere or _mass(x, gone) < NAMED_TEXT * total:
            gone.add(id(x))
    content = [x for x in content if not _under(wrapper.parts, x, gone)]
    total, own = _mass(whole, gone), sum(_mass(x, gone) for x in content)
    by_content = bool(content) and max(x.pages for x in content) >= CONTENT_SHARE * wrapper.pages and own >= CONTENT_TEXT * total
    kept: set[int] = set()
    for part in content if by_content else _main(wrapper.parts, gone):
        kept |= {id(x) for x in _slots([part])}
    left = {id(x) for x in _open(wrapper.parts, gone)}
    # where the article is not in content elements, only text within the main part is of it
    return [0 if id(x) not in left else 1 if id(x) in kept else 2 if by_content else 0 for x in _slots(wrapper.parts)]


def _elements(part: Part) -> Iterator[Part]:
    yield part
    for x in part.inner:
        yield from _elements(x)


def _within(part: Part, others: list[Part]) -> bool:
    return any(part is not other and any(part is x for x in _elements(other)) for other in others)


def _under(parts: list[Part], part: Part, gone: set[int]) -> bool:
    """Whether a part is dropped or within one that is."""
    return not any(part is x for x in _open_elements(parts, gone))


def _open_elements(parts: list[Part], gone: set[int]) -> Iterator[Part]:
    for x in parts:
        if id(x) not in gone:
            yield x
            yield from _open_elements(x.inner, gone)


def _open(parts: list[Part], gone: set[int]) -> Iterator[Part]:
    return (x for x in _open_elements(parts, gone) if x.label[0] == "#")


def _main(parts: list[Part], gone: set[int]) -> list[Part]:
    """The parts that have the article: down to where no single element has most of the text, and headings before it on the way."""
    headings: list[Part] = []
    while True:
        total = sum(_mass(x, gone) for x in parts)
        main = next((k for k, x in enumerate(parts) if x.tag in HOLDERS and not x.repeated and _mass(x, gone) >= MAIN_TEXT * total > 0), None)
        if main is None:
            return headings + parts
        headings += [x for x in parts[:main] if x.tag in HEADINGS]
        parts = parts[main].inner


class Plan:
    """A host's wrapper and the roles of its slots, to align pages with."""

    def __init__(self, text: str):
        parts, roles = json.loads(text)
        self.parts = [Part.load(x) for x in parts]
        self.roles = {id(x): role for x, role in zip(_slots(self.parts), roles, strict=True)}

    def text_of(self, page: Page) -> str:
        roles = [0] * len(page.blocks)
        self._assign(self.parts, page.parts, roles)
        kept = 1 if 1 in roles else 2
        return "\n\n".join(block for block, role in zip(page.blocks, roles, strict=True) if role == kept)

    def _assign(self, a: list[Part], b: list[Part], roles: list[int]) -> None:
        for x, y in pairs(a, b):
            if x and y:
                self._paired(x, y, roles)

    def _paired(self, x: list[Part], y: list[Part], roles: list[int]) -> None:
        known: dict[str, Part] = {}
        for part in x:
            for p in part.inner if part.label == "()" else (part,):
                known.setdefault(p.label, p)
        for k, part in enumerate(y):
            own = x[k] if len(x) == len(y) and x[k].label != "()" else known.get(part.label) or (x[0] if len(x) == 1 and x[0].label != "()" else None)
            if own is None:
                continue
            if part.label[0] == "#":
                for block in part.at:
                    roles[block] = self.roles.get(id(own), 0)
            else:
                self._assign(own.inner, part.inner, roles)


def wrappers(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, wrapper): the wrapper of each host as JSON, over all its pages.

    A URL without a host, a null one too, is of the host "". Null pages are empty ones.
    """

    def batch(made: dict[str, Wrapper]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(made), pa.string()), pa.array([w.dump() for w in made.values()], pa.string())], ["host", "wrapper"])

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Wrapper] = {}
        for part in batches:
            for host, text in zip(part.column("host").to_pylist(), part.column("html").to_pylist(), strict=True):
                held.setdefault(host, Wrapper()).add(parsed(text or ""))
                if len(held) > HELD_HOSTS:
                    yield batch(held)
                    held.clear()
        yield batch(held)

    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: dict[str, Wrapper] = {}
        for part in batches:
            for host, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                if host not in now:
                    if now:
                        yield batch(now)
                    now = {host: Wrapper()}
                now[host].join(Wrapper.load(text))
        yield batch(now)

    kind = "host string, wrapper string"
    parts = pages.select(_host(url).alias("host"), F.col(html).alias("html")).mapInArrow(read, kind)
    # a host of very many pages has a wrapper from each task: some of these are aligned in each of several tasks first
    some = parts.repartition("host", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS))).sortWithinPartitions("host", "wrapper").mapInArrow(join, kind)
    return some.repartition("host").sortWithinPartitions("host", "wrapper").mapInArrow(join, kind)


def _host(url: str):
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]*)", 1))


def extracted(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """id_col, url, text and n_chars (code points), one row for each row of pages.

    text is the kept blocks in page order, joined by two line ends; empty for empty and null pages. Repeated rows
    and ids stay; other columns are not looked at; no rows give no rows.
    """
    source = pages.select(F.col(id_col).alias("id"), F.col(url).alias("url"), F.col(html).alias("html"))
    source = source.withColumn("host", _host("url"))

    def planned(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [Wrapper.load(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([w.plan() for w in made], pa.string()), pa.array([w.pages for w in made], pa.int64())], ["host", "plan", "pages"])

    plans = written(wrappers(source).mapInArrow(planned, "host string, plan string, pages long"))
    size = bytes_of(plans, "host", "plan")
    small = size <= BROADCAST_BYTES
    sent = pages.sparkSession.sparkContext.broadcast({r.host: r.plan for r in plans.collect()} if small else {})
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Plan] = {}
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                texts = []
                for k, (host, text) in enumerate(zip(part.column("host").to_pylist(), part.column("html").to_pylist(), strict=True)):
                    if host not in known:
                        if not small or len(known) > HELD_HOSTS:
                            known.clear()
                        known[host] = Plan(sent.value[host] if small else part.column("plan")[k].as_py())
                    texts.append(known[host].text_of(parsed(text or "")))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["id", "url", "text", "n_chars"])

    if not small:
        source = dealt_join(source, plans, ["host"], "pages")
    return source.mapInArrow(run, f"id {kind}, url string, text string, n_chars long").withColumnRenamed("id", id_col)


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main texts of all pages."""
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def registered() -> Iterator[tuple]:
    yield "op4_html_extraction", op4_html_extraction, None
