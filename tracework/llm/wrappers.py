"""Main text of web pages by wrappers: a union-free regular expression for each host's pages.

1. A page becomes an expression: elements by tag and class, with the runs of text between block borders as slots.
   Neighbouring equal elements, or equal groups of up to PERIOD elements, fold into one repeated element or group.
2. The expressions of a host are aligned one after the other. Where the children of two matched elements differ, an element
   that only one side has becomes optional, runs become repeated groups, and slots take up what differs in the text.
   Of its text a slot keeps sums (runs, characters, characters in links) and the SKETCH smallest hashes, which tell whether
   it ever differs. A page whose structure a task has met already only adds to the sums. Tasks hold one
   expression for each host; their results are aligned by (host, part) and then by host, in a stated order, so only
   expressions are shuffled, never pages, and a host's pages never meet in one task.
3. A wrapper tells the role of each of its elements. Menus, headers, footers, sidebars, notices, adverts, forms, scripts and
   comments go, by tag or by a word of class, id or role. What is left inside the host's main element (article or main)
   is the text; where a host or a page has none, slots that mostly hold links, or the same text on all pages, go too.
4. Every page is read again, its elements are matched to its host's wrapper in order, and the kept slots are its blocks.
   Wrappers of hosts with over 1 / HOT_SHARE of all pages, hence at most HOT_SHARE, and of at most HOT_BYTES each, are
   broadcast; larger ones of such hosts are joined to pages dealt to SALTS parts; all others are joined by host.

Defined results: null and blank html, and pages without main text, have the text ''; what isn't closed ends where HTML ends
it (p, li, dt, dd, tr, td, th, option) or with what stands around it; elements below MAX_DEPTH stand beside each other,
with the role of the outermost one there that isn't main text; pages without a host (no "://", null url) count as one host;
repeated rows give repeated rows; headings inside the main element belong to the text; <br> is white space; an empty table
gives no rows; columns other than those named are dropped.
"""

from __future__ import annotations

import bisect
import html as entities
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracework.llm.urlfilter import split_url
from tracework.session import cut, give_back, whole_texts

MAX_DEPTH = 64
#: Elements of a group that may repeat.
PERIOD = 4
#: Children beyond which those of one label fold into one, whatever stands between.
WIDE = 256
#: Pairs of children that are aligned by their longest common sequence; longer lists match each label in order.
ALIGN_PAIRS = 1 << 14
SKETCH = 8
#: Expressions that a task holds at once, and their elements.
HELD_HOSTS, HELD_ELEMENTS = 2_000, 200_000
PARTS = 32
HOT_SHARE, HOT_BYTES, SALTS = 1_000, 64 << 10, 64
#: Text runs of a slot, all equal, that make it part of the template; and the part of a slot's characters in links.
SAME_TEXTS, LINK_PART = 8, 0.5

_words = lambda text: frozenset(text.split())
VOID = _words("area base br col embed hr img input link meta param source track wbr")
BLOCK = _words(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend "
    "li main menu nav ol optgroup p pre search section summary table tbody td tfoot th thead title tr ul"
)
#: Containers that tell nothing by their name.
BARE = _words("center div section table tbody td tr")
#: Elements that show no text, and those whose content is no markup. They don't end a block.
SILENT = _words("audio button canvas datalist iframe math noscript object option select svg template textarea video")
RAW = _words("iframe noembed noframes script style textarea title xmp")
#: What a start tag ends, and what that doesn't reach beyond.
ENDS = {"li": ("li", "p"), "dt": ("dd", "p"), "dd": ("dd", "p"), "tr": ("tr", "td"), "td": ("td",), "th": ("td",), "option": ("option",)}
KIND = {"dt": "dd", "th": "td"}
WITHIN = {"p": _words("table td th button object template caption"), "li": _words("ul ol menu dir"), "dd": _words("dl"), "tr": _words("table"), "td": _words("table tr"), "option": _words("select datalist")}
BOUNDS = {tag: [g for g, tags in WITHIN.items() if tag in tags] for tags in WITHIN.values() for tag in tags}

NEVER = _words("head title nav aside form dialog menu search footer script style template noscript")
#: Words of class, id or role.
CUES = _words(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar complementary aside nav navbar navigation menu menus breadcrumb breadcrumbs "
    "footer contentinfo cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login search share sharing social related recommended "
    "recommendations comment comments disqus reply replies respond discussion pager pagination skip copyright widget form dialog alert"
)
OUTER_CUES = _words("header masthead topbar toolbar top")
MAIN_TAGS, MAIN_WORDS = _words("article main"), _words("article articlebody story post entry content main")

_TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>""")
_PLAIN_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)>")
_NAMED = re.compile(r"""(?<![\w-])(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPLIT = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")


class Element:
    """An element of a page or of a wrapper, a slot of text (label '#'), or a wrapper's group of elements that repeats."""

    __slots__ = ("label", "kids", "n", "chars", "linked", "sketch", "repeated", "optional", "moved", "text")

    def __init__(self, label: str, kids: list[Element] | None = None) -> None:
        self.label, self.kids = label, kids or []
        self.n, self.chars, self.linked, self.sketch = 1, 0, 0, []
        self.repeated = self.optional = False
        #: The element that this one was merged into; a slot's text, in pages only.
        self.moved = self.text = None

    @property
    def tag(self) -> str:
        return self.label.partition(".")[0]

    @property
    def words(self) -> frozenset[str]:
        return frozenset(self.label.split(".")[1:])

    def slots(self) -> Iterator[Element]:
        for kid in self.kids:
            if kid.label == "#":
                yield kid
            else:
                yield from kid.slots()


def words_of(attributes: str) -> frozenset[str]:
    """The words of class, id, role and itemprop; of ids only those that tell a role."""
    found = set()
    for name, a, b, c in _NAMED.findall(attributes):
        own = {w.lower() for w in _SPLIT.split(a or b or c) if w}
        found |= own & (CUES | OUTER_CUES | MAIN_WORDS) if name.lower() == "id" else own
    return frozenset(found)


_labels: dict[str, tuple[str, frozenset[str]]] = {}


def label_of(tag: str, attributes: str) -> tuple[str, frozenset[str]]:
    if "=" not in attributes:
        return tag, frozenset()
    found = _labels.get(key := f"{tag} {attributes}") if len(attributes) < 200 else None
    if found is None:
        words = words_of(attributes)
        found = (".".join([tag, *sorted(words)]), words)
        if len(attributes) < 200:
            if len(_labels) > 20_000:
                _labels.clear()
            _labels[key] = found
    return found


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, rest) of '<' start, '>' end and '' text, in order; comments, declarations and raw content are left out.
    Each step moves on, and a search that fails is not made again, so the time is linear."""
    at, size, tag, lower = 0, len(page), _TAG, None
    ends = page.find(">") >= 0  # whether any is left
    while at < size:
        low = page.find("<", at) if ends else -1
        if low < 0:
            yield "", page[at:], ""
            return
        if low > at:
            yield "", page[at:low], ""
        mark = page[low + 1 : low + 2]
        if page.startswith("<!--", low):
            found = page.find("-->", low + 4)
            at = found + 3 if found >= 0 else size
            continue
        if mark in ("!", "?"):
            found = page.find(">", low)
            at = found + 1 if found >= 0 else size
            continue
        if not (mark.isalpha() or mark == "/"):
            yield "", "<", ""
            at = low + 1
            continue
        found = tag.match(page, low)
        if found is None and tag is _TAG and page[low + 1 : low + 3].strip("/")[:1].isalpha():
            tag = _PLAIN_TAG if page.find(">", low) >= 0 else tag
            ends = tag is _PLAIN_TAG
            found = tag.match(page, low)
        if found is None:
            if page.startswith("</", low) and ends:  # an end tag without a name is a comment
                found = page.find(">", low)
                at = found + 1 if found >= 0 else size
                continue
            yield "", "<", ""
            at = low + 1
            continue
        at = found.end()
        name = found[2].lower()
        if found[1]:
            yield ">", name, ""
            continue
        yield "<", name, found[3]
        if name in RAW:
            lower = page.lower() if lower is None else lower
            close = lower.find(f"</{name}", at)
            at = close if close >= 0 else size


class Open:
    """An element that isn't closed yet: where its text goes, and where elements below it stand if it is too deep."""

    __slots__ = ("tag", "block", "silent", "target", "depth", "holder", "gone")

    def __init__(self, tag: str, block: bool, silent: bool, target: Element, depth: int, holder: Element | None, gone: bool) -> None:
        self.tag, self.block, self.silent, self.target, self.depth, self.holder, self.gone = tag, block, silent, target, depth, holder, gone


class Builder:
    """Tokens -> a tree of block elements and slots. Elements that aren't closed end as in HTML."""

    def __init__(self) -> None:
        self.root = Element("")
        self.stack = [Open("", True, False, self.root, 0, None, False)]
        self.count: dict[str, int] = {}
        #: By kind: the places of the open ones, and negative ones of what they don't reach beyond.
        self.scopes: dict[str, list[int]] = {g: [] for g in WITHIN}
        self.links = self.quiet = self.linked = 0
        self.pieces: list[str] = []

    def flush(self) -> None:
        """The text since the last border of a block becomes a slot."""
        if self.pieces:
            text = " ".join("".join(self.pieces).split())
            if text:
                slot = Element("#")
                slot.text, slot.chars, slot.linked = text, len(text), min(self.linked, len(text))
                self.stack[-1].target.kids.append(slot)
            self.pieces, self.linked = [], 0

    def put(self, data: str) -> None:
        if not self.quiet:
            data = entities.unescape(data) if "&" in data else data
            self.pieces.append(data)
            if self.links:
                self.linked += len(data.strip())

    def start(self, tag: str, attributes: str) -> None:
        if tag in VOID:
            if tag == "hr":
                self.flush()
            elif tag == "br":
                self.pieces.append(" ")
            return
        block = tag in BLOCK
        for group in ENDS.get(tag, ("p",) if block else ()):
            if self.scopes[group] and self.scopes[group][-1] > 0:
                self.close_to(self.scopes[group][-1])
        label, words = label_of(tag, attributes)
        top = self.stack[-1]
        target, depth, holder, gone = top.target, top.depth, top.holder, top.gone
        if block:
            self.flush()
            below = depth >= MAX_DEPTH
            if below:
                gone = gone or _goes(tag, words)
                label = target.label if top.gone else label
            target = Element(label)
            (top.target if not below else holder).kids.append(target)
            depth, holder = (depth, holder) if below else (depth + 1, target)
        silent = tag in SILENT or tag in RAW or (not block and not words.isdisjoint(CUES))
        at = len(self.stack)
        self.stack.append(Open(tag, block, silent, target, depth, holder, gone))
        self.count[tag] = self.count.get(tag, 0) + 1
        self.links += tag == "a"
        self.quiet += silent
        for group in _kinds(tag):
            self.scopes[group].append(at if group == KIND.get(tag, tag) else -at)

    def pop(self) -> None:
        top = self.stack[-1]
        if top.block:
            self.flush()
        self.stack.pop()
        self.count[top.tag] -= 1
        self.links -= top.tag == "a"
        self.quiet -= top.silent
        for group in _kinds(top.tag):
            self.scopes[group].pop()

    def close_to(self, at: int) -> None:
        while len(self.stack) > at:
            self.pop()

    def end(self, tag: str) -> None:
        if self.count.get(tag):
            while self.stack[-1].tag != tag:
                self.pop()
            self.pop()
        elif tag == "br":
            self.pieces.append(" ")
        elif tag == "p":
            self.flush()


def _kinds(tag: str) -> tuple[str, ...]:
    """The kinds whose scopes an element opens or bounds."""
    own = KIND.get(tag, tag)
    return (*((own,) if own in WITHIN else ()), *(g for g in BOUNDS.get(tag, ()) if g != own))


def tree_of(page: str | None) -> Element:
    build = Builder()
    for kind, name, rest in tokens(page or ""):
        if kind == "":
            build.put(name)
        elif kind == "<":
            build.start(name, rest)
        else:
            build.end(name)
    build.close_to(1)
    build.flush()
    return build.root


def _resolved(e: Element) -> Element:
    while e.moved is not None:
        e = e.moved
    return e


def _add(into: Element, slot: Element) -> None:
    into.n += slot.n
    into.chars += slot.chars
    into.linked += slot.linked
    if len(into.sketch) < SKETCH or slot.sketch[0] < into.sketch[-1]:
        into.sketch = sorted({*into.sketch, *slot.sketch})[:SKETCH]


def _merge(into: Element, e: Element) -> None:
    """e, which has the same label, becomes a part of what `into` stands for."""
    if into.label == "#":
        _add(into, e)
    else:
        into.n += e.n
        into.kids = _aligned(into.kids, e.kids)
    into.repeated |= e.repeated
    into.optional |= e.optional
    e.moved = into


def alike(a: Element | Role, b: Element) -> bool:
    """Whether two elements may be one of the expression's: the same label, and containers that only that label tells apart
    begin alike, or share over a third of the labels inside them and over half of those inside the smaller one."""
    if a.label != b.label or a.label not in BARE:
        return a.label == b.label
    x, y = _inside(a), _inside(b)
    both = len(x.keys() & y.keys())
    return not (x and y) or next(iter(x)) == next(iter(y)) or (3 * both > max(len(x), len(y)) and 2 * both > min(len(x), len(y)))


def _inside(e: Element | Role) -> dict[str, None]:
    """The labels inside, in order."""
    return {k.label: None for kid in e.kids for k in (kid.kids if kid.label.startswith("(") else (kid,))}


def _same(kids: list[Element], i: int, j: int, period: int) -> bool:
    return j + period <= len(kids) and all(alike(kids[i + k], kids[j + k]) for k in range(period))


def folded(kids: list[Element]) -> list[Element]:
    """Neighbouring equal elements become one that repeats, neighbouring equal groups a group that repeats."""
    for period in range(1, PERIOD + 1):
        if len(kids) < 2 * period:
            break
        out, i = [], 0
        while i < len(kids):
            j = i + period
            while _same(kids, i, j, period):
                for k in range(period):
                    _merge(kids[i + k], kids[j + k])
                j += period
            if j == i + period:
                out.append(kids[i])
                i += 1
                continue
            group = kids[i] if period == 1 else Element("(" + " ".join(k.label for k in kids[i : i + period]) + ")", kids[i : i + period])
            group.repeated = True
            out.append(group)
            i = j
        kids = out
    return _narrow(kids)


def _narrow(kids: list[Element]) -> list[Element]:
    if len(kids) <= WIDE:
        return kids
    first: dict[str, Element] = {}
    for kid in kids:
        if kid.label in first:
            _merge(first[kid.label], kid)
            first[kid.label].repeated = first[kid.label].optional = True
        else:
            first[kid.label] = kid
    return list(first.values())


def _pairs(x: list[Element], y: list[Element]) -> list[tuple[int, int]]:
    """Places of a longest common sequence; of long lists, each label of y at its next place in x."""
    if len(x) * len(y) > ALIGN_PAIRS:
        where: dict[str, list[int]] = {}
        for i, e in enumerate(x):
            where.setdefault(e.label, []).append(i)
        found, at = [], -1
        for j, e in enumerate(y):
            places = where.get(e.label, [])
            k = bisect.bisect_right(places, at)
            if k < len(places):
                at = places[k]
                found.append((at, j))
        return found
    equal = [[alike(a, b) for b in y] for a in x]
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) - 1, -1, -1):
        row, below = best[i], best[i + 1]
        for j in range(len(y) - 1, -1, -1):
            row[j] = max(below[j + 1] + 1 if equal[i][j] else 0, below[j], row[j + 1])
    found, i, j = [], 0, 0
    while i < len(x) and j < len(y):
        if equal[i][j] and best[i][j] == best[i + 1][j + 1] + 1:
            found.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return found


def _aligned(x: list[Element], y: list[Element]) -> list[Element]:
    """One list for two: elements of both are merged, those of one side are optional."""
    if len(x) == len(y) and all(map(alike, x, y)):
        for a, b in zip(x, y, strict=True):
            _merge(a, b)
        return x
    out, i, j = [], 0, 0
    for a, b in [*_pairs(x, y), (len(x), len(y))]:
        for e in (*x[i:a], *y[j:b]):
            e.optional = True
            out.append(e)
        if a < len(x):
            _merge(x[a], y[b])
            out.append(x[a])
        i, j = a + 1, b + 1
    # what now stands side by side is a run
    runs = []
    for e in out:
        if runs and alike(runs[-1], e):
            _merge(runs[-1], e)
            runs[-1].repeated = True
        else:
            runs.append(e)
    return _narrow(runs)


def expression_of(page: str | None) -> Element:
    """A page's own expression."""

    def fold(e: Element) -> None:
        for kid in e.kids:
            if kid.label == "#":
                kid.sketch = [xxhash.xxh64_intdigest(kid.text) >> 1]
                kid.text = None
            else:
                fold(kid)
        e.kids = folded(e.kids)

    root = tree_of(page)
    fold(root)
    return root


def signature(e: Element) -> str:
    """An expression's structure as text, without what its slots hold."""
    mark = "+" * e.repeated + "?" * e.optional
    return f"{e.label}{mark}" if e.label == "#" else f"{e.label}{mark}({' '.join(map(signature, e.kids))})"


def packed(e: Element) -> list:
    flags = e.repeated + 2 * e.optional
    return [e.label, flags, e.n, e.chars, e.linked, e.sketch] if e.label == "#" else [e.label, flags, e.n, [packed(k) for k in e.kids]]


def unpacked(data: list) -> Element:
    e = Element(data[0])
    e.repeated, e.optional, e.n = bool(data[1] & 1), bool(data[1] & 2), data[2]
    if e.label == "#":
        e.chars, e.linked, e.sketch = data[3:]
    else:
        e.kids = [unpacked(k) for k in data[3]]
    return e


def _goes(tag: str, words: frozenset[str], outside: bool = True) -> bool:
    """Whether an element is no main text by its tag or words."""
    return tag in NEVER or not words.isdisjoint(CUES) or (outside and (tag == "header" or not words.isdisjoint(OUTER_CUES)))


class Role:
    """What a wrapper says of an element: whether it is the main one, and of a slot whether it is text inside of the main
    one, or where there is none."""

    __slots__ = ("label", "main", "inside", "outside", "kids", "places", "repeated")

    def __init__(self, e: Element) -> None:
        self.label, self.repeated = e.label, e.repeated
        self.main = self.inside = self.outside = False
        self.kids: list[Role] = []
        self.places: dict[str, list[int]] = {}


def roles_of(wrapper: Element) -> Role:
    size: dict[int, int] = {}

    def measure(e: Element) -> int:
        size[id(e)] = e.chars if e.label == "#" else sum(map(measure, e.kids))
        return size[id(e)]

    measure(wrapper)
    found: list[tuple[int, Element]] = []  # how free a main element is of cues around and on it

    def search(e: Element, blocked: int) -> None:
        for kid in e.kids:
            tag, words = kid.tag, kid.words
            goes = tag not in ("", "html", "body", "#", "(") and _goes(tag, words)
            if kid.label != "#":
                if tag in MAIN_TAGS or (tag in ("div", "section", "td") and not words.isdisjoint(MAIN_WORDS)):
                    own = 0 if not goes else 1 if tag in MAIN_TAGS and 2 * size[id(kid)] > size[id(wrapper)] else 2
                    found.append((max(blocked, own), kid))
                search(kid, blocked if not goes or tag == "form" else max(blocked, 2 if tag in NEVER else 1))  # a form may span the page

    search(wrapper, 0)
    mains: list[Element] = []
    for wanted in (lambda e: e.tag in MAIN_TAGS, lambda e: True):
        free = min((b for b, e in found if wanted(e)), default=2)
        if free < 2:
            mains = [e for b, e in found if b == free and wanted(e)]
            break
    by_tag = {tag: [e for e in mains if e.tag == tag] for tag in MAIN_TAGS}
    if by_tag["article"] and by_tag["main"]:
        most = sum(size[id(e)] for e in by_tag["article"])
        mains = by_tag["article"] if 2 * most >= sum(size[id(e)] for e in by_tag["main"]) else by_tag["main"]
    chosen = {id(e) for e in mains}
    sure = any(e.tag in MAIN_TAGS for e in mains)

    def build(e: Element, inside: bool, gone_inside: bool, gone: bool) -> Role:
        role = Role(e)
        for kid in e.kids:
            if kid.label == "#":
                slot = Role(kid)
                plain = 2 * kid.linked <= kid.chars if LINK_PART == 0.5 else kid.linked <= LINK_PART * kid.chars
                fixed = kid.n >= SAME_TEXTS and len(kid.sketch) == 1 and e.tag not in ("h1", "h2")
                slot.inside = inside and not gone_inside and (sure or (plain and not fixed))
                slot.outside = not gone and plain and not fixed
                role.kids.append(slot)
                continue
            tag, words, main = kid.tag, kid.words, id(kid) in chosen
            whole = tag in ("html", "body", "(") or main
            below = build(kid, inside or main, False if main else gone_inside or (not whole and _goes(tag, words, False)), gone or (not whole and _goes(tag, words)))
            below.main = main
            role.kids.append(below)
        for kid in role.kids[:]:  # a group's elements stand among its neighbours
            if kid.label.startswith("("):
                at = role.kids.index(kid)
                role.kids[at : at + 1] = kid.kids
        for i, kid in enumerate(role.kids):
            role.places.setdefault(kid.label, []).append(i)
        return role

    return build(wrapper, False, False, False)


def main_text(page: str | None, wrapper: Role) -> str:
    """The blocks that a host's wrapper keeps of a page, a line each."""
    inside, outside, has_main = [], [], False

    def walk(e: Element, role: Role) -> None:
        nonlocal has_main
        at = -1
        for kid in e.kids:
            places = role.places.get(kid.label)
            if not places:
                continue
            # the same place again if it repeats, else the next, else from the start: a group's next turn
            if not (at >= 0 and role.kids[at].repeated and alike(role.kids[at], kid)):
                k = bisect.bisect_right(places, at)
                order = places[k:] + places[:k]
                at = next((i for i in order if alike(role.kids[i], kid)), order[0])
            own = role.kids[at]
            if kid.label == "#":
                if own.inside:
                    inside.append(kid.text)
                if own.outside:
                    outside.append(kid.text)
            else:
                has_main |= own.main
                walk(kid, own)

    walk(tree_of(page), wrapper)
    return "\n".join(inside if has_main else outside)


class Held:
    """A task's expressions by host."""

    def __init__(self) -> None:
        self.wrappers: dict[str, Element] = {}
        self.met: dict[tuple[str, str], list[Element]] = {}
        self.pages: dict[str, int] = {}
        self.size = 0

    def add(self, host: str, e: Element, pages: int = 1) -> None:
        self.pages[host] = self.pages.get(host, 0) + pages
        key = (host, signature(e))
        slots = list(e.slots())
        known = self.met.get(key)
        if known is not None:
            for into, slot in zip(known, slots, strict=True):
                _add(_resolved(into), slot)
            return
        if host in self.wrappers:
            _merge(self.wrappers[host], e)
        else:
            self.wrappers[host] = e
        self.met[key] = slots
        self.size += len(key[1]) // 4 + len(slots)

    def full(self) -> bool:
        return len(self.wrappers) > HELD_HOSTS or self.size > HELD_ELEMENTS

    def rows(self) -> pa.RecordBatch:
        hosts = sorted(self.wrappers)
        data = [json.dumps(packed(self.wrappers[h]), separators=(",", ":")) for h in hosts]
        parts = [xxhash.xxh32_intdigest(d) % PARTS for d in data]
        columns = [pa.array(hosts, pa.string()), pa.array(parts, pa.int32()), pa.array([self.pages[h] for h in hosts], pa.int64()), pa.array(data, pa.string())]
        self.__init__()
        return pa.RecordBatch.from_arrays(columns, ["host", "part", "pages", "wrapper"])


_ROWS = "host string, part int, pages long, wrapper string"


def expressions(pages: DataFrame) -> DataFrame:
    """(host, part, pages, wrapper) of pages(host, html): each task's expression of each of its hosts."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        held = Held()
        for batch in batches:
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.add(host, expression_of(page))
                if held.full():
                    yield held.rows()
        yield held.rows()
        give_back()

    return pages.select("host", "html").mapInArrow(run, _ROWS)


def joined(found: DataFrame, *by: str) -> DataFrame:
    """Expressions of equal `by` aligned to one, in the order of their text."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        held, current = Held(), None
        for batch in batches:
            for row in batch.to_pylist():
                if current is not None and tuple(row[c] for c in by) != current and held.wrappers:
                    yield held.rows()
                current = tuple(row[c] for c in by)
                e = unpacked(json.loads(row["wrapper"]))
                held.add(row["host"], e, row["pages"])
        if held.wrappers:
            yield held.rows()

    return found.repartition(*by).sortWithinPartitions(*by, "wrapper").mapInArrow(run, _ROWS)


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """(host, pages, wrapper) of pages(host, html): one row for each host."""
    return joined(joined(expressions(pages), "host", "part"), "host").select("host", "pages", "wrapper")


def _extracted(pages: DataFrame) -> DataFrame:
    def run(batches) -> Iterator[pa.RecordBatch]:
        roles: dict[str, Role] = {}
        for batch in batches:
            page, wrapper = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("html", "wrapper"))
            texts = []
            for p, w in zip(page, wrapper, strict=True):
                if w not in roles:
                    if len(roles) > HELD_HOSTS:
                        roles.clear()
                    roles[w] = roles_of(unpacked(json.loads(w)))
                texts.append(main_text(p, roles[w]))
            columns = [*(batch.column(batch.schema.get_field_index(c)) for c in ("page_id", "url")), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])
        give_back()

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html", "wrapper").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def main_texts(pages: DataFrame, hot_share: int = HOT_SHARE, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages(page_id, url, html)."""
    whole_texts(pages)
    hosted = pages.select("page_id", "url", "html", split_url(F.col("url"))[0].alias("host"))
    found = cut(infer_wrappers(hosted), "wrappers")
    total, hosts = found.agg(F.sum("pages"), F.count("*")).first()
    hot = found.where(F.col("pages") * hot_share > (total or 0))
    named = {r.host: r.small for r in hot.select("host", (F.length("wrapper") <= hot_bytes).alias("small")).collect()}  # at most hot_share
    small, large = ([h for h, s in named.items() if s == kind] for kind in (True, False))
    is_small, is_large = (F.col("host").isin(x) if x else F.lit(False) for x in (small, large))
    wrappers = found.drop("pages")
    parts = []
    if small:
        parts.append(_extracted(hosted.where(is_small).join(F.broadcast(wrappers.where(is_small)), "host")))
    if hosts > len(small):
        dealt = hosted.where(~is_small).withColumn("salt", F.when(is_large, F.pmod(F.xxhash64("page_id", "html"), F.lit(SALTS))).otherwise(0))
        salted = wrappers.where(~is_small).withColumn("salt", F.explode(F.when(is_large, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
        parts.append(_extracted(dealt.join(salted.hint("merge"), ["host", "salt"])))
    if not parts:
        return _extracted(hosted.where("false").join(wrappers, "host"))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
