"""Wrappers against a plain reading of known templates, and the inference by itself."""

import html
import itertools
import random
import re
import time

import pytest

from tracework.llm import queries as Q
from tracework.llm import wrappers as W
from tracework.session import table

PAGES = "page_id long, url string, html string, host string, wrapper string, salt int, text string"


def pages_of(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "y", 3, "z") for i, u, h in rows], PAGES)


def texts(frame):
    return {r.page_id: r.text for r in frame.collect()}


def fold(t):
    return " ".join(html.unescape(t).split())


@pytest.mark.parametrize("at", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_the_tables(spark, at):
    """The given pages have one article each, of headings and paragraphs with inline markup: read by that alone."""
    rows = table(spark, at, "pages").select("page_id", "url", "html").collect()
    want = []
    for r in rows:
        article = r.html[r.html.index("<article>") + 9 : r.html.index("</article>")]
        blocks = [fold(re.sub(r"<br>", " ", re.sub(r"</?b>", "", b))) for b in re.split(r"</?(?:h1|p)>", article)]
        text = "\n".join(b for b in blocks if b)
        want.append((r.page_id, r.url, text, len(text)))
    got = Q.QUERIES["op12_html_wrappers"](spark, at).select("page_id", "url", "text", "n_chars")
    assert sorted(map(tuple, got.collect())) == sorted(want)


class Site:
    """Pages of a layout of one's own: what is text is known, what stands around it varies from page to page."""

    def __init__(self, seed: int, semantic: bool, classes: bool) -> None:
        self.draw, self.semantic, self.classes = random.Random(seed), semantic, classes
        self.lines = [self.words(5) for _ in range(6)]

    def words(self, n):
        return " ".join("".join(self.draw.choice("bcdfglmnprst") + self.draw.choice("aeiou") for _ in range(self.draw.randint(1, 4))) for _ in range(n))

    def box(self, tag, name, inner):
        return f'<{tag}>{inner}</{tag}>' if self.semantic else f'<div class="{name}">{inner}</div>' if self.classes else f"<div>{inner}</div>"

    def page(self):
        links = "".join(f'<li><a href="/{i}">{self.words(2)}</a>' for i in range(self.draw.randint(3, 9)))
        blocks, parts = [self.words(6)], []
        parts.append(f"<h1>{blocks[0]}</h1>")
        for _ in range(self.draw.randint(2, 12)):
            kind, text = self.draw.random(), self.words(self.draw.randint(8, 40))
            if kind < 0.6:
                parts.append(f"<p>{text}" + self.draw.choice(["</p>", ""]))
            elif kind < 0.7:
                parts.append(f"<h2>{text}</h2>")
            elif kind < 0.8:
                more = [self.words(4) for _ in range(self.draw.randint(1, 4))]
                parts.append("<ul>" + "".join(f"<li>{m}" for m in more) + "</ul>")
                blocks.extend(more)
                continue
            elif kind < 0.9:
                parts.append(f"<blockquote><p>{text}</p></blockquote>")
            else:
                parts.append(f"<p>{text} &amp; <b>bold</b>,<br>\n  <a href=x>link</a>  &lt;end&gt;</p>")
                text += " & bold, link <end>"
            blocks.append(text)
        body = "\n".join(parts)
        body = f"<article>{body}</article>" if self.semantic else f'<div class="post-body">{body}</div>' if self.classes else f"<div>{body}</div>"
        around = [
            self.box("header", "masthead", f"<div>{self.lines[0]}</div>"), self.box("nav", "main-menu", f"<ul>{links}</ul>"),
            body, self.draw.choice(["", self.box("aside", "sidebar", f"<div>{self.lines[1]}</div><ul>{links}</ul>")]),
        ]
        if self.semantic or self.classes:
            around += [f'<section id="comments"><h3>{self.lines[2]}</h3><div><p>{self.words(60)}</p></div></section>', f'<div class="cookie notice">{self.words(9)}</div>']
        around += [f"<form><label>{self.lines[3]}</label><input name=q><button>go</button></form>", "<script>if (a < b) document.write('<p>no</p>')</script>", self.box("footer", "site-footer", f"<div>&copy; {self.lines[4]}</div>")]
        page = f"<!DOCTYPE html><html><head><title>{self.words(3)}</title><style>p > a {{}}</style></head><body>{''.join(around)}</body></html>"
        return page, "\n".join(blocks)


def sites(semantic, classes):
    rows, want, lines = [], {}, set()
    for s in range(4):
        site = Site(s, semantic, classes)
        lines |= set(site.lines)
        for i in range(30):
            page, text = site.page()
            rows.append((100 * s + i, f"https://www.site{s}.org/{i}", page))
            want[100 * s + i] = text
    return rows, want, lines


@pytest.mark.parametrize(("semantic", "classes"), [(True, False), (False, True)])
def test_other_layouts(spark, semantic, classes):
    """Elements by name or by class."""
    rows, want, _ = sites(semantic, classes)
    assert texts(W.main_texts(pages_of(spark, rows))) == want
    # the joins by shuffle, and by shuffle and salt, give the same rows
    for share, size in ((1, 1 << 20), (1_000, 0), (5, 0)):
        assert texts(W.main_texts(pages_of(spark, rows), share, size)) == want


def test_layouts_without_names(spark):
    """Containers that nothing tells apart: no block of the text is lost, and four pages in five, at least, are free of the
    template's lines and menus, which only their repeated text and their links tell."""
    rows, want, lines = sites(False, False)
    got = texts(W.main_texts(pages_of(spark, rows)))
    assert sum(bool(lines & set(t.split("\n"))) for t in got.values()) <= 0.2 * len(want)
    assert all(set(want[i].split("\n")) <= set(t.split("\n")) for i, t in got.items())
    assert sum(got[i] == want[i] for i in want) >= 0.8 * len(want)


def test_odd_pages(spark):
    rows = [
        (1, None, None), (2, "no scheme", ""), (3, "http://a.b/", "plain text &lt; only"), (4, "http://a.b/", "<p>one<p>two <!-- x"), (5, "http://a.b/", "<ul><li>x<li>y</ul>a < b <"),
        (6, "http://c.d/", "<article><h1>T</h1><p>a\n b</p></article>"), (6, "http://c.d/", "<article><h1>T</h1><p>a\n b</p></article>"), (None, "http://c.d/", "<main><div class=ad>x</div>kept</main>"),
        (7, "http://e.f/", "<div>" * 100_000 + "deep" + "</div>" * 100_000), (8, "http://e.f/", "<p>" * 5_000 + "x"), (9, "http://e.f/", "<nav>" + "<div>" * 500 + "menu"), (10, "http://g.h/", "<p>" + "long " * 400_000),
        (11, "http://i.j/", "<table><tr><td>a<td>b<tr><td>c</table>&#x41;&nbsp;&notin;&bogus;</p>"), (12, "http://i.j/", "<article><script>" + "<p>never</p>" * 10), (13, "http://i.j/", "<body class='has-sidebar'><form><article>in a form</article></form>"),
    ]
    want = {1: "", 2: "", 3: "plain text < only", 4: "one\ntwo", 5: "x\ny\na < b <", 6: "T\na b", None: "kept", 7: "deep", 8: "x", 9: "", 10: fold("long " * 400_000), 11: "a\nb\nc\nA ∉&bogus;", 12: "", 13: "in a form"}
    frame = W.main_texts(pages_of(spark, rows))
    assert frame.count() == len(rows) and texts(frame) == want
    assert W.main_texts(pages_of(spark, rows).where("false")).count() == 0


@pytest.mark.parametrize("bad", ["<", "<a", "<a ", "<a '", '<a "x', "</", "<!", "<!--", "<p", "<p>", "<li>", "<table><p>", "<td><p>", "&", "<b>", "<a>", "</div>", "<script>", "<x></y>", "<p><table>", "<div></p>", '<a ">', "<div class=a>", "<div class=ad>", "<span class=ad>"])
def test_time_is_linear_in_odd_markup(bad):
    took = []
    for n in (20_000, 80_000):
        began = time.process_time()
        W.expression_of(bad * n)
        took.append(time.process_time() - began)
    assert took[1] < max(0.6, 12 * took[0]) and took[1] < 20


def test_copies_of_one_article_keep_their_text(spark):
    """A host of nothing but copies: the article isn't taken for its template."""
    page, text = Site(5, True, False).page()
    rows = [(i, "http://copies.example/x", page) for i in range(40)]
    assert set(texts(W.main_texts(pages_of(spark, rows))).values()) == {text}


def shape(e):
    return W.signature(e).removeprefix("(").removesuffix(")")


def test_alignment():
    """Optional, repeated and group elements, as published for union-free expressions."""
    of = W.expression_of
    assert shape(of("<ul><li>a<li>b<li>c</ul>")) == "ul(li+(#))"
    assert shape(of("<dl><dt>a<dd>b<dt>c<dd>d</dl>")) == "dl((dt dd)+(dt(#) dd(#)))"
    held = W.Held()
    for page in ("<div><h1>t</h1><p>x</p></div>", "<div><h1>u</h1><p>y</p><p>z</p><hr></div>", "<div><h1>v</h1><blockquote>q</blockquote><p>w</p></div>", "<div><h1>w</h1></div>"):
        held.add("h", of(page))
    assert shape(held.wrappers["h"]) == "div(h1(#) blockquote?(#) p+?(#))"
    heading = held.wrappers["h"].kids[0].kids[0].kids[0]
    assert (heading.n, heading.chars, len(heading.sketch)) == (4, 4, 4)


def test_every_page_is_matched_by_its_wrapper():
    """Of random pages each element has a place in the wrapper, and packing loses nothing."""
    draw = random.Random(9)
    tags = ["div", "p", "h2", "ul", "section", "span"]

    def some(depth):
        out = []
        for _ in range(draw.randint(0, 4)):
            tag = draw.choice(tags)
            name = draw.choice(["", "", " class=a", " class=b"])
            out.append(draw.choice(["t ", ""]) + f"<{tag}{name}>" + (some(depth - 1) if depth else "w") + draw.choice([f"</{tag}>", f"</{tag}>", ""]))
        return "".join(out)

    pages = [some(3) for _ in range(150)]
    held = W.Held()
    for p in pages:
        held.add("h", W.expression_of(p))
    wrapper = held.wrappers["h"]
    again = W.unpacked(W.packed(wrapper))
    assert W.signature(again) == W.signature(wrapper) and W.packed(again) == W.packed(wrapper)
    role = W.roles_of(again)

    def matched(e, r):
        return all(k.label in r.places and (k.label == "#" or any(matched(k, r.kids[i]) for i in r.places[k.label])) for k in e.kids)

    assert all(matched(W.tree_of(p), role) for p in pages)
    total = sum(s.chars for p in pages for s in W.tree_of(p).slots())
    assert sum(s.chars for s in wrapper.slots()) == total


def test_longest_common_sequences():
    draw = random.Random(2)
    for _ in range(200):
        x, y = ([draw.choice("abc") for _ in range(draw.randint(0, 6))] for _ in range(2))
        pairs = W._pairs([W.Element(c) for c in x], [W.Element(c) for c in y])
        assert all(x[i] == y[j] for i, j in pairs) and all(a < c and b < d for (a, b), (c, d) in zip(pairs, pairs[1:]))
        best = max(k for k in range(7) for c in itertools.combinations(range(len(x)), k) if is_inside([x[i] for i in c], y))
        assert len(pairs) == best


def is_inside(part, whole):
    left = iter(whole)
    return all(c in left for c in part)
