"""Main-text extraction: pages that are hard to read, and a plain second making of the path ratios."""

from __future__ import annotations

import os
import time
from html.parser import HTMLParser

import pyarrow.dataset as ds
import pytest

from siftworks.llm import html_extract as H

ARTICLE = "<article><h1>Title</h1><p>One, two. Three, four.</p></article>"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("""<script>if(a<b){s="it's"} if(c<d) s='x</script>""" + ARTICLE, "Title One, two. Three, four."),
        ("<script>var s='<!--';</script>" + ARTICLE, "Title One, two. Three, four."),
        (
            '<div class="article-header"><h1>Title</h1><p>The lead, which says it.</p></div><div class="body"><p>Long text, with commas, and more. Yes.</p><p>And more, quite so. Indeed.</p></div>',
            "Title The lead, which says it. Long text, with commas, and more. Yes. And more, quite so. Indeed.",
        ),
        ("<article><p>Text of it, long enough. And more, of it.</p><ul><li><a>Ref one</a><li><a>Ref two</a></ul></article><div class=comments><p>So good, yes!</p></div>", "Text of it, long enough. And more, of it. Ref one Ref two"),
        ('<form id="all"><div id=nav><a>Home</a></div><div class=post><h2>Hi</h2><p>Some text, here and there. On it goes.</p><p>Short.</p></div><div class=footer>All, rights.</div></form>', "Hi Some text, here and there. On it goes. Short."),
        ('<div class="promo"><p>The only prose of this page, though named oddly. It goes on, and on.</p></div><footer>x</footer>', "The only prose of this page, though named oddly. It goes on, and on."),
        ("<div class=content><p>Real text, it is. Long, and long.</p><div class=comments>" + "<p>I liked this, great. Very good! Yes, yes, I did.</p>" * 50 + "</div></div>", "Real text, it is. Long, and long."),
        ("<p>Don't <b>stop</b> <p don't>now, ok.</p><p>foo<x-y>bar</x-y>baz</p>", "Don't stop now, ok. foobarbaz"),
        ('<p title="a>b">x &lt;y&gt; 3 < 4, z.</p><!-- a > b --><![CDATA[ <p>no</p> ]]>', "x <y> 3 < 4, z."),
        ('<article><p>a, <span hidden>no</span>b.</p><div style="display: none">no, no.</div></article>', "a, b."),
        ("<p>text, here.</p><a href='x", "text, here."),
        # A page builder's names, contributions without a telling name, a notice in another language, a pointer to another story.
        ('<div class="elementor-widget-container"><p>The article stands here, in a builder page. It goes on, and on, for a while.</p><p>And more of it, quite a lot. Yes.</p></div><div class="note"><p>A note, beside it. It is short, yes.</p></div>',
         "The article stands here, in a builder page. It goes on, and on, for a while. And more of it, quite a lot. Yes. A note, beside it. It is short, yes."),
        ('<div class="widget"><p>The article stands here, in a widget. It goes on, and on, for a while.</p></div><footer>All, rights.</footer>', "The article stands here, in a widget. It goes on, and on, for a while."),
        ('<div class="text"><h1>Title</h1><p>The story begins here, slowly. It has many words, and some marks. So it goes on, for quite a while, as stories do.</p><p>And it ends, in time. The reader is glad, and so is the writer, at last.</p></div>'
         '<section class="reactions">' + "".join(f'<div class="item"><span class="who">user {i}</span><div class="when">May {i}</div><p>I liked it, a lot!</p></div>' for i in range(4)) + "</section>",
         "Title The story begins here, slowly. It has many words, and some marks. So it goes on, for quite a while, as stories do. And it ends, in time. The reader is glad, and so is the writer, at last."),
        ('<div class="talk">' + "".join(f'<div class="turn"><div class="who">{w}</div><p>{t}</p></div>' for w, t in (("Anna", "So it began, did it?"), ("Ben", "It did, and how. We went."), ("Anna", "And then, what came of it?"), ("Ben", "Nothing, at all."))) + "</div>",
         "Anna So it began, did it? Ben It did, and how. We went. Anna And then, what came of it? Ben Nothing, at all."),
        ('<div class="hinweis"><p>Diese Seite setzt Kekse ein, wie alle. Weiter so, oder nicht.</p></div><div class="beitrag"><p>Der Text des Beitrags, der lang ist. Er hat Kommas, Punkte, und mehr. So geht es fort.</p><p>Und weiter, bis zum Ende. Ja.</p></div>',
         "Der Text des Beitrags, der lang ist. Er hat Kommas, Punkte, und mehr. So geht es fort. Und weiter, bis zum Ende. Ja."),
        ('<main><article><h1>One</h1><p>The text of the article, long enough. It goes on, and on. There is more of it, and more, to be read here.</p><p>Then it ends, as it must. So be it, then.</p></article><article><h3><a href=x>Two</a></h3><p>Read that, too.</p></article></main>',
         "One The text of the article, long enough. It goes on, and on. There is more of it, and more, to be read here. Then it ends, as it must. So be it, then."),
        ('<article><p>The text of the article, long enough. It goes on, and on, and on.</p><article><p>First, said a reader.</p></article></article>', "The text of the article, long enough. It goes on, and on, and on."),
        ('<article><h2>A</h2><p>The first story, which is long enough. It goes on.</p></article><article><h2>B</h2><p>The second story, as long as it. It goes on, too.</p></article>', "A The first story, which is long enough. It goes on. B The second story, as long as it. It goes on, too."),
        ("<div class=widget>" * 300 + "<p>Deep, but there. It reads, as it should.</p>" + "</div>" * 300, "Deep, but there. It reads, as it should."),
    ],
)
def test_pages(page, want):
    assert H.main_text(page) == want


@pytest.mark.parametrize(
    "page",
    [
        "<p>x, y.</p><a " + '"x" ' * 250_000, "<p>x, y.</p>" + '<a title="x>' * 80_000, "<" * 1_000_000, "<![CDATA[" * 100_000, "<a" + " " * 1_000_000,
        "<div>" * 20_000 + "<p>x, y.</p>" + "</div>" * 20_000, "".join(f"<div class=c{i}>t, x." for i in range(20_000)), "<b>" * 20_000 + "<p>x, y.</p>" * 20_000,
        "<i>" * 20_000 + "</p>" * 20_000, "<ul><li>" * 20_000, "<div>" * 20_000 + "<i>x</i>" * 20_000, "<li><a>x" * 50_000,
    ],
)
def test_time_is_linear(page):
    began = time.process_time()
    H.main_text(page)
    assert time.process_time() - began < 1


class Plain(HTMLParser):
    """Blocks with their whole path as a tuple, for pages whose only implied end tags are those of p."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.open, self.words, self.blocks = ["html"], "", []
        self.feed(page)
        self.end()

    def end(self):
        text = " ".join(self.words.split())
        path = tuple(t for t in self.open if t.split(".")[0] in H.BLOCKS)
        if text and not {"title", "script", "style"} & set(self.open):
            self.blocks.append((path, text, "a" in self.open))
        self.words = ""

    def handle_starttag(self, tag, attributes):
        if tag == "br":
            self.words += " "
            return
        if tag in H.VOID or tag == "html":
            return
        if tag in H.BLOCKS or tag in ("script", "style"):
            self.end()
        if tag in H.CLOSE_P and "p" in self.open and not any(t in H.BLOCKS for t in self.open[self.open.index("p") + 1 :]):
            del self.open[self.open.index("p") :]
        self.open.append(tag + "." * bool(attributes and dict(attributes).get("class")) + (dict(attributes).get("class") or ""))

    def handle_endtag(self, tag):
        if tag in H.BLOCKS or tag in ("a", "script", "style"):
            self.end()
        names = [t.split(".")[0] for t in self.open]
        if tag in names and tag != "html":
            del self.open[len(names) - 1 - names[::-1].index(tag) :]

    def handle_data(self, data):
        self.words += data


def plain_scores(blocks, weight):
    """Fused scores by counting each path's blocks anew, from the definition."""
    paths = list(dict.fromkeys(p for p, _, _ in blocks))
    of = {p: [(t, a) for q, t, a in blocks if q == p] for p in paths}
    size = lambda p: sum(len(t) for t, _ in of[p])
    menu = lambda p: sum(len(t) for t, a in of[p] if a) > 0.6 * size(p) and size(p) < 60 * len(of[p])
    live = [p for p in paths if "article" in p or not menu(p)]
    length = {p: size(p) / len(of[p]) for p in live}
    marks = {p: (sum(t.count(c) for t, _ in of[p] for c in ".,;:!?…。，；：！？、") + 0.5) / len(of[p]) for p in live}
    out = {}
    for i, p in enumerate(live):
        near = [p, p, *live[max(0, i - 1) : i], *live[i + 1 : i + 2]]
        mean = lambda of_, near=near: sum(of_[q] for q in near) / len(near)
        out[p] = mean(length) * mean(marks) * (len(of[p]) if weight[p] > 0.3 else H.log2(1 + len(of[p]))) * weight[p]
    return out


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no driver tables")
def test_ratios_equal_a_plain_making():
    pages = ds.dataset("/root/testdata/sf0.01/pages.parquet").to_table().column("html").to_pylist()
    assert pages
    for page in filter(None, pages):
        blocks = Plain(page).blocks
        weight = {p: 0.0 if {"nav", "footer"} & set(p) else 0.01 if "div.ad" in p else 1.0 for p, _, _ in blocks}
        want = plain_scores(blocks, weight)
        made = H.read(page)
        _, got = H.ratios(made)
        assert not any(H.listed(made, H.ratios(made)[0]))
        assert list(got.values()) == pytest.approx(list(want.values()))
        # On these pages the paths over the threshold, and what stands under their common path, are the article.
        best = max(want.values())
        core = [p for p, s in want.items() if s >= 0.1 * best and weight[p] > 0.3]
        assert all("article" in p for p in core)
        assert H.main_text(page) == " ".join(t for p, t, _ in blocks if "article" in p)
