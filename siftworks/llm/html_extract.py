"""Main text of web pages by tag-path ratios.

A page is read into text blocks, each with the path of tags from the root to it.
All blocks of one path are taken together: their text length for each occurrence and
their punctuation make the path's two ratios. Ratios are smoothed over neighbouring
paths in page order and fused; names and tags that tell of a page's frame weigh on the
fused score. Paths over the threshold are content. The innermost element that holds
nearly all of them bounds the article. Among them there, a lower threshold, on the
weight alone, takes in headlines, short paragraphs, tables and lists.

Lists of contributions, such as readers' comments, are known by their items: elements of one path, each with prose
and a line of few characters beside it, without headlines, that have less than half of the page's text.
Article elements of one path are told apart: one that is short beside the longest and links elsewhere
is a pointer to another story, and one inside the longest is a comment.

A name weighs on a score and decides nothing alone: where a page's only prose has such
a name, or all of it stands in a form, its paths are still those of the highest score.

The reader passes over a page once, as browsers do: quotes count in values of
attributes only, scripts and the like end at their own end tag, comments at theirs.
Open elements and paths are found by number, so time is linear in the page, at any
depth of nesting.

Defined results: null and empty html give an empty text; unclosed and crossed tags are
closed as browsers do, for the tags that matter here; a tag that the page ends in is
no text; text outside any tag counts as the body's; a page of nothing but menus,
footers and the like gives an empty text; no length limit; repeated rows get equal
results; extra columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from math import log2

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, table

_TAG = re.compile(r"</?([a-zA-Z][^\s/>]*+)")
_ATTRIBUTE = re.compile(r"[\s/]*+(?:(=?[^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?+)")
_PUNCTUATION = re.compile(r"[.,;:!?…。，；：！？、]")
_SPACE = re.compile(r"\s+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

# Fixed values from the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe xmp noframes noembed".split())
#: Block tags close an open paragraph.
CLOSE_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
#: All other tags, unknown ones too, stand inside a line of text.
BLOCKS = CLOSE_P | frozenset("html head body li dt dd tr td th thead tbody tfoot caption colgroup option optgroup select button legend noscript template object svg canvas audio video textarea iframe xmp noframes noembed title script style".split()) - {"script", "style"}
#: Open tags that a start tag closes, up to a tag that bounds the search.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",)), "tbody": (("thead", "tbody"), ("table",)), "tfoot": (("thead", "tbody"), ("table",)), "body": (("head",), ("html",)),
}
HEADLINES = frozenset("h1 h2 h3 h4 h5 h6".split())
ARTICLE_TAGS = frozenset("main article".split())

#: Tags that are never the article, tags of a page's frame, and those of what is not shown as text.
OTHER_TAGS = frozenset("nav footer button select menu dialog".split())
FRAME_TAGS = frozenset("aside form header search".split())
UNSHOWN_TAGS = frozenset("head noscript template object svg canvas audio video".split())
#: Parts of class, id or role names that tell of the frame whatever stands beside them ...
FRAME_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion promoted nav navbar navigation menu breadcrumb breadcrumbs sidebar sidebars footer masthead "
    "comment comments commentlist disqus feedback cookie cookies consent gdpr popup modal newsletter subscribe subscription signup login share sharing pagination pager toolbar outbrain taboola "
    # the same in German, French and Spanish
    "werbung anzeige anzeigen kommentar kommentare hinweis hinweise seitenleiste fusszeile kopfzeile brotkrumen publicite pub annonce annonces commentaire commentaires temoins bandeau "
    "publicidad anuncio anuncios comentario comentarios galletas aviso avisos suscripcion".split()
)
#: ... and those that do if nothing else does: an ``article-header`` is the article's, a ``site-header`` the page's.
FAINT_NAMES = frozenset(
    "aside header reply replies respond notice notices alert overlay social related recommended recommendations skip search copyright legal disclaimer hidden complementary contentinfo dialog tags toc".split()
)
PLACE_NAMES = frozenset("site page top bottom left right main global web the box block bar list area wrapper wrap container inner outer section content group js l m u c".split())
_NAME_PART = re.compile(r"[A-Za-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

#: What a frame tag, a frame name, a faint name beside others, and being hidden leave of a score.
FRAME_TAG, FRAME, FAINT, HIDDEN = 0.003, 0.01, 0.5, 0.0001
#: What marks leave at least, however many lie on a path.
LEAST = 1e-9
#: Shares of the best score that a content path has, and of the best path's weight that a path among them has.
CONTENT, WITHIN = 0.1, 0.3
#: Share of the content's text that the container holds.
HELD = 0.9
#: A path is a menu if links make this share of its text and a block of it has fewer characters.
MENU_LINKS, MENU_CHARS = 0.6, 60


#: Tags of a list's items, how many make a list, the share of them that have prose and a line, and characters of such a line.
ITEM_TAGS, ITEMS, ITEM_SHARE, BYLINE = frozenset("div section article li".split()), 3, 0.6, 40
#: An article element with less than this share of the longest one's text beside it is a pointer to another story if it
#: has a link or at most so many blocks.
POINTER, POINTER_BLOCKS = 0.25, 2


class Page:
    """Paths by number, each after its parent, and the text blocks in page order."""

    def __init__(self) -> None:
        self.parent, self.tag, self.weight = [-1], ["html"], [1.0]
        self.article = [False]  # inside an article or main
        self.opened = [1]  # how many elements have each path
        self.known: dict[tuple[int, str, str, float], int] = {}
        self.blocks: list[tuple[int, str, int, int]] = []  # path, text, characters in links, article element
        self.around = [0]  # of each article element: the one around it, 0 for none

    def path(self, above: int, tag: str, label: str, weight: float) -> int:
        key = (above, tag, label, weight)
        found = self.known.get(key)
        if found is None:
            found = self.known[key] = len(self.parent)
            self.parent.append(above)
            self.tag.append(tag)
            both = self.weight[above] * weight
            self.weight.append(max(both, LEAST) if both else 0.0)
            self.article.append(self.article[above] or tag in ARTICLE_TAGS)
            self.opened.append(0)
        self.opened[found] += 1
        return found


def _name_weight(value: str) -> float:
    """What the names in a class, id or role attribute leave of a score."""
    least = 1.0
    for word in value.split():
        parts = [p.lower() for p in _NAME_PART.findall(_CAMEL.sub(" ", word))]
        if not parts or parts[0] in {"has", "with", "without", "no"} or parts[-1] in {"open", "closed", "enabled", "disabled"}:
            continue  # names that tell of a page's parts, not of this one
        if any(p in FRAME_NAMES for p in parts):
            least = FRAME
        elif any(p in FAINT_NAMES for p in parts):
            least = min(least, FRAME if all(p in FAINT_NAMES or p in PLACE_NAMES for p in parts) else FAINT)
    return least


def _attributes(page: str, at: int) -> tuple[int, bool, str, float]:
    """End of a start tag (-1 if the page ends first), whether it closes itself, its first class, and its weight."""
    label, weight = "", 1.0
    while True:
        m = _ATTRIBUTE.match(page, at)
        at = m.end()
        name = m[1].lower()
        if not name:
            if at >= len(page):
                return -1, False, label, weight
            if page[at] == ">":
                return at + 1, page[at - 1] == "/", label, weight
            at += 1
            continue
        if name in ("class", "id", "role"):
            value = m[2] or m[3] or m[4] or ""
            weight = min(weight, _name_weight(value))
            if name == "class" and value.split():
                label = value.split()[0].lower()
        elif name == "hidden" or name == "style" and _HIDDEN.search(m[2] or m[3] or m[4] or ""):
            weight = HIDDEN
        elif name == "aria-hidden" and (m[2] or m[3] or m[4] or "").lower() == "true":
            weight = min(weight, FRAME)


def read(page: str) -> Page:
    """Text blocks of a page in order, white space collapsed, references decoded."""
    out = Page()
    stack: list[tuple[str, int]] = [("html", 0)]  # tag, path
    where: dict[str, list[int]] = defaultdict(list)  # places in the stack of each open tag
    where["html"].append(0)
    block_at = [0]  # places in the stack of what is not inside a line
    units = [0]  # open article elements
    parts: list[str] = []
    linked = 0

    def end_block() -> None:
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", "".join(parts)).strip(" ")
            if text:
                out.blocks.append((stack[-1][1], text, min(linked, len(text)), units[-1]))
            parts.clear()
        linked = 0

    def text_of(a: int, b: int) -> None:
        nonlocal linked
        if b > a:
            t = page[a:b]
            if "&" in t:
                t = entities.unescape(t)
            parts.append(t)
            if where["a"]:
                linked += len(t)

    def pop(to: int) -> None:
        while len(stack) > to:
            tag = stack.pop()[0]
            where[tag].pop()
            if tag == "article":
                units.pop()
            if block_at[-1] >= len(stack):
                block_at.pop()

    def last(*tags: str) -> int:
        return max((where[t][-1] for t in tags if where[t]), default=-1)

    at = look = 0
    no_cdata_end = False
    while True:
        lt = page.find("<", look)
        if lt < 0:
            text_of(at, len(page))
            break
        m = _TAG.match(page, lt)
        if m is None:
            following = page[lt + 1 : lt + 2]
            if following not in ("!", "?", "/") or not following:
                look = lt + 1  # a sign, not a tag
                continue
            text_of(at, lt)
            if page.startswith("<!--", lt):
                end = lt + 5 if page.startswith("<!-->", lt) else page.find("-->", lt + 4) + 3
                end = len(page) if end == 2 else end
            else:
                end = 0
                if not no_cdata_end and page.startswith("<![CDATA[", lt):
                    end = page.find("]]>", lt) + 3
                    no_cdata_end = end == 2
                if end <= 2:
                    end = page.find(">", lt) + 1 or len(page)
            at = look = end
            continue
        text_of(at, lt)
        closing, tag = page[lt + 1] == "/", m[1].lower()
        at, closed, label, weight = _attributes(page, m.end())
        look = at
        if at < 0:
            break  # a tag that the page ends in
        if tag == "br":
            parts.append(" ")
            continue
        block = tag in BLOCKS
        if closing:
            if tag == "p" and not where["p"]:
                end_block()
                continue
            if block:
                end_block()
            to = where[tag][-1] if where[tag] else 0
            if to <= 0 or not block and block_at[-1] > to or tag in ("p", "li", "td", "tr") and last("article", "main", "table", "body") > to:
                continue  # it closes nothing: an inline end tag nothing outside its block
            if not block and block_at[-1] == to:  # a marked part of a line
                end_block()
            pop(to)
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            if tag not in ("script", "style"):
                end_block()
            if end:
                stop = page.find(">", end.end())
                at = look = stop + 1 if stop >= 0 else len(page)
            elif not closed:
                at = look = len(page)
            continue
        if tag in VOID:
            if block:  # a rule
                end_block()
            continue
        if closed and not block:
            continue
        split = not block and weight < WITHIN  # a marked part of a line is a block of its own
        if block:
            end_block()
            if tag in CLOSE_P and where["p"] and where["p"][-1] >= block_at[-1]:
                pop(where["p"][-1])
            if tag in CLOSES:
                ends, bounds = CLOSES[tag]
                if (to := last(*ends)) > max(0, last(*bounds)):
                    pop(to)
            if tag in ("html", "body") and where[tag]:
                continue
        elif split:
            end_block()
        elif tag == "a" and where["a"] and where["a"][-1] > block_at[-1]:
            pop(where["a"][-1])  # links don't nest
        above = stack[-1][1]
        if block or split:
            if tag in UNSHOWN_TAGS or tag in OTHER_TAGS:
                weight = 0.0
            elif tag in FRAME_TAGS and not (tag == "header" and out.article[above]):
                weight = min(weight, FRAME_TAG)
            elif tag in ("html", "body", "main", "article") and weight > HIDDEN and label not in ("comment", "comments"):
                weight = 1.0  # names of the page's own frame also sit on containers of the article
            above = out.path(above, tag, label, weight)
            block_at.append(len(stack))
        where[tag].append(len(stack))
        stack.append((tag, above))
        if tag == "article":
            out.around.append(units[-1])
            units.append(len(out.around) - 1)
        if closed and tag in ("svg", "canvas"):
            pop(len(stack) - 1)
    end_block()
    return out


def _smoothed(values: list[float]) -> list[float]:
    """Weighted means over neighbours: 1, 2, 1."""
    n = len(values)
    out = []
    for i in range(n):
        near = [(values[j], 2 if j == i else 1) for j in (i - 1, i, i + 1) if 0 <= j < n]
        out.append(sum(v * w for v, w in near) / sum(w for _, w in near))
    return out


def ratios(page: Page) -> tuple[dict[int, list[int]], dict[int, float]]:
    """Of each path, in page order: text length, punctuation, blocks and characters in links; and its fused score.

    Menus have no score. Repetition counts for a path's mass, though only by its logarithm
    where a frame's name weighs on the path: lists of comments and adverts repeat as well.
    """
    found: dict[int, list[int]] = {}
    for path, text, linked, _ in page.blocks:
        row = found.setdefault(path, [0, 0, 0, 0])
        row[0] += len(text)
        row[1] += len(_PUNCTUATION.findall(text))
        row[2] += 1
        row[3] += linked
    order = [p for p, r in found.items() if page.article[p] or not is_menu(r)]
    length = _smoothed([found[p][0] / found[p][2] for p in order])
    punctuation = _smoothed([(found[p][1] + 0.5) / found[p][2] for p in order])
    usual = WITHIN * max((page.weight[p] for p in order), default=1.0)
    mass = [found[p][2] if page.weight[p] > usual else log2(1 + found[p][2]) for p in order]
    return found, {p: a * b * m * page.weight[p] for p, a, b, m in zip(order, length, punctuation, mass, strict=True)}


def is_menu(row: list[int]) -> bool:
    """Paths of short texts that are links for the most part are menus, whatever they are called."""
    return row[3] > MENU_LINKS * row[0] and row[0] < MENU_CHARS * row[2]


def listed(page: Page, found: dict[int, list[int]]) -> list[bool]:
    """Whether each path is inside the items of a list of contributions, such as readers' comments, whatever their names.

    Items are elements of one path under a single element; each has prose and a line of few characters that is no sentence (who
    wrote it, and when) but no headline. A list with most of the page's text is the article itself, such as an interview.
    """
    n = len(page.parent)
    size, prose, lines, headed = ([0] * n for _ in range(4))
    for p, (length, punctuation, times, _) in found.items():
        if not page.weight[p]:
            continue
        size[p] += length
        short = length < BYLINE * times and punctuation < times
        (lines if short else prose)[p] += times
        headed[p] += page.tag[p] in HEADLINES
    for p in range(n - 1, 0, -1):
        for column in (size, prose, lines, headed):
            column[page.parent[p]] += column[p]
    out = [False] * n
    for p in range(1, n):
        times = page.opened[p]
        item = page.tag[p] in ITEM_TAGS and times >= ITEMS and page.opened[page.parent[p]] * ITEMS <= times
        whole = min(prose[p], lines[p]) >= ITEM_SHARE * times and not headed[p] and 2 * size[p] < size[0]
        out[p] = out[page.parent[p]] or item and whole
    return out


def chosen(page: Page) -> list[bool]:
    """Whether each path is the article's."""
    found, score = ratios(page)
    contributed = listed(page, found)
    score = {p: s for p, s in score.items() if not contributed[p]}
    n = len(page.parent)
    if not score:
        return [False] * n
    best = max(score, key=score.__getitem__)
    if not score[best]:
        return [False] * n
    unmarked = WITHIN * page.weight[best]  # the best path may stand in a form or have a frame's name itself
    core = {p for p, s in score.items() if s >= CONTENT * score[best] and page.weight[p] > unmarked}
    held, rest = [0] * n, [0] * n  # content text, and paths of other kinds that don't read like an article
    for p in score:
        if p in core:
            held[p] = found[p][0]
        elif page.weight[p] > unmarked:
            length, punctuation, times, _ = found[p]
            rest[p] = page.tag[p] not in HEADLINES and punctuation < times and length < MENU_CHARS * times
    for p in range(n - 1, 0, -1):
        held[page.parent[p]] += held[p]
        rest[page.parent[p]] += rest[p]
    # The deepest element with nearly all content text ...
    container, within = 0, HELD * held[0]
    for p in range(n):
        if page.parent[p] == container and held[p] >= within:
            container = p
    if container in found and container and page.tag[container] not in ("article", "main", "div", "section", "body"):
        container = page.parent[container]
    # ... grows while what it takes in besides reads like the article: headlines and punctuated or longer text.
    while container and rest[page.parent[container]] == rest[container]:
        container = page.parent[container]
    p = container
    while p and page.tag[p] not in ARTICLE_TAGS:
        p = page.parent[p]
    container = p or container
    inside, out = [False] * n, [False] * n
    for p in range(n):
        inside[p] = p == container or p > 0 and inside[page.parent[p]]
        out[p] = inside[p] and p in score and page.weight[p] > unmarked
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    made = read(page)
    of = chosen(made)
    kept = [b for b in made.blocks if of[b[0]]]
    other = other_articles(made, kept)
    return " ".join(text for _, text, _, unit in kept if unit not in other)


def other_articles(page: Page, kept: list[tuple[int, str, int, int]]) -> set[int]:
    """Article elements that point to other stories, and those inside the longest one, which HTML has for comments.

    Elements of one path are told apart here, as paths can't.
    """
    size, linked, blocks = defaultdict(int), defaultdict(int), defaultdict(int)
    for _, text, links, unit in kept:
        size[unit] += len(text)
        linked[unit] += links
        blocks[unit] += 1
    if len(page.around) < 3:
        return set()
    longest = max(range(1, len(page.around)), key=lambda u: (size[u], -u))
    out: set[int] = set()
    for u in range(1, len(page.around)):
        above = page.around[u]
        pointer = size[u] < POINTER * size[longest] and (linked[u] or blocks[u] <= POINTER_BLOCKS)
        if u != longest and (above in out or above == longest and size[u] < size[longest] or not above and pointer):
            out.add(u)
    return out


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), column: str = "html") -> DataFrame:
    def make():
        def call(texts, _):
            made = [main_text(t) for t in texts]
            return {"text": made, "n_chars": [len(t) for t in made]}

        return call

    return map_texts(pages, make, "text string, n_chars long", keep, text=column)


def op2_tag_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", F.col("html")))
