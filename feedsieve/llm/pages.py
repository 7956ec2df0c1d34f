"""Main text of HTML pages by composite text density."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame

# Markup vocabulary: element and attribute names with their usual meaning (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
DROPPED = frozenset("head script style noscript template iframe object svg canvas audio video nav footer aside button select option textarea input menu xmp noembed noframes title".split())
FLOWING = INLINE | frozenset("svg math canvas audio video object select button meter progress output script style noscript template iframe textarea picture embed".split())  # stand inside a sentence
WITHIN = frozenset("svg math select audio video object canvas".split())  # what they hold stands there too
SENTENCES = frozenset("p li td th dd dt h1 h2 h3 h4 h5 h6 blockquote figcaption caption pre".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search alert menu menubar toolbar".split())
DROPPED_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored sponsors promo promotion comment comments commentlist disqus respond replies reply "
    "sidebar widget widgets related recommended recommendations share sharing social newsletter subscribe subscription signup cookie cookies consent gdpr notice notices alert popup modal overlay "
    "menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer masthead topbar toolbar login search skip".split())
FORMS = frozenset("form fieldset dialog alertdialog".split())  # elements or roles
COMMENT_WORDS = frozenset("comment comments commentlist disqus respond replies reply".split())
COMMENT_PARTS = COMMENT_WORDS | frozenset("list area section body content form thread".split())
# Words that with those above make a name no less whole.
LAYOUT_WORDS = frozenset(
    "list area section container wrapper wrap box block inner outer item items bar button buttons icon icons link links left right top bottom header user users slot unit panel column col row group "
    "post posts article articles site module zone region form thread body".split())
NAME_WORDS = DROPPED_WORDS | LAYOUT_WORDS
SIBLINGS = {"li": ("li", {"ul", "ol", "menu"}), "dt": ("dt dd", {"dl"}), "dd": ("dt dd", {"dl"}), "tr": ("tr td th", {"table"}), "td": ("td th", {"tr", "table"}), "th": ("td th", {"tr", "table"}),
            "tbody": ("thead tbody tfoot tr td th", {"table"}), "tfoot": ("thead tbody tfoot tr td th", {"table"}), "option": ("option", {"select"})}
SCOPES = frozenset("table td th caption button object template html".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^"'<>]|"[^"<]*"|'[^'<]*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>|<[a-zA-Z/!?][^>]*\Z""", re.S)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style|itemprop)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WORDS = re.compile(r"[a-z]+")


class _Page:
    """Elements in page order (a child after its parent) and the page's text pieces with the element each belongs to."""

    def __init__(self, html: str) -> None:
        self.tag, self.parent, self.dropped, self.main = ["#page"], [-1], [False], [False]
        self.outer = [False]  # article and main elements that are in none
        self.named = [0]  # by a part of class or id: 1, by a whole class or id, or a form: 2, as comments: 3
        self.article = [0]  # outermost article around the element, itself included
        self.flowing, self.within = [False], [False]  # ends no sentence; and neither does what it holds
        self.pieces: list[tuple[int, str | None]] = []  # None: a block ends or begins
        self._read(html)

    def _open(self, tag: str, attributes: str, parent: int, in_article: bool) -> int:
        found = {k.lower(): (v or "").strip("\"'").lower() for k, v in _ATTRIBUTE.findall(attributes)} if attributes.strip("/ \n") else {}
        main = tag in ("article", "main") or found.get("role") == "main" or found.get("itemprop") == "articlebody"
        button = tag == "button" and self._sentence(parent)
        drop = tag in DROPPED and not button or tag == "header" and not in_article or found.get("role") in DROPPED_ROLES or "hidden" in found or found.get("aria-hidden") == "true" or bool(_HIDDEN.search(found.get("style", "")))
        named = 0
        if not drop and tag not in ("html", "body"):
            own = [_WORDS.findall(name) for name in (found.get("class", "") + " " + found.get("id", "")).split()]
            if any(not COMMENT_WORDS.isdisjoint(words) and COMMENT_PARTS.issuperset(words) for words in own):
                named = 3
            elif tag not in ("article", "main") or in_article:
                bad = [words for words in own if not DROPPED_WORDS.isdisjoint(words)]
                whole = tag in FORMS or found.get("role") in FORMS or any(NAME_WORDS.issuperset(words) for words in bad)
                # Inside an article a name of which only a part says so says something else.
                named = 2 if whole else int(bool(bad) and not self.article[parent])
        self.named.append(named)
        self.article.append(self.article[parent] or (len(self.tag) if tag == "article" or found.get("itemprop") == "articlebody" else 0))
        self.within.append(self.within[parent] or tag in WITHIN)
        self.flowing.append(tag in FLOWING or self.within[parent])
        self.tag.append(tag)
        self.parent.append(parent)
        self.dropped.append(drop or self.dropped[parent])
        self.main.append(main)
        self.outer.append(tag in ("article", "main") and not in_article)
        return len(self.tag) - 1

    def _sentence(self, node: int) -> bool:
        """Whether text at this place belongs to a paragraph, a list entry or the like."""
        while node > 0 and self.tag[node] in INLINE:
            node = self.parent[node]
        return self.tag[node] in SENTENCES

    def _read(self, html: str) -> None:
        stack, open_tags, articles, at, end = [0], {}, 0, 0, len(html)

        def close(depth: int) -> None:
            nonlocal articles
            while len(stack) > depth:
                node = stack.pop()
                open_tags[self.tag[node]] -= 1
                articles -= self.main[node]
                if not self.flowing[node]:
                    self.pieces.append((node, None))

        def close_to(names: tuple[str, ...], stops: frozenset | set) -> None:
            for depth in range(len(stack) - 1, 0, -1):
                if self.tag[stack[depth]] in names:
                    close(depth)
                    return
                if self.tag[stack[depth]] in stops:
                    return

        while at < end:
            m = _TAG.search(html, at)
            if m is None or m.start() > at:
                self.pieces.append((stack[-1], html[at : m.start() if m else end]))
            if m is None:
                break
            at = m.end()
            name = m[2] or m[5]
            if not name:
                continue
            tag, closing, attributes = name.lower(), m[1] or m[4], m[3] or m[6] or ""
            if closing:
                if open_tags.get(tag):
                    for depth in range(len(stack) - 1, 0, -1):
                        if self.tag[stack[depth]] == tag:
                            close(depth)
                            break
                continue
            if tag in CLOSES_P and open_tags.get("p"):
                close_to(("p",), SCOPES)
            if tag in SIBLINGS:
                names, stops = SIBLINGS[tag]
                while any(open_tags.get(n) for n in names.split()):
                    before = len(stack)
                    close_to(tuple(names.split()), stops)
                    if len(stack) == before:
                        break
            node = self._open(tag, attributes, stack[-1], articles > 0)
            if not self.flowing[node]:
                self.pieces.append((node, None))
            elif tag == "br":
                self.pieces.append((node, "\n"))
            if tag in RAW and not attributes.endswith("/"):
                ending = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(html, at)
                at = ending.end() if ending else end
            elif tag not in VOID:
                stack.append(node)
                open_tags[tag] = open_tags.get(tag, 0) + 1
                articles += self.main[node]
        close(1)


def _drop_named(page: _Page, chars: list[int], linked: list[int]) -> bool:
    """Drops what a name or a form sets apart; True if nothing were left then, and so nothing is dropped.

    What holds the largest marked article or main element stays, as its name tells of something else there, and so does what
    holds most of the characters outside links (comments not counted) of the article that it lies in, or of the page if
    nothing is marked. Beside a mark nothing that is named stays, however large. Articles that are in none stay for the
    search, but those named as comments are no marks.
    """
    n = len(chars)
    size = [0 if page.dropped[i] else chars[i] - linked[i] for i in range(n)]
    for i in range(n - 1, 0, -1):
        if page.named[i] < 3 or page.outer[i]:
            size[page.parent[i]] += size[i]
    page.main = [page.main[i] and page.named[i] < 3 for i in range(n)]
    marks = [i for i in range(1, n) if page.main[i] and size[i]]
    whole = [page.article[page.parent[i]] if i and marks else 0 for i in range(n)]
    stays = [page.outer[i] or (0 < page.named[i] < 3 and (whole[i] > 0 or not marks) and 2 * size[i] > size[whole[i]]) for i in range(n)]
    for some in ([i for i in marks if page.tag[i] == "article"], [i for i in marks if page.tag[i] != "article"]):
        i = max(some, key=lambda i: (size[i], -i), default=0)
        while i > 0:
            stays[i] = True
            i = page.parent[i]
    dropped = page.dropped[:]
    for i in range(1, n):
        dropped[i] = dropped[i] or dropped[page.parent[i]] or (page.named[i] > 0 and not stays[i])
    if not any(chars[i] and not dropped[i] for i in range(n)):
        return True
    page.dropped = dropped
    for i in range(1, n):
        if dropped[i]:
            chars[i] = linked[i] = 0
    return False


def _core(page: _Page, chars: list[int], linked: list[int], total: list[float]) -> int:
    """The element with the largest sum, moved to what the page marks: to the outermost article around it, else the
    outermost main element, else down to the marked element that holds most of its characters outside links."""
    n = len(chars)
    core = i = max(range(n), key=lambda i: (total[i] if chars[i] else -1.0, -i))
    around = []
    while i > 0:
        if page.main[i]:
            around.append(i)
        i = page.parent[i]
    if around:
        return ([i for i in around if page.tag[i] == "article"] or around)[-1]
    inside = [False] * n
    inside[core] = True
    for i in range(core + 1, n):
        inside[i] = inside[page.parent[i]]
    most = [i for i in range(core + 1, n) if inside[i] and (page.main[i] or page.outer[i]) and not page.dropped[i] and 2 * (chars[i] - linked[i]) > chars[core] - linked[core]]
    return max(most, key=lambda i: (page.tag[i] == "article", chars[i], -i), default=core)


def main_text(html: str | None) -> str:
    """The article of a page: its blocks, white space collapsed, joined by line ends.

    Each element's density is its characters per tag, lowered by the share of link characters and link tags (composite
    text density); an element's sum is that of its children's densities. The element with the largest sum is the
    article's core; the smallest density on its path up to the body is the threshold, and every subtree that is as
    dense belongs to it. What the page itself marks as article or main moves the core to the mark around it, or to the
    mark that holds most of it; articles beside a core that is one, if not mostly links, and articles of which some
    part is as dense as the threshold belong to the text as a whole. Scripts, menus, headers, footers and asides, known by
    element or role, never count. Adverts, notices, comments and the like, known by class or id, and forms do not either,
    unless they hold the core and are found to hold the page's article (`_drop_named`), or are all that the page has.
    """
    if not html:
        return ""
    page = _Page(html)
    n = len(page.tag)
    chars, linked, tags, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    in_link = [False] * n
    for i in range(1, n):
        in_link[i] = page.tag[i] == "a" or in_link[page.parent[i]]
    for node, piece in page.pieces:
        if piece and not page.dropped[node]:
            size = len(piece.strip())
            chars[node] += size
            linked[node] += size * in_link[node]
    bare = any(page.named) and _drop_named(page, chars, linked)
    for i in range(n - 1, 0, -1):
        if not page.dropped[i]:
            p = page.parent[i]
            chars[p] += chars[i]
            linked[p] += linked[i]
            tags[p] += tags[i] + 1
            link_tags[p] += link_tags[i] + (page.tag[i] == "a")
    if not chars[0]:
        return ""
    ratio, density, total = linked[0] / chars[0], [0.0] * n, [0.0] * n
    for i in range(n):
        if chars[i]:
            c, t, lc, lt = chars[i], max(tags[i], 1), max(linked[i], 1), max(link_tags[i], 1)
            density[i] = c / t * max(0.0, log(c / lc * t / lt)) / log(log(c / max(c - linked[i], 1) * lc + ratio * c + e))
    for i in range(1, n):
        total[page.parent[i]] += density[i]
    core = _core(page, chars, linked, total)
    keep, least, i = [False] * n, density[core], core
    while i > 0 and page.tag[i] not in ("body", "html"):
        least = min(least, density[i])
        i = page.parent[i]
    keep[core] = True
    if any(page.named) and not bare:  # what stayed for the search and is outside the core
        near, i = {core}, core
        while i > 0:
            near.add(i)
            i = page.parent[i]
        inside = [False] * n
        for i in range(1, n):
            inside[i] = i == core or inside[page.parent[i]]
            page.dropped[i] = page.dropped[i] or page.dropped[page.parent[i]] or (page.named[i] > 0 and i not in near and (page.outer[i] or not inside[i]))
    beside = page.parent[core] if page.tag[core] == "article" else -1
    for i in range(1, n):
        keep[i] = keep[i] or (page.tag[i] not in INLINE and page.tag[i] not in ("body", "html") and density[i] >= least > 0)
        keep[i] = keep[i] or (page.tag[i] == "article" and page.main[i] and page.parent[i] == beside and 2 * linked[i] < chars[i])
    # An article that belongs to the text in part belongs to it as a whole.
    partly = [keep[i] and not page.dropped[i] for i in range(n)]
    for i in range(n - 1, 0, -1):
        keep[i] = keep[i] or (partly[i] and page.tag[i] == "article" and page.main[i])
        partly[page.parent[i]] = partly[page.parent[i]] or partly[i]
    for i in range(1, n):
        keep[i] = (keep[i] or keep[page.parent[i]]) and not page.dropped[i]
    blocks, current = [], []
    for node, piece in page.pieces:
        if piece is None:
            blocks.append(current)
            current = []
        elif keep[node]:
            current.append(piece)
    blocks.append(current)
    lines = (" ".join(unescape("".join(b)).split()) for b in blocks if b)
    return "\n".join(line for line in lines if line)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x) for x in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """Main text of every row of `pages` (page_id, url, html): page_id, url, text and n_chars (code points).

    Null or empty html, or a page without text: empty text. Null ids or addresses are passed on; rows that repeat give a
    row each; other columns are not looked at. Empty input: empty result. A page is read whole, in one pass.
    """
    return pages.select("page_id", "url", "html").mapInArrow(_extract, "page_id bigint, url string, text string, n_chars bigint")
