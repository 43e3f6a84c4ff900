"""HTML extraction by tag-path ratios.

Text nodes are grouped by the path of tags from the root; where a class or id has the name of a page part, that is part of the path. Per
path, text length and punctuation are summed and set against its nodes, smoothed over neighbouring nodes in page order, and fused by
their product, with factors for what is a link, for an article and for the name. The paths whose mean is above the page's threshold hold
the content: a node is on one of them, or it goes. What stays beside them are short blocks that belong to them: headings and unmarked
blocks of an article or container with chosen nodes, or between chosen nodes, unless they are mostly links or a copyright line; and what
follows from the page's highest heading on. Names only weigh: where all prose of a page has one, the best of it is kept, unless the name is
that of an advert or the like.

Dropped outright are scripts, styles, forms, navigation and what else tags or roles say isn't text of the page. Time is linear in the page,
however deep its markup is nested.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from vitrine.llm.common import read, slices

#: Fixed values of HTML: elements whose content is raw text, that have no content, and that stand in the flow of a line.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "nobr", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "br", "math", "mi", "mo", "mn", "ms", "mtext", "mrow", "mfrac", "msqrt", "mroot", "msup", "msub", "msubsup", "mover", "munder", "munderover", "semantics"}
#: Elements that never hold main text.
BOILERPLATE = {"head", "nav", "footer", "aside", "form", "button", "select", "option", "input", "dialog", "menu", "svg", "annotation", "annotation-xml", "canvas", "object", "audio", "video"} | RAW
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar", "form"}
#: Words of the classes and ids of parts that are never main text, in the languages of the tables.
STRONG = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "masthead", "topbar", "footer", "colophon", "sidebar", "aside", "comment", "comments", "disqus", "replies", "respond", "cookie", "cookies", "consent", "gdpr", "modal", "popup", "newsletter", "subscribe", "subscription", "signup", "login", "share", "sharing", "social", "related", "recommended", "recommendations", "pagination", "pager", "toolbar",
    "werbung", "anzeige", "anzeigen", "kommentar", "kommentare", "seitenleiste", "fusszeile", "fußzeile", "kopfzeile", "menü", "teilen",
    "publicité", "publicite", "pub", "commentaire", "commentaires", "partager", "publicidad", "anuncio", "anuncios", "comentario", "comentarios", "compartir",
}
#: Words that such parts often have, and others too.
WEAK = {"banner", "promo", "promotion", "header", "rail", "widget", "widgets", "reply", "notice", "alert", "overlay", "search", "skip", "copyright", "legal", "disclaimer", "form", "hinweis", "avis", "aviso"}
MARKS = STRONG | WEAK
#: Words that say nothing of a part's kind; a name of these and of MARKS alone is that of such a part.
PLAIN_WORDS = {"area", "bar", "block", "box", "button", "buttons", "container", "content", "inner", "item", "items", "left", "links", "list", "main", "outer", "page", "post", "posts", "right", "section", "site", "top", "bottom", "wrap", "wrapper", "global", "primary", "secondary", "user", "the"}
HEADERS = {"header", "masthead", "topbar", "banner"}
#: What a name makes of a path's score: none, one that contains a word of MARKS or is of weak ones, one that is such a part's.
UNMARKED, CONTAINS, NAMED = 0, 1, 2
FACTORS = np.array([1.0, 0.1, 0.001])
#: What an article makes of it.
ARTICLE_FACTOR = 3.0
#: Text nodes from which a part of a weak name in an article is one of its sections.
SECTION_NODES = 3
#: Elements of prose, which may stand before or after all chosen nodes, and elements that may so in a container of them.
PROSE = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "figcaption"}
ITEMS = PROSE | {"li", "td", "th", "dt", "dd"}
_NOTICE = re.compile(r"\s*(?:©|\(c\)\s|copyright\b)", re.I)
#: A start tag of one of these ends an open paragraph.
ENDS_P = {"address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
#: Open elements that a start tag of the same kind ends, and the elements beyond which it ends none.
KINDS = {"p": 0, "li": 1, "dt": 2, "dd": 2, "tr": 3, "td": 4, "th": 4, "option": 5}
SCOPES = {"table", "ul", "ol", "dl"}
_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+(?=>|\Z)|[^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_PUNCTUATION = re.compile(r"[.,;:!?，。；：！？、]")
_ARTICLE = {"article", "main"}
#: Elements that, besides an article, can be the region of the main text.
CONTAINERS = {"body", "center", "div", "section", "table", "td"}
#: Of the mean score, the share at which a node counts as content.
THRESHOLD = 0.5
HEADINGS = {f"h{k}": k for k in range(1, 7)}


def _mark(name: str, marks: set[str]) -> int:
    """What a class or id says: UNMARKED, CONTAINS or NAMED."""
    words = re.findall(r"[^\W\d_]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower())
    if marks.isdisjoint(words):
        return UNMARKED
    return NAMED if not STRONG.isdisjoint(words) and all(w in marks or w in PLAIN_WORDS for w in words) else CONTAINS


def _section_like(name: str) -> bool:
    """A name of weak words alone."""
    words = re.findall(r"[^\W\d_]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower())
    return not WEAK.isdisjoint(words) and all(w in WEAK or w in PLAIN_WORDS for w in words)


def _read(tag: str, attributes: str, in_article: bool) -> tuple[bool, int, bool, bool]:
    """Whether an element is dropped with all that is in it, what its class and id say, whether it is an article, and whether all words of a
    name are weak."""
    #: A header within an article holds its title, one outside is the page's.
    if tag in BOILERPLATE or tag == "header" and not in_article:
        return True, UNMARKED, False, False
    if not attributes or attributes.isspace():
        return False, UNMARKED, tag in _ARTICLE, False
    values = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(attributes)}
    role = values.get("role", "").lower()
    hidden = "hidden" in values or values.get("aria-hidden", "").lower() == "true" or "display:none" in values.get("style", "").replace(" ", "").lower()
    marks = MARKS - HEADERS if in_article else MARKS
    names = [] if tag in ("html", "body", "article", "main") else [*values.get("class", "").split(), values.get("id", "")]
    named = max(map(_mark, names, repeat(marks)), default=UNMARKED)
    return hidden or role in ROLES, named, tag in _ARTICLE or role in _ARTICLE or values.get("itemprop", "").lower() == "articlebody", any(map(_section_like, names))


@dataclass
class Page:
    """Elements in page order, 0 is the root; and text nodes: (element, block, text) of what isn't dropped."""

    tags: list[str]
    parents: list[int]
    marks: list[int]
    articles: list[int]  # the outermost article around an element, itself included
    weak: list[int]  # the outermost element of a weak name within that article
    nodes: list[tuple[int, int, str]]


def parse(page: str) -> Page:
    out = Page([""], [-1], [UNMARKED], [0], [0], [])
    tags, dropped = out.tags, [False]
    stack, open_, kinds = [0], Counter(), [(0,) * 6]  # open elements, how many of each tag, the nearest of each kind in scope
    block, at = 0, 0

    def close(depth: int) -> None:
        nonlocal block
        closed = [tags[e] for e in stack[depth:]]
        block += not INLINE.issuperset(closed)
        open_.subtract(closed)
        del stack[depth:], kinds[depth:]

    def add(text: str) -> None:
        if text and not dropped[stack[-1]]:
            out.nodes.append((stack[-1], block, text))

    while at < len(page):
        m = _MARKUP.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if open_[tag] > 0:
                close(next(k for k in range(len(stack) - 1, 0, -1) if tags[stack[k]] == tag))
            elif tag not in INLINE:
                block += 1
            continue
        if tag in VOID:
            add(" ") if tag == "br" else None
            block += tag == "hr"
            continue
        near = kinds[-1]
        depth = near[0] if tag in ENDS_P else near[3] or near[4] if tag == "tr" else near[KINDS[tag]] if tag in KINDS else 0
        if depth:
            close(depth)
        block += tag not in INLINE
        above = stack[-1]
        is_dropped, mark, is_article, weak = _read(tag, m[3], out.articles[above] > 0)
        if out.articles[above] and mark == CONTAINS or is_article and out.marks[above] == CONTAINS:
            mark = UNMARKED
        else:
            mark = max(mark, out.marks[above])
        tags.append(tag), out.parents.append(above), out.marks.append(mark), dropped.append(dropped[above] or is_dropped)
        out.weak.append(out.weak[above] or (len(tags) - 1) * (weak and out.articles[above] > 0))
        out.articles.append(out.articles[above] or (len(tags) - 1) * (is_article and mark != NAMED))
        if m[0].endswith("/>") and tag in ("svg", "path"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        stack.append(len(tags) - 1)
        open_[tag] += 1
        kind = KINDS.get(tag)
        kinds.append((0,) * 6 if tag in SCOPES else kinds[-1] if kind is None else (*kinds[-1][:kind], len(stack) - 1, *kinds[-1][kind + 1 :]))
    return out


def tag_paths(page: Page) -> list[int]:
    """A number for each element's path of tags, and of what names say of them, from the root."""
    seen: dict[tuple[int, str, int], int] = {}
    path = [0] * len(page.tags)
    for e in range(1, len(path)):
        path[e] = seen.setdefault((path[page.parents[e]], page.tags[e], page.marks[e]), len(seen) + 1)
    return path


def content_scores(lengths: np.ndarray, marks: np.ndarray, paths: np.ndarray) -> np.ndarray:
    """The fused ratio of each node: its path's text and punctuation per node, each smoothed over neighbours in page order."""
    _, path = np.unique(paths, return_inverse=True)
    count = np.bincount(path)
    kernel = np.exp(-np.arange(-2, 3) ** 2 / 2.0)
    kernel /= kernel.sum()
    fused = np.ones(len(lengths))
    for feature in (lengths, marks + 1):
        ratio = (np.bincount(path, feature) / count)[path]
        fused *= np.convolve(np.pad(ratio, 2, mode="edge"), kernel, "valid")
    return fused


def chosen_nodes(lengths: np.ndarray, punctuation: np.ndarray, paths: np.ndarray, marks: np.ndarray, factors: np.ndarray | None = None) -> np.ndarray:
    """Whether each node is on a path whose mean score reaches the threshold: a share of the mean of the least marked nodes. factors: what
    else weighs a node's score."""
    scores = content_scores(lengths, punctuation, paths) * FACTORS[marks] * (1.0 if factors is None else factors)
    if marks.min() == NAMED:
        return np.zeros(len(scores), bool)
    _, path = np.unique(paths, return_inverse=True)
    mean = np.bincount(path, scores) / np.bincount(path)
    return (mean >= THRESHOLD * scores[marks == marks.min()].mean())[path]


def main_text(html_text: str | None) -> str:
    """The main text: blocks in page order joined by a newline, white space within a block one space, character references decoded."""
    page = parse(html_text or "")
    nodes = [(e, b, html.unescape(t)) for e, b, t in page.nodes]
    texts = [" ".join(t.split()) for _, _, t in nodes]
    filled = [i for i, t in enumerate(texts) if t]
    if not filled:
        return ""
    n, parents, paths = len(page.tags), page.parents, tag_paths(page)
    heading, linked, prose, item = [0] * n, [False] * n, [False] * n, [False] * n
    for e in range(1, n):
        up, tag = parents[e], page.tags[e]
        heading[e], linked[e], prose[e], item[e] = HEADINGS.get(tag, heading[up]), linked[up] or tag == "a", prose[up] or tag in PROSE, item[up] or tag in ITEMS
    of, block = [nodes[i][0] for i in filled], [nodes[i][1] for i in filled]
    lengths = np.array([len(texts[i]) for i in filled], float)
    in_section = Counter(page.weak[e] for e in of)
    #: A short part of a weak name in an article counts as marked.
    aside = np.array([page.weak[e] > 0 and in_section[page.weak[e]] < SECTION_NODES for e in of])
    marks = np.maximum([page.marks[e] for e in of], np.where(aside, CONTAINS, UNMARKED))
    path = np.array([2 * paths[e] for e in of]) + aside
    in_link, in_article = np.array([linked[e] for e in of]), np.array([page.articles[e] > 0 for e in of])
    notice = np.array([not page.articles[e] and bool(_NOTICE.match(texts[i])) for i, e in zip(filled, of, strict=True)])
    factors = (1 - _shares(path, lengths, in_link)) ** 2 * np.where(in_article, ARTICLE_FACTOR, 1.0) * np.where(_shares(path, lengths, notice) > 0.5, FACTORS[CONTAINS], 1.0)
    chosen = chosen_nodes(lengths, np.array([len(_PUNCTUATION.findall(texts[i])) for i in filled], float), path, marks, factors)
    anchors = {page.articles[e] or e for e, c in zip(of, chosen, strict=True) if c}
    if not anchors:
        return ""
    below, inside = [0] * n, [False] * n
    for e in range(n - 1, -1, -1):
        below[e] += e in anchors
        if e:
            below[parents[e]] += below[e]
    #: The lowest common ancestor of all anchors.
    region = max(e for e in range(n) if below[e] == len(anchors))
    while region and not (page.tags[region] in CONTAINERS or page.articles[region] == region):
        region = parents[region]
    inside[region] = True
    for e in range(region + 1, n):
        inside[e] = inside[parents[e]]
    whole = page.tags[region] in ("", "html", "body")
    of_links = _shares(np.array(block), lengths, in_link) > 0.5
    #: The outermost element of a marked part; one that only contains a word, or is of weak ones, counts as unmarked if most of it is chosen.
    part = [0] * n
    for e in range(1, n):
        part[e] = 0 if page.marks[e] == UNMARKED else part[parents[e]] if page.marks[e] == page.marks[parents[e]] else e
    plain = (marks == UNMARKED) | (marks == CONTAINS) & ~aside & (_shares(np.array([part[e] for e in of]), lengths, chosen) >= 0.5)
    picked = np.flatnonzero(chosen)
    first, last = picked[0], picked[-1]

    def belongs(k: int) -> bool:
        """Whether a node that isn't chosen stays."""
        e = of[k]
        if not plain[k] or not inside[e] or notice[k] or of_links[k] and not (heading[e] and page.articles[e] in anchors):
            return False
        return page.articles[e] in anchors or first <= k <= last or prose[e] or not whole and item[e]

    #: A block with a chosen node stays whole.
    of_chosen = _shares(np.array(block), lengths, chosen) > 0
    kept = [bool(c) or of_chosen[k] and marks[k] != NAMED or belongs(k) for k, c in enumerate(chosen)]
    #: What follows from the page's highest heading on, where that stands before the region.
    start = next((k for k in range(len(of)) if inside[of[k]]), len(of))
    fits = lambda k: plain[k] and not (of_links[k] and not heading[of[k]])
    highest = min((heading[e] for k, e in enumerate(of) if heading[e] and fits(k)), default=0)
    titled = next((k for k in range(start) if highest and heading[of[k]] == highest and fits(k)), start)
    for k in range(titled, start):
        kept[k] = kept[k] or fits(k)
    of_block = {b for b, k in zip(block, kept, strict=True) if k}
    dropped = {i for i, k in zip(filled, kept, strict=True) if not k}
    blocks: dict[int, list[str]] = {}
    for i, (_, b, t) in enumerate(nodes):
        if b in of_block and i not in dropped:
            blocks.setdefault(b, []).append(t)
    return "\n".join(t for t in (" ".join("".join(x).split()) for x in blocks.values()) if t)


def _shares(groups: np.ndarray, lengths: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Of each node's group, the share of text for which `of` holds."""
    _, group = np.unique(groups, return_inverse=True)
    return (np.bincount(group, lengths * of) / np.bincount(group, lengths))[group]


def extract(pages: DataFrame) -> DataFrame:
    """Per row of pages (page_id, url, html): page_id, url, text, n_chars. A null html is empty, its text too; repeated rows stay; no rows
    give none; other columns are ignored. Broken markup is read as browsers do in the main: an open tag at the end is dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "html"):
                texts = [main_text(x.as_py()) for x in rows.column("html")]
                yield pa.RecordBatch.from_arrays([rows.column("page_id"), rows.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    out = pages.select("page_id", "url", "html").schema
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {out['page_id'].dataType.simpleString()}, url string, text string, n_chars long")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))
