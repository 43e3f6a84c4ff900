"""HTML extraction: path ratios against plain Python, names of parts, and time in deep markup."""

from __future__ import annotations

import html
import math
import time

import numpy as np
import pytest

from vitrine.llm import html_tpr

LONG = [f"<p>Sentence {k}, which is long enough to count, has commas; it ends here.</p>" for k in range(6)]
PLAIN = [x[3:-4] for x in LONG]


def plain_choice(page: html_tpr.Page) -> list[tuple[str, str, bool]]:
    """(path, text, whether chosen) of the nodes with text, from lists and loops alone."""
    rows = []
    for e, _, t in page.nodes:
        text = " ".join(html.unescape(t).split())
        path = []
        while e > 0:
            path.append((page.tags[e], page.marks[e]))
            e = page.parents[e]
        if text:
            rows.append(("/".join(f"{t}{m}" for t, m in reversed(path)), text, path[0][1] if path else 0))
    if not rows:
        return []
    kernel = [math.exp(-(d * d) / 2) for d in range(-2, 3)]
    kernel = [k / sum(kernel) for k in kernel]
    scores = [html_tpr.FACTORS[mark] for *_, mark in rows]
    for feature in (len, lambda t: 1 + sum(c in ".,;:!?，。；：！？、" for c in t)):
        of_path: dict[str, list[int]] = {}
        for path, text, _ in rows:
            of_path.setdefault(path, []).append(feature(text))
        ratio = [sum(of_path[p]) / len(of_path[p]) for p, *_ in rows]
        scores = [s * sum(kernel[d + 2] * ratio[min(max(i + d, 0), len(rows) - 1)] for d in range(-2, 3)) for i, s in enumerate(scores)]
    least = min(mark for *_, mark in rows)
    own = [s for s, (*_, mark) in zip(scores, rows, strict=True) if mark == least]
    by_path: dict[str, list[float]] = {}
    for s, (p, *_) in zip(scores, rows, strict=True):
        by_path.setdefault(p, []).append(s)
    level = html_tpr.THRESHOLD * sum(own) / len(own)
    return [(p, t, least < html_tpr.NAMED and sum(by_path[p]) / len(by_path[p]) >= level) for p, t, _ in rows]


def test_path_ratios_by_brute_force(spark) -> None:
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html").collect()]
    pages += [f"<div class=sidebar>{LONG[0]}</div><div class='has-sidebar'>{''.join(LONG)}</div><div class=ad>{LONG[1]}</div><ul><li>x<li>y</ul>", "<div class=ad>x, y.</div>"]
    for page in pages:
        parsed = html_tpr.parse(page or "")
        paths = html_tpr.tag_paths(parsed)
        nodes = [(e, " ".join(html.unescape(t).split())) for e, _, t in parsed.nodes]
        nodes = [(e, t) for e, t in nodes if t]
        want = plain_choice(parsed)
        assert [t for _, t in nodes] == [t for _, t, _ in want]
        if nodes:
            marks = [len(html_tpr._PUNCTUATION.findall(t)) for _, t in nodes]
            got = html_tpr.chosen_nodes(np.array([len(t) for _, t in nodes], float), np.array(marks, float), np.array([paths[e] for e, _ in nodes]), np.array([parsed.marks[e] for e, _ in nodes]))
            assert got.tolist() == [c for *_, c in want]
            #: Every node on a chosen path is in the text.
            text = html_tpr.main_text(page).replace("\n", " ")
            assert all(t in text for _, t, c in want if c)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<article>{LONG[0]}<section id='legal-history'><h2>History</h2>{LONG[1]}</section></article>", [PLAIN[0], "History", PLAIN[1]]),
        (f"<article>{LONG[0]}<div class='search-results-discussion'><p>Short</p></div></article>", [PLAIN[0], "Short"]),
        (f"<article>{LONG[0]}<p>So <math><mi>a</mi><mo>=</mo><mn>1</mn></math> holds.</p></article>", [PLAIN[0], "So a=1 holds."]),
        (f"<div class='layout has-sidebar'><h1>Title</h1>{''.join(LONG)}</div><div class='ad'>Buy, now. Yes!</div>", ["Title", *PLAIN]),
        (f"<article>{''.join(LONG)}<section class='comments'>{LONG[0] * 9}</section></article>", PLAIN),
        (f"<div>{''.join(LONG)}</div><div id='cookie-notice'>{LONG[0] * 3}</div><div class='relatedPosts'><article>{LONG[1]}</article></div>", PLAIN),
        ("<div class='ad'>Only, an advert.</div>", []),
        (f"<table><tr><td><ul><li>Home<li>About</ul><tr><td>{''.join(LONG)}</table>", PLAIN),
        (f"<p a='x' b=\"><b>bold</b></p>{''.join(LONG)}", ["bold", *PLAIN]),
    ],
)
def test_names_of_parts(page: str, text: list[str]) -> None:
    assert html_tpr.main_text(page) == "\n".join(text)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<body><div class='widget'>{''.join(LONG)}</div>", PLAIN),
        (f"<body><div class='alert post'>{''.join(LONG)}</div>", PLAIN),
        (f"<body><div class='widget'><p>Buy this, now.</p></div><div>{''.join(LONG)}</div><div class='notice'><p>We changed our terms, see here.</p></div>", PLAIN),
        (f"<article>{LONG[0]}<section id='legal'><h2>Law</h2>{''.join(LONG[1:5])}</section></article>", [PLAIN[0], "Law", *PLAIN[1:5]]),
        (f"<article>{''.join(LONG)}<section class='reply'><h2>An answer</h2>{LONG[1]}{LONG[2]}</section></article>", [*PLAIN, "An answer", PLAIN[1], PLAIN[2]]),
        (f"<article>{''.join(LONG)}<div class='notice'>Cookies, again.</div></article>", PLAIN),
        (f"<body>{LONG[0]}<ul><li><a href=/>Home</a><li><a href=/s>Shop</a></ul>{LONG[1]}", [PLAIN[0], PLAIN[1]]),
        (f"<body><div><a href=/>Home</a> <a href=/a>About</a></div>{''.join(LONG)}<div>Copyright 2020 Some Shop, all rights reserved.</div>", PLAIN),
        (f"<body><div class='werbung'><p>Kaufen Sie, jetzt, hier. Los!</p></div>{''.join(LONG)}<div class='kommentare'>{LONG[0]}{LONG[1]}</div>", PLAIN),
        (f"<body><h1>Title</h1><div class=body>{''.join(LONG[:3])}</div><div class=body>{''.join(LONG[3:])}</div>", ["Title", *PLAIN]),
        (f"<article>{LONG[0]}{LONG[1]}</article><article>{LONG[2]}{LONG[3]}</article>", PLAIN[:4]),
        (f"<article><h1><a href=/x>Title</a></h1><p>Short.</p>{''.join(LONG)}<ul><li>one<li>two</ul></article>", ["Title", "Short.", *PLAIN, "one", "two"]),
        (f"<body><p>See <a href=/x>this other page of ours</a>, too.</p>{''.join(LONG)}", ["See this other page of ours, too.", *PLAIN]),
    ],
)
def test_paths_choose(page: str, text: list[str]) -> None:
    assert html_tpr.main_text(page) == "\n".join(text)


@pytest.mark.parametrize("instead", [0, 1])
def test_the_choice_decides(spark, monkeypatch, instead: int) -> None:
    """With no path chosen, or with all of them, most pages give another text."""
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html").collect()]
    before = [html_tpr.main_text(x) for x in pages]
    monkeypatch.setattr(html_tpr, "chosen_nodes", lambda lengths, *_: np.full(len(lengths), bool(instead)))
    assert sum(html_tpr.main_text(x) != t for x, t in zip(pages, before, strict=True)) > 0.8 * len(pages)


def test_articles_of_the_table(spark) -> None:
    """By brute force on all pages of sf0.01: the words of the article element, no more and no less."""
    import re

    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        body = re.search(r"(?s)<article>(.*?)</article>", r["html"])
        want = html.unescape(re.sub(r"(?s)<[^>]*>", " ", re.sub(r"(?s)<(script|style|aside|nav|form)\b.*?</\1>|<div class=\"(?:ad|comments|share|related|cookie)\">.*?</div>", " ", body[1]))).split() if body else []
        assert sorted(html_tpr.main_text(r["html"]).split()) == sorted(want), r["page_id"]


@pytest.mark.parametrize("markup", ["<b>x ", "<div>x ", "<p><ul><div>x ", "<table><tr><td>x", "<a 'x>", "<li>x", "<article>x", "</b>x", "<dl><dt>x"])
def test_deep_markup_takes_linear_time(markup: str) -> None:
    def seconds(n: int) -> float:
        start = time.process_time()
        html_tpr.main_text(markup * n)
        return time.process_time() - start

    seconds(1000)
    assert seconds(40_000) < 25 * max(seconds(4000), 0.02)
