import os
import re
import time
from collections import Counter

import pyarrow.parquet as pq
import pytest

from lisible.llm import html_text
from lisible.llm.html_text import extract, main_text

P1 = "Le premier paragraphe de l'article est assez long, et il contient de la ponctuation; beaucoup."
P2 = "A second paragraph follows it, with more sentences. It says some more, and then it ends."
PAGES = {
    "article": (
        f"""<html><head><title>T</title><style>p{{}}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav>
        <div class="cookie-notice"><p>We use cookies, please accept.</p></div><article><h1>A &amp; B</h1><p>{P1}<p>Short.<p>{P2}
        <aside><p>Side note in the article, long enough, really.</p></aside><div class="ad">Buy now, cheap, good.</div>
        <form><label>Mail</label><input></form><script>var x="</p>";</script></article>
        <section id="comments"><h2>Comments</h2><article class="comment"><p>{P1} {P2} {P1} First, I say!</p></article></section><footer>&copy; x</footer></body></html>""",
        f"A & B\n{P1}\nShort.\n{P2}",
    ),
    "no article element": (
        f"""<body><div id="wrapper" class="has-sidebar"><div class="menu"><a href=a>One</a> <a href=b>Two</a></div><div class="post-body"><h2>Title</h2><p>{P1}</p>
        <p>{P2}</p><ul><li>first item<li>second item</ul><blockquote>{P1}</blockquote></div><div class="sidebar"><p>{P1} {P1}</p></div></div></body>""",
        f"Title\n{P1}\n{P2}\nfirst item\nsecond item\n{P1}",
    ),
    "main in a wrapping form": (f"<form id=aspnet><main><p>{P1}</p><p>x <b>y</b><i>z</i></p></main></form>", f"{P1}\nx yz"),
    "broken": (f"<article><p><b>{P1}<br><p>tail &am", f"{P1}\ntail &am"),
    "attributes": (f"""<article><p title="a > b" data-x='</p>'>{P1}</p><p hidden>no</p><p style="display: none">no</p></article>""", P1),
    "spaces": (f"<article><p>\n a&nbsp; b\t\n c </p><pre>x\n  y</pre><p>{P1}</p></article>", f"a b c\nx y\n{P1}"),
    "comment": (f"<article><!-- <p>no</p> --><p>{P1}</p><!-- open", P1),
    "empty": ("", ""),
    "no text": ("<html><body><nav>x</nav></body></html>", ""),
    "bare text": ("just words, no tags.", "just words, no tags."),
}


@pytest.mark.parametrize("name", PAGES)
def test_pages(name):
    html, want = PAGES[name]
    assert extract(html) == want


def test_deep_and_long_pages():
    assert extract("<div>" * 3000 + P1 + "</div>" * 3000) == P1
    paragraphs = [f"{P1} {i}" for i in range(20_000)]
    assert extract("<article>" + "".join(f"<p>{p}</p>" for p in paragraphs) + "</article>") == "\n".join(paragraphs)


def test_rows(spark):
    rows = [(1, "u", PAGES["article"][0], "x"), (1, "u", PAGES["article"][0], "x"), (None, None, None, None), (3, "v", "", "y")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    want = PAGES["article"][1]
    assert [tuple(r) for r in main_text(df).collect()] == [(1, "u", want, len(want))] * 2 + [(None, None, "", 0), (3, "v", "", 0)]
    assert main_text(df.limit(0)).count() == 0


def flattened(html: str) -> str:
    """The page without anything that says what its parts are."""
    html = re.sub(r"<(/?)(?:article|nav|footer|aside|header|main|section)\b[^>]*>", r"<\1div>", html)
    return re.sub(r' (?:class|id|role)="[^"]*"', "", html)


FOLDER = "/root/testdata/sf0.001/pages.parquet"


@pytest.mark.skipif(not os.path.exists(FOLDER), reason="driver tables are absent")
def test_ratios_find_the_article_without_markup(monkeypatch):
    """Labels: the blocks inside <article>. Ratios alone find them where every part is a plain div; equal scores do not."""
    pages = [r["html"] for r in pq.read_table(FOLDER, columns=["html"]).to_pylist()]
    labels = [extract(re.search(r"<article>.*</article>", h, re.S)[0]) for h in pages]
    assert sum(extract(h) == want for h, want in zip(pages, labels, strict=True)) == len(pages)

    def measure():
        hit = got = all_ = 0
        for h, want in zip(pages, labels, strict=True):
            a, b = Counter(extract(flattened(h)).split("\n")), Counter(want.split("\n"))
            size = lambda c: sum(len(k) * n for k, n in c.items())
            hit, got, all_ = hit + size(a & b), got + size(a), all_ + size(b)
        return hit / got, hit / all_

    precision, recall = measure()
    assert precision > 0.98 and recall > 0.98
    monkeypatch.setattr(html_text, "_scores", lambda blocks, parents: {node.path: 1.0 for node, _, _ in blocks})
    assert measure()[0] < precision - 0.03


@pytest.mark.parametrize("tag", ["div", "font", "ul><li"])
def test_deep_pages_take_linear_time(tag):
    began = time.perf_counter()
    extract(f"<{tag}>" * 50_000 + P1 + "</p></x>" * 1000)
    extract(f"<{tag}>some text, here." * 20_000)
    assert time.perf_counter() - began < 20


def plain_scores(html):
    """Path scores by walking up from every block, path strings and all."""
    page = html_text.parse(html)
    blocks = html_text._settle(page)
    names = {0: ()} | {}
    for (up, label), own in page.paths.items():
        names[own] = (*names[up], label)
    out = {}
    for family in {(names[b[0].path][:-1], b[0].part is None) for b in blocks}:
        own = list(dict.fromkeys(names[b[0].path] for b in blocks if (names[b[0].path][:-1], b[0].part is None) == family))
        rows = {p: [(t, k) for node, t, k in blocks if names[node.path] == p] for p in own}
        length = [sum(max(0, len(t) - k) for t, k in rows[p]) / len(rows[p]) for p in own]
        marks = [sum(c in ".,;:!?…。、，！？；：«»\"“”()" for t, _ in rows[p] for c in t) / len(rows[p]) for p in own]
        for i, p in enumerate(own):
            w = [0.5 if j == i else 0.25 if abs(i - j) == 1 else 0 for j in range(len(own))]
            mean = lambda x: sum(a * b for a, b in zip(w, x, strict=True)) / sum(w)
            out[p] = mean(length) * (1 + mean(marks)) if length[i] else 0.0
    return {names[p]: s for p, s in html_text._scores(blocks, {own: up for (up, _), own in page.paths.items()}).items()}, out


@pytest.mark.parametrize("name", [n for n in PAGES if n not in ("empty", "no text")])
def test_scores_equal_brute_force(name):
    got, want = plain_scores(PAGES[name][0])
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in got)
