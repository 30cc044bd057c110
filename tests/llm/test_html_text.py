"""Hand-made pages with every kind of boilerplate, and the article of real pages by a plain cut."""

import html
import re

import pytest

from snapweave.llm import html_text as H

P1 = "The first paragraph of the article is long enough to be text, with some <b>bold</b> words and a <a href='#'>link</a>."
P2 = "A second one follows, also a sentence or two in length; it says nothing new but says it at some length."
WANT = "Headline The first paragraph of the article is long enough to be text, with some bold words and a link. " \
       "Short. " + P2
ARTICLE = f"<h1>Headline</h1><p>{P1}</p><p>Short.</p><p>{P2}</p>"
AROUND = """<!doctype html><html><head><title>T</title><style>p {{}}</style></head><body>
<header><a href=/>Site</a> the best site there is, a tagline long enough to look like text at first sight</header>
<nav><ul><li><a href=a>A</a></li><li><a href=b>B</a></li></ul></nav>{before}
{main}
{after}<aside><p>Sidebar text that goes on for long, and on, and on, and on, and on, until it is quite long.</p></aside>
<form><label>Name</label><input><textarea>typed text</textarea></form>
<script>var s = "<p>not text</p>";</script><footer>&copy; Somebody, all rights reserved and so on and so forth</footer></body></html>"""
JUNK = [
    '<div class="ad">Buy this now, it is the best offer of the year and of every year to come, surely.</div>',
    '<div id="cookie-notice">We use cookies and so does everybody else; please agree or do not, as you like.</div>',
    '<section class="comments"><article class="comment"><p>I disagree with every word of this and say so here.</p></article></section>',
    '<div role="navigation"><a href=x>one</a> <a href=y>two</a></div>',
    '<div class="siteBanner">A banner that is long enough to be taken for a paragraph if one does not look.</div>',
    '<div style="display: none">Hidden words that nobody sees but the parser, who must not be fooled by them.</div>',
]


@pytest.mark.parametrize("main", [f"<article>{ARTICLE}</article>", f"<main>{ARTICLE}</main>",
                                  f"<main><article>{ARTICLE}</article></main>", f'<div class="post">{ARTICLE}</div>'])
@pytest.mark.parametrize("junk", range(len(JUNK) + 1))
def test_article_only(main, junk):
    extra = JUNK[junk] if junk < len(JUNK) else "".join(JUNK)
    assert H.main_text(AROUND.format(main=main, before=extra, after="")) == WANT
    assert H.main_text(AROUND.format(main=main, before="", after=extra)) == WANT


def test_form_around_the_whole_page():
    page = f"<body><form><article>{ARTICLE}</article></form></body>"
    assert H.main_text(page) == WANT


def test_junk_inside_the_article():
    inside = ARTICLE.replace("<p>Short.</p>", f"{JUNK[0]}<p>Short.</p><aside>Read also this other page of ours</aside>")
    assert H.main_text(AROUND.format(main=f"<article>{inside}</article>", before="", after="")) == WANT


def test_broken_markup():
    page = "<article><h1>Head</h1><p><b>one <i>two<br>three<p>four &amp five &eacute; &#x1F600;</div><p>six"
    assert H.main_text(page) == "Head one two three four & five é \U0001f600 six"


@pytest.mark.parametrize("page,want", [("", ""), ("plain  text", "plain text"), ("<p></p>", ""), ("<script>x", ""),
                                       ("<nav>a</nav>", ""), ("<", "<"), ("<article>" + "<div>" * 3000 + "deep", "deep")])
def test_small_pages(page, want):
    assert H.main_text(page) == want


def test_query_over_real_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    sources = {r.page_id: r.html or "" for r in pages.collect()}
    for r in H.extract(pages).collect():
        m = re.search(r"<article>(.*?)(</article>|$)", sources[r["id"]], re.S)
        parts = re.split(r"</?(?:p|h1)>", re.sub("</?b>", "", m[1].replace("<br>", " ")))
        want = " ".join(t for t in (" ".join(html.unescape(p).split()) for p in parts) if t)
        assert r["text"] == want and r["n_chars"] == len(want)


@pytest.mark.parametrize("page", [
    "<article>{0}<section id='discussion'><h2>Discussion</h2><p>{1}</p></section></article>",
    "<article>{0}<div class='section' id='discussion'><h2>Discussion</h2><p>{1}</p></div></article>",
    "<article>{0}<div id='social-impact'><h2>Discussion</h2><p>{1}</p></div></article>",
    "<article>{0}<section id='login'><h2>Discussion</h2><p>{1}</p></section></article>",
    "<article>{0}<h2 id='related-work'>Discussion</h2><p class='notice-period'>{1}</p></article>",
    "<article>{0}<h3 id='search'>Discussion</h3><p>{1}</p></article>",
    "<article>{0}<div class='notice'><h2>Discussion</h2><p>{1}</p></div></article>",
    "<body class='comments-open'><main id='discussion'>{0}<h2>Discussion</h2><p>{1}</p></main></body>",
])
def test_topics_are_no_boilerplate(page):
    assert H.main_text(page.format(ARTICLE, P2)) == f"{WANT} Discussion {P2}"


@pytest.mark.parametrize("junk", ["<section id='comments'>{}</section>", "<div class='related-posts'>{}</div>",
                                  "<div id='comment-12' class='comment'>{}</div>", "<ul class='share-buttons'><li>{}</ul>",
                                  "<section class='widget_2'>{}</section>"])
def test_whole_cue_names_are(junk):
    assert H.main_text(f"<article>{ARTICLE}{junk.format('<p>' + P1 + '</p>')}</article>") == WANT


def test_formulas_stay():
    page = f"<article>{ARTICLE}<p>So <math><semantics><mrow><mi>E</mi><mo>=</mo><mi>m</mi></mrow><annotation>E=m" \
           "</annotation></semantics></math>, as is known.</p></article>"
    assert H.main_text(page) == WANT + " So E=m, as is known."


CARD = f"<article><p>{'About the author, at length. ' * 9}</p><p>{'More about the author here. ' * 10}</p></article>"
LONG_TEXT = f"<h1>Headline</h1>{f'<p>{P1}</p><p>Short.</p><p>{P2}</p>' * 2}"
LONG_WANT = WANT + WANT[len("Headline"):]


@pytest.mark.parametrize("page,want", [
    (f"<main><h1>Headline</h1><article>{ARTICLE[17:]}</article></main>", WANT),
    (f"<div><h1>Headline</h1><div>x</div></div><article>{ARTICLE[17:]}</article>", WANT),
    (f"<main><article>{ARTICLE}</article><p>{P2}</p></main>", f"{WANT} {P2}"),
    (f"<body><article>{ARTICLE}</article><p>{P1}</p><p>{P2}</p></body>", f"{WANT}{WANT[8:].replace(' Short.', '')}"),
    (f"<div><article>{ARTICLE}</article><article><h2>Next</h2></article></div>", f"{WANT} Next"),
    (f"<div class='post'>{LONG_TEXT}</div><div class='related'>{CARD}</div>", LONG_WANT),
])
def test_region_by_mass(page, want):
    assert H.main_text(page) == want


def test_card_in_the_text():
    assert H.main_text(f"<div class='post'>{LONG_TEXT}{CARD}</div>").startswith(LONG_WANT + " About the author")


POST = f"{ARTICLE}<p>{P1}</p><p>{P2}</p>"
POST_WANT = f"{WANT} {WANT[9:].replace(' Short.', '')}"
COMMENT = "<p>A reader says at length what readers say, and goes on to say it again at even greater length.</p>" * 2


@pytest.mark.parametrize("page", [
    "<div class='widget Blog'><div class='blog-posts'><div class='post'>{}</div></div></div>",
    "<div id='page' class='sidebar-right'>{}</div>",
    "<div class='container right-sidebar'><div>{}</div></div>",
    "<div class='modal-content'>{}</div>",
    "<div class='notice-content'>{}</div>",
    "<div role='main' class='widget'>{}</div>",
    "<div class='widget Blog'><div class='hentry'>{}</div></div>",
    "<div class='post-body entry-content'>{}</div>",
])
@pytest.mark.parametrize("junk", ["", "<ol class='commentlist'><li>{}</li></ol>", "<div id='jp-relatedposts'>{}</div>",
                                  "<div id='comments'>{}</div>", "<div class='sidebar'>{}</div>"])
def test_a_cue_around_the_article(page, junk):
    body = page.format(POST) + junk.format(COMMENT)
    assert H.main_text(f"<html><body><nav><a href=x>Home</a></nav>{body}<footer>All rights</footer></body></html>") == POST_WANT


@pytest.mark.parametrize("junk", ["<div class='sidebar'>{}</div>", "<div id='comments'>{}</div>", "<div role='complementary'>{}</div>"])
def test_long_boilerplate_beside_a_short_article(junk):
    assert H.main_text(f"<body><article>{ARTICLE}</article>{junk.format(COMMENT * 20)}</body>") == WANT


@pytest.mark.parametrize("open_tags", ["<font>x ", "<div>x ", "<div><p>x", "<form>x ", "<div class='notice'>x ", "<article><form>x ",
                                       "<font></b>x ", "<p><font>x "])
def test_unclosed_tags_take_linear_time(open_tags):
    import time
    import tracemalloc
    page = open_tags * 16_000
    start = time.perf_counter()
    H.main_text(page)
    assert time.perf_counter() - start < 5
    tracemalloc.start()
    H.main_text(open_tags * 4_000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50 << 20


def test_threshold_against_a_plain_version():
    import random

    import numpy as np
    rng = random.Random(4)
    for _ in range(50):
        lines = []
        for _ in range(rng.randint(1, 40)):
            x = H.Line("x" * rng.randint(1, 300), rng.randint(0, 20), 0)
            x.skip, x.doubts = rng.random() < 0.2, int(rng.random() < 0.2)
            lines.append(x)
        ratio = np.array([0 if x.skip or x.doubts else len(x.text) / max(1, x.tags) for x in lines])
        kernel = np.exp(-np.arange(-2, 3) ** 2 / 2)
        smooth = np.convolve(np.pad(ratio, 2), kernel / kernel.sum(), mode="valid")
        on = [i for i, x in enumerate(lines) if not (x.skip or x.doubts)]
        want = [i for i in on if smooth[i] >= smooth.std() - 1e-12]
        assert H.content_lines(lines, False) == (want or on)
