"""Regions of pages without and with articles, and what the threshold does."""

import pytest

from learntrace.llm import html_extract

LONG = "A long paragraph of the page goes on and on. " * 25


@pytest.mark.parametrize(
    "page,want",
    [
        (f"<h1>Title</h1><div class=ad>Buy</div><p>{LONG}</p>", ["Title", LONG.strip()]),
        (f"<html><body><p>{LONG}</p><div class=ad>Buy</div><p>Short.</p><div class=ad>Buy</div><p>{LONG}</p><div class=ad>x</div><p>End.</p></body></html>", [LONG.strip(), "Short.", LONG.strip(), "End."]),
        (f"<body><div><h1>Title</h1></div><div class=ad>Buy</div><div><p>{LONG}</p></div></body>", ["Title", LONG.strip()]),
        (f"<article><p>{LONG}</p></article><article><p>Short one.</p></article>", [LONG.strip(), "Short one."]),
    ],
)
def test_short_regions_stay(page, want):
    assert html_extract.main_text(page).split("\n") == want


@pytest.mark.parametrize(
    "page,want",
    [
        ("<p>First paragraph of some length here, really.</p><p>Second paragraph of some length here too.</p><div><a>link</a> <a>link2</a> <a>l3</a></div>", ["First paragraph of some length here, really.", "Second paragraph of some length here too."]),
        ("<article><p>Short teaser.</p></article><div>" + "".join(f"<p>Sentence {i} of the long text goes on.</p>" for i in range(30)) + "</div>", ["Short teaser.", *(f"Sentence {i} of the long text goes on." for i in range(30))]),
        ('<div class="legal"><p>A law text that goes on.</p></div>', ["A law text that goes on."]),
        (f"<main><p>{LONG}</p></main><main><p>Short.</p></main>", [LONG.strip(), "Short."]),
        (f'<article><p>{LONG}</p><div class="search">How to search a list.</div><p>End.</p></article><div class=ad>{LONG}</div><div id="comments"><p>{LONG}</p></div>', [LONG.strip(), "How to search a list.", "End."]),
        (f'<form id="page"><nav>menu</nav><div><p>{LONG}</p><p>End.</p></div></form>', [LONG.strip(), "End."]),
        ("<form><p>Name</p><input><p>Send your address to us</p></form>", [""]),
        (f'<div class="content with-sidebar"><p>{LONG}</p></div><div class="sidebar">s</div>', [LONG.strip()]),
        (f"<article><p>{LONG}</p></article><div><ul><li><a>One</a></li><li><a>Two</a></li><li><a>Three</a></li><li><a>Four</a></li></ul></div>", [LONG.strip()]),
    ],
)
def test_regions(page, want):
    assert html_extract.main_text(page).split("\n") == want


def test_ratio_and_threshold_choose():
    page = html_extract.lines_of(f"<article><p>{LONG}</p></article><div><p>{LONG}</p></div><div><ul><li><a>One</a></li><li><a>Two</a></li><li><a>Three</a></li><li><a>Four</a></li></ul></div>")
    texts = lambda *a: [x.text for x in html_extract.chosen(page, *a)]
    assert texts() == [LONG.strip()] * 2
    assert texts(1e18) == [] and texts(-1.0) == [LONG.strip()] * 2 + ["One", "Two", "Three", "Four"]
    beside = html_extract.lines_of(f"<article><p>{LONG}</p></article><p>By us</p><nav><a>m</a></nav><nav><a>m</a></nav><nav><a>m</a></nav>")
    assert len(html_extract.chosen(beside, 2.5)) == 2 and len(html_extract.chosen(beside, 2.5, 1e-6)) == 1  # the smoothing lifts a short line beside a long one


def test_ties_of_regions_are_all_chosen():
    assert html_extract.main_text("<div><div><p>Same words.</p></div></div><nav>menu</nav><div><div><p>Same words.</p></div></div>") == "Same words.\nSame words."


def test_unclosed_tags_cost_the_same_each():
    assert html_extract.main_text("<div><b>" * 20_000 + "x" + "</i></div>" * 20_000) == "x"
    assert html_extract.main_text("<nav><article>" * 20_000 + "x") == "x"


@pytest.mark.parametrize(
    "page,want",
    [
        (f'<article><h1>T</h1><p>{LONG}</p><h2 id="related-work">Related work</h2><p>{LONG}</p><h2 id="social-impact">Social impact</h2><p class="market-share">Market share rose.</p><p>{LONG}</p></article>', ["T", LONG.strip(), "Related work", LONG.strip(), "Social impact", "Market share rose.", LONG.strip()]),
        (f'<article><p>{LONG}</p><div class="social-impact"><p>A short paragraph.</p><p>{LONG}</p></div><p>{LONG}</p></article>', [LONG.strip(), "A short paragraph.", LONG.strip(), LONG.strip()]),
        (f'<article><p>{LONG}</p><div class="share-buttons"><a>Share</a> <a>Tweet</a></div><div class="ad-slot-3">Buy this now</div><div class="widget-newsletter">Sign up</div><p>{LONG}</p></article>', [LONG.strip(), LONG.strip()]),
        (f'<article><p>{LONG}</p><div class="also-related"><ul><li><a>Other page</a></li><li><a>One more</a></li></ul></div></article>', [LONG.strip()]),
        (f'<body><div class="entry-header"><h1>Title</h1></div><p>{LONG}</p><p><a href="x">See the source</a></p><p>End.</p></body>', ["Title", LONG.strip(), "See the source", "End."]),
    ],
)
def test_names_weigh_in_articles(page, want):
    assert html_extract.main_text(page).split("\n") == want


def article_of(page):
    return html_extract.main_text(page[page.index("<article") : page.index("</article>") + 10])


def test_given_pages_unwrapped_and_renamed(spark):
    """Articles as plain blocks, with names of furniture on content; and what smoothing and the threshold do there."""
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    exact = unwrapped = renamed = smoothing = limits = 0
    for i, page in enumerate(pages):
        want = article_of(page)
        plain = page.replace("<article", "<div").replace("</article>", "</div>")
        exact += html_extract.main_text(page) == want
        unwrapped += html_extract.main_text(plain) == want
        renamed += html_extract.main_text(page.replace("<p>", '<p class="market-share">').replace("<h1>", '<h1 id="related-work">')) == want
        listed = plain.replace("</body>", "<div><ul>" + f"<li><a>Page {i}</a></li>" * 8 + "</ul></div><div><div><p>Short end of the page.</p></div></div></body>")
        full, smooth, low = (html_extract.chosen(html_extract.lines_of(listed), *a) for a in ((), (None, 1e-6), (-1.0,)))
        smoothing += [x.text for x in smooth] != [x.text for x in full]
        limits += [x.text for x in low] != [x.text for x in full]
    assert exact == len(pages) == renamed and unwrapped >= 0.98 * len(pages)
    assert limits > 0.9 * len(pages)
    assert smoothing > 0
