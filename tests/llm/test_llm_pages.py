"""Main text of pages written by hand, as themes lay them out; and the field's gradient."""

import numpy as np
import pytest

from lumenfold.llm import html_blocks as hb
from lumenfold.llm import html_crf as hc

TITLE = "How the harbour bridge was built"
P1 = "The first piers were set in the spring of 1911, when the river was low and the ferries still ran."
P2 = "It took four years, two floods and the work of nine hundred people until the last arch was closed."
P3 = "Today the bridge carries more than forty thousand cars a day, and it is due for new paint."
STORY = f"<h1>{TITLE}</h1><p>{P1}</p><p>{P2}</p><p>{P3}</p>"
WHOLE = "\n".join((TITLE, P1, P2, P3))
MENU = "<nav><ul><li><a href='/'>Home</a></li><li><a href='/news'>News</a></li><li><a href='/about'>About us</a></li></ul></nav>"
FOOT = "<footer><p>&copy; 2024 Harbour News. All rights reserved.</p></footer>"
SIDE = "<aside><h3>More stories</h3><ul><li><a href='/a'>A new ferry for the islands</a></li><li><a href='/b'>Fish market moves</a></li></ul></aside>"
TALK = "<div class='comments'><h3>2 comments</h3><div class='comment'><p>anna</p><p>I crossed it every day for years.</p></div><div class='comment'><p>ben</p><p>Great read, thank you!</p></div></div>"


def page(story, body="", before=MENU, after=FOOT, head="<title>Harbour News</title>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body{body}>{before}{story}{after}</body></html>"


ARTICLE = f"<article>{STORY}</article>"
PAGES = {
    "plain": page(ARTICLE),
    "body has-sidebar": page(ARTICLE, ' class="has-sidebar"'),
    "body no-sidebar home": page(ARTICLE, ' class="no-sidebar home"'),
    "body with-ads": page(ARTICLE, ' class="with-ads"'),
    "body search-open": page(ARTICLE, ' class="search-open"'),
    "body sticky-header": page(ARTICLE, ' class="sticky-header"'),
    "body with main": page(f"<main>{ARTICLE}</main>", ' class="sticky-header has-sidebar"'),
    "article share-enabled": page(f'<article class="post share-enabled">{STORY}</article>'),
    "article of a theme": page(f'<article class="post-12 post type-post status-publish hentry category-promo tag-ads comments-open">{STORY}</article>'),
    "page-header-wrapper": page(f'<div class="page-header-wrapper">{ARTICLE}</div>'),
    "wrapper with-sidebar": page(f'<div id="wrap" class="with-sidebar">{ARTICLE}</div>{SIDE}'),
    "header-fixed": page(f'<div class="header-fixed">{ARTICLE}</div>'),
    "no article element": page(f'<div id="content">{STORY}</div>{SIDE}'),
    "only divs": page(f"<div><div>{STORY}</div></div>"),
    "comments inside": page(f"<article>{STORY}{TALK}</article>"),
    "side and comments": page(f"{ARTICLE}{SIDE}{TALK}"),
    "unclosed paragraphs": page(f"<article><h1>{TITLE}</h1><p>{P1}<p>{P2}<p>{P3}</article>"),
    "unclosed button": page(f"<article><h1>{TITLE}</h1><button>Listen<p>{P1}</p><p>{P2}</p><p>{P3}</p></article>"),
    "unclosed button before another": page(f"<article><h1>{TITLE}</h1><select><p>{P1}</p><p>{P2}</p><button>Share</button><p>{P3}</p></article>"),
    "deep": page("<div>" * 30 + ARTICLE + "</div>" * 30),
    "deep inline": page(f"<article><h1>{TITLE}</h1><p>{'<span>' * 30}{P1}{'</span>' * 30}</p><p>{P2}</p><p>{P3}</p></article>"),
    "self-closing div": page(f"<article><div/><h1>{TITLE}</h1><p>{P1}</p><p>{P2}</p><p>{P3}</p></article>"),
    "unquoted link": page(f"<article><h1>{TITLE}</h1><p><a href=/x/>The first piers</a>{P1[15:]}</p><p>{P2}</p><p>{P3}</p></article>"),
    "linked paragraph": page(f"<article><h1>{TITLE}</h1><p>{P1}</p><p>It <a href='/y'>{P2[3:]}</a></p><p>{P3}</p></article>"),
    "wholly linked paragraph": page(f"<article><h1>{TITLE}</h1><p>{P1}</p><p><a href='/y'>{P2}</a></p><p>{P3}</p></article>"),
    "advert inside": page(f"<article><h1>{TITLE}</h1><p>{P1}</p><div class='ad'>Buy two, get one free.</div><p>{P2}</p><p>{P3}</p></article>"),
    "cookie banner": page(ARTICLE, before="<div id='cookie-banner'><p>We use cookies to make this site work better.</p><a href='#'>Accept</a></div>" + MENU),
    "inline markup": page(f"<article><h1>{TITLE}</h1><p>{P1.replace('spring', '<em>spring</em>')}</p><p>{P2}</p><p>{P3}<br></p></article>"),
    "site-header": page(ARTICLE, before=f"<div class='site-header'><p>Harbour News, since 1890</p></div>{MENU}"),
}


@pytest.fixture(scope="module")
def field():
    return tuple(a.tolist() for a in hc.model())


@pytest.mark.parametrize("name", sorted(PAGES))
def test_pages_come_out_whole(field, name):
    assert hc.main_text(PAGES[name], *field) == WHOLE


@pytest.mark.parametrize(
    "word, kind",
    [
        ("header", "header"), ("site-header", "header"), ("header-fixed", None), ("has-sidebar", None),
        ("left_sidebar", "side"), ("category-promo", None), ("comment-body", "comments"), ("comments-open", None),
        ("post-content", "article"), ("page-header", None), ("ad", "advert"), ("top-ad", "advert"), ("add", None), ("", None),
    ],
)
def test_words_tell_kinds(word, kind):
    assert hb.word_kind(word) == kind


def test_many_unclosed_elements_take_linear_time():
    import time

    begin = time.perf_counter()
    assert len(hb.blocks("<button>x<p>y" * 20_000)) == 20_000
    assert len(hb.blocks("<div><span>" * 20_000 + "z")) == 1
    assert time.perf_counter() - begin < 10


def likelihood(theta, pages):
    """Log likelihood of labelled pages by every labelling, less the penalty."""
    import itertools

    size = len(hc.FEATURES)
    w, moves = theta[:size], theta[size:].reshape(2, 2)
    total = 0.0
    for one in pages:
        emit = [sum(w[i] for i in f) for f in hc.features([b for b, _ in one])]
        score = lambda y: sum(e * k for e, k in zip(emit, y)) + sum(moves[a, b] for a, b in zip(y, y[1:]))  # noqa: B023, E731
        every = [score(y) for y in itertools.product((0, 1), repeat=len(one))]
        total += score([k for _, k in one]) - np.logaddexp.reduce(every)
    return total / len(pages) - hc.PENALTY / 2 * (theta**2).sum()


def test_gradient_by_finite_differences():
    pages = [p[:8] for p in hc.labelled_pages(6, seed=11)]
    size = len(hc.FEATURES)
    theta = np.random.default_rng(3).standard_normal(size + 4) * 0.3
    grad = hc.gradient(theta, *hc.padded(pages))
    for i in [*range(0, size, 5), *range(size, size + 4)]:
        step = np.zeros_like(theta)
        step[i] = 1e-5
        slope = (likelihood(theta + step, pages) - likelihood(theta - step, pages)) / 2e-5
        assert grad[i] == pytest.approx(slope, abs=1e-4)
