"""Pages marked by hand: what stands in GOES must go with its headings, all other text must stay, in order. No list or rule is taken from the code."""

import re
import time

import pytest

from mnemospark.llm import html_extract as h

PROSE = "<p>The first paragraph of the text, with commas, and with enough characters in it to count as prose here.</p>"
LONG = "Fees rose, the council said, because costs had doubled since spring, and nobody had planned for that, least of all the mayor."

GOES = {
    "comments": [f'<div class="{c}"><p>GONE I disagree, frankly, with all of this, as would anyone who reads it twice.</p></div>' for c in (
        "user-comments", "reader-comments", "comment-thread", "commentlist", "disqus_thread", "commentsSection", "comments__x3f9", "comment-body even thread-odd", "post-comments")]
    + ['<section id="comments"><h2>12 Comments</h2><article class="comment"><p>GONE one, two</p></article></section>', '<h3>Comments (3)</h3><ol class="comment-list"><li>GONE x</li></ol>',
       '<div itemprop="comment"><p>GONE so, so wrong</p></div>', '<section aria-label="Comments"><p>GONE no, thanks</p></section>', '<article class="comment"><p>GONE well, well</p></article>'],
    "adverts": [f'<div class="{c}">GONE Buy shoes, socks and laces</div>' for c in ("ad-unit-300x250", "advert-label-wide", "adsbygoogle", "ad_slot_2", "sponsored-content", "adContainer", "advertisement-zq81")]
    + ['<p class="advertisement">GONE Buy</p>', '<p class="sponsored-label">GONE by X</p>', '<section class="zone-x promoTiles"><h3>Advertisement</h3><p>GONE Buy it</p></section>'],
    "notices": [f'<div class="{c}">GONE We use cookies, as all do</div>' for c in ("cookie-policy-banner", "cookieConsent", "gdpr-info", "notice", "site-notices")] + ['<p class="cookie-notice">GONE We use cookies.</p>'],
    "beside": [f'<div class="{c}"><a href=a>GONE Share</a> <a href=b>GONE Send</a></div>' for c in ("social-icons", "share-this", "social-zq9", "related-zq9-teasers", "newsletter-zq9")]
    + ['<div class="sidebar-left-rail"><p>GONE Weather, stars, and more of it, for all who look here.</p></div>', '<div class="subscribe-zq9"><p>GONE Your address</p><input name=e></div>',
       '<div class="related-zq9"><h3>Related articles</h3><p>GONE A long teaser, with commas, that goes on for more than eighty characters, as some of them do.</p></div>'],
}
STAYS = [
    '<h2 id="related-work">Related work</h2>', '<h2 id="comments-on-method">Comments on method</h2>', '<h2 class="header">A heading</h2>', '<p class="alert-levels">Levels, of alert.</p>',
    '<section id="related-work"><p>Text of work</p></section>', '<section id="social-history"><h2>Social history</h2><p>Guilds, fairs, courts.</p></section>',
    '<section id="ad-hoc-networks"><h2>Ad hoc networks</h2><p>Nodes, links.</p></section>', '<div class="cookie-recipe"><p>Flour, sugar, salt.</p></div>',
    '<div class="has-sidebar"><p>Text.</p></div>', '<div class="comments-open"><p>Text.</p></div>', '<h2>Comments</h2><p>What the minister said, in full.</p>', f'<div class="search-results-of-1910"><p>{LONG}</p></div>',
    '<div class="article-header"><h2>Part two</h2></div>', '<div class="shared-values"><p>Values, all of them.</p></div>', '<div class="address-line"><p>Main street, 4</p></div>', '<div class="pagebody"><p>Page, body.</p></div>', '<p class="notices-of-death">Mr X, 80.</p>',
]


def text_of(page):
    return [t for t in (" ".join(re.sub("<[^>]*>", " ", x).split()) for x in re.split(r"(?=<(?:h2|p)\b)", page)) if t]


@pytest.mark.parametrize("around", ["article", "main"])
@pytest.mark.parametrize("piece", [x for xs in GOES.values() for x in xs])
def test_goes(around, piece):
    page = f"<html><body><{around}><h1>T</h1>{PROSE}{piece}{PROSE}</{around}></body></html>"
    assert h.extract(page).split("\n") == text_of(f"<h2>T</h2>{PROSE}{PROSE}")


@pytest.mark.parametrize("around", ["article", "main"])
@pytest.mark.parametrize("piece", STAYS)
def test_stays(around, piece):
    page = f"<html><body><{around}><h1>T</h1>{PROSE}{piece}{PROSE}</{around}></body></html>"
    assert h.extract(page).split("\n") == text_of(f"<h2>T</h2>{PROSE}{piece}{PROSE}")


def test_pages_without_article():
    """Plain pages: wrappers named after what stands beside the text don't take the text with them."""
    page = f'<body class="no-js"><div class="page-with-comments"><div class="nav-primary-x"><a href=a>GONE</a></div><div class="promo-layout-zq"><h1>T</h1>{PROSE}</div><div class="comments-zq"><p>GONE a, b, c</p></div></div></body>'
    assert h.extract(page).split("\n") == text_of(f"<h2>T</h2>{PROSE}")
    page = f'<body><main><article class="post tag-comments category-newsletter"><h1>T</h1>{PROSE}</article></main></body>'
    assert h.extract(page).split("\n") == text_of(f"<h2>T</h2>{PROSE}")


def test_hostile_names():
    """Very many and very long names cost time in proportion."""
    t = time.time()
    page = "".join(f'<div class="comment{i} related-{i}-zz"><p>x, {i}</p>' for i in range(20000)) + f'<p class="{"ad-" * 50000}x">y</p>' + f'<div class="{"a" * 20000}">z</div>'
    h.extract(page)
    assert time.time() - t < 20
