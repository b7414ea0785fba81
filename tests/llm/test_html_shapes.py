"""Main text of page shapes that the classifier has not learnt from: words found and words left out, by shape and together."""

from __future__ import annotations

import re

import pytest

from orograph.llm import html_text

#: Pages as publishing systems write them. M12 stands for twelve words of the article, X12 for twelve others.
SHAPES = {
    "wiki": '<div id="mw-navigation"><h2>Navigation menu</h2><ul><li><a href=/a>X2</a></li><li><a href=/b>X3</a></li></ul></div><div id="content" role="main"><h1>M2</h1>'
    '<div id="bodyContent"><p>M60 <a href=/x>M2</a> M9</p><div id="toc" class="toc"><ul><li><a href="#a">X2</a></li><li><a href="#b">X3</a></li></ul></div><h2>M2</h2><p>M80</p>'
    "<ul><li>M9</li><li>M14</li></ul><p>M33</p></div></div><div id=footer><ul><li>X14</li><li>X9</li></ul></div>",
    "news": '<div class="site-nav-wrapper"><a href=/1>X1</a> <a href=/2>X2</a></div><article class="c-article"><h1 class="c-article__headline">M9</h1><div class="c-article__body"><p>M44</p>'
    '<div class="ad-slot ad-300x250">X8</div><p>M39</p><p>M52</p></div></article><div class="c-teasers"><a href="/t1"><p>X18</p></a><a href="/t2"><p>X15</p></a></div><footer>X20</footer>',
    "blog": '<div id="page" class="hfeed site"><header class="site-branding"><p>X5</p></header><div class="entry-content"><h1>M5</h1><p>M71</p><p>M8</p><p>M40</p></div>'
    '<div id="comments-wrap"><ol class="comment-list"><li class="comment even"><div class="comment-content"><p>X33</p></div></li><li class="comment odd"><p>X12</p></li></ol></div></div>',
    "overlay": '<div class="cookie-consent-overlay" id="onetrust-banner-sdk"><h2>We value your privacy</h2><p>X40</p><button>X2</button></div><main><h1>M7</h1><p>M55</p><p>M21</p></main>',
    "grid": '<div class="container"><div class="row"><div class="col-md-8"><h1>M6</h1><p>M64</p><p>M18</p><p>M47</p></div><div class="col-md-4"><h3>X2</h3><p>X25</p><ul><li><a href=/>X4</a></li></ul></div></div></div>',
    "thread": '<article><h1>M8</h1><p>M50</p><p>M26</p></article><ul class="comment-thread"><li class="comment-item">X30</li><li class="comment-item">X22</li></ul>',
    "headed": "<article><h1>M4</h1><p>M37</p><p>M66</p></article><section><h2>12 Comments</h2><p>X28</p><p>X51</p></section><section><h2>You may also like</h2><p>X9</p><p>X11</p></section>",
    "german": "<nav><a href=/>X1</a></nav><div class=beitrag><h1>M6</h1><p>M48</p><p>M35</p></div><h3>Kommentare (3)</h3><div><p>X24</p></div><div><p>X41</p></div>",
    "teasers": "<h1>M7</h1><p>M59</p><p>M33</p><p>M24</p><a href=/q><div><p>X16</p></div></a><a href=/r><div><p>X21</p></div></a>",
    "anchor": '<a name="top"><h1>M5</h1><p>M63</p><p>M20</p><p>M18</p>',
    "unclosed": "<article><p>M30 <a href=/x>M3<p>M40</p><p>M22</p></article>",
    "slash": "<div data-src=http://x/a/><h1>M4</h1><p>M52</p></div><p>M31</p><footer>X12</footer>",
    "cards": '<section class="intro"><h1>M5</h1><p>M34</p></section><div class=row><div class="col-md-4"><p>M26</p></div><div class="col-md-4"><p>M30</p></div><div class="col-md-4"><p>M22</p></div></div>',
    "recipe": "<nav><ul><li><a href=/>X1</a></li></ul></nav><main><h1>M4</h1><p>M28</p><h2>M1</h2><ul><li>M4</li><li>M3</li><li>M5</li></ul><h2>M1</h2><ol><li>M18</li><li>M25</li></ol></main><aside>X30</aside>",
    "newsletter": '<article class="story"><h1>M9</h1><p>M46</p><div class="newsletter-inline"><h4>X4</h4><p>X17</p></div><p>M58</p><p>M12</p></article><div class="site-footer__legal">X35</div>',
    "dialogue": "<header class=masthead><a href=/>X2</a></header><article><h1>M6</h1><p>M3</p><p>M6</p><p>M2</p><p>M11</p><p>M4</p></article><div class=tagcloud-tags><a href=/>X1</a> <a href=/>X1</a></div>",
}


def words(shape: str) -> tuple[str, set[str], set[str]]:
    """A shape with words that are all unlike, those of the article and the others."""
    kinds: dict[str, set[str]] = {"M": set(), "X": set()}

    def fill(m: re.Match) -> str:
        made = [f"{'main' if m[1] == 'M' else 'other'}{m.start()}n{i}" for i in range(int(m[2]))]
        kinds[m[1]].update(made)
        return " ".join(made)

    return re.sub(r"\b([MX])(\d+)\b", fill, SHAPES[shape]), kinds["M"], kinds["X"]


@pytest.mark.parametrize("shape", sorted(SHAPES))
def test_words_of_a_shape(shape):
    page, main, other = words(shape)
    got = set(html_text.main_text(page).split())
    assert len(got & main) >= 0.9 * len(main), sorted(main - got)
    assert len(got & other) <= 0.1 * len(main), sorted(got & other)


def test_all_shapes_together():
    found = right = there = 0
    for shape in SHAPES:
        page, main, other = words(shape)
        got = set(html_text.main_text(page).split())
        right, found, there = right + len(got & main), found + len(got & (main | other)), there + len(main)
    assert right >= 0.95 * found and right >= 0.95 * there


@pytest.mark.parametrize(
    ("name", "kind"),
    [
        ("comment-thread", html_text.STRONG), ("ad-300x250", html_text.SIDE), ("onetrust-banner-sdk", html_text.SIDE), ("page__sidebar", html_text.SIDE), ("c-article__content", html_text.MAIN),
        ("siteFooter", html_text.SIDE), ("col-md-4", html_text.OPEN), ("content-sidebar-wrap", html_text.OPEN), ("has-sidebar", html_text.OPEN), ("", html_text.OPEN), ("42", html_text.OPEN),
    ],
)
def test_names(name, kind):
    assert html_text.name_kind(name) == kind


def test_nesting_and_odd_ends_take_linear_time():
    deep = "<div>" * 50_000 + "<ul><li>" * 20_000 + "<h2>Comments</h2>" * 2_000 + "</div></li><li>" * 20_000 + "</div>" * 60_000
    html_text.main_text(deep)
    assert html_text.main_text("<li>" * 3 + "<td>" * 3 + "</ul></a><a href=x>") == ""
