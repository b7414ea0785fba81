"""Labelled page shapes from which the main-text classifier learns.

Each is the skeleton of a page: +9 stands for nine words of main text, -9 for nine other words. The shapes are those of usual publishing systems: pages with
landmark elements, with classes only, with neither, wrapped in layout containers or in one form, dialogue, lists, recipes, forums and pages without an article.
The labelled names tell what the words in class names and ids say of an element's content.
"""

from __future__ import annotations

_NAV = "<nav><ul><li><a>-1</a></li><li><a>-1</a></li><li><a>-2</a></li></ul></nav>"
_FOOT = "<footer><p>-12</p><ul><li><a>-1</a></li><li><a>-2</a></li></ul></footer>"

#: Names of what stands beside an article.
SIDE_NAMES = (
    "ad ads ad-slot ad-container advert adverts advertisement advertising adsense article-ad billboard sponsor sponsored promo promotion banner breadcrumb breadcrumbs"
    " cookie cookies cookie-consent cookie-notice consent consent-overlay gdpr disclaimer footer site-footer page-footer header site-header page-header masthead login signin"
    " menu main-menu nav navbar main-nav site-nav post-nav navigation post-navigation newsletter signup subscribe subscription notice notification pagination pager popup modal"
    " overlay recommended recommendations related related-posts article-related read-next more-stories most-read trending search search-form share share-buttons post-share"
    " social social-links sidebar article-sidebar content-sidebar right-rail side-bar skip-link toolbar topbar widget widget-area alert tags post-tags author-bio outbrain taboola"
    " toc table-of-contents teaser-list onetrust"
).split()
#: Names of what readers say.
STRONG_NAMES = "comment comments commentlist comment-list comment-thread comment-content comment-body post-comments article-comments disqus replies respond".split()
#: Names of articles.
MAIN_NAMES = (
    "article article-body article-content article-text articlebody content content-body entry entry-content main main-content maincontent post post-body post-content post-text"
    " story story-body story-content body-text text-body page-content blog-post"
).split()
#: Names that say nothing of their content.
OPEN_NAMES = (
    "container wrapper wrap row col column page site layout inner section block grid card box has-sidebar no-sidebar with-sidebar content-sidebar-wrap has-ads no-comments"
    " content-wrapper main-wrapper page-wrapper text-center text-lg article-header entry-header post-header header-image article-footer post-title article-list search-page has-nav"
    " with-menu figure body text list item"
).split()
#: Phrases that head what stands beside an article, in lower case without numbers and marks.
CUES = frozenset(
    "comments|comment|leave a comment|leave a reply|add a comment|post a comment|reader comments|join the discussion|join the conversation|related|related articles|related posts"
    "|related stories|more stories|more from this author|you may also like|you might also like|recommended|recommended for you|read next|up next|most read|most popular|popular posts"
    "|trending|trending now|advertisement|sponsored|sponsored content|newsletter|subscribe|subscribe to our newsletter|sign up|share this|share this article|follow us|tags|archives"
    "|recent posts|recent comments|navigation|navigation menu|main menu|contents|table of contents|on this page|about the author|cookie settings|we value your privacy"
    "|kommentare|kommentar schreiben|leserkommentare|ähnliche artikel|verwandte artikel|das könnte sie auch interessieren|meistgelesen|anzeige|inhaltsverzeichnis|mehr zum thema"
    "|commentaires|laisser un commentaire|articles similaires|à lire aussi|sommaire|publicité|comentarios|deja un comentario|artículos relacionados|te puede interesar|publicidad".split("|")
)

PAGES = [
    # Landmark elements.
    f"{_NAV}<div class=ad>-8</div><article><h1>+9</h1><p>+60 <a>+1</a></p><p>+1</p><p>+35</p></article><footer>-14</footer>",
    f"{_NAV}<div class=ad>-2</div><article><h1>+3</h1><p>+12</p></article><footer>-6</footer>",
    f"{_NAV}<div class=ad>-30</div><article><h1>+11</h1><p>+2</p><p>+300</p><p>+1</p><p>+4</p><p>+90</p></article><footer>-25</footer>",
    f"{_NAV}<div class=ads>-50</div><article><h1>+1</h1><p>+1</p></article><footer>-3</footer>",
    f"<header><p>-4</p>{_NAV}</header><main><article><header><h1>+7</h1><p>+5</p></header><p>+45</p><blockquote>+14</blockquote><ul><li>+6</li><li>+9 <a>+1</a></li></ul><h2>+3</h2><p>+80</p></article></main><aside><h3>-2</h3><p>-33</p><ul><li><a>-6</a></li></ul></aside>{_FOOT}",
    f"{_NAV}<main><h1>+8</h1><p>+25</p><p><a>+11</a></p><p>+40</p></main>{_FOOT}",
    f"{_NAV}<main><article><h1>+6</h1><p>+30</p><ul><li><a>+4</a></li><li><a>+3</a></li></ul><p>+22</p><aside><h4>-2</h4><p>-18</p></aside><p>+50</p></article><section class=comments><h2>-1</h2><p>-20</p><p>-45</p><p>-3</p></section></main>{_FOOT}",
    f"{_NAV}<article><h1>+5</h1><p>+1</p><p>+2</p><p>+1</p><p>+13</p><p>+3</p></article><footer>-9</footer>",
    f"{_NAV}<article><h1>+10</h1><p>+40</p><nav><a>-2</a> <a>-2</a></nav><p>+18</p><div class=share><a>-1</a><a>-1</a></div><div class=related><h3>-2</h3><ul><li><a>-7</a></li><li><a>-9</a></li></ul></div></article>{_FOOT}",
    f"{_NAV}<article><h1><a>+7</a></h1><p>+22</p><figure><figcaption>+11</figcaption></figure><p>+55</p></article><section id=comments><h3>-2</h3><article><p>-30</p></article><article><p>-12</p></article></section>{_FOOT}",
    f"<div role=banner>-6</div><div role=navigation><a>-1</a> <a>-2</a></div><div role=main><h1>+6</h1><p>+70</p><p>+8</p></div><div role=complementary><p>-40</p></div><div role=contentinfo>-15</div>",
    f"<dialog><p>-25</p><p>-8</p></dialog>{_NAV}<article><h1>+4</h1><p>+35</p><table><tr><td>+1</td><td>+2</td></tr><tr><td>+3</td><td>+1</td></tr></table><p>+16</p></article>{_FOOT}",
    f"{_NAV}<article><header><h2>+9</h2><p>+3</p></header><p>+52</p><p>+6</p><footer><p>-9</p></footer></article>{_FOOT}",
    f"<header><a>-2</a></header><article><header><h1>+5</h1></header><p>+2</p><p>+41</p></article><section class=comments-area><article><p>-24</p><p>-5</p></article><article><header><h4>-2</h4></header><p>-51</p></article></section>{_FOOT}",
    f"{_NAV}<main><article><h1>+8</h1><p>+37</p></article></main><div id=comments><ol><li><article><p>-15</p></article></li><li><article><p>-42</p></article></li></ol></div>{_FOOT}",
    # Inside containers whose names or kinds say something else.
    f'<div class="content-sidebar-wrap">{_NAV}<main class=content><article><h1>+7</h1><p>+44</p><p>+3</p><p>+61</p></article></main><aside class=sidebar><p>-26</p></aside></div>{_FOOT}',
    f"<form id=aspnetForm>{_NAV}<div id=main><h1>+6</h1><p>+50</p><p>+12</p><p>+2</p></div><div id=footer>-10</div></form>",
    f"<form><div class=header>-5</div><div class=content><h2>+4</h2><p>+33</p><p>+71</p></div><div class=sidebar><p>-20</p></div></form>",
    f'{_NAV}<div class="content has-sidebar"><h1>+5</h1><p>+38</p><p>+9</p></div><div class=sidebar><h4>-2</h4><p>-22</p></div>{_FOOT}',
    f'{_NAV}<div class="article search-page"><h1>+3</h1><p>+64</p><p>+17</p></div><div class=search><p>-6</p></div>{_FOOT}',
    f"<div class=widget><div class=article><h1>+8</h1><p>+47</p><p>+4</p></div></div><div class=widget><h3>-2</h3><p>-30</p></div>",
    f"<header><main><h1>+6</h1><p>+41</p><p>+5</p></main></header>{_FOOT}",
    f"<aside><article><h1>+5</h1><p>+33</p><p>+2</p><p>+20</p></article></aside>{_FOOT}",
    f"<div class=modal><main><p>+28</p><p>+77</p></main></div><div class=modal><p>-15</p></div>",
    f"{_NAV}<main><form><p>-4</p><p>-9</p><p>-1</p></form><p>+36</p><p>+19</p></main>{_FOOT}",
    f"{_NAV}<article><h1>+4</h1><p>+66</p><form><p>-12</p><label>-2</label></form></article><form><h3>-3</h3><p>-17</p></form>{_FOOT}",
    # Classes and ids only.
    "<div id=header>-5</div><div id=nav><a>-1</a> <a>-1</a> <a>-2</a></div><div class=post><h2>+6</h2><div class=entry><p>+58</p><p>+11</p><p>+3</p></div></div><div id=sidebar><h3>-1</h3><ul><li><a>-3</a></li><li><a>-4</a></li></ul><p>-16</p></div><div id=footer>-11</div>",
    "<div class=navbar><a>-1</a><a>-2</a></div><div class=cookie-notice><p>-24</p></div><div class=story-body><h1>+8</h1><p>+29</p><p>+46</p><div class=advert><p>-13</p></div><p>+52</p></div><div class=newsletter><p>-19</p></div><div class=site-footer>-21</div>",
    "<div class=masthead>-3</div><div class=breadcrumbs><a>-1</a> <a>-2</a></div><div class=main-content><h1>+4</h1><ol><li>+14</li><li>+7</li><li>+25</li></ol><p>+31</p></div><ul class=pagination><li><a>-1</a></li><li><a>-1</a></li></ul><div class=comments><div class=comment><p>-32</p></div><div class=comment><p>-8</p></div></div><div class=footer>-8</div>",
    "<div class=topbar>-4</div><div class=article-body><p>+1</p><p>+4</p><p>+2</p><p>+13</p><p>+1</p><p>+3</p></div><div class=sponsored><p>-27</p></div><div class=disclaimer><p>-48</p></div>",
    "<div class=article-content><p>+21</p><p>+90</p><div class=share-buttons>-3</div><div class=author-bio><p>-28</p></div></div><div class=related-posts><h4>-2</h4><p><a>-8</a></p><p><a>-10</a></p></div>",
    "<div style='display:none'><p>-35</p></div><div class=content><h1>+5</h1><p>+62</p><p>+6</p></div><p class=notice>-14</p>",
    "<div class=main><div class=menu><ul><li><a>-2</a></li><li><a>-1</a></li></ul></div><div class=content><h1>+6</h1><p>+42</p><pre>+30</pre><p>+15</p></div></div><div class=footer><p>-18</p><p>-40</p></div>",
    # Neither landmarks nor names.
    "<ul><li><a>-1</a></li><li><a>-1</a></li><li><a>-1</a></li></ul><h1>+7</h1><p>+45 <a>+1</a></p><p>+70</p><p>+12</p><p>+38 <a>+2</a></p><p>+25</p><ul><li><a>-2</a></li><li><a>-2</a></li></ul>",
    "<div><a>-3</a></div><div><a>-2</a> | <a>-2</a></div><h1>+5</h1><p>+25</p><p>+9</p><p>+90 <a>+3</a></p><div><a>-4</a> -2</div>",
    "<table><tr><td><a>-2</a></td><td><a>-1</a></td></tr></table><h2>+10</h2><p>+150 <a>+2</a></p><p>+44</p><p>+20</p><p><a>-8</a></p>",
    "<p>+40</p><p>+3</p><p>+66</p><p>+21</p>",
    "<h1>+4</h1><p>+18</p><p>+30</p><p>+5</p>",
    "<p>+1</p><p>+5</p><p>+2</p><p>+13</p><p>+1</p>",
    "<div>+120</div>",
    "<h1>+6</h1><div>+33<br>+12</div><div>+47</div>",
    "<p>+9</p>",
    "<div><div><div><p>+55</p><p>+14</p></div></div></div>",
    "<ul><li>+12</li><li>+9</li><li>+16</li></ul><p>+20</p>",
    "<div><a>-1</a> <a>-1</a> <a>-1</a> <a>-2</a></div><div><p>+34</p><p>+7</p><p>+58</p></div><div><a>-6</a></div><div><a>-9</a></div>",
    # No article.
    "<ul><li><a>-2</a></li><li><a>-3</a></li><li><a>-1</a></li><li><a>-4</a></li></ul><div><a>-6</a></div><ul><li><a>-2</a></li><li><a>-2</a></li></ul>",
    f"{_NAV}<form><p>-3</p><label>-1</label><label>-2</label></form>{_FOOT}",
    f"{_NAV}<div class=cookie-banner><p>-30</p></div><footer>-12</footer>",
    f"<div class=login><h2>-2</h2><p>-12</p></div>{_FOOT}",
    # Comments, adverts, overlays, teasers and lists of contents inside and beside articles.
    f"{_NAV}<article><h1>+6</h1><p>+48</p><p>+17</p><ul class=comment-thread><li class=comment-item><p>-21</p></li><li class=comment-item><p>-44</p></li></ul></article>{_FOOT}",
    f"{_NAV}<article><h1>+9</h1><p>+26</p><p>+57</p></article><section><h2>Comments</h2><p>-18</p><p>-40</p><p>-3</p></section>{_FOOT}",
    "<h1>+5</h1><p>+44</p><p>+62</p><p>+13</p><h3>Leave a comment</h3><p>-16</p><p>-35</p>",
    "<article><h1>+7</h1><p>+30</p><h2>+2</h2><p>+51</p><h2>Comments</h2><div><h4>-2</h4><p>-27</p></div><div><h4>-1</h4><p>-60</p></div></article>",
    f"{_NAV}<main><h1>+4</h1><p>+39</p><h2>+3</h2><p>+24</p><section><header><h3>Related articles</h3></header><p>-12</p><p>-14</p></section></main>{_FOOT}",
    "<div class=post><h2>+6</h2><p>+47</p><div class=ad-slot><p>-11</p></div><p>+33</p><p>+20</p></div><div><h3>Recent posts</h3><ul><li><a>-5</a></li><li><a>-7</a></li></ul></div>",
    "<div class=cookie-consent><p>-33</p><p>-14</p></div><div class=content><h1>+5</h1><p>+28</p><div class=ad>-9</div><p>+61</p><p>Advertisement</p><p>+18</p></div>",
    "<div id=toc><h2>Contents</h2><ul><li><a>-2</a></li><li><a>-3</a></li></ul></div><h1>+4</h1><p>+58</p><h2>+2</h2><p>+40</p>",
    f"{_NAV}<article><h1>+5</h1><div class=toc><ul><li>-3</li><li>-4</li></ul></div><h2>+3</h2><p>+66</p><h2>+2</h2><p>+29</p></article>{_FOOT}",
    f"{_NAV}<article><h1>+5</h1><p>+43</p><p>+25</p></article><a><h3>-6</h3><p>-19</p></a><a><p>-14</p></a>{_FOOT}",
    "<h1>+6</h1><p>+31</p><p>+54</p><p>+12</p><a><p>-17</p></a><a><p>-22</p></a><a><p>-9</p></a>",
    "<article><h1>+5</h1><p>+36</p><p>+72</p><a><p>-18</p></a><a><p>-11</p></a></article>",
    "<div class=row><div class=col-md-8><h1>+6</h1><p>+50</p><p>+21</p></div><div class=col-md-4><h4>-2</h4><p>-30</p><p>-15</p></div></div>",
    "<div class=row><div class=col-md-3><ul><li><a>-1</a></li><li><a>-2</a></li></ul><p>-25</p></div><div class=col-md-9><h1>+4</h1><p>+37</p><p>+8</p></div></div>",
    "<div class=grid><div class='large-8 columns'><h1>+7</h1><p>+52</p><p>+30</p></div><div class='large-4 columns'><h4>-3</h4><p>-45</p><p>-20</p></div></div>",
    "<div class=row><div class=span9><p>+41</p><p>+66</p></div><div class=span3><h3>-2</h3><p>-38</p><ul><li><a>-3</a></li></ul></div></div>",
    f"{_NAV}<div class=row><div class=col-sm-2><p>-17</p></div><div class=col-sm-8><h2>+5</h2><p>+33</p><p>+9</p></div><div class=col-sm-2><p>-26</p></div></div>{_FOOT}",
    "<div class=row><div class=col-md-4><p>+20</p></div><div class=col-md-4><p>+31</p></div><div class=col-md-4><p>+24</p></div></div>",
    f"{_NAV}<main><h1>+5</h1><ol><li class=comment><p>-20</p></li><li class=comment><p>-38</p></li></ol><p>+45</p><p>+33</p></main>{_FOOT}",
    "<article><h1>+6</h1><ol><li><p>+14</p></li><li><p>+19</p><p>+8</p></li></ol><table><tr><td><p>+5</p></td><td>+9</td></tr></table><p>+30</p></article>",
    "<div class=overlay><div><p>-28</p></div></div><h1>+5</h1><p>+46</p><p>+17</p><div class=newsletter><h3>-4</h3><p>-12</p></div>",
    f"{_NAV}<article><h1>+7</h1><p>+39</p><p><a>+6</a></p><p>+23</p><p><a>+3</a> <a>+4</a></p><p>+15</p></article>{_FOOT}",
]
