"""Main text of pages in many ways of writing them, with the text that a reader would call the article."""

import pytest

from leadmill.llm import html, queries

LONG = "The council met on Monday and decided to close the old bridge for repairs until the end of next year."
MORE = "Drivers will have to use the northern road, which is narrow and often blocked by snow in winter months."
LAST = "A spokeswoman said that the works would cost four million and that the state would pay for half of them."
BODY = f"<h1>Bridge closed</h1><p>{LONG}</p><p>{MORE}</p>"
TEXT = f"Bridge closed\n\n{LONG}\n\n{MORE}"
NAV = '<nav><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li></ul></nav>'
FOOT = "<footer><p>Copyright 2024 The Daily Bridge. All rights reserved. Contact our office for more information about it.</p></footer>"
TALK = "I have lived here for forty years and nobody ever asked me what I think about the bridge, which is a shame."

PAGES = {
    "a form around the page": (f'<body><form id="aspnetForm" method="post"><input type="hidden"><header><a href="/">Home</a></header><article>{BODY}</article></form></body>', TEXT),
    "a form around a main": (f"<form><div>{NAV}</div><main>{BODY}</main>{FOOT}</form>", TEXT),
    "a form around paragraphs": (f"<form action=x><h1>Bridge closed</h1><p>{LONG}</p><p>{MORE}</p><p>{LAST}</p></form>", f"{TEXT}\n\n{LAST}"),
    "a form in an article": (f"<article>{BODY}<form><p>Get the newsletter of the bridge each week in your mail box for free.</p><input><button>Go</button></form></article>", TEXT),
    "a form after an article": (f"<article>{BODY}</article><form><label>Your name</label><p>We will not share it with anyone else at all, we promise you that.</p></form>", TEXT),
    "an article in a menu": (f"<menu><article>{BODY}</article></menu>", TEXT),
    "an article in a dialog": (f"<dialog open><article>{BODY}</article></dialog>", TEXT),
    "an article in a fieldset": (f"<fieldset><article>{BODY}</article></fieldset>", TEXT),
    "comments as articles": (f'<article>{BODY}</article><div id="comments"><ol><li class="comment"><article class="comment-body"><p>{TALK}</p></article></li></ol></div>', TEXT),
    "comments as articles in the main": (f'<main><article>{BODY}</article><section class="comments-area"><article><p>{TALK}</p></article></section></main>', TEXT),
    "comments before the article": (f'<div class="comment-list"><article><p>{TALK}</p></article></div><article>{BODY}</article>', TEXT),
    "users' comments in a main": (f'<main>{BODY}<div class="user-comments"><p>{TALK}</p></div></main>', TEXT),
    "readers' comments in a main": (f'<main>{BODY}<div class="reader_comments"><p>{TALK}</p></div></main>', TEXT),
    "a post's comments": (f'<article>{BODY}<div id="post-comments"><p>{TALK}</p></div></article>', TEXT),
    "answers": (f'<article>{BODY}</article><div id="respond"><p>{TALK}</p></div><div class="replies"><p>{TALK}</p></div>', TEXT),
    "a discussion": (f'<main>{BODY}<section id="disqus_thread"><p>{TALK}</p></section></main>', TEXT),
    "related posts": (f'<article>{BODY}</article><div class="related-posts"><article><h2>Tunnel opened</h2><p>{LAST}</p></article></div>', TEXT),
    "related posts first": (f'<div class="related-posts"><article><h2>Tunnel opened</h2><p>{LAST}</p></article></div><article>{BODY}</article>', TEXT),
    "a sidebar of articles": (f'<div class="sidebar"><article><h3>Tunnel</h3><p>{LAST}</p></article></div><article>{BODY}</article>', TEXT),
    "an aside with an article": (f"<article>{BODY}</article><aside><article><p>{LAST}</p></article></aside>", TEXT),
    "a short page": ("<h1>Title</h1><p>Hello there friend.</p>", "Title\n\nHello there friend."),
    "a short page with menus": (f"<html><body>{NAV}<p>Hello there friend.</p>{FOOT}</body></html>", "Hello there friend."),
    "paragraphs with links": (f'<body>{NAV}<div><h1>Bridge closed</h1><p>The council <a href=x>met on Monday and decided</a> to close the old bridge.</p><p>{MORE}</p></div>{FOOT}</body>', f"Bridge closed\n\nThe council met on Monday and decided to close the old bridge.\n\n{MORE}"),
    "menus alone": (f"<html><body>{NAV}<div>Home</div><p><a href=x>All our news</a></p>{FOOT}</body></html>", ""),
    "no article": (f'<body>{NAV}<div id="content">{BODY}</div>{FOOT}</body>', TEXT),
    "headers of articles": (f'<article class="post"><header class="entry-header"><h1>Bridge closed</h1></header><div class="entry-content"><p>{LONG}</p><p>{MORE}</p></div></article>', TEXT),
    "a wrapper named as a header": (f'<div class="header-wrap"><article>{BODY}</article></div>', TEXT),
    "a notice in an article": (f'<article><div class="cookie-notice"><p>{TALK}</p></div>{BODY}</article>', TEXT),
    "an advert between paragraphs": (f'<article><h1>Bridge closed</h1><p>{LONG}</p><div class="ad-slot">Buy now</div><p>{MORE}</p></article>', TEXT),
    "sharing": (f'<article>{BODY}<div class="social-share"><a href=x>Tell a friend</a></div></article>', TEXT),
    "two articles": (f"<main><article>{BODY}</article><article><h2>Tunnel</h2><p>{LAST}</p></article></main>", f"{TEXT}\n\nTunnel\n\n{LAST}"),
    "tables": (f'<article>{BODY}<table><tr><th>Year<td>2024</table></article>', f"{TEXT}\n\nYear\n\n2024"),
    "lists and quotes": (f"<article>{BODY}<ul><li>North<li>South</ul><blockquote>So be it.</blockquote></article>", f"{TEXT}\n\nNorth\n\nSouth\n\nSo be it."),
    "old markup": (f"<BODY><TABLE><TR><TD><A HREF=/>Home</A><TD><H1>Bridge closed</H1><P>{LONG}<P>{MORE}</TABLE>", TEXT),
    "references": ("<article><h1>Tom &amp; J&eacute;r&#244;me</h1><p>a &lt;b&gt;&nbsp;c</p></article>", "Tom & Jérôme\n\na <b> c"),
    "scripts and styles": (f"<article><style>p{{}}</style>{BODY}<script>if (a < b) {{ x('<p>no</p>') }}</script><noscript><p>{TALK}</p></noscript></article>", TEXT),
}


@pytest.mark.parametrize("name", PAGES)
def test_page(name):
    page, want = PAGES[name]
    assert html.main_text(page) == want


def test_op10_over_odd_tables(spark, tmp_path):
    rows = [(1, "u", PAGES["related posts"][0], "clash"), (1, "u", PAGES["related posts"][0], "clash"), (2, None, None, None), (None, "", "", "")]
    for name, n in (("all", 4), ("none", 0)):
        spark.createDataFrame(rows[:n], "page_id long, url string, html string, text string").write.parquet(f"{tmp_path}/{name}/pages.parquet")
        got = queries.QUERIES["op10_html_extraction"](spark, f"{tmp_path}/{name}").collect()
        assert sorted((str(r.page_id), r.text, r.n_chars) for r in got) == sorted([("1", TEXT, len(TEXT))] * 2 + [("2", "", 0), ("None", "", 0)])[: 4 if n else 0]
