"""Extraction from hand-written pages, whose texts are known, and from hostile ones."""

import time

import numpy as np
import pytest

from bomloom.llm import html

P = ["The river rose by two metres in a single night, and the old bridge was closed to all traffic.", "By noon the water stood in the cellars of the market square; nobody was hurt, the mayor said.", "Volunteers carried sandbags until the evening, when the rain at last began to ease over the hills.", "Repairs to the embankment will take until spring, and cost more than the town has put aside."]
TEXT = " ".join(P)
BODY = "".join(f"<p>{p}</p>" for p in P)
TITLE = "Flood in the old town"
WHOLE = f"{TITLE} {TEXT}"

CARDS = "<article><h3>Ferry late again</h3><p>The ferry was late for the third time.</p></article><article><h3>Rain</h3><p>Rain is on its way.</p></article>"

#: (name, page, text)
PAGES = [
    ("article", f"<nav>Home</nav><article><h1>{TITLE}</h1>{BODY}</article><footer>Imprint</footer>", WHOLE),
    ("main", f"<div class=menu>Home</div><main><h1>{TITLE}</h1>{BODY}</main><aside>More</aside>", WHOLE),
    ("plain divs", f"<div>Home</div><div>Search our site</div><h1>{TITLE}</h1>{BODY}<div>Terms</div><div>Privacy</div>", WHOLE),
    ("no heading", f"<div>Home</div><div>News</div><div>Sport</div>{BODY}<div>Terms</div>", TEXT),
    ("link menu", f"<ul><li><a href=/>Home</a><li><a href=/n>All the news of the town and of the country</a></ul>{BODY}", TEXT),
    ("link list at the end", f"{BODY}<ul><li><a href=1>The ten best places to see in autumn this year</a><li><a href=2>Why the ferry is late again, and again</a></ul>", TEXT),
    ("copyright", f"{BODY}<div>© 2020 The Town Herald, a company registered at the district court, all rights reserved by it and others.</div>", TEXT),
    ("footer words", f"{BODY}<div>Terms of use</div><div>Imprint</div><div>Contact</div><div>Jobs</div>", TEXT),
    ("menu words", f"<div>Home</div><div>Politics</div><div>Sport</div><div>Culture</div><div>Weather</div><h2>{TITLE}</h2>{BODY}", WHOLE),
    ("byline", f"<h1>{TITLE}</h1><div>By A. Smith</div><div>3 May</div>{BODY}", f"{TITLE} By A. Smith 3 May {TEXT}"),
    ("short last sentence", f"{BODY}<p>More follows.</p><div>Imprint</div>", f"{TEXT} More follows."),
    ("short paragraph inside", f"<p>{P[0]}</p><p>Then silence</p><p>{P[1]}</p>", f"{P[0]} Then silence {P[1]}"),
    ("advert between", f"<p>{P[0]}</p><div class=ad>Buy a boat</div><div class=ad>Buy two</div><div class=ad>Buy three</div><p>{P[1]}</p>", f"{P[0]} {P[1]}"),
    ("long advert between", f"<p>Short lead.</p><div class='ad-slot'>{P[3]}</div><div class=ad>x</div><div class=ad>y</div>{BODY}", f"Short lead. {TEXT}"),
    ("light last section", f"{BODY}<div class=ads>a</div><div class=ads>b</div><div class=ads>c</div><h2>After</h2><p>The water fell on Friday, they say.</p>", f"{TEXT} After The water fell on Friday, they say."),
    ("related article class", f"<div class='related-article content'>{BODY}</div>", TEXT),
    ("has-sidebar", f"<body class='has-sidebar nav-open'><div id=wrap class=post-comment-enabled>{BODY}</div>", TEXT),
    ("compounds", f"<div class='content-sidebar-wrap with-comments'><div class='news-article'>{BODY}</div><div class='article-comments'><p>I was there, and it was not like that at all.</p></div><div id=site_footer>Imprint and all that, in a long line of text.</div></div>", TEXT),
    ("cookie notice", f"<div id=cookie-notice>We set cookies. This text about them is longer than any of the article's own paragraphs, and says nothing.</div>{BODY}", TEXT),
    ("comments", f"<article>{BODY}</article><section id=comments><p>{P[0]} I was there, and it was not like that at all.</p></section>", TEXT),
    ("comments in divs", f"{BODY}<div class='comment-list'><p>I was there, and it was not like that at all, I tell you.</p></div>", TEXT),
    ("sidebar", f"<div class='left-sidebar'>Weather today: rain, and then some more of it until the evening.</div>{BODY}", TEXT),
    ("form", f"{BODY}<form>Your name <input> and your opinion of this article, in your own words: <textarea>Type</textarea></form>", TEXT),
    ("hidden", f"{BODY}<div hidden>A text that nobody sees, of some length, in a hidden element.</div><div style='display: none'>Another such text.</div>", TEXT),
    ("script and style", f"<style>p{{}}</style><script>var x = '<p>no</p>';</script>{BODY}<SCRIPT>if (a < b) document.write('</p>')</SCRIPT >", TEXT),
    ("comment markup", f"<!-- <p>not this</p> -->{BODY}<!-- unclosed {P[0]}", TEXT),
    ("self-closing", f"<svg/><object data=x /><p>{P[0]}</p><canvas/><p>{P[1]}</p>", f"{P[0]} {P[1]}"),
    ("custom elements", f"<title-bar>Herald</title-bar><story-text>{BODY}</story-text>", TEXT),
    ("references", "<article><p>Fish &amp; chips &lt;cheap&gt; &eacute;t&eacute; &#8211; caf&#xe9;&nbsp;bar</p></article>", "Fish & chips <cheap> été – café bar"),
    ("white space", "<article><p>One\n\t two&nbsp; three<br>four</p>  <p> five </p></article>", "One two three four five"),
    ("inline markup", "<article><p>An <b>im</b>portant <a href=x>link</a>, <i>really</i>.</p></article>", "An important link, really."),
    ("unclosed", f"<p>{P[0]}<p>{P[1]}<div>{P[2]}", " ".join(P[:3])),
    ("quotes in tags", f"<div title='a > b' data-x=\"c > d\">{BODY}</div><p class=it's>{P[0]}</p>", f"{TEXT} {P[0]}"),
    ("unclosed quote", f'<div title="a>{BODY}<p>{P[0]}</p>', f"{TEXT} {P[0]}"),
    ("less than", f"<p>{P[0]} 1 < 2 and 3 > 2.</p>", f"{P[0]} 1 < 2 and 3 > 2."),
    ("header in article", f"<header>The Town Herald</header><article><header><h1>{TITLE}</h1></header>{BODY}</article>", WHOLE),
    ("table", "<article><table><tr><th>Year<td>Level<tr><th>1990<td>3.5</table></article>", "Year Level 1990 3.5"),
    ("short list in article", f"<article>{BODY}<ul><li>one</li><li>two</li><li>three</li><li>four</li></ul></article>", f"{TEXT} one two three four"),
    ("cards after the story", f"<main><article><h1>{TITLE}</h1>{BODY}</article>{CARDS}</main>", WHOLE),
    ("cards after a story in divs", f"<div><h1>{TITLE}</h1>{BODY}</div><article><p><a href=1>Ferry late again</a></p></article>", WHOLE),
    ("cards without main", f"<article><h1>{TITLE}</h1>{BODY}</article><div><h2>More stories</h2>{CARDS}</div>", WHOLE),
    ("two stories", f"<article>{BODY}</article><p>Share</p><article>{BODY}</article>", f"{TEXT} {TEXT}"),
    ("sections as articles", f"<main><h1>{TITLE}</h1>{''.join(f'<article><p>{p}</p></article>' for p in P)}</main>", WHOLE),
    ("story in main beside cards", f"<main><h1>{TITLE}</h1>{BODY}{CARDS}</main>", WHOLE),
    ("named share", f"<div>Home</div><div class='post-share'><h1>{TITLE}</h1>{BODY}</div><div>Terms</div>", WHOLE),
    ("named reviews", f"<div class='album-reviews'><h1>{TITLE}</h1>{BODY}</div><div>Terms</div>", WHOLE),
    ("form around the body", f"<form id=aspnetForm><div class=menu>Home</div><h1>{TITLE}</h1>{BODY}<div class=footer>Imprint and more.</div></form>", WHOLE),
    ("long comments", f"<article>{BODY}</article><div id=comments>{BODY * 4}</div>", TEXT),
    ("long comments beside divs", f"<div>{BODY}</div><div id=comments>{BODY * 4}</div>", TEXT),
    ("discussion", f"{BODY}<section id=discussion><p>I was there, and it was not like that at all.</p></section>", TEXT),
    ("search results", f"{BODY}<div class='search-results'><p>The ferry was late for the third time this week.</p></div>", TEXT),
    ("more stories", f"<article>{BODY}</article><div><h3>More stories</h3><p>The ferry was late for the third time.</p></div>", TEXT),
    ("header in main", f"<main><header>Site menu</header><h1>{TITLE}</h1>{BODY}</main>", WHOLE),
    ("title in main's header", f"<main><header><div>Site menu</div><h1>{TITLE}</h1></header>{BODY}</main>", WHOLE),
    ("title beside article", f"<main><h1>{TITLE}</h1><article>{BODY}</article></main>", WHOLE),
    ("nothing but boilerplate", "<nav>Home</nav><footer>Imprint</footer>", ""),
    ("text only", "plain text", "plain text"),
]


@pytest.mark.parametrize("name, page, text", PAGES, ids=[p[0] for p in PAGES])
def test_page(name, page, text):
    assert html.main_text(page)[0] == text


def test_distribution_decides(monkeypatch):
    """Without surge and dive, the lines around the text of pages without an article element stay."""
    monkeypatch.setattr(html, "article_spans", lambda found: [(0, len(found))])
    wrong = [name for name, page, text in PAGES if html.main_text(page)[0] != text]
    assert {"plain divs", "no heading", "link menu", "link list at the end", "copyright", "footer words", "menu words"} <= set(wrong)


def test_distribution_decides_on_given_pages(spark, monkeypatch):
    """Without surge and dive, menus, adverts and footers of the tables' pages stay, article element or not."""
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html").collect()]
    texts = [html.main_text(p)[0] for p in pages]
    monkeypatch.setattr(html, "article_spans", lambda found: [(0, len(found))])
    assert sum(t != html.main_text(p)[0] for t, p in zip(texts, pages, strict=True)) > 0.9 * len(pages)


HOSTILE = {
    "quotes": '<a b="' + '"' * 1_000_000,
    "quoted ends": '<a =">" ' * 125_000,
    "two quotes": "<a =' =\">" * 110_000,
    "depth": "<div>" * 130_000 + "x" + "</div>" * 60_000,
    "closing only": "</b></div>" * 100_000,
    "openings": "<a " * 330_000,
    "attributes": "<p " + "a=1 " * 250_000 + ">x",
    "comments": "<!--" * 250_000,
    "scripts": "<script>" * 120_000,
    "references": "&amp" * 250_000,
    "inline": "<b>" * 300_000 + "x",
    "classes": "<b class='a-b'>x</b>" * 50_000,
}


@pytest.mark.parametrize("name", sorted(HOSTILE))
def test_hostile_page(name):
    """A megabyte takes about a second at most, whatever it holds."""
    began = time.process_time()
    html.main_text(HOSTILE[name])
    assert time.process_time() - began < 3


def test_long_page_is_whole():
    words = [f"word{i} and its sentence, which is long enough." for i in range(60_000)]
    assert html.main_text("<article>" + "".join(f"<p>{w}</p>" for w in words) + "</article>")[0] == " ".join(words)


def test_clashing_columns(spark):
    rows = [(1, "u", f"<p>{P[0]}</p>", "x", "y", 5), (None, None, None, None, None, None)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, text string, _key string, surge long")
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in html.op9_html_extraction(table).collect()}
    assert got == {1: ("u", P[0], len(P[0])), None: (None, "", 0)}


def test_blocks():
    assert html.blocks(np.array([1, 2, 3, 4])).tolist() == [6, 9, 7, 4]
