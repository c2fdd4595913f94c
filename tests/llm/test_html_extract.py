"""Main text against expected articles, written by hand or cut from the pages' own markup."""

import html
import re

import pytest

from assaylake.llm.html_extract import extract_text, main_text

PARAGRAPHS = ["First, a long paragraph of the article; it has several clauses, and it ends here.", "Short.", "Another paragraph, with <b>bold</b> words &amp; <a href='/x'>a link</a>, goes on for a while."]
CLEAN = [re.sub("<[^>]+>", "", html.unescape(p)) for p in PARAGRAPHS]
BODY = "".join(f"<p>{p}</p>\n" for p in PARAGRAPHS)
JUNK = [
    "<nav><ul><li><a href='/'>Home</a></li><li><a href='/b'>Blog, news, and more.</a></li></ul></nav>",
    "<header><h2>The Site, Ltd.</h2><p>All the news, every day, for all.</p></header>",
    "<div class='cookie-notice'><p>We use cookies, sorry. Accept them, or leave, as you wish.</p></div>",
    "<aside><p>Read also: this, that, and the other thing, today.</p></aside>",
    "<div id=sidebar><p>Popular: one, two, three, four, five, six.</p></div>",
    "<div class=\"ad\">Buy now, pay later. Offer ends soon, really.</div>",
    "<form><p>Your name, please.</p><input name=q><button>Send</button></form>",
    "<section class='commentList' id='comments'><h3>Comments</h3><article><p>I disagree, strongly, with all of this, as ever.</p></article></section>",
    "<footer>&copy; The Site. All rights reserved, everywhere.</footer>",
    "<script>var t = '</p><p>no, never.</p>';</script><style>p{margin:0}</style><!-- <p>hidden, text.</p> -->",
]


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main>{}</main>", "<div id='content'>{}</div>", "<div class='post'><div>{}</div></div>"])
@pytest.mark.parametrize("around", [0, 3, len(JUNK)])
def test_article_among_furniture(wrap, around):
    page = "<!doctype html><html><head><title>T, t.</title></head><body>" + "".join(JUNK[:around]) + wrap.format(f"<h1>A  headline</h1>{BODY}") + "".join(JUNK[-around or 99 :]) + "</body></html>"
    assert main_text(page) == "\n\n".join(["A headline", *CLEAN])


def test_furniture_inside_the_article():
    page = f"<article><h1>H</h1>{BODY}<div class='share-buttons'>Share, like, follow.</div><aside>More, here.</aside><p>End of it.</p></article>"
    assert main_text(page) == "\n\n".join(["H", *CLEAN, "End of it."])


@pytest.mark.parametrize(("page", "text"), [
    (None, ""), ("", ""), ("<nav>a, b</nav>", ""), ("plain &lt;text&gt;, here", "plain <text>, here"), ("<p>a<br>b &nbsp; c\n d<p>e</p>", "a b c d\n\ne"),
    ("<article><p>cut off, he", "cut off, he"), ("<article><p>x &am", "x &am"), ("<article><p>1 < 2, and 3 > 2.</p></article>", "1 < 2, and 3 > 2."), ("<script>never closed <p>x</p>", ""), ("<", "<"), ("<p title='a>b'>x.</p>", "x."),
])
def test_odd_pages(page, text):
    assert main_text(page) == text


def test_pages_table(spark, sf):
    rows = extract_text(spark.read.parquet(f"{sf}/pages.parquet").selectExpr("page_id", "url", "html", "html as raw", "1 as text")).collect()
    for r in rows:
        inner = re.search(r"(?s)<article>(.*?)(?:</article>|<footer>)", r.raw)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]+>", " " if "br" in b[:0] else "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n\n".join(b for b in blocks if b)
        assert r.n_chars == len(r.text)
    assert extract_text(spark.read.parquet(f"{sf}/pages.parquet").limit(0)).collect() == []
    long = spark.createDataFrame([(1, None, "<article>" + "<p>word, word.</p>" * 50_000)], "page_id long, url string, html string")
    assert extract_text(long).first().n_chars == 50_000 * 11 + 49_999 * 2
