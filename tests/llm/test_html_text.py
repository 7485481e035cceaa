import html
import re
import time

import pytest

from millrace.llm import html_text
from millrace.llm.html_text import extract_text, is_aside, main_text

ARTICLE = "<article><h1>Title &amp; more</h1><p><b>First long paragraph with many words in it for the ratio.<br><p>Second one,\n  wrapped   text &eacute;&#39;s.</p><ul><li>one<li>two</ul><p>End.</p></article>"
TEXT = "Title & more First long paragraph with many words in it for the ratio. Second one, wrapped text é's. one two End."
NOISE = {
    "nav": "<nav><ul><li><a href='/a'>Menu entry that is long enough to look like text</a></ul></nav>",
    "header": "<header><h1>Site name</h1></header>",
    "footer": "<footer>&copy; site &middot; imprint and a long line of words about nothing at all</footer>",
    "aside": "<aside><p>Related links in a side bar with quite a few words in them too</p></aside>",
    "ad": "<div class='ad'>Buy this now, it is cheap and good and everybody wants it</div>",
    "cookie": "<div id='cookie-notice'><p>We use cookies to do many things with them, as everybody does</p></div>",
    "form": "<form>Your mail <input name=x><select><option>One<option>Two</select><button>Send</button></form>",
    "script": "<script>var t='</p><p>no text';</script><style>p{margin:0}</style><!-- <p>comment</p> -->",
    "comments": "<section class='comments'><div class='comment'><p>Great post, I really liked it and read it twice to my children</p></div></section>",
}


@pytest.mark.parametrize("name", NOISE)
def test_noise_around(name):
    page = lambda a, b, c: main_text(f"<!DOCTYPE html><html><head><title>T</title></head><body>{a}{b}{c}</body></html>")
    assert page(NOISE[name], ARTICLE, "") == TEXT and page("", ARTICLE, NOISE[name]) == TEXT
    inside = ARTICLE.replace("<p>End.", NOISE[name] + "<p>End.")
    assert page("", inside, "") == TEXT


def test_all_noise_without_article():
    body = "".join(NOISE.values()) + ARTICLE.replace("article>", "div>") + NOISE["footer"]
    assert main_text(f"<body>{body}") == TEXT


def test_class_names():
    aside = ["article-comments", "page-header", "main-nav", "ad-content", "reader_comments", "post footer", "cookieConsent cookie-bar"]
    content = ["post-content", "with-sidebar", "no-ads", "layout-sidebar-right", "category-social", "commentary", "address", "download"]
    page = lambda name: main_text(f"<body><div class='{name}'><p>Words in the section</p></div><div class='entry'><p>The words of the article, which are many more</p></div>")
    assert [page(n) for n in aside] == ["The words of the article, which are many more"] * len(aside)
    assert all(is_aside("div", [("class", n)]) is False for n in content)


def test_odd_pages():
    assert [main_text(x) for x in (None, "", "plain &lt; text", "<nav>only</nav>", "<p>a<p>b", "<div class='x'")] == ["", "", "plain < text", "", "a b", "<div class='x'"]
    assert main_text("<p>" + "word " * 50_000 + "</p>").count("word") == 50_000
    assert main_text("<div>" * 500 + "deep") == "deep"


def test_pages_against_their_articles(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for r in extract_text(pages.withColumn("text", pages["html"])).join(pages.select("page_id", "html"), "page_id").collect():
        inner = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        parts = re.split(r"</?(?:h1|p|br)>", inner.replace("<b>", "").replace("</b>", ""))
        assert r["text"] == " ".join(" ".join(html.unescape(x) for x in parts).split())
    assert extract_text(pages.limit(0)).count() == 0


def test_what_the_article_keeps():
    kept = [
        "<h2 id='discussion'>Discussion</h2>", "<section id='discussion'><h2>Discussion</h2><p>What it means.</p></section>", "<h2 id='related-work'>Related work</h2>", "<p class='byline'>By A. Writer</p>",
        "<p class='social-history'>Lives alone.</p>", "<p>As <math><mi>x</mi></math> grows</p>", "<figure><figcaption>A figure</figcaption></figure>", "<p id='comment-1'>No comment.</p>", "<table><tr><td>a<td>b</table>",
    ]
    plain = lambda x: " ".join(re.sub(r"</?(?:h2|p|section|tr|td|table|figure|figcaption)[^>]*>", " ", re.sub(r"</?m[^>]*>", "", x)).split())
    for part in kept:
        assert main_text("<body>" + NOISE["nav"] + ARTICLE.replace("<p>End.", part + "<p>End.") + NOISE["footer"]) == TEXT.replace("End.", plain(part) + " End."), part
    assert main_text(ARTICLE.replace("<h1>Title &amp; more</h1>", "<header><h1>Title &amp; more</h1><nav><a href=x>Up</a></nav></header>")) == TEXT
    assert main_text("<form><div><input>" + ARTICLE + "</div></form>") == TEXT


def test_menus_and_copyright_lines_without_names():
    links = "<div><ul>" + "".join(f"<li><a href='/{n}'>Section {n}</a></li>" for n in range(8)) + "</ul></div>"
    body = ARTICLE.replace("article>", "div>")
    assert main_text(f"<body>{links}{body}{links}<div>© 2024 Somebody</div>") == TEXT
    assert main_text(f"<body><article>{ARTICLE[9:-10]}{links}<p>All rights reserved.</p></article>") == TEXT + " All rights reserved."


def test_ratios_decide(monkeypatch):
    """Another threshold, or ratios that say nothing, give other text."""
    links = "<div>" + "".join(f"<p><a href='/{n}'>Short {n}</a></p>" for n in range(6)) + "</div>"
    page = f"<body>{links}<div>" + "<p>A long paragraph of plain words that goes on for quite a while here.</p>" * 4 + f"</div>{links}"
    before = main_text(page)
    assert before == " ".join(["A long paragraph of plain words that goes on for quite a while here."] * 4)
    monkeypatch.setattr(html_text, "smoothed", lambda ratios: [1.0] * len(ratios))
    assert main_text(page) != before


def test_deep_unclosed_markup_is_linear():
    began = time.process_time()
    assert main_text("<div>word " * 100_000).count("word") == 100_000
    assert main_text("<span>" * 50_000 + "<li>x</b>" * 50_000).count("x") == 50_000
    assert time.process_time() - began < 20
