import html
import re
import time

from vacantia.llm.html_extract import extract, report

LAYOUT = """<!DOCTYPE html><html><head><title>T</title></head><body class="has-sidebar"><header><h1>Site</h1></header>
<nav><a href=x>Home</a></nav><div class="cookie-notice">We use cookies</div><div id="content"><h1>The title</h1>
<div class="post-body"><p>First, para &amp; more&nbsp;text, with <a href=q>link</a> in it.<p>Second para.<br>line two</p>
<div class="ad">Buy</div><ul><li>one item</li><li>two item</li></ul></div><div class="related"><a>rel</a></div></div>
<aside>side text, long, long</aside><section id="comments"><p>Reader, one, two, three comment which is very long, and has, many, commas, to win</p></section>
<form><p>form text</p></form><footer>foot</footer><script>var a="<p>x</p>"</script></body></html>"""


def test_layouts():
    assert extract(LAYOUT) == "The title\n\nFirst, para & more text, with link in it.\n\nSecond para. line two\n\none item\n\ntwo item"
    assert extract("<body><div><p>One.</p><p>Two.</p></div><div class='comments'><p>c</p></div></body>") == "One.\n\nTwo."
    assert extract("<article class='comment'>no</article><article><header><h1>A</h1></header>b<ul><li><a>x</a></li></ul></article>") == "A\n\nb\n\nx"
    assert extract("<main><div class='story'><h2>Head</h2><p>Body text.</p></div><div class='share'>x</div></main>") == "Head\n\nBody text."


def test_article_text_is_kept():
    assert extract("<div class='commentary'><p>A long text, with commas, of the article.</p></div><div>one</div>").startswith("A long text")
    parts = "<ul class='meta'><li><a>source</a></li></ul><div class='replying'>r</div><p class='modality'>m</p><p class='alerts'>a</p><p>x <math><mi>y</mi></math></p>"
    assert extract(f"<article><p>Text.</p>{parts}<div class='comments'>c</div><footer>f</footer></article>") == "Text.\n\nsource\n\nr\n\nm\n\na\n\nx y"
    two = "<article><p>First, part, of the text.</p></article>"
    assert extract(f"<nav>n</nav>{two}{two}<p>after</p>") == "First, part, of the text.\n\nFirst, part, of the text."
    assert extract("<article><p>Out.</p><article><p>In, a, nested, one, that, wins.</p></article></article>") == "Out.\n\nIn, a, nested, one, that, wins."
    assert extract("<table><tr><td>a<td>b<tr><td>c</table><p>d, e, f") == "a b\n\nc\n\nd, e, f"
    assert extract("<dl><dt>a<dd>b<dt>c<dd>d</dl>") == "a\n\nb\n\nc\n\nd"


def test_names_leave_no_article_out():
    said = "A text, of the article, with commas."
    assert extract(f'<article class="notice-board"><p>{said}</p></article>') == said
    assert extract(f'<div class="restaurant-menu-article"><article><p>{said}</p></article></div>') == said
    assert extract(f'<article><p>{said}</p><div class="survey-responses"><p>Many said yes.</p></div></article>') == f"{said}\n\nMany said yes."
    assert extract(f'<article><p>One.</p><svg viewBox="0 0 1 1" /><p>{said}</p><svg><path d="x"/><text>no</text></svg><p>Two.</p></article>') == f"One.\n\n{said}\n\nTwo."
    assert extract(f"<article><template><p>no</p><template>no</template></template><p>{said}</p></article>") == said
    for name in ("menu", "notice", "banner", "sidebar", "alert", "promo-box"):
        # the only article is not left out for its name or its wrapper's
        assert extract(f'<div class="{name}"><article><p>{said}</p></article></div><footer>f</footer>') == said
        assert extract(f'<article class="{name}"><p>{said}</p></article>') == said
        assert extract(f'<div class="{name}"><p>{said}</p></div>') == said
        # but a part beside the article is
        assert extract(f'<article><p>{said}</p></article><div class="{name}"><p>no, no, no</p></div>') == said
    for name in ("menu-item-history", "noticeable", "bannerman", "user-commentary", "adventure", "admissions", "menus-of-the-world", "comment-free-zone", "has-sidebar", "responses-2024-survey"):
        assert extract(f'<article><p>{said}</p><div class="{name}"><p>Kept.</p></div></article>') == f"{said}\n\nKept.", name
    for name in ("cookie-notice", "ad-slot", "adSlot", "site-banner", "comments-area", "comment-list", "top-menu", "advert_box", "alert alert-info", "google-ads"):
        assert extract(f'<article><p>{said}</p><div class="{name}"><p>Gone.</p></div></article>') == said, name
    assert extract('<section id="comments"><article><p>c</p></article></section>') == ""


def test_nesting_takes_linear_time():
    began = time.time()
    for tag in ("div", "b", "article", "p"):
        assert extract(f"<{tag}>" * 100_000 + "deep text" + f"</{tag}>" * 100_000) == "deep text"
        assert extract(f"<{tag}>x" * 30_000 + "<p>y</i></li>" * 30_000).count("y") == 30_000
    assert time.time() - began < 60


def test_edges_of_input(spark):
    assert [extract(x) for x in (None, "", "<nav>n</nav>", "<p>x<", "plain", "<p>cut <b")] == ["", "", "", "x<", "plain", "cut"]
    deep = "<div>" * 3_000 + "deep text" + "</div>" * 3_000
    assert extract(deep) == "deep text"
    long = "<article>" + "<p>word, word</p>" * 60_000
    assert extract(long).count("\n\n") == 59_999
    rows = [(1, "u", None, "t"), (1, "u", None, "t"), (2, None, "<p>é</p>", "t")]
    got = report(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((r["page_id"], r["text"], r["n_chars"]) for r in got) == [(1, "", 0), (1, "", 0), (2, "é", 1)]
    assert report(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_whole_table_against_the_articles(spark):
    """The pages of the test tables name their article, so its text can be cut out directly."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    wanted = {}
    for r in pages.collect():
        body = re.sub(r"<[^>]*$", "", re.sub(r"<footer>.*", "", r["html"][r["html"].index("<article>") + 9 :].split("</article>")[0], flags=re.S))
        parts = [" ".join(html.unescape(re.sub(r"</?b>|<br>", " ", b)).split()) for b in re.split(r"</?p>|</?h1>", body)]
        wanted[r["page_id"]] = "\n\n".join(p for p in parts if p)
    assert {r["page_id"]: r["text"] for r in report(pages).collect()} == wanted
