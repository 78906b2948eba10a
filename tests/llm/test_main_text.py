import html
import re
import time

import pytest

from timberline.llm import main_text as M
from timberline.llm.queries import op13_main_text

SF = "/root/testdata/sf0.01"


def article(page):
    """The article of a test page, by its tags."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S).group(1)
    parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", part)).split()) for part in re.split(r"</?(?:p|h1)>|<br>", inner)]
    return "\n\n".join(p for p in parts if p)


def test_whole_table_against_the_article_elements(spark):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = op13_main_text(spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r["text"] == article(pages[r["page_id"]]["html"]) and r["url"] == pages[r["page_id"]]["url"]
        assert r["n_chars"] == len(r["text"])


#: Held-out layouts: (page, main text).
LAYOUTS = {
    "classes": (
        '<body class="has-sidebar"><div id="top-nav"><a href="/">Home</a> <a href="/a">A</a></div><div class="cookie-notice"><p>We use cookies to make'
        ' this site better for all of you, and there is more to read about them here.</p></div><div id="content"><h1>The title of it</h1><p>Some words of the'
        " text that are long enough for a page, and then some more.</p><p>Short.</p><div class=\"sidebar\"><p>About the author, who writes long"
        " sentences for this page every day of the week.</p></div><p>More words here.</p><ul><li>first point</li><li>second point</li></ul></div>"
        '<div class="comments"><h3>Comments</h3><div class="comment"><p>I liked it very much because it is so long and so well written.</p></div></div>'
        '<form><p>Sign up for our letter with many words to fill.</p><textarea>hi</textarea></form><div id="footer">&copy; 2020 All rights reserved</div>',
        "The title of it|Some words of the text that are long enough for a page, and then some more.|Short.|More words here.|first point|second point"),
    "no names": (
        "<table><tr><td><a href=x>Home</a></td><td><a href=y>News</a></td></tr></table><h1>The old page</h1><p>This page was written long ago and has no"
        " class names at all, so that only its words can tell.<p>It has <i>unclosed</i> paragraphs too, which the reader should see as text of the page &amp;"
        " nothing else.<p>And here is a last one with a <a href=z>link</a> in it that goes on for quite a few words.<hr><a href=m>Mail</a> | <a href=n>Top</a>"
        "<p>&copy; 1998 Someone",
        "The old page|This page was written long ago and has no class names at all, so that only its words can tell.|It has unclosed paragraphs too,"
        " which the reader should see as text of the page & nothing else.|And here is a last one with a link in it that goes on for quite a few words."),
    "article in main": (
        "<header><h1>Site name</h1><nav><a href=a>One</a></nav></header><main><div>Live tonight: watch the show at nine</div><article><header><h1>Headline"
        "</h1><p>By Somebody</p></header><p>First &lt;b&gt; paragraph&nbsp;here.</p><aside>Pull quote</aside><p>Second<br>line.</p><footer>Posted in <a href=t>tag</a>"
        '</footer></article><section class="related"><h2>Related</h2><ul><li><a href=a>Other story</a></li></ul></section></main>'
        '<div class="gdpr">We value your privacy</div><footer>foot</footer>',
        "Headline|By Somebody|First <b> paragraph here.|Second line."),
    "camel case and roles": (
        '<div role="navigation">Menu of this place</div><div role="main"><p>The text is here, in a few words.</p><div class="adBanner">Buy now and save a lot of'
        ' money today only</div><p>It ends here.</p></div><div role="contentinfo">Imprint</div><div style="display: none">unseen words</div>',
        "The text is here, in a few words.|It ends here."),
    "cut off": ("<article><p>One two three<!-- no end <p>four", "One two three"),
    "no tags": ("a < b and c <d e=\"x>y\" f> are all that there is in this text, which has enough words to be one &am", "a < b and c are all that there is in this text,"
                " which has enough words to be one &am"),
    "raw": ("<article><script>var t='</p>';</script><style>p{}</style><p>words &#x41;&quot;</p><noscript>turn it on</noscript><template><p>no</p></template>", 'words A"'),
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_held_out_layouts(name):
    page, want = LAYOUTS[name]
    assert M.main_text(page) == want.replace("|", "\n\n")


def test_tree_fits_its_table_and_a_held_out_half():
    pages = M.LABELLED
    tree = M.trained(pages[::2])
    right = total = 0
    for page in pages[1::2]:
        x = M.features([("", *b[1:]) for b in page])
        right += int((M.decide(tree, x) == [bool(b[0]) for b in page]).sum())
        total += len(page)
    assert right / total > 0.8
    x = [(M.features([("", *b[1:]) for b in page]), page) for page in pages]
    assert sum(int((M.decide(M.trained(), f) == [bool(b[0]) for b in p]).sum()) for f, p in x) / sum(map(len, pages)) > 0.95


@pytest.mark.parametrize("page", ["<p>x" * 50000, "<a b='\">" * 50000, "<" * 200000, "<!--" * 100000, "<script>" * 50000, "<div><b>" * 50000 + "</div>" * 50000,
                                  "<p " + "a" * 500000, "&" * 200000])
def test_hostile_pages_take_linear_time(page):
    begin = time.time()
    M.main_text(page)
    assert time.time() - begin < 10


def test_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, "u", None, "x", 1), (None, None, "", "x", 1), (3, "v", "<article><p>a b</p><p>\U0001f600 c</p></article>", "x", 1),
            (3, "v", "<article><p>a b</p><p>\U0001f600 c</p></article>", "x", 1), (4, "w", "<nav><a href=x>only a menu</a></nav>", "x", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = M.extract(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(
        [(1, "u", "", 0), (None, None, "", 0), (3, "v", "a b\n\n\U0001f600 c", 8), (3, "v", "a b\n\n\U0001f600 c", 8), (4, "w", "", 0)], key=str)
    assert M.extract(pages.limit(0)).collect() == []
