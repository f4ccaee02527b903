"""Main text of pages: the given pages against their article elements, and pages made by hand."""

import html
import re

import pytest

from tests.llm.conftest import SF
from tidewell.llm import html_text


@pytest.fixture(scope="module")
def weights(spark):
    return html_text.learn(spark.read.parquet(f"{SF}/pages.parquet"))


def test_given_pages(spark, weights):
    assert all((v > 0) == k.startswith("w ") for k, v in weights.items())
    rows = html_text.extract(spark.read.parquet(f"{SF}/pages.parquet"), weights).collect()
    assert rows
    for r in rows:
        article = re.search(r"<article>(.*?)</article>", r["html"], flags=re.DOTALL)[1]
        blocks = (" ".join(html.unescape(b).split()) for b in re.split(r"</?(?:h1|p|br)>", re.sub("</?b>", "", article)))
        want = "\n".join(b for b in blocks if b)
        assert r["text"] == want and r["n_chars"] == len(want)


def test_unlabelled_pages(spark, weights):
    # The same pages without the elements that mark the article: the words and tags left find it.
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        marked = html_text.main_text(r["html"], weights)
        assert html_text.main_text(re.sub("</?article>", "", r["html"]), weights) == marked


HAND = [
    (None, ""), ("", ""), ("just  words\n here", "just words here"),
    ("<nav><ul><li><a href=/>Home</a></ul></nav>", ""),
    ("<body><header><h1>Site</h1></header><article><header><h1>Title</h1></header><p>One &lt;b&gt; &eacute;&nbsp;two<p>three <b>bold</b>ly<br>on</article><section class='comments'><article><p>first! nice words from a reader here</article></section>", "Title\nOne <b> é two\nthree boldly on"),
    ("<article><p>Before words.</p><aside>also read this and that</aside><div class='ad-box'>Buy now, buy cheap, buy more</div><form>Your mail <input name=m> please</form><script>if (a < b) '</p>'</script><p>After words.</p></article>", "Before words.\nAfter words."),
    ("<main class='with-sidebar'><h2>List</h2><ul><li>one item</li><li>two items</ul><table><tr><td>a</td><td>b</table><p>Last words.</p></main><div id=sidebar>Links and links</div>", "List\none item\ntwo items\na\nb\nLast words."),
    ("<div class='page with-sidebar'><article><p>Kept in a frame with a telling name.</article></div>", "Kept in a frame with a telling name."),
    ("<article><p title='a > b'>quoted</p><!-- <p>not this</p> --><p hidden>nor this</p><p style='display: none'>or this</p><p>5 < 6 &amp;&amp; 7 > 6</p>", "quoted\n5 < 6 && 7 > 6"),
    ("<div role='alert' class='cookie-notice'>We use cookies on this site, do you agree to that?</div><p>Text without an article around it, long enough.</p><footer><p>Copyright of many words and names, all rights reserved</footer>", "Text without an article around it, long enough."),
]


@pytest.mark.parametrize(("page", "want"), HAND)
def test_by_hand(page, want, weights):
    assert html_text.main_text(page or "", weights) == want


def best_region(scores):
    return max([0.0, *(sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1))])


def test_scan_finds_the_best_region(weights):
    # Without other purposes and with words told apart, the region's score is the maximum over all contiguous regions.
    page = "<div><p>a b c</p><hr><hr><hr><p>d e f g</p><ul><li>h</li><li>i</li></ul></div><hr><p>j</p>"
    plain = {"w p": 1.0, "w li": 0.5, "t hr": -2.0, "t /hr": -2.0}
    found = list(html_text.pieces(page))
    scores = [html_text.score(kind, text, plain) for kind, text, _, _ in found]
    words = html_text.main_text(page, plain).split()
    chosen = [i for i, (_, text, _, _) in enumerate(found) if text and set(text.split()) & set(words)]
    assert abs(sum(scores[chosen[0] : chosen[-1] + 1]) - best_region(scores)) < 1e-9


def test_columns_and_repeats(spark, weights):
    df = spark.createDataFrame([(1, "<p>x y</p>", "clash", 9), (1, "<p>x y</p>", "clash", 9), (None, None, None, None)], "page_id long, html string, text string, n_chars int")
    out = html_text.extract(df, weights)
    assert sorted(out.columns) == ["html", "n_chars", "page_id", "text"]
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in out.collect()) == [(0, "", 0), (1, "x y", 3), (1, "x y", 3)]
    assert html_text.extract(df.where("false"), {}).count() == 0 and html_text.learn(df.where("false")) == {}


def test_long_page(spark):
    page = "<article>" + "<p>some words &amp; more</p>" * 40000 + "</article>"
    assert html_text.main_text(page, {}).count("\n") == 39999
