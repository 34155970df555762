import html
import re

import pytest

from conftest import SMALL
from tidemark.llm import maintext

FRAME = "<html><head><title>t</title></head><body><nav><ul><li><a href=x>home</a></ul></nav>{}<footer>made by us in the year</footer></body></html>"


def article(page):
    inside = page[page.index("<article>") + 9 : page.index("</article>")]
    blocks = (re.sub("</?b>", "", b.replace("<br>", " ")) for b in re.split("</?(?:p|h1)>", inside))
    return "\n".join(b for b in (" ".join(html.unescape(b).split()) for b in blocks) if b)


def test_given_pages(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    want = {r.page_id: article(r.html) for r in pages.collect()}
    assert {r.page_id: r.text for r in maintext.extract(pages).collect()} == want


@pytest.mark.parametrize(
    "body, text",
    [
        ("<div class='content'><p>One two three four.<p>Five &lt;six&gt; &amp seven</div>", "One two three four.\nFive <six> & seven"),
        ("<article><h1>Head</h1><p>one two<aside>not this one</aside><p>three<div class=ad>buy buy buy</div></article>", "Head\none two\nthree"),
        ("<article><p>a b c<section id='comments'><p>first! so many many words in a comment here</section></article>", "a b c"),
        ("<article><p>a <i>b</i>c<br>d\n e&nbsp;f<script>x='</p>'</script><!-- no --> g</article>", "a bc d e f g"),
        ("<article><ul><li>x<li>y</ul><table><tr><td>1<td>2</table></article>", "x\ny\n1\n2"),
        ("<div class='cookie-notice'>" + "we use cookies " * 30 + "</div><main>short text</main>", "short text"),
        ("<article><form><label>name</label><input></form><p>said</article>", "said"),
        ("<article><p>price < 3 and a > b</article>", "price < 3 and a > b"),
        ("", ""),
    ],
)
def test_markup(body, text):
    assert maintext.main_text(FRAME.format(body), maintext.Scores()) == text


@pytest.mark.parametrize(
    "body, text",
    [
        ("<p>one <svg width=1 /> two<p>three", "one two\nthree"),
        ("<p>one <math/> two<p>three", "one two\nthree"),
        ("<p>one<object data=x><p>two<p>three", "one\ntwo\nthree"),
        ("<p>one<video src=x><p>two<p>three", "one\ntwo\nthree"),
        ("<p>one<canvas><p>two<p>three", "one\ntwo\nthree"),
        ("<p>one<select><option>two<p>three", "one\ntwo\nthree"),
        ("<p>one<object>no <object>not</object> never</object> two", "one two"),
        ("<p>one <svg><g><text>no</text></g></svg>two <video>no</video><select><option>no<option>no</select>three", "one two three"),
        ("<p>as <math><mi>E</mi><mo>=</mo><mi>m</mi></math> says", "as E=m says"),
    ],
)
def test_elements_that_are_no_raw_text(body, text):
    assert maintext.main_text(FRAME.format(f"<article>{body}</article>"), maintext.Scores()) == text


ARTICLE = "<article><h1>Head</h1><p>one two three four</article>"


@pytest.mark.parametrize(
    "body",
    [
        f"<div class='layout with-sidebar'>{ARTICLE}</div>",
        f"<div class='content overflow-hidden no-comments'>{ARTICLE}</div>",
        f"<div class='sidebar-layout'>{ARTICLE}<div class='sidebar'>buy this and that</div></div>",
        f"<main id='search-results'>{ARTICLE}</main>",
        f"<main class='related'><div class='widget'>{ARTICLE}</div></main>",
        ARTICLE.replace("<article>", "<article class='promo has-ads' title='a hidden gem'>"),
        f"{ARTICLE}<section class='comments'><article class='comment'>first said so</article></section>",
        "<div class='page header-fixed'><h1>Head</h1><p>one two three four</div>",
    ],
)
def test_names_of_what_holds_the_article_are_no_sign(body):
    for page in (FRAME, FRAME.replace("<body>", "<body class='no-sidebar search menu'>").replace("<html>", "<html class='hidden cookie'>")):
        assert maintext.main_text(page.format(body), maintext.Scores()) == "Head\none two three four"
        labels = [t.label for t in maintext.Page(page.format(body)).items if t.text == "Head"]
        assert labels == ["article" in body]


def test_deep_and_broken_pages():
    deep = "<article>" + "<div>" * 5000 + "<p>deep text" + "<p>more" * 5000
    assert maintext.main_text(deep, maintext.Scores()).count("\n") == 5000
    assert maintext.main_text("<article><p>a<a href='x>b", maintext.Scores()).startswith("a")
    assert maintext.main_text("<script>never closed <p>words", maintext.Scores()) == ""


def test_best_range():
    assert maintext.best_range([]) == maintext.best_range([-1.0, 0.0]) == (0, 0)
    assert maintext.best_range([1.0, -2.0, 3.0, -1.0, 2.0, -5.0, 4.0]) == (2, 5)


def test_odd_rows(spark):
    rows = [(1, "u", None, 3), (2, None, "", 3), (None, "u", "<p>some text", 3), (4, "u", "<p>some text", 3), (4, "u", "<p>some text", 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    found = sorted(((r.page_id, r.text) for r in maintext.extract(pages).collect()), key=repr)
    assert found == [(1, ""), (2, ""), (4, "some text"), (4, "some text"), (None, "some text")]
    assert maintext.extract(pages.limit(0)).count() == 0


def test_weights_come_from_labelled_pages(spark):
    page = FRAME.format("<div class='teaser'>look look look</div><article><p>words of the article</article>")
    pages = spark.createDataFrame([(i, "u", page + " " * i) for i in range(5)], "page_id long, url string, html string")
    learnt = maintext.weights(pages)
    assert learnt["word in div.teaser"] < 0 < learnt["word in article"]
    assert maintext.main_text(page.replace("article", "section"), maintext.Scores(learnt)) == "words of the section"


@pytest.mark.parametrize("name", ["alert-levels", "menu-item", "related-work", "hidden-gem", "social-history", "form-of-verbs"])
def test_names_with_other_words_cut_nothing(name):
    body = f"<article><h1>Head</h1><p>one two</p><div class='{name}'><p>three four</p></div><p id={name}>five</p></article>"
    assert maintext.main_text(FRAME.format(body), maintext.Scores()) == "Head\none two\nthree four\nfive"


def test_suspects_are_cut_by_their_learnt_score():
    body = "<article><h1>Head</h1><p>one two three four five six</p><div class='related-posts'>see this</div><p>seven</p></article>"
    learnt = maintext.Scores({"word in div.related-posts": -2.0})
    assert maintext.main_text(FRAME.format(body), learnt) == "Head\none two three four five six\nseven"


def test_wide_pages_take_linear_time():
    import time

    began = time.time()
    n = 100_000
    for page in ("<b>" * n + "</q>" * n, "<u><div>" + "<i>" * n + "</u>" * n, "<div>" + "<i>" * n + "<h2>x</h2>" * n, "<a " * n, '<a title="' * (n + 1), "<!x" * n):
        maintext.main_text(FRAME.format("<article><p>one two</p></article>") + page, maintext.Scores())
    assert time.time() - began < 60


def test_unclosed_tags_swallow_the_rest():
    assert maintext.main_text("<article><p>one two three</p></article><a href=x four", maintext.Scores()) == "one two three"


def plain_range(scores):
    """The best contiguous range by definition: the largest sum, then the first start and the first end."""
    best, place = 0.0, (0, 0)
    for i in range(len(scores)):
        total = 0.0
        for j in range(i, len(scores)):
            total += scores[j]
            if total > best:
                best, place = total, (i, j + 1)
    return best, place


def test_best_range_is_that_of_the_definition():
    import random

    rng = random.Random(4)
    for _ in range(400):
        scores = [float(rng.randint(-4, 4)) for _ in range(rng.randint(0, 30))]
        best, _ = plain_range(scores)
        start, end = maintext.best_range(scores)
        assert sum(scores[start:end]) == best and (best > 0 or (start, end) == (0, 0))
