import html
import re

import pytest
from odd import check_shapes

from pricetrail.llm import html_text
from pricetrail.llm.common import table

ARTICLE = "<p>First, a sentence. Then another one, longer than the first.</p><p>Short.</p>"
CASES = [
    (None, ""),
    ("", ""),
    ("<html><body></body></html>", ""),
    ("plain &amp; simple", "plain & simple"),
    ("<p>a<p>b\n\t c &lt;d&gt;<br>e", "a\nb c <d> e"),
    (f"<nav>Menu, menu.</nav><article><h1>T</h1>{ARTICLE}</article><footer>Foot, note.</footer>",
     "T\nFirst, a sentence. Then another one, longer than the first.\nShort."),
    (f"<div class='side sidebar'>Far, far, far more text than there is in the whole of the article, "
     f"again and again.</div><div id='story'>{ARTICLE}</div>"
     "<section class=comments><p>Nice, nice, nice, really nice.</p></section>",
     "First, a sentence. Then another one, longer than the first.\nShort."),
    ("<header><h1>Site</h1></header><main><header><h1>Title</h1></header><p>x</main>", "Title\nx"),
    ("<article><p>a<script>if (a<b) '</p>'</script>b<style>p{}</style><!-- <p>no --></p>"
     "<form><p>Name, please.</p><input></form><aside>Aside, aside.</aside><p>c</article>", "ab\nc"),
    ("<article><ul><li>one<li>two</ul><table><tr><td>x<td>y</table></article>", "one\ntwo\nx\ny"),
    ("<p class='a>unclosed <b>x</p>tail <3 <", "unclosed x\ntail <3 <"),
    ("<article><p>cut off <di", "cut off"),
    ("<article><p>no end <!-- of comment", "no end"),
    ("<article><P><B>Bold<P>next&nbsp;&eacute;&#233;&#x1F600; &am", None),
]


TEXT = "First, a sentence. Then another one, longer than the first.\nShort."
WRAPPED = [
    (f"<body class='has-sidebar'><article class='post no-comments'>{ARTICLE}</article></body>", TEXT),
    (f"<body class='sidebar'><div class=sidebar>Side.</div><main class=menu>{ARTICLE}</main></body>", TEXT),
    (f"<div id='page-with-navigation'>{ARTICLE}</div>", TEXT),
    (f"<div class='navigation'><nav>Menu, menu, menu.</nav><article>{ARTICLE}</article></div>", TEXT),
    (f"<form><div class=menu>Menu.</div><article>{ARTICLE}</article></form><footer>Foot.</footer>", TEXT),
    (f"<div class='notice'>{ARTICLE}</div><p class=notice>Note.</p>", TEXT),
    (f"<article>{ARTICLE}</article><div class=comments>" + "<article><p>Nice, nice.</p></article>" * 50
     + "</div>", TEXT),
    ("<article><p class=byline>By A.</p><p class='related teaser'>See b.</p><p>x<math>2</math></article>",
     "By A.\nSee b.\nx2"),
    (f"<html><head><title>T</title><script>'<p>no</p>'</script><body><article>{ARTICLE}</article>", TEXT),
    (f"<head><meta charset=utf-8><style>p{{}}</style><title>T</title><div>{ARTICLE}</div>", TEXT),
    ("<nav class=menu>Menu.</nav><div class=sidebar>Side.</div><footer>Foot, and far more of it.</footer>",
     ""),
]


@pytest.mark.parametrize("page,text", WRAPPED)
def test_wrappers_and_open_heads(page, text):
    assert html_text.main_text(page) == text


@pytest.mark.parametrize("page,text", CASES)
def test_cases(page, text):
    if text is None:
        text = "Bold\nnext éé\U0001f600 &am"
    assert html_text.main_text(page) == text


def test_table_frame(spark):
    big = "<article>" + "<p>word, word.</p>" * 30000 + "</article>"
    rows = [(k, f"u{k}", page) for k, (page, _) in enumerate(CASES)]
    rows += [(None, None, big), (1, "u1", CASES[5][0]), (1, "u1", CASES[5][0])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = check_shapes(df, html_text.extract)
    texts = [html_text.main_text(page) for *_, page in rows]
    want = [(len(t), key, t, url) for (key, url, _), t in zip(rows, texts)]
    assert got == sorted(want, key=repr)


def test_pages_table(spark):
    """The supplied pages hold their text in one article of headings and paragraphs."""
    pages = table(spark, "/root/testdata/sf0.001", "pages").collect()
    for row in pages:
        inner = re.search(r"<article>(.*?)</article>", row.html, re.S)[1]
        parts = (html.unescape(re.sub(r"<[^>]*>", " ", x)) for x in re.split(r"</?(?:p|h1)>", inner))
        want = "\n".join(filter(None, (" ".join(p.split()) for p in parts)))
        assert html_text.main_text(row.html) == want


def test_scores_prefer_long_punctuated_paths():
    found = [html_text.Block(("body", "div.list"), "Home")] * 9
    found += [html_text.Block(("body", "div", "p"), "A sentence, with marks, and length.")] * 5
    scores = html_text.path_scores(found)
    assert max(scores, key=scores.get) == ("body", "div", "p")
    assert html_text.container(scores) == ("body", "div")
