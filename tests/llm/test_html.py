"""Main text: the generated pages by their markup, and pages of other make by hand."""

import html as entities
import re

import pytest
from llm.sql import connect

from sparkwalk.llm import html, queries

FOLDER = "/root/testdata/sf0.01"


def expected(page):
    """The pages of the test data hold their text in one article of h1 and p elements."""
    parts = re.split(r"</?(?:p|h1)>", re.search(r"<article>(.*?)</article>", page, re.S)[1])
    told = [" ".join(entities.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in parts]
    return "\n".join(t for t in told if t)


def test_query_equals_markup(spark):
    want = [(k, u, expected(h), len(expected(h))) for k, u, h in connect(FOLDER).sql("select page_id, url, html from pages").fetchall()]
    got = queries.op4_html(spark, FOLDER)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_held_out_blocks():
    """Trained without one labelled page, the tree still tells its blocks, nearly always."""
    lines, right, total = html.LABELLED.strip().splitlines(), 0, 0
    pages = []
    for line in lines:
        told = [b.split() for b in line.split("/")]
        page = [html.Block("", int(w), int(a), {"m": 1, "b": -1, "o": 0}[c]) for c, w, a, _ in told]
        pages.append(list(zip(html.features(page), [y == "y" for *_, y in told])))
    for i, held in enumerate(pages):
        tree = html.grow([r for j, p in enumerate(pages) if j != i for r in p])
        right += sum(html.is_main(x, tree) == y for x, y in held)
        total += len(held)
    assert right / total > 0.9


@pytest.mark.parametrize(
    "page, want",
    [
        (None, ""), ("", ""), ("just text of a page", "just text of a page"),
        ("<main><h2>T</h2><p>a&nbsp;b &amp;&#233;<br>c <b>d</b>e</p><aside>no</aside><p>last</main><footer>f</footer>", "T\na b &é c de\nlast"),
        ("<body class='page content'><div class='entry-content'><p>One two three.<div class=AdBox>buy</div><p>Four<form><p>x<input></form></div><div id=comments><p>well said my friend of old, I do agree with all of it</div>", "One two three.\nFour"),
        ("<article><script>var a='</p><p>x';</script><style>p{}</style><p>kept<!-- <p>no</p> --> on<noscript>no</noscript></p></article>", "kept on"),
        ("<article><p>text <span class='ad'>buy</span>goes on</p><section class='user-comments'><p>mine</p></section><p>end</p>", "text goes on\nend"),
        ("<article><p>" + "long " * 50_000 + "</p></article>", ("long " * 50_000).strip()),
        ("<div class='site-header'>My site</div><div id=main><div class='post-header'><h1>T</h1></div><p class='text-muted'>By me</p></div><div role=dialog>sign up now</div>", "T\nBy me"),
        ("<article></div></p><p>a</span><p>b", "a\nb"),
    ],
)
def test_pages_by_hand(page, want):
    assert html.main_text(page, html.classifier()) == want


def test_odd_rows(spark):
    pages = spark.createDataFrame([(None, None, None, 1), (1, "u", "<article>x</article>", 2), (1, "u", "<article>x</article>", 2)], "page_id long, url string, html string, text int")
    assert sorted(map(repr, map(tuple, html.extract(pages).collect()))) == sorted(map(repr, [(None, None, ""), (1, "u", "x"), (1, "u", "x")]))
    assert html.extract(pages.limit(0)).count() == 0


def test_context_decides():
    """A block that its page marks as main or as boilerplate is taken at its word, whatever stands around it."""
    import itertools

    tree, near = html.classifier(), list(itertools.product((0, 1, 4, 30, 200), (0.0, 0.2, 0.7, 1.0)))
    for context in (1, -1):
        for own, before, after in itertools.product(near[4:], near, near):
            assert html.is_main((context, *own, *before, *after), tree) == (context == 1)
