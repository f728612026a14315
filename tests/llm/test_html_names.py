"""Names in a page are read whole: anchors, layout wrappers and looks take no main text away."""

import pytest

from sparkwalk.llm import html

TREE = html.classifier()


@pytest.mark.parametrize(
    "page, want",
    [
        ("<article><h2 id='side-effects'>Side effects</h2><p id='search-history'>Found by search.</p><p class=notice>Mind it.</p></article>", "Side effects\nFound by search.\nMind it."),
        ("<div class='layout has-sidebar'><article><p>one two</p></article></div>", "one two"),
        ("<div class='layout sidebar'><p>menu of it</p><article><p>one two</p><div class='share-buttons'>share</div></article><p>end of it</p></div>", "one two"),
        ("<div class='layout sidebar'><article><p>one</p></article><article><p>two</p><nav><article><p>no</p></article></nav></article></div>", "one\ntwo"),
        ("<div class=sidebar><main><p>one two</p></main></div>", "one two"),
        ("<article class='post category-social'><p>one two</p></article>", "one two"),
        ("<main><section id='related-work'><h2 class='social'>Work</h2><p>one two</p></section></main>", "Work\none two"),
        ("<main><p>one <b class='warning'>two</b> <span class='side'>three</span> <span class='ad'>buy</span></p></main>", "one two three"),
        ("<main><p>one</p></main><div id=comments><article class=comment><p>I agree with all of it</p></article></div>", "one"),
        ("<article><p>one</p><div class='user-comments'><article><p>I agree</p></article></div><div class='relatedPosts'><p>more</p></div></article>", "one"),
        ("<aside><article><p>one two three</p></article></aside><div hidden class=layout><main><p>no</p></main></div>", ""),
        ("<div class='layout sidebar'><nav><article><p>no</p></article></nav><article><p>yes</p></article></div>", "yes"),
    ],
)
def test_main_text(page, want):
    assert html.main_text(page, TREE) == want


def test_plain_text_keeps_lines_whole():
    assert html.plain_text("<p>one <b class='warning'>two</b> <span class='ad'>buy</span> <i hidden>no</i></p>") == "one two buy"
