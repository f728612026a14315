"""The text of conversion records: all shown text, as the full block reader gives it; and as written by hand."""

from llm.sql import connect

from sparkwalk.llm import html

ODD = [
    "<div class=nav><span hidden>kept in a menu</span> a</div><p><span hidden>gone</span> b</p>",
    "<ul><li>one<li>two <b style='display: none'>x</b> three</ul><p>four<p>five<br>six<hr>seven",
    "<table><tr><td>a<td>b<tr><td>c</table><svg><text>no</text></svg>d<script>e</script>f</p>g</div>",
    "<nav><article><i aria-hidden=true>h <i>i</i> j</i> k</article></nav><head><title>t</title></head>l",
    "<p>m<script/>n</p><textarea><p>o</textarea>p &amp; &#233;<!-- q -->r <a href=x>s</a>", "", "no markup at all", "<", "<p",
]


def blocks(page):
    return "\n".join(b.text for b in html.blocks(page, adverts=True))


def test_equals_the_block_reader():
    pages = [h for (h,) in connect("/root/testdata/sf0.01").sql("select html from pages").fetchall()] + ODD
    assert [html.plain_text(h) for h in pages] == [blocks(h) for h in pages]


def test_by_hand():
    page = "<title>t</title><h1>One  <b>two</b></h1><nav>menu</nav><p>three<script>x</script> four <span hidden>no</span>five<ul><li>six<li>seven</ul>" + "w " * 200_000
    assert html.plain_text(page) == "One two\nmenu\nthree four five\nsix\nseven\n" + " ".join("w" * 200_000)
    assert html.plain_text(None) == html.plain_text("") == ""
