import pytest

from tabscope.llm import html_extract
from tabscope.llm.common import read_table
from tests.llm.brute import article

MARKUP = [
    ("<article><h1>A &amp; B</h1><p>One<b>two</b> three\n four<br>five</p></article>", "A & B Onetwo three four five"),
    ("<nav><p>menu</p></nav><main><p>x</p></main><footer>f</footer>", "x"),
    ("<header><h1>Site</h1></header><article><header><h1>T</h1><p>by me</p></header><p>text</p></article>", "T text"),
    ("<article><p>a</p><div class='ad box'><p>buy</p><div>more</div></div><p>b</p><aside>s</aside><form>f<input></form></article>", "a b"),
    ("<article>a<section id=comments><article class=comment><p>nice</p></article></section></article>", "a"),
    ("<article><p class=notice>n<p>a</article>", "a"),
    ('<article><script>var t="</p><p>no";</script><style>p{}</style><!-- <p>no</p> --><p>&lt;tag&gt; &#65;&#x42; &eacute;</p></article>', "<tag> AB é"),
    ("<article><ul><li>one<li>two</ul><table><tr><td>a<td>b</table></article>", "one two a b"),
    ("<article><p>cut <b of", "cut"),
    ("<article><p title='a > b'>x</p><p>1 < 2</p></article>", "x 1 < 2"),
    ("<div><p>no mark</p><div role=navigation>menu</div><p hidden>h</p></div>", "no mark"),
    ("", ""),
    (None, ""),
    ("<div class=ad>unclosed<article><p>kept</p></article>", "kept"),
    ("<nav>menu</nav><div class='content with-sidebar'><p>all the text of it</p></div><p>end</p>", "all the text of it end"),
    ("<form><h1>T</h1><p>a page in one form</p></form><footer>f</footer>", "T a page in one form"),
    ("<main class='with-sidebar'><p>long main text</p></main>", "long main text"),
    ("<p>a text of some words</p><form>your name</form><div class=share>tell others</div>", "a text of some words"),
    ("<main><div>Home About Contact Terms</div><article><p>the one text of this page</p></article></main>", "the one text of this page"),
    ("<main><p>a list of many things</p><article>first</article><article>second</article></main>", "a list of many things first second"),
    ("<div class='page with-sidebar'><div class=sidebar><p>and much more in here</p></div><p>the one text of it</p></div>", "the one text of it"),
    ("<div>" + "word " * 12 + "</div><div class=comments>" + "nice " * 99 + "</div>", "word " * 11 + "word"),
    ("<div hidden>x</div><p style='display: none'>y</p>", ""),
    ("<div hidden><article>x</article></div><article aria-hidden=true>y</article>", "x"),
]


def test_markup(spark):
    pages = spark.createDataFrame([(i, f"http://h{i}.org/", p, "x") for i, (p, _) in enumerate(MARKUP)] + [(None, None, None, None)], "page_id bigint, url string, html string, text string")
    got = {r.page_id: (r.text, r.n_chars) for r in html_extract.main_texts(pages).collect()}
    assert got == {**{i: (t, len(t)) for i, (_, t) in enumerate(MARKUP)}, None: ("", 0)}
    assert html_extract.main_texts(pages.limit(0)).count() == 0


def test_boilerplate_of_a_host(spark):
    """Pages that mark no article: what other pages of the host hold as well goes, whatever is alone stays."""
    frame = "<div>" + " ".join(f"line{i}" for i in range(14)) + "</div>"
    own = ["<div>" + " ".join(f"own{n}word{i}" for i in range(20)) + "</div>" for n in range(4)]
    rows = [(n, "http://a.org/x", frame + own[n]) for n in range(3)] + [(3, "http://b.org/x", frame + own[3])]
    rows += [(4, "http://a.org/copy", rows[0][2])]  # a copy of a page is no other page
    got = {r.page_id: r.text for r in html_extract.main_texts(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    text = [o[5:-6] for o in own]
    assert got == {0: text[0], 1: text[1], 2: text[2], 3: frame[5:-6] + " " + text[3], 4: text[0]}


def test_boilerplate_inside_marked_articles(spark):
    """A line that ends many different articles goes, though markup does not tell it; paragraphs that articles share stay."""
    share = "<div>" + " ".join(f"share{i}" for i in range(19)) + "</div>"
    own = ["".join("<p>" + " ".join(f"own{n}p{k}w{i}" for i in range(20)) + "</p>" for k in range(3)) for n in range(6)]
    common = "<p>" + " ".join(f"common{i}" for i in range(25)) + "</p>"
    pages = [f"<article>{common if n == 1 else ''}{o}{common if n > 3 else ''}{share}</article>" for n, o in enumerate(own)]
    rows = [(n, "http://a.org/x", p) for n, p in enumerate(pages)]
    licence = share.replace("div", "p")  # a paragraph at the end of them all stays: articles share such ones
    rows += [(20 + n, "http://c.org/x", f"<article>{o}{licence}</article>") for n, o in enumerate(own)]
    # copies of one article with other menus: its last paragraph repeats, but always after the same text
    rows += [(10 + n, "http://b.org/x", f"<nav>menu{n}</nav><article>{own[0]}{share}</article>") for n in range(6)]
    got = {r.page_id: r.text for r in html_extract.main_texts(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    def text(page):
        return " ".join(html_extract._MARKUP.sub(" ", page).split())

    want = {n: text(p.replace(share, "")) for n, p in enumerate(pages)} | {10 + n: text(own[0] + share) for n in range(6)}
    want |= {20 + n: text(o + licence) for n, o in enumerate(own)}
    assert got == want


def test_every_page_of_the_table(spark, sf):
    pages = read_table(spark, sf, "pages")
    want = {r.page_id: article(r.html) for r in pages.collect()}
    got = {r.page_id: r.text for r in html_extract.main_texts(pages).collect()}
    assert got == want


@pytest.mark.parametrize("page", ["<" * 2000, "<p " * 500, '<a title="' * 300, "&" * 1000, "<!--" * 100, "</" * 100])
def test_broken_markup_ends(page):
    html_extract.blocks(page)
