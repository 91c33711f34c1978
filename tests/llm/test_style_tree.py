import html as references
import re

import pytest

from netsight.llm import style_tree


def texts(page):
    blocks, _ = style_tree.parse(page)
    inside = [t for _, t, i in blocks if i]
    return inside or [t for _, t, _ in blocks]


@pytest.mark.parametrize(
    "page,expected",
    [
        ("", []),
        ("plain  text\n here", ["plain text here"]),
        ("<p>a<p>b<br>c<p>", ["a", "b c"]),
        ("<article><h1>T</h1><p><b>x<p>y</article>z", ["T", "x", "y"]),
        ("<nav><p>menu</p></nav><p>a</p><footer>f</footer>", ["a"]),
        ("<div class='ad top'>buy</div><div class=head-line>a</div><aside>s</aside>", ["a"]),
        ("<div id=comments><article><p>me too</p></article></div><article><p>a</p><footer>by</footer></article>", ["a"]),
        ("<article><header><h1>T</h1></header><p>a</p></article><header>site</header>", ["T", "a"]),
        ("<script>var t='</p>';<p>no</script><style>p{}</style><p>a &amp; b &#233;&nbsp;c&copy;</p>", ["a & b é c©"]),
        ("<p>1 < 2 and 3 > 2 <3</p>", ["1 < 2 and 3 > 2 <3"]),
        ("<p>cut &am", ["cut &am"]),
        ("<p>cut <a href='x", ["cut <a href='x"]),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", ["a", "b", "c", "d"]),
        ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]),
        ("<!-- <p>no</p> --><p>a<!-- x -->b</p><!-- open", ["ab"]),
        ("<p hidden>no</p><p style='display: none'>no</p><p aria-hidden=true>no</p><p>a</p>", ["a"]),
        ("<main><p>a</p><form><p>no</p><button>b</button></form><p role=alert>no</p></main><p>out</p>", ["a"]),
        ("<body class='has-sidebar'><p>a</p></body>", ["a"]),
        ("<P>A</P></div></p><DIV>b</DIV>", ["A", "b"]),
        ("<title>t</title><textarea>no</textarea><p>a</p><script>never closed <p>no</p>", ["a"]),
        ("<pre>x\n  y</pre>", ["x y"]),
    ],
)
def test_blocks(page, expected):
    assert texts(page) == expected


@pytest.mark.parametrize(
    "page,expected",
    [
        ("<main class='content with-sidebar'><p>a</p></main><p>out</p>", ["a"]),
        ("<div id='page' class='has-footer'><p>a</p></div>", ["a"]),
        ("<article class='post comments-open'><p>a</p></article>", ["a"]),
        ("<html class='no-search'><body class='search'><p>a</p></body></html>", ["a"]),
        ("<html class=search><p>a</p></html>", ["a"]),
        ("<article class=sponsored><p>a</p><article class=comment><p>no</p></article></article>", ["a"]),
        ("<div class=widget><main><p>long text</p></main></div><p>b</p>", ["long text", "b"]),
        ("<div><p>body</p></div><div id=comments><article><p>a longer comment</p></article></div>", ["body"]),
        ("<div class=sidebar><article><p>t</p></article></div><div><p>the body</p></div>", ["the body"]),
        ("<div class='top-nav ad-1'><p>no</p></div><div class='comment-form'><p>no</p></div><p>a</p>", ["a"]),
        ("<div class='main-menu'><p>no</p></div><div class=site-header><p>no</p></div><p>a</p>", ["a"]),
        ("<article><p>let <math><mi>x</mi></math> be <object data=f>a figure</object></p></article>", ["let x be a figure"]),
    ],
)
def test_one_word_of_a_class_drops_no_article(page, expected):
    assert texts(page) == expected


def test_deep_and_long_pages():
    assert texts("<div>" * 3000 + "a" + "</div>" * 3000) == ["a"]
    assert texts("<p>" + "word " * 200_000)[0].count("word") == 200_000
    assert texts("<article>" + "<p>x</p>" * 20_000) == ["x"] * 20_000


def generated(article, nav="a", tail="</body></html>"):
    return f"<html><head><title>t</title></head><body><nav><ul><li>{nav}</li></ul></nav><article>{article}</article><footer>&copy; {nav}{tail}"


def test_query_on_given_pages(spark):
    import os

    sf = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    found = {r.page_id: (r.text, r.n_chars) for r in style_tree.main_texts(pages).collect()}
    for page in pages.collect():
        part = page.html.split("<article>", 1)[1].split("</article>")[0]
        cut = re.split("</?(?:p|h1)>", re.sub("</?(?:b|br)>", " ", part))
        blocks = [re.sub(r"\s+", " ", references.unescape(b)).strip() for b in cut]
        text = "\n\n".join(b for b in blocks if b)
        assert found[page.page_id] == (text, len(text))


def test_pages_without_article_lose_what_their_host_repeats(spark, prose):
    def page(i):
        return (
            f"<html><body><div class=top><span>Our shop</span></div><div class=text><p>{prose(30, i)}</p><p>{prose(20, i + 500)}</p></div>"
            "<div class=box><p>Call us today</p></div></body></html>"
        )

    rows = [(i, f"http://x.net/{i}", page(i)) for i in range(12)] + [(100, "http://y.net/", page(100))]
    found = {r.page_id: r.text for r in style_tree.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(12):
        assert found[i] == f"{prose(30, i)}\n\n{prose(20, i + 500)}"
    assert "Our shop" in found[100]  # one page tells nothing about its host


def test_copies_of_an_article_stay(spark):
    rows = [(i, "http://x.net/", generated("<p>same text</p>", nav="home")) for i in range(20)]
    found = style_tree.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(found) == 20 and {r.text for r in found} == {"same text"}


def test_unmarked_copies_are_no_template(spark, prose):
    def page(i, host):
        return (
            f"http://{host}/{i}", f"<html><body><div class=top><span>Our shop</span></div><div class=text><p>{prose(30, i)}</p>"
            f"<p>{prose(20, i + 500)}</p></div><div class=box><p>Call us today</p></div></body></html>",
        )

    rows = [(i, *page(7, "copies.net")) for i in range(20)]  # nothing but copies
    rows += [(100 + i, *page(7, "x.net")) for i in range(300)] + [(1000 + i, *page(i, "x.net")) for i in range(10, 20)]
    found = {r.page_id: r.text for r in style_tree.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    own = f"{prose(30, 7)}\n\n{prose(20, 507)}"
    assert all(own in found[i] for i in range(20))
    assert all(found[100 + i] == own for i in range(300))  # as on a host with eleven pages
    assert all(found[1000 + i] == f"{prose(30, i)}\n\n{prose(20, i + 500)}" for i in range(10, 20))


def test_nulls_and_clashing_names(spark):
    rows = [(1, None, None), (1, None, None), (None, "x", ""), (2, "http://h", "<p>a</p>"), (3, "http://h", "<nav>b</nav>")]
    pages = spark.createDataFrame([(*r, "t", 5, "k") for r in rows], "page_id long, url string, html string, text string, host int, key string")
    found = style_tree.main_texts(pages).collect()
    assert sorted(str((r.page_id, r.url, r.text, r.n_chars)) for r in found) == sorted(
        map(str, [(1, None, "", 0), (1, None, "", 0), (None, "x", "", 0), (2, "http://h", "a", 1), (3, "http://h", "", 0)])
    )
    assert style_tree.main_texts(pages.limit(0)).count() == 0
