"""HTML extraction: pages whose article is known, malformed markup, wrappers."""

from __future__ import annotations

import html
import json
import re

import pyarrow.parquet as pq
import pytest
from pyspark.sql import types as T
from regframe.llm import queries, wrapper

SCHEMA = T.StructType([T.StructField(n, t) for n, t in (("page_id", T.LongType()), ("url", T.StringType()), ("html", T.StringType()), ("row", T.StringType()), ("text", T.StringType()), ("host", T.StringType()))])


def pages_of(spark, pages):
    return spark.createDataFrame([(i, u, h, "r", "t", "h") for i, (u, h) in enumerate(pages)], SCHEMA)


def run(spark, pages):
    return {r["page_id"]: r["text"] for r in wrapper.extract(pages_of(spark, pages)).select("row.page_id", "text").collect()}


def brute(page):
    """The article of the given tables' pages by string search (their layout is known)."""
    m = re.search(r"<article>(.*?)</article>", page, re.S)
    parts = re.split(r"</?(?:p|h1)>", m[1])
    texts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", " " if "<br>" in p else "", p))).strip() for p in parts]
    return "\n\n".join(t for t in texts if t)


def test_query_matches_known_layout(spark):
    sf = "/root/testdata/sf0.01"
    page = {r["page_id"]: r["html"] for r in pq.read_table(f"{sf}/pages.parquet").to_pylist()}
    got = queries.op10_html_extract(spark, sf)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    rows = got.collect()
    assert len(rows) == len(page)
    for r in rows:
        assert r["text"] == brute(page[r["page_id"]]), r["page_id"]
        assert r["n_chars"] == len(r["text"])


def site(body, i, extra=""):
    return (
        f"<html><head><title>t{i}</title><script>var a='<p>x</p>';</script></head><body><header><h1>Site</h1></header>"
        f"<div class='top-menu'><ul><li><a href=/>Home</a></li><li><a href=/b>About</a></li></ul></div>{body}{extra}"
        "<aside>Latest news</aside><div id=comments><p>first! comment</p></div><footer>&copy; me</footer></body></html>"
    )


def test_no_article_tag_uses_the_wrapper(spark):
    def body(i):
        paras = "".join(f"<p>Paragraph {i}.{j} says   something &amp; more.</p>" for j in range(3 + i % 3))
        return f"<div class=wrap><div class=post><h2>Title {i}</h2>{paras}</div><div class=box><p>Always the same words here</p></div></div>"

    got = run(spark, [("http://a.example/x", site(body(i), i, "<div class='cookie-notice'>We use cookies</div>" if i % 2 else "")) for i in range(8)])
    for i in range(8):
        want = [f"Title {i}", *[f"Paragraph {i}.{j} says something & more." for j in range(3 + i % 3)]]
        assert got[i] == "\n\n".join(want), got[i]


def test_optional_and_repeated_parts(spark):
    def body(i):
        parts = "".join(f"<h2>H{i}.{j}</h2><p>a{i}{j}<p>b <b>bold<br>x</b> <a href=#>link</a>" for j in range(1 + i))
        table = "<table><tr><td>c1<td>c2</table>" if i % 2 else ""
        return f"<main><form><input><p>Sign up</form><div class=ad>Buy</div>{parts}{table}<ul><li>one<li>two</ul></main>"

    got = run(spark, [("https://b.example", site(body(i), i)) for i in range(4)])
    for i in range(4):
        want = [t for j in range(1 + i) for t in (f"H{i}.{j}", f"a{i}{j}", "b bold x link")]
        want += ["c1", "c2"] * (i % 2) + ["one", "two"]
        assert got[i] == "\n\n".join(want), got[i]


def test_edges(spark):
    long = "<article>" + "<p>word</p>" * 20_000 + "</article>"
    got = run(spark, [(None, None), ("", ""), ("x", "   "), ("http://c.example", long), ("http://c.example", "plain words only"),
                      ("http://d.example", "<" * 50_000), ("http://d.example", '<a "' * 20_000), ("http://e.example", "<article><p>&lt;b&gt; &#233;&nbsp;x <!-- no --> y</article>"),
                      ("http://e.example", "<div>" * 30_000 + "deep")])
    assert got[0] == got[1] == got[2] == ""
    assert got[3] == "\n\n".join(["word"] * 20_000)
    assert got[4] == "plain words only" and got[7] == "<b> é x y" and got[8] == "deep"
    assert wrapper.extract(pages_of(spark, [])).count() == 0


@pytest.mark.parametrize("order", [1, -1])
def test_wrapper_accepts_all_pages(order):
    pages = ["<article><h1>a</h1><p>x</p><p>y</p></article>", "<article><h1>b</h1><ul><li>1<li>2</ul><p>z</article>", "<article><p>only</article>"][::order]
    trees = [wrapper.parse(p) for p in pages]
    w = wrapper.learn(trees[0])
    for t in trees[1:]:
        w = wrapper.merge(w, wrapper.learn(t))
    w = wrapper.choose(w)
    for t, p in zip(trees, pages):
        assert wrapper.blocks(t, w) == wrapper.blocks(t, wrapper.choose(wrapper.learn(t))), p


def of_host(pages):
    """Texts of the pages of one host, without Spark."""
    trees = [wrapper.learn(wrapper.parse(p)) for p in pages]
    w = trees[0]
    for t in trees[1:]:
        w = wrapper.merge(w, t)
    w = wrapper.choose(w)
    return [wrapper.main_text(p, w) for p in pages]


@pytest.mark.parametrize("tag", ["<p hidden>", "<p role=alert>"])
@pytest.mark.parametrize("at", [0, 1, 2])
def test_flagged_node_does_not_flag_its_like(tag, at):
    pages = [f"<article><h1>T{i}</h1>{tag + 'note</p>' if i == at else ''}<p>text {i}</p><p>more</p></article>" for i in range(3)]
    assert of_host(pages) == [f"T{i}\n\ntext {i}\n\nmore" for i in range(3)]
    assert of_host(pages[at : at + 1]) == [f"T{at}\n\ntext {at}\n\nmore"]


@pytest.mark.parametrize("page", [
    "<body class='has-sidebar'>{}</body>",
    "<body><main class='content with-sidebar'>{}</main></body>",
    "<body><article class='post comments-open' id='related'>{}</article></body>",
    "<body><div class='page has-sidebar'>{}</div><div class=sidebar><p>Side</p></div></body>",
    "<body><div class='post comments-open'><h1>T{}</div><div id=comments><p>first!</p></div></body>",
    "<form id=aspnetForm><div class=wrap>{}</div></form>",
    "<article style=\"overflow:hidden\">{}</article>",
    "<article><div title='hidden gems' data-id=\"comments-3\" data-role=banner>{}</div></article>",
    "<article><div title=hidden data-x='class=ad'>{}</div></article>",
])
def test_loose_names_do_not_flag_the_article(page):
    titled = "<h1>" in page
    for n in (1, 3):
        heads = [f"{i}</h1>" if titled else "" for i in range(n)]
        pages = [page.format(f"{h}<p>The first paragraph, number {i}.</p><p>The second paragraph.</p>") for i, h in enumerate(heads)]
        want = [f"The first paragraph, number {i}.\n\nThe second paragraph." for i in range(n)]
        assert of_host(pages) == [f"T{i}\n\n{x}" if titled else x for i, x in enumerate(want)], page


def test_misread_attribute_beside_longer_text():
    part = "<p style='visibility:hidden'>a</p><p title='hidden gems'>b</p><p data-id='comments-3'>c</p>"
    assert of_host([f"<article>{part}<p>{'long ' * 9}</p></article>"]) == ["a\n\nb\n\nc\n\n" + ("long " * 9).strip()]


def test_long_comments_and_hidden_text_stay_out():
    page = "<h1>T</h1><p>short news of the day</p>{}"
    for other in ("<div id=comments><p>" + "much talk " * 9 + "</p></div>", "<div hidden><p>" + "unseen " * 30 + "</p></div>"):
        assert of_host([f"<article>{page.format(other)}</article>"]) == ["T\n\nshort news of the day"]


def test_outermost_article_without_comments_and_teasers():
    def check(page, want):
        for n in (1, 3):
            assert of_host([page.replace("@", str(i)) for i in range(n)]) == [want.replace("@", str(i)) for i in range(n)], page

    check("<main>body text @, with a teaser<article>teaser</article></main>", "body text @, with a teaser")
    check("<article>body text @, long enough<section><article>a comment</article><article>another</article></section></article>", "body text @, long enough")
    check("<main><h1>T@</h1><article><p>the body of the page</p></article></main>", "T@\n\nthe body of the page")
    check("<main><article><p>one whole post</p></article><article><p>another whole post</p></article></main>", "one whole post\n\nanother whole post")
    check("<main><h1>T@</h1><article>the body of the page<article>reader</article></article></main>", "T@\n\nthe body of the page")
    check(f"<article class=lead><p>lead @</p></article><article class=long><p>{'x' * 500}</p></article>", f"lead @\n\n{'x' * 500}")


def test_teasers_of_other_pages_cost_no_article():
    index = "<main><p>what this site is about, at some length</p><article>teaser @</article></main>"
    pages = [index.replace("@", str(i)) for i in range(5)] + ["<main><h1>T</h1><article>the only whole post</article></main>"]
    assert of_host(pages) == ["what this site is about, at some length"] * 5 + ["T\n\nthe only whole post"]


def learned(pages):
    w = wrapper.learn(wrapper.parse(pages[0]))
    for p in pages[1:]:
        w = wrapper.merge(w, wrapper.learn(wrapper.parse(p)))
    return w


def test_wrapper_does_not_grow_with_names_of_single_pages():
    def page(i):
        return (f"<div class='wrap cat-{i}'><div id='post-{i}' class='post post-{i}'><h2 id='title-{chr(97 + i % 26) * (1 + i // 26)}'>Title {i}</h2>"
                f"<p id=p-{i}>Text {i} of the post.</p></div><div class='box-{i}'><p>Always the same</p></div></div>")

    pages = [page(i) for i in range(200)]
    assert len(json.dumps(learned(pages))) < 2 * len(json.dumps(learned(pages[:2])))
    assert of_host(pages) == [f"Title {i}\n\nText {i} of the post." for i in range(200)]


def test_wrapper_is_bounded_where_class_words_or_tags_vary():
    def page(i):
        word = "".join(chr(97 + int(c)) for c in str(i))
        return f"<article class='post tag-{word}'><h1>T{i}</h1><div class=x{word}>a{i}</div><my-{word}>b{i}</my-{word}><div class=ad>Buy</div></article>"

    pages = [page(i) for i in range(1500)]
    w = learned(pages)
    assert len(json.dumps(w)) < 60_000
    assert of_host(pages) == [f"T{i}\n\na{i}\n\nb{i}" for i in range(1500)]
    wide = "<article>" + "".join(f"<div class={'abcdefghij'[i % 10] * (1 + i % 37)}>{i}</div>" for i in range(3000)) + "</article>"
    assert of_host([wide, wide.replace("<div", "<p>.</p><div", 1)])[0] == "\n\n".join(map(str, range(3000)))


def test_wrappers_looked_up_or_joined(spark, monkeypatch):
    pages = [(f"http://h{i % 3}.example/{i}", f"<div class=w><div class=post><p>Text {i}</p></div><div class=box><p>Same</p></div></div>") for i in range(12)]
    got = run(spark, pages)
    assert got == {i: f"Text {i}" for i in range(12)}
    monkeypatch.setattr(wrapper, "BROADCAST", 0)
    assert run(spark, pages) == got


def test_ids_of_containers_still_tell_parts_apart():
    pages = [f"<div id=body-{i}><div id=text><p>This is the text {i}.</p></div><div id=legal><p>Always the same</p></div></div>" for i in range(5)]
    assert of_host(pages) == [f"This is the text {i}." for i in range(5)]


@pytest.mark.parametrize("depth", [10, 140, 149, 150, 151, 160, 5000])
def test_deep_elements_close_themselves(depth):
    deep = "<div>" * depth + "deep<nav>menu</nav><div class=ad><p>Buy</p></div><footer><div><p>foot</p></div></footer>text" + "</div>" * depth
    page = f"<body><div class=wrap><article><p>first</p>{deep}<p>last</p></article><p>outside</p></div></body>"
    assert of_host([page]) == ["first\n\ndeep\n\ntext\n\nlast"]
    assert of_host([page] * 3) == ["first\n\ndeep\n\ntext\n\nlast"] * 3
    far = "<div>" * depth + "<article><p>the text of the article</p></article><p>aside</p>" + "</div>" * depth + "<p>after</p>"
    assert of_host([far]) == ["the text of the article"]
    assert of_host(["<blockquote>" * depth + "quote" + "</blockquote>" * depth + "<p>after</p>"])[0] in ("quote\n\nafter", "quote", "after")
    quotes = "<article>" + "<blockquote>" * depth + "quote" + "</blockquote>" * depth + "<p>after</p></article><p>outside</p>"
    assert of_host([quotes]) == ["quote\n\nafter"]


def test_deep_articles_and_boilerplate_stay_bounded():
    page = "<div>" * 200 + "<article>x" * 500 + "<nav>y" * 5000
    got = of_host([page] * 2)
    assert got[0] == got[1] == "\n\n".join("x" * 500)


def test_deep_menu_inside_a_lifted_flag():
    page = "<div class=has-sidebar><p>first words of the text</p>" + "<div>" * 160 + "deep<nav>menu</nav>" + "</div>" * 160 + "<p>last</p></div>"
    assert of_host([page]) == ["first words of the text\n\ndeep\n\nlast"]
    assert of_host(["<article>" + "<div class=ad>" * 3000 + "Buy" + "</div>" * 3000 + "<p>the text of the article</p></article>"] * 2) == ["the text of the article"] * 2


def test_texts_with_an_equal_beginning_differ():
    same = "A templated description of a part, the same on all pages. " * 5
    pages = [f"<div class=w><div class=d>{same}No. {i:04d}</div><div class=n><p>Page {i}</p></div><div class=legal>{same}</div></div>" for i in range(4)]
    want = same.strip()
    assert of_host(pages) == [f"{want} No. {i:04d}\n\nPage {i}" for i in range(4)]
