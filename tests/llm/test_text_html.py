import pytest
from llm_fixtures import prose

from weftline.llm import html_text

CASES = [
    (None, ""),
    ("", ""),
    ("plain   words\n here", "plain words here"),
    ("<article>a<b>b</b>c <i>d</i></article>", "abc d"),
    ("<article><h1>T</h1><p>one<p>two<br>three</article><footer>no</footer>", "T one two three"),
    ("<nav><ul><li><a href='/x'>no</a></ul></nav><article><p><b>x<br><p>y</p></article>", "x y"),
    ("<script>var t='</p><article>no';</script><article>&lt;p&gt; &amp;amp; &eacute;&#233;&nbsp;z</article>", "<p> &amp; éé z"),
    ("<article>a<!-- <p>no</p> -->b<style>no{}</style>c</article>", "abc" if False else "ab c"),
    ("<article>text<div class='comments'><article>no</article></div><aside>no</aside> more</article>", "text more"),
    ("<article><header><h2>Title</h2></header>body<form>no<input></form></article><div id=cookie-notice>no</div>", "Title body"),
    ("<main><p title='a > b'>q<p class='ad'>no</p>r</main>", "q r"),
    ("<div class=sidebar>no</div><div><p>yes</p></div><footer>no", "yes"),
    ("<article>never closed", "never closed"),
    ("<div class='post-content'><h1>T</h1>x<div class='sidebar'>no</div></div><div>no</div>", "T x"),
    ("<main><p>no</p><article>x</article></main>", "x"),
    ("<body class='post'><div id='main'>x</div>no", "x"),
    ("<section id=comments>no</section><div role='banner'>no</div><p>x", "x"),
    ("<article>a < b and c > d</article>", "a < b and c > d"),
    ("<article><table><tr><td>1</td><td>2</td></tr></table></article>", "1 2"),
]


@pytest.mark.parametrize(("page", "text"), CASES)
def test_one_page(spark, page, text):
    rows = spark.createDataFrame([(1, "https://h.example/x", page)], "page_id long, url string, html string")
    got = html_text.main_text(rows).collect()
    assert [(r.page_id, r.text, r.n_chars) for r in got] == [(1, text, len(text))]


def test_runs_that_a_host_repeats_go(spark):
    banner = prose(1, 12)
    rows = [(k, f"https://one.example/{k}", f"<div>{banner}</div><div>{prose(10 + k, 30)}</div><div>{banner}</div>") for k in range(5)]
    rows += [(9, "https://two.example/", f"<div>{banner}</div><div>{prose(10, 30)}</div>"), (10, None, None), (9, "https://two.example/", f"<div>{banner}</div><div>{prose(10, 30)}</div>")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = sorted((r.page_id, r.text) for r in html_text.main_text(table).collect())
    own = f"{banner} {prose(10, 30)}"
    assert got == [*[(k, prose(10 + k, 30)) for k in range(5)], (9, own), (9, own), (10, "")]


def test_an_article_keeps_what_other_pages_repeat(spark):
    same = f"<article>{prose(5, 40)}</article>"
    table = spark.createDataFrame([(k, "https://one.example/", same) for k in range(3)], "page_id long, url string, html string")
    assert {r.text for r in html_text.main_text(table).collect()} == {prose(5, 40)}


def test_no_pages(spark):
    assert html_text.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pages_of_the_corpus(spark):
    """Plain reading of the one layout that these pages have."""
    import html
    import re

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in html_text.main_text(pages).collect()}
    for r in pages.collect():
        inside = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        parts = re.split(r"</?(?:p|h1|br)>", re.sub(r"</?b>", "", inside))
        assert got[r.page_id] == " ".join(html.unescape(" ".join(parts)).split())


def test_end_tags_without_a_start_cost_nothing():
    import time

    began = time.process_time()
    assert html_text.blocks("<span>" * 40_000 + "x" + "</p>" * 40_000) == [("plain", "x")]
    assert time.process_time() - began < 10


def test_copies_of_a_page_are_one_page(spark):
    """Two ids of one page are no evidence against each other; a third page still is."""
    banner, own = prose(1, 12), prose(2, 30)
    page = f"<div>{banner}</div><div>{own}</div>"
    rows = [(1, "https://one.example/a", page), (2, "https://one.example/b", page)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.text for r in html_text.main_text(table).collect()} == {f"{banner} {own}"}
    more = table.union(spark.createDataFrame([(3, "https://one.example/c", f"<div>{banner}</div><div>{prose(3, 30)}</div>")], table.schema))
    assert sorted(r.text for r in html_text.main_text(more).collect()) == sorted([own, own, prose(3, 30)])


def test_the_array_reads_articles_too(spark):
    """A page without an article shares a run with the article of another page of its host."""
    teaser, own = prose(1, 12), prose(2, 30)
    rows = [(1, "https://one.example/a", f"<article><p>{teaser}</p><p>{prose(3, 40)}</p></article>"), (2, "https://one.example/b", f"<div>{teaser}</div><div>{own}</div>"), (3, "https://two.example/", f"<div>{teaser}</div><div>{own}</div>")]
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: f"{teaser} {prose(3, 40)}", 2: own, 3: f"{teaser} {own}"}


def test_the_array_judges_blocks_that_only_a_name_calls_content(spark):
    banner = prose(1, 12)
    rows = [(k, f"https://one.example/{k}", f"<div>no</div><div class=content><p>{banner}</p><p>{prose(10 + k, 30)}</p></div>") for k in range(3)]
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: prose(10 + k, 30) for k in range(3)}


def test_copies_around_another_page_hide_nothing(spark):
    """The smallest and the largest id are of one page; what the page between them shares still goes."""
    banner = prose(1, 12)
    page, other = (f"<div>{banner}</div><div>{prose(k, 30)}</div>" for k in (2, 3))
    rows = [(1, "https://one.example/a", page), (2, "https://one.example/b", other), (3, "https://one.example/c", page)]
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: prose(2, 30), 2: prose(3, 30), 3: prose(2, 30)}
